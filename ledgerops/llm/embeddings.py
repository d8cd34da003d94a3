"""Embedding near-duplicates by a robust-pruned flat graph.

Vectors of one label (and one length) are compared by cosine. Equal vectors are
one node. Nodes go to the shards of their nearest centroids, several each, so
shards overlap; a shard too large for one task is split into blocks and every
pair of blocks is a task. Each task builds a graph of its nodes by robust
pruning; the adjacency lists that a node got in its tasks are united. Then each
task searches all its nodes greedily from the medoids of its graph, and wherever
the search comes into range it expands every node in range. Links are verified
by their cosine in double precision. Per node only its number of links and one
link to its group's smallest node leave a task. An audit compares the links of a
bounded sample of nodes with brute force over all rows and widens the overlap
while recall is too low.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import component_labels, connected_components, empty_batch, read_table, written

THRESHOLD = 0.98
SHARD_ROWS = 256          # nodes per centroid; a shard holds about OVERLAP times as many
MAX_BLOCK = 1536          # nodes of one task; larger shards are split into pairs of half as large blocks
MAX_CENTROIDS = 1024      # per label, so that what is broadcast stays bounded
SAMPLE_ROWS = 20_000      # nodes that the centroids are fitted on
OVERLAP = 3               # nearest centroids of a node
AUDIT_ROWS = 256
RECALL = 0.97             # the overlap is doubled until the audit reaches it
MAX_OVERLAP, LEAST_RECALL = 12, 0.9  # the last overlap, and the recall below which it is an error
CANDIDATES, BEAM, STEP, ALPHA = 48, 16, 6, 1.2
SPREAD = 1 << 20          # neighbours of expanded nodes that a search marks at once


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision (scaled by their largest part first, so nothing overflows)."""
    x = vectors.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def robust_prune(cosine: np.ndarray, candidates: int = CANDIDATES, alpha: float = ALPHA) -> tuple[np.ndarray, np.ndarray]:
    """(node, neighbour) links: of a node's nearest candidates each is kept unless one kept before is
    ``alpha`` times nearer to it than the node is. Links go both ways."""
    n = len(cosine)
    if n < 2:
        return np.array([], np.int64), np.array([], np.int64)
    c = min(candidates, n - 1)
    near = cosine.copy()
    np.fill_diagonal(near, -np.inf)
    pool = np.argpartition(-near, c - 1, axis=1)[:, :c]
    rows = np.arange(n)[:, None]
    pool = pool[rows, np.argsort(-near[rows, pool], axis=1, kind="stable")]
    distance = np.sqrt(np.maximum(0, 2 - 2 * near[rows, pool]))
    alive = np.ones((n, c), bool)
    for i in range(c - 1):
        to = np.sqrt(np.maximum(0, 2 - 2 * cosine[pool[:, i][:, None], pool[:, i + 1:]]))
        alive[:, i + 1:] &= ~(alive[:, i][:, None] & (alpha * to <= distance[:, i + 1:]))
    node, place = np.nonzero(alive)
    other = pool[node, place]
    return np.concatenate([node, other]), np.concatenate([other, node])


def neighbour_lists(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct neighbours of every node, one list after the other, and where each list begins."""
    pair = np.unique(a * n + b)
    return pair % n, np.searchsorted(pair // n, np.arange(n + 1))


def range_search(x: np.ndarray, lists: np.ndarray, begin: np.ndarray, entries: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of nodes a search of every node finds at ``threshold`` or more (boolean, node by node).

    All nodes are searched in step, from the medoids and their own lists. A round expands, for every query, each node
    in range and the best few open nodes of its beam; it ends when the beam and
    everything in range are expanded."""
    n = len(x)
    cosine = np.full((n, n), -np.inf)
    expanded, wanted = np.zeros((n, n), bool), np.zeros((n, n), bool)
    cosine[:, entries] = x @ x[entries].T
    np.fill_diagonal(cosine, 1.0)  # the query's own list is in range from the start
    beam = min(BEAM, n)
    rows = np.arange(n)
    slack = threshold - 1e-9
    while len(rows):
        sub = cosine[rows]
        open_ = np.where(expanded[rows], -np.inf, sub)
        least = np.partition(sub, n - beam, axis=1)[:, n - beam]  # worst of the beam
        step = min(STEP, n)
        best = np.argpartition(-open_, step - 1, axis=1)[:, :step]
        chosen = open_ >= slack
        value = np.take_along_axis(open_, best, axis=1)
        good = (value >= least[:, None]) & (value > -np.inf)
        at, place = np.nonzero(good)
        chosen[at, best[at, place]] = True
        at, node = np.nonzero(chosen)
        busy = chosen.any(axis=1)
        if not len(at):
            break
        query = rows[at]
        expanded[query, node] = True
        wanted[:] = False
        size = np.cumsum(begin[node + 1] - begin[node])
        lo = 0
        while lo < len(node):  # so many neighbours at once, whatever the lists' lengths
            hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + SPREAD, side="right")))
            length = begin[node[lo:hi] + 1] - begin[node[lo:hi]]
            spread = np.arange(length.sum()) + np.repeat(begin[node[lo:hi]] - (np.cumsum(length) - length), length)
            wanted[np.repeat(query[lo:hi], length), lists[spread]] = True
            lo = hi
        q, v = np.nonzero(wanted & (cosine == -np.inf))
        for lo in range(0, len(q), 1 << 18):
            a, b = q[lo:lo + (1 << 18)], v[lo:lo + (1 << 18)]
            cosine[a, b] = np.einsum("ij,ij->i", x[a], x[b])
        rows = rows[busy]
    found = cosine >= threshold
    found |= found.T
    np.fill_diagonal(found, False)
    return found


def medoids(x: np.ndarray, lists: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The node nearest to the mean, in every connected part of the graph."""
    n = len(x)
    label = component_labels(n, np.repeat(np.arange(n), np.diff(begin)), lists)
    out = []
    for part in np.unique(label):
        member = np.flatnonzero(label == part)
        out.append(member[np.argmax(x[member] @ x[member].mean(axis=0))])
    return np.array(out)


def fit_centroids(nodes: DataFrame, seed: int = 7) -> dict[tuple, np.ndarray]:
    """Unit centroids per (label, length), fitted by k-means on at most SAMPLE_ROWS nodes."""
    counts = {(r["label"], r["dim"]): r["n"] for r in nodes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"))
              .orderBy(F.desc("n")).limit(SAMPLE_ROWS).collect()}
    sample = nodes.orderBy(F.xxhash64("node")).limit(SAMPLE_ROWS).select("label", "dim", "embedding").collect()
    rows: dict[tuple, list] = {}
    for r in sample:
        rows.setdefault((r["label"], r["dim"]), []).append(r["embedding"])
    rng = np.random.default_rng(seed)
    out = {}
    for key, vectors in rows.items():
        x = unit(np.array(vectors, np.float64))
        k = max(1, min(MAX_CENTROIDS, len(x), round(counts.get(key, 1) / SHARD_ROWS)))
        centre = x[rng.choice(len(x), k, replace=False)]
        for _ in range(8 if k > 1 else 0):
            nearest = np.argmax(x @ centre.T, axis=1)
            total = np.zeros_like(centre)
            np.add.at(total, nearest, x)
            norm = np.sqrt((total * total).sum(axis=1, keepdims=True))
            centre = np.where(norm > 0, total / np.maximum(norm, 1e-300), centre)
        out[key] = centre
    return out


MEMBER = "shard long, task int, node long, embedding array<float>, shards array<long>, block int"


def shard_members(nodes: DataFrame, centroids: dict, overlap: int) -> DataFrame:
    """(shard, node, embedding, shards): every node in the shards of its nearest centroids."""
    base, start = {}, 0
    for key in sorted(centroids, key=str):
        base[key], start = start, start + len(centroids[key])
    shared = nodes.sparkSession.sparkContext.broadcast((centroids, base, start))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, base, start = shared.value
        for batch in batches:
            labels, dims = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            vectors = batch.column(3)
            shards: list = [None] * len(batch)
            pairs = np.stack([labels.astype(np.int64), dims.astype(np.int64)], axis=1) if len(batch) else np.empty((0, 2), int)
            for label, dim in np.unique(pairs, axis=0).tolist():
                rows = np.flatnonzero((pairs == (label, dim)).all(axis=1))
                x = unit(np.stack([np.asarray(v) for v in vectors.take(pa.array(rows)).to_pylist()]))
                centre = centroids.get((label, dim))
                if centre is None:  # a label that the sample does not hold has one shard of its own
                    for r in rows:
                        shards[r] = [start + (hash((label, dim)) & 0x7FFFFFFF)]
                    continue
                m = min(overlap, len(centre))
                near = np.argpartition(-(x @ centre.T), m - 1, axis=1)[:, :m]
                for r, s in zip(rows, np.sort(near, axis=1) + base[label, dim]):
                    shards[r] = s.tolist()
            yield pa.RecordBatch.from_arrays([batch.column(2), vectors, pa.array(shards, pa.list_(pa.int64()))],
                                             names=["node", "embedding", "shards"])

    member = nodes.select("label", "dim", "node", "embedding").mapInArrow(
        run, "node long, embedding array<float>, shards array<long>")
    return member.select(F.explode("shards").alias("shard"), "node", "embedding", "shards")


def task_members(members: DataFrame) -> DataFrame:
    """Members with their task: a shard of more than MAX_BLOCK nodes is cut into blocks, and each pair is a task."""
    sizes = members.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    half = MAX_BLOCK // 2
    blocks = sizes.select(F.col("shard").alias("_s"), F.when(F.col("n") <= MAX_BLOCK, 1)
                          .otherwise(F.ceil(F.col("n") / half)).cast("int").alias("blocks"))
    rows = members.join(blocks, F.col("shard") == F.col("_s")).withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # the tasks of a block: its pairs with every block, as a * blocks + b for a <= b
    task = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1),
                       lambda b: F.least(b, F.col("block")) * F.col("blocks") + F.greatest(b, F.col("block")))
    return rows.select("shard", F.explode(task).alias("task"), "node", "embedding", "shards", "block")


def _by_task(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """One table per (shard, task) of batches sorted by both."""
    held, current = [], None
    for batch in batches:
        if not len(batch):
            continue
        shard, task = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        edges = np.flatnonzero(np.concatenate([[True], (shard[1:] != shard[:-1]) | (task[1:] != task[:-1]), [True]]))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if held and (shard[a], task[a]) != current:
                yield current, pa.Table.from_batches(held)
                held = []
            current = (shard[a], task[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield current, pa.Table.from_batches(held)


def _vectors(table: pa.Table) -> np.ndarray:
    column = table.column("embedding").combine_chunks()
    return unit(column.flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1))


def graph_lists(tasks: DataFrame) -> DataFrame:
    """(node, near): the united adjacency lists that robust pruning gives a node in all its tasks."""
    out = pa.schema([("node", pa.int64()), ("near", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = False
        for _, table in _by_task(batches):
            node, x = table.column("node").to_numpy(), _vectors(table)
            lists, begin = neighbour_lists(len(x), *robust_prune(x @ x.T))
            some = True
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.ListArray.from_arrays(
                pa.array(begin.astype(np.int32)), pa.array(node[lists]))], schema=out)
        if not some:
            yield empty_batch(out)

    lists = (tasks.repartition("shard", "task").sortWithinPartitions("shard", "task")
             .mapInArrow(run, "node long, near array<long>"))
    return lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))


def search_tasks(tasks: DataFrame, threshold: float) -> DataFrame:
    """(node, low, weight): per task and node the smallest node of its group in the task and the rows its links
    count. A pair that shares several shards counts in the first of them only."""
    out = pa.schema([("node", pa.int64()), ("low", pa.int64()), ("weight", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = False
        for (shard, _), table in _by_task(batches):
            node, x = table.column("node").to_numpy(), _vectors(table)
            n = len(node)
            order = np.argsort(node)
            near = table.column("near").combine_chunks()
            size = np.diff(near.offsets.to_numpy())
            owner, to = np.repeat(np.arange(n), size), near.flatten().to_numpy(zero_copy_only=False)
            place = np.minimum(np.searchsorted(node[order], to), n - 1)
            here = node[order][place] == to  # the united lists also name nodes of other tasks
            lists, begin = neighbour_lists(n, owner[here], order[place[here]])
            found = range_search(x, lists, begin, medoids(x, lists, begin), threshold)
            block = table.column("block").to_numpy()
            if block.min() != block.max():  # a pair of blocks: pairs within a block belong to that block's own task
                found &= block[:, None] != block[None, :]
            a, b = np.nonzero(found)
            label = component_labels(n, a, b)
            # the first shard that both have
            member = table.column("shards").to_pylist()
            first = np.array([m[0] for m in member])
            counted = np.ones(len(a), bool)
            if shard != first.min() or shard != first.max():
                width = max(map(len, member))
                grid = np.array([m + [-1] * (width - len(m)) for m in member])
                for i in range(width):  # an earlier common shard of the pair takes the count
                    earlier = grid[a, i]
                    counted &= ~((earlier >= 0) & (earlier < shard) & (grid[b] == earlier[:, None]).any(axis=1))
            copies = table.column("copies").to_numpy()
            weight = np.bincount(a[counted], copies[b[counted]], minlength=n).astype(np.int64)
            some = True
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(node[label]), pa.array(weight)], schema=out)
        if not some:
            yield empty_batch(out)

    return (tasks.repartition("shard", "task").sortWithinPartitions("shard", "task")
            .select("shard", "task", "node", "embedding", "shards", "block", "near", "copies")
            .mapInArrow(run, "node long, low long, weight long"))


def audit(nodes: DataFrame, found: DataFrame, threshold: float) -> float:
    """Recall of the links of at most AUDIT_ROWS nodes, by brute force over all nodes."""
    chosen = nodes.orderBy(F.xxhash64(F.lit(1), "node")).limit(AUDIT_ROWS).select("label", "dim", "node", "embedding").collect()
    if not chosen:
        return 1.0
    picks: dict[tuple, tuple] = {}
    for key in {(r["label"], r["dim"]) for r in chosen}:
        own = [r for r in chosen if (r["label"], r["dim"]) == key]
        picks[key] = (np.array([r["node"] for r in own]), unit(np.array([r["embedding"] for r in own])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, dims, node, copies = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 4))
            for (label, dim), (ids, x) in picks.items():
                rows = np.flatnonzero((labels == label) & (dims == dim))
                if len(rows):
                    y = unit(np.array(batch.column(3).take(pa.array(rows)).to_pylist()))
                    linked = (x @ y.T >= threshold) & (ids[:, None] != node[rows][None, :])
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array((linked * copies[rows][None, :]).sum(axis=1))],
                                                     names=["node", "weight"])

    true = nodes.select("label", "dim", "node", "embedding", "copies").mapInArrow(run, "node long, weight long").agg(
        F.sum("weight")).first()[0] or 0
    ids = [r["node"] for r in chosen]
    got = found.where(F.col("node").isin(ids)).agg(F.sum("weight")).first()[0] or 0
    return got / true if true else 1.0


def link_components(embeddings: DataFrame, threshold: float = THRESHOLD, overlap: int = OVERLAP,
                    recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``embeddings`` (vec_id, embedding, label).

    n_links counts the other rows linked directly, component_id is the smallest
    vec_id reachable. Rows with a null label, vec_id or vector, with null or
    non-finite parts, or all zero link with nothing: n_links 0, component_id the
    own vec_id, kept (a null vec_id has a null component_id and is not kept).
    Equal rows are rows of their own and linked with each other."""
    value = F.col("embedding").cast("array<float>")
    usable = (F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
              & F.forall(value, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
              & F.exists(value, lambda v: v != 0))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                             value.alias("embedding"), F.coalesce(usable, F.lit(False)).alias("usable"),
                             F.xxhash64(value).alias("h1"), F.xxhash64(F.lit(1), value).alias("h2"))
    # equal vectors of a label are one node; combined map-side, so copies of any number are one row each task
    classes = written(rows.where("usable").groupBy("label", "h1", "h2").agg(
        F.first("embedding").alias("embedding"), F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("copies"))
        .withColumn("dim", F.size("embedding")).withColumn("node", F.monotonically_increasing_id()), "embedding-nodes")
    nodes = classes.select("label", "dim", "node", "embedding", "copies")
    centroids = fit_centroids(nodes)
    while True:
        tasks = written(task_members(shard_members(nodes, centroids, overlap)), "embedding-tasks")
        lists = graph_lists(tasks)
        copies = nodes.select(F.col("node").alias("_n"), "copies")
        ready = tasks.join(lists, "node").join(copies, F.col("node") == F.col("_n"))
        found = written(search_tasks(ready, threshold), "embedding-links")
        reached = audit(nodes, found, threshold)
        if reached >= recall or overlap >= MAX_OVERLAP and reached >= LEAST_RECALL:
            break
        if overlap >= MAX_OVERLAP:
            raise RuntimeError(f"recall {reached:.3f} is below {LEAST_RECALL} at overlap {overlap}: give a larger one to begin with")
        overlap *= 2
    parts = connected_components(found.where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")),
                                 "embedding-components")
    per_node = found.groupBy("node").agg(F.sum("weight").alias("weight"))
    joined = (classes.select("label", "h1", "h2", "node", "low", "copies").join(per_node, "node", "left")
              .join(parts, "node", "left").withColumn("root", F.coalesce("component", "node")))
    lowest = joined.groupBy(F.col("root").alias("_r")).agg(F.min("low").alias("component_id"))
    known = joined.join(lowest, F.col("root") == F.col("_r")).select(
        F.col("label").alias("_l"), F.col("h1").alias("_1"), F.col("h2").alias("_2"), "component_id",
        (F.coalesce("weight", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.select("vec_id", "label", "h1", "h2", "usable").join(
        known, F.col("usable") & (F.col("label") == F.col("_l")) & (F.col("h1") == F.col("_1")) & (F.col("h2") == F.col("_2")),
        "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op9_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Links and component of every embedding."""
    return link_components(read_table(spark, sf_dir, "embeddings"))


OP9_SQL = f"""
WITH RECURSIVE vectors AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= {THRESHOLD}),
reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
lowest AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN lowest USING (vec_id)
"""
