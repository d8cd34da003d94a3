"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments (22, 21, 21 bits). Two
fingerprints at two or fewer differing bits agree exactly on some segment while
the next segment (cyclic) differs in at most one bit: with errors (2,0,0) one of
the two clean segments is followed by the other, with (1,1,0) the clean one is
followed by a segment with one error. The perfect Golay (23,12,7) code makes
"at most one bit" a key: every 23-bit word decodes to exactly one codeword, and
a segment gets the indices of all codewords that it, or a word one bit away,
decodes to (1 to 7 keys). Two segments one bit apart share at least one index.
A key is (segment number, exact segment, codeword index of the next segment).
Candidates of one key are verified by XOR and bit count.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import component_labels, connected_components, each_text, empty_batch, written

SEGMENTS = ((42, 22), (21, 21), (0, 21))  # (lowest bit, width)
# Fixed value: generator polynomial of the (23,12) Golay code, x^11+x^10+x^6+x^5+x^4+x^2+1.
GOLAY_POLY = 0b110001110101
PAIR_BLOCK = 512
HASH_BLOCK = 1 << 16


def _golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndrome of each byte at its three places, and the error pattern of each syndrome."""
    bit = []
    for i in range(23):
        r = 1 << i
        for j in range(22, 10, -1):
            if r >> j & 1:
                r ^= GOLAY_POLY << (j - 11)
        bit.append(r)
    synd = np.zeros((3, 256), np.int64)
    for place in range(3):
        for v in range(256):
            for i in range(8):
                if v >> i & 1 and place * 8 + i < 23:
                    synd[place, v] ^= bit[place * 8 + i]
    error = np.zeros(2048, np.int64)
    for weight in (1, 2, 3):
        for places in combinations(range(23), weight):
            s = 0
            for i in places:
                s ^= bit[i]
            error[s] = sum(1 << i for i in places)
    return synd, error


def golay_index(words: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Index (12 message bits) of the one codeword within three bits of each 23-bit word."""
    synd, error = tables
    s = synd[0][words & 255] ^ synd[1][(words >> 8) & 255] ^ synd[2][words >> 16]
    return (words ^ error[s]) >> 11


def fuzzy_keys(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(position of the fingerprint, key) for every key of every fingerprint."""
    tables = _golay_tables()
    value = [((fps >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64) for low, width in SEGMENTS]
    places, keys = [], []
    for i in range(3):
        nxt = (i + 1) % 3
        flips = np.array([0] + ([1 << b for b in range(SEGMENTS[nxt][1])] if max_bits else []), np.int64)
        index = np.sort(golay_index(value[nxt][:, None] ^ flips[None, :], tables), axis=1)
        first = np.ones(index.shape, bool)
        first[:, 1:] = index[:, 1:] != index[:, :-1]
        row, col = np.nonzero(first)
        places.append(row)
        keys.append((np.int64(i) << 34) | (value[i][row] << 12) | index[row, col])
    return np.concatenate(places), np.concatenate(keys)


def links_within(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components (fingerprints at ``max_bits`` or fewer bits) of one key's distinct members.

    Small groups compare all members; a larger one meets at shared words one bit
    away (two words at two bits have such a word in common), which takes 65 keys
    a member instead of all pairs and finds the same components."""
    n = len(fps)
    if n <= PAIR_BLOCK or max_bits < 2:
        if max_bits < 2 and n > PAIR_BLOCK:
            blocks = [(i, min(i + PAIR_BLOCK, n)) for i in range(0, n, PAIR_BLOCK)]
        else:
            blocks = [(0, n)]
        found = []
        for lo, hi in blocks:
            i, j = np.nonzero(np.bitwise_count(fps[lo:hi, None] ^ fps[None, :]) <= max_bits)
            found.append((i + lo, j))
        a, b = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    else:
        flips = np.concatenate([[np.uint64(0)], np.uint64(1) << np.arange(64, dtype=np.uint64)])
        near = (fps[:, None] ^ flips[None, :]).ravel()
        owner = np.repeat(np.arange(n), len(flips))
        order = np.argsort(near, kind="stable")
        near, owner = near[order], owner[order]
        same = near[1:] == near[:-1]
        a, b = owner[1:][same], owner[:-1][same]
    label = component_labels(n, a, b)
    member = np.flatnonzero(label != np.arange(n))
    return member, label[member]


def fingerprint(text: bytes, shingle: int) -> int:
    """64-bit SimHash of a text's word shingles (repeats count; no words: zero)."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    counts = np.zeros((8, 256), np.int64)
    digest = xxhash.xxh64_intdigest
    for start in range(0, n, HASH_BLOCK):
        part = words[start:min(start + HASH_BLOCK, n) + shingle - 1]
        joined = b" ".join(part)
        if len(part) < shingle:
            hashes = [digest(joined, 42)]
        else:
            ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
            starts = np.concatenate([[0], ends[:-1]]).tolist()
            ends = (ends - 1).tolist()
            hashes = [digest(joined[s:e], 42) for s, e in zip(starts, ends[shingle - 1:])]
        octets = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
        for place in range(8):
            counts[place] += np.bincount(octets[:, place], minlength=256)
    bits = (np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1
    over = (counts @ bits).ravel() * 2 > n
    return int((over.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


def _with_fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """``docs`` with ``text``, its last column, replaced by ``fp``: the fingerprint's 64 bits as a signed long."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema.fields[:-1]) + ", fp long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in each_text(batch.column(batch.num_columns - 1))], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps.view(np.int64))],
                                             names=[*batch.schema.names[:-1], "fp"])

    return docs.mapInArrow(run, schema)


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint's 64 bits as a signed long. A null text has no words."""
    return _with_fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")),
                              shingle)


def fingerprint_links(distinct: DataFrame, max_bits: int) -> DataFrame:
    """Verified links (a, b) between distinct fingerprints that span all components."""
    if not 0 <= max_bits <= 2:
        raise ValueError("the three-segment keys cover a distance of 0 to 2 bits")
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for lo in range(0, len(fps), HASH_BLOCK):
                part = fps[lo:lo + HASH_BLOCK]
                place, key = fuzzy_keys(part, max_bits)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[place].view(np.int64))],
                                                 names=["key", "fp"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False))
                for b in batches]
        if not rows:
            yield empty_batch(out)
            return
        key, fp = (np.concatenate([r[i] for r in rows]) for i in (0, 1))
        order = np.lexsort((fp, key))
        key, fp = key[order], fp[order].view(np.uint64)
        edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        for lo, hi in zip(edges[:-1][np.diff(edges) > 1], edges[1:][np.diff(edges) > 1]):
            group = fp[lo:hi]
            i, j = links_within(group, max_bits)
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(group[i].view(np.int64)), pa.array(group[j].view(np.int64))],
                                                 schema=out)

    return distinct.select("fp").mapInArrow(keys, "key long, fp long").repartition("key").mapInArrow(join, "a long, b long")


def _components_of(rows: DataFrame, max_bits: int) -> DataFrame:
    """(fp, low, root) of every distinct fingerprint of rows (doc_id, fp): its smallest doc_id and its component."""
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = connected_components(fingerprint_links(distinct, max_bits), "simhash-links")
    return distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "low", F.coalesce("component", "fp").alias("root"))


def simhash_components(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) per row of ``docs``; component_id is the smallest doc_id reachable by links.

    Equal fingerprints are one node, so a group of copies of any size is one row
    before the key join. Nulls: a null text has the zero fingerprint; a null
    doc_id is kept as a row and takes part in links, and component_id is null
    only where every reachable doc_id is null. Repeated rows stay repeated."""
    rows = written(fingerprints(docs, shingle), "simhash-fp")
    node = _components_of(rows, max_bits)
    low = node.groupBy("root").agg(F.min("low").alias("component_id"))
    by_fp = node.join(low, "root").select("fp", "component_id")
    return rows.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def keep_one_per_component(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """Exactly one row of ``docs`` for each component: the one with the smallest doc_id (null last), then text hash.

    Rows are told apart by doc_id and text, so a doc_id with two texts loses only
    the text that is a copy, and null doc_ids are rows like any other. Of rows equal
    in doc_id and text one stays, with its other columns. A null text has no words
    and counts with all texts without words; very long texts are hashed whole; an
    empty table gives no rows. Columns keep their names, order and types."""
    body = F.col("text").cast("string")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(body).alias("t1"),
                      F.xxhash64(F.lit(1), body).alias("t2"), body.alias("text"))
    rows = written(_with_fingerprints(own, shingle).groupBy("doc_id", "t1", "t2", "fp").agg(F.count(F.lit(1)).alias("n")), "simhash-rows")
    by_fp = rows.join(_components_of(rows, max_bits), "fp")
    key = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "t1", "t2")
    ranked = written(by_fp.select("root", key.alias("key"), "n"), "simhash-ranked")
    # combined map-side: a component that holds a large part of all rows is one row per task
    first = ranked.groupBy("root").agg(F.min("key").alias("first"))
    again = written(ranked.join(first, "root").where("key <> first OR n > 1").select(
        F.col("key.doc_id").alias("_id"), F.col("key.t1").alias("_t1"), F.col("key.t2").alias("_t2"), (F.col("key") == F.col("first")).alias("_stays")),
        "simhash-again")

    def same(marks: DataFrame):
        text = docs["text"].cast("string")
        return (docs["doc_id"].cast("long").eqNullSafe(marks["_id"]) & (F.xxhash64(text) == marks["_t1"])
                & (F.xxhash64(F.lit(1), text) == marks["_t2"]))

    kept = docs.join(again, same(again), "left_anti")
    repeated = again.where("_stays")
    if repeated.isEmpty():
        return kept
    # equal rows of a kept document: one of them, whichever
    copies = docs.join(repeated, same(repeated)).groupBy(*[repeated[c] for c in ("_id", "_t1", "_t2")]).agg(
        F.first(F.struct(*[docs[f"`{c}`"] for c in docs.columns])).alias("_row"))
    return kept.unionByName(copies.select("_row.*"))


def op10_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Fingerprint (16 hex digits) and component of every document."""
    from .common import read_table

    parts = simhash_components(read_table(spark, sf_dir, "documents"), shingle=3, max_bits=2)
    return parts.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
