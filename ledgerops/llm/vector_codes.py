"""Vector code compression: product codebooks with exact integer distances, searched through LAESA pivots.

Vectors become integers and are cut into equal parts; every part position has a
codebook that is refined by rounds of nearest-entry assignment and means. A few
pivots per part position are fixed at the start (those of the first codebook that
lie farthest apart), and each vector part's distances to them are computed once and
written beside its integers. In a round only the distances of pivots and entries
are new: their differences are lower bounds of the distances of parts and entries,
by which entries are tried in order and left out once the bound exceeds the best
exact distance found. Exact distances are integers, so ties are exact as well.
Vectors without structure give weak bounds; where these leave a part most of its
entries, it is cheaper to evaluate all of them in one product, also exactly.

Vectors never move: a round is one pass over the written table that sends one row
of sums per task and entry; the codebooks (at most 256 entries) are all that the
driver holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read_table, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
PIVOTS = 8
FIRST_TRIED = 4             # entries tried first, by their bounds
FEW = 24                    # entries left by the bounds that are evaluated one by one
BLOCK_ROWS = 512            # rows whose bounds are held at once
BLOCK_NUMBERS = 1 << 20     # components of (part, entry) pairs evaluated at once
# Rounding of 32-bit distances, their differences and square roots, relative to the distances.
SLACK = 1e-6


def largest_component(dim: int) -> int:
    """Integers up to this size keep the squared distance of two vectors of ``dim`` components below 2**62."""
    return min(int((2**62 / dim) ** 0.5 / 2), 2**30)


def as_integers(vectors: np.ndarray) -> np.ndarray:
    """(rows, PARTS, part components) of floor(SCALE * x)."""
    whole = np.floor(vectors.astype(np.float64) * SCALE).astype(np.int64)
    return whole.reshape(len(vectors), PARTS, -1)


def choose_pivots(book: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """The entries of one part's codebook that lie farthest from the ones chosen before, beginning with the first."""
    chosen, gap = [0], None
    while len(chosen) < min(n, len(book)):
        d = ((book - book[chosen[-1]]) ** 2).sum(axis=1)
        gap = d if gap is None else np.minimum(gap, d)
        chosen.append(int(gap.argmax()))
    return book[chosen]


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances (points, pivots), each from an exact squared integer."""
    out = np.empty((len(points), len(pivots)))
    for j, pivot in enumerate(pivots):
        out[:, j] = np.sqrt(((points - pivot) ** 2).sum(axis=1))
    return out


def _pair_distances(points: np.ndarray, book: np.ndarray, row: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Squared distances of the pairs (row, entry)."""
    out, step = np.empty(len(row), np.int64), max(1, BLOCK_NUMBERS // max(1, book.shape[1]))
    for i in range(0, len(row), step):
        gap = points[row[i:i + step]] - book[entry[i:i + step]]
        out[i:i + step] = np.einsum("ij,ij->i", gap, gap)
    return out


def _all_distances(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of all points and entries; products go through doubles where these hold them exactly."""
    if len(points) and book.shape[1] * int(np.abs(points).max()) * int(np.abs(book).max()) < 2**53:
        cross = (points.astype(np.float64) @ book.T.astype(np.float64)).astype(np.int64)
        return (points**2).sum(axis=1)[:, None] + (book**2).sum(axis=1)[None, :] - 2 * cross
    row, entry = np.indices((len(points), len(book))).reshape(2, -1)
    return _pair_distances(points, book, row, entry).reshape(len(points), len(book))


def nearest(points: np.ndarray, to_pivots: np.ndarray, book: np.ndarray, book_to_pivots: np.ndarray):
    """(entry, squared distance, evaluated pairs) of every point: the nearest entry of ``book``, ties to the lower index.

    The entries with the least bounds are evaluated first; after that only those
    whose bound does not exceed the best distance. Where the bounds leave a point
    more than FEW entries, all of its entries are evaluated in one product."""
    n, k = len(points), len(book)
    away, book_away = to_pivots.astype(np.float32), book_to_pivots.astype(np.float32)
    bounds, gap = np.zeros((n, k), np.float32), np.empty((n, k), np.float32)
    for j in range(away.shape[1]):
        np.subtract(away[:, j, None], book_away[None, :, j], out=gap)
        np.maximum(bounds, np.abs(gap, out=gap), out=bounds)
    bounds -= np.float32(SLACK) * (away.max(axis=1)[:, None] + book_away.max())
    first = np.argpartition(bounds, FIRST_TRIED - 1, axis=1)[:, :FIRST_TRIED] if k > FIRST_TRIED else np.tile(np.arange(k), (n, 1))
    first.sort(axis=1)  # the leftmost of equal distances is then the lowest entry
    found = _pair_distances(points, book, np.repeat(np.arange(n), first.shape[1]), first.ravel()).reshape(first.shape)
    at = found.argmin(axis=1)
    code, best = first[np.arange(n), at], found[np.arange(n), at]
    np.put_along_axis(bounds, first, np.inf, axis=1)
    # a bound equal to the best distance may still be a tie
    left = bounds <= (np.sqrt(best.astype(np.float64)) * (1 + SLACK)).astype(np.float32)[:, None] * np.float32(1 + SLACK)
    open_entries = left.sum(axis=1)
    dense, sparse = np.flatnonzero(open_entries > FEW), np.flatnonzero((open_entries > 0) & (open_entries <= FEW))
    if len(dense):
        found = _all_distances(points[dense], book)
        code[dense] = found.argmin(axis=1)
        best[dense] = found[np.arange(len(dense)), code[dense]]
    pairs = first.size + len(dense) * k
    if len(sparse):
        row, entry = np.nonzero(left[sparse])
        found = _pair_distances(points, book, sparse[row], entry)
        heads = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        low = np.minimum.reduceat(found, heads)
        lowest = np.minimum.reduceat(np.where(found == np.repeat(low, np.diff([*heads, len(row)])), entry, k), heads)
        better = (low < best[sparse]) | ((low == best[sparse]) & (lowest < code[sparse]))
        code[sparse[better]], best[sparse[better]] = lowest[better], low[better]
        pairs += len(found)
    return code, best, pairs


def _blocks(batch: pa.RecordBatch, dim: int, n_pivots: int):
    """(first row, integers, distances to the pivots) of a batch of the prepared table, block by block."""
    ints = np.frombuffer(b"".join(batch.column("ints").to_pylist()), np.int32).reshape(-1, PARTS, dim // PARTS)
    away = np.frombuffer(b"".join(batch.column("away").to_pylist()), np.float32).reshape(-1, PARTS, n_pivots)
    for i in range(0, len(ints), BLOCK_ROWS):
        yield i, ints[i:i + BLOCK_ROWS].astype(np.int64), away[i:i + BLOCK_ROWS]


def _assigned(batch: pa.RecordBatch, books: np.ndarray, pivots: np.ndarray, books_away: list[np.ndarray]):
    """(first row, integers, codes, errors) of every block of a batch; codes and errors are (rows, PARTS)."""
    for i, ints, away in _blocks(batch, books.shape[2] * PARTS, pivots.shape[1]):
        pairs = [nearest(ints[:, p], away[:, p], books[p], books_away[p]) for p in range(PARTS)]
        yield i, ints, np.stack([c for c, _, _ in pairs], axis=1), np.stack([e for _, e, _ in pairs], axis=1)


def _prepared(fitting: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(vec_id, label, ints, away): 32-bit integers of every vector and its parts' distances to the pivots, written once."""
    label = fitting.schema["label"]

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            values = batch.column("embedding").flatten().to_numpy(zero_copy_only=False)
            ints = as_integers(values.reshape(n, -1)) if n else np.empty((0, PARTS, pivots.shape[2]), np.int64)
            away = np.stack([distances(ints[:, p], pivots[p]) for p in range(PARTS)], axis=1).astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"),
                 pa.array([r.tobytes() for r in ints.astype(np.int32)], pa.binary()), pa.array([r.tobytes() for r in away], pa.binary())],
                names=["vec_id", "label", "ints", "away"])

    schema = f"vec_id long, label {label.dataType.simpleString()}, ints binary, away binary"
    return written(fitting.select("vec_id", "label", "embedding").mapInArrow(prepare, schema), "vector-parts")


def _refined(prepared: DataFrame, books: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The codebooks after one round: means of the parts assigned to each entry, rounded down."""
    size = books.shape[2]
    books_away = [distances(books[p], pivots[p]) for p in range(PARTS)]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((PARTS, books.shape[1], size + 1), np.int64)
        for batch in batches:
            for _, ints, codes, _ in _assigned(batch, books, pivots, books_away):
                for p in range(PARTS):
                    np.add.at(total[p, :, :size], codes[:, p], ints[:, p])
                    np.add.at(total[p, :, size], codes[:, p], 1)
        part, entry = np.nonzero(total[:, :, size])
        yield pa.RecordBatch.from_arrays(
            [pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)),
             pa.array([total[p, e].tolist() for p, e in zip(part, entry, strict=True)], pa.list_(pa.int64()))],
            names=["part", "entry", "sums"])

    rows = prepared.select("ints", "away").mapInArrow(sums, "part int, entry int, sums array<long>")
    found = rows.groupBy("part", "entry").agg(*[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(size + 1)])
    out = books.copy()
    for part, entry, *total in found.collect():  # one row per entry that is in use
        out[part, entry] = [s // total[-1] for s in total[:-1]]
    return out


def _coded(prepared: DataFrame, books: np.ndarray, pivots: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of every prepared vector."""
    books_away = [distances(books[p], pivots[p]) for p in range(PARTS)]
    label = prepared.schema["label"]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, ints, codes, errors in _assigned(batch, books, pivots, books_away):
                text = [r.tobytes().hex() for r in codes.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id").slice(i, len(ints)), batch.column("label").slice(i, len(ints)),
                     pa.array(text, pa.string()), pa.array(errors.sum(axis=1))], names=["vec_id", "label", "code", "error"])

    schema = f"vec_id long, label {label.dataType.simpleString()}, code string, error long"
    return written(prepared.mapInArrow(code, schema), "vector-codes")


def digest_of(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))),
                      F.lit(False))


def compress_vectors(embeddings: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, code, error), codebooks) of ``embeddings`` (vec_id, embedding, label).

    Vectors that are null or hold null, NaN or infinite components are left out. The
    vectors' length is the most frequent one that PARTS divides (ties: the smaller);
    a vector of another length, or with a component so large that squared distances
    would not fit 64 bits (``largest_component``), stays with a null code and error and
    takes no part in the codebooks. The first codebook holds the ENTRIES smallest
    vec_ids (null ids last; rows of one id by their components), fewer if there are
    fewer. Repeated rows are rows of their own; other columns are ignored, whatever
    their names; an empty table gives no rows and empty codebooks."""
    vector = F.col("embedding").cast("array<double>")
    kept = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), vector.alias("embedding")).where(usable(vector))
    common = (kept.groupBy(F.size("embedding").alias("dim")).count().where(f"dim > 0 AND dim % {PARTS} = 0")
              .orderBy(F.desc("count"), "dim").first())
    if common is None:
        none = kept.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
        return none, np.zeros((PARTS, 0, 0), np.int64)
    dim, limit = common["dim"], largest_component(common["dim"])
    fits = (F.size("embedding") == dim) & F.forall("embedding", lambda v: F.abs(v) * SCALE <= limit)
    fitting = kept.where(fits)
    start = [r[0] for r in fitting.orderBy(F.asc_nulls_last("vec_id"), "embedding").select("embedding").limit(ENTRIES).collect()]
    books = as_integers(np.array(start, np.float64).reshape(-1, dim)).transpose(1, 0, 2).copy()
    pivots = np.stack([choose_pivots(book) for book in books]) if start else np.zeros((PARTS, 0, dim // PARTS), np.int64)
    misfits = kept.where(~fits).select("vec_id", "label", F.lit(None).cast("string").alias("code"),
                                       F.lit(None).cast("long").alias("error"))
    if not start:
        return misfits, books
    prepared = _prepared(fitting, pivots)
    for _ in range(ROUNDS):
        books = _refined(prepared, books, pivots)
    return _coded(prepared, books, pivots).unionByName(misfits), books


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    """Code, error, error of the label, and the codebooks' digest of every usable embedding."""
    coded, books = compress_vectors(read_table(spark, sf_dir, "embeddings"))
    # null when a label's sum passes 64 bits; combined map-side, and the join can be split at a large label
    totals = coded.groupBy(F.col("label").alias("_label")).agg(F.try_sum("error").alias("label_error"))
    return coded.join(totals, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest_of(books)).alias("codebooks_sha256"))


def _sql_round(i: int) -> str:
    """Codebook i + 1 from the parts assigned to codebook i."""
    return f"""
a{i} AS MATERIALIZED ({_sql_assign(i)}),
m{i} AS (
  SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (
    SELECT p, e, i, sum(x) AS s, count(*) AS n FROM (
      SELECT a.p, a.best.e AS e, unnest(q.v) AS x, unnest(range(len(q.v))) AS i
      FROM a{i} a JOIN parts q ON a.vec_id = q.vec_id AND a.p = q.p)
    GROUP BY p, e, i) GROUP BY p, e),
c{i + 1} AS MATERIALIZED (
  SELECT c.p, c.e, CAST(coalesce(m.v, c.v) AS BIGINT[]) AS v FROM c{i} c LEFT JOIN m{i} m ON c.p = m.p AND c.e = m.e)"""


def _sql_assign(i: int) -> str:
    return f"""
  SELECT q.vec_id, q.p, min({{'d': list_sum(list_transform(list_zip(q.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': c.e}}) AS best
  FROM parts q JOIN c{i} c ON q.p = c.p GROUP BY q.vec_id, q.p"""


OP11_SQL = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT vec_id, p, list_slice(v, p * (len(v) // {PARTS}) + 1, (p + 1) * (len(v) // {PARTS})) AS v
  FROM kept, range({PARTS}) AS t(p)),
c0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v FROM parts QUALIFY e < {ENTRIES}),
{",".join(_sql_round(i) for i in range(ROUNDS))},
last AS MATERIALIZED ({_sql_assign(ROUNDS)}),
coded AS (
  SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM last GROUP BY vec_id),
books AS (
  SELECT sha256(string_agg(x, ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM (
    SELECT p, e, CAST(unnest(v) AS VARCHAR) AS x, unnest(range(len(v))) AS i FROM c{ROUNDS}))
SELECT k.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept k JOIN coded USING (vec_id), books
"""
