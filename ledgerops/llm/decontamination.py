"""Benchmark decontamination by suffix arrays over the training texts.

Every task builds suffix arrays over the words of its documents, shard by shard
(a shard is at most SHARD_WORDS suffixes), and binary-searches all windows of
the benchmark in them. A suffix array is sorted eight bytes at a time, and only
the buckets that some benchmark window falls into are sorted deeper. Neighbouring
hits on one diagonal join to verbatim matches of any length with their places.
No document text is shuffled. The windows are built in tasks as a written table
of blocks, places in the block's text instead of copies of it; blocks are of a
checked size and are sent to the tasks one after the other, each searched over all
documents before the next is read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import each_text, read_table, text_bytes, written

WINDOW = 10
SHARD_WORDS = 1 << 21
SHARD_BYTES = 2 << 20  # of texts searched at a time, or as many as the block's text has if that is more
BLOCK_BYTES = 8 << 20  # benchmark text per broadcast block, about
PIECE_WORDS = 4096     # of an item, and
PIECE_BYTES = 1 << 18  # at most, but for ten longer words
PIECES = pa.schema([("row", pa.int64()), ("item_id", pa.string()), ("first_word", pa.int64()), ("body", pa.binary())])
ARRAYS = ("start", "length", "words", "first", "item", "item_word")
BLOCKS = f"block int, body binary, {', '.join(f'`{a}` binary' for a in ARRAYS)}, ids array<string>"
MATCHES = "array<struct<item_id:string,item_word:int,doc_word:int,n_words:int>>"


def _normal_table() -> bytes:
    """Byte map: A-Z to lower case, every other byte that is no word character to a space."""
    def to(b: int) -> int:
        if 0x41 <= b <= 0x5A:
            return b + 32
        return b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    return bytes(map(to, range(256)))


NORMAL = _normal_table()


def words_of(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


def cut_items(size: int):
    """mapInArrow function (row, item_id, text) -> PIECES: the words of every item, each closed by a space, cut so that
    every window stands in exactly one piece."""
    def cut(batches):
        for batch in batches:
            out = []
            for row, item, text in zip(batch["row"].to_pylist(), batch["item_id"].to_pylist(), text_bytes(batch["text"])):
                words = words_of(text)
                start = end = 0
                while end < len(words):
                    length = 0
                    while end < len(words) and (end - start < size or (end - start < PIECE_WORDS and length < PIECE_BYTES)):
                        length += len(words[end])
                        end += 1
                    out.append((row, item or "", start, b" ".join(words[start:end]) + b" "))
                    start = end - size + 1
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(PIECES)], schema=PIECES)

    return cut


def block_windows(size: int):
    """applyInPandas function: the pieces of one block -> the block, its distinct windows as places in its text, and the
    items that have each (with the first place there)."""
    def build(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values("id")
        body = b"".join(pieces["body"])
        rows = {row: i for i, row in enumerate(dict.fromkeys(pieces["row"]))}
        ids = list(dict(zip(pieces["row"], pieces["item_id"])).values())
        numbers: dict[bytes, int] = {}
        seen: set[tuple[int, int]] = set()
        found, places, base = [], [], 0
        for row, first_word, piece in zip(pieces["row"], pieces["first_word"], pieces["body"]):
            ends = np.flatnonzero(np.frombuffer(piece, np.uint8) == 32) + 1
            starts = [0, *ends[:-1].tolist()]
            for j in range(max(1, len(ends) - size + 1)):
                last = min(j + size, len(ends)) - 1
                lo, hi = starts[j], int(ends[last])
                number = numbers.setdefault(hashlib.blake2b(piece[lo:hi], digest_size=16).digest(), len(numbers))
                if number == len(found):
                    found.append((base + lo, hi - lo, last - j + 1))
                if (number, rows[row]) not in seen:
                    seen.add((number, rows[row]))
                    places.append((number, rows[row], first_word + j))
            base += len(piece)
        start, length, words = np.array(found, np.int64).reshape(-1, 3).T
        number, item, item_word = np.array(places, np.int64).reshape(-1, 3).T
        order = np.argsort(number, kind="stable")
        first = np.searchsorted(number[order], np.arange(len(found) + 1))
        arrays = dict(zip(ARRAYS, (start, length, words, first, item[order], item_word[order])))
        return pd.DataFrame({"block": [pieces["block"].iloc[0]], "body": [body],
                             **{a: [x.astype(np.int64).tobytes()] for a, x in arrays.items()}, "ids": [ids]})

    return build


def _windows(row) -> dict:
    """A row of BLOCKS as arrays; without one, a block without windows."""
    body = bytes(row["body"]) if row else b""
    arrays = {a: np.frombuffer(bytes(row[a]), np.int64) if row else np.zeros(int(a == "first"), np.int64) for a in ARRAYS}
    return {**arrays, "text": np.frombuffer(body + bytes(8), np.uint8), "ids": list(row["ids"]) if row else []}


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start+1, ... of every range, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def locate(text: np.ndarray, starts: np.ndarray, windows: dict):
    """(window, suffix) for every suffix ``text[starts[i]:]`` that begins with a window.

    Sorts the suffixes by their next eight bytes and searches the windows' next
    eight; buckets that hold a longer window are sorted further."""
    lengths, window_start = windows["length"], windows["start"]
    window_view = np.ndarray((len(windows["text"]) - 7,), ">u8", windows["text"], strides=(1,))
    view = np.ndarray((len(text) - 7,), ">u8", text, strides=(1,))
    place, owner = starts, np.arange(len(starts))
    suffix_group = np.zeros(len(starts), np.int64)
    query = np.arange(len(lengths))
    group = np.zeros(len(query), np.int64)
    depth, found = 0, []
    while len(query) and len(place):
        key = view[place + 8 * depth].astype(np.uint64)
        left = np.minimum(lengths[query] - 8 * depth, 8)
        behind = np.where(left < 8, (np.uint64(1) << (8 * (8 - left) % 64).astype(np.uint64)) - np.uint64(1), np.uint64(0))
        high = window_view[window_start[query] + 8 * depth].astype(np.uint64) | behind
        low = high ^ behind
        if depth:
            values, rank = np.unique(np.concatenate([key, low, high]), return_inverse=True)
            rank = rank + np.concatenate([suffix_group, group, group]) * len(values)
            key, low, high = np.split(rank, [len(key), len(key) + len(low)])
        order = np.argsort(key)
        key, place, owner = key[order], place[order], owner[order]
        lo, hi = np.searchsorted(key, low, "left"), np.searchsorted(key, high, "right")
        closed, hit = lengths[query] <= 8 * (depth + 1), hi > lo
        done = closed & hit
        found.append((np.repeat(query[done], (hi - lo)[done]), owner[_ranges(lo[done], (hi - lo)[done])]))
        go = ~closed & hit
        bucket, first, group = np.unique(lo[go], return_index=True, return_inverse=True)
        size = hi[go][first] - bucket
        inside = _ranges(bucket, size)
        place, owner, suffix_group = place[inside], owner[inside], np.repeat(np.arange(len(bucket)), size)
        query, depth = query[go], depth + 1
    return tuple(np.concatenate([f[i] for f in found]) if found else np.array([], np.int64) for i in (0, 1))


def search(texts: list[bytes], windows: dict) -> tuple[np.ndarray, list[np.ndarray]]:
    """Words per text, and the verbatim matches as arrays (text, item, item word, text word, words)."""
    joined = b"".join(t.translate(NORMAL) + b" \x01" for t in texts)
    raw = np.frombuffer(joined, np.uint8)
    ends = raw == 1
    word = (raw != 32) & ~ends
    after = np.concatenate([[False], word[:-1]])
    keep = word | ends | after  # words, one space after each, and the ends of texts
    text = np.concatenate([raw[keep], np.zeros(int(windows["length"].max(initial=1)) + 24, np.uint8)])
    starts = np.flatnonzero((word & ~after)[keep])
    bounds = np.searchsorted(starts, np.flatnonzero(ends[keep]))  # words up to the end of each text
    counts = np.diff(np.concatenate([[0], bounds]))
    hits = []
    for lo in range(0, len(starts), SHARD_WORDS):
        window, suffix = locate(text, starts[lo:lo + SHARD_WORDS], windows)
        hits.append((window, suffix + lo))
    window, at = (np.concatenate([h[i] for h in hits]) if hits else np.array([], np.int64) for i in (0, 1))
    # every item that has the window
    first, last = windows["first"][window], windows["first"][window + 1]
    each = _ranges(first, last - first)
    window, at = np.repeat(window, last - first), np.repeat(at, last - first)
    item, item_word, size = windows["item"][each], windows["item_word"][each], windows["words"][window]
    doc = np.searchsorted(bounds, at, "right")
    doc_word = at - (bounds - counts)[doc]
    # hits in a row on one diagonal are one match
    order = np.lexsort((item_word, doc_word - item_word, item, doc))
    doc, item, item_word, doc_word, size = (x[order] for x in (doc, item, item_word, doc_word, size))
    same = ((doc[1:] == doc[:-1]) & (item[1:] == item[:-1]) & (item_word[1:] == item_word[:-1] + 1)
            & (doc_word[1:] == doc_word[:-1] + 1))
    head = np.flatnonzero(np.concatenate([[True], ~same])) if len(doc) else np.array([], np.int64)
    tail = np.concatenate([head[1:], [len(doc)]]).astype(np.int64) - 1 if len(doc) else head
    return counts, [doc[head], item[head], item_word[head], doc_word[head], tail - head + size[head]]


def hit_words(doc: np.ndarray, start: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
    """Per document: words inside any of its matches."""
    out = np.zeros(n, np.int64)
    if not len(doc):
        return out
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], (start + words)[order]
    # running end of the document's matches so far
    offset = doc * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + offset) - offset
    before = np.concatenate([[0], np.where(doc[1:] == doc[:-1], reach[:-1], 0)])
    np.add.at(out, doc, np.maximum(0, end - np.maximum(start, before)))
    return out


def _parts(texts: Iterable[bytes], least: int = 0):
    """Runs of texts of at most about SHARD_BYTES, or ``least`` if that is more (a longer text is a run of its own)."""
    most = max(SHARD_BYTES, least)
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > most:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def matcher(shared):
    """Arrow function text -> (n_words, matches) for one broadcast block of benchmark windows."""
    @F.arrow_udf(f"struct<n_words:int,matches:{MATCHES}>")
    def find(column: pa.Array) -> pa.Array:
        windows = shared.value
        ids = np.array(windows["ids"], object)
        words, each, base = [], [], 0
        for part in _parts(each_text(column), len(windows["text"])):
            counts, matches = search(part, windows)
            words.append(counts)
            each.append([matches[0] + base, *matches[1:]])
            base += len(part)
        doc, item, item_word, doc_word, size = ([np.concatenate([e[i] for e in each]) for i in range(5)] if each
                                                else [np.array([], np.int64)] * 5)
        offsets = np.searchsorted(doc, np.arange(len(column) + 1)).astype(np.int32)
        fields = [pa.array(ids[item], pa.string()), *(pa.array(x, pa.int32()) for x in (item_word, doc_word, size))]
        found = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(
            fields, names=["item_id", "item_word", "doc_word", "n_words"]))
        counts = np.concatenate(words) if words else np.array([], np.int64)
        return pa.StructArray.from_arrays([pa.array(counts, pa.int32()), found], names=["n_words", "matches"])

    return find


def covered_words():
    """Arrow function matches -> number of words inside any of them."""
    @F.arrow_udf("int")
    def count(matches: pa.Array) -> pa.Array:
        sizes = pc.list_value_length(matches).fill_null(0).to_numpy(zero_copy_only=False)
        flat = matches.flatten()
        doc = np.repeat(np.arange(len(matches)), sizes)
        start, words = (flat.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("doc_word", "n_words"))
        return pa.array(hit_words(doc, start, words, len(matches)), pa.int32())

    return count


def benchmark_blocks(benchmark: DataFrame, size: int = WINDOW) -> tuple[DataFrame, int]:
    """The written table of window blocks, and how many it has. A block is about BLOCK_BYTES of the benchmark's words: pieces
    of items are far smaller, and are dealt out by their own numbers (repeated items to different blocks)."""
    items = benchmark.select(F.monotonically_increasing_id().alias("row"), F.col("item_id").cast("string").alias("item_id"),
                             F.col("text").cast("string").alias("text"))
    cut = items.mapInArrow(cut_items(size), "row long, item_id string, first_word long, body binary")
    pieces = written(cut.withColumn("id", F.monotonically_increasing_id()), "decontamination-pieces")
    total = pieces.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    return written(dealt.groupBy("block").applyInPandas(block_windows(size), BLOCKS), "decontamination-blocks", BLOCK_BYTES), blocks


def _sent(table: DataFrame, block: int):
    """One block of windows (of a size checked when it was dealt), broadcast."""
    rows = table.where(F.col("block") == block).take(1)
    return table.sparkSession.sparkContext.broadcast(_windows(rows[0] if rows else None))


def _digest():
    return F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256)


def _matches_by_block(docs: DataFrame, table: DataFrame, blocks: int) -> DataFrame:
    """(_id, _digest, _matches): the matches of each distinct (doc_id, text) that has any, one block searched at a time."""
    rows = docs.select(F.col("doc_id").alias("_id"), _digest().alias("_digest"), F.col("text").cast("string").alias("text"))
    parts = []
    for b in range(blocks):
        shared = _sent(table, b)
        found = rows.select("_id", "_digest", matcher(shared)("text")["matches"].alias("_matches")).where(F.size("_matches") > 0)
        parts.append(written(found.dropDuplicates(["_id", "_digest"]), "decontamination-matches"))
        shared.destroy()
    found = functools.reduce(DataFrame.unionByName, parts)
    return found.groupBy("_id", "_digest").agg(F.flatten(F.collect_list("_matches")).alias("_matches"))


def _same_row():
    return F.col("doc_id").eqNullSafe(F.col("_id")) & (_digest() == F.col("_digest"))


def word_counts():
    """Arrow function text -> its number of words."""
    @F.arrow_udf("int")
    def count(column: pa.Array) -> pa.Array:
        return pa.array([len(words_of(t)) for t in each_text(column)], pa.int32())

    return count


def match_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, matches) of every row of ``docs``.

    A window is ``window`` consecutive item words, or all words of a shorter
    item; matches are the verbatim runs of such windows (item, word in the item,
    word in the document, words). A window that an item repeats counts at its first
    place there; an item so long that it lies in several blocks has such a place, and
    its runs end, in each. Null texts have no words; items without words
    have no window; items with a null id are reported under an empty id;
    repeated rows and items stay as they are; an empty benchmark matches nothing, an empty table
    gives none. Texts and items may be of any length: documents are searched in shards, items are cut into
    pieces. Other columns of ``docs``, whatever their names, are not looked at.

    A benchmark of one block costs one pass over the texts; each further block is
    another, whose matches are written and put together by document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table, blocks = benchmark_blocks(benchmark, window)
    if blocks == 1:
        rows = rows.select("doc_id", matcher(_sent(table, 0))("text").alias("f")).select("doc_id", "f.n_words", "f.matches")
    else:
        found = _matches_by_block(rows, table, blocks)
        rows = rows.join(found, _same_row(), "left").select(
            "doc_id", word_counts()("text").alias("n_words"), F.coalesce("_matches", F.array().cast(MATCHES)).alias("matches"))
    return rows.select("doc_id", "n_words", covered_words()("matches").alias("n_hit"), "matches")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark occurs, with all their columns (see ``match_documents``
    for odd rows)."""
    table, blocks = benchmark_blocks(benchmark, window)
    if blocks == 1:
        return docs.where(F.size(matcher(_sent(table, 0))(F.col("text").cast("string"))["matches"]) == 0)
    return docs.join(_matches_by_block(docs, table, blocks), _same_row(), "left_anti")


def op2_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """Hit words and items of every document against the whole benchmark."""
    found = match_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    return found.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.col("n_hit").cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def _sql_words(text: str) -> str:
    lowered = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"regexp_extract_all({lowered}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


OP2_SQL = f"""
WITH docs AS (SELECT doc_id, {_sql_words("text")} AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_sql_words("text")} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least({WINDOW}, len(w)) AS n, array_to_string(w[j:j + {WINDOW - 1}], ' ') AS body
  FROM items, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS t(j) WHERE len(w) > 0),
places AS (
  SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS body
  FROM docs, (SELECT DISTINCT n FROM windows) AS sizes, unnest(range(1, len(w) - n + 2)) AS t(p)),
hits AS (SELECT doc_id, p, n, item FROM places JOIN windows USING (n, body)),
words AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS i FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN found ON d.doc_id = found.doc_id
"""
