"""Exact substring dedup by suffix arrays.

Two equal strings of ``length`` bytes share their smallest 32-byte hash at the
same offset. So every such string (a window) belongs to the anchor where its
leftmost smallest hash lies, and a document becomes a list of anchors, each with
the range of window starts that belong to it. Equal windows meet at one anchor
hash:

1. anchors are cut out per batch, equal ones of a batch are combined, and blocks
   of them are dealt out by anchor hash;
2. of anchors with one hash, those with equal bytes repeat the first of them;
   the first of each different byte string is a candidate;
3. the candidates' bytes are fetched and dealt out by hash to shards; each shard
   sorts their suffixes in two stages (suffixes smaller than their successors
   are sorted directly, the others are induced by one scan over the buckets) and
   compares neighbours; windows with a common prefix of ``length`` bytes are equal;
4. all but the first of equal windows are removed.

An anchor hash with very many different byte strings (the edge of a passage that
stands in a large part of all documents) is not gathered: its windows are
compared one by one through a 128-bit digest, an aggregation that combines map-side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_table, text_bytes, written

LENGTH = 100
GRAM = 32                # most bytes of an anchor, a power of two
SEGMENT = 1 << 17        # window starts handled at once
PLACE_BITS = 18
BATCH_BYTES = 8 << 20    # anchors of so much text are combined before the shuffle
BUCKET_BYTES = 4 << 20   # text per anchor bucket
SHARD_BYTES = 4 << 20    # candidate bytes per suffix array, about
HOT_STRINGS = 4096       # different byte strings of one anchor hash that are gathered; more go window by window
HELD_ROWS = 1 << 21
SEPARATOR = 0xFF         # no byte of UTF-8
ANCHORS = "bucket int, rows binary"
ROW = np.dtype([("hash", "<u8"), ("bytes", "<u8"), ("key", "<i8"), ("start", "<i4"), ("more", "<i4")])


# -- anchors ---------------------------------------------------------------------

def gram_size(length: int) -> int:
    """Bytes of an anchor: GRAM, or for short strings the largest power of two up to half their length."""
    return min(GRAM, 1 << (max(length, 2) // 2).bit_length() - 1)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes (a power of two) from every place on."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    factor, size = 0xD6E8FEB86659FD93, 1
    while size < gram:
        h = h[:-size] * np.uint64(factor) + h[size:]
        factor, size = factor * factor % (1 << 64), 2 * size
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def sliding_least(values: np.ndarray, size: int) -> np.ndarray:
    """The smallest of ``size`` values from every place on."""
    least, span = values, 1
    while 2 * span <= size:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = size - span
    return np.minimum(least[:len(least) - rest], least[rest:]) if rest else least


def anchors_of(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window start, further starts, hash) of every anchor of the texts."""
    gram = gram_size(length)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(texts), np.uint8)
    edge = np.zeros(len(data) + 1, np.int8)  # +1 where window starts of a text begin, -1 after its last
    long = sizes >= length
    edge[begin[long]] += 1
    edge[begin[long] + sizes[long] - length + 1] -= 1
    valid = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    low = np.uint64((1 << PLACE_BITS) - 1)
    out = []
    for at in range(0, len(data) - length + 1, SEGMENT):
        part = data[at:at + SEGMENT + length - 1]
        ok = valid[at:at + len(part) - length + 1]
        if not ok.any():
            continue
        hashes = gram_hashes(part, gram)
        place = np.arange(len(hashes), dtype=np.uint64)
        least = sliding_least((hashes & ~low) | place, length - gram + 1) & low
        new = ok.copy()
        new[1:] &= (least[1:] != least[:-1]) | ~ok[:-1]
        start = np.flatnonzero(new)
        # a run ends before the next one or where windows are no longer valid
        stop = np.concatenate([start[1:], [len(ok)]])
        gaps = np.flatnonzero(~ok)
        if len(gaps):
            nearest = np.searchsorted(gaps, start)
            inside = nearest < len(gaps)
            stop[inside] = np.minimum(stop[inside], gaps[nearest[inside]])
        out.append((start + at, stop - start - 1, hashes[least[start].astype(np.int64)]))
    if not out:
        return tuple(np.array([], t) for t in (np.int64, np.int64, np.int64, np.uint64))
    start, more, hashes = (np.concatenate([o[i] for o in out]) for i in range(3))
    text = np.searchsorted(begin, start, "right") - 1
    # texts of no bytes share a begin with the next; the last of them is the one that has the bytes
    return text, start - begin[text], more, hashes


def first_of_equal(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The earliest of the rows with one hash and one byte string, in order; and the other, later rows."""
    rows = rows[np.lexsort((rows["start"], rows["key"], rows["bytes"], rows["hash"]))]
    head = np.ones(len(rows), bool)
    head[1:] = (rows["hash"][1:] != rows["hash"][:-1]) | (rows["bytes"][1:] != rows["bytes"][:-1])
    first = rows[head]
    same = first[np.cumsum(head) - 1]
    # the same place twice (a repeated row of the table) is no later one
    later = ~head & ((rows["key"] != same["key"]) | (rows["start"] != same["start"]))
    return first, rows[later]


def spans(key: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of the byte ranges [start, end) of each key, as disjoint ranges in order."""
    if not len(key):
        return key, start, end
    order = np.lexsort((start, key))
    key, start, end = key[order], start[order], end[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    # ends so far within a key: offset every key beyond the one before
    offset = np.cumsum(new) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + offset) - offset
    new[1:] |= start[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(key)]]) - 1
    return key[first], start[first], reach[last]


# kinds of rows: bytes to remove, candidates for a suffix array, candidates to compare window by window
REMOVE, GATHER, SINGLE = 0, 1, 2
FOUND = "kind int, key long, start int, stop int, hash long"


def _found(kind: int, key, start, stop, hashes=None) -> pa.RecordBatch:
    n = len(key)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, kind, np.int32)), pa.array(np.asarray(key, np.int64)), pa.array(np.asarray(start, np.int32)),
         pa.array(np.asarray(stop, np.int32)),
         pa.array(np.zeros(n, np.int64) if hashes is None else np.ascontiguousarray(hashes).view(np.int64))],
        names=["kind", "key", "start", "stop", "hash"])


def anchor_blocks(keyed: DataFrame, buckets: int, length: int) -> DataFrame:
    """(bucket, rows): anchors of the texts of keyed(_key, _text), in blocks per bucket. Anchors of a batch with
    equal bytes stay one block row each, but all in one place, so that the block compresses."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            texts = text_bytes(batch.column(1))
            at = 0
            while at < len(texts):
                stop, size = at, 0
                while stop < len(texts) and size < BATCH_BYTES:
                    size += len(texts[stop])
                    stop += 1
                part = texts[at:stop]
                text, start, more, hashes = anchors_of(part, length)
                rows = np.empty(len(text), ROW)
                rows["hash"], rows["key"], rows["start"], rows["more"] = hashes, keys[at:stop][text], start, more
                digest = xxhash.xxh3_64_intdigest
                rows["bytes"] = np.fromiter(
                    (digest(part[t][a:b]) for t, a, b in zip(text.tolist(), start.tolist(), (start + more + length).tolist())),
                    np.uint64, len(text))
                bucket = (rows["hash"] >> np.uint64(32)) % np.uint64(buckets)
                order = np.lexsort((rows["start"], rows["key"], bucket))
                rows, bucket = rows[order], bucket[order]
                cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(rows) else np.array([0])
                # a block holds its columns one after the other: equal high bytes compress
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[cut[:-1]].astype(np.int32)),
                     pa.array([b"".join(rows[f][a:b].tobytes() for f in ROW.names) for a, b in zip(cut[:-1], cut[1:])], pa.binary())],
                    names=["bucket", "rows"])
                at = stop

    return keyed.select("_key", "_text").mapInArrow(run, ANCHORS)


def _unpacked(block: bytes) -> np.ndarray:
    n, at = len(block) // ROW.itemsize, 0
    rows = np.empty(n, ROW)
    for f in ROW.names:
        kind = ROW[f]
        rows[f] = np.frombuffer(block, kind, n, at)
        at += n * kind.itemsize
    return rows


class Bucket:
    """The anchors of one bucket, taken block by block; rows of hashes with too many byte strings are let go."""

    def __init__(self, length: int):
        self.length, self.rows, self.fresh, self.size = length, np.empty(0, ROW), [], 0
        self.hot = np.empty(0, np.uint64)

    def add(self, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.fresh.append(rows)
        self.size += len(rows)
        if self.size > HELD_ROWS:
            yield from self.settle()

    def settle(self) -> Iterator[pa.RecordBatch]:
        first, later = first_of_equal(np.concatenate([self.rows, *self.fresh]))
        yield self._remove(later)
        hashes, counts = np.unique(first["hash"], return_counts=True)
        hot = np.union1d(self.hot, hashes[counts > HOT_STRINGS])
        away = np.isin(first["hash"], hot)
        yield self._candidates(SINGLE, first[away])
        self.rows, self.fresh, self.size, self.hot = first[~away], [], 0, hot

    def close(self) -> Iterator[pa.RecordBatch]:
        yield from self.settle()
        hashes, place, counts = np.unique(self.rows["hash"], return_inverse=True, return_counts=True)
        yield self._candidates(GATHER, self.rows[counts[place] > 1])

    def _remove(self, rows: np.ndarray) -> pa.RecordBatch:
        start = rows["start"].astype(np.int64)
        return _found(REMOVE, *spans(rows["key"].astype(np.int64), start, start + rows["more"] + self.length))

    def _candidates(self, kind: int, rows: np.ndarray) -> pa.RecordBatch:
        return _found(kind, rows["key"], rows["start"], rows["start"] + rows["more"] + self.length, rows["hash"])


def candidates(blocks: DataFrame, length: int) -> DataFrame:
    """Byte ranges to remove (repeats of an anchor's bytes) and candidates, from anchor blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, bucket = None, None
        for batch in batches:
            for number, block in zip(batch.column(0).to_pylist(), batch.column(1)):
                if number != current:
                    if bucket is not None:
                        yield from bucket.close()
                    current, bucket = number, Bucket(length)
                yield from bucket.add(_unpacked(block.as_py()))
        if bucket is not None:
            yield from bucket.close()

    return blocks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, FOUND)


# -- suffix arrays ---------------------------------------------------------------

def sort_suffixes(text: np.ndarray, place: np.ndarray, depth: int) -> np.ndarray:
    """``place`` in the order of the suffixes' first ``depth`` bytes, eight at a time; only ties are sorted on."""
    view = np.ndarray((len(text) - 7,), ">u8", text, strides=(1,))
    key = view[place].astype(np.uint64)
    order = np.argsort(key)
    place, key = place[order], key[order]
    tied = np.flatnonzero(np.concatenate([[False], key[1:] == key[:-1]]))  # same as the one before
    group = np.arange(len(place))
    group[tied] = 0
    group = np.maximum.accumulate(group)
    for at in range(8, depth, 8):
        if not len(tied):
            break
        member = np.union1d(tied, tied - 1)
        key = view[place[member] + at].astype(np.uint64)
        order = np.lexsort((key, group[member]))
        place[member], key = place[member][order], key[order]
        same = (group[member][1:] == group[member][:-1]) & (key[1:] == key[:-1])
        tied = member[1:][same]
        group[member] = member
        group[tied] = 0
        # a member's group is the last member at or before it that starts one
        starts = np.where(np.concatenate([[True], ~same]), member, 0)
        group[member] = np.maximum.accumulate(starts)
    return place


def suffix_order(text: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes marked in ``wanted`` by their first ``depth`` bytes, by two-stage sorting.

    ``text`` ends with at least ``depth`` + 8 zero bytes. A suffix smaller than
    its successor is sorted directly; any other one follows its successor when
    the buckets (by first byte) are scanned in order."""
    n = len(text) - depth - 8
    change = np.flatnonzero(text[1:n + 1] != text[:n])
    up = text[change] < text[change + 1]
    nearest = np.searchsorted(change, np.arange(n))
    smaller = np.zeros(n, bool)
    inside = nearest < len(change)
    smaller[inside] = up[nearest[inside]]
    # also wanted: the successors of a wanted larger suffix up to the first smaller one
    place = np.arange(n)
    stop = np.minimum.accumulate(np.where(smaller, place, n)[::-1])[::-1]
    last = np.maximum.accumulate(np.where(wanted[:n], place, -1))  # nearest wanted place at or before
    needed = (last >= 0) & (stop[np.maximum(last, 0)] >= place)
    direct = sort_suffixes(text, np.flatnonzero(needed & smaller), depth)
    bounds = np.searchsorted(text[direct], np.arange(257))
    induced = np.zeros(n + 1, bool)
    induced[:n] = needed & ~smaller
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    order = []
    for byte in range(256):
        runs = []
        current = np.concatenate(waiting[byte]) if waiting[byte] else np.array([], np.int64)
        while len(current):  # larger suffixes of a run of one byte follow each other
            runs.append(current)
            before = current - 1  # -1 is the unused last place of ``induced``
            current = before[induced[before] & (text[before] == byte)]
        bucket = np.concatenate([*runs, direct[bounds[byte]:bounds[byte + 1]]])
        order.append(bucket)
        before = bucket - 1
        before = before[induced[before]]
        first = text[before]
        before, first = before[first > byte], first[first > byte]
        by = np.argsort(first, kind="stable")
        before, first = before[by], first[by]
        for part in np.split(before, np.flatnonzero(first[1:] != first[:-1]) + 1) if len(before) else ():
            waiting[text[part[0]]].append(part)
    order = np.concatenate(order)
    return order[wanted[order]]


def common_prefixes(text: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in ``order``, counted up to ``limit``."""
    view = np.ndarray((len(text) - 7,), ">u8", text, strides=(1,))
    common = np.zeros(len(order), np.int64)
    open_pairs = np.arange(1, len(order))
    for at in range(0, limit, 8):
        differ = view[order[open_pairs] + at] ^ view[order[open_pairs - 1] + at]
        differ = differ.astype(np.uint64)
        equal = differ == 0
        # equal leading bytes of the first eight that differ
        lead = np.zeros(len(differ), np.int64)
        for byte in range(7):
            lead += (differ >> np.uint64(56 - 8 * byte) == 0)
        common[open_pairs] = at + np.where(equal, 8, lead)
        open_pairs = open_pairs[equal]
        if not len(open_pairs):
            break
    return np.minimum(common, limit)


def equal_windows(strings: list[bytes], key: np.ndarray, start: np.ndarray, length: int):
    """(key, start, end) ranges covered by windows that also occur earlier in the strings of this shard.

    A string holds bytes of document ``key`` from ``start`` on; all its windows lie inside it."""
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    begin = np.cumsum(sizes + 1) - sizes - 1
    sep = bytes([SEPARATOR])
    text = np.frombuffer(sep.join(strings) + sep + bytes(length + 16), np.uint8)
    wanted = np.zeros(len(text), bool)
    windows = sizes - length + 1
    inside = np.repeat(begin, windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    wanted[inside] = True
    depth = -(-length // 8) * 8
    order = suffix_order(text, wanted, depth)
    equal = common_prefixes(text, order, length) == length
    member = equal.copy()
    member[:-1] |= equal[1:]
    order, head = order[member], ~equal[member]
    if not len(order):
        return key[:0], start[:0], start[:0]
    string = np.searchsorted(begin, order, "right") - 1
    doc, at = key[string], start[string] + order - begin[string]
    group = np.cumsum(head)
    by = np.lexsort((at, doc, group))
    doc, at, group = doc[by], at[by], group[by]
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))[group - 1]
    later = (doc != doc[first]) | (at != at[first])
    return spans(doc[later], at[later], at[later] + length)


def shard_spans(texts: DataFrame, shards: int, length: int) -> DataFrame:
    """Ranges to remove among the candidates of texts(_key, _text, picks): per shard of anchor hashes one suffix array."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text, picks in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                body = text.as_py() or b""
                picks = picks.as_py()
                at = np.array([p["start"] for p in picks], np.int32)
                hashes = np.array([p["hash"] for p in picks], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(((hashes.view(np.uint64) >> np.uint64(20)) % np.uint64(shards)).astype(np.int32)),
                     pa.array(np.full(len(picks), key, np.int64)), pa.array(at),
                     pa.array([body[p["start"]:p["stop"]] for p in picks], pa.binary())],
                    names=["shard", "key", "start", "bytes"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []

        def close() -> pa.RecordBatch:
            key, start = (np.concatenate([h.column(i).to_numpy(zero_copy_only=False) for h in held]).astype(np.int64)
                          for i in (1, 2))
            strings = [s for h in held for s in h.column(3).to_pylist()]
            return _found(REMOVE, *equal_windows(strings, key, start, length))

        for batch in batches:
            shard = batch.column(0).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]])) if len(shard) else []
            for a, b in zip(edges[:-1], edges[1:]):
                if shard[a] != current and held:
                    yield close()
                    held = []
                current = shard[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield close()

    strings = texts.mapInArrow(cut, "shard int, key long, start int, bytes binary")
    return strings.repartition("shard").sortWithinPartitions("shard").mapInArrow(sort, FOUND)


def single_spans(texts: DataFrame, length: int) -> DataFrame:
    """Ranges to remove among the windows of candidates whose anchor hash has very many byte strings."""
    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text, picks in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                body = text.as_py() or b""
                at = [i for p in picks.as_py() for i in range(p["start"], p["stop"] - length + 1)]
                both = b"".join(xxhash.xxh3_128_digest(body[i:i + length]) for i in at)
                pair = np.frombuffer(both, "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ascontiguousarray(pair[:, 0])), pa.array(np.ascontiguousarray(pair[:, 1])),
                     pa.array(np.full(len(at), key, np.int64)), pa.array(np.array(at, np.int32))], names=["d1", "d2", "key", "start"])

    windows = written(texts.mapInArrow(digests, "d1 long, d2 long, key long, start int"), "substring-windows")
    # written, so that AQE can split a window that very many documents share
    first = written(windows.groupBy("d1", "d2").agg(F.min(F.struct("key", "start")).alias("first"),
                                                    F.count(F.lit(1)).alias("n")).where("n > 1"), "substring-first")
    later = windows.join(first, ["d1", "d2"]).where(F.struct("key", "start") > F.col("first"))
    return later.select(F.lit(REMOVE).alias("kind"), "key", "start", (F.col("start") + length).cast("int").alias("stop"),
                        F.lit(0).cast("long").alias("hash"))


# -- operator --------------------------------------------------------------------

def keyed_texts(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with _key, a long in the order of (doc_id, text hash), and the text's bytes as _text.

    The key is the doc_id itself if doc_ids are there and unique. Otherwise the
    distinct (doc_id, text hash) are numbered in order; a row that is repeated
    in the table gets the same key and counts as the same document."""
    body = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body.cast("binary").alias("_text"))
    odd = rows.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count()
    if not odd:
        return rows.select(F.col("doc_id").alias("_key"), "doc_id", "_text")
    hashed = rows.withColumn("_hash", F.xxhash64("_text"))
    numbers = written(hashed.select(F.col("doc_id").alias("_doc"), F.col("_hash").alias("_h")).distinct()
                      .orderBy("_doc", "_h").withColumn("_key", F.monotonically_increasing_id()), "substring-keys")
    return (hashed.join(numbers, hashed["doc_id"].eqNullSafe(numbers["_doc"]) & (hashed["_hash"] == numbers["_h"]))
            .select("_key", "doc_id", "_text"))


def repeated_spans(keyed: DataFrame, length: int = LENGTH) -> DataFrame:
    """(_k, spans): per key with removed bytes the disjoint ranges [start, stop), in order."""
    total = keyed.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    found = written(candidates(anchor_blocks(keyed, max(16, -(-total // BUCKET_BYTES)), length), length), "substring-anchors")
    ranges = [found.where(f"kind = {REMOVE}")]
    sizes = {r["kind"]: r["size"] for r in found.groupBy("kind").agg(F.sum(F.col("stop") - F.col("start")).alias("size")).collect()}
    for kind in (GATHER, SINGLE):
        if not sizes.get(kind):
            continue
        # one list per document: no longer than the document's own anchors
        picks = found.where(f"kind = {kind}").groupBy(F.col("key").alias("_k")).agg(
            F.collect_list(F.struct("start", "stop", "hash")).alias("picks"))
        texts = keyed.join(picks, F.col("_key") == F.col("_k")).select("_key", "_text", "picks")
        ranges.append(written(shard_spans(texts, max(16, -(-sizes[kind] // SHARD_BYTES)), length) if kind == GATHER
                              else single_spans(texts, length), "substring-spans"))
    every = ranges[0]
    for r in ranges[1:]:
        every = every.unionByName(r)
    return every.groupBy(F.col("key").alias("_k")).agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, spans array<struct<start,stop>>, kept binary) of every row of ``docs``.

    Every byte is removed that a string of ``length`` bytes covers which also
    starts earlier (smaller doc_id, or earlier in the same text); strings are
    judged on the input. spans are the maximal removed runs. A null text is
    empty; null doc_ids come first; rows equal in doc_id and text count as one
    document and get equal results; of rows with one doc_id and different texts
    the one with the smaller text hash is earlier."""
    keyed = keyed_texts(docs)
    out = pa.struct([("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), ("kept", pa.binary())])

    @F.arrow_udf("struct<spans:array<struct<start:int,stop:int>>,kept:binary>")
    def cut(texts: pa.Array, ranges: pa.Array) -> pa.Array:
        rows = []
        for text, given in zip(texts, ranges):
            body, given = text.as_py() or b"", given.as_py() or []
            _, start, stop = spans(np.zeros(len(given), np.int64), np.array([g["start"] for g in given], np.int64),
                                   np.array([g["stop"] for g in given], np.int64))
            start, stop = start.tolist(), stop.tolist()
            kept = b"".join(body[a:b] for a, b in zip([0, *stop], [*start, len(body)]))
            rows.append({"spans": [{"start": a, "stop": b} for a, b in zip(start, stop)], "kept": kept})
        return pa.array(rows, out)

    joined = keyed.join(repeated_spans(keyed, length), F.col("_key") == F.col("_k"), "left")
    return joined.select("doc_id", F.coalesce(F.octet_length("_text"), F.lit(0)).cast("long").alias("n_bytes"),
                         cut("_text", "spans").alias("c")).select("doc_id", "n_bytes", "c.spans", "c.kept")


def op1_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    """Bytes, removed bytes, removed runs and the digest of the remaining bytes of every document."""
    out = remove_repeats(read_table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


# The same by all windows of every text, as hexadecimal text (two digits a byte).
OP1_SQL = f"""
WITH texts AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
windows AS (
  SELECT doc_id, s, md5(substr(h, 2 * s + 1, {2 * LENGTH})) AS w FROM texts, unnest(range(n - {LENGTH - 1})) AS t(s)),
repeats AS (
  SELECT doc_id, s FROM (
    SELECT doc_id, s, row_number() OVER (PARTITION BY w ORDER BY doc_id, s) AS nth FROM windows) WHERE nth > 1),
marked AS (
  SELECT doc_id, s, coalesce(s > lag(s) OVER d + {LENGTH}, true) AS head
  FROM repeats WINDOW d AS (PARTITION BY doc_id ORDER BY s)),
numbered AS (
  SELECT doc_id, s, count(*) FILTER (WHERE head) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM marked),
runs AS (
  SELECT doc_id, run, min(s) AS a, max(s) + {LENGTH} AS b FROM numbered GROUP BY doc_id, run),
gaps AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM runs),
cut AS (
  SELECT g.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last,
         string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept
  FROM gaps g JOIN texts USING (doc_id) GROUP BY g.doc_id)
SELECT t.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept || substr(h, 2 * last + 1), h))) AS kept_sha256
FROM texts t LEFT JOIN cut c ON t.doc_id = c.doc_id
"""
