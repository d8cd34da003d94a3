"""Language-model scores by a hierarchical Pitman-Yor model over word pairs.

The probability of a word depends on the whole word before it (at a text's start:
its end mark). Every preceding word has a restaurant of its own, all of them share
one parent, the restaurant of single words, whose base is uniform over the known
words and one unknown word. Seating is sampled by Gibbs: the number of tables of a
(context, word) cell is drawn from its exact conditional distribution (generalised
Stirling numbers) given the other tables of its restaurant and the parent. A
restaurant's first cells are reseated one after the other, later ones in blocks of
a sixteenth; cells of more than 64 customers sit down one by one. Probabilities are
averaged over the rounds after the burn-in.

Cells live in buckets by their context, so a restaurant's totals are at hand; single
words live in homes by ranges of their hashes. A cell with one customer always has
one table, so only cells of two or more customers, and only the words in them, are
sent between buckets and homes: in a round every bucket makes LOCAL_SWEEPS sweeps
against the parent as it last heard of it and its own changes, sends its tables per
word to the homes, and hears the words' new totals. Contexts with more tokens than a
bucket is made for (found in a sample of the rows, which steers nothing but this) are
cut by the following word; their totals go through the driver, at most one figure a
bucket's worth of text.

Buckets and homes are tables bucketed by their number, so rounds read them without
shuffling them. Texts are counted in batches: a batch sends, per bucket, its distinct
cells, and hears their probabilities at the end, when its texts are read once more (a
check sum tells whether the rows came in the same batches). No word list reaches the
driver. Words are known by 52 bits of their XXH3 hash.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import co_located, discard, read_table, text_bytes, with_mail, written

HASH_BITS = 52
BATCH_BYTES = 16 << 20
SLICE_BYTES = 1 << 20
BUCKET_BYTES = 16 << 20  # text per bucket of contexts
HOME_BYTES = 128 << 20   # text per home of words
SAMPLED = 1 / 256        # of the rows, to find contexts that are cut
ROW_GROUP_BYTES = 16 << 20
BURN_IN, SAMPLES, LOCAL_SWEEPS = 2, 3, 3
STRENGTH = 1.0
EXACT = 64               # customers of a cell whose tables are drawn from the exact conditional
CLASSES = (1, 2, 4, 8, 16, EXACT)
END = b""                # the end of a text; no word is empty
SPACE = re.compile(rb"[ \t-\r]")
SEATS, PART, HOT, ROOT, REPLY, FIGURES, ANSWER, TEXTS = range(8)
MAIL = "kind int, source int, target int, payload binary"
BATCHES = "kind int, bucket int, batch long, payload binary"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes, byte plane by byte plane; whole numbers in as few planes as they need."""
    out = [np.array([len(arrays)], "<i8").tobytes()]
    narrow = []
    for a in arrays:
        if a.dtype.kind in "iu" and len(a) and a.min() >= 0:
            a = a.astype(f"<u{next((w for w in (1, 2, 4) if a.max() < 1 << 8 * w), 8)}")
        narrow.append(a)
        out.append(np.array([len(a), a.dtype.itemsize, "iuf".index(a.dtype.kind)], "<i8").tobytes())
    for a in narrow:
        out.append(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes())
    plain = b"".join(out)
    return len(plain).to_bytes(8, "little") + pa.compress(plain, codec="zstd", asbytes=True)


def unpack(data: bytes) -> list[np.ndarray]:
    """The arrays of ``pack``; whole numbers as int64."""
    data = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    n = int(np.frombuffer(data, "<i8", 1)[0])
    heads = np.frombuffer(data, "<i8", 3 * n, 8).reshape(n, 3).tolist()
    at, out = 8 + 24 * n, []
    for size, width, kind in heads:
        planes = np.frombuffer(data, np.uint8, size * width, at).reshape(width, size)
        one = np.ascontiguousarray(planes.T).view(f"<{'iuf'[kind]}{width}").reshape(size)
        out.append(one if kind == 2 else one.astype(np.int64))
        at += size * width
    return out


def steps(ascending: np.ndarray) -> np.ndarray:
    """Differences of numbers in ascending order; ``np.cumsum`` gives them back."""
    return np.diff(ascending, prepend=0)


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[t]) for i, (_, t) in enumerate(fields)],
                                      names=[name for name, _ in fields])


def hash_of(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) >> (64 - HASH_BITS)


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 10 == 0


def home_of(hashes: np.ndarray, homes: int) -> np.ndarray:
    """Homes are ranges of hashes, so that words in order are in the order of their homes."""
    return (hashes >> (HASH_BITS - 32)) * homes >> 32


class Deal:
    """The bucket of a cell: that of its context, and for contexts that are cut one of several by the word."""

    def __init__(self, buckets: int, hot: dict[int, int]):
        self.buckets = buckets
        self.hot = np.array(sorted(hot), np.int64)
        self.parts = np.array([hot[h] for h in self.hot.tolist()], np.int64)

    def is_hot(self, contexts: np.ndarray) -> np.ndarray:
        return np.isin(contexts, self.hot)

    def __call__(self, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        shift = 0
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, contexts), len(self.hot) - 1)
            shift = words % np.where(self.hot[at] == contexts, self.parts[at], 1)
        return (contexts + shift) % self.buckets


def _words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a slice of it at a time."""
    at = 0
    while at < len(text):
        found = SPACE.search(text, at + SLICE_BYTES)
        stop = found.start() if found else len(text)
        yield text[at:stop].lower().split()
        at = stop


def tokens_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes in order, every token and the one before it as places among them, tokens per text."""
    vocabulary: dict[bytes, int] = defaultdict(count().__next__)
    end = vocabulary[END]
    parts, sizes = [], []
    for i, text in enumerate(texts):
        texts[i], size = b"", 1
        for words in _words(text):
            parts.append(np.fromiter(map(vocabulary.__getitem__, words), np.int32, len(words)))
            size += len(words)
        parts.append(np.array([end], np.int32))
        sizes.append(size)
    hashes, place = np.unique(np.fromiter(map(hash_of, vocabulary), np.int64, len(vocabulary)), return_inverse=True)
    token = place[np.concatenate(parts)]
    return hashes, token, np.concatenate([place[[end]], token[:-1]]), np.array(sizes, np.int64)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list[bytes]]]:
    """(number, doc_ids, texts) of whole documents, about BATCH_BYTES of text each."""
    number = None
    for batch in batches:
        if number is None and batch.num_rows:
            number = count(batch.column(2)[0].as_py() << 32)
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        sizes = pc.binary_length(texts).fill_null(0).to_pylist()
        at = 0
        while at < len(sizes):
            stop, size = at, 0
            while stop < len(sizes) and size < BATCH_BYTES:
                size += sizes[stop]
                stop += 1
            yield next(number), ids[at:stop], text_bytes(texts.slice(at, stop - at))
            at = stop


def _read(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.spark_partition_id().alias("part"))


def _mark(hashes: np.ndarray, token: np.ndarray) -> int:
    return zlib.crc32(token.astype(np.int32).tobytes(), zlib.crc32(hashes.tobytes()))


def hot_contexts(docs: DataFrame, total: int, buckets: int) -> dict[int, int]:
    """Contexts that hold more tokens than a bucket is made for, with the number of buckets they are cut into."""
    share = min(1.0, max(SAMPLED, (64 << 20) * SAMPLED * 16 / max(1, total)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, texts in _batches(batches):
            hashes, token, _, _ = tokens_of(texts)
            yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(np.bincount(token, minlength=len(hashes)))],
                                             names=["hash", "n"])

    seen = written(_read(docs).sample(share, 7).mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")),
                   "lm-sample")
    tokens = seen.agg(F.sum("n")).first()[0] or 0
    most = max(1, tokens / buckets / 2)
    hot = {r["hash"]: min(buckets, int(r["n"] / most) + 1) for r in seen.where(F.col("n") > most).collect()}
    discard(seen)
    return hot


def count_batches(docs: DataFrame, deal: Deal) -> DataFrame:
    """Rows of BATCHES: a batch's distinct cells of one bucket (check sum, contexts, cells per context, words, word of
    every cell, training counts)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, ids, texts in _batches(batches):
            hashes, token, before, sizes = tokens_of(texts)
            mark, n = _mark(hashes, token), len(hashes)
            key = before * n + token
            trained = np.repeat([not is_held_out(i) for i in ids], sizes)
            del token, before
            cells, (learned, seen) = np.unique(key), np.unique(key[trained], return_counts=True)
            del key, trained
            counts = np.zeros(len(cells), np.int64)
            counts[np.searchsorted(cells, learned)] = seen
            bucket = deal(hashes[cells // n], hashes[cells % n])
            order = np.argsort(bucket, kind="stable")
            cells, counts, bucket = cells[order], counts[order], bucket[order]
            found, first = np.unique(bucket, return_index=True)
            for b, at, stop in zip(found.tolist(), first, [*first[1:], len(cells)]):
                context, word = np.divmod(cells[at:stop], n)
                contexts, per_context = np.unique(context, return_counts=True)
                words, place = np.unique(word, return_inverse=True)
                yield _rows([(ANSWER, b, number, pack(np.array([mark]), steps(hashes[contexts]), per_context,
                                                      steps(hashes[words]), place, counts[at:stop]))], BATCHES)

    return _read(docs).mapInArrow(run, BATCHES)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, list[np.ndarray]]]]]:
    """(group, [(source, arrays)]) of rows (group, source, payload) that come group by group."""
    current, rows = None, []
    for batch in batches:
        for group, source, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if group != current and rows:
                yield current, rows
                rows = []
            current = group
            rows.append((source, unpack(payload.as_py())))
    if rows:
        yield current, rows


BUCKET = "bucket int, words binary, cells binary, open binary, maps binary"


def context_buckets(requests: DataFrame, deal: Deal, parts: int) -> DataFrame:
    """One row per bucket: its words, its cells with their counts, those of two or more customers, and the places of
    every batch's cells. Bucketed by ``bucket``."""
    def merged(bucket: int, rows: list[tuple[int, list[np.ndarray]]]) -> pa.RecordBatch:
        arrays = [a for _, a in rows]
        contexts, context = np.unique(np.concatenate([np.cumsum(a[1]) for a in arrays]), return_inverse=True)
        context = np.repeat(context, np.concatenate([a[2] for a in arrays]))
        words, place = np.unique(np.concatenate([np.cumsum(a[3]) for a in arrays]), return_inverse=True)
        at = np.cumsum([0] + [len(a[3]) for a in arrays])
        word = place[np.concatenate([a[4] + start for a, start in zip(arrays, at)])]
        cells, place = np.unique(context * len(words) + word, return_inverse=True)
        counts = np.bincount(place, np.concatenate([a[5] for a in arrays]), len(cells)).astype(np.int64)
        sizes = np.array([len(a[4]) for a in arrays])
        maps = pack(np.array([batch for batch, _ in rows]), np.array([a[0][0] for a in arrays]), sizes,
                    np.concatenate([steps(p) for p in np.split(place, np.cumsum(sizes)[:-1])]))
        context, word = np.divmod(cells, len(words))
        n, open_cell = len(contexts), counts > 1
        singles = np.bincount(context, counts == 1, n).astype(np.int64)
        opened = np.bincount(word, open_cell, len(words)).astype(np.int64)
        per_open = np.bincount(context, open_cell, n).astype(np.int64)
        hot = deal.is_hot(contexts)
        kept = np.flatnonzero((per_open > 0) | hot)
        number = np.cumsum(opened > 0) - 1
        customers = np.bincount(context, counts, n).astype(np.int64)
        return _rows([(bucket,
                       pack(steps(words), np.bincount(word, counts, len(words)).astype(np.int64),
                            np.bincount(word, counts == 1, len(words)).astype(np.int64), opened),
                       pack(np.bincount(context, minlength=n), word, counts),
                       pack(steps(kept), per_open[kept], number[word[open_cell]], counts[open_cell], singles[kept],
                            np.flatnonzero(hot[kept]), contexts[hot], customers[hot]),
                       maps)], BUCKET)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _grouped(batches):
            yield merged(bucket, rows)

    dealt = requests.select("bucket", "batch", "payload").repartition(parts, "bucket").sortWithinPartitions("bucket", "batch")
    return co_located(dealt.mapInArrow(run, BUCKET), "bucket", parts, "lm-buckets", ROW_GROUP_BYTES)


def _split(homes: np.ndarray) -> list[tuple[int, int, int]]:
    """(home, start, stop) of words in order."""
    found, first = np.unique(homes, return_index=True)
    return list(zip(found.tolist(), first.tolist(), [*first[1:].tolist(), len(homes)]))


def introductions(buckets: DataFrame, homes: int) -> DataFrame:
    """Rows PART (words, training counts, single cells, open cells) for every home, HOT and FIGURES of a bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, words, opened in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                arrays = unpack(words.as_py())
                hashes = np.cumsum(arrays[0])
                for home, at, stop in _split(home_of(hashes, homes)):
                    yield _rows([(PART, bucket, home, pack(steps(hashes[at:stop]), *(a[at:stop] for a in arrays[1:])))], MAIL)
                _, per_open, _, counts, singles, hot_at, hot, customers = unpack(opened.as_py())
                figures = np.array([arrays[2].sum(), (counts == 2).sum()], float)
                yield _rows([(HOT, bucket, -1, pack(hot, customers, (singles + per_open)[hot_at])),
                             (FIGURES, bucket, -1, pack(figures))], MAIL)

    return buckets.select("bucket", "words", "open").mapInArrow(run, MAIL)


HOME = "home int, words binary, links binary, open_links binary, figures binary"


def word_homes(introduced: DataFrame, parts: int) -> DataFrame:
    """One row per home: training counts, single cells and first customers of its words, the places of every bucket's
    words and of those in open cells. Bucketed by ``home``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for home, rows in _grouped(batches):
            words, place = np.unique(np.concatenate([np.cumsum(a[0]) for _, a in rows]), return_inverse=True)
            counts, singles, opened = (np.bincount(place, np.concatenate([a[i] for _, a in rows]), len(words)).astype(np.int64)
                                       for i in (1, 2, 3))
            source, sizes = np.array([s for s, _ in rows]), np.array([len(a[0]) for _, a in rows])
            each = np.split(place, np.cumsum(sizes)[:-1])
            in_open = [p[a[3] > 0] for p, (_, a) in zip(each, rows)]
            customers = singles + opened
            figures = np.array([(counts > 0).sum(), counts.sum(), (customers > 0).sum(), (customers == 1).sum(),
                                (customers == 2).sum()], float)
            yield _rows([(home, pack(counts, singles, customers),
                          pack(source, sizes, np.concatenate([steps(p) for p in each])),
                          pack(source, np.array([len(p) for p in in_open]), np.concatenate([steps(p) for p in in_open])),
                          pack(figures))], HOME)

    dealt = (introduced.where(f"kind = {PART}").select(F.col("target").alias("home"), "source", "payload")
             .repartition(parts, "home").sortWithinPartitions("home", "source"))
    return co_located(dealt.mapInArrow(run, HOME), "home", parts, "lm-homes", ROW_GROUP_BYTES)


def _places(links: bytes) -> list[tuple[int, np.ndarray]]:
    """(bucket, places of its words) of a home."""
    source, sizes, moves = unpack(links)
    return [(s, np.cumsum(m)) for s, m in zip(source.tolist(), np.split(moves, np.cumsum(sizes)[:-1]))]


def sums(payloads: DataFrame, width: int) -> np.ndarray:
    """The sum of packed figures, ``width`` of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            for payload in batch.column(0):
                total += unpack(payload.as_py())[0]
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int64()), pa.array(total)], names=["at", "value"])

    out = np.zeros(width)
    for r in payloads.mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
        out[r["at"]] = r["value"]
    return out


def hot_totals(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts that are cut, their customers and tables over all buckets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in unpack(payload.as_py())], names=["hash", "c", "t"])

    found = (rows.where(f"kind = {HOT}").select("payload").mapInArrow(run, "hash long, c long, t long")
             .groupBy("hash").agg(F.sum("c").alias("c"), F.sum("t").alias("t")).orderBy("hash").collect())
    return tuple(np.array([r[i] for r in found], np.int64) for i in range(3))


def stirling(discount: float) -> np.ndarray:
    """Logs of the generalised Stirling numbers of up to EXACT customers: ways to sit at so many tables."""
    out = np.full((EXACT + 1, EXACT), -np.inf)
    out[1, 0] = 0
    tables = np.arange(1, EXACT + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(1, EXACT):
            stay = out[c] + np.log(np.where(tables <= c, c - discount * tables, 1))
            out[c + 1] = np.logaddexp(stay, np.concatenate([[-np.inf], out[c, :-1]]))
    return out


def draw_tables(customers: np.ndarray, opening: np.ndarray, growth: np.ndarray, numbers: np.ndarray, rng) -> np.ndarray:
    """Tables of cells of 2 to EXACT customers from their conditional distribution: a cell's first table has the weight
    ``opening``, each further one ``growth`` more."""
    tables = np.ones(len(customers), np.int64)
    for low, high in zip(CLASSES, CLASSES[1:]):
        at = np.flatnonzero((customers > low) & (customers <= high))
        if len(at):
            weight = np.cumsum(np.log(opening[at, None] + growth[at, None] * np.arange(high)), axis=1)
            weight += numbers[customers[at], :high]
            weight = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
            tables[at] += (weight < rng.random((len(at), 1)) * weight[:, -1:]).sum(axis=1)
    return np.minimum(tables, customers)


def seat(customers: np.ndarray, opening: np.ndarray, growth: np.ndarray, discount: float, rng) -> np.ndarray:
    """Tables of cells after their customers sat down one by one, later ones in blocks of a sixteenth."""
    tables = np.ones(len(customers), np.int64)
    seated, active = 1, np.flatnonzero(customers > 1)
    while len(active):
        block = max(1, seated // 16)
        new = opening[active] + growth[active] * tables[active]
        tables[active] += rng.binomial(np.minimum(block, customers[active] - seated), new / (new + seated - discount * tables[active]))
        seated += block
        active = active[customers[active] > seated]
    return tables


class Root:
    """Discounts and totals of the parent restaurant."""

    def __init__(self, words: float, discounts: tuple[float, float], customers: float, tables: float):
        self.words, self.discounts, self.customers, self.tables = words, discounts, customers, tables
        self.base = 1 / (words + 1)

    def probability(self, customers, tables):
        open_ = (STRENGTH + self.discounts[1] * self.tables) * self.base
        return (customers - self.discounts[1] * tables + open_) / (STRENGTH + self.customers)


def seat_words(customers: np.ndarray, tables: np.ndarray, root: Root, rng) -> np.ndarray:
    """Tables of the words in the parent restaurant, given the totals of the others."""
    discount = root.discounts[1]
    opening, growth = (STRENGTH + discount * (root.tables - tables)) * root.base, np.full(len(customers), discount * root.base)
    out = (customers > 0).astype(np.int64)
    few, many = (customers > 1) & (customers <= EXACT), customers > EXACT
    out[few] = draw_tables(customers[few], opening[few], growth[few], stirling(discount), rng)
    out[many] = seat(customers[many], opening[many], growth[many], discount, rng)
    return out


class OpenCells:
    """The cells of a bucket with two or more customers, and their seating."""

    def __init__(self, payload: bytes):
        _, per_context, self.word, self.count, self.singles, self.hot_at, self.hot, self.customers = unpack(payload)
        self.context = np.repeat(np.arange(len(per_context)), per_context)
        self.tables = np.ones(len(self.count), np.int64)
        rank = np.arange(len(self.count)) - np.repeat(np.cumsum(per_context) - per_context, per_context)
        step = np.where(rank < 32, rank, 32 + (16 * np.log2(np.maximum(rank, 32) / 32)).astype(np.int64))
        step[self.count > EXACT] = -1
        order = np.argsort(step, kind="stable")
        self.turns = np.split(order, np.flatnonzero(np.diff(step[order])) + 1) if len(order) else []

    def per_context(self, tables: np.ndarray) -> np.ndarray:
        return self.singles + np.bincount(self.context, tables, len(self.singles)).astype(np.int64)

    def per_word(self, words: int) -> np.ndarray:
        return np.bincount(self.word, self.tables, words).astype(np.int64)

    def elsewhere(self, hot: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """Tables that contexts which are cut have in other buckets."""
        out = np.zeros(len(self.singles), np.int64)
        if len(self.hot):
            out[self.hot_at] = hot[2][np.searchsorted(hot[0], self.hot)] - self.per_context(self.tables)[self.hot_at]
        return out

    def sweep(self, root: Root, customers: np.ndarray, tables: np.ndarray, elsewhere: np.ndarray, numbers: np.ndarray, rng) -> None:
        """Every cell once, given the words' customers and tables in the parent restaurant."""
        discount = root.discounts[0]
        total = self.per_context(self.tables) + elsewhere
        for cells in self.turns:
            c, k, own = self.count[cells], self.context[cells], self.tables[cells]
            rest = customers[self.word[cells]] - own
            p0 = root.probability(rest, np.minimum(tables[self.word[cells]], rest))
            opening, growth = (STRENGTH + discount * (total[k] - own)) * p0, discount * p0
            new = (seat(c, opening, growth, discount, rng) if c[0] > EXACT else draw_tables(c, opening, growth, numbers, rng))
            self.tables[cells] = new
            np.add.at(total, k, new - own)


def _mail(column: pa.Array) -> list[list[tuple[int, int, bytes]]]:
    """(kind, source, payload) of every row's mail, by kind and source."""
    return [sorted(((m["kind"], m["source"], m["payload"]) for m in mail or ()), key=lambda m: m[:2]) for mail in column.to_pylist()]


def root_pass(homes: DataFrame, mail: DataFrame | None, root: Root, number: int, parts: int) -> DataFrame:
    """Rows ROOT (customers and tables of a home's words), REPLY (those of a bucket's words in open cells), FIGURES."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters = _mail(batch.column(3)) if batch.num_columns > 3 else [[]] * batch.num_rows
            for home, words, links, post in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), letters):
                _, singles, customers = unpack(words.as_py())
                places = _places(links.as_py())
                tables = (customers > 0).astype(np.int64)
                if post:
                    customers, place_of = singles.copy(), dict(places)
                    for kind, source, payload in post:
                        if kind == PART:
                            customers[place_of[source]] += unpack(payload)[0]
                        else:
                            tables = np.minimum(unpack(payload)[1], customers)
                tables = seat_words(customers, tables, root, np.random.default_rng((1, home, number)))
                yield _rows([(ROOT, home, home, pack(customers, tables)),
                             (FIGURES, home, -1, pack(np.array([customers.sum(), tables.sum()], float)))], MAIL)
                for bucket, at in places:
                    if len(at):
                        yield _rows([(REPLY, home, bucket, pack(customers[at], tables[at]))], MAIL)

    found = homes.select("home", "words", F.col("open_links").alias("links"))
    return (with_mail(found, "home", mail, parts) if mail is not None else found).mapInArrow(run, MAIL)


def bucket_pass(buckets: DataFrame, mail: DataFrame, root: Root, hot: tuple[np.ndarray, ...], number: int,
                parts: int) -> DataFrame:
    """Rows SEATS, PART (tables per word for a home) and HOT after LOCAL_SWEEPS sweeps."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = stirling(root.discounts[0])
        for batch in batches:
            for bucket, opened, post in zip(batch.column(0).to_pylist(), batch.column(1), _mail(batch.column(2))):
                cells, rng = OpenCells(opened.as_py()), np.random.default_rng((2, bucket, number))
                replies = [(home, unpack(payload)) for kind, home, payload in post if kind == REPLY]
                for kind, _, payload in post:
                    if kind == SEATS:
                        cells.tables = unpack(payload)[0]
                if replies:
                    customers, tables = (np.concatenate([a[i] for _, a in replies]) for i in (0, 1))
                    before, elsewhere = cells.per_word(len(customers)), cells.elsewhere(hot)
                    for _ in range(LOCAL_SWEEPS):
                        now = customers - before + cells.per_word(len(customers))
                        cells.sweep(root, now, np.minimum(tables, now), elsewhere, numbers, rng)
                    after = cells.per_word(len(customers))
                    edges = np.cumsum([0] + [len(a[0]) for _, a in replies])
                    for (home, _), at, stop in zip(replies, edges, edges[1:]):
                        yield _rows([(PART, bucket, home, pack(after[at:stop]))], MAIL)
                yield _rows([(SEATS, bucket, bucket, pack(cells.tables)),
                             (HOT, bucket, -1, pack(cells.hot, cells.customers, cells.per_context(cells.tables)[cells.hot_at]))],
                            MAIL)

    return with_mail(buckets.select("bucket", "open"), "bucket", mail, parts).mapInArrow(run, MAIL)


def _numbered(tables: list[DataFrame], kind: int) -> DataFrame:
    """Rows of one kind of several samples, the kind replaced by the sample's number."""
    found = [t.where(f"kind = {kind}").withColumn("kind", F.lit(i)) for i, t in enumerate(tables)]
    out = found[0]
    for one in found[1:]:
        out = out.unionByName(one)
    return out


def last_replies(homes: DataFrame, roots: list[DataFrame], parts: int) -> DataFrame:
    """Rows REPLY: training counts of all words of a bucket, their customers and tables in every sample."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for home, words, links, post in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), _mail(batch.column(3))):
                columns = [unpack(words.as_py())[0], *chain.from_iterable(unpack(payload) for _, _, payload in post)]
                for bucket, at in _places(links.as_py()):
                    yield _rows([(REPLY + 1000, home, bucket, pack(*(c[at] for c in columns)))], MAIL)

    return with_mail(homes.select("home", "words", "links"), "home", _numbered(roots, ROOT), parts).mapInArrow(run, MAIL)


def answers(buckets: DataFrame, mail: DataFrame, roots: list[Root], hots: list[tuple[np.ndarray, ...]],
            parts: int) -> DataFrame:
    """Rows of BATCHES: check sum, training counts of the batch's words and log10 probabilities of its cells."""
    def probabilities(cells: bytes, opened: bytes, post: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        per_context, word, count_ = unpack(cells)
        n = len(per_context)
        context = np.repeat(np.arange(n), per_context)
        columns = [np.concatenate(c) for c in zip(*(unpack(p) for kind, _, p in post if kind >= 1000))]
        seats = [unpack(p)[0] for kind, _, p in post if kind < 1000]
        places = np.cumsum(unpack(opened)[0])
        cut = OpenCells(opened)
        customers = np.bincount(context, count_, n)
        singles, open_cell, mean = np.bincount(context, count_ == 1, n), count_ > 1, 0
        for i, (root, hot) in enumerate(zip(roots, hots)):
            tables = np.minimum(count_, 1)
            tables[open_cell] = seats[i]
            total = singles + np.bincount(context, np.where(open_cell, tables, 0), n)
            if len(cut.hot):
                at = np.searchsorted(hot[0], cut.hot)
                customers[places[cut.hot_at]], total[places[cut.hot_at]] = hot[1][at], hot[2][at]
            p0 = root.probability(columns[1 + 2 * i], columns[2 + 2 * i])[word]
            discount = root.discounts[0]
            mean = mean + ((count_ - discount * tables + (STRENGTH + discount * total[context]) * p0)
                           / (STRENGTH + customers[context]))
        return np.log10(mean / len(roots)).astype(np.float32), columns[0], word

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, cells, opened, maps, post in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2),
                                                         batch.column(3), _mail(batch.column(4))):
                log_p, counts, word = probabilities(cells.as_py(), opened.as_py(), post)
                numbers, marks, sizes, moves = unpack(maps.as_py())
                for number, mark, move in zip(numbers.tolist(), marks, np.split(moves, np.cumsum(sizes)[:-1])):
                    at = np.cumsum(move)
                    yield _rows([(ANSWER, bucket, number, pack(np.array([mark]), counts[np.unique(word[at])], log_p[at]))], BATCHES)

    found = with_mail(buckets.select("bucket", "cells", "open", "maps"), "bucket", mail, parts)
    return found.mapInArrow(run, BATCHES)


def read_again(docs: DataFrame, deal: Deal) -> DataFrame:
    """Rows TEXTS of every batch: check sum, doc_ids, their nulls, held out, tokens per text, the cell of every token,
    the word of every cell among its bucket's in the batch, counted on from bucket to bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, ids, texts in _batches(batches):
            hashes, token, before, sizes = tokens_of(texts)
            n, mark = len(hashes), _mark(hashes, token)
            cells, cell = np.unique(before * n + token, return_inverse=True)
            del before
            word = cells % n
            bucket = deal(hashes[cells // n], hashes[word])
            order = np.argsort(bucket, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            # a word of a token, in each bucket once: any of the bucket's answers tells its training count
            asked, first = np.unique(bucket * n + word, return_index=True)
            known = np.full(n, -1)
            known[asked % n] = np.arange(len(asked))
            yield _rows([(TEXTS, -1, number, pack(
                np.array([mark]), np.array([i or 0 for i in ids], np.int64), np.array([i is None for i in ids]).astype(np.uint8),
                np.array([is_held_out(i) for i in ids]).astype(np.uint8), sizes, place[cell], known[token]))], BATCHES)

    return _read(docs).mapInArrow(run, BATCHES)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def add_up(answered: DataFrame, texts: DataFrame, tokens: int, words: int) -> DataFrame:
    """The documents' scores from their batch's answers; a group is one batch, of bounded size."""
    names = [part.split()[0] for part in SCORES.split(", ")]

    def run(group: pa.Table) -> pa.Table:
        found, body = [], None
        for kind, bucket, payload in zip(*(group.column(c).to_pylist() for c in ("kind", "bucket", "payload"))):
            if kind == ANSWER:
                found.append((bucket, unpack(payload)))
            else:
                body = unpack(payload)
        found.sort(key=lambda a: a[0])
        if body is None or any(a[0][0] != body[0][0] for _, a in found):
            raise RuntimeError("the documents came in other batches when they were read again: write them to a table first")
        mark, ids, null, held, sizes, cell, word = body
        count_ = np.concatenate([a[1] for _, a in found])[word]
        log_p = np.concatenate([a[2] for _, a in found])[cell].astype(np.float64)
        first = np.cumsum(sizes) - sizes
        base = np.log10((count_ + 0.1) / (tokens + 0.1 * (words + 1)))
        return pa.table([
            pa.array(ids, mask=null.astype(bool)), pa.array(held.astype(bool)), pa.array(sizes),
            pa.array(np.add.reduceat((count_ > 0), first, dtype=np.int64)), pa.array(np.full(len(ids), tokens)),
            pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(log_p, first))],
            names=names)

    return answered.unionByName(texts).groupBy("batch").applyInArrow(run, SCORES)


def _discount(one: float, two: float) -> float:
    return min(0.95, max(0.05, one / (one + 2 * two))) if one + two else 0.5


def score_documents(docs: DataFrame, burn_in: int = BURN_IN, samples: int = SAMPLES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``.

    The model learns from rows whose crc32(doc_id as text) mod 10 is not 0; rows
    with a null doc_id are held out. A null text is empty: one token, its end; so is
    a text of blanks. Texts of any length are read in slices and counted whole.
    Repeated rows are learned and scored each on its own; ties cannot arise. Without
    training rows all words are unknown, and an empty table gives no rows. Only the
    columns doc_id and text are read, so others may have any name. ``burn_in`` and
    ``samples`` are rounds of LOCAL_SWEEPS Gibbs sweeps. ``docs`` is read twice and
    must come in the same partitions and order, as a table does; else an error says so."""
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    buckets, homes = max(6, -(-total // BUCKET_BYTES)), max(6, -(-total // HOME_BYTES))
    deal = Deal(buckets, hot_contexts(docs, total, buckets))
    table = context_buckets(count_batches(docs, deal), deal, 2 * buckets)
    met = written(introductions(table, homes), "lm-words", ROW_GROUP_BYTES)
    home_table = word_homes(met, 2 * homes)
    cell_discount = _discount(*sums(met.where(f"kind = {FIGURES}").select("payload"), 2))
    hot = hot_totals(met)
    discard(met)
    words, tokens, guests, one, two = sums(home_table.select("figures"), 5)
    root = Root(words, (cell_discount, _discount(one, two)), 0, guests)
    heard = written(root_pass(home_table, None, root, 0, 2 * homes), "lm-root", ROW_GROUP_BYTES)

    def totals(rows: DataFrame) -> Root:
        return Root(words, root.discounts, *sums(rows.where(f"kind = {FIGURES}").select("payload"), 2))

    root, seats = totals(heard), None
    kept = []
    for number in range(1, burn_in + samples + 1):
        mail = heard.where(f"kind = {REPLY}")
        if seats is not None:
            mail = mail.unionByName(seats.where(f"kind = {SEATS}"))
        new = written(bucket_pass(table, mail, root, hot, number, 2 * buckets), "lm-seats", ROW_GROUP_BYTES)
        hot = hot_totals(new)
        mail = new.where(f"kind = {PART}").unionByName(heard.where(f"kind = {ROOT}"))
        told = written(root_pass(home_table, mail, root, number, 2 * homes), "lm-root", ROW_GROUP_BYTES)
        for old in (heard, seats):
            if old is not None and all(old is not t for pair in kept for t in pair[:2]):
                discard(old)
        heard, seats, root = told, new, totals(told)
        if number > burn_in:
            kept.append((seats, heard, root, hot))
    mail = last_replies(home_table, [k[1] for k in kept], 2 * homes).unionByName(_numbered([k[0] for k in kept], SEATS))
    answered = answers(table, mail, [k[2] for k in kept], [k[3] for k in kept], 2 * buckets)
    return add_up(answered, read_again(docs, deal), int(tokens), int(words))


def op8_pitman_yor_scores(spark, sf_dir: str) -> DataFrame:
    """Model and base log10 probability of every document."""
    return score_documents(read_table(spark, sf_dir, "documents"))
