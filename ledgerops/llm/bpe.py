"""Byte-level BPE encoding and decoding with a lexicon automaton for frequent words.

The corpus's frequent words and their token ids are compiled into a minimal
acyclic transducer: states with equal futures are shared, and outputs sit on
the arcs as early as possible. Its flat arrays are one file in the shared
folder; executors fetch it (``SparkFiles``) and memory-map it. A word that the
automaton does not hold is merged exactly by the vocabulary's ranks. Results do
not depend on which words are in the lexicon.
"""

from __future__ import annotations

import heapq
import json
import mmap
import os
import re
from array import array
from collections.abc import Iterator
from hashlib import sha256
from itertools import accumulate, chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import bounded_counts, read_table, worker_cache, written

LEXICON_WORDS = 32768
CACHE_PIECES = 150_000  # of either kind that a worker keeps
COUNTED_PIECES = 100_000  # that a task counts before it hands the counts on
LONG_WORD = 64
MARKS = ".,;:!?"  # marks that are a word of their own after letters
PART_BYTES = 1 << 20
MET_MASK = (1 << 22) - 1
# Fixed value: the pre-tokenizer pattern of byte-level BPE vocabularies.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NOT_FINAL = 0xFFFFFFFF
TOKEN_BITS = 24
TOKEN = (1 << TOKEN_BITS) - 1
NO_MERGE = 1 << 62


# -- vocabulary ------------------------------------------------------------------

def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file: printable Latin-1 bytes stand
    for themselves, the others for the letters from U+0100 on, in order."""
    letters, spare = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            letters.append(chr(b))
        else:
            letters.append(chr(spare))
            spare += 1
    return letters


def read_vocabulary(path: str) -> dict:
    """Merges, byte ids, token bytes and added tokens of a byte-level BPE file (a bounded table: its size is the
    vocabulary's, whatever the corpus)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = _byte_letters()
    value = {c: b for b, c in enumerate(letters)}
    vocab = spec["model"]["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    tokens = [b""] * (max(chain(vocab.values(), added.values())) + 1)
    for token, i in vocab.items():
        tokens[i] = bytes(value[c] for c in token)
    for token, i in added.items():
        tokens[i] = token.encode()
    return {"stand_in": class_corrections(path), "byte": [vocab[c] for c in letters], "tokens": tokens, "added": added,
            # the rank above the merged token's id, so that the smallest value is the next merge
            "merge": {(vocab[a], vocab[b]): rank << TOKEN_BITS | vocab[a + b] for rank, (a, b) in enumerate(pairs)}}


def merge_word(word: bytes, byte: list[int], merge: dict) -> list[int]:
    """Token ids of one word: the lowest-ranked adjacent pair is merged, leftmost first, until none is left."""
    ids = [byte[b] for b in word]
    if len(ids) > 48:
        return _merge_long(ids, merge)
    get = merge.get
    ranks = [get(p, NO_MERGE) for p in zip(ids, ids[1:])]
    while ranks:
        best = min(ranks)
        if best == NO_MERGE:
            break
        i = ranks.index(best)
        ids[i:i + 2] = [best & TOKEN]
        del ranks[i]
        if i:
            ranks[i - 1] = get((ids[i - 1], ids[i]), NO_MERGE)
        if i < len(ranks):
            ranks[i] = get((ids[i], ids[i + 1]), NO_MERGE)
    return ids


def _merge_long(ids: list[int], merge: dict) -> list[int]:
    """The same merges with a heap and a linked list (n log n for a word of any length)."""
    n = len(ids)
    right, left = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(merge[p], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in merge]
    heapq.heapify(heap)
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = right[i] if ids[i] is not None else n
        if j >= n or (ids[i], ids[j]) != pair:
            continue
        ids[i], ids[j] = merge[pair] & TOKEN, None
        right[i] = k = right[j]
        if k < n:
            left[k] = i
            if (p := (ids[i], ids[k])) in merge:
                heapq.heappush(heap, (merge[p], i, p))
        if (h := left[i]) >= 0 and (p := (ids[h], ids[i])) in merge:
            heapq.heappush(heap, (merge[p], h, p))
    return [x for x in ids if x is not None]


STAND_IN = {"L": "\u00df", "N": "\u00b2", "S": "\u2003", "O": "\u2014"}


def class_corrections(path: str) -> dict[int, str]:
    """Code points that the tokenizers library puts in another class (letter, number, white space, other) than
    the ``regex`` module does, each with a stand-in of the library's class. The two follow different Unicode
    versions; the table's size is bounded by the code space."""
    from tokenizers import Tokenizer

    split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    mine = {c: regex.compile(p).match for c, p in (("L", r"\p{L}"), ("N", r"\p{N}"), ("S", r"\s"))}
    found = {}
    points = [*range(0x80, 0xD800), *range(0xE000, 0x40000), *range(0xE0000, 0xE1000)]
    for lo in range(0, len(points), 4096):
        part = points[lo:lo + 4096]
        starts = {s for _, (s, _) in split("".join(f"a{chr(p)}\n1{chr(p)}\n!{chr(p)}\n" for p in part))}
        for i, p in enumerate(part):
            theirs = next((c for c, at in (("L", 1), ("N", 4), ("O", 7)) if 9 * i + at not in starts), "S")
            if theirs != next((c for c, match in mine.items() if match(chr(p))), "O"):
                found[p] = STAND_IN[theirs]
    return found


# -- lexicon automaton -----------------------------------------------------------

def _shared(a: tuple, b: tuple) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def compile_lexicon(entries: list[tuple[bytes, tuple[int, ...]]]) -> bytes:
    """Flat arrays of the minimal acyclic transducer of the sorted distinct words and their ids.

    Words are added in order; the states of the previous word's tail, which can
    no longer change, are replaced by an equal registered state if there is one."""
    registry: dict[tuple, int] = {}
    states: list[tuple] = []
    # open states along the last word: [arcs of (label, target, output), final, final output]
    path: list[list] = [[[], False, ()]]
    last = b""

    def close(depth: int) -> None:
        while len(path) - 1 > depth:
            arcs, final, out = path.pop()
            key = (final, out, tuple(arcs))
            if key not in registry:
                registry[key] = len(states)
                states.append(key)
            label, _, output = path[-1][0][-1]
            path[-1][0][-1] = (label, registry[key], output)

    for word, ids in entries:
        common, rest = _shared(word, last), tuple(ids)
        close(common)
        for depth in range(common):
            label, target, output = path[depth][0][-1]
            keep = _shared(output, rest)
            moved, rest = output[keep:], rest[keep:]
            if moved:
                path[depth][0][-1] = (label, target, output[:keep])
                arcs, final, out = path[depth + 1]
                path[depth + 1] = [[(x, t, moved + o) for x, t, o in arcs], final, moved + out if final else out]
        for depth in range(common, len(word)):
            path[depth][0].append((word[depth], -1, rest if depth == common else ()))
            path.append([[], False, ()])
        path[-1][1] = True
        if len(word) == common:
            path[-1][2] = rest
        last = word
    close(0)
    states.append((path[0][1], path[0][2], tuple(path[0][0])))

    arc_start, final_size, final_at, target, out_at, pool, labels = [0], [], [], [], [0], [], bytearray()
    for final, out, arcs in states:
        final_size.append(len(out) if final else NOT_FINAL)
        final_at.append(len(pool))
        pool.extend(out)
    outputs = len(pool)
    for _, _, arcs in states:
        for label, to, out in arcs:
            labels.append(label)
            target.append(to)
            pool.extend(out)
            out_at.append(len(pool) - outputs)
        arc_start.append(len(target))
    head = [len(states), len(target), len(pool), outputs]
    return np.array(head + arc_start + final_size + final_at + target + out_at + pool, "<u4").tobytes() + bytes(labels)


class Lexicon:
    """A compiled lexicon over a memory-mapped file (or bytes)."""

    ONE = [bytes([b]) for b in range(256)]

    def __init__(self, buffer):
        self.buffer = buffer
        view = memoryview(buffer)
        states, arcs, pool, outputs = view[:16].cast("I")
        sizes = (states + 1, states, states, arcs, arcs + 1, pool)
        at, parts = 16, []
        for size in sizes:
            parts.append(view[at:at + 4 * size].cast("I"))
            at += 4 * size
        self.arc_start, self.final_size, self.final_at, self.target, self.out_at, self.pool = parts
        self.labels, self.outputs, self.root = at, outputs, states - 1

        # arcs by (state, byte), for walking many words at once
        state = np.repeat(np.arange(states), np.diff(np.asarray(self.arc_start).astype(np.int64)))
        self.arc_keys = state << 8 | np.frombuffer(view, np.uint8, arcs, at)
        self.targets, self.finals = np.asarray(self.target), np.asarray(self.final_size)

    def known(self, words: list[bytes]) -> np.ndarray:
        """Numbers of the words that the lexicon holds; all words walk the automaton in step."""
        if not len(self.arc_keys) or not words:
            return np.array([], np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(sizes) - sizes
        text = np.frombuffer(b"".join(words), np.uint8)
        walking = np.flatnonzero(sizes > 0)
        state = np.full(len(walking), self.root, np.int64)
        found, depth = [], 0
        while len(walking):
            key = state << 8 | text[starts[walking] + depth]
            arc = np.minimum(np.searchsorted(self.arc_keys, key), len(self.arc_keys) - 1)
            on = self.arc_keys[arc] == key
            walking, state = walking[on], self.targets[arc[on]].astype(np.int64)
            depth += 1
            end = sizes[walking] == depth
            found.append(walking[end & (self.finals[state] != NOT_FINAL)])
            walking, state = walking[~end], state[~end]
        return np.concatenate(found)

    def lookup(self, word: bytes) -> list[int] | None:
        state, out, find, one = self.root, [], self.buffer.find, self.ONE
        for b in word:
            arc = find(one[b], self.labels + self.arc_start[state], self.labels + self.arc_start[state + 1])
            if arc < 0:
                return None
            arc -= self.labels
            lo, hi = self.out_at[arc], self.out_at[arc + 1]
            if hi > lo:
                out.extend(self.pool[self.outputs + lo:self.outputs + hi])
            state = self.target[arc]
        size = self.final_size[state]
        if size == NOT_FINAL:
            return None
        return out + list(self.pool[self.final_at[state]:self.final_at[state] + size]) if size else out


# -- texts -----------------------------------------------------------------------

def merge_tables(merge: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted pair keys, their ranks, and the merged token of each rank."""
    keys = np.fromiter((a << TOKEN_BITS | b for a, b in merge), np.int64, len(merge))
    packed = np.fromiter(merge.values(), np.int64, len(merge))
    order = np.argsort(keys)
    ranks = packed[order] >> TOKEN_BITS
    merged = np.zeros(int(ranks.max(initial=0)) + 1, np.int64)
    merged[ranks] = packed[order] & TOKEN
    return keys[order], ranks, merged


def merge_words(words: list[bytes], byte: np.ndarray, tables: tuple) -> list[bytes]:
    """Token ids (int32 bytes) of many words at once, by the merges of ``merge_word``.

    In every round each unfinished word merges all places of its lowest-ranked
    pair; only the pairs beside a merge are looked up again."""
    keys, ranks, merged = tables

    def rank_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        pair = a << TOKEN_BITS | b
        at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
        return np.where(keys[at] == pair, ranks[at], NO_MERGE)

    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ids = byte[np.frombuffer(b"".join(words), np.uint8)]
    word = np.repeat(np.arange(len(words)), sizes)
    rank = np.full(len(ids), NO_MERGE)
    inside = np.flatnonzero(word[1:] == word[:-1])
    rank[inside] = rank_of(ids[inside], ids[inside + 1])
    done_ids, done_word = [], []
    while len(ids):
        starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        length = np.diff(np.concatenate([starts, [len(ids)]]))
        best = np.repeat(np.minimum.reduceat(rank, starts), length)
        over = best == NO_MERGE
        if over.any():
            done_ids.append(ids[over])
            done_word.append(word[over])
            ids, word, rank, best = (x[~over] for x in (ids, word, rank, best))
            if not len(ids):
                break
        take = rank == best
        twice = np.flatnonzero(take[1:] & take[:-1])  # the same pair may overlap itself: every second place of a run
        if len(twice):
            place = np.arange(len(take))
            run = np.maximum.accumulate(np.where(take & ~np.concatenate([[False], take[:-1]]), place, 0))
            take &= (place - run) % 2 == 0
        at = np.flatnonzero(take)
        ids[at] = merged[rank[at]]
        keep = np.ones(len(ids), bool)
        keep[at + 1] = False
        stale = np.zeros(len(ids), bool)
        stale[at] = True
        ids, word, stale, rank = ids[keep], word[keep], stale[keep], rank[keep]
        stale[:-1] |= stale[1:]
        again = np.flatnonzero(stale)
        rank[again] = NO_MERGE
        again = again[(again + 1 < len(ids))]
        again = again[word[again] == word[again + 1]]
        rank[again] = rank_of(ids[again], ids[again + 1])
    if not words:
        return []
    ids, word = np.concatenate(done_ids), np.concatenate(done_word)
    order = np.argsort(word, kind="stable")
    data = ids[order].astype(np.int32).tobytes()
    ends = np.cumsum(np.bincount(word, minlength=len(words))) * 4
    return [data[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]


def word_splitter(stand_in: dict[int, str]):
    """text -> pre-tokens. A text with code points of a corrected class is split by its stand-ins' places."""
    find = regex.compile(WORD).findall
    odd = frozenset(map(chr, stand_in))

    def words(text: str) -> list[str]:
        if text.isascii() or odd.isdisjoint(text):
            return find(text)
        ends = list(accumulate(map(len, find(text.translate(stand_in)))))
        return [text[a:b] for a, b in zip([0, *ends], ends)]

    return words


class Encoder:
    """Encodes texts as the tokenizers library does (special tokens in a text become their ids).

    Pieces between single spaces are encoded once and kept, up to a bound, for
    the worker's later texts."""

    def __init__(self, vocabulary: dict, lexicon: Lexicon | None):
        self.byte, self.merge, self.added = vocabulary["byte"], vocabulary["merge"], vocabulary["added"]
        self.byte_ids, self.tables = np.array(self.byte, np.int64), merge_tables(self.merge)
        self.lexicon = lexicon
        self.words = word_splitter(vocabulary["stand_in"])
        self.spaced: dict[str, bytes] = {}  # ids of a space and the piece
        self.exact: dict[str, bytes] = {}   # ids of the text itself
        self.met = bytearray(MET_MASK + 1)  # which pieces came before, by hash
        self.held: dict[bytes, bytes] = {}  # ids of the lexicon's words met so far
        odd = frozenset(map(chr, vocabulary["stand_in"]))
        # letters only, of code points whose class is not in doubt
        self.all_letters = lambda t: t.isalpha() and (t.isascii() or odd.isdisjoint(t))
        self.mark_ids = {m: array("i", merge_word(m.encode(), self.byte, self.merge)).tobytes() for m in MARKS}
        self.space_run = re.compile(r" \s").search
        special = sorted(self.added, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    def _learn(self, cache: dict[str, bytes], texts: set[str], prefix: str) -> list[str]:
        """Put the ids of ``texts`` into the cache; returns those to forget after this part: long ones, and those
        that the worker has not met before (most never come again)."""
        if len(cache) > CACHE_PIECES:  # the older half makes room
            for key in list(islice(cache, len(cache) // 2)):
                del cache[key]
        texts = texts.difference(cache)
        letters = self.all_letters
        # a space and letters are one word; a mark at the end is a word of its own and the rest may be known already
        plain, marked, other = set(), [], []
        for t in texts:
            if not prefix:
                other.append(t)
            elif letters(t):
                plain.add(t)
            elif t[-1:] in MARKS and letters(t[:-1]):
                marked.append(t)
                plain.add(t[:-1])
            else:
                other.append(t)
        fresh = list(plain.difference(cache))
        split = [self.words(prefix + t) for t in other]
        words = [(prefix + t).encode() for t in fresh]
        words += [w.encode() for w in chain.from_iterable(split)]
        found = self._word_ids(words)
        cache.update(zip(fresh, found))
        mark = self.mark_ids
        for t in marked:
            cache[t] = cache[t[:-1]] + mark[t[-1]]
        at = len(fresh)
        for t, parts in zip(other, split):
            n = len(parts)
            cache[t] = found[at] if n == 1 else b"".join(found[at:at + n])
            at += n
        texts = texts.union(fresh)
        met, passing = self.met, []
        for t in texts:
            place = hash(t) & MET_MASK
            if not met[place] or len(t) > LONG_WORD:
                met[place] = 1
                passing.append(t)
        return passing

    def _word_ids(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word: from the lexicon, else by merging."""
        found: list = [None] * len(words)
        if self.lexicon:
            held = self.held  # no more entries than the lexicon has words
            for i in self.lexicon.known(words).tolist():
                ids = held.get(words[i])
                if ids is None:
                    ids = held[words[i]] = array("i", self.lexicon.lookup(words[i])).tobytes()
                found[i] = ids
        unseen = []
        for i, ids in enumerate(found):
            if ids is None:
                if len(words[i]) > LONG_WORD:
                    found[i] = array("i", merge_word(words[i], self.byte, self.merge)).tobytes()
                else:
                    unseen.append(i)
        for i, ids in zip(unseen, merge_words([words[i] for i in unseen], self.byte_ids, self.tables)):
            found[i] = ids
        return found

    def _plan(self, text: str) -> list[tuple[list[str], list[str]]]:
        """Parts of the text: exact pieces, then pieces that a single space precedes."""
        # A single space between two words always starts a word, so the pieces between such spaces can be
        # encoded apart; texts with a space before white space (runs belong together) are split whole.
        if text[-1:] == " " or self.space_run(text):
            return [(self.words(text), [])]
        first, *rest = text.split(" ")
        return [([first], rest)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        plans = []
        for text in texts:
            if self.special is None or not self.special.search(text):
                plans.append(self._plan(text))
            else:
                plans.append(list(chain.from_iterable(
                    [([p], None)] if i % 2 else self._plan(p) for i, p in enumerate(self.special.split(text)))))
        parts = [p for plan in plans for p in plan]
        passing = (self._learn(self.exact, set(chain.from_iterable(e for e, r in parts if r is not None)), ""),
                   self._learn(self.spaced, set(chain.from_iterable(r for _, r in parts if r)), " "))
        exact, spaced = self.exact.__getitem__, self.spaced.__getitem__
        out = []
        for plan in plans:
            out.append(np.frombuffer(b"".join(chain.from_iterable(
                [array("i", [self.added[e[0]]]).tobytes()] if r is None else chain(map(exact, e), map(spaced, r))
                for e, r in plan)), np.int32))
        for cache, keys in zip((self.exact, self.spaced), passing):
            for key in keys:
                del cache[key]
        return out


def _texts(column: pa.Array) -> Iterator[str]:
    for b in column.cast(pa.binary()):
        yield (b.as_py() or b"").decode("utf-8", "replace")


def _parts(column: pa.Array) -> Iterator[list[str]]:
    """The texts in runs of about PART_BYTES characters."""
    part, size = [], 0
    for text in _texts(column):
        part.append(text)
        size += len(text)
        if size > PART_BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part


def piece_counts(docs: DataFrame) -> DataFrame:
    """(piece, n): how often each piece between spaces occurs in all texts, combined before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in bounded_counts((text.split(" ") for text in _texts(batch.column(0))), COUNTED_PIECES):
                yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())],
                                                 names=["piece", "n"])

    return (docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "piece string, n long")
            .groupBy("piece").agg(F.sum("n").alias("n")))


def frequent_pieces(docs: DataFrame, size: int) -> list[str]:
    """The most frequent pieces, at most ``size``: all that occur more often than the smallest count for which
    they are no more than that. Only a histogram of counts and these pieces reach the driver."""
    counts = written(piece_counts(docs).where("length(piece) between 1 and 64 and n > 1"), "bpe-pieces")
    # counts in steps of about 1/16, so the histogram has a few hundred rows whatever the corpus
    step = F.floor(F.log2("n") * 16)
    room, least = size, None
    for r in counts.groupBy(step.alias("s")).count().orderBy(F.desc("s")).collect():
        if r["count"] > room:
            break
        room, least = room - r["count"], r["s"]
    return [] if least is None else [r[0] for r in counts.where(step >= least).select("piece").collect()]


def publish_lexicon(spark: SparkSession, docs: DataFrame, vocabulary: dict, size: int = LEXICON_WORDS) -> str:
    """Compile the words of the frequent pieces of ``docs`` into a file in the shared folder and register it
    with ``addFile``; returns its name. ``size`` bounds what reaches the driver and changes no result."""
    split = word_splitter(vocabulary["stand_in"])
    words = sorted({w.encode() for p in frequent_pieces(docs, size) for w in split(" " + p)})
    data = compile_lexicon([(w, tuple(merge_word(w, vocabulary["byte"], vocabulary["merge"]))) for w in words])
    path = scratch_path(spark, "lexicon") + ".bin"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    out.write(bytearray(data))
    out.close()
    spark.sparkContext.addFile(str(target))
    return os.path.basename(path)


def open_lexicon(name: str) -> Lexicon:
    with open(SparkFiles.get(name), "rb") as f:
        return Lexicon(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))


def _encoder(shared, name: str) -> Encoder:
    """The worker's encoder for this lexicon."""
    cache = worker_cache("bpe")
    if cache.get("name") != name:
        cache.update(name=name, encoder=Encoder(shared.value, open_lexicon(name)))
    return cache["encoder"]


def _prepared(docs: DataFrame, vocabulary: dict, lexicon_words: int):
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    name = publish_lexicon(docs.sparkSession, rows, vocabulary, lexicon_words)
    return rows, docs.sparkSession.sparkContext.broadcast(vocabulary), name


def encode_documents(docs: DataFrame, vocabulary_path: str, lexicon_words: int = LEXICON_WORDS, decoded: bool = False) -> DataFrame:
    """(doc_id, ids array<int>) of every row of ``docs``; whole texts, a null text is empty, rows stay as they are
    (null or repeated doc_ids included). An empty table gives no rows. With ``decoded`` the ids are decoded again in
    the same task, and ``decoded_sha256`` is the digest of that text."""
    rows, shared, name = _prepared(docs, read_vocabulary(vocabulary_path), lexicon_words)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), *[("decoded_sha256", pa.string())] * decoded])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, tokens = _encoder(shared, name).encode, shared.value["tokens"]
        for batch in batches:
            start = 0
            for part in _parts(batch.column(1)):
                found = encode(part)
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                columns = [batch.column(0).slice(start, len(part)),
                           pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))]
                if decoded:
                    columns.append(pa.array([sha256(decode_ids(x.tolist(), tokens).encode()).hexdigest() for x in found], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
                start += len(part)

    return rows.mapInArrow(run, "doc_id long, ids array<int>" + ", decoded_sha256 string" * decoded)


def decode_ids(ids: list[int], tokens: list[bytes]) -> str:
    """The text of an id list, special tokens included; bytes that are no UTF-8 become U+FFFD."""
    return b"".join(map(tokens.__getitem__, ids)).decode("utf-8", "replace")


def decode_documents(encoded: DataFrame, vocabulary_path: str) -> DataFrame:
    """(doc_id, ids, text): the text of each id list, as decode(ids, skip_special_tokens=False) gives it. A null
    list is empty."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path)["tokens"])
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shared.value
        for batch in batches:
            texts = [decode_ids(ids.as_py() or [], tokens) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())],
                                             schema=schema)

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")


def round_trip_digests(docs: DataFrame, vocabulary_path: str, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: texts are encoded and their ids decoded again in
    the same task, so that neither ids nor texts travel between processes. Nulls as in ``encode_documents``."""
    rows, shared, name = _prepared(docs, read_vocabulary(vocabulary_path), lexicon_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, tokens = _encoder(shared, name).encode, shared.value["tokens"]
        digits = [str(i) for i in range(len(tokens))]
        for batch in batches:
            counts, encoded, decoded = [], [], []
            for part in _parts(batch.column(1)):
                for ids in encode(part):
                    ids = ids.tolist()
                    counts.append(len(ids))
                    encoded.append(sha256(",".join(map(digits.__getitem__, ids)).encode()).hexdigest())
                    decoded.append(sha256(decode_ids(ids, tokens).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(encoded, pa.string()),
                                              pa.array(decoded, pa.string())],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_bpe_encode_decode(spark, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of the decoded text of every document."""
    import public_tokenizers

    return round_trip_digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
