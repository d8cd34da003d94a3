"""Repair of the turn structure of conversations by secondary-sorted streaming.

Rows are dealt out by conversation and sorted by turn inside each partition; a
``mapInPandas`` pass reads them in order and carries a small dynamic programme
across Arrow batches. A conversation is well formed when its role initials read
``(s?(ua)+)?``; a row may be kept, given the other role or deleted, and empty
user or assistant rows may be inserted. The programme keeps, for each of the four
places in that pattern, the cheapest edits that lead there (ties: the edits whose
letters come first). Costs only matter relative to each other, so the set of
states is finite: a step is a lookup in a table that is filled as needed, and a
row's backpointer is one number in that table. Backpointers and rows of a giant
conversation go to temporary files of the task, so its memory does not grow with
the conversation but for one letter per edit.

Which (role, text) pairs stood in the conversation before is decided by Spark
ahead of the pass, on digests; the few later repeats enter the same sorted stream
as marker rows, so that the texts are shuffled once.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read_table, written

START, SYSTEM, USER, ASSISTANT = range(4)  # the last role initial so far
FOLLOWS = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
NAMES = {USER: "user", ASSISTANT: "assistant"}
COST = {"K": 0, "R": 3, "D": 4, "I": 3}
TRUNCATED_COST = 3
SOUND, REPEATED, CUT, BLANK = range(4)  # a row's first fault
# From USER or ASSISTANT any other state's edits can be followed with at most one insertion and one deletion more.
SLACK = COST["I"] + COST["D"]

SPILL_ROWS = 1 << 18    # backpointers and rows of a conversation beyond these go to temporary files
SPILL_CHARS = 8 << 20
OUT_ROWS = 4096
SPACE = " \t\n\x0b\x0c\r"


class Edits:
    """The table of steps: (state, row kind) -> next state, added cost, backpointers.

    A state is a tuple of (cost, rank) or None for each place; costs are above the
    least one, ranks order the best edits of the places by their letters. Edits that
    have used up the same rows never begin with one another, so ranks decide ties."""

    def __init__(self) -> None:
        first = ((0, 0), None, None, None)
        self.states, self.numbers = [first], {first: 0}
        self.known: dict[tuple[int, str, int], tuple[int, int, int]] = {}
        self.back: list[dict[int, tuple[int, str]]] = []  # of each step: place -> (place before, letters)

    @staticmethod
    def _with_insertions(state) -> Iterator[tuple[int, int, int, str]]:
        """(place, place after insertions, cost, letters); two insertions reach whatever any number does."""
        for place, entry in enumerate(state):
            if entry:
                now, cost = place, entry[0]
                for n in range(3):
                    yield place, now, cost, "I" * n
                    now, cost = FOLLOWS[now].get("u") or FOLLOWS[now]["a"], cost + COST["I"]

    def step(self, state: int, initial: str, fault: int) -> tuple[int, int, int]:
        """(next state, added cost, number of the step) after a row of that role initial and fault."""
        key = (state, initial, fault)
        if key not in self.known:
            self.known[key] = self._new_step(*key)
        return self.known[key]

    def _new_step(self, state: int, initial: str, fault: int) -> tuple[int, int, int]:
        before, best = self.states[state], {}

        def offer(place: int, cost: int, origin: int, letters: str) -> None:
            entry = (cost, before[origin][1], letters, origin)
            best[place] = min(best.get(place, entry), entry)

        for origin, place, cost, letters in self._with_insertions(before):
            offer(place, cost + COST["D"], origin, letters + "D")
            if fault in (SOUND, CUT):
                extra = TRUNCATED_COST if fault == CUT else 0
                if initial in FOLLOWS[place]:
                    offer(FOLLOWS[place][initial], cost + COST["K"] + extra, origin, letters + "K")
                for role in set(FOLLOWS[place]) & {"u", "a"}:
                    offer(FOLLOWS[place][role], cost + COST["R"] + extra, origin, letters + "R")
        top = min((best[p][0] for p in (USER, ASSISTANT) if p in best), default=None)
        if top is not None:
            best = {p: e for p, e in best.items() if e[0] <= top + SLACK}
        least = min(e[0] for e in best.values())
        ranks = {p: i for i, p in enumerate(sorted(best, key=lambda p: best[p][1:3]))}
        after = tuple((best[p][0] - least, ranks[p]) if p in best else None for p in range(4))
        if after not in self.numbers:
            self.numbers[after] = len(self.states)
            self.states.append(after)
        self.back.append({p: (e[3], e[2]) for p, e in best.items()})
        return self.numbers[after], least, len(self.back) - 1

    def end(self, state: int) -> tuple[int, int, str]:
        """(added cost, place of the last row, letters after it) of the best well-formed end."""
        entries = self.states[state]
        cost, _, letters, place = min((c, entries[p][1], letters, p) for p, now, c, letters in self._with_insertions(entries)
                                      if now in (START, ASSISTANT))
        return cost, place, letters


class Spill:
    """Rows of one conversation, in order; beyond the limits in a temporary file that goes with the object."""

    def __init__(self) -> None:
        self.rows, self.chars, self.file = [], 0, None

    def add(self, row: tuple) -> None:
        self.rows.append(row)
        self.chars += len(row[0]) + len(row[1])
        if self.chars > SPILL_CHARS or len(self.rows) > SPILL_ROWS:
            self.file = self.file or tempfile.TemporaryFile()
            pickle.dump(self.rows, self.file)
            self.rows, self.chars = [], 0

    def __iter__(self) -> Iterator[tuple]:
        if self.file:
            end = self.file.tell()
            self.file.seek(0)
            while self.file.tell() < end:
                yield from pickle.load(self.file)
        yield from self.rows


class Conversation:
    """The rows of one conversation, fed in order of turn, and its cheapest repair."""

    def __init__(self, conv_id, edits: Edits) -> None:
        self.conv_id, self.edits = conv_id, edits
        self.state = self.cost = 0
        self.rows, self.back, self.blocks, self.file = Spill(), array("I"), 0, None
        self.counts = [0, 0, 0, 0]
        self.illegal = self.distinct = 0
        self.low = self.high = self.last = self.turn = None
        self.marked: set[str] = set()

    def at_turn(self, turn) -> None:
        """Moves on to the rows of ``turn`` (None: unknown)."""
        if turn != self.turn:
            self.turn, self.marked = turn, set()

    def add(self, role: str, text: str, fault: int) -> None:
        if fault != BLANK and (self.last == (self.turn, role, text) or self.marked and repeat_key(role, text) in self.marked):
            fault = REPEATED
        if self.turn is not None and self.turn != self.high:
            self.low = self.turn if self.low is None else self.low
            self.high, self.distinct = self.turn, self.distinct + 1
        if self.last is not None and self.last[1][:1] + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = (self.turn, role, text)
        self.counts[fault] += 1
        self.rows.add((role, text, self.turn))
        self.state, cost, step = self.edits.step(self.state, role[:1], fault)
        self.cost += cost
        self.back.append(step)
        if len(self.back) == SPILL_ROWS:
            self.file = self.file or tempfile.TemporaryFile()
            self.back.tofile(self.file)
            self.back, self.blocks = array("I"), self.blocks + 1

    def _steps_from_last(self) -> Iterator[int]:
        yield from reversed(self.back)
        for block in reversed(range(self.blocks)):
            self.file.seek(block * SPILL_ROWS * self.back.itemsize)
            steps = array("I")
            steps.fromfile(self.file, SPILL_ROWS)
            yield from reversed(steps)

    def audit(self) -> bytearray:
        """The letters of the cheapest edits, in order; adds the cost of those after the last row."""
        cost, place, letters = self.edits.end(self.state)
        self.cost += cost
        found = bytearray(letters.encode())
        for step in self._steps_from_last():
            place, letters = self.edits.back[step][place]
            found += letters[::-1].encode()
        found.reverse()
        return found

    def repaired(self, audit: bytearray) -> Iterator[tuple[str, str, str, int | None]]:
        """(edit, role, text, turn) of every row that the edits leave or add."""
        rows, place = iter(self.rows), START
        for letter in audit:
            edit = chr(letter)
            role, text, turn = ("", "", None) if edit == "I" else next(rows)
            if edit == "D":
                continue
            initial = role[:1] if edit == "K" else next(r for r in ("u", "a") if r in FOLLOWS[place])
            place = FOLLOWS[place][initial]
            yield edit, role if edit == "K" else NAMES[place], text, turn

    def report(self) -> tuple:
        audit = self.audit()
        digest = hashlib.sha256()
        for i, (_, role, text, _) in enumerate(self.repaired(audit)):
            digest.update((b"\n" if i else b"") + role.encode() + b":" + text.encode())
        gaps = self.high - self.low + 1 - self.distinct if self.distinct else 0
        return (self.conv_id, gaps, self.counts[BLANK], self.counts[REPEATED], self.counts[CUT], self.illegal, self.cost,
                audit.decode(), digest.hexdigest())


def repeat_key(role: str, text: str) -> str:
    """What ``_repeat_key`` gives for a row, as a Python string."""
    return hashlib.sha256(f"{len(role)}:{role}:{text}".encode()).hexdigest()


def _repeat_key() -> Column:
    return F.sha2(F.concat_ws(":", F.length("_role"), "_role", "_text").cast("binary"), 256)


def _later_repeats(rows: DataFrame) -> DataFrame:
    """(_conv, _turn, key) where a (role, text) pair stands at a later turn than its first; a missing turn is the first of all."""
    at = F.struct(F.col("_turn").isNotNull().alias("known"), F.col("_turn").alias("turn"))
    digests = rows.where("_fault <> 3 AND NOT _gone").select("_conv", at.alias("at"), _repeat_key().alias("key"))
    # combined map-side, so a pair that fills a large part of a conversation is one row per task; the join can be split
    first = written(digests.groupBy("_conv", "key").agg(F.min("at").alias("first"), F.max("at").alias("last"))
                    .where("first <> last").select(F.col("_conv").alias("_c"), F.col("key").alias("_k"), "first"),
                    "conversation-repeats")
    same = F.col("_conv").eqNullSafe(F.col("_c")) & (F.col("key") == F.col("_k")) & (F.col("at") != F.col("first"))
    return digests.join(first, same).select("_conv", F.col("at.turn").alias("_turn"), "key").distinct()


def _sorted_stream(conversations: DataFrame, gone: Column | None) -> DataFrame:
    """Rows and markers dealt out by conversation, in order of turn; ``_mark`` rows carry a key in ``_role``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    tail = F.right(F.rtrim(text, F.lit(SPACE)), F.lit(1))
    rows = conversations.select(
        F.col("conv_id").cast("string").alias("_conv"), F.col("turn").cast("long").alias("_turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("_role"), text.alias("_text"),
        F.when(tail == "", BLANK).when(tail.isin(".", "!", "?"), SOUND).otherwise(CUT).alias("_fault"),
        (F.lit(False) if gone is None else F.coalesce(gone, F.lit(False))).alias("_gone"))
    marks = _later_repeats(rows).select("_conv", "_turn", F.col("key").alias("_role"), F.lit("").alias("_text"),
                                        F.lit(SOUND).alias("_fault"), F.lit(False).alias("_gone"), F.lit(True).alias("_mark"))
    kept = rows.withColumns({c: F.when(~F.col("_gone"), F.col(c)).otherwise("") for c in ("_role", "_text")})
    both = kept.withColumn("_mark", F.lit(False)).unionByName(marks).select(
        "_conv", F.col("_turn").isNotNull().alias("_known"), F.coalesce("_turn", F.lit(0)).alias("_turn"),
        (~F.col("_mark")).alias("_row"), "_role", "_text", "_fault", "_gone")
    return both.repartition("_conv").sortWithinPartitions("_conv", "_known", "_turn", "_row", "_role", "_text")


def _conversations(batches: Iterator[pd.DataFrame]) -> Iterator[Conversation]:
    """Every conversation of a sorted partition, as soon as its last row is read."""
    edits, current = Edits(), None
    for batch in batches:
        for conv, known, turn, row, role, text, fault, gone in zip(*(batch[c].tolist() for c in batch.columns), strict=True):
            if current is None or conv != current.conv_id:
                if current is not None:
                    yield current
                current = Conversation(conv, edits)
            if gone:
                continue
            current.at_turn(turn if known else None)
            if row:
                current.add(role, text, fault)
            else:
                current.marked.add(role)
    if current is not None:
        yield current


REPORT = ["_conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
REPORT_SCHEMA = ("_conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
                 "audit string, repaired_sha256 string")
ROWS = ["_conv", "place", "known", "turn", "edit", "role", "text"]
ROWS_SCHEMA = "_conv string, place long, known boolean, turn long, edit string, role string, text string"


def _frames(rows: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += len(row[-1]) + len(row[-2])
        if len(held) >= OUT_ROWS or chars > SPILL_CHARS:
            yield pd.DataFrame(held, columns=columns)
            held, chars = [], 0
    if held:
        yield pd.DataFrame(held, columns=columns)


def conversation_reports(conversations: DataFrame, gone: Column | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation.

    ``gone`` marks rows that are left out although their conversation gets a report
    (with no rows left: zeros and an empty audit). A null role or text counts as one
    space; rows with a null conv_id are one conversation; null turns come first and
    count for no gap. Rows of equal turn follow each other by role, then text, so
    repeated rows are neighbours and all but one are duplicates. Empty texts are
    blank; very long ones are read whole, one Arrow batch at a time. Other columns are
    ignored, whatever their names; an empty table gives no rows."""
    kind = conversations.schema["conv_id"].dataType

    def reports(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _frames((c.report() for c in _conversations(batches)), REPORT)

    found = _sorted_stream(conversations, gone).mapInPandas(reports, REPORT_SCHEMA)
    return found.select(F.col("_conv").cast(kind).alias("conv_id"), *REPORT[1:])


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, turn, edit, role, text) of the repaired conversations.

    place numbers the rows of a conversation from 0; edit is K (kept), R (given
    another role) or I (inserted, with an empty text and a null turn). Odd rows are
    treated as ``conversation_reports`` says; a conversation without rows left has none here."""
    kind = conversations.schema["conv_id"].dataType

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _frames(((c.conv_id, i, turn is not None, turn or 0, edit, role, text) for c in _conversations(batches)
                            for i, (edit, role, text, turn) in enumerate(c.repaired(c.audit()))), ROWS)

    found = _sorted_stream(conversations, None).mapInPandas(rows, ROWS_SCHEMA)
    return found.select(F.col("_conv").cast(kind).alias("conv_id"), "place", F.expr("if(known, turn, null)").alias("turn"),
                        "edit", "role", "text")


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): rows with a fault planted by the CRC of ``conv_id:turn``; nulls there are one space."""
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    text = F.coalesce(F.col("text").cast("string"), space)
    rows = conversations.select(
        "conv_id", "turn", F.coalesce(F.col("role").cast("string"), space).alias("role"), text.alias("text"),
        (F.crc32(name.cast("binary")) % 20).alias("_fate"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("_fate") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_fate") == 1, "").when(F.col("_fate") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"),
        (F.col("_fate") == 0).alias("gone"),
        F.explode(F.when(F.col("_fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")).drop("_copy")


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and repaired digest of every conversation after the planted damage."""
    rows = damaged(read_table(spark, sf_dir, "conversations"))
    return conversation_reports(rows.withColumnRenamed("gone", "_left_out"), F.col("_left_out"))
