"""Conversation repair against a brute-force search of all edits."""

import hashlib
import random
import re
import sys
import zlib
from functools import cache

from pyspark.sql import functions as F

from ledgerops.llm import conversations as C

SF_SMALL = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
BLANKS = " \t\n\x0b\x0c\r"
sys.setrecursionlimit(20_000)  # the search below goes one call deeper with every row


def cheapest(rows):
    """(cost, letters, repaired rows) by trying every edit from each row on; rows of (role, text, fault)."""
    targets = {"": "su", "s": "u", "u": "a", "a": "u"}

    @cache
    def best(i, last, inserted):
        found = []
        if i == len(rows) and last in ("", "a"):
            found.append((0, "", ()))

        def go(cost, letter, row, j, now, n):
            if (rest := best(j, now, n)) is not None:
                found.append((cost + rest[0], letter + rest[1], row + rest[2]))

        if inserted < 4:
            for r in set(targets[last]) & set("ua"):
                go(3, "I", ({"u": "user:", "a": "assistant:"}[r],), i, r, inserted + 1)
        if i < len(rows):
            role, text, fault = rows[i]
            go(4, "D", (), i + 1, last, 0)
            if fault not in ("blank", "duplicate"):
                extra = 3 if fault == "truncated" else 0
                if role[:1] and role[:1] in targets[last]:
                    go(extra, "K", (f"{role}:{text}",), i + 1, role[:1], 0)
                for r in set(targets[last]) & set("ua"):
                    go(3 + extra, "R", ({"u": "user", "a": "assistant"}[r] + ":" + text,), i + 1, r, 0)
        return min(found, default=None)

    return best(0, "", 0)


def expected(table, damage=True):
    by_id = {}
    for conv, turn, role, text in table:
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fate = zlib.crc32(name.encode()) % 20 if damage else 19
        rows = by_id.setdefault(conv, [])
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        rows += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    out = {}
    for conv, rows in by_id.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, seen = [], set()
        for _, role, text in rows:
            body = text.rstrip(BLANKS)
            faults.append("blank" if not body else "duplicate" if (role, text) in seen
                          else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {t for t, _, _ in rows if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit, kept = cheapest(tuple((r, t, f) for (_, r, t), f in zip(rows, faults)))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"),
                     faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit,
                     hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def as_dict(df):
    rows = df.collect()
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: tuple(r)[1:] for r in rows}


def random_table(n, seed):
    pick, table = random.Random(seed), []
    for conv in range(n):
        turn = 0
        for _ in range(pick.randint(1, 9)):
            turn = None if pick.random() < 0.05 else (turn or 0) + pick.choice([0, 1, 1, 1, 2])
            table.append((conv, turn, pick.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None]),
                          pick.choice(["Yes.", "No!", "so", "", " \n", None, "Why?  ", "x" * 40 + "."])))
    return table


def test_random_conversations_equal_brute_force(spark):
    table = random_table(400, 7)
    df = spark.createDataFrame(table, SCHEMA).repartition(3)
    assert as_dict(C.conversation_reports(df)) == expected(table, damage=False)
    hurt = C.damaged(df)
    assert as_dict(C.conversation_reports(hurt, F.col("gone"))) == expected(table)


def test_query_equals_brute_force_on_the_whole_table(spark):
    table = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/conversations.parquet")
             .select("conv_id", "turn", "role", "text").collect()]
    assert as_dict(C.op13_conversation_repair(spark, SF_SMALL)) == expected(table)


def test_spilled_conversation_equals_the_one_in_memory(spark, monkeypatch):
    pick = random.Random(3)
    rows = [(pick.choice(["user", "assistant", "system"]), pick.choice(["Yes.", "no", "", f"{i}."])) for i in range(3000)]

    def run():
        talk = C.Conversation(1, C.Edits())
        for i, (role, text) in enumerate(rows):
            talk.at_turn(i)
            talk.add(role, text, C.BLANK if not text else C.CUT if text == "no" else C.SOUND)
        return talk, talk.report(), list(talk.repaired(talk.audit()))

    held, report, out = run()
    monkeypatch.setattr(C, "SPILL_ROWS", 64)
    spilled, report_2, out_2 = run()
    assert held.file is None and spilled.file is not None and spilled.rows.file is not None
    assert report == report_2 and out == out_2
    assert len(held.edits.states) < 500
    cost = cheapest(tuple((r, t, "blank" if not t else "truncated" if t == "no" else "") for r, t in rows[:200]))[0]
    talk = C.Conversation(1, C.Edits())
    for i, (role, text) in enumerate(rows[:200]):
        talk.at_turn(i)
        talk.add(role, text, C.BLANK if not text else C.CUT if text == "no" else C.SOUND)
    assert talk.report()[6] == cost


def test_repaired_rows_are_well_formed(spark):
    table = random_table(100, 11)
    rows = C.repair_conversations(spark.createDataFrame(table, SCHEMA)).collect()
    by_id = {}
    for r in sorted(rows, key=lambda r: (r.conv_id, r.place)):
        by_id.setdefault(r.conv_id, []).append(r)
    reports = expected(table, damage=False)
    for conv, report in reports.items():
        talk = by_id.get(conv, [])
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in talk))
        assert [r.edit for r in talk] == [c for c in report[6] if c != "D"]
        digest = hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in talk).encode()).hexdigest()
        assert digest == report[7] and [r.place for r in talk] == list(range(len(talk)))
        assert all(r.turn is None and r.text == "" for r in talk if r.edit == "I")


def test_one_large_conversation_and_odd_rows(spark):
    hot = [(5, i, "user" if i % 2 == 0 else "assistant", "Same." if i % 3 else f"Turn {i}.") for i in range(300)]
    odd = [(None, None, None, None), (None, 3, "user", "Hi."), (None, 3, "user", "Hi."), (7, 2**62, "user", "naïve 🙂."),
           (7, 2**62 + 1, "assistant", "y" * 200_000), (8, -3, "assistant", ""), (8, 5, "system", "Be kind.")]
    df = spark.createDataFrame(hot + odd, SCHEMA)
    df = df.select("*", *[F.lit(1).alias(c) for c in ("_conv", "_role", "place", "key", "gone", "_fate", "_copy", "audit")])
    got = as_dict(C.conversation_reports(C.damaged(df), F.col("gone")))
    assert got == expected(hot + odd)
    ints = spark.createDataFrame([(1, 2, "user", "A."), (1, 1, "assistant", "B.")], "conv_id int, turn int, role string, text string")
    assert C.conversation_reports(ints).schema["conv_id"].dataType.simpleString() == "int"


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert C.conversation_reports(none).count() == 0 and C.repair_conversations(none).count() == 0
    gone = spark.createDataFrame([(1, 1, "user", "A.")], SCHEMA)
    report = C.conversation_reports(gone, F.lit(True)).collect()[0]
    assert tuple(report) == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
