"""Line dedup: winnowed fingerprints and extension against brute force over all windows of lines."""

import random

import pytest

import ledgerops.llm.lines as L
from odd_rows import no_docs, odd_docs  # noqa: F401


def brute(docs, size, long_words=None):
    """``docs`` without later windows of ``size`` lines, or of fewer lines with more than ``long_words`` words."""
    seen, out = set(), []
    for text in docs:
        lines = text.split("\n")
        gone = [False] * len(lines)
        for i in range(len(lines)):
            for k in range(1, size + 1):
                w = tuple(lines[i:i + k])
                if len(w) < k or k < size and (long_words is None or sum(len(x.split()) for x in w) <= long_words):
                    continue
                if w in seen:
                    gone[i:i + k] = [True] * k
                seen.add(w)
        out.append("\n".join(x for x, g in zip(lines, gone) if not g))
    return out


@pytest.mark.parametrize("size", [1, 2, 3, 5])
def test_random_lines_match_brute_force(spark, size):
    rng = random.Random(size)
    pool = ["", "common", *(f"line {i}" for i in range(12))]
    docs = ["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 30))) for _ in range(60)] + ["a\na\na\na\na\na", "a"]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in L.drop_repeated_lines(df, size).collect()}
    assert [got[i] for i in range(len(docs))] == brute(docs, size)


def test_every_repeated_run_shares_a_fingerprint(spark):
    """The winnowing guarantee: two texts that share three lines in a row share a selected line."""
    rng = random.Random(8)
    run = [f"shared {i}" for i in range(3)]
    rows = []
    for i in range(40):
        lines = [f"{i} {j} {rng.random()}" for j in range(rng.randint(0, 9))]
        at = rng.randint(0, len(lines))
        rows.append((i, "\n".join(lines[:at] + run + lines[at:])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = L.fingerprint_rows(df, 3).groupBy("fp").agg({"_doc": "count"}).collect()
    assert max(r[1] for r in found) >= 40


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a\nb\nc")], "doc_id long, text string")
    plan = L.drop_repeated_lines(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_odd_rows(odd_docs, no_docs):
    out = L.drop_repeated_lines(odd_docs)
    assert out.columns == odd_docs.columns
    rows = out.collect()
    assert len(rows) == 11
    text = {}
    for r in rows:
        text.setdefault(r["doc_id"], []).append(r["text"])
    # the null id comes first and keeps its lines; the later copies lose theirs
    assert text[None][0].startswith("the quick") and text[1] == [""]
    assert sorted(text[4]) == ["", "", "another text under the same id"]
    assert text[2] == [None] and text[3] == [""] and text[5] == ["   \n\t "]
    assert L.drop_repeated_lines(no_docs).collect() == []


def test_long_passages_of_fewer_than_three_lines(spark):
    """With ``long_words``, long single lines, line pairs and copies of short documents go; short common lines stay."""
    long = " ".join(f"w{i}" for i in range(60))
    half = [" ".join(f"{c}{i}" for i in range(30)) for c in "ab"]
    docs = [long, f"x\n{long}\ny", long, "short", "short", f"{half[0]}\n{half[1]}", f"p\n{half[0]}\n{half[1]}\nq\n{half[0]}",
            "1\n2\n3", f"0\n1\n2\n3\n{long}\n4"]
    df = spark.createDataFrame([*enumerate(docs), (99, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in L.drop_repeated_lines(df, long_words=50).collect()}
    assert [got[i] for i in range(len(docs))] == [long, "x\ny", "", "short", "short", docs[5], f"p\nq\n{half[0]}", docs[7], "0\n4"]
    assert got[99] is None
    assert [got[i] for i in range(len(docs))] == brute(docs, 3, 50)
    as_before = {r["doc_id"]: r["text"] for r in L.drop_repeated_lines(df).collect()}
    assert [as_before[i] for i in range(len(docs))] == brute(docs, 3)


def test_random_long_lines_match_brute_force(spark):
    rng = random.Random(21)
    pool = [" ".join(f"{c}{j}" for j in range(n)) for c in "abcdef" for n in (0, 3, 20, 30, 49, 50, 51, 70)]
    docs = ["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 5))) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in L.drop_repeated_lines(df, long_words=50).collect()}
    assert [got[i] for i in range(len(docs))] == brute(docs, 3, 50)


def test_no_long_line_stands_twice_in_what_is_left(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    left = L.drop_repeated_lines(docs, long_words=L.LONG_WORDS).selectExpr("explode(split(text, '\n')) AS line")
    again = left.groupBy("line").count().where("count > 1 AND size(split(trim(line), ' +')) > 50")
    assert again.count() == 0
