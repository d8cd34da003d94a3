"""Line dedup by winnowing over line hashes (DataFrame functions only).

A document is its lines (split at newlines). In every window of ``size``
consecutive lines the leftmost smallest line hash is the window's fingerprint,
so each repeated run of ``size`` or more lines is sure to share one. Positions
join on the fingerprints that occur more than once; from each such position the
match extends both ways to the windows around it, whose contents decide. A
window that also starts earlier (smaller doc_id, or earlier in the same text)
is a repeat; overlapping repeats join to runs, and the runs' lines are deleted.

With ``long_words``, runs of fewer than ``size`` lines count too when they hold
more words than that: their digests are grouped directly. So do the registered
query and the pipeline: three lines, or more than LONG_WORDS words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import read_table, written

WINDOW = 3
LONG_WORDS = 50
WORD = "[^ \\t\\n\\x0B\\f\\r]+"
RUNS = "_repeated_line_runs"


def fingerprint_rows(docs: DataFrame, size: int) -> DataFrame:
    """(_doc, _text, fp, windows): a row per selected position, with the windows whose fingerprint it is."""
    body = F.col("text").cast("string")
    lines = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.xxhash64(body).alias("_text"),
                        F.transform(F.split(body, "\n"), lambda x: F.xxhash64(x)).alias("h"))
    spans = lines.where(F.size("h") >= size).select("_doc", "_text", "h", F.transform(
        F.sequence(F.lit(1), F.size("h") - (size - 1)), lambda i: F.slice("h", i, size)).alias("s"))
    marked = spans.select("_doc", "_text", "h", F.transform("s", lambda s, i: F.struct(
        i.alias("start"), (i + F.array_position(s, F.array_min(s)).cast("int") - 1).alias("p"),
        F.xxhash64(s).alias("d1"), F.xxhash64(F.lit(size), F.reverse(s)).alias("d2"))).alias("w"))
    places = marked.select("_doc", "_text", "h", "w", F.array_distinct(F.transform("w", lambda x: x["p"])).alias("at"))
    rows = places.select("_doc", "_text", F.explode(F.transform("at", lambda p: F.struct(
        F.get("h", p).alias("fp"),
        F.filter(F.slice("w", F.greatest(p - (size - 1), F.lit(0)) + 1, size), lambda x: x["p"] == p).alias("windows"))))
        .alias("f"))
    return rows.select("_doc", "_text", "f.fp", F.transform("f.windows", lambda x: F.struct(
        x["start"].alias("start"), x["d1"].alias("d1"), x["d2"].alias("d2"))).alias("windows"))


def long_spans(docs: DataFrame, size: int, words: int) -> DataFrame:
    """(_doc, _text, start, d1, d2, end) of every run of fewer than ``size`` lines that holds more than ``words`` words."""
    body = F.col("text").cast("string")
    lines = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.xxhash64(body).alias("_text"),
                        F.transform(F.split(body, "\n"), lambda x: F.struct(
                            F.xxhash64(x).alias("h"), F.size(F.regexp_extract_all(x, F.lit(WORD), F.lit(0))).alias("n"))).alias("l"))

    def runs_of(k: int):
        runs = F.transform(F.sequence(F.lit(0), F.size("l") - k), lambda i: F.struct(i.alias("i"), F.slice("l", i + 1, k).alias("s")))
        long = F.filter(runs, lambda x: F.aggregate(x["s"], F.lit(0).cast("long"), lambda n, y: n + y["n"]) > words)
        return F.transform(long, lambda x: F.struct(
            x["i"].alias("start"), F.xxhash64(x["s"]["h"]).alias("d1"),
            F.xxhash64(F.lit(k), F.reverse(x["s"]["h"])).alias("d2"), (x["i"] + k).alias("end")))

    none = F.slice(runs_of(1), 1, 0)
    parts = [F.when(F.size("l") >= k, runs_of(k)).otherwise(none) for k in range(1, size)]
    return lines.where("l IS NOT NULL").select("_doc", "_text", F.explode(F.concat(*parts)).alias("r")).select("_doc", "_text", "r.*")


def repeated_runs(docs: DataFrame, size: int = WINDOW, long_words: int | None = None) -> DataFrame:
    """(_doc, _text, runs): per document with repeats, its later repeated runs [a, b) of line numbers, in order."""
    rows = written(fingerprint_rows(docs, size), "line-fp")
    # Written, so that both sides of the joins below are plain shuffles: AQE can then split a line or a window
    # that stands in a large part of all documents.
    shared = written(rows.groupBy("fp").count().where("count > 1").select("fp"), "line-shared")
    near = rows.join(shared, "fp").select("_doc", "_text", F.explode("windows").alias("w")).select(
        "_doc", "_text", "w.start", "w.d1", "w.d2")
    first = written(near.groupBy("d1", "d2").agg(F.min(F.struct("_doc", "_text", "start")).alias("first"),
                                                 F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "line-first")
    # a row that is repeated in the table is the same document, not an earlier one
    later = (near.join(first, ["d1", "d2"]).where(~F.struct("_doc", "_text", "start").eqNullSafe(F.col("first")))
             .select("_doc", "_text", "start").distinct())
    later = later.withColumn("end", F.col("start") + size)
    if long_words is not None and size > 1:
        spans = written(long_spans(docs, size, long_words), "line-spans")
        begun = written(spans.groupBy("d1", "d2").agg(F.min(F.struct("_doc", "_text", "start")).alias("first"),
                                                      F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "line-first")
        later = later.unionByName(spans.join(begun, ["d1", "d2"])
                                  .where(~F.struct("_doc", "_text", "start").eqNullSafe(F.col("first")))
                                  .select("_doc", "_text", "start", "end").distinct())
    order = Window.partitionBy("_doc", "_text").orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = (later.withColumn("gap", F.coalesce(F.col("start") > reached, F.lit(True)).cast("int"))
            .withColumn("run", F.sum("gap").over(order.rowsBetween(Window.unboundedPreceding, 0)))
            .groupBy("_doc", "_text", "run").agg(F.min("start").alias("a"), F.max("end").alias("b")))
    return runs.groupBy("_doc", "_text").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("runs"))


def with_runs(docs: DataFrame, size: int = WINDOW, long_words: int | None = None) -> DataFrame:
    """``docs`` with its runs in the column RUNS (empty where nothing repeats). The small side is joined by doc_id and text hash."""
    runs = repeated_runs(docs, size, long_words)
    same = (docs["doc_id"].cast("long").eqNullSafe(runs["_doc"])
            & (F.xxhash64(docs["text"].cast("string")) == runs["_text"]))
    return docs.join(runs, same, "left").select(
        *[docs[f"`{c}`"] for c in docs.columns],
        F.coalesce(runs["runs"], F.array().cast("array<struct<a:int,b:int>>")).alias(RUNS))


def _kept_lines(lines, runs):
    """The lines outside the runs: one slice between every two runs."""
    begin = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["b"]))
    end = F.concat(F.transform(runs, lambda r: r["a"]), F.array(F.size(lines)))
    return F.flatten(F.zip_with(begin, end, lambda b, e: F.slice(lines, b + 1, e - b)))


def drop_repeated_lines(docs: DataFrame, size: int = WINDOW, long_words: int | None = None) -> DataFrame:
    """``docs`` with the later repeated runs of ``size`` or more lines cut out of ``text``; all rows and columns stay.
    With ``long_words`` shorter runs of more than that many words go too.

    Null texts stay null and empty ones empty; a text all of whose lines repeat
    becomes empty. Order is doc_id (null first), then text hash, so rows that
    are equal in doc_id and text count as one document and get equal results."""
    body = F.col("text").cast("string")
    out = with_runs(docs, size, long_words)
    kept = F.when(F.size(RUNS) == 0, body).otherwise(F.array_join(_kept_lines(F.split(body, "\n"), F.col(RUNS)), "\n"))
    return out.select(*[(kept.alias(c) if c == "text" else F.col(f"`{c}`")) for c in docs.columns])


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Lines, deleted lines, runs and the digest of the remaining text of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    lines = F.split("text", "\n")
    kept = F.array_join(_kept_lines(lines, F.col(RUNS)), "\n")
    return with_runs(docs, long_words=LONG_WORDS).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.aggregate(RUNS, F.lit(0).cast("long"), lambda s, r: s + r["b"] - r["a"]).alias("n_removed"),
        F.size(RUNS).cast("long").alias("n_runs"),
        F.sha2(F.coalesce(kept, F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP3_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM documents WHERE text IS NOT NULL),
windows AS (
  SELECT doc_id, pos, line, lead(line, 1) OVER d AS l2, lead(line, 2) OVER d AS l3, n, lead(n, 1) OVER d AS n2
  FROM (SELECT *, len(regexp_extract_all(line, '{WORD}')) AS n FROM lines)
  WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
repeats AS (
  SELECT doc_id, pos, 3 AS size, row_number() OVER (PARTITION BY line, l2, l3 ORDER BY doc_id, pos) AS nth
  FROM windows WHERE l3 IS NOT NULL
  UNION ALL
  SELECT doc_id, pos, 2, row_number() OVER (PARTITION BY line, l2 ORDER BY doc_id, pos)
  FROM windows WHERE l2 IS NOT NULL AND n + n2 > {LONG_WORDS}
  UNION ALL
  SELECT doc_id, pos, 1, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos)
  FROM windows WHERE n > {LONG_WORDS}),
gone AS (
  SELECT DISTINCT doc_id, pos + o AS pos FROM repeats, (VALUES (0), (1), (2)) AS t(o) WHERE nth > 1 AND o < size),
marked AS (
  SELECT l.doc_id, l.pos, l.line, g.pos IS NOT NULL AS cut,
         g.pos IS NOT NULL AND NOT coalesce(lag(g.pos IS NOT NULL) OVER (PARTITION BY l.doc_id ORDER BY l.pos), false) AS head
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos)
SELECT d.doc_id, count(m.pos) AS n_lines, count(*) FILTER (WHERE m.cut) AS n_removed,
       count(*) FILTER (WHERE m.head) AS n_runs,
       sha256(coalesce(string_agg(m.line, chr(10) ORDER BY m.pos) FILTER (WHERE NOT m.cut), '')) AS kept_sha256
FROM documents d LEFT JOIN marked m ON d.doc_id = m.doc_id
GROUP BY d.doc_id
"""
