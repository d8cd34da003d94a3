"""Secret scans weighed by corpus-wide ownership (DataFrame functions only).

One pass over the texts finds candidates: assignments of a password or key, access
keys, long hexadecimal runs (the base kinds), and bare opaque runs of characters.
Their values are hashed and the hashes counted over the whole corpus by distinct
repositories and owners. A value that many owners hold is a copied example; one
that looks like a live credential and stands with a single owner is reported as
his own, and bare runs of that sort are spans of the kind ``bare``. Base spans stay
whatever their verdict.

The repository of a document is its ``source``, its owner the part before the
first ``/``. Places are found by splitting a text at the matches and adding up the
lengths; only positions and hashes go into the later, small shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import read_table, written

# The patterns below are fixed: results must follow them letter by letter.
KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
BEFORE_VALUE = ("(" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in KEYWORDS)
                + ")[\"']?\\x20*[:=]\\x20*[\"']?")
PATTERNS = {
    "assign": BEFORE_VALUE + "([A-Za-z0-9+/_.=-]+)",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]{24,}",
    "bare": "[A-Za-z0-9+/_-]{20,}={0,2}",
}
KINDS = list(PATTERNS)
BASE = KINDS[:3]
ASSIGN_CHARS, ACCESS_CHARS = 6, 20
# A live-looking value: so many characters, letters and digits, and so many different ones.
LIVE_CHARS, LIVE_DISTINCT = 16, 10
EXAMPLE_OWNERS = 3  # a value that so many owners hold is an example
BLOCK = 512
SPANS = "array<struct<start:int,end:int,m:string>>"
PLACES = "array<struct<start:int,k:int,end:int>>"


def _of_kind(k: Column, kind: str) -> Column:
    return k == KINDS.index(kind)


def _kept(k: Column, match: Column, value: Column) -> Column:
    """Whether a match counts; bare runs must look like a live value to be candidates at all."""
    return (F.when(_of_kind(k, "assign"), F.length(value) >= ASSIGN_CHARS)
            .when(_of_kind(k, "access"), F.length(match) >= ACCESS_CHARS)
            .when(_of_kind(k, "bare"), live_looking(value)).otherwise(F.lit(True)))


def live_looking(value: Column) -> Column:
    return ((F.length(value) >= LIVE_CHARS) & value.rlike("[0-9]") & value.rlike("[A-Za-z]")
            & (F.size(F.array_distinct(F.split(value, ""))) >= LIVE_DISTINCT))


def _spans(gaps: Column, matches: Column) -> Column:
    """[(start, end, m)] of the matches, in code points, from the texts between them. Places add up block by block,
    so long lists take linear time."""
    lengths = F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda gap, m: F.struct(
        F.length(gap).alias("gap"), m.alias("m")))
    none = F.array().cast(SPANS)

    def after(spans: Column, otherwise: Column) -> Column:
        return F.coalesce(F.try_element_at(spans, F.lit(-1))["end"], otherwise)

    def block_spans(block: Column, offset: Column) -> Column:
        return F.aggregate(block, none, lambda s, x: F.concat(s, F.array(F.struct(
            (after(s, offset) + x["gap"]).alias("start"), (after(s, offset) + x["gap"] + F.length(x["m"])).alias("end"),
            x["m"].alias("m")))))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / BLOCK).cast("int")),
                         lambda b: F.slice(lengths, b * BLOCK + 1, BLOCK))
    return F.flatten(F.aggregate(blocks, F.array().cast(f"array<{SPANS}>"), lambda s, b: F.concat(s, F.array(
        block_spans(b, after(F.coalesce(F.try_element_at(s, F.lit(-1)), none), F.lit(0)))))))


def _candidates(lists: Column) -> Column:
    """[(start, k, end, key, live)] of lists of (k, m, gaps); ``k`` is the kind's place in KINDS."""

    def of_list(x: Column) -> Column:
        valued = F.transform(_spans(x["gaps"], x["m"]), lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), s["m"].alias("m"),
            F.when(_of_kind(x["k"], "assign"), F.regexp_replace(s["m"], "^" + BEFORE_VALUE, "")).otherwise(s["m"]).alias("value")))
        return F.transform(F.filter(valued, lambda s: _kept(x["k"], s["m"], s["value"])), lambda s: F.struct(
            s["start"].alias("start"), x["k"].alias("k"), s["end"].alias("end"),
            F.unhex(F.sha2(s["value"].cast("binary"), 256)).alias("key"), live_looking(s["value"]).alias("live")))

    return F.array_sort(F.flatten(F.transform(F.filter(lists, lambda x: F.size(x["m"]) > 0), of_list)))


def find_candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, _row, _repository, _owner, found): the candidates of every row of ``docs`` in order of start, then
    kind, written once."""
    source = F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_body"),
                       source.alias("_repository"), F.substring_index(source, "/", 1).alias("_owner"),
                       F.monotonically_increasing_id().alias("_row"))
    none, body = F.array().cast("array<string>"), F.col("_body")
    # a text without the letters that a match must hold needs no search
    may = {"assign": body.contains("=") | body.contains(":"), "access": body.contains("AKIA")}
    matched = rows.select("*", *[F.when(may.get(k, F.lit(True)), F.regexp_extract_all("_body", F.lit(PATTERNS[k]), F.lit(0)))
                                 .otherwise(none).alias(f"_{k}") for k in KINDS])
    lists = F.array(*[F.struct(F.lit(i).alias("k"), F.col(f"_{k}").alias("m"),
                               F.when(F.size(f"_{k}") > 0, F.split("_body", PATTERNS[k])).otherwise(none).alias("gaps"))
                      for i, k in enumerate(KINDS)])
    return written(matched.select("doc_id", "_row", "_repository", "_owner", _candidates(lists).alias("found")), "secret-candidates")


def candidate_places(rows: DataFrame) -> DataFrame:
    """A row per candidate of ``find_candidates``; bare runs that touch a base span of their text are left out."""
    places = rows.where("size(found) > 0").select(
        "_row", "_repository", "_owner", F.explode("found").alias("c")).select("_row", "_repository", "_owner", "c.*")
    before = Window.partitionBy("_row").orderBy("start", "k").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy("_row").orderBy(F.desc("start"), F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)
    is_base = F.col("k") < len(BASE)
    # sorted by start, a run touches a base span if one before reaches into it or the next one begins inside
    reached = F.max(F.when(is_base, F.col("end"))).over(before)
    following = F.last(F.when(is_base, F.col("start")), ignorenulls=True).over(behind)
    free = ~(F.coalesce(reached > F.col("start"), F.lit(False)) | F.coalesce(following < F.col("end"), F.lit(False)))
    return places.withColumn("_free", free).where(is_base | F.col("_free")).drop("_free")


def ownership(places: DataFrame, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """(key, n_places, n_repositories, n_owners, verdict) of every candidate value.

    verdict: ``example`` with ``example_owners`` owners or more, ``live`` for a
    live-looking value of one owner, else ``shared``. Every step combines map-side,
    so a value that a large part of all documents holds is a few rows per task."""
    per_repository = places.groupBy("key", "_owner", "_repository").agg(F.count(F.lit(1)).alias("n"), F.max("live").alias("live"))
    per_owner = per_repository.groupBy("key", "_owner").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("r"), F.max("live").alias("live"))
    counted = per_owner.groupBy("key").agg(F.sum("n").alias("n_places"), F.sum("r").alias("n_repositories"),
                                           F.count(F.lit(1)).alias("n_owners"), F.max("live").alias("live"))
    verdict = (F.when(F.col("n_owners") >= example_owners, "example")
               .when(F.col("live") & (F.col("n_owners") == 1), "live").otherwise("shared"))
    return counted.select("key", "n_places", "n_repositories", "n_owners", verdict.alias("verdict"))


def scan_secrets(docs: DataFrame, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """(doc_id, spans, n_live, n_example) of every row of ``docs``.

    spans: (start, k, end) in order of start, then kind, with every base span and the
    bare runs whose verdict is ``live``; ``k`` is the place of the kind in KINDS, places
    are code points. n_live and n_example count the spans of those verdicts, bare runs
    that are examples included. A null text is empty and has no spans; texts of any
    length are read whole; a null ``source`` (or none) is one repository and owner of
    its own. Rows are told apart by a number of their own, so repeated rows and rows
    of one doc_id (null too) each get their result, and repeated rows count as places
    of one repository. Other columns are ignored; an empty table gives no rows."""
    rows = find_candidates(docs)
    # written, so that both sides of the join are plain shuffles and AQE can split a value that stands in many documents
    places = written(candidate_places(rows), "secret-places")
    weighed = written(ownership(places, example_owners).select(F.col("key").alias("_key"), "verdict"), "secret-owners")
    judged = places.join(weighed, F.col("key") == F.col("_key"))
    is_bare = _of_kind(F.col("k"), "bare")
    found = judged.groupBy(F.col("_row").alias("_r")).agg(
        F.collect_list(F.when(is_bare & (F.col("verdict") == "live"), F.struct("start", "k", "end"))).alias("added"),
        F.count_if(F.col("verdict") == "live").alias("n_live"), F.count_if(F.col("verdict") == "example").alias("n_example"))
    base = F.transform(F.filter("found", lambda x: x["k"] < len(BASE)), lambda x: F.struct(
        x["start"].alias("start"), x["k"].alias("k"), x["end"].alias("end")))
    return rows.select("doc_id", "_row", base.alias("_base")).join(found, F.col("_row") == F.col("_r"), "left").select(
        "doc_id", F.array_sort(F.concat("_base", F.coalesce("added", F.array().cast(PLACES)))).alias("spans"),
        F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"),
        F.coalesce("n_example", F.lit(0)).cast("long").alias("n_example"))


def _listed(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["start"], x["end"])), ",")


def op12_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Base spans by kind, their digest, all spans, and how many are live-looking or examples, of every document."""
    found = scan_secrets(read_table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["k"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda x: x["k"] < len(BASE))
    return found.select("doc_id", count("assign"), count("access"), count("hex"),
                        F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"),
                        count("bare"), "n_live", "n_example")


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _sql_matches(kind: str) -> str:
    pattern = _sql_text(PATTERNS[kind])
    value = f"regexp_replace(m, {_sql_text('^' + BEFORE_VALUE)}, '')" if kind == "assign" else "m"
    return f"""
  SELECT doc_id, '{kind}' AS kind, {KINDS.index(kind)} AS k, i, m, {value} AS value, repository, owner,
         sum(length(gap) + coalesce(length(m), 0)) OVER (PARTITION BY doc_id ORDER BY i) AS e
  FROM (SELECT doc_id, repository, owner, unnest(regexp_extract_all(body, {pattern})) AS m,
               unnest(string_split_regex(body, {pattern})) AS gap,
               unnest(range(len(string_split_regex(body, {pattern})))) AS i FROM texts)"""


OP12_SQL = f"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS body, coalesce(source, '') AS repository,
         split_part(coalesce(source, ''), '/', 1) AS owner FROM documents),
matches AS ({" UNION ALL ".join(_sql_matches(k) for k in KINDS)}),
candidates AS (
  SELECT *, e - length(m) AS s FROM (
    SELECT *, length(value) >= {LIVE_CHARS} AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
              AND len(list_distinct(string_split(value, ''))) >= {LIVE_DISTINCT} AS live FROM matches WHERE m IS NOT NULL)
  WHERE kind = 'hex' OR kind = 'assign' AND length(value) >= {ASSIGN_CHARS} OR kind = 'access' AND length(m) >= {ACCESS_CHARS}
     OR kind = 'bare' AND live),
places AS (
  SELECT * FROM candidates c WHERE kind <> 'bare' OR NOT EXISTS (
    SELECT 1 FROM candidates b WHERE b.doc_id = c.doc_id AND b.kind <> 'bare' AND b.s < c.e AND c.s < b.e)),
owners AS (
  SELECT value, count(DISTINCT owner) AS n, bool_or(live) AS live FROM places GROUP BY value),
judged AS (
  SELECT p.*, CASE WHEN n >= {EXAMPLE_OWNERS} THEN 'example' WHEN o.live AND n = 1 THEN 'live' ELSE 'shared' END AS verdict,
         kind || ':' || s || ':' || e AS shown
  FROM places p JOIN owners o ON p.value = o.value)
SELECT t.doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
       count(*) FILTER (WHERE kind = 'hex') AS n_hex,
       sha256(coalesce(string_agg(shown, ',' ORDER BY s, k) FILTER (WHERE kind <> 'bare'), '')) AS base_sha256,
       coalesce(string_agg(shown, ',' ORDER BY s, k) FILTER (WHERE kind <> 'bare' OR verdict = 'live'), '') AS spans,
       count(*) FILTER (WHERE kind = 'bare' AND verdict = 'live') AS n_bare,
       count(*) FILTER (WHERE verdict = 'live') AS n_live, count(*) FILTER (WHERE verdict = 'example') AS n_example
FROM texts t LEFT JOIN judged j ON t.doc_id = j.doc_id
GROUP BY t.doc_id
"""
