"""License scan by canonical digests (DataFrame functions only).

A text is brought to a canonical form: copyright lines go, letters A-Z become
lower case, every run of punctuation and blanks becomes one space, and
equivalent spellings become one. The digests of the whole canonical text and of
each of its lines are hash-joined to the digests of known license texts and
notices, brought to the same form. Only entire texts match: a line that merely
mentions a license does not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# A line that states a copyright and nothing else of the license.
COPYRIGHT_LINE = r"(^|\n)[ \t]*(copyright|\(c\)|©)[^\n]*"
PUNCTUATION = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"
# Equivalent spellings (a subset of the SPDX matching guidelines' list), canonical form second.
SPELLINGS = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"),
    ("favour", "favor"), ("organisation", "organization"), ("organisations", "organizations"), ("whilst", "while"),
    ("wilful", "willful"), ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"),
    ("per cent", "percent"), ("sub license", "sublicense"), ("non commercial", "noncommercial"),
    ("acknowledgement", "acknowledgment"), ("https", "http"),
]

# Known license texts and notices by SPDX identifier.
_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
_ISC_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER
IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE
OF THIS SOFTWARE."""
KNOWN_LICENSES = [
    ("MIT", "MIT License\n\n" + _MIT_GRANT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT_GRANT),
    ("MIT", _MIT_GRANT),
    ("ISC", "ISC License\n\n" + _ISC_GRANT + "\n\n" + _ISC_DISCLAIMER),
    ("ISC", _ISC_GRANT + "\n\n" + _ISC_DISCLAIMER),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted.\n\n""" + _ISC_DISCLAIMER),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]


def canonical_lines(text: Column) -> Column:
    """The canonical lines of a text, empty ones left out (null stays null)."""
    body = F.translate(text, UPPER, LOWER)
    body = F.regexp_replace(body, COPYRIGHT_LINE, "$1")
    body = F.regexp_replace(body, PUNCTUATION, " ")
    lines = F.transform(F.split(body, "\n"), lambda x: F.concat(F.lit(" "), F.trim(x), F.lit(" ")))

    def spelled(line: Column) -> Column:
        for variant, canonical in SPELLINGS:
            line = F.replace(line, F.lit(f" {variant} "), F.lit(f" {canonical} "))
        return F.trim(line)

    return F.filter(F.transform(lines, spelled), lambda x: x != "")


def _digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def known_digests(licenses: DataFrame) -> DataFrame:
    """(digest, license) of licenses(license_id, text); a text known under two ids counts for the smaller one.
    Rows with a null id or without words are left out."""
    known = licenses.where("license_id is not null and text is not null").select(
        "license_id", F.array_join(canonical_lines(F.col("text")), " ").alias("c")).where("c <> ''")
    return known.groupBy(_digest(F.col("c")).alias("digest")).agg(F.min("license_id").alias("license"))


def known_licenses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KNOWN_LICENSES, "license_id string, text string")


def scan_licenses(docs: DataFrame, licenses: DataFrame) -> DataFrame:
    """(doc_id, text_digest, whole_license, n_notices, licenses) of every row of ``docs``.

    whole_license: the license whose entire text the document is; n_notices: its
    lines that are entire known texts; licenses: the distinct ids of both, in
    order. A null text counts as empty and matches nothing; rows equal in doc_id
    and text get equal results."""
    text = F.col("text").cast("string")
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("_text"),
                       F.coalesce(canonical_lines(text), F.array().cast("array<string>")).alias("lines"))
    rows = written(read.select("doc_id", "_text", _digest(F.array_join("lines", " ")).alias("text_digest"),
                               F.transform("lines", _digest).alias("lines")), "license-digests")
    known = known_digests(licenses)
    places = rows.select("doc_id", "_text", F.posexplode("lines").alias("line", "digest")).unionByName(
        rows.select("doc_id", "_text", F.lit(-1).alias("line"), F.col("text_digest").alias("digest")))
    found = places.join(known, "digest").groupBy(F.col("doc_id").alias("_doc"), F.col("_text").alias("_hash")).agg(
        F.max(F.expr("if(line = -1, license, null)")).alias("whole_license"),
        F.size(F.collect_set(F.expr("if(line >= 0, line, null)"))).cast("long").alias("n_notices"),
        F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"))
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & F.col("_text").eqNullSafe(F.col("_hash"))
    return rows.join(found, same, "left").select(
        "doc_id", "text_digest", "whole_license", F.coalesce("n_notices", F.lit(0).cast("long")).alias("n_notices"),
        F.coalesce("licenses", F.lit("")).alias("licenses"))


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    """License texts and notices of every document, by digest."""
    return scan_licenses(read_table(spark, sf_dir, "documents"), known_licenses(spark))


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _sql_lines(text: str) -> str:
    body = f"translate({text}, '{UPPER}', '{LOWER}')"
    body = f"regexp_replace({body}, {_sql_text(COPYRIGHT_LINE)}, '\\1', 'g')"
    body = f"regexp_replace({body}, {_sql_text(PUNCTUATION)}, ' ', 'g')"
    line = "' ' || trim(x) || ' '"
    for variant, canonical in SPELLINGS:
        line = f"replace({line}, ' {variant} ', ' {canonical} ')"
    return (f"list_filter(list_transform(string_split({body}, chr(10)), lambda x: trim({line})), "
            f"lambda x: x <> '')")


OP4_SQL = f"""
WITH known AS (
  SELECT sha256(c) AS digest, min(license_id) AS license FROM (
    SELECT license_id, array_to_string({_sql_lines("text")}, ' ') AS c
    FROM (VALUES {", ".join(f"({_sql_text(i)}, {_sql_text(t)})" for i, t in KNOWN_LICENSES)}) AS k(license_id, text))
  WHERE c <> '' GROUP BY 1),
rows AS (
  SELECT doc_id, coalesce({_sql_lines("text")}, []) AS lines FROM documents),
places AS (
  SELECT doc_id, 0 AS line, sha256(array_to_string(lines, ' ')) AS digest FROM rows
  UNION ALL
  SELECT doc_id, unnest(range(1, len(lines) + 1)) AS line, sha256(unnest(lines)) AS digest FROM rows),
found AS (
  SELECT doc_id, max(license) FILTER (WHERE line = 0) AS whole_license, count(*) FILTER (WHERE line > 0) AS n_notices,
         string_agg(DISTINCT license, ',' ORDER BY license) AS licenses
  FROM places JOIN known USING (digest) GROUP BY doc_id)
SELECT r.doc_id, sha256(array_to_string(r.lines, ' ')) AS text_digest, f.whole_license,
       coalesce(f.n_notices, 0) AS n_notices, coalesce(f.licenses, '') AS licenses
FROM rows r LEFT JOIN found f ON r.doc_id = f.doc_id
"""
