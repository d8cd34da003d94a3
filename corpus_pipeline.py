"""The training-data pipeline: five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs. All but the last return the
columns of documents. A stage that runs Python sets the session's bound on the
bytes of an Arrow batch, for its result too: that is computed when it is written.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerops.llm.bpe import encode_documents
from ledgerops.llm.common import read_table, written
from ledgerops.llm.decontamination import remove_contaminated
from ledgerops.llm.lines import LONG_WORDS, drop_repeated_lines
from ledgerops.llm.simhash import keep_one_per_component
from ledgerops.llm.toxicity import keep_accepted
from ledgerops.session import small_arrow_batches

TOKENIZER = "byte_bpe_50k.json"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of being toxic is over one half go."""
    small_arrow_batches(spark)
    return keep_accepted(docs, read_table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of three or more lines, or of more than LONG_WORDS words, are cut out of the texts; every
    row stays. Null texts stay null, texts all of whose lines repeat become empty."""
    kept = drop_repeated_lines(docs, long_words=LONG_WORDS)
    if "n_chars" in kept.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast("long"))
    return kept


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays: the one with the smallest doc_id (null last). Rows are told
    apart by doc_id and text, so another text under the same doc_id stays."""
    small_arrow_batches(spark)
    return keep_one_per_component(docs, shingle=3, max_bits=2)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of ten benchmark words go."""
    small_arrow_batches(spark)
    return remove_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256) of every row that is left: the ids, and the digest of the text that they
    decode to. Null texts are empty."""
    small_arrow_batches(spark)
    encoded = encode_documents(docs, public_tokenizers.path(TOKENIZER), decoded=True)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded_sha256")


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("decontamination", decontamination),
    ("bpe_encoding", bpe_encoding),
]

# Toxicity, SimHash and BPE can't be expressed in SQL; tests/llm compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
