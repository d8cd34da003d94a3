"""The pipeline's stages against brute force on their own input, and the registered queries."""

import hashlib
import sys

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline as P
from conftest import SF_SMALL
from ledgerops.llm.catalog import LLM_ORACLE, LLM_QUERIES
from ledgerops.llm.common import read_table, written
from test_decontamination import brute as brute_hits
from test_lines import brute as brute_lines
from test_simhash import brute_components, brute_fingerprint

SF = "/root/testdata/sf0.01"


def test_every_query_is_registered():
    names = set(entry.queries())
    assert set(LLM_QUERIES) <= names and "pipeline" in names
    assert {int(n[2:].split("_")[0]) for n in LLM_QUERIES} == set(range(1, 14))
    assert set(LLM_ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(LLM_ORACLE))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF_SMALL}/{table}.parquet')")
    res = con.execute(LLM_ORACLE[name])
    columns = [d[0] for d in res.description]
    got = LLM_QUERIES[name](spark, SF_SMALL)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(repr, res.fetchall()))


def test_stages_one_after_the_other(spark):
    docs = read_table(spark, SF, "documents")
    labels = {r["doc_id"]: r["toxic"] for r in read_table(spark, SF, "labels").collect()}
    items = [(r["item_id"], r["text"]) for r in read_table(spark, SF, "benchmark").collect()]
    for name, stage in P.STAGES:
        before = sorted(docs.collect(), key=lambda r: r["doc_id"])
        after_df = written(stage(spark, docs, SF), f"test-{name}")
        after = {r["doc_id"]: r for r in after_df.collect()}
        assert name == "bpe_encoding" or after_df.columns == docs.columns
        if name == "toxicity":
            gone = [r["doc_id"] for r in before if r["doc_id"] not in after]
            labelled = [labels[i] for i in gone if i in labels]
            assert labelled and sum(labelled) / len(labelled) > 0.95
            toxic = [r["doc_id"] for r in before if labels.get(r["doc_id"]) == 1]
            assert sum(i not in after for i in toxic) / len(toxic) > 0.7
        elif name == "line_dedup":
            assert [after[r["doc_id"]]["text"] for r in before] == brute_lines([r["text"] for r in before], 3, 50)
            assert all(r["n_chars"] == len(r["text"]) for r in after.values())
        elif name == "simhash_near_dedup":
            ids = [r["doc_id"] for r in before]
            assert set(after) == set(brute_components(ids, [brute_fingerprint(r["text"]) for r in before], 2))
        elif name == "decontamination":
            hits = brute_hits([r["text"] for r in before], items)
            assert set(after) == {r["doc_id"] for r, (_, hit, _) in zip(before, hits) if not hit}
        else:
            library = Tokenizer.from_file(public_tokenizers.path(P.TOKENIZER))
            for r in before:
                ids = library.encode(r["text"], add_special_tokens=False).ids
                assert after[r["doc_id"]]["ids"] == ids and after[r["doc_id"]]["n_tokens"] == len(ids)
                text = library.decode(ids, skip_special_tokens=False)
                assert after[r["doc_id"]]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        docs = after_df


def test_run_applies_all_stages(spark):
    out = P.run(spark, SF_SMALL)
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"] and 0 < out.count() < 200
    assert out.agg({"n_tokens": "sum"}).first()[0] > 0


def test_nothing_else_imports_this_part():
    import pathlib
    import re

    root = pathlib.Path(P.__file__).parent
    for f in root.glob("ledgerops/**/*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert not re.search(r"\bllm\b", f.read_text()), f
    assert "ledgerops.llm" in sys.modules
