"""Registered queries: SQL, columns, and the pipeline's stages."""

import corpus_pipeline
import oracle
import pytest
from pyspark.sql import functions as F

from docharbor.llm import decontam, simhash
from docharbor.llm.queries import ORACLE_SQL, QUERIES

COLUMNS = {
    "op2_token_counts": "doc_id n_bytes n_tokens over_limit",
    "op3_simhash": "doc_id fingerprint component_id",
    "op4_ann": "query_id rank vec_id score",
    "op5_lm_score": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op8_langid": "doc_id held_out lang_pred score",
    "op9_quality_crf": "doc_id held_out score predicted",
    "op10_warc": "page_id payload_bytes payload_digest record_type refers_to",
}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, small, name):
    assert oracle.compare(QUERIES[name](spark, small), ORACLE_SQL[name], oracle.connection(small)) == ""


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, small, name):
    assert set(COLUMNS[name].split()) <= set(QUERIES[name](spark, small).columns)


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def test_pipeline(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    extra = spark.createDataFrame([(9000, None, "en", "s", 0), (9001, "12 34", "en", "s", 5), (9002, "", None, None, None)], docs.schema)
    docs = docs.unionByName(extra).withColumn("score", F.lit("clash")).withColumn("lang_pred", F.lit("clash"))
    n, at = docs.count(), docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, small)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == at.columns, name
        out = spark.createDataFrame(out.collect(), out.schema)
        if name == "language":
            assert {9000, 9001, 9002}.isdisjoint(r.doc_id for r in out.collect()) and out.count() == n - 3 and out.first().score == "clash"
        if name == "lines":
            assert out.count() == at.count() and out.agg(F.sum("n_chars")).first()[0] < at.agg(F.sum("n_chars")).first()[0]
        if name == "near_duplicates":
            sets = {r.doc_id: set(simhash.shingle_hashes((r.text or "").encode(), 5).tolist()) for r in at.collect()}
            left = {r.doc_id for r in out.collect()}
            twin = lambda a, b: a == b or bool(a | b) and len(a & b) / len(a | b) >= 0.8
            assert not [(a, b) for a in left for b in left if a < b and twin(sets[a], sets[b])]
            assert all(any(twin(sets[i], sets[j]) for j in sets if j != i) for i in set(sets) - left)
        if name == "benchmark_leaks":
            items = [decontam.words_of(r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
            clean = lambda t: not any(decontam.smith_waterman(decontam.words_of(t), w) / len(w) >= 0.5 for w in items)
            left = {r.doc_id for r in out.collect()}
            texts = {r.doc_id: r.text for r in at.collect()}
            assert all(not clean(texts[i]) for i in set(texts) - left) and all(clean(texts[i]) for i in sorted(left)[:25])
        at = out
    assert at.columns == ["doc_id", "source", "lang", "ids", "n_pieces", "round_trip"] and at.where("not round_trip").count() == 0
