"""The registered corpus queries on the smallest tables, and the pipeline against its stages done by hand."""

import re

import duckdb
import pytest

import corpus_pipeline
from loadloom.llm import decontaminate, substring, toxicity
from loadloom.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def test_one_query_per_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"op13_hard_negatives"}))
def test_query_covers_its_table(spark, name):
    table = "embeddings" if name.startswith(("op4", "op11")) else "documents"
    df, n = QUERIES[name](spark, SF), spark.read.parquet(f"{SF}/{table}.parquet").count()
    assert df.count() >= n and (name.startswith("op8") or df.count() == n)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    want = con.sql(ORACLE[name]).df()
    assert len(got) and sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    assert sorted(map(tuple, got[cols].values.tolist())) == sorted(map(tuple, want[cols].values.tolist()))


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def grams(text, k=5):
    w = words(text)
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} or {tuple(w)}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_pipeline_applies_every_stage(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "substring_dedup", "benchmark_decontamination", "best_fit_packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    left = {r.doc_id for r in toxicity.score(docs, model).where("predicted = 0").collect()}
    now = docs.where(docs.doc_id.isin(sorted(left)))
    rows = {r.doc_id: grams(r.text) for r in now.collect()}
    near = {i: {j for j in rows if jaccard(rows[i], rows[j]) >= 0.8} for i in rows}
    label = {i: i for i in rows}
    while (new := {i: min(label[j] for j in near[i]) for i in rows}) != label:
        label = new
    now = now.where(now.doc_id.isin(sorted(set(label.values()))))
    now = substring.without_repeats(now)
    hit = decontaminate.contaminated_words(now, spark.read.parquet(f"{SF}/benchmark.parquet"))
    want = {r.doc_id for r in hit.where("NOT contaminated").collect()}
    got = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in got.select("doc_id").distinct().collect()} == want
    assert got.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0
