"""A maintained pre-aggregate: what is refreshed, what is read, and that it equals a full rebuild."""

import pytest
from pyspark.sql import functions as F

from loadloom.plans import rollup_queries
from loadloom.sources import maintained as M


def cells(df):
    return df.groupBy("user_id").agg(F.sum("v").alias("s"), F.count("*").alias("n"))


def test_only_changed_parts_are_aggregated(spark, tmp_path):
    source, root = str(tmp_path / "source"), str(tmp_path / "root")
    base = spark.range(1000).selectExpr("id % 7 AS user_id", "id * 0.5D AS v", "2020 + id % 3 AS year")
    base.write.partitionBy("year").parquet(source)
    built = []

    def build(part):
        built.append(part)
        return cells(spark.read.parquet(f"{source}/{part}"))

    def same():
        want = {tuple(r) for r in cells(spark.read.parquet(source)).collect()}
        return {tuple(r) for r in M.merged(M.state(spark, root), ["user_id"], ["s", "n"]).select("user_id", "s", "n").collect()} == want

    with pytest.raises(ValueError):
        M.state(spark, root)
    assert sorted(M.refresh(spark, root, M.source_parts(spark, source), build)) == ["year=2020", "year=2021", "year=2022"] and same()
    assert M.refresh(spark, root, M.source_parts(spark, source), build) == [] and len(built) == 3
    spark.range(50).selectExpr("id % 9 AS user_id", "1D AS v", "2023 AS year").write.mode("append").partitionBy("year").parquet(source)
    assert M.refresh(spark, root, M.source_parts(spark, source), build) == ["year=2023"] and same()
    spark.range(50).selectExpr("id % 9 AS user_id", "2D AS v", "2021 AS year").write.mode("append").partitionBy("year").parquet(source)
    assert M.refresh(spark, root, M.source_parts(spark, source), build) == ["year=2021"] and same()
    parts = M.source_parts(spark, source)
    del parts["year=2020"]
    assert M.refresh(spark, root, parts, build) == []
    assert M.state(spark, root).agg(F.sum("n")).first()[0] == 1100 - 334

    def fails(part):
        raise RuntimeError(part)

    with pytest.raises(RuntimeError):
        M.refresh(spark, root, {**parts, "year=2022": "other"}, fails)
    assert M.state(spark, root).agg(F.sum("n")).first()[0] == 1100 - 334


def test_query_does_not_scan_the_readings_again(spark):
    sf = "/root/testdata/sf0.001"
    first = rollup_queries.region_hour_preaggregated(spark, sf).collect()
    again = rollup_queries.region_hour_preaggregated(spark, sf)
    assert "lineitem" not in again._jdf.queryExecution().optimizedPlan().toString() and not any("lineitem" in f for f in again.inputFiles())
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, first))
