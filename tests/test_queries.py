import pytest

from tallyforge.plans.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(name, same):
    same(QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("name", ["reconciliation_summary", "competing_claims", "category_health", "catalog_health_overall"])
def test_means_and_ties_on_larger_tables(name, same):
    same(QUERIES[name], ORACLE_SQL[name], "/root/testdata/sf0.01")


def test_competing_claims_are_all_but_the_winner(spark):
    from tallyforge.operators.reconcile import competing_claims

    rows = [(1, "power", 1, "10 W", 0.9), (1, "power", 2, "10 W", 0.8), (1, "power", 3, "99 W", 0.7), (2, "power", 1, "1 kW", 0.9), (2, "power", 2, "1000 W", 0.8), (3, "power", 1, "5 W", 0.9)]
    got = competing_claims(spark.createDataFrame(rows, "product_id long, attribute_name string, source_id long, raw_value string, trust double"))
    assert sorted((r["product_id"], r["source_id"], r["winning_value"]) for r in got.collect()) == [(1, 2, "10 W"), (1, 3, "10 W")]


def test_exact_mean_of_ties(spark):
    from pyspark.sql import functions as F

    from tallyforge.functions.values import exact_mean

    rows = [(1, 0.8366), (1, 0.8367), (2, 0.8367), (2, 0.8368), (3, None), (4, -0.0001), (4, 0.0), (5, 0.0001), (5, 0.0001), (5, 0.0003)]
    got = spark.createDataFrame(rows, "k int, x double").groupBy("k").agg(exact_mean(F.col("x"), 4).alias("m")).collect()
    assert {r["k"]: r["m"] for r in got} == {1: 0.8366, 2: 0.8368, 3: None, 4: 0.0, 5: 0.0002}


def test_bulk_embed_gives_unit_vectors(spark):
    got = QUERIES["bulk_embed"](spark, "/root/testdata/sf0.001").toPandas()
    assert (got["dims"] == 384).all() and (abs(got["norm2"] - 1) < 1e-5).all()


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0


def test_stream_dedupe_keeps_a_content_once_a_day(spark):
    got = QUERIES["stream_dedupe"](spark, "/root/testdata/sf0.001").toPandas()
    assert len(got) and got["content_hash"].nunique() == got["content"].nunique()
    assert (got.groupby("content").size() <= 31).all()


def test_a_text_is_hashed_once_for_all_salts(spark):
    import hashlib

    import numpy as np

    from tallyforge.sources.ingest import hash_vectors

    got = hash_vectors(spark.createDataFrame([(1, "héllo"), (2, ""), (3, None)], "id long, t string"), "id", "t", dims=40)
    assert "sha2" not in got._jdf.queryExecution().optimizedPlan().toString()
    v = np.frombuffer(b"".join(hashlib.sha256(f"héllo:{i}".encode()).digest() for i in range(3)), ">u2")[:40] / 65535 - 0.5
    rows = {r["id"]: r["vector"] for r in got.collect()}
    assert np.allclose(rows[1], v / np.linalg.norm(v)) and rows[2] == rows[3] == [0.0] * 40


@pytest.mark.parametrize("name", ["duplicates_of", "sources_for_product", "validate_catalog", "validation_issues"])
def test_more_rows_are_dealt_to_more_tasks(spark, same, monkeypatch, name):
    """What a task groups is bounded whatever the session's number of partitions."""
    from tallyforge import storage

    monkeypatch.setattr(storage, "ROWS_A_TASK", 500)
    n = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count() * (2 if name == "duplicates_of" else 1)
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert f", {-(-n // 500)}), REPARTITION_BY_NUM" in plan
    same(QUERIES[name], ORACLE_SQL[name])
