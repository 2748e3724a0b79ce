import datetime as dt

from pyspark.sql import functions as F

from tallyforge.operators import decisions as DC
from tallyforge.operators import reconcile as R
from tallyforge.streaming import streams as S

ISSUES = "validation_id long, product_id long, attribute_id long, status string, last_resolution string, expected_claim struct<raw_value: string, source_id: long>, actual_claims array<struct<raw_value: string, source_id: long>>, expected_value string, actual_value string"
DECISIONS = "validation_id long, product_id long, resolution string, resolved_value string, notes string, decided_at timestamp"


def at(minute):
    return dt.datetime(2024, 1, 1, 0, minute)


def decided(spark):
    issues = [
        (1, 7, 70, "open", None, ("11 kW", 3), [("7 kW", 4), ("8 kW", 5)], None, None), (2, 7, 71, "open", None, None, None, None, "A"), (3, 7, 72, "resolved", "custom", None, None, None, None),
        (4, 8, None, "open", None, None, [], "E", None), (5, 8, 80, "open", None, None, None, None, None), (6, 7, 70, "open", None, ("9 kW", 6), None, None, None),
    ]
    rows = [
        (1, 7, "accept_source_b", None, None, at(5)), (1, 7, "accept_source_a", None, None, at(9)), (1, 7, "accept_source_b", None, None, at(10)), (1, 7, "custom", " ", None, at(1)),
        (2, 7, "accept_source_a", "given", "n", at(1)), (3, 7, "custom", "x", None, at(1)), (3, 7, "accept_source_a", None, None, at(2)), (4, 8, "accept_source_b", None, None, at(1)), (4, 7, "custom", "x", None, at(0)),
        (5, 8, "accept_source_a", None, None, at(1)), (5, 8, None, "x", None, at(2)), (99, 8, "custom", "x", None, at(1)), (6, 7, "accept_source_a", None, None, at(7)),
    ]
    issues = spark.createDataFrame(issues, ISSUES)
    return issues, DC.resolve_issues(issues, spark.createDataFrame(rows, DECISIONS))


def test_what_becomes_of_decisions(spark):
    issues, out = decided(spark)
    got = {(r["validation_id"], r["decided_at"].minute): (r["outcome"], r["value"], r["source_id"]) for r in out.collect()}
    assert got == {
        (1, 5): ("resolved", "7 kW", 4), (1, 9): ("conflict", None, None), (1, 10): ("already_resolved", None, None), (1, 1): ("no_value", None, None), (2, 1): ("resolved", "A", None),
        (3, 1): ("already_resolved", None, None), (3, 2): ("conflict", None, None), (4, 1): ("resolved", "E", None), (4, 0): ("wrong_product", None, None), (5, 1): ("no_value", None, None),
        (5, 2): ("unsupported", None, None), (99, 1): ("wrong_product", None, None), (6, 7): ("resolved", "9 kW", 6),
    }
    after = {r["validation_id"]: (r["status"], r["last_resolution"]) for r in DC.decided_issues(issues, out).collect()}
    assert after[1] == ("resolved", "accept_source_b") and after[5] == ("open", None) and after[3] == ("resolved", "custom") and len(after) == 6
    assert DC.resolution_audit(out).count() == 4
    assert DC.resolve_issues(issues, spark.createDataFrame([], DECISIONS)).count() == 0


def test_decided_values_are_verified_and_scored(spark):
    _, out = decided(spark)
    attributes = spark.createDataFrame([(70, 7, "power", "11 kW", 0.9, "conflicting"), (71, 7, "voltage", "230 V", 0.9, "extracted"), (80, 8, "power", "1 V", 0.3, "extracted")], "attribute_id long, product_id long, attribute_name string, raw_value string, confidence double, status string")
    after = DC.decided_attributes(attributes, out)
    assert {r["attribute_id"]: (r["raw_value"], r["status"]) for r in after.collect()} == {70: ("9 kW", "verified"), 71: ("A", "verified"), 80: ("1 V", "extracted")}
    products = spark.createDataFrame([(7, "none such", 1.0, "needs_review"), (8, "none such", 1.0, "needs_review"), (9, "none such", 1.0, "draft")], "product_id long, category string, quality_score double, status string")
    got = {r["product_id"]: (r["quality_score"], r["status"]) for r in DC.rescore(products, after, after.select("attribute_id"), out).collect()}
    assert got[9] == (1.0, "draft") and got[7][0] > 1.0 and got[8][0] > 1.0 and got[8][1] == "needs_review"  # a power in volts is an error


def test_reconciled_stream_follows_claims_over_batches(spark, tmp_path):
    schema = "product_id long, attribute_name string, source_id long, raw_value string, trust double"
    first = [(1, "power", 1, "11 kW", 0.9), (2, "power", 1, "5 kW", 0.9), (3, "power", 1, "1 W", 0.5)]
    second = [(1, "power", 2, "11000 W", 0.8), (2, "power", 2, "6 kW", 0.7), (4, "power", 9, "2 W", 0.5)]
    for rows in (first, second):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        kept = S.ReconciledStream(spark, f"{tmp_path}/out", stream.schema)
        kept.start(stream, f"{tmp_path}/state").awaitTermination()
    got = kept.results.read()
    assert {r["product_id"]: r["status"] for r in got.collect()} == {1: "EQUIVALENT", 2: "CONFLICTING", 3: "MISSING", 4: "MISSING"}
    want = R.reconcile(spark.createDataFrame(first + second, schema))
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert got.where(F.col("batch") == 1).count() == 3  # only what the batch touched
