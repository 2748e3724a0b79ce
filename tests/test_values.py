import pytest
from pyspark.sql import functions as F

from tallyforge.functions import values as V
from tallyforge.operators import reconcile as R
from tallyforge.operators import validate as X


def one(spark, column, **cells):
    row = spark.range(1).select(*[F.lit(v).cast("string" if v is None or isinstance(v, str) else type(v).__name__.replace("float", "double")).alias(k) for k, v in cells.items()])
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "kind", "hint", "num", "boolean", "unit", "ok"),
    [
        ("230 V", "numeric", "V", 230, None, "V", True),
        ("5.5 kW", "numeric", "kW", 5.5, None, "kW", True),
        ("1440 RPM", "numeric", "RPM", 1440, None, "RPM", True),
        ("50Hz", "numeric", None, 50, None, "Hz", True),
        ("1,500", "numeric", None, 1.5, None, None, True),
        ("1 1/2 in", "numeric", None, 1.5, None, "in", True),
        ("yes", "boolean", None, None, True, None, True),
        ("0", "boolean", None, None, False, None, True),
        ("N/A - Not Applicable", "numeric", None, None, None, None, False),
    ],
)
def test_normalize_value(spark, raw, kind, hint, num, boolean, unit, ok):
    got = one(spark, V.normalize_value(F.col("raw"), F.col("kind"), F.col("hint")), raw=raw, kind=kind, hint=hint)
    assert (got["norm_num"], got["norm_bool"], got["unit"], got["success"]) == (num, boolean, unit, ok)


@pytest.mark.parametrize(("x", "want"), [(50.25, "50-1/4"), (0.5, "1/2"), (3.0, "3"), (2.999, "3"), (1.015625, "1-1/64")])
def test_fraction(spark, x, want):
    assert one(spark, V.decimal_to_fraction(F.col("x")), x=x) == want


@pytest.mark.parametrize(
    ("method", "verified", "normal", "conf", "trust", "conflicts", "want"),
    [("deterministic", True, True, 0.88, 1.0, 0, 98.0), ("llm", False, False, 0.3, 0.5, 1, 36.8), ("llm_inference", False, True, 0.9, 1.0, 5, 38.0)],
)
def test_confidence(spark, method, verified, normal, conf, trust, conflicts, want):
    lits = [F.lit(x) for x in (method, verified, normal, conf, trust, conflicts)]
    assert one(spark, V.confidence_score(*lits), a="") == want


def test_identifiers(spark):
    keys = [one(spark, V.normalize_identifier(F.col("x")), x=x) for x in ("MX-500", "mx 500", "MX500", "MX-500A", " - ")]
    assert keys == ["mx500", "mx500", "mx500", "mx500a", None]


def test_mojibake(spark):
    assert one(spark, V.repair_mojibake(F.col("x")), x="25 Â°C") == "25 °C"
    assert one(spark, V.repair_mojibake(F.col("x")), x="Ã") == "Ã"
    assert one(spark, V.repair_mojibake(F.col("x")), x=None) is None


def test_four_outcomes(spark):
    claims = spark.createDataFrame(
        [(1, 1, "power", "11 kW", 0.95), (1, 2, "power", "7.5 kW", 0.7), (1, 1, "frequency", "50 Hz", 0.95), (1, 3, "frequency", "50 Hz", 0.9), (1, 1, "voltage", "0.4 kV", 0.95), (1, 3, "voltage", "400 V", 0.9), (1, 1, "ip_rating", "IP55", 0.95)],
        "product_id long, source_id long, attribute_name string, raw_value string, trust double",
    )
    got = {r["attribute_name"]: (r["status"], r["confidence"]) for r in R.reconcile(claims).collect()}
    assert got == {"power": ("CONFLICTING", 0.7), "frequency": ("AGREEMENT", 1.0), "voltage": ("EQUIVALENT", 1.0), "ip_rating": ("MISSING", 0.95)}
    again = R.reconcile(claims.repartition(3).orderBy(F.desc("raw_value")))
    assert {r["attribute_name"]: (r["status"], r["confidence"]) for r in again.collect()} == got


def test_completeness_of_a_motor(spark):
    products = spark.createDataFrame([(1, "Motors"), (2, "Unknown"), (3, None)], "product_id long, category string")
    attributes = spark.createDataFrame([(1, "rated voltage"), (1, "power"), (2, "x")], "product_id long, attribute_name string")
    got = {r["product_id"]: r["completeness"] for r in X.completeness(products, attributes).collect()}
    assert got == {1: 46.7, 2: 60.0, 3: 0.0}


def test_capitals_are_those_of_the_sql(spark):
    import duckdb

    texts = ["Straße ﬁn ŉ", "ßß", "ß", "", "aßb", "abc", None] + ["".join(map(chr, range(max(i, 1), i + 1024))) for i in range(0, 0xD800, 1024)]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(V.capitals(F.col("t"))).collect()]
    want = [duckdb.execute("SELECT upper(?)", [t]).fetchall()[0][0] for t in texts]
    assert got[:7] == ["STRAẞE ﬁN ŉ", "ẞẞ", "ẞ", "", "AẞB", "ABC", None] and got[:7] == want[:7]
    assert [len(t) for t in got[7:]] == [1024] * 54 or [len(t) for t in got[7:]] == [1023] + [1024] * 53
    assert [(a, b) for x, y in zip(got[7:], want[7:]) for a, b in zip(x, y) if a != b] == []


def test_invoices_with_letters_of_two_capitals(spark):
    from tallyforge.operators import parts as PT

    rows = spark.createDataFrame([(1, "STRAẞE"), (2, "x" * 39 + "ß"), (3, None)], "id long, v string").withColumn("v", F.when(F.col("id") == 2, V.capitals(F.col("v"))).otherwise(F.col("v")))
    assert [(r["id"], r["too_long"], r["not_upper"]) for r in PT.invoice_violations(rows, "v").collect()] == [(1, False, False), (2, False, False), (3, None, None)]


def test_normalized_rows_equal_the_column(spark):
    """In projections the result is that of the column, and it is compiled."""
    raws = ["230 V", "5,5kW", "1 1/2 in", "1/0 V", "N/A - Not Applicable", "abc", "", " ", None, "yes", "a;b", "12 foo", "12 ip", "5 Â°C", "heavy kg", "1e999 V"]
    rows = spark.createDataFrame([(r, k, h) for r in raws for k in ("numeric", "boolean", "structured", "text", None) for h in (None, "", "volts", " foo ")], "raw string, kind string, hint string")
    got = V.with_normalized(rows, "n", "raw", "kind", "hint")
    assert sorted(map(str, got.collect())) == sorted(map(str, rows.withColumn("n", V.normalize_value(F.col("raw"), F.col("kind"), F.col("hint"))).collect()))
    assert "lambda" not in got.select("n.norm_num", "n.unit")._jdf.queryExecution().optimizedPlan().toString()
