"""Catalog tables derived from the star schema, once as DataFrames and once as SQL.

products from part, sources from supplier, claims from lineitem (a supplier's value for one attribute of a product), attributes (the
claim of the most trusted source), issues from attributes, jobs from orders and steps from events.  Values are built from integers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import dealt_by_size

ATTRIBUTES = ["power", "voltage", "speed", "weight", "frequency"]
UNITS = [("W", "kW"), ("V", "kV"), ("RPM", "r/min"), ("g", "kg"), ("Hz", "kHz")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def products(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS product_id",
        "concat(p_type, '-', p_partkey) AS sku",
        "p_brand AS brand",
        "p_name AS product_name",
        "concat(p_type, ' ', p_size) AS model",
        "CASE p_type WHEN 'ECONOMY' THEN 'industrial_motor' WHEN 'STANDARD' THEN 'Motors' WHEN 'MEDIUM' THEN 'Industrial Pump' WHEN 'LARGE' THEN 'Transformer' WHEN 'PROMO' THEN 'Drives' ELSE 'Electric Motor' END AS category",
        "CASE p_partkey % 3 WHEN 0 THEN 'verified' WHEN 1 THEN 'needs_review' ELSE 'draft' END AS status",
        "CAST((p_partkey * 37) % 101 AS DOUBLE) AS quality_score",
        "date_add(DATE'2024-01-01', CAST(p_partkey % 365 AS INT)) AS updated_at",
        "date_add(DATE'2023-01-01', CAST(p_partkey % 200 AS INT)) AS created_at",
    )


PRODUCTS = """products AS (
  SELECT p_partkey AS product_id, p_type || '-' || p_partkey AS sku, p_brand AS brand, p_name AS product_name, p_type || ' ' || p_size AS model,
         CASE p_type WHEN 'ECONOMY' THEN 'industrial_motor' WHEN 'STANDARD' THEN 'Motors' WHEN 'MEDIUM' THEN 'Industrial Pump' WHEN 'LARGE' THEN 'Transformer' WHEN 'PROMO' THEN 'Drives' ELSE 'Electric Motor' END AS category,
         CASE p_partkey % 3 WHEN 0 THEN 'verified' WHEN 1 THEN 'needs_review' ELSE 'draft' END AS status,
         CAST((p_partkey * 37) % 101 AS DOUBLE) AS quality_score,
         DATE '2024-01-01' + CAST(p_partkey % 365 AS INT) AS updated_at, DATE '2023-01-01' + CAST(p_partkey % 200 AS INT) AS created_at
  FROM part)"""


def sources(spark, sf_dir):
    return table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS source_id", "s_name AS source_name", "(50 + s_suppkey % 51) / 100 AS trust",
        "CASE s_suppkey % 4 WHEN 0 THEN 'document' WHEN 1 THEN 'catalog' WHEN 2 THEN 'manufacturer_website' ELSE 'manual' END AS source_type",
    )


SOURCES = """sources AS (
  SELECT s_suppkey AS source_id, s_name AS source_name, (50 + s_suppkey % 51) / 100 AS trust,
         CASE s_suppkey % 4 WHEN 0 THEN 'document' WHEN 1 THEN 'catalog' WHEN 2 THEN 'manufacturer_website' ELSE 'manual' END AS source_type
  FROM supplier)"""

_VALUE = "CAST(100 + (l_partkey * 37) % 900 + (l_linenumber % 5) * 1000 + CASE WHEN l_quantity >= 48 THEN 10 ELSE 0 END AS BIGINT)"


def claims(spark, sf_dir):
    """The first claim of each (product, attribute, source), as raw text with a unit."""
    lines = table(spark, sf_dir, "lineitem")
    line = lines.selectExpr(
        "l_partkey AS product_id", "l_suppkey AS source_id", "CAST(l_linenumber % 5 AS INT) AS k", f"{_VALUE} AS w", "l_shipdate", "l_orderkey", "l_extendedprice",
    )
    first = F.min_by("w", F.struct("l_shipdate", "l_orderkey", "l_extendedprice", "w"))
    one = dealt_by_size(line, lines.count(), "product_id", "source_id").groupBy("product_id", "source_id", "k").agg(first.alias("w"))
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("k") + 1)
    small, large = pick([u[0] for u in UNITS]), pick([u[1] for u in UNITS])
    other = (F.col("source_id") % 7 == 0) & (F.col("k") != 2)
    thousands = F.concat(F.floor(F.col("w") / 1000).cast("string"), F.lit("."), F.lpad((F.col("w") % 1000).cast("string"), 3, "0"))
    number = F.when(other, thousands).otherwise(F.col("w").cast("string"))
    unit = F.when(F.col("source_id") % 7 == 0, large).otherwise(small)
    return one.select(
        "product_id", "source_id", pick(ATTRIBUTES).alias("attribute_name"), F.concat_ws(" ", number, unit).alias("raw_value"), ((50 + F.col("source_id") % 51) / 100).alias("trust")
    )


CLAIMS = f"""claims AS (
  SELECT product_id, source_id, ['power', 'voltage', 'speed', 'weight', 'frequency'][k + 1] AS attribute_name,
         CASE WHEN source_id % 7 = 0 AND k <> 2 THEN (w // 1000) || '.' || lpad(CAST(w % 1000 AS VARCHAR), 3, '0') ELSE CAST(w AS VARCHAR) END || ' ' ||
         CASE WHEN source_id % 7 = 0 THEN ['kW', 'kV', 'r/min', 'kg', 'kHz'][k + 1] ELSE ['W', 'V', 'RPM', 'g', 'Hz'][k + 1] END AS raw_value,
         (50 + source_id % 51) / 100 AS trust, w, k
  FROM (SELECT l_partkey AS product_id, l_suppkey AS source_id, CAST(l_linenumber % 5 AS INT) AS k, {_VALUE} AS w,
               row_number() OVER (PARTITION BY l_partkey, l_suppkey, l_linenumber % 5 ORDER BY l_shipdate, l_orderkey, l_extendedprice, {_VALUE}) AS rn
        FROM lineitem) WHERE rn = 1)"""


def attributes(spark, sf_dir, of=None):
    """One row for each (product, attribute): the claim of the most trusted source (then of the least id).  ``of``: the claims, where they are stored."""
    best = F.min_by(F.struct("source_id", "raw_value", "trust"), F.struct((-F.col("trust")).alias("t"), "source_id"))
    rows = table(spark, sf_dir, "lineitem").count()
    one = dealt_by_size(claims(spark, sf_dir) if of is None else of, rows, "product_id", "attribute_name").groupBy("product_id", "attribute_name").agg(best.alias("b"), F.count("*").alias("n_claims"))
    k = F.array_position(F.array(*map(F.lit, ATTRIBUTES)), F.col("attribute_name")) - 1
    return one.select(
        (F.col("product_id") * 5 + k).cast("long").alias("attribute_id"), "product_id", "attribute_name", "b.source_id", "b.raw_value", F.col("b.trust").alias("confidence"), "n_claims"
    ).withColumn("status", F.when(F.col("attribute_id") % 11 == 0, "conflicting").when(F.col("confidence") < 0.6, "needs_review").otherwise("extracted"))


ATTRIBUTES_SQL = """attributes AS (
  SELECT *, CASE WHEN attribute_id % 11 = 0 THEN 'conflicting' WHEN confidence < 0.6 THEN 'needs_review' ELSE 'extracted' END AS status
  FROM (SELECT product_id * 5 + k AS attribute_id, product_id, attribute_name, source_id, raw_value, trust AS confidence,
               count(*) OVER (PARTITION BY product_id, attribute_name) AS n_claims,
               row_number() OVER (PARTITION BY product_id, attribute_name ORDER BY trust DESC, source_id) AS rn
        FROM claims) WHERE rn = 1)"""


def issues(spark, sf_dir):
    """A validation result for every fourth attribute."""
    return attributes(spark, sf_dir).where("attribute_id % 4 = 0").selectExpr(
        "attribute_id AS validation_id", "product_id", "attribute_id",
        "CASE attribute_id % 5 WHEN 0 THEN 'cross_source_conflict' WHEN 1 THEN 'missing_required_attribute' WHEN 2 THEN 'low_confidence' WHEN 3 THEN 'invalid_unit' ELSE 'numeric_range' END AS validation_type",
        "CASE attribute_id % 7 WHEN 0 THEN 'critical' WHEN 1 THEN 'error' WHEN 2 THEN 'error' WHEN 3 THEN 'info' ELSE 'warning' END AS severity",
        "CASE WHEN attribute_id % 3 = 0 THEN 'resolved' ELSE 'open' END AS status",
        "concat(attribute_name, ' of ', raw_value) AS message",
        "date_add(DATE'2024-03-01', CAST(attribute_id % 90 AS INT)) AS created_at",
    )


ISSUES = """issues AS (
  SELECT attribute_id AS validation_id, product_id, attribute_id,
         CASE attribute_id % 5 WHEN 0 THEN 'cross_source_conflict' WHEN 1 THEN 'missing_required_attribute' WHEN 2 THEN 'low_confidence' WHEN 3 THEN 'invalid_unit' ELSE 'numeric_range' END AS validation_type,
         CASE attribute_id % 7 WHEN 0 THEN 'critical' WHEN 1 THEN 'error' WHEN 2 THEN 'error' WHEN 3 THEN 'info' ELSE 'warning' END AS severity,
         CASE WHEN attribute_id % 3 = 0 THEN 'resolved' ELSE 'open' END AS status,
         attribute_name || ' of ' || raw_value AS message, DATE '2024-03-01' + CAST(attribute_id % 90 AS INT) AS created_at
  FROM attributes WHERE attribute_id % 4 = 0)"""


def jobs(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS job_id", "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'queued' ELSE CASE WHEN o_orderkey % 5 = 0 THEN 'failed' ELSE 'processing' END END AS status",
        "o_orderkey % 17 AS total_items", "o_orderkey % 5 AS failed_items", "CAST(o_orderdate AS DATE) AS created_at", "o_custkey AS owner_id",
    )


JOBS = """jobs AS (
  SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'queued' ELSE CASE WHEN o_orderkey % 5 = 0 THEN 'failed' ELSE 'processing' END END AS status,
         o_orderkey % 17 AS total_items, o_orderkey % 5 AS failed_items, CAST(o_orderdate AS DATE) AS created_at, o_custkey AS owner_id
  FROM orders)"""


def steps(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("event_id AS step_id", "user_id AS job_id", "event_type AS stage", "ts AS created_at", "value")


STEPS = "steps AS (SELECT event_id AS step_id, user_id AS job_id, event_type AS stage, ts AS created_at, value FROM events)"

_NEEDS = {"attributes": ["claims"], "issues": ["claims", "attributes"]}
_TEXT = {"products": PRODUCTS, "sources": SOURCES, "claims": CLAIMS, "attributes": ATTRIBUTES_SQL, "issues": ISSUES, "jobs": JOBS, "steps": STEPS}


def with_views(names: str, sql: str) -> str:
    """``sql`` after the definitions of the views it names and of those that they need."""
    wanted: list[str] = []
    for n in names.split():
        wanted += [x for x in [*_NEEDS.get(n, []), n] if x not in wanted]
    more = sql.lstrip()
    views = ",\n".join(_TEXT[n] for n in wanted)
    for start in ("WITH RECURSIVE ", "WITH "):
        if more.startswith(start):
            return f"{start}{views},\n{more.removeprefix(start)}"
    return f"WITH {views}\n{more}"
