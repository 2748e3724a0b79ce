"""Health, overview and review reports of a catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V

CONFLICTS = ["cross_attribute_conflict", "cross_source_conflict", "inconsistent_value"]
MISSING = ["missing_required_field", "missing_required_attribute"]


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.bround(F.coalesce(100.0 * F.try_divide(part, whole), F.lit(0.0)), digits)


def health_overall(products: DataFrame, completeness: DataFrame, attributes: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row: counts, average quality, verification rate, mean completeness and evidence coverage."""
    p = products.agg(F.count("*").alias("products"), F.bround(F.coalesce(F.avg("quality_score"), F.lit(0.0)), 1).alias("avg_quality"), percent(F.count_if(F.col("status") == "verified"), F.count("*")).alias("verification_rate"))
    c = completeness.agg(F.coalesce(V.exact_mean(F.col("completeness"), 1), F.lit(0.0)).alias("avg_completeness"))
    covered = attributes.join(evidence.select("attribute_id").distinct(), "attribute_id", "left_semi").agg(F.count("*").alias("covered"))
    a = attributes.agg(F.count("*").alias("attributes"))
    one = p.crossJoin(c).crossJoin(covered).crossJoin(a)  # each side is one row
    return one.select("products", "avg_quality", "verification_rate", "avg_completeness", "attributes", percent(F.col("covered"), F.col("attributes")).alias("evidence_coverage"))


def issues_summary(issues: DataFrame, attributes: DataFrame) -> DataFrame:
    kind = F.col("validation_type")
    i = issues.where("status = 'open'").agg(F.count_if(kind.isin(CONFLICTS)).alias("ci"), F.count_if(kind.isin(MISSING)).alias("missing"), F.count_if(~kind.isin(CONFLICTS + MISSING)).alias("other"))
    a = attributes.agg(F.count_if(F.col("status") == "conflicting").alias("ca"), F.count_if((F.col("confidence") < 0.75) | F.col("status").isin("needs_review", "conflicting")).alias("low_confidence"))
    return i.crossJoin(a).select((F.col("ci") + F.col("ca")).alias("conflicts"), "missing", "other", "low_confidence")


def group_health(products: DataFrame, completeness: DataFrame, issues: DataFrame, attributes: DataFrame, key: str) -> DataFrame:
    """Health by category or brand; issues and conflicts are summed per product before the join."""
    i = issues.where("status = 'open'").groupBy("product_id").agg(F.count("*").alias("oi"))
    c = attributes.where("status = 'conflicting'").groupBy("product_id").agg(F.count("*").alias("oc"))
    all_ = products.join(completeness.select("product_id", "completeness"), "product_id", "left").join(i, "product_id", "left").join(c, "product_id", "left")
    return all_.groupBy(key).agg(
        F.count("*").alias("products"), F.bround(F.avg("quality_score"), 1).alias("avg_quality"), percent(F.count_if(F.col("status") == "verified"), F.count("*")).alias("verification_rate"),
        F.coalesce(V.exact_mean(F.col("completeness"), 1), F.lit(0.0)).alias("avg_completeness"), F.coalesce(F.sum("oi"), F.lit(0)).alias("open_issues"), F.coalesce(F.sum("oc"), F.lit(0)).alias("conflicts"),
    )


def attention_queue(products: DataFrame, issues: DataFrame, attributes: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` products that most need a look."""
    i = issues.where("status = 'open'").groupBy("product_id").agg(F.count("*").alias("open_issues"), F.bool_or(F.col("validation_type").isin(CONFLICTS)).alias("ic"))
    c = attributes.where("status = 'conflicting'").select("product_id").distinct().withColumn("ac", F.lit(True))
    p = products.join(i, "product_id", "left").join(c, "product_id", "left")
    p = p.withColumn("open_issues", F.coalesce("open_issues", F.lit(0))).withColumn("has_conflict", F.coalesce("ic", F.lit(False)) | F.coalesce("ac", F.lit(False)))
    p = p.where("status = 'needs_review' or quality_score < 70 or open_issues > 0")
    review = (F.col("status") == "needs_review").alias("r")
    return p.orderBy(F.desc(review), F.desc("has_conflict"), "quality_score", F.desc("open_issues"), "product_id").limit(k).select("product_id", "status", "has_conflict", "quality_score", "open_issues")


def review_queue(
    issues: DataFrame, products: DataFrame, attributes: DataFrame, status: str | None = "open", severity: str | None = None, cls: str | None = None,
    search: str | None = None, sort: str = "severity", page: int = 1, size: int = 20,
) -> DataFrame:
    """A page of issues with their product and attribute, filtered and sorted; pages hold 100 at most."""
    p = products.select("product_id", "product_name", "sku", "brand")
    a = attributes.select("attribute_id", "attribute_name", F.col("status").alias("attribute_status"), "confidence")
    rows = issues.join(p, "product_id").join(a, "attribute_id", "left")
    rows = rows.withColumn("issue_class", V.issue_class(F.col("validation_type"), F.col("attribute_status"), F.col("confidence")))
    if status and status != "all":
        rows = rows.where(F.col("status") == status)
    if severity:
        rows = rows.where(F.col("severity") == severity)
    if cls:
        rows = rows.where(F.col("issue_class") == cls)
    if search:
        hit = F.lit(False)
        for c in ("product_name", "sku", "brand", "attribute_name", "message"):
            hit = hit | F.coalesce(F.lower(F.col(c)).contains(search.lower()), F.lit(False))
        rows = rows.where(hit)
    rank = F.when(F.col("severity") == "critical", 4).when(F.col("severity") == "error", 3).when(F.col("severity") == "warning", 2).otherwise(1)
    order = {"newest": F.desc("created_at"), "oldest": F.asc("created_at"), "severity": F.desc(rank), "confidence": F.asc(F.coalesce("confidence", F.lit(1.0)))}[sort]
    size = min(size, 100)
    return rows.orderBy(order, "validation_id").offset((page - 1) * size).limit(size).select("validation_id", "product_id", "severity", "issue_class", "attribute_name", "created_at")
