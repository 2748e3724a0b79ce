"""Review decisions with effect: what each does, the attributes and issues that follow, audit rows, scores anew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import validate as X


def resolve_issues(issues: DataFrame, decisions: DataFrame) -> DataFrame:
    """(validation_id, decided_at, product_id, attribute_id, resolution, notes, outcome, value, source_id): what becomes of each decision.

    ``issues``: validation_id, product_id, attribute_id, status, last_resolution, expected_claim and actual_claims (the winning claim and
    those against it, structs of raw_value and source_id; null where the issue has none) and expected_value, actual_value (plain
    texts instead).  ``decisions``: validation_id, product_id, resolution, resolved_value, notes, decided_at.

    wrong_product: the issue is unknown or another product's.  already_resolved, conflict: it was resolved by the same or by another
    resolution.  unsupported: no such resolution.  no_value: accept_source_a finds no expected claim, plain actual or supplied value,
    accept_source_b no first actual claim, plain expected or supplied value, custom none but a blank one.  Else resolved.
    Of several decisions on one issue the earliest that can resolve it does (then by the least resolution), and those after it are held against it;
    the issue's first one is found by an aggregate, so no issue's decisions are gathered.
    """
    own = issues.select(
        F.col("validation_id").alias("_issue"), F.col("product_id").alias("_product"), "attribute_id", "status", "last_resolution", "expected_claim", F.get("actual_claims", F.lit(0)).alias("_against"), "expected_value", "actual_value"
    )
    d = decisions.join(own, F.col("validation_id") == F.col("_issue"), "left")
    a, b, custom = F.col("resolution") == "accept_source_a", F.col("resolution") == "accept_source_b", F.col("resolution").isin("custom", "custom_value")
    given = F.trim("resolved_value")
    value = (
        F.when(a, F.coalesce("expected_claim.raw_value", "actual_value", "resolved_value"))
        .when(b, F.coalesce("_against.raw_value", "expected_value", "resolved_value"))
        .when(custom & (given != ""), given)
    )
    source = F.when(a & F.col("expected_claim.raw_value").isNotNull(), F.col("expected_claim.source_id")).when(b & F.col("_against.raw_value").isNotNull(), F.col("_against.source_id"))
    d = d.withColumns({"_value": value, "_source": source})
    fault = F.when(~F.coalesce(F.col("_product") == F.col("product_id"), F.lit(False)), "wrong_product").when(
        F.col("status") != "resolved", F.when(~F.coalesce(a | b | custom, F.lit(False)), "unsupported").when(F.col("_value").isNull(), "no_value")
    )
    d = d.withColumn("_fault", fault)
    order = F.struct("decided_at", F.col("resolution"))
    able = d.where("_fault is null and status <> 'resolved'")
    first = able.groupBy(F.col("validation_id").alias("_of")).agg(F.min(order).alias("_first"))
    d = d.join(first, F.col("validation_id") == F.col("_of"), "left")
    held = F.when(F.col("status") == "resolved", F.col("last_resolution")).otherwise(F.col("_first.resolution"))
    late = (F.col("status") == "resolved") | (F.coalesce(order > F.col("_first"), F.lit(False)))
    outcome = F.when(F.col("_fault") == "wrong_product", F.col("_fault")).when(late, F.when(held.eqNullSafe(F.col("resolution")), "already_resolved").otherwise("conflict")).otherwise(F.coalesce("_fault", F.lit("resolved")))
    d = d.withColumn("outcome", outcome)
    done = F.col("outcome") == "resolved"
    return d.select("validation_id", "decided_at", "product_id", "attribute_id", "resolution", "notes", "outcome", F.when(done, F.col("_value")).alias("value"), F.when(done, F.col("_source")).alias("source_id"))


def decided_attributes(attributes: DataFrame, decided: DataFrame) -> DataFrame:
    """``attributes`` with the decided values, which are verified; of several issues of an attribute the last decision counts (then the largest issue)."""
    won = decided.where("outcome = 'resolved' and attribute_id is not null").groupBy(F.col("attribute_id").alias("_at")).agg(F.max_by("value", F.struct("decided_at", "validation_id")).alias("_value"))
    both = attributes.join(won, F.col("attribute_id") == F.col("_at"), "left")
    new = {"raw_value": F.coalesce("_value", "raw_value"), "status": F.when(F.col("_at").isNotNull(), "verified").otherwise(F.col("status"))}
    return both.select(*[new.get(c, F.col(c)).alias(c) for c in attributes.columns])


def decided_issues(issues: DataFrame, decided: DataFrame) -> DataFrame:
    """``issues`` with those resolved that a decision resolves, and its resolution as the last one."""
    won = decided.where("outcome = 'resolved'").groupBy(F.col("validation_id").alias("_of")).agg(F.max("resolution").alias("_by"))
    both = issues.join(won, F.col("validation_id") == F.col("_of"), "left")
    new = {"status": F.when(F.col("_of").isNotNull(), "resolved").otherwise(F.col("status")), "last_resolution": F.coalesce("_by", "last_resolution")}
    return both.select(*[new.get(c, F.col(c)).alias(c) for c in issues.columns])


def resolution_audit(decided: DataFrame) -> DataFrame:
    """An audit row for each decision that resolved an issue."""
    details = F.to_json(F.struct("resolution", F.col("value").alias("resolved_value"), F.col("source_id").alias("selected_source_id"), "notes"))
    return decided.where("outcome = 'resolved'").select(F.lit("validation_result").alias("entity_type"), F.col("validation_id").alias("entity_id"), F.lit("human_resolution").alias("action"), F.lit("user").alias("actor_type"), details.alias("details"), F.col("decided_at").alias("created_at"))


def rescore(products: DataFrame, attributes: DataFrame, evidence: DataFrame, decided: DataFrame) -> DataFrame:
    """``products`` with quality_score and status of those that a decision resolved an issue of, by their ``attributes`` after it:
    verified if no error or critical issue is left, else the status they had.  Only touched products are validated."""
    touched = decided.where("outcome = 'resolved'").select("product_id").distinct()
    p, a = products.join(touched, "product_id", "left_semi"), attributes.join(touched, "product_id", "left_semi")
    found = X.validate_catalog(p, a)
    bad = found.where("severity in ('error', 'critical')").select(F.col("product_id").alias("_bad")).distinct()
    scores = X.quality_scores(p, a, evidence, found).select(F.col("product_id").alias("_id"), "quality")
    fresh = scores.join(bad, F.col("_id") == F.col("_bad"), "left").select("_id", "quality", F.col("_bad").isNull().alias("_clean"))
    both = products.join(fresh, F.col("product_id") == F.col("_id"), "left")
    new = {"quality_score": F.coalesce("quality", "quality_score"), "status": F.when(F.col("_clean"), "verified").otherwise(F.col("status"))}
    return both.select(*[new.get(c, F.col(c)).alias(c) for c in products.columns])
