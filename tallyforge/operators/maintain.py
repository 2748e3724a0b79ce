"""Keyed snapshots: upserts, versions, audit rows, decisions.  Each gives the new table; nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = (), if_null: tuple[str, ...] = ()) -> DataFrame:
    """``old`` with the rows of ``new`` put in by key: ``keep`` columns stay as they were, ``if_null`` ones where the new is null."""
    o = old.select(*keys, F.struct(*[c for c in old.columns if c not in keys]).alias("o"))
    n = new.select(*keys, F.struct(*[c for c in old.columns if c not in keys]).alias("n"))
    both = o.join(n, keys, "full_outer")

    def pick(c: str):
        if c in keep:
            return F.when(F.col("o").isNotNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))
        if c in if_null:
            return F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}"))
        return F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))

    return both.select(*[c if c in keys else pick(c).alias(c) for c in old.columns])


def audit_rows(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """created, updated or deleted rows with both states as JSON; unchanged rows are left out."""
    state = lambda df, name: df.select(F.col(key), F.to_json(F.struct(*sorted(df.columns))).alias(name))
    both = state(old, "before").join(state(new, "after"), key, "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))
    return both.select(key, F.when(F.col("before").isNull(), "created").when(F.col("after").isNull(), "deleted").otherwise("updated").alias("action"), "before", "after")


def next_versions(versions: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """Version numbers for ``changes``: they go on after the versions there are."""
    held = versions.groupBy(key).agg(F.count("*").alias("held"))
    w = Window.partitionBy(key).orderBy(order)
    return changes.join(held, key, "left").withColumn("version_number", F.coalesce("held", F.lit(0)) + F.row_number().over(w)).drop("held")


def latest(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key by ``order``, by an aggregate with partial sums."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("x")).select(*keys, "x.*")


def replace_open_issues(existing: DataFrame, fresh: DataFrame, batch: DataFrame) -> DataFrame:
    """Open issues of the products of ``batch`` give way to ``fresh``; all others stay."""
    touched = batch.select("product_id").distinct().withColumn("touched", F.lit(True))
    stay = existing.join(touched, "product_id", "left").where("status <> 'open' or touched is null").select(*existing.columns)
    return stay.unionByName(fresh.select(*existing.columns))


def named_products(rows: DataFrame) -> DataFrame:
    """``rows`` with a brand and a category for those that have none: UNKNOWN and Uncategorized."""
    or_else = lambda c, name: F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) == "", name).otherwise(F.col(c))
    return rows.withColumns({"brand": or_else("brand", "UNKNOWN"), "category": or_else("category", "Uncategorized")})


def delete_products(gone: DataFrame, attributes: DataFrame, by_product: dict[str, DataFrame], by_attribute: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What is left of the attributes, of the tables with a product_id and of those with an attribute_id once the products of ``gone`` are."""
    ids = gone.select("product_id").distinct()
    lost = attributes.join(ids, "product_id", "left_semi").select("attribute_id").distinct()
    left = {"attributes": attributes.join(ids, "product_id", "left_anti")}
    left |= {name: t.join(ids, "product_id", "left_anti") for name, t in by_product.items()}
    return left | {name: t.join(lost, "attribute_id", "left_anti") for name, t in by_attribute.items()}


def decide(issues: DataFrame, decisions: DataFrame) -> DataFrame:
    """(validation_id, outcome, new_status) of decisions (validation_id, product_id, resolution) on issues with their last one."""
    d = decisions.select("validation_id", F.col("product_id").alias("d_product"), "resolution")
    rows = issues.join(d, "validation_id")
    outcome = (
        F.when(F.col("d_product") != F.col("product_id"), "wrong_product")
        .when(F.col("status") == "resolved", F.when(F.col("last_resolution") == F.col("resolution"), "already_resolved").otherwise("conflict"))
        .otherwise("resolved")
    )
    return rows.select("validation_id", outcome.alias("outcome"), F.when(outcome == "resolved", "resolved").otherwise(F.col("status")).alias("new_status"))


def retry_failed(jobs: DataFrame) -> DataFrame:
    """Failed jobs are queued again with one more attempt and no failures."""
    failed = F.col("status") == "failed"
    return jobs.withColumn("attempt", F.when(failed, F.col("attempt") + 1).otherwise(F.col("attempt"))).withColumn("failed_items", F.when(failed, 0).otherwise(F.col("failed_items"))).withColumn("status", F.when(failed, "queued").otherwise(F.col("status")))


def rejected_retries(jobs: DataFrame) -> DataFrame:
    """Jobs that can't be tried again, as they haven't failed."""
    return jobs.where(~F.coalesce(F.col("status") == "failed", F.lit(False)))


def approve(products: DataFrame, approved: DataFrame) -> DataFrame:
    """``products`` with the status verified for those of ``approved`` (product_id)."""
    ok = approved.select("product_id").distinct().withColumn("_ok", F.lit(True))
    rows = products.join(ok, "product_id", "left").withColumn("status", F.when(F.col("_ok"), "verified").otherwise(F.col("status")))
    return rows.select(*products.columns)


def reindex(index: DataFrame, rows: DataFrame, key: str, digest: str, gone: DataFrame | None = None) -> DataFrame:
    """``index`` with the new and changed ones of ``rows`` put in by ``key``, and without those of ``gone``; rows of an equal ``digest`` stay."""
    held = index.select(key, F.col(digest).alias("_held"))
    changed = rows.join(held, key, "left").where(~F.col("_held").eqNullSafe(F.col(digest))).select(*index.columns)
    out = upsert(index, changed, [key])
    return out if gone is None else out.join(gone.select(key).distinct(), key, "left_anti")


def without_cached(inputs: DataFrame, results: DataFrame, now) -> DataFrame:
    """Inputs whose cache key has no valid, unexpired result."""
    good = results.where((F.col("status") == "valid") & (F.col("expires_at").isNull() | (F.col("expires_at") > now)))
    return inputs.join(good.select("cache_key").distinct(), "cache_key", "left_anti")
