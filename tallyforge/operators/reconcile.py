"""Multi-source reconciliation of claims."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values as V

KEY = ["product_id", "attribute_name"]


def parse_claims(claims: DataFrame) -> DataFrame:
    """Claims with ``num`` in the base unit of their standardised unit, ``base_unit`` and ``text``."""
    unit = F.coalesce(V.numeric_unit(F.col("raw_value"), F.lit(None).cast("string")), F.regexp_extract("raw_value", r"([a-zA-Z/]+)\s*$", 1))
    return claims.withColumn("num", F.bround(V.si_value(V.numeric_value(F.col("raw_value")), unit), 6)).withColumn("base_unit", V.si_unit(unit)).withColumn("text", V.normalize_text(F.col("raw_value")))


def winning_claims(claims: DataFrame) -> DataFrame:
    """The claim with the highest trust of each attribute, then that of the least source id."""
    best = F.min_by(F.struct("source_id", "raw_value", "trust", "num", "text"), F.struct((-F.col("trust")).alias("t"), "source_id"))
    return claims.groupBy(*KEY).agg(best.alias("w")).select(*KEY, "w.*")


def reconcile(claims: DataFrame, attributes: DataFrame | None = None) -> DataFrame:
    """One row per attribute: MISSING (a single source), AGREEMENT (same text), EQUIVALENT (same value) or CONFLICTING, each claim
    held against the winner, with a confidence.

    ``claims`` has one claim for each (product, attribute, source).  ``attributes`` (product_id, attribute_name, raw_value,
    confidence) are those of the catalog: with a single source, trust times the attribute's own confidence counts (1 where there is
    no such attribute), and an attribute without claims stands as one claim of full trust without a source.

    All claims equal the winner if the least and the largest do, so one aggregate decides and no attribute's claims are gathered.
    """
    parsed = parse_claims(claims)
    win = F.min_by(F.struct("source_id", "raw_value", "trust", "num", "text"), F.struct((-F.col("trust")).alias("t"), "source_id"))
    word = F.when(F.col("num").isNull(), F.col("text"))
    one = parsed.groupBy(*KEY).agg(
        win.alias("w"), F.count("*").alias("n_claims"), F.count("source_id").alias("n_sources"), F.min("num").alias("low"), F.max("num").alias("high"),
        F.min("text").alias("first"), F.max("text").alias("last"), F.min(word).alias("first_word"), F.max(word).alias("last_word"),
    )
    near = (F.col("high") - F.col("w.num") <= 1e-5) & (F.col("w.num") - F.col("low") <= 1e-5)
    words = F.col("first_word").isNull() | ((F.col("first_word") == F.col("w.text")) & (F.col("last_word") == F.col("w.text")))
    all_text = F.col("first") == F.col("last")
    same = F.when(F.col("w.num").isNotNull(), near & words).otherwise(all_text)
    known = F.lit(1.0)
    if attributes is not None:
        own = attributes.select(*KEY, F.col("raw_value").alias("own_value"), F.col("confidence").alias("own"))
        one = one.join(own.hint("merge"), KEY, "full")  # a filter on the result can turn it into a left join; the catalog isn't for broadcasting
        known = F.coalesce("own", F.lit(1.0))
        one = one.withColumns({"n_claims": F.coalesce("n_claims", F.lit(1).cast("long")), "trust": F.coalesce("w.trust", F.lit(1.0)), "winning_value": F.when(F.col("n_sources").isNull(), F.col("own_value")).otherwise(F.col("w.raw_value"))})
    else:
        one = one.withColumns({"trust": F.col("w.trust"), "winning_value": F.col("w.raw_value")})
    single = F.col("n_claims") == 1
    status = F.when(single, "MISSING").when(same, F.when(all_text, "AGREEMENT").otherwise("EQUIVALENT")).otherwise("CONFLICTING")
    alone = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("trust") * known))
    boosted = F.least(F.lit(1.0), F.col("trust") + 0.05 * (F.col("n_sources") - 1))
    confidence = F.when(single, alone).when(same, boosted).otherwise(F.greatest(F.lit(0.2), F.col("trust") - 0.25))
    return one.select(*KEY, "n_claims", F.col("w.source_id").alias("winner"), "winning_value", status.alias("status"), F.bround(confidence, 4).alias("confidence"))


def summary(reconciled: DataFrame) -> DataFrame:
    """Per product: attributes by status and the mean confidence."""
    by = lambda s: F.count_if(F.col("status") == s).alias(s.lower())
    return reconciled.groupBy("product_id").agg(F.count("*").alias("attributes"), *[by(s) for s in ("AGREEMENT", "EQUIVALENT", "MISSING", "CONFLICTING")], V.exact_mean(F.col("confidence"), 4).alias("mean_confidence"))


def competing_claims(claims: DataFrame) -> DataFrame:
    """All claims but the winner of each attribute whose claims conflict, those of the winner's text too, with its value."""
    odd = reconcile(claims).where("status = 'CONFLICTING'").select(*KEY, "winner", "winning_value")
    return claims.join(odd, KEY).where(~F.col("source_id").eqNullSafe(F.col("winner"))).select(*KEY, "source_id", "raw_value", "trust", "winning_value")
