"""Validation of attributes against category rules, completeness and quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lookups as L
from ..functions import values as V


def rule_table(spark) -> DataFrame:
    """(rule, field, is_required, name): each field of a category with every name that counts as it.  A fixed small table."""
    rows = [
        (key, field, required, name)
        for key, lists in L.CATEGORY_RULES.items()
        for required, fields in zip((True, False), lists, strict=True)
        for field in fields
        for name in sorted({field, *L.ATTRIBUTE_ALIASES.get(field, [])})
    ]
    return spark.createDataFrame(rows, "rule string, field string, is_required boolean, name string")


RULES_SQL = "rules(rule, field, is_required, name) AS (VALUES " + ", ".join(
    f"({L.sql_text(key)}, {L.sql_text(field)}, {str(required).lower()}, {L.sql_text(name)})"
    for key, lists in L.CATEGORY_RULES.items()
    for required, fields in zip((True, False), lists, strict=True)
    for field in fields
    for name in sorted({field, *L.ATTRIBUTE_ALIASES.get(field, [])})
) + ")"


def fields_present(products: DataFrame, attributes: DataFrame) -> DataFrame:
    """(product_id, rule, field, is_required, present) for each field of a product's category."""
    rules = rule_table(products.sparkSession)
    fields = rules.select("rule", "field", "is_required").distinct()
    wanted = products.select("product_id", V.category_key(F.col("category")).alias("rule")).join(F.broadcast(fields), "rule")  # fixed table
    have = attributes.select("product_id", V.attribute_key(F.col("attribute_name")).alias("name"))
    names = rules.select("field", "name").distinct()
    have = have.join(F.broadcast(names), "name").select("product_id", "field").distinct().withColumn("present", F.lit(True))
    return wanted.join(have, ["product_id", "field"], "left").withColumn("present", F.coalesce("present", F.lit(False)))


def missing_attributes(products: DataFrame, attributes: DataFrame) -> DataFrame:
    return fields_present(products, attributes).where("is_required and not present").select("product_id", "rule", "field")


def completeness(products: DataFrame, attributes: DataFrame) -> DataFrame:
    """Required fields count 70, optional ones 30; without required fields it goes by the number of attributes."""
    share = lambda r: F.coalesce(F.try_divide(F.count_if(F.col("present") & (F.col("is_required") == r)), F.count_if(F.col("is_required") == r)), F.lit(1.0))
    by_field = fields_present(products, attributes).groupBy("product_id").agg(share(True).alias("req"), share(False).alias("opt"), F.count_if("is_required").alias("n_required"))
    n = attributes.groupBy("product_id").agg(F.count("*").alias("n"))
    out = products.select("product_id").join(by_field, "product_id", "left").join(n, "product_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    generic = F.when(F.col("n") == 0, 0.0).when(F.col("n") >= 5, 100.0).otherwise(50.0 + 10.0 * F.col("n"))
    score = F.when(F.col("n_required") > 0, F.col("req") * 70 + F.col("opt") * 30).otherwise(generic)
    return out.select("product_id", "n", F.bround(score, 1).alias("completeness"))


def completeness_details(products: DataFrame, attributes: DataFrame, evidence: DataFrame) -> DataFrame:
    """(product_id, required_present, required_total, optional_present, optional_total, missing, evidence_coverage, completeness).

    ``missing``: the required fields that a product lacks, in the order of its category's rules.  ``evidence_coverage``: the percentage of
    its attribute names that ``evidence`` (product_id, attribute_name) has.  Names count once, whatever their case and spaces.
    """
    places = {(key, field): i for key, lists in L.CATEGORY_RULES.items() for i, field in enumerate(lists[0])}
    place = F.create_map(*[x for (key, field), i in places.items() for x in (F.lit(f"{key}/{field}"), F.lit(i))])
    fields = fields_present(products, attributes).withColumn("place", F.try_element_at(place, F.concat_ws("/", "rule", "field")))
    of = lambda required, cond=None: F.count_if((F.col("is_required") == required) & (F.lit(True) if cond is None else cond))
    absent = F.sort_array(F.collect_list(F.when(F.col("is_required") & ~F.col("present"), F.struct("place", "field"))))  # the fields of one category
    here = F.col("present")
    by_field = fields.groupBy("product_id").agg(of(True, here).alias("rp"), of(True).alias("rt"), of(False, here).alias("op"), of(False).alias("ot"), absent.alias("absent"))
    named = lambda df: df.select("product_id", F.regexp_replace(F.trim(F.lower("attribute_name")), " ", "_").alias("name")).distinct()
    held = named(attributes).join(named(evidence).withColumn("backed", F.lit(True)), ["product_id", "name"], "left").groupBy("product_id").agg(F.count("*").alias("n"), F.count("backed").alias("backed"))
    out = products.select("product_id").join(by_field, "product_id", "left").join(held, "product_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    n = zero("n")
    score = F.when(zero("rt") > 0, F.col("rp") / F.col("rt") * 70 + F.when(F.col("ot") > 0, F.try_divide(F.col("op"), F.col("ot"))).otherwise(0.5) * 30).when(n == 0, 0.0).when(n >= 5, 100.0).otherwise(50.0 + 10.0 * n)
    return out.select(
        "product_id", zero("rp").alias("required_present"), zero("rt").alias("required_total"), zero("op").alias("optional_present"), zero("ot").alias("optional_total"),
        F.coalesce(F.transform("absent", lambda x: x["field"]), F.array().cast("array<string>")).alias("missing"), F.bround(F.coalesce(F.try_divide(zero("backed") * 100.0, n), F.lit(0.0)), 1).alias("evidence_coverage"), F.bround(score, 1).alias("completeness"),
    )


def check_units(attributes: DataFrame) -> DataFrame:
    """(attribute_id, concept, unit, outcome): ok, invalid_unit, missing_unit, or null without a concept."""
    concept, unit = V.match_concept(F.col("attribute_name")), V.embedded_unit(F.col("raw_value"))
    fits = F.array_contains(V.allowed_units(concept), unit)
    outcome = F.when(concept.isNull(), None).when(unit.isNull(), "missing_unit").when(fits, "ok").otherwise("invalid_unit")
    return attributes.select("attribute_id", concept.alias("concept"), unit.alias("unit"), outcome.alias("outcome"))


def check_ranges(rows: DataFrame, name: str = "attribute_name", value: str = "value") -> DataFrame:
    """``rows`` with ``range_issue``: invalid_numeric_value, out_of_range or null, by the first rule that the name matches."""
    key, text = F.regexp_replace(F.lower(F.col(name)), " ", "_"), F.regexp_replace(F.trim(F.col(value)), ",", "")
    num = F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))
    positive = key.contains("volt") | key.contains("power")
    later = lambda *words: F.greatest(*[key.contains(w) for w in words]) if len(words) > 1 else key.contains(words[0])
    bad = (
        F.when(positive, num <= 0)
        .when(later("speed", "rpm"), num < 0)
        .when(later("efficiency"), (num < 0) | (num > 100))
        .when(later("weight", "mass"), num <= 0)
        .when(later("freq"), num <= 0)
        .otherwise(num < 0)
    )
    return rows.withColumn("range_issue", F.when(F.col(value).isNull(), None).when(num.isNull(), "invalid_numeric_value").when(bad, "out_of_range"))


def validate_catalog(products: DataFrame, attributes: DataFrame) -> DataFrame:
    """The issues of a catalog: (product_id, subject, validation_type, severity).

    One pass over the attributes gives all issues of an attribute; missing ones come from the category rules."""
    concept, unit = V.match_concept(F.col("attribute_name")), V.embedded_unit(F.col("raw_value"))
    number = F.regexp_extract("raw_value", V.SPLIT_UNIT, 1)
    ranged = check_ranges(attributes.withColumn("number", F.when(number != "", number)), value="number")
    issue = lambda cond, kind, severity: F.when(cond, F.struct(F.lit(kind).alias("validation_type"), F.lit(severity).alias("severity")))
    found = F.array(
        issue(concept.isNotNull() & unit.isNotNull() & ~F.array_contains(V.allowed_units(concept), unit), "invalid_unit", "error"),
        issue(F.col("range_issue").isNotNull(), "numeric_range", "error"),
        issue(F.col("confidence") < 0.6, "low_confidence", "warning"),
        issue(F.col("status") == "conflicting", "cross_source_conflict", "warning"),
    )
    own = ranged.select("product_id", F.col("attribute_name").alias("subject"), F.explode(F.filter(found, lambda x: x.isNotNull())).alias("i")).select("product_id", "subject", "i.*")
    missing = missing_attributes(products, attributes).select("product_id", F.col("field").alias("subject"), F.lit("missing_required_attribute").alias("validation_type"), F.lit("error").alias("severity"))
    return own.unionByName(missing)


#: What a message says of a number by the words in its attribute's name, in the order they are looked for.
_RANGES = [
    (("volt",), "Voltage must be strictly positive (> 0), got {}."), (("power",), "Power must be strictly positive (> 0), got {}."),
    (("speed", "rpm"), "Speed must be non-negative (>= 0), got {}."), (("weight", "mass"), "Weight must be strictly positive (> 0), got {}."),
    (("freq",), "Frequency must be strictly positive (> 0), got {}."), (("efficiency",), "Efficiency percentage must be between 0% and 100%, got {}."),
]


def _text(*parts: Column | str) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _issue(cond: Column, kind: Column | str, severity: str, message: Column, expected: str, actual: Column) -> Column:
    given = kind if isinstance(kind, Column) else F.lit(kind)
    return F.when(cond, F.struct(given.alias("validation_type"), F.lit(severity).alias("severity"), message.alias("message"), F.lit(expected).alias("expected"), actual.alias("actual")))


def validation_issues(products: DataFrame, attributes: DataFrame) -> DataFrame:
    """(product_id, attribute_id, attribute_name, validation_type, severity, message, expected, actual): all that is wrong with a catalog.

    ``attributes``: attribute_id, product_id, attribute_name, raw_value, unit, data_type, normalized_value, confidence, status.  Types:
    invalid_unit, invalid_numeric_value, out_of_range (of numeric attributes), low_confidence, cross_attribute_conflict, and
    missing_required_attribute, whose attribute_id is null.  One pass over the attributes; the category rules are a fixed table.
    """
    name = F.col("attribute_name")
    own_unit = F.coalesce(V.blank_to_null(F.col("unit")), F.nullif(F.regexp_extract(F.trim("raw_value"), V.SPLIT_UNIT, 2), F.lit("")))
    allowed = V.allowed_units(V.match_concept(name))
    rows = check_ranges(attributes.withColumn("_checked", F.when(F.col("data_type") == "numeric", F.coalesce("normalized_value", "raw_value"))), value="_checked")
    number = F.regexp_replace(F.trim("_checked"), ",", "").try_cast("double").cast("string")
    key = F.regexp_replace(F.lower(name), " ", "_")
    bounds = _text("Attribute '", name, "' value ", number, " is negative, which is unexpected.")
    for words, said in reversed(_RANGES):
        before, after = said.split("{}")
        bounds = F.when(key.rlike("|".join(words)), _text(before, number, after)).otherwise(bounds)
    unread = _text("Attribute '", name, "' value '", F.col("_checked"), "' cannot be parsed as a valid numeric number.")
    percent = _text(F.bround(F.col("confidence") * 100, 0).cast("long").cast("string"), "%")
    listed = _text("['", F.array_join(F.array_sort(allowed), "', '"), "']")
    kind = F.col("range_issue")
    found = F.array(
        _issue(
            own_unit.isNotNull() & ~F.array_contains(allowed, V.canonical_unit(own_unit)), "invalid_unit", "error",
            _text("Incompatible unit '", own_unit, "' for attribute '", name, "'. Expected one of ", listed, "."), "Compatible unit", F.coalesce(V.blank_to_null(F.col("unit")), "raw_value"),
        ),
        _issue(kind.isNotNull(), kind, "error", F.when(kind == "out_of_range", bounds).otherwise(unread), "Valid positive numeric value", F.col("_checked")),
        _issue(F.col("confidence") < 0.6, "low_confidence", "warning", _text("Attribute '", name, "' has low extraction confidence (", percent, ")."), "Confidence >= 60%", percent),
        _issue(F.col("status") == "conflicting", "cross_attribute_conflict", "warning", _text("Attribute '", name, "' has conflicting source values that require human resolution."), "Single verified value", F.col("raw_value")),
    )
    own = rows.select("product_id", "attribute_id", "attribute_name", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("i")).select("product_id", "attribute_id", "attribute_name", "i.*")
    field = F.col("field")
    gone = missing_attributes(products, attributes).join(products.select("product_id", "category"), "product_id").select(
        "product_id", F.lit(None).cast("long").alias("attribute_id"), field.alias("attribute_name"), F.lit("missing_required_attribute").alias("validation_type"), F.lit("error").alias("severity"),
        _text("Required attribute '", field, "' is missing for category '", F.coalesce("category", F.lit("None")), "'.").alias("message"), _text("Present attribute '", field, "'").alias("expected"), F.lit("Missing").alias("actual"),
    )
    return own.unionByName(gone)


def quality_scores(products: DataFrame, attributes: DataFrame, evidence: DataFrame, issues: DataFrame) -> DataFrame:
    """completeness, confidence, evidence coverage, health and trust in one score, and the status it gives."""
    att = attributes.join(evidence.select("attribute_id").distinct().withColumn("has_evidence", F.lit(1)), "attribute_id", "left")
    att = att.groupBy("product_id").agg(F.avg("confidence").alias("conf"), F.avg(F.coalesce("has_evidence", F.lit(0))).alias("cov"))
    of = lambda s: F.count_if(F.col("severity") == s)
    iss = issues.groupBy("product_id").agg((30 * of("critical") + 15 * of("error") + 5 * of("warning")).alias("loss"), F.count_if(F.col("severity").isin("error", "critical")).alias("bad"))
    out = completeness(products, attributes).join(att, "product_id", "left").join(iss, "product_id", "left")
    health = F.greatest(F.lit(0.0), 100.0 - F.coalesce("loss", F.lit(0)))
    conf, cov = F.coalesce("conf", F.lit(0.8)) * 100, F.coalesce("cov", F.lit(0.0)) * 100
    score = 0.25 * F.col("completeness") + 0.25 * conf + 0.20 * cov + 0.15 * health + 0.15 * 90.0
    out = out.withColumn("quality", F.bround(F.round(score, 6), 1))
    return out.select("product_id", "completeness", "quality", F.when((F.coalesce("bad", F.lit(0)) > 0) | (F.col("quality") < 70), "needs_review").otherwise("verified").alias("new_status"))
