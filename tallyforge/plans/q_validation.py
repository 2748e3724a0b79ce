"""The query over all validation issues with what they say."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lookups as L
from ..operators import scoring as S
from ..operators import validate as X
from . import catalog as C
from .q_catalog import FIELDS

Q: dict = {}
_FORM = "'^([+-]?\\d+(?:\\.\\d+)?)\\s*([a-zA-Z°%/³]+)$'"
_SAY = {
    "voltage": "Voltage must be strictly positive (> 0)", "power": "Power must be strictly positive (> 0)", "speed": "Speed must be non-negative (>= 0)", "weight": "Weight must be strictly positive (> 0)",
    "frequency": "Frequency must be strictly positive (> 0)",
}
_BY_NAME = "CASE attribute_name {} END"
_LISTED = _BY_NAME.format(" ".join(f"WHEN '{c}' THEN {L.sql_text(str(sorted(L.CONCEPT_UNITS[c])))}" for c in C.ATTRIBUTES))
_FITS = _BY_NAME.format(" ".join(f"WHEN '{c}' THEN list_contains({L.sql_list(L.CONCEPT_UNITS[c])}, u)" for c in C.ATTRIBUTES))
_BOUND = _BY_NAME.format(" ".join(f"WHEN '{c}' THEN '{said}'" for c, said in _SAY.items()))

SQL = C.with_views("products claims attributes", f"""WITH {FIELDS},
mixed AS (SELECT attribute_id, product_id, attribute_name, CASE attribute_id % 9 WHEN 0 THEN '-3 V' WHEN 1 THEN '0' WHEN 2 THEN '5 furlong' WHEN 3 THEN '1,200.5' WHEN 4 THEN 'about 9' ELSE raw_value END AS raw_value,
  CASE WHEN attribute_id % 7 = 0 THEN 'kg' WHEN attribute_id % 7 = 1 THEN ' ' END AS unit, CASE WHEN attribute_id % 4 = 0 THEN 'text' ELSE 'numeric' END AS data_type,
  CASE WHEN attribute_id % 9 IN (0, 5) THEN CAST((attribute_id % 5) - 2 AS VARCHAR) WHEN attribute_id % 9 = 6 THEN split_part(raw_value, ' ', 1) END AS normalized_value, confidence, status FROM attributes),
m AS (SELECT *, coalesce(nullif(trim(unit), ''), nullif(regexp_extract(trim(raw_value), {_FORM}, 2), '')) AS own, coalesce(normalized_value, raw_value) AS chk FROM mixed),
n AS (SELECT *, coalesce({L.sql_map(L.UNIT_SYNONYMS)}[lower(trim(own))], own) AS u, CASE WHEN data_type = 'numeric' THEN TRY_CAST(replace(trim(chk), ',', '') AS DOUBLE) END AS num FROM m)
SELECT product_id, attribute_id, attribute_name, 'invalid_unit' AS validation_type, 'error' AS severity, format('Incompatible unit ''{{}}'' for attribute ''{{}}''. Expected one of {{}}.', own, attribute_name, {_LISTED}) AS message,
  'Compatible unit' AS expected, coalesce(nullif(trim(unit), ''), raw_value) AS actual FROM n WHERE own IS NOT NULL AND NOT {_FITS}
UNION ALL SELECT product_id, attribute_id, attribute_name, 'invalid_numeric_value', 'error', format('Attribute ''{{}}'' value ''{{}}'' cannot be parsed as a valid numeric number.', attribute_name, chk), 'Valid positive numeric value', chk FROM n WHERE data_type = 'numeric' AND num IS NULL
UNION ALL SELECT product_id, attribute_id, attribute_name, 'out_of_range', 'error', {_BOUND} || ', got ' || CAST(num AS VARCHAR) || '.', 'Valid positive numeric value', chk FROM n WHERE CASE WHEN attribute_name = 'speed' THEN num < 0 ELSE num <= 0 END
UNION ALL SELECT product_id, attribute_id, attribute_name, 'low_confidence', 'warning', format('Attribute ''{{}}'' has low extraction confidence ({{}}%).', attribute_name, CAST(round_even(confidence * 100, 0) AS BIGINT)), 'Confidence >= 60%', CAST(round_even(confidence * 100, 0) AS BIGINT) || '%' FROM n WHERE confidence < 0.6
UNION ALL SELECT product_id, attribute_id, attribute_name, 'cross_attribute_conflict', 'warning', format('Attribute ''{{}}'' has conflicting source values that require human resolution.', attribute_name), 'Single verified value', raw_value FROM n WHERE status = 'conflicting'
UNION ALL SELECT product_id, NULL, field, 'missing_required_attribute', 'error', format('Required attribute ''{{}}'' is missing for category ''{{}}''.', field, category), format('Present attribute ''{{}}''', field), 'Missing' FROM present JOIN products USING (product_id) WHERE is_required AND NOT present""")


def validation_issues(spark, d):
    """Attributes with values below zero, zero, foreign units, grouped digits and words, three in four numeric."""
    mixed = C.attributes(spark, d).selectExpr(
        "attribute_id", "product_id", "attribute_name", "CASE attribute_id % 9 WHEN 0 THEN '-3 V' WHEN 1 THEN '0' WHEN 2 THEN '5 furlong' WHEN 3 THEN '1,200.5' WHEN 4 THEN 'about 9' ELSE raw_value END AS raw_value",
        "CASE WHEN attribute_id % 7 = 0 THEN 'kg' WHEN attribute_id % 7 = 1 THEN ' ' END AS unit", "if(attribute_id % 4 = 0, 'text', 'numeric') AS data_type",
        "CASE WHEN attribute_id % 9 IN (0, 5) THEN cast((attribute_id % 5) - 2 AS string) WHEN attribute_id % 9 = 6 THEN split(raw_value, ' ')[0] END AS normalized_value", "confidence", "status",
    )
    return X.validation_issues(C.products(spark, d), mixed)


Q["validation_issues"] = (validation_issues, SQL)


def completeness_details(spark, d):
    """With the evidence of two attributes in three."""
    a = C.attributes(spark, d)
    out = X.completeness_details(C.products(spark, d), a, a.where("attribute_id % 3 <> 0").select("product_id", F.upper("attribute_name").alias("attribute_name")))
    return out.withColumn("missing", F.array_join("missing", ","))


_PLACES = "places(rule, field, place) AS (VALUES " + ", ".join(f"({L.sql_text(key)}, {L.sql_text(field)}, {i})" for key, lists in L.CATEGORY_RULES.items() for i, field in enumerate(lists[0])) + ")"
Q["completeness_details"] = (completeness_details, C.with_views("products claims attributes", f"""WITH {FIELDS}, {_PLACES}, s AS (SELECT product_id, count(*) FILTER (is_required AND present) AS rp, count(*) FILTER (is_required) AS rt, count(*) FILTER (NOT is_required AND present) AS op, count(*) FILTER (NOT is_required) AS ot,
  string_agg(CASE WHEN is_required AND NOT present THEN field END, ',' ORDER BY place) AS missing FROM present LEFT JOIN places USING (rule, field) GROUP BY 1), n AS (SELECT product_id, count(*) AS n, count(*) FILTER (attribute_id % 3 <> 0) AS b FROM attributes GROUP BY 1)
SELECT product_id, coalesce(rp, 0) AS required_present, coalesce(rt, 0) AS required_total, coalesce(op, 0) AS optional_present, coalesce(ot, 0) AS optional_total, coalesce(missing, '') AS missing, round_even(coalesce(100.0 * b / n, 0)::DOUBLE, 1) AS evidence_coverage,
  round_even(CASE WHEN rt > 0 THEN rp / rt * 70 + CASE WHEN ot > 0 THEN op / ot ELSE 0.5 END * 30 WHEN n IS NULL THEN 0 WHEN n >= 5 THEN 100 ELSE 50 + 10 * n END::DOUBLE, 1) AS completeness FROM products LEFT JOIN s USING (product_id) LEFT JOIN n USING (product_id)"""))


def description_check(spark, d):
    """Every whole text as a description, its lines as features, against a few words that are verified."""
    lines = F.split("text", "\n")
    rows = C.table(spark, d, "documents").select("doc_id", "text", F.expr("concat(doc_id, ' 10 24.5 IP65 ul listed ', source)").alias("verified"), lines.alias("features"), F.array("source").alias("applications"))
    c = F.col("checked")
    out = S.check_claims(rows, "text", "verified", "features", "applications")
    return out.select("doc_id", c["valid"].alias("valid"), F.size(c["unsupported"]).cast("long").alias("n_unsupported"), c["supported"].alias("supported"), c["total"].alias("total"), F.size(c["clean_features"]).cast("long").alias("n_clean"), F.sha2(F.array_join(c["unsupported"], "|"), 256).alias("unsupported_sha256"))


_NUMBER = "'\\b\\d+(?:\\.\\d+)?\\b'"
_NAMED = "[" + ", ".join(f"'{r}'" for r in S.RATINGS) + "]"
Q["description_check"] = (description_check, f"""WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS said, lower(doc_id || ' 10 24.5 IP65 ul listed ' || source) AS own, string_split(text, chr(10)) AS features FROM documents),
n AS (SELECT *, regexp_extract_all(said, {_NUMBER}) AS ns, regexp_extract_all(own, {_NUMBER}) AS known FROM d),
w AS (SELECT *, list_filter(ns, lambda x: NOT list_contains(known, x)) AS wrong, list_filter({_NAMED}, lambda r: contains(said, r) AND NOT contains(own, r)) AS named,
  coalesce(list_filter(list_transform(features, lambda f: {{'f': f, 'n': list_filter(regexp_extract_all(lower(f), {_NUMBER}), lambda x: NOT list_contains(known, x))[1]}}), lambda s: s.n IS NOT NULL), []) AS bad, coalesce(len(features), 0) AS nf FROM n),
t AS (SELECT *, list_concat(list_concat(list_transform(wrong, lambda x: 'Unsupported numeric spec claim: ''' || x || ''' found in description.'), list_transform(named, lambda r: 'Unsupported certification/rating claim: ''' || r || ''' in AI text.')),
  list_transform(bad, lambda s: 'Unsupported feature claim: ''' || s.f || ''' contains unverified number ''' || s.n || '''.')) AS told FROM w)
SELECT doc_id, len(told) = 0 AS valid, len(told) AS n_unsupported, len(ns) - len(wrong) + nf - len(bad) + 1 AS supported, greatest(1, len(ns) + len(named) + nf + 1) AS total, nf - len(bad) AS n_clean, sha256(array_to_string(told, '|')) AS unsupported_sha256 FROM t""")
