"""Queries over the catalog: reconciliation, validation, reports, reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lookups as L
from ..operators import maintain as M
from ..operators import reconcile as R
from ..operators import reports as P
from ..operators import validate as X
from . import catalog as C
from .q_values import KEYED

Q: dict = {}


def query(name: str, views: str, sql: str):
    def put(f):
        Q[name] = (f, C.with_views(views, sql) if views else sql)
        return f

    return put


PARSED = """parsed AS (SELECT *, round_even(CAST(split_part(raw_value, ' ', 1) AS DOUBLE) * CASE split_part(raw_value, ' ', 2)
    WHEN 'kW' THEN 1000.0 WHEN 'kV' THEN 1000.0 WHEN 'kHz' THEN 1000.0 WHEN 'g' THEN 0.001 ELSE 1.0 END, 6) AS num, lower(raw_value) AS text FROM claims),
win AS (SELECT product_id, attribute_name, source_id AS winner, raw_value AS winning_value, trust AS win_trust, num AS win_num, text AS win_text FROM (SELECT *, row_number() OVER (PARTITION BY product_id, attribute_name ORDER BY trust DESC, source_id) AS rn FROM parsed) WHERE rn = 1)"""
RECONCILED = f"""{PARSED},
declared AS (SELECT product_id, ['power', 'voltage', 'speed', 'weight', 'frequency', 'model'][j + 1] AS attribute_name, CASE WHEN j = 5 THEN model ELSE product_name END AS own_value, (40 + (product_id * 7 + j * 13) % 61) / 100.0 AS own
  FROM products, range(6) t(j)),
agg AS (SELECT product_id, attribute_name, count(*) AS n_claims, count(DISTINCT source_id) AS n_sources, bool_and(abs(num - win_num) <= 1e-5) AS same, bool_and(text = win_text) AS same_text, min(winner) AS winner, min(winning_value) AS winning_value, min(win_trust) AS win_trust FROM parsed JOIN win USING (product_id, attribute_name) GROUP BY 1, 2),
rec AS (SELECT product_id, attribute_name, coalesce(n_claims, 1) AS n_claims, winner, coalesce(winning_value, own_value) AS winning_value,
  CASE WHEN coalesce(n_claims, 1) = 1 THEN 'MISSING' WHEN same AND same_text THEN 'AGREEMENT' WHEN same THEN 'EQUIVALENT' ELSE 'CONFLICTING' END AS status,
  round_even(CASE WHEN n_claims IS NULL THEN own WHEN n_claims = 1 THEN win_trust * own WHEN same THEN least(1.0::DOUBLE, win_trust + 0.05 * (n_sources - 1)) ELSE greatest(0.2::DOUBLE, win_trust - 0.25) END, 4) AS confidence
  FROM declared LEFT JOIN agg USING (product_id, attribute_name))"""


def exact_mean_sql(x: str, digits: int) -> str:
    """The mean of ``digits`` decimals, half-even to as many, from whole numbers."""
    s = f"sum(CAST(round({x} * {10**digits}) AS BIGINT))"
    n = f"count({x})"
    return f"(({s} // {n}) + CASE WHEN 2 * ({s} % {n}) > {n} OR (2 * ({s} % {n}) = {n} AND ({s} // {n}) % 2 = 1) THEN 1 ELSE 0 END) / {10**digits}.0::DOUBLE"


def declared(spark, d):
    """The attributes that each product has in the catalog, with a confidence; nobody claims a model."""
    j = F.posexplode(F.array(*[F.lit(x) for x in (*C.ATTRIBUTES, "model")])).alias("j", "attribute_name")
    rows = C.products(spark, d).select("product_id", "product_name", "model", j)
    confidence = (40 + (F.col("product_id") * 7 + F.col("j") * 13) % 61) / 100
    return rows.select("product_id", "attribute_name", F.when(F.col("j") == 5, F.col("model")).otherwise(F.col("product_name")).alias("raw_value"), confidence.alias("confidence"))


def _reconciled(spark, d):
    return R.reconcile(C.claims(spark, d), declared(spark, d))


@query("reconcile_claims", "products claims", f"WITH {RECONCILED} SELECT * FROM rec")
def reconcile_claims(spark, d):
    return _reconciled(spark, d)


@query("reconciliation_summary", "products claims", f"""WITH {RECONCILED} SELECT product_id, count(*) AS attributes, count(*) FILTER (status = 'AGREEMENT') AS agreement, count(*) FILTER (status = 'EQUIVALENT') AS equivalent,
  count(*) FILTER (status = 'MISSING') AS missing, count(*) FILTER (status = 'CONFLICTING') AS conflicting, {exact_mean_sql("confidence", 4)} AS mean_confidence FROM rec GROUP BY 1""")
def reconciliation_summary(spark, d):
    return R.summary(_reconciled(spark, d))


@query("reconciliation_filter", "products claims", f"WITH {RECONCILED} SELECT product_id, attribute_name, confidence FROM rec WHERE status = 'CONFLICTING'")
def reconciliation_filter(spark, d):
    return _reconciled(spark, d).where("status = 'CONFLICTING'").select("product_id", "attribute_name", "confidence")


@query("winning_claim", "claims attributes", "SELECT product_id, attribute_name, source_id, raw_value FROM attributes")
def winning_claim(spark, d):
    return R.winning_claims(R.parse_claims(C.claims(spark, d))).select("product_id", "attribute_name", "source_id", "raw_value")


@query("competing_claims", "claims", f"""WITH {PARSED}, odd AS (SELECT product_id, attribute_name FROM parsed JOIN win USING (product_id, attribute_name) GROUP BY 1, 2 HAVING bool_or(abs(num - win_num) > 1e-5))
SELECT product_id, attribute_name, source_id, raw_value, trust, winning_value FROM parsed JOIN odd USING (product_id, attribute_name) JOIN win USING (product_id, attribute_name) WHERE source_id <> winner""")
def competing_claims(spark, d):
    return R.competing_claims(C.claims(spark, d))


@query("conflict_issues", "products claims", f"WITH {RECONCILED} SELECT product_id, attribute_name, 'cross_source_conflict' AS validation_type, winning_value AS expected FROM rec WHERE status = 'CONFLICTING'")
def conflict_issues(spark, d):
    return _reconciled(spark, d).where("status = 'CONFLICTING'").select("product_id", "attribute_name", F.lit("cross_source_conflict").alias("validation_type"), F.col("winning_value").alias("expected"))


FIELDS = f"""{KEYED}, {X.RULES_SQL},
field AS (SELECT DISTINCT k.product_id, k.rule, r.field, r.is_required FROM keyed k JOIN rules r USING (rule)),
have AS (SELECT DISTINCT a.product_id, r.field FROM attributes a JOIN (SELECT DISTINCT field, name FROM rules) r ON r.name = replace(lower(a.attribute_name), ' ', '_')),
present AS (SELECT f.*, h.field IS NOT NULL AS present FROM field f LEFT JOIN have h ON h.product_id = f.product_id AND h.field = f.field)"""
_COMPLETE = f"""{FIELDS},
shares AS (SELECT product_id, coalesce(count(*) FILTER (present AND is_required) / nullif(count(*) FILTER (is_required), 0), 1.0::DOUBLE) AS req,
  coalesce(count(*) FILTER (present AND NOT is_required) / nullif(count(*) FILTER (NOT is_required), 0), 1.0::DOUBLE) AS opt, count(*) FILTER (is_required) AS n_required FROM present GROUP BY 1),
n AS (SELECT product_id, count(*) AS n FROM attributes GROUP BY 1),
complete AS (SELECT product_id, coalesce(n.n, 0) AS n, round_even(CASE WHEN n_required > 0 THEN req * 70 + opt * 30 WHEN coalesce(n.n, 0) = 0 THEN 0 WHEN n.n >= 5 THEN 100 ELSE 50 + 10.0 * n.n END::DOUBLE, 1) AS completeness
  FROM products LEFT JOIN shares USING (product_id) LEFT JOIN n USING (product_id))"""


@query("missing_attributes", "products claims attributes", f"WITH {FIELDS} SELECT product_id, rule, field FROM present WHERE is_required AND NOT present")
def missing_attributes(spark, d):
    return X.missing_attributes(C.products(spark, d), C.attributes(spark, d))


@query("completeness", "products claims attributes", f"WITH {_COMPLETE} SELECT * FROM complete")
def completeness(spark, d):
    return X.completeness(C.products(spark, d), C.attributes(spark, d))


_CONCEPT = "attribute_name"
_UNIT = f"coalesce({L.sql_map(L.UNIT_SYNONYMS)}[lower(regexp_extract(raw_value, '^([+-]?\\d+(?:\\.\\d+)?)\\s*([a-zA-Z°%/³]+)$', 2))], nullif(regexp_extract(raw_value, '^([+-]?\\d+(?:\\.\\d+)?)\\s*([a-zA-Z°%/³]+)$', 2), ''))"
_FITS = "CASE attribute_name " + " ".join(f"WHEN '{c}' THEN list_contains({L.sql_list(L.CONCEPT_UNITS[c])}, u)" for c in C.ATTRIBUTES) + " END"


@query("unit_check", "claims attributes", f"SELECT attribute_id, {_CONCEPT} AS concept, u AS unit, CASE WHEN u IS NULL THEN 'missing_unit' WHEN {_FITS} THEN 'ok' ELSE 'invalid_unit' END AS outcome FROM (SELECT *, {_UNIT} AS u FROM attributes)")
def unit_check(spark, d):
    return X.check_units(C.attributes(spark, d))


@query("range_check", "", """
SELECT event_id, CASE WHEN NOT regexp_matches(v, '^[+-]?\\d+(\\.\\d+)?$') THEN 'invalid_numeric_value'
  WHEN CASE n WHEN 'rated voltage' THEN CAST(v AS DOUBLE) <= 0 WHEN 'motor speed' THEN CAST(v AS DOUBLE) < 0 WHEN 'efficiency' THEN CAST(v AS DOUBLE) < 0 OR CAST(v AS DOUBLE) > 100 ELSE CAST(v AS DOUBLE) < 0 END THEN 'out_of_range' END AS range_issue
FROM (SELECT event_id, ['rated voltage', 'motor speed', 'efficiency', 'length'][event_id % 4 + 1] AS n, CASE event_id % 7 WHEN 0 THEN '0' WHEN 1 THEN '-5' WHEN 2 THEN '5d' ELSE CAST(event_id AS VARCHAR) END AS v FROM events)""")
def range_check(spark, d):
    rows = C.table(spark, d, "events").selectExpr("event_id", "element_at(array('rated voltage', 'motor speed', 'efficiency', 'length'), cast(event_id % 4 + 1 as int)) AS attribute_name", "CASE event_id % 7 WHEN 0 THEN '0' WHEN 1 THEN '-5' WHEN 2 THEN '5d' ELSE string(event_id) END AS value")
    return X.check_ranges(rows).select("event_id", "range_issue")


_VALID = f"""{FIELDS}, a AS (SELECT *, {_UNIT} AS u FROM attributes),
found AS (SELECT product_id, attribute_name AS subject, 'invalid_unit' AS validation_type, 'error' AS severity FROM a WHERE u IS NOT NULL AND NOT {_FITS}
  UNION ALL SELECT product_id, attribute_name, 'low_confidence', 'warning' FROM a WHERE confidence < 0.6
  UNION ALL SELECT product_id, attribute_name, 'cross_source_conflict', 'warning' FROM a WHERE status = 'conflicting'
  UNION ALL SELECT product_id, field, 'missing_required_attribute', 'error' FROM present WHERE is_required AND NOT present)"""


@query("validate_catalog", "products claims attributes", f"WITH {_VALID} SELECT * FROM found")
def validate_catalog(spark, d):
    return X.validate_catalog(C.products(spark, d), C.attributes(spark, d))


def _evidence(spark, d):
    return C.attributes(spark, d).where("attribute_id % 3 <> 0").select("attribute_id", "source_id")


_QUALITY = f"""{_COMPLETE},
att AS (SELECT product_id, avg(confidence) AS conf, avg((attribute_id % 3 <> 0)::INT) AS cov FROM attributes GROUP BY 1),
iss AS (SELECT product_id, 30 * count(*) FILTER (severity = 'critical') + 15 * count(*) FILTER (severity = 'error') + 5 * count(*) FILTER (severity = 'warning') AS loss, count(*) FILTER (severity IN ('error', 'critical')) AS bad FROM issues GROUP BY 1),
q AS (SELECT product_id, completeness, coalesce(bad, 0) AS bad, round_even(round(0.25 * completeness + 0.25 * (coalesce(conf, 0.8) * 100) + 0.20 * (coalesce(cov, 0.0) * 100) + 0.15 * greatest(0.0::DOUBLE, 100.0 - coalesce(loss, 0)) + 0.15 * 90.0, 6), 1) AS quality
  FROM complete LEFT JOIN att USING (product_id) LEFT JOIN iss USING (product_id))"""


@query("quality_score", "products claims attributes issues", f"WITH {_QUALITY} SELECT product_id, completeness, quality, CASE WHEN bad > 0 OR quality < 70 THEN 'needs_review' ELSE 'verified' END AS new_status FROM q")
def quality_score(spark, d):
    return X.quality_scores(C.products(spark, d), C.attributes(spark, d), _evidence(spark, d), C.issues(spark, d))


@query("evidence_names", "claims attributes", "SELECT product_id, attribute_name FROM attributes WHERE attribute_id % 3 <> 0")
def evidence_names(spark, d):
    return C.attributes(spark, d).join(_evidence(spark, d), "attribute_id", "left_semi").select("product_id", "attribute_name")


@query("catalog_health_overall", "products claims attributes", f"""WITH {_COMPLETE}
SELECT (SELECT count(*) FROM products) AS products, (SELECT round_even(avg(quality_score), 1) FROM products) AS avg_quality, (SELECT round_even(100.0 * count(*) FILTER (status = 'verified') / count(*), 1) FROM products) AS verification_rate,
  (SELECT {exact_mean_sql("completeness", 1)} FROM complete) AS avg_completeness, (SELECT count(*) FROM attributes) AS attributes, (SELECT round_even(100.0 * count(*) FILTER (attribute_id % 3 <> 0) / count(*), 1) FROM attributes) AS evidence_coverage""")
def catalog_health_overall(spark, d):
    a = C.attributes(spark, d)
    return P.health_overall(C.products(spark, d), X.completeness(C.products(spark, d), a), a, _evidence(spark, d))


@query("status_breakdown", "products", "SELECT count(*) FILTER (status = 'verified') AS verified, count(*) FILTER (status = 'needs_review') AS needs_review, count(*) FILTER (status = 'draft') AS draft FROM products")
def status_breakdown(spark, d):
    return C.products(spark, d).agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("verified", "needs_review", "draft")])


@query("issues_summary", "claims attributes issues", """SELECT (SELECT count(*) FROM issues WHERE status = 'open' AND validation_type = 'cross_source_conflict') + (SELECT count(*) FROM attributes WHERE status = 'conflicting') AS conflicts,
  (SELECT count(*) FROM issues WHERE status = 'open' AND validation_type = 'missing_required_attribute') AS missing, (SELECT count(*) FROM issues WHERE status = 'open' AND validation_type NOT IN ('cross_source_conflict', 'missing_required_attribute')) AS other,
  (SELECT count(*) FROM attributes WHERE confidence < 0.75 OR status IN ('needs_review', 'conflicting')) AS low_confidence""")
def issues_summary(spark, d):
    return P.issues_summary(C.issues(spark, d), C.attributes(spark, d))


def _group_sql(key: str) -> str:
    return f"""WITH {_COMPLETE}, i AS (SELECT product_id, count(*) AS oi FROM issues WHERE status = 'open' GROUP BY 1), c AS (SELECT product_id, count(*) AS oc FROM attributes WHERE status = 'conflicting' GROUP BY 1)
SELECT p.{key}, count(*) AS products, round_even(avg(quality_score), 1) AS avg_quality, round_even(100.0 * count(*) FILTER (status = 'verified') / count(*), 1) AS verification_rate, {exact_mean_sql("completeness", 1)} AS avg_completeness,
  CAST(coalesce(sum(oi), 0) AS BIGINT) AS open_issues, CAST(coalesce(sum(oc), 0) AS BIGINT) AS conflicts FROM products p LEFT JOIN complete USING (product_id) LEFT JOIN i USING (product_id) LEFT JOIN c USING (product_id) GROUP BY 1"""


@query("category_health", "products claims attributes issues", _group_sql("category"))
def category_health(spark, d):
    p, a = C.products(spark, d), C.attributes(spark, d)
    return P.group_health(p, X.completeness(p, a), C.issues(spark, d), a, "category")


@query("brand_health", "products claims attributes issues", _group_sql("brand"))
def brand_health(spark, d):
    p, a = C.products(spark, d), C.attributes(spark, d)
    return P.group_health(p, X.completeness(p, a), C.issues(spark, d), a, "brand")


@query("health_sorted", "products", "SELECT brand, round_even(avg(quality_score), 1) AS avg_quality FROM products GROUP BY 1 ORDER BY 2 DESC, 1")
def health_sorted(spark, d):
    return C.products(spark, d).groupBy("brand").agg(F.bround(F.avg("quality_score"), 1).alias("avg_quality")).orderBy(F.desc("avg_quality"), "brand")


@query("review_counts", "claims attributes issues products", """WITH c AS (SELECT CASE WHEN validation_type = 'cross_source_conflict' THEN 'conflict' WHEN validation_type = 'missing_required_attribute' THEN 'missing' WHEN validation_type = 'low_confidence' THEN 'low_confidence' ELSE 'validation_issue' END AS issue_class FROM issues WHERE status = 'open')
SELECT issue_class, count(*) AS n FROM c GROUP BY 1""")
def review_counts(spark, d):
    from ..functions.values import issue_class

    none = F.lit(None)
    return C.issues(spark, d).where("status = 'open'").groupBy(issue_class(F.col("validation_type"), none.cast("string"), none.cast("double")).alias("issue_class")).agg(F.count("*").alias("n"))


@query("attention_queue", "products claims attributes issues", """WITH i AS (SELECT product_id, count(*) AS n, bool_or(validation_type = 'cross_source_conflict') AS ic FROM issues WHERE status = 'open' GROUP BY 1),
x AS (SELECT p.product_id, p.status, coalesce(ic, false) OR EXISTS (SELECT 1 FROM attributes a WHERE a.product_id = p.product_id AND a.status = 'conflicting') AS has_conflict, quality_score, coalesce(n, 0) AS open_issues FROM products p LEFT JOIN i USING (product_id))
SELECT * FROM x WHERE status = 'needs_review' OR quality_score < 70 OR open_issues > 0 ORDER BY status = 'needs_review' DESC, has_conflict DESC, quality_score, open_issues DESC, product_id LIMIT 10""")
def attention_queue(spark, d):
    return P.attention_queue(C.products(spark, d), C.issues(spark, d), C.attributes(spark, d))


@query("worst_products", "products", "SELECT product_id, quality_score, updated_at FROM products ORDER BY quality_score, updated_at DESC, product_id LIMIT 10")
def worst_products(spark, d):
    return C.products(spark, d).orderBy("quality_score", F.desc("updated_at"), "product_id").limit(10).select("product_id", "quality_score", "updated_at")


@query("recent_products", "products", "SELECT product_id, sku, updated_at FROM products ORDER BY updated_at DESC, product_id LIMIT 10")
def recent_products(spark, d):
    return C.products(spark, d).orderBy(F.desc("updated_at"), "product_id").limit(10).select("product_id", "sku", "updated_at")


@query("review_queue", "products claims attributes issues", """SELECT validation_id, i.product_id, severity, CASE WHEN validation_type = 'cross_source_conflict' OR a.status = 'conflicting' THEN 'conflict' WHEN validation_type = 'missing_required_attribute' THEN 'missing' WHEN validation_type = 'low_confidence' OR confidence < 0.75 OR a.status = 'needs_review' THEN 'low_confidence' ELSE 'validation_issue' END AS issue_class, attribute_name, i.created_at
FROM issues i JOIN products USING (product_id) LEFT JOIN attributes a USING (attribute_id) WHERE i.status = 'open' AND (contains(lower(product_name), 'red') OR contains(lower(sku), 'red') OR contains(lower(brand), 'red') OR contains(lower(attribute_name), 'red') OR contains(lower(message), 'red'))
ORDER BY CASE severity WHEN 'critical' THEN 4 WHEN 'error' THEN 3 WHEN 'warning' THEN 2 ELSE 1 END DESC, validation_id LIMIT 20 OFFSET 20""")
def review_queue(spark, d):
    return P.review_queue(C.issues(spark, d), C.products(spark, d), C.attributes(spark, d), search="red", page=2)


@query("issue_context", "products sources claims attributes issues", """SELECT i.validation_id, p.sku, a.attribute_name, a.raw_value, s.source_name FROM issues i JOIN products p USING (product_id) LEFT JOIN attributes a ON a.attribute_id = i.attribute_id LEFT JOIN sources s ON s.source_id = a.source_id""")
def issue_context(spark, d):
    a = C.attributes(spark, d).select("attribute_id", "attribute_name", "raw_value", "source_id")
    return C.issues(spark, d).join(C.products(spark, d).select("product_id", "sku"), "product_id").join(a, "attribute_id", "left").join(C.sources(spark, d), "source_id", "left").select("validation_id", "sku", "attribute_name", "raw_value", "source_name")


@query("latest_step_per_job", "steps", "SELECT job_id, arg_max(step_id, struct_pack(a := created_at, b := step_id)) AS step_id, arg_max(stage, struct_pack(a := created_at, b := step_id)) AS stage FROM steps GROUP BY 1")
def latest_step_per_job(spark, d):
    return M.latest(C.steps(spark, d).select("job_id", "step_id", "stage", "created_at"), ["job_id"], "created_at", "step_id").select("job_id", "step_id", "stage")


@query("best_attribute_per_name", "claims attributes", "SELECT product_id, attribute_name, raw_value FROM attributes")
def best_attribute_per_name(spark, d):
    rows = C.claims(spark, d).withColumn("rank", -F.col("source_id"))
    return M.latest(rows, ["product_id", "attribute_name"], "trust", "rank").select("product_id", "attribute_name", "raw_value")


@query("first_claim_per_source", "claims", "SELECT product_id, source_id, attribute_name, raw_value FROM claims")
def first_claim_per_source(spark, d):
    return C.claims(spark, d).select("product_id", "source_id", "attribute_name", "raw_value")


@query("attribute_visible", "claims attributes", "SELECT attribute_id, attribute_name FROM attributes WHERE NOT regexp_matches(CASE WHEN attribute_id % 9 = 0 THEN ' 12.5 ' ELSE attribute_name END, '^\\s*\\d+(?:\\.\\d+)?\\s*$')")
def attribute_visible(spark, d):
    shown = F.when(F.col("attribute_id") % 9 == 0, " 12.5 ").otherwise(F.col("attribute_name"))
    return C.attributes(spark, d).where(~shown.rlike(r"^\s*\d+(?:\.\d+)?\s*$")).select("attribute_id", "attribute_name")
