"""Queries over listings, lookups, claim scoring, search and index upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lookups as L
from ..functions import values as V
from ..operators import maintain as M
from ..operators import match as K
from ..operators import reconcile as R
from ..operators import scoring as S
from ..storage import dealt_by_size
from . import catalog as C
from .q_catalog import RECONCILED

Q: dict = {}


def query(name: str, views: str, sql: str | None):
    def put(f):
        Q[name] = (f, (C.with_views(views, sql) if views else sql) if sql else None)
        return f

    return put


@query("text_to_pages", "", "SELECT doc_id, 1 AS page_number, length(text) AS n_chars FROM documents")
def text_to_pages(spark, d):
    pages = S.text_to_pages(C.table(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content")))
    return pages.select("doc_id", F.explode("pages").alias("p")).select("doc_id", "p.page_number", F.length("p.text").cast("long").alias("n_chars"))


@query("content_hash", "", "SELECT p_partkey AS product_id, sha256('{\"brand\":\"' || p_brand || '\",\"name\":\"' || p_name || '\",\"size\":' || p_size || '}') AS content_hash FROM part")
def content_hash(spark, d):
    return C.table(spark, d, "part").select(F.col("p_partkey").alias("product_id"), S.content_hash(name=F.col("p_name"), size=F.col("p_size"), brand=F.col("p_brand")).alias("content_hash"))


@query("explode_tables", "", "SELECT p_partkey AS document_id, r AS row_number, ['Brand', 'Type', 'Name'][r] AS k, CASE r WHEN 1 THEN p_brand WHEN 2 THEN p_type ELSE p_name END AS v FROM part, range(1, 4) t(r)")
def explode_tables(spark, d):
    rows = F.array(*[F.array(F.lit(k), F.col(c)) for k, c in (("Brand", "p_brand"), ("Type", "p_type"), ("Name", "p_name"))])
    return C.table(spark, d, "part").select(F.col("p_partkey").alias("document_id"), F.posexplode(rows).alias("i", "r")).select("document_id", (F.col("i") + 1).cast("long").alias("row_number"), F.col("r")[0].alias("k"), F.col("r")[1].alias("v"))


@query("attributes_by_product", "claims attributes", "SELECT product_id, attribute_name, raw_value, confidence FROM attributes ORDER BY product_id, attribute_name")
def attributes_by_product(spark, d):
    return C.attributes(spark, d).select("product_id", "attribute_name", "raw_value", "confidence").orderBy("product_id", "attribute_name")


@query("validations_by_product", "claims attributes issues", "SELECT product_id, validation_id, severity FROM issues WHERE status = 'open'")
def validations_by_product(spark, d):
    return C.issues(spark, d).where("status = 'open'").select("product_id", "validation_id", "severity")


@query("versions_by_product", "", "SELECT l_partkey AS product_id, l_shipdate AS changed_at, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate) AS version_number FROM (SELECT DISTINCT l_partkey, l_shipdate FROM lineitem)")
def versions_by_product(spark, d):
    from pyspark.sql import Window

    changes = C.table(spark, d, "lineitem").select(F.col("l_partkey").alias("product_id"), F.col("l_shipdate").alias("changed_at")).distinct()
    return changes.withColumn("version_number", F.row_number().over(Window.partitionBy("product_id").orderBy("changed_at")).cast("long"))


@query("duplicates_of", "", "SELECT DISTINCT l_partkey AS product_id, l_suppkey AS other_id FROM lineitem WHERE l_partkey <> l_suppkey UNION SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_partkey <> l_suppkey")
def duplicates_of(spark, d):
    lines = C.table(spark, d, "lineitem")
    p = lines.where("l_partkey <> l_suppkey")
    both = F.explode(F.array(F.struct(F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("other_id")), F.struct(F.col("l_suppkey").alias("product_id"), F.col("l_partkey").alias("other_id"))))
    return dealt_by_size(p.select(both.alias("x")).select("x.*"), 2 * lines.count(), "product_id", "other_id").distinct()


@query("evidence_for_product", "claims attributes", "SELECT a.product_id, a.attribute_id, c.source_id, c.raw_value FROM claims c JOIN attributes a ON a.product_id = c.product_id AND a.attribute_name = c.attribute_name")
def evidence_for_product(spark, d):
    a = C.attributes(spark, d).select("product_id", "attribute_name", "attribute_id")
    return C.claims(spark, d).join(a, ["product_id", "attribute_name"]).select("product_id", "attribute_id", "source_id", "raw_value")


@query("evidence_of_attribute", "claims", "SELECT product_id, source_id, raw_value FROM claims WHERE attribute_name = 'voltage'")
def evidence_of_attribute(spark, d):
    return C.claims(spark, d).where("attribute_name = 'voltage'").select("product_id", "source_id", "raw_value")


_JSON = "CASE event_id % 3 WHEN 0 THEN '{\"name\": \"' || event_type || '\", \"value\": \"' || event_id || '\"}' WHEN 1 THEN '{\"specification\": \"' || event_type || '\", \"val\": \"' || event_id || '\", \"data_type\": \"numeric\"}' ELSE '{\"key\": \" \", \"value\": 1}' END"


@query("attribute_types_from_json", "", "SELECT event_id, event_type AS name, CAST(event_id AS VARCHAR) AS value, CASE event_id % 3 WHEN 1 THEN 'numeric' ELSE 'text' END AS data_type, 'llm' AS extraction_method FROM events WHERE event_id % 3 <> 2")
def attribute_types_from_json(spark, d):
    return S.attributes_from_json(C.table(spark, d, "events").select("event_id", F.expr(_JSON).alias("raw")), "raw")


@query("records_with_enrichment", "products jobs", "SELECT p.product_id, j.status FROM products p JOIN jobs j ON j.job_id = p.product_id WHERE j.status = 'completed'")
def records_with_enrichment(spark, d):
    j = C.jobs(spark, d).where("status = 'completed'").select(F.col("job_id").alias("product_id"), F.col("status").alias("s"))
    return C.products(spark, d).select("product_id").join(j, "product_id").select("product_id", F.col("s").alias("status"))


@query("overview_review_summary", "products claims attributes issues", "SELECT (SELECT count(*) FROM issues WHERE status = 'open') AS open_issues, (SELECT count(*) FROM issues WHERE status = 'open' AND validation_type = 'cross_source_conflict') + (SELECT count(*) FROM attributes WHERE status = 'conflicting') AS conflicts, (SELECT count(*) FROM attributes WHERE confidence < 0.75) AS low_confidence, (SELECT count(*) FROM products WHERE status = 'needs_review') AS needs_review")
def overview_review_summary(spark, d):
    i = C.issues(spark, d).where("status = 'open'").agg(F.count("*").alias("open_issues"), F.count_if(F.col("validation_type") == "cross_source_conflict").alias("c"))
    a = C.attributes(spark, d).agg(F.count_if(F.col("status") == "conflicting").alias("ac"), F.count_if(F.col("confidence") < 0.75).alias("low_confidence"))
    p = C.products(spark, d).agg(F.count_if(F.col("status") == "needs_review").alias("needs_review"))
    return i.crossJoin(a).crossJoin(p).select("open_issues", (F.col("c") + F.col("ac")).alias("conflicts"), "low_confidence", "needs_review")  # one row each


@query("overview_quality_summary", "products claims attributes", "SELECT (SELECT count(*) FROM products WHERE status = 'verified') AS verified, (SELECT count(*) FROM products WHERE status = 'needs_review' OR quality_score < 70) AS attention, (SELECT round_even(100.0 * count(*) FILTER (attribute_id % 3 <> 0) / count(*), 1) FROM attributes) AS evidence_coverage, (SELECT round_even(avg(quality_score), 1) FROM products) AS completeness_rate")
def overview_quality_summary(spark, d):
    p = C.products(spark, d).agg(F.count_if(F.col("status") == "verified").alias("verified"), F.count_if((F.col("status") == "needs_review") | (F.col("quality_score") < 70)).alias("attention"), F.bround(F.avg("quality_score"), 1).alias("completeness_rate"))
    return p.crossJoin(C.attributes(spark, d).agg(F.bround(100.0 * F.try_divide(F.count_if(F.col("attribute_id") % 3 != 0), F.count("*")), 1).alias("evidence_coverage")))  # one row each


@query("compliance_scorecard", "", "SELECT round_even(100.0 * count(*) FILTER (p_partkey % 3 <> 0) / count(*), 1) AS upper_rate, round_even(100.0 * count(*) FILTER (p_partkey % 4 <> 0) / count(*), 1) AS length_rate FROM part")
def compliance_scorecard(spark, d):
    flags = F.expr("filter(array(if(p_partkey % 3 = 0, 'not uppercase', null), if(p_partkey % 4 = 0, 'exceeds limit', null)), x -> x is not null)")
    clean = lambda *words: F.bround(F.coalesce(100.0 * F.try_divide(F.count_if(~F.exists("flags", lambda x: F.greatest(*[x.contains(w) for w in (*words, words[0])]))), F.count("*")), F.lit(100.0)), 1)
    return C.table(spark, d, "part").select(flags.alias("flags")).agg(clean("uppercase").alias("upper_rate"), clean("limit", "exceeds").alias("length_rate"))


@query("index_summary", "", "SELECT count(*) AS total, count(*) FILTER (len(embedding) = 64) AS indexed, count(*) FILTER (len(embedding) <> 64) AS failed FROM embeddings")
def index_summary(spark, d):
    return C.table(spark, d, "embeddings").agg(F.count("*").alias("total"), F.count_if(F.size("embedding") == 64).alias("indexed"), F.count_if(F.size("embedding") != 64).alias("failed"))


@query("latest_step_per_document", "jobs steps", "WITH t AS (SELECT job_id, status, created_at FROM jobs ORDER BY created_at DESC, job_id LIMIT 10), s AS (SELECT job_id, arg_max(stage, struct_pack(a := created_at, b := step_id)) AS stage FROM steps GROUP BY 1) SELECT t.job_id, coalesce(s.stage, t.status) AS stage FROM t LEFT JOIN s USING (job_id)")
def latest_step_per_document(spark, d):
    top = C.jobs(spark, d).orderBy(F.desc("created_at"), "job_id").limit(10).select("job_id", "status")
    last = M.latest(C.steps(spark, d).select("job_id", "stage", "created_at", "step_id"), ["job_id"], "created_at", "step_id")
    return top.join(last, "job_id", "left").select("job_id", F.coalesce("stage", "status").alias("stage"))


@query("latest_enrichment", "steps", "SELECT job_id AS product_id, arg_max(CAST(json_extract_string(props, '$.k') AS BIGINT), struct_pack(a := ts, b := event_id)) AS k FROM (SELECT user_id AS job_id, props, ts, event_id FROM events) GROUP BY 1")
def latest_enrichment(spark, d):
    e = C.table(spark, d, "events").select(F.col("user_id").alias("product_id"), F.get_json_object("props", "$.k").cast("long").alias("k"), "ts", "event_id")
    return M.latest(e, ["product_id"], "ts", "event_id").select("product_id", "k")


@query("attribute_dedupe_latest", "", "SELECT l_partkey AS product_id, l_linenumber AS attribute, arg_max(l_extendedprice, struct_pack(a := l_shipdate, b := l_orderkey, c := l_extendedprice)) AS value FROM lineitem GROUP BY 1, 2")
def attribute_dedupe_latest(spark, d):
    rows = C.table(spark, d, "lineitem").select(F.col("l_partkey").alias("product_id"), F.col("l_linenumber").alias("attribute"), F.col("l_extendedprice").alias("value"), "l_shipdate", "l_orderkey")
    return M.latest(rows, ["product_id", "attribute"], "l_shipdate", "l_orderkey", "value").select("product_id", "attribute", "value")


@query("last_audit_per_issue", "", "SELECT user_id AS issue_id, arg_max(json_extract_string(props, '$.k'), struct_pack(a := ts, b := event_id)) AS resolution FROM events WHERE event_type = 'click' GROUP BY 1")
def last_audit_per_issue(spark, d):
    e = C.table(spark, d, "events").where("event_type = 'click'").select(F.col("user_id").alias("issue_id"), F.get_json_object("props", "$.k").alias("resolution"), "ts", "event_id")
    return M.latest(e, ["issue_id"], "ts", "event_id").select("issue_id", "resolution")


@query("source_union", "sources claims", "SELECT source_id, max(used) AS used FROM (SELECT DISTINCT source_id, 1 AS used FROM claims WHERE product_id % 2 = 0 UNION ALL SELECT source_id, 0 FROM sources WHERE source_type = 'document') GROUP BY 1")
def source_union(spark, d):
    a = C.claims(spark, d).where("product_id % 2 = 0").select("source_id").distinct().withColumn("used", F.lit(1))
    b = C.sources(spark, d).where("source_type = 'document'").select("source_id", F.lit(0).alias("used"))
    return a.unionByName(b).groupBy("source_id").agg(F.max("used").alias("used"))


@query("clean_list_values", "", "SELECT p_partkey AS product_id, p_size || ' in|' || p_size || ' V' AS cleaned FROM part")
def clean_list_values(spark, d):
    items = F.array(F.struct(F.concat(F.col("p_size").cast("string"), F.lit(" inches")).alias("value"), F.lit("").alias("uom")), F.struct(F.col("p_size").cast("string").alias("value"), F.lit("volts").alias("uom")))
    cleaned = F.transform(items, lambda s: V.format_value_uom(V.clean_part_value(s["value"], s["uom"])))
    return C.table(spark, d, "part").select(F.col("p_partkey").alias("product_id"), F.array_join(cleaned, "|").alias("cleaned"))


@query("l2_normalize", "", "SELECT vec_id, round_even(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 5) AS norm, 1.0::DOUBLE AS unit FROM embeddings")
def l2_normalize(spark, d):
    e = C.table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    return e.select("vec_id", F.bround(S.norm("e"), 5).alias("norm"), S.l2_normalize("e").alias("u")).select("vec_id", "norm", F.bround(S.norm("u"), 5).alias("unit"))


@query("search_payload", "products claims attributes", "SELECT p.product_id, p.brand, a.raw_value AS voltage FROM products p LEFT JOIN attributes a ON a.product_id = p.product_id AND a.attribute_name = 'voltage'")
def search_payload(spark, d):
    payload = S.search_payload(C.products(spark, d), C.attributes(spark, d))
    return payload.select("product_id", "payload.brand", F.try_element_at("payload.attributes", F.lit("voltage")).alias("voltage"))


@query("parse_utc", "", "SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE date_trunc('second', ts) END AS at FROM events")
def parse_utc(spark, d):
    text = F.expr("CASE event_id % 3 WHEN 0 THEN date_format(ts, 'yyyy-MM-dd HH:mm:ss') WHEN 1 THEN concat(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\"), 'Z') ELSE 'soon' END")
    return C.table(spark, d, "events").select("event_id", F.try_to_timestamp(text).cast("timestamp_ntz").alias("at"))


@query("is_expired", "jobs", "SELECT job_id, created_at < DATE '1998-01-01' AS expired FROM jobs")
def is_expired(spark, d):
    return C.jobs(spark, d).select("job_id", (F.col("created_at") < F.lit("1998-01-01").cast("date")).alias("expired"))


@query("display_value_unit", "claims", "SELECT product_id, source_id, attribute_name, split_part(raw_value, ' ', 1) AS shown FROM claims")
def display_value_unit(spark, d):
    c = C.claims(spark, d).withColumn("unit", F.upper(F.split("raw_value", " ")[1]))
    return c.select("product_id", "source_id", "attribute_name", S.display_value(F.lit(None).cast("string"), F.col("raw_value"), F.col("unit")).alias("shown"))


@query("competing_view", "claims attributes issues", "SELECT validation_id, message AS value, 0.95::DOUBLE AS trust FROM issues UNION ALL SELECT validation_id, severity, 0.70::DOUBLE FROM issues WHERE severity <> 'info'")
def competing_view(spark, d):
    i = C.issues(spark, d).withColumn("actual", F.when(F.col("severity") != "info", F.col("severity")))
    pair = lambda c, t: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("value"), F.lit(t).alias("trust")))
    return i.select("validation_id", F.explode(F.filter(F.array(pair("message", 0.95), pair("actual", 0.70)), lambda x: x.isNotNull())).alias("c")).select("validation_id", "c.*")


@query("semantic_candidates", "products", """WITH q AS (SELECT vec_id AS product_id, embedding AS qe, brand, CASE WHEN vec_id % 100 = 0 THEN sku ELSE sku || 'X' END AS sku FROM embeddings JOIN products ON product_id = vec_id WHERE vec_id % 50 = 0),
s AS (SELECT q.product_id + 1000000 AS incoming_id, q.brand AS ib, q.sku AS isku, e.vec_id, round_even(list_cosine_similarity(e.embedding::DOUBLE[], qe::DOUBLE[]), 6) AS score FROM embeddings e, q),
t AS (SELECT *, row_number() OVER (PARTITION BY incoming_id ORDER BY score DESC, vec_id) AS rank FROM s), n AS (SELECT *, max(score) OVER (PARTITION BY incoming_id) AS confidence FROM t WHERE rank <= 5 AND score >= 0.7)
SELECT incoming_id, p.product_id, score, rank, confidence FROM n JOIN products p ON p.product_id = n.vec_id WHERE NOT (lower(trim(ib)) = lower(trim(p.brand)) AND lower(regexp_replace(isku, '[^a-zA-Z0-9]', '', 'g')) <> lower(regexp_replace(p.sku, '[^a-zA-Z0-9]', '', 'g')))""")
def semantic_candidates(spark, d):
    """Products that come in again with the vectors of those that the catalog has, half of them under another part number."""
    v, p = C.table(spark, d, "embeddings"), C.products(spark, d)
    incoming = p.where("product_id % 50 = 0").selectExpr("product_id + 1000000 AS incoming_id", "if(product_id % 100 = 0, sku, concat(sku, 'X')) AS sku", "brand", "model", "product_name")
    q = v.join(p.select(F.col("product_id").alias("vec_id")), "vec_id").where("vec_id % 50 = 0").select((F.col("vec_id") + 1000000).alias("query_id"), "embedding", F.lit(None).cast("int").alias("label"))
    return K.semantic_candidates(K.vector_topk(v, q, k=5), incoming, p).withColumn("rank", F.col("rank").cast("long"))


@query("brand_fallback", "", "SELECT p_partkey AS product_id, CASE p_partkey % 3 WHEN 0 THEN 'GE®' WHEN 1 THEN p_brand ELSE 'Maker' END AS brand FROM part")
def brand_fallback(spark, d):
    p = C.table(spark, d, "part").selectExpr("p_partkey AS product_id", "if(p_partkey % 3 = 0, 'GE®', 'Unbranded') AS found", "if(p_partkey % 3 = 1, p_brand, '-- Unbranded --') AS own", "'Maker' AS maker")
    return p.select("product_id", S.brand_or(F.col("found"), F.col("own"), F.col("maker")).alias("brand"))


@query("merge_claims", "claims", "SELECT product_id, source_id, attribute_name, CASE WHEN source_id % 2 = 0 THEN 'deterministic' ELSE 'llm' END AS method FROM claims c WHERE source_id % 2 = 0 OR NOT EXISTS (SELECT 1 FROM claims e WHERE e.product_id = c.product_id AND e.attribute_name = c.attribute_name AND e.source_id % 2 = 0)")
def merge_claims(spark, d):
    c = C.claims(spark, d).withColumn("method", F.expr("if(source_id % 2 = 0, 'deterministic', 'llm')"))
    return S.merge_claims(c.where("method = 'deterministic'"), c.where("method = 'llm'"), ["product_id", "attribute_name"]).select("product_id", "source_id", "attribute_name", "method")


@query("claim_conflicts", "claims attributes", "SELECT a.attribute_id, count(*) FILTER (lower(trim(c.raw_value)) <> lower(trim(a.raw_value))) AS conflicts FROM attributes a JOIN claims c ON a.product_id = c.product_id AND a.attribute_name = c.attribute_name GROUP BY 1")
def claim_conflicts(spark, d):
    return S.conflict_counts(C.attributes(spark, d), C.claims(spark, d), ["product_id", "attribute_name"])


@query("score_claims", "claims attributes", """WITH c AS (SELECT a.attribute_id, a.confidence AS trust, count(*) FILTER (lower(trim(c.raw_value)) <> lower(trim(a.raw_value))) AS k FROM attributes a JOIN claims c ON a.product_id = c.product_id AND a.attribute_name = c.attribute_name GROUP BY 1, 2),
s AS (SELECT attribute_id, k, round_even(greatest(0.0::DOUBLE, least(100.0::DOUBLE, (76 + 12 + 4 + 6 - least(20, 8 * k)) * greatest(0.8::DOUBLE, least(1.0::DOUBLE, trust)))), 1) AS score FROM c)
SELECT attribute_id, score, CASE WHEN k > 0 THEN 'conflicting' WHEN score >= 85 THEN 'verified' WHEN score >= 60 THEN 'extracted' ELSE 'needs_review' END AS status FROM s""")
def score_claims(spark, d):
    a = C.attributes(spark, d)
    counts = S.conflict_counts(a, C.claims(spark, d), ["product_id", "attribute_name"])
    rows = a.join(counts, "attribute_id")
    score = V.confidence_score(F.lit("deterministic"), F.lit(True), F.lit(True), F.lit(0.88), F.col("confidence"), F.col("conflicts"))
    rows = rows.withColumn("score", score)
    return rows.select("attribute_id", "score", F.when(F.col("conflicts") > 0, "conflicting").otherwise(V.status_from_confidence(F.col("score"))).alias("status"))


@query("renormalize", "claims attributes", "SELECT attribute_id, CAST(split_part(raw_value, ' ', 1) AS DOUBLE) AS num FROM attributes")
def renormalize(spark, d):
    v = V.normalize_value(F.col("raw_value"), F.lit("numeric"), F.lit(None).cast("string"))
    return C.attributes(spark, d).select("attribute_id", v["norm_num"].alias("num"))


@query("part_to_product", "", "SELECT p_partkey AS product_id, p_type || '-' || p_partkey AS sku, CASE WHEN p_partkey % 2 = 0 THEN 'Abrasives' ELSE 'Tools & Hardware' END AS category, CASE WHEN p_partkey % 2 = 0 THEN 'Sanding Belts' ELSE 'Kneeling Pads' END AS subcategory, CASE WHEN p_partkey % 5 = 0 THEN 'needs_review' ELSE 'verified' END AS status FROM part")
def part_to_product(spark, d):
    p = C.table(spark, d, "part").select(F.col("p_partkey").alias("product_id"), F.expr("concat(p_type, '-', p_partkey)").alias("sku"), F.when(F.col("p_partkey") % 2 == 0, L.CLASS_PATHS[3]).otherwise(L.CLASS_PATHS[9]).alias("class_path"), (F.col("p_partkey") % 5 == 0).alias("needs_review"))
    return S.part_products(p).select("product_id", "sku", "category", "subcategory", "status")


@query("upsert_evidence", "claims attributes", """WITH o AS (SELECT attribute_id, source_id % 3 AS document_id, CASE WHEN attribute_id % 2 = 0 THEN source_id ELSE -1 END AS source_id, 'old' AS text FROM attributes),
n AS (SELECT attribute_id, 1 AS document_id, CASE WHEN attribute_id % 5 = 0 THEN 7 END AS source_id, 'new' AS text FROM attributes WHERE attribute_id % 4 <> 0)
SELECT attribute_id, document_id, coalesce(n.source_id, o.source_id) AS source_id, coalesce(n.text, o.text) AS text FROM o FULL OUTER JOIN n USING (attribute_id, document_id)""")
def upsert_evidence(spark, d):
    a = C.attributes(spark, d)
    old = a.selectExpr("attribute_id", "source_id % 3 AS document_id", "if(attribute_id % 2 = 0, source_id, -1) AS source_id", "'old' AS text")
    new = a.where("attribute_id % 4 <> 0").selectExpr("attribute_id", "1L AS document_id", "if(attribute_id % 5 = 0, 7L, null) AS source_id", "'new' AS text")
    return M.upsert(old, new, ["attribute_id", "document_id"], if_null=("source_id",))


@query("accuracy_align", "", "SELECT p_partkey AS part, p_name AS expected, upper(p_name) AS actual FROM part WHERE p_partkey % 11 <> 0")
def accuracy_align(spark, d):
    p = C.table(spark, d, "part")
    e = p.select(F.trim(F.col("p_partkey").cast("string")).alias("key"), F.col("p_name").alias("expected"))
    a = p.where("p_partkey % 11 <> 0").select(F.concat(F.lit(" "), F.col("p_partkey").cast("string")).alias("raw"), F.upper("p_name").alias("actual"))
    return e.join(a.withColumn("key", F.trim("raw")), "key").select(F.col("key").cast("long").alias("part"), "expected", "actual")


@query("bulk_extract", "", "SELECT doc_id, 'chars' AS name, CAST(length(text) AS VARCHAR) AS value, 'numeric' AS data_type, 'llm' AS extraction_method FROM documents")
def bulk_extract(spark, d):
    """With a stand-in for a model: it says how many characters a page has."""
    import json

    def model(texts: list[str]) -> list[str]:
        return [json.dumps([{"name": "chars", "value": str(len(t)), "data_type": "numeric"}]) for t in texts]

    return S.bulk_extract(C.table(spark, d, "documents"), "doc_id", "text", model)


@query("reconcile_touched", "products claims", f"WITH {RECONCILED} SELECT product_id, attribute_name, status FROM rec WHERE winner IS NOT NULL AND product_id IN (SELECT product_id FROM claims WHERE source_id % 2 = 0)")
def reconcile_touched(spark, d):
    """Products touched by the claims of even sources are reconciled again, as a batch of new claims would have them."""
    c = C.claims(spark, d)
    touched = c.where("source_id % 2 = 0").select("product_id").distinct()
    return R.reconcile(c.join(touched, "product_id", "left_semi")).select("product_id", "attribute_name", "status")
