"""Queries over listings, details, pages of documents, deliveries and the search index."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import listings as G
from ..operators import maintain as M
from ..operators import match as K
from ..operators import parts as PT
from ..operators import scoring as S
from ..sources import ingest as I
from . import catalog as C
from .q_more import _queries_of

Q: dict = {}


def query(name: str, views: str, sql: str | None):
    def put(f):
        Q[name] = (f, (C.with_views(views, sql) if views else sql) if sql else None)
        return f

    return put


# ---- listings


@query("product_list", "products", "SELECT product_id, brand, quality_score FROM products WHERE status = 'verified' AND quality_score BETWEEN 20 AND 80 ORDER BY updated_at DESC, created_at DESC, product_id LIMIT 100 OFFSET 20")
def product_list(spark, d):
    found = G.matching(C.products(spark, d), {"status": "verified", "brand": None}, {"quality_score": (20, 80)})
    return G.page(found, "product_id", ("updated_at", "created_at"), offset=20).select("product_id", "brand", "quality_score")


_DOCS = "docs AS (SELECT doc_id AS document_id, source AS name, CASE WHEN n_chars % 5 = 0 THEN 'failed' WHEN n_chars % 5 = 1 THEN 'processing' ELSE 'completed' END AS status FROM documents)"


def _documents(spark, d):
    return C.table(spark, d, "documents").selectExpr("doc_id AS document_id", "source AS name", "CASE WHEN n_chars % 5 = 0 THEN 'failed' WHEN n_chars % 5 = 1 THEN 'processing' ELSE 'completed' END AS status")


@query("document_list", "", f"WITH {_DOCS} SELECT document_id, name FROM docs WHERE status = 'completed' ORDER BY document_id LIMIT 50 OFFSET 10")
def document_list(spark, d):
    return G.page(G.matching(_documents(spark, d), {"status": "completed"}), "document_id", offset=10, limit=50).select("document_id", "name")


@query("job_list", "jobs", "SELECT job_id, status FROM jobs WHERE status = 'failed' ORDER BY job_id LIMIT 100")
def job_list(spark, d):
    return G.page(G.matching(C.jobs(spark, d), {"status": "failed"}), "job_id").select("job_id", "status")


_ENRICHED = "enriched AS (SELECT job_id AS product_id, status AS s, failed_items AS score, total_items > 8 AS review FROM jobs WHERE status <> 'processing')"


def _enriched(spark, d):
    """The job of the same number stands for a record's enrichment."""
    return C.jobs(spark, d).where("status <> 'processing'").selectExpr("job_id AS product_id", "status", "failed_items AS score", "total_items > 8 AS needs_review")


@query("record_list", "products jobs", f"WITH {_ENRICHED} SELECT product_id, sku, coalesce(s, 'queued') AS status, coalesce(score, 0) AS score, coalesce(review, false) AS needs_review FROM products LEFT JOIN enriched USING (product_id)")
def record_list(spark, d):
    return G.record_list(C.products(spark, d).select("product_id", "sku"), _enriched(spark, d), "product_id")


@query("record_page", "products jobs", f"""WITH {_ENRICHED}, found AS (SELECT product_id, created_at, s AS status, score, review AS needs_review FROM products JOIN enriched USING (product_id) WHERE s = 'completed' AND NOT review)
SELECT product_id, status, score, needs_review, (SELECT count(*) FROM found) AS total FROM found ORDER BY created_at DESC, product_id LIMIT 30 OFFSET 10""")
def record_page(spark, d):
    found = G.record_list(C.products(spark, d).select("product_id", "created_at"), _enriched(spark, d), "product_id", status="completed", needs_review=False)
    return G.with_total(G.page(found, "product_id", ("created_at",), offset=10, limit=30), found).drop("created_at")


@query("pending_records", "products jobs", f"WITH {_ENRICHED} SELECT product_id FROM products LEFT JOIN enriched USING (product_id) WHERE s IS NULL OR s IN ('queued', 'failed')")
def pending_records(spark, d):
    return G.pending_records(C.products(spark, d).select("product_id"), _enriched(spark, d), "product_id")


@query("product_detail", "products claims attributes", """SELECT p.product_id, p.sku, attribute_name, CASE WHEN attribute_id % 2 = 0 THEN split_part(raw_value, ' ', 1) ELSE raw_value END AS value, split_part(raw_value, ' ', 2) AS unit, raw_value,
  upper(attribute_name) AS display_name, CASE WHEN a.attribute_id IS NOT NULL THEN 'numeric' END AS data_type, confidence, a.status, CASE WHEN a.attribute_id IS NOT NULL THEN 'document' END AS source_type FROM products p LEFT JOIN attributes a ON a.product_id = p.product_id""")
def product_detail(spark, d):
    a = C.attributes(spark, d).selectExpr(
        "product_id", "attribute_name", "if(attribute_id % 2 = 0, split(raw_value, ' ')[0], null) AS value", "split(raw_value, ' ')[1] AS unit", "raw_value", "upper(attribute_name) AS display_name",
        "'numeric' AS data_type", "confidence", "status", "'document' AS source_type",
    )
    p = G.product_details(C.products(spark, d).select("product_id", "sku"), a)
    return p.select("product_id", "sku", F.explode_outer("attributes").alias("attribute_name", "v")).select("product_id", "sku", "attribute_name", "v.*")


@query("sources_for_product", "sources claims", """WITH s AS (SELECT source_id, source_name, trust, CASE WHEN source_type = 'document' THEN source_id END AS document_id FROM sources),
links AS (SELECT DISTINCT l_partkey AS product_id, l_orderkey % 150 AS document_id FROM lineitem WHERE l_linenumber = 1), ev AS (SELECT DISTINCT product_id, source_id FROM claims),
x AS (SELECT product_id, source_id, source_name, document_id, trust, 1 AS used FROM ev JOIN s USING (source_id) UNION ALL SELECT product_id, source_id, source_name, document_id, trust, 0 FROM links JOIN s USING (document_id)
  UNION ALL SELECT product_id, document_id, source, document_id, 1.0::DOUBLE, 0 FROM links JOIN documents ON doc_id = document_id WHERE document_id NOT IN (SELECT document_id FROM s WHERE document_id IS NOT NULL))
SELECT product_id, source_id, source_name, document_id, trust, CASE max(used) WHEN 1 THEN 'evidence_source' ELSE 'document_source' END AS association_type FROM x GROUP BY 1, 2, 3, 4, 5""")
def sources_for_product(spark, d):
    s = C.sources(spark, d).withColumn("document_id", F.when(F.col("source_type") == "document", F.col("source_id")))
    lines = C.table(spark, d, "lineitem")
    links = lines.where("l_linenumber = 1").selectExpr("l_partkey AS product_id", "l_orderkey % 150 AS document_id")
    return G.sources_of_products(C.claims(spark, d).select("product_id", "source_id"), links, s, _documents(spark, d), 2 * lines.count())


_ITEMS = "items AS (SELECT l_orderkey AS job_id, CASE WHEN l_returnflag = 'R' THEN 'failed' WHEN l_linestatus = 'F' THEN 'completed' ELSE 'queued' END AS s FROM lineitem WHERE l_quantity > 20)"


@query("job_progress", "jobs", f"WITH {_ITEMS} SELECT j.job_id, j.status, count(s) AS total, count(s) FILTER (s = 'completed') AS completed, count(s) FILTER (s = 'failed') AS failed FROM jobs j LEFT JOIN items USING (job_id) GROUP BY 1, 2")
def job_progress(spark, d):
    items = C.table(spark, d, "lineitem").where("l_quantity > 20").selectExpr("l_orderkey AS job_id", "CASE WHEN l_returnflag = 'R' THEN 'failed' WHEN l_linestatus = 'F' THEN 'completed' ELSE 'queued' END AS status")
    return G.job_progress(C.jobs(spark, d), items)


_KPIS = """SELECT (SELECT count(*) FROM p) AS products, (SELECT round_even(avg(quality_score), 1) FROM p) AS avg_quality, (SELECT round_even(100.0 * count(*) FILTER (status = 'verified') / nullif(count(*), 0), 1) FROM p) AS verification_rate,
  (SELECT count(*) FROM docs) AS documents, (SELECT count(*) FROM docs WHERE status = 'completed') AS processed_documents, (SELECT count(*) FROM jobs WHERE status IN ('queued', 'processing')) AS active_jobs,
  coalesce((SELECT nullif(count(*), 0) FROM p WHERE status = 'needs_review'), (SELECT count(*) FROM issues WHERE status = 'open')) AS backlog"""


@query("overview_kpis", "products claims attributes issues jobs", f"WITH {_DOCS}, p AS (SELECT * FROM products) {_KPIS}")
def overview_kpis(spark, d):
    return G.overview(C.products(spark, d), _documents(spark, d), C.jobs(spark, d), C.issues(spark, d))


@query("overview_without_reviews", "products claims attributes issues jobs", f"WITH {_DOCS}, p AS (SELECT * FROM products WHERE status <> 'needs_review') {_KPIS}")
def overview_without_reviews(spark, d):
    """The headline figures of products of which none waits for a review: the backlog is that of open issues."""
    return G.overview(C.products(spark, d).where("status <> 'needs_review'"), _documents(spark, d), C.jobs(spark, d), C.issues(spark, d))


# ---- values, records and deliveries

_RAW = "CASE {0} % 5 WHEN 0 THEN {1} WHEN 1 THEN ' ' || {1} || 'mm ' WHEN 2 THEN {1} || ' - ' || {1} || ' bar' WHEN 3 THEN CASE WHEN {0} % 2 = 0 THEN 'TRUE' ELSE ' no' END ELSE {2} END"


@query("infer_type_unit", "claims", f"""WITH v AS (SELECT product_id, source_id, attribute_name, raw_value AS raw FROM claims UNION ALL SELECT -1 - event_id, 0, event_type, {_RAW.format("event_id", "round(value, 1)::VARCHAR", "event_type")} FROM events),
n AS (SELECT *, trim(raw) AS t, regexp_extract(trim(raw), '^[+-]?[0-9]+([.,][0-9]+)?[ ]*([a-zA-Z/]*)$', 2) AS u, regexp_matches(trim(raw), '^[+-]?[0-9]+([.,][0-9]+)?[ ]*[a-zA-Z/]*$') AS one FROM v)
SELECT product_id, source_id, attribute_name, CASE WHEN lower(t) IN ('yes', 'no', 'true', 'false') THEN 'boolean' WHEN one OR contains(t, ' - ') THEN 'numeric' ELSE 'text' END AS data_type, nullif(u, '') AS unit FROM n""")
def infer_type_unit(spark, d):
    c = C.claims(spark, d).select("product_id", "source_id", "attribute_name", "raw_value")
    e = C.table(spark, d, "events").selectExpr("-1 - event_id AS product_id", "0L AS source_id", "event_type AS attribute_name", _RAW.format("event_id", "string(round(value, 1))", "event_type") + " AS raw_value")
    return c.unionByName(e).select("product_id", "source_id", "attribute_name", V.infer_type(F.col("raw_value")).alias("data_type"), V.infer_unit(F.col("raw_value")).alias("unit"))


@query("import_counts", "", "SELECT count(DISTINCT p_name) AS imported, (SELECT count(*) FROM part) - count(DISTINCT p_name) AS skipped FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_partkey % 50 = 0)")
def import_counts(spark, d):
    p = C.table(spark, d, "part").select(F.col("p_name").alias("part_num"), "p_partkey")
    return I.import_counts(p, p.where("p_partkey % 50 = 0"), "part_num")


@query("header_diff", "", """WITH t AS (SELECT event_id, string_split(lower(regexp_replace(event_type || '_a_b_' || event_id % 3, '[^a-z0-9]', '_', 'g')), '_') AS a, string_split(event_type || CASE event_id % 4 WHEN 0 THEN '_a_b_' || event_id % 3 WHEN 1 THEN '_b_a' WHEN 2 THEN '' ELSE '_a_b_0_c' END, '_') AS b FROM events)
SELECT event_id AS id, len(list_filter(range(1, greatest(len(a), len(b)) + 1), lambda i: a[i] IS DISTINCT FROM b[i])) AS differing FROM t""")
def header_diff(spark, d):
    e = C.table(spark, d, "events").selectExpr("event_id", "split(concat(event_type, '_a_b_', event_id % 3), '_') AS a", "split(concat(event_type, CASE event_id % 4 WHEN 0 THEN concat('_a_b_', event_id % 3) WHEN 1 THEN '_b_a' WHEN 2 THEN '' ELSE '_a_b_0_c' END), '_') AS b")
    return e.select(F.col("event_id").alias("id"), S.header_differences(F.col("a"), F.col("b")).alias("differing"))


_LISTS = {"features": (20, []), "attributes": (50, ["name", "value", "uom"]), "images": (4, []), "manuals": (4, [])}
_SPREAD = ", ".join(
    f"coalesce({name}[{i}]{'.' + f if f else ''}, '') AS {name}_{i}{'_' + f if f else ''}" for name, (n, fields) in _LISTS.items() for i in range(1, n + 1) for f in (fields or [""])
)


@query("delivery_export", "products jobs claims attributes", f"""WITH {_ENRICHED}, l AS (SELECT product_id, list(struct_pack(name := attribute_name, value := split_part(raw_value, ' ', 1), uom := split_part(raw_value, ' ', 2)) ORDER BY attribute_name) AS attributes FROM attributes GROUP BY 1),
r AS (SELECT p.product_id, p.sku, l.attributes, string_split(p.product_name, ' ') AS features, [p.sku || '.jpg', p.model || '.png'] AS images, [p.sku || '.pdf'] AS manuals FROM products p JOIN enriched e ON e.product_id = p.product_id AND e.s = 'completed' LEFT JOIN l ON l.product_id = p.product_id)
SELECT product_id::VARCHAR AS product_id, coalesce(sku, '') AS sku, {_SPREAD} FROM r""")
def delivery_export(spark, d):
    """Enriched products with up to 20 features, 50 attributes of three columns, 4 images and 4 manuals."""
    a = C.attributes(spark, d).selectExpr("product_id", "attribute_name AS name", "split(raw_value, ' ')[0] AS value", "split(raw_value, ' ')[1] AS uom")
    lists = a.groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct("name", "value", "uom"))).alias("attributes"))  # five attributes at most
    done = _enriched(spark, d).where("status = 'completed'").select("product_id")
    p = C.products(spark, d).join(done, "product_id", "left_semi").join(lists, "product_id", "left")
    rows = p.selectExpr("product_id", "sku", "attributes", "split(product_name, ' ') AS features", "array(concat(sku, '.jpg'), concat(model, '.png')) AS images", "array(concat(sku, '.pdf')) AS manuals")
    return PT.deliver(rows, ["product_id", "sku"], _LISTS)


@query("approve_records", "products", "SELECT product_id, sku, CASE WHEN product_id % 4 = 0 THEN 'verified' ELSE status END AS status FROM products")
def approve_records(spark, d):
    p = C.products(spark, d).select("product_id", "sku", "status")
    return M.approve(p, p.where("product_id % 4 = 0"))


@query("rejected_retries", "jobs", "SELECT job_id, status FROM jobs WHERE status <> 'failed'")
def rejected_retries(spark, d):
    return M.rejected_retries(C.jobs(spark, d)).select("job_id", "status")


# ---- pages of documents

_TEXT_PAGE = 400


def _paged(spark, d):
    """Documents in pages of 400 characters, each page with a table of the document's source and language."""
    table = "array(named_struct('headers', array(' Key', 'VALUE '), 'rows', array(array('Source', source), array('Lang', lang))))"
    pages = f"transform(sequence(1, 1 + cast(greatest(0, length(text) - 1) div {_TEXT_PAGE} as int)), i -> named_struct('text', substring(text, (i - 1) * {_TEXT_PAGE} + 1, {_TEXT_PAGE}), 'tables', {table}))"
    x = C.table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.coalesce("text", F.lit("")).alias("text"), "source", "lang")
    return x.select("document_id", F.expr(pages).alias("pages"))


_PAGES = f"d AS (SELECT doc_id, coalesce(text, '') AS text, source, lang FROM documents), p AS (SELECT doc_id, source, lang, page, substr(text, (page - 1) * {_TEXT_PAGE} + 1, {_TEXT_PAGE}) AS t FROM (SELECT *, unnest(range(1, 2 + greatest(0, length(text) - 1) // {_TEXT_PAGE})) AS page FROM d))"


@query("explode_pages", "", f"WITH {_PAGES} SELECT doc_id AS document_id, page AS page_number, sha256(t) AS text_hash FROM p")
def explode_pages(spark, d):
    return I.explode_pages(_paged(spark, d)).select("document_id", "page_number", F.sha2("text", 256).alias("text_hash"))


@query("page_corpus", "", f"""WITH {_PAGES}, n AS (SELECT doc_id, page, trim(regexp_replace(lower(trim(concat_ws(' ', t, ' Key VALUE  Source', source, 'Lang', lang))), '\\s+', ' ', 'g')) AS t FROM p)
SELECT doc_id AS document_id, count(*) AS n_pages, sha256(string_agg(t, ' ' ORDER BY page)) AS corpus_hash FROM n GROUP BY 1""")
def page_corpus(spark, d):
    return I.page_corpus(_paged(spark, d)).select("document_id", F.size("pages").cast("long").alias("n_pages"), F.sha2("corpus", 256).alias("corpus_hash"))


# ---- search


@query("search_results", "products claims attributes", """WITH q AS (SELECT vec_id AS query_id, embedding AS qe, CASE WHEN vec_id % 100 = 0 THEN label END AS ql FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id, round_even(list_cosine_similarity(embedding::DOUBLE[], qe::DOUBLE[]), 6) AS score FROM embeddings, q WHERE ql IS NULL OR ql = label),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s),
l AS (SELECT product_id, string_agg(attribute_name || '=' || raw_value, ';' ORDER BY attribute_name) AS attributes FROM attributes GROUP BY 1)
SELECT query_id, p.product_id, sku, rank, attributes FROM t JOIN products p ON p.product_id = vec_id LEFT JOIN l ON l.product_id = p.product_id WHERE rank <= 10 AND query_id % 150 <> 0""")
def search_results(spark, d):
    """Hits of all queries but those that ask for nothing, every third."""
    v = C.table(spark, d, "embeddings")
    hits = K.vector_topk(v, _queries_of(v)).withColumnRenamed("vec_id", "product_id")
    texts = v.where("vec_id % 50 = 0").selectExpr("vec_id AS query_id", "if(vec_id % 150 = 0, if(vec_id % 300 = 0, ' ', null), string(vec_id)) AS text")
    got = G.search_results(hits, texts, C.products(spark, d), C.attributes(spark, d))
    shown = F.array_join(F.transform("attributes", lambda x: F.concat_ws("=", x["name"], x["value"])), ";")
    return got.select("query_id", "product_id", "sku", F.col("rank").cast("long").alias("rank"), shown.alias("attributes"))


@query("index_upsert", "", "SELECT vec_id, CASE WHEN vec_id % 3 = 0 OR vec_id % 5 = 0 THEN 2 ELSE 1 END AS generation FROM embeddings WHERE vec_id % 7 <> 0")
def index_upsert(spark, d):
    """An index in which one vector in three is stale and one in five is missing; one in seven is to be deleted."""
    rows = C.table(spark, d, "embeddings").select("vec_id", F.sha2(F.col("embedding").cast("string"), 256).alias("content_hash"))
    old = rows.where("vec_id % 5 <> 0").withColumn("content_hash", F.when(F.col("vec_id") % 3 == 0, "stale").otherwise(F.col("content_hash"))).withColumn("generation", F.lit(1))
    return M.reindex(old, rows.withColumn("generation", F.lit(2)), "vec_id", "content_hash", rows.where("vec_id % 7 = 0")).select("vec_id", "generation")
