"""Queries over matching, part lists, table maintenance, ingestion and bulk work."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lookups as L
from ..functions import values as V
from ..operators import decisions as DC
from ..operators import maintain as M
from ..operators import match as K
from ..operators import parts as PT
from ..operators import vectors as VX
from ..sources import ingest as I
from . import catalog as C

Q: dict = {}


def query(name: str, views: str, sql: str | None):
    def put(f):
        Q[name] = (f, (C.with_views(views, sql) if views else sql) if sql else None)
        return f

    return put


# ---- matching

_INCOMING = """incoming AS (SELECT product_id + 1000000 AS incoming_id, CASE product_id % 4 WHEN 0 THEN lower(replace(sku, '-', ' ')) WHEN 1 THEN NULL ELSE sku || 'X' END AS sku, brand,
  CASE product_id % 4 WHEN 1 THEN lower(model) WHEN 3 THEN NULL ELSE model || 'Z' END AS model, ' ' || upper(product_name) AS product_name FROM products)"""


def _incoming(spark, d):
    return C.products(spark, d).selectExpr(
        "product_id + 1000000 AS incoming_id", "CASE product_id % 4 WHEN 0 THEN lower(replace(sku, '-', ' ')) WHEN 1 THEN NULL ELSE concat(sku, 'X') END AS sku", "brand",
        "CASE product_id % 4 WHEN 1 THEN lower(model) WHEN 3 THEN NULL ELSE concat(model, 'Z') END AS model", "concat(' ', upper(product_name)) AS product_name",
    )


_KEYS = "nullif(lower(regexp_replace(sku, '[^a-zA-Z0-9]', '', 'g')), '') AS s, nullif(lower(regexp_replace(model, '[^a-zA-Z0-9]', '', 'g')), '') AS m, lower(trim(brand)) AS b, lower(trim(product_name)) AS n"


@query("entity_resolve", "products", f"""WITH {_INCOMING}, i AS (SELECT incoming_id, {_KEYS} FROM incoming), c AS (SELECT product_id, {_KEYS} FROM products),
l1 AS (SELECT incoming_id, min(product_id) AS p FROM i JOIN c USING (s, b) GROUP BY 1),
l2 AS (SELECT incoming_id, min(product_id) AS p FROM i JOIN c USING (m, b) WHERE NOT coalesce(i.s <> c.s, false) GROUP BY 1),
l3 AS (SELECT incoming_id, min(product_id) AS p FROM i JOIN c USING (n, b) WHERE NOT coalesce(i.s <> c.s, false) AND NOT coalesce(i.m <> c.m, false) GROUP BY 1)
SELECT i.incoming_id, coalesce(l1.p, l2.p, l3.p) AS match_id, CASE WHEN l1.p IS NOT NULL THEN 'exact_sku_brand' WHEN l2.p IS NOT NULL THEN 'model_brand' WHEN l3.p IS NOT NULL THEN 'name_brand' ELSE 'none' END AS method,
  CASE WHEN l1.p IS NOT NULL THEN 1.0::DOUBLE WHEN l2.p IS NOT NULL THEN 0.95::DOUBLE WHEN l3.p IS NOT NULL THEN 0.9::DOUBLE ELSE 0.0::DOUBLE END AS confidence
FROM i LEFT JOIN l1 USING (incoming_id) LEFT JOIN l2 USING (incoming_id) LEFT JOIN l3 USING (incoming_id)""")
def entity_resolve(spark, d):
    return K.resolve_entities(_incoming(spark, d), C.products(spark, d))


def _with_products(spark, d):
    """The catalog's products that have a vector, and rows that come in with the same vectors: some resolve by a key, and the rest by vectors."""
    p, v = C.products(spark, d), C.table(spark, d, "embeddings")
    odd = lambda c, x: f"if(product_id % 3 = 0, {x}, concat({c}, 'X')) AS {c}"
    incoming = p.selectExpr("product_id + 1000000 AS incoming_id", odd("sku", "sku"), "if(product_id % 5 = 0, 'Other', brand) AS brand", odd("model", "null"), "if(product_id % 2 = 0, product_name, concat(product_name, ' new')) AS product_name")
    own = v.select("vec_id", "embedding", F.lit(None).cast("int").alias("label")).join(p.select(F.col("product_id").alias("vec_id")), "vec_id", "left_semi")
    return p, incoming, own


@query("entity_resolve_vectors", "products", f"""WITH incoming AS (SELECT product_id + 1000000 AS incoming_id, CASE WHEN product_id % 3 = 0 THEN sku ELSE sku || 'X' END AS sku, CASE WHEN product_id % 5 = 0 THEN 'Other' ELSE brand END AS brand,
  CASE WHEN product_id % 3 = 0 THEN NULL ELSE model || 'X' END AS model, CASE WHEN product_id % 2 = 0 THEN product_name ELSE product_name || ' new' END AS product_name FROM products),
i AS (SELECT incoming_id, {_KEYS} FROM incoming), c AS (SELECT product_id, {_KEYS} FROM products),
hit AS (SELECT incoming_id, product_id, CASE WHEN i.s = c.s THEN 1 WHEN i.m = c.m AND NOT coalesce(i.s <> c.s, false) THEN 2 WHEN i.n = c.n AND NOT coalesce(i.s <> c.s, false) AND NOT coalesce(i.m <> c.m, false) THEN 3 END AS level FROM i JOIN c USING (b)),
best AS (SELECT incoming_id, level, min(product_id) AS match_id, count(*) AS n FROM hit JOIN (SELECT incoming_id, min(level) AS level FROM hit GROUP BY 1) USING (incoming_id, level) GROUP BY 1, 2),
own AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id IN (SELECT product_id FROM products)),
s AS (SELECT i.incoming_id, e.vec_id, round_even(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM i ANTI JOIN best USING (incoming_id) JOIN own q ON q.vec_id + 1000000 = i.incoming_id, own e),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY incoming_id ORDER BY score DESC, vec_id) AS rn FROM s WHERE score >= 0.7) WHERE rn <= 5),
cand AS (SELECT near.incoming_id, string_agg(c.product_id || ':' || near.score, ',' ORDER BY rn) AS candidates FROM near JOIN i USING (incoming_id) JOIN c ON c.product_id = near.vec_id WHERE NOT coalesce(i.b = c.b AND i.s <> c.s, false) GROUP BY 1)
SELECT i.incoming_id, match_id, CASE level WHEN 1 THEN 'exact_sku_brand' WHEN 2 THEN 'model_brand' WHEN 3 THEN 'name_brand' ELSE CASE WHEN candidates IS NULL THEN 'none' ELSE 'vector_candidates' END END AS method,
  coalesce(CASE level WHEN 1 THEN 1.0 WHEN 2 THEN 0.95 WHEN 3 THEN 0.9 END::DOUBLE, (SELECT max(score) FROM near WHERE near.incoming_id = i.incoming_id), 0.0) AS confidence, coalesce(best.n, 0) AS n_equal, coalesce(best.n > 1, false) OR candidates IS NOT NULL AS review, coalesce(candidates, '') AS candidates
FROM i LEFT JOIN best USING (incoming_id) LEFT JOIN cand USING (incoming_id)""")
def entity_resolve_vectors(spark, d):
    p, incoming, own = _with_products(spark, d)
    asked = own.select((F.col("vec_id") + 1000000).alias("incoming_id"), "embedding")
    out = K.resolve_with_vectors(incoming, p, asked, VX.build_index(own))
    return out.withColumn("candidates", F.array_join(F.transform("candidates", lambda x: F.concat_ws(":", x.product_id.cast("string"), x.score.cast("string"))), ","))


@query("duplicate_groups", "products", "WITH g AS (SELECT product_id, min(product_id) OVER (PARTITION BY brand, product_name) AS group_id, count(*) OVER (PARTITION BY brand, product_name) AS n FROM products) SELECT * FROM g WHERE n > 1")
def duplicate_groups(spark, d):
    return K.duplicate_groups(C.products(spark, d))


_LOOSE = """loose AS (SELECT product_id, CASE WHEN product_id % 3 = 0 THEN NULL ELSE ' ' || brand || '-' || product_id % 97 END AS sku, CASE WHEN product_id % 4 = 1 THEN NULL ELSE upper(model) END AS model,
  CASE WHEN product_id % 29 = 0 THEN NULL WHEN product_id % 5 < 2 THEN 'Hot' ELSE upper(brand) END AS brand, CASE WHEN product_id % 23 = 0 THEN NULL ELSE ' ' || substr(product_name, 1, 6) END AS product_name FROM products)"""


def _loose(spark, d):
    """Products of few skus, models and names, some without one or without a brand; one brand has two fifths of all."""
    return C.products(spark, d).selectExpr(
        "product_id", "if(product_id % 3 = 0, null, concat(' ', brand, '-', product_id % 97)) AS sku", "if(product_id % 4 = 1, null, upper(model)) AS model",
        "CASE WHEN product_id % 29 = 0 THEN NULL WHEN product_id % 5 < 2 THEN 'Hot' ELSE upper(brand) END AS brand", "if(product_id % 23 = 0, null, concat(' ', substring(product_name, 1, 6))) AS product_name",
    )


@query("duplicate_candidates", "products", f"""WITH RECURSIVE {_LOOSE}, k AS (SELECT product_id AS id, {_KEYS} FROM loose),
link AS (SELECT x.id AS a, y.id AS b, CASE WHEN x.s = y.s THEN 1 WHEN x.m = y.m AND (x.s IS NULL OR y.s IS NULL) THEN 2 WHEN x.n = y.n AND (x.s IS NULL OR y.s IS NULL) AND (x.m IS NULL OR y.m IS NULL) THEN 3 END AS level FROM k x JOIN k y ON x.b = y.b AND x.id <> y.id),
l AS (SELECT * FROM link WHERE level IS NOT NULL), reach(id, root) USING KEY (id) AS (SELECT id, id FROM k UNION SELECT l.a, min(r.root) FROM reach r JOIN l ON l.b = r.id JOIN recurring.reach own ON own.id = l.a WHERE r.root < own.root GROUP BY 1)
SELECT k.id AS product_id, root AS group_id, coalesce(t.n, 0) AS n_links, CASE t.best WHEN 1 THEN 'exact_sku_brand' WHEN 2 THEN 'model_brand' WHEN 3 THEN 'name_brand' ELSE 'none' END AS method,
  CASE t.best WHEN 1 THEN 1.0 WHEN 2 THEN 0.95 WHEN 3 THEN 0.9 ELSE 0.0 END::DOUBLE AS score FROM k JOIN reach USING (id) LEFT JOIN (SELECT a, count(*) AS n, min(level) AS best FROM l GROUP BY 1) t ON t.a = k.id""")
def duplicate_candidates(spark, d):
    return K.duplicate_candidates(_loose(spark, d))


@query("duplicate_pairs", "", """WITH p AS (SELECT least(l_partkey, l_suppkey) AS product_id, greatest(l_partkey, l_suppkey) AS candidate_id, l_discount AS score, l_shipdate FROM lineitem WHERE l_partkey <> l_suppkey),
n AS (SELECT *, row_number() OVER (PARTITION BY product_id, candidate_id ORDER BY l_shipdate DESC, score DESC) AS rn FROM p) SELECT product_id, candidate_id, score, CASE WHEN score > 0.05 THEN 'vector' ELSE 'rule' END AS method FROM n WHERE rn = 1""")
def duplicate_pairs(spark, d):
    p = C.table(spark, d, "lineitem").selectExpr("l_partkey AS a", "l_suppkey AS b", "l_discount AS score", "if(l_discount > 0.05, 'vector', 'rule') AS method", "l_shipdate AS seen_at")
    return K.record_pairs(p)


def _queries_of(vectors):
    return vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.when(F.col("vec_id") % 100 == 0, F.col("label")).alias("label"))


@query("vector_topk", "", """WITH q AS (SELECT vec_id AS query_id, embedding AS qe, CASE WHEN vec_id % 100 = 0 THEN label END AS ql FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id, round_even(list_cosine_similarity(embedding::DOUBLE[], qe::DOUBLE[]), 6) AS score FROM embeddings, q WHERE ql IS NULL OR ql = label)
SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""")
def vector_topk(spark, d):
    v = C.table(spark, d, "embeddings")
    return K.vector_topk(v, _queries_of(v)).withColumn("rank", F.col("rank").cast("long"))


def _all_as_queries(spark, d):
    v = C.table(spark, d, "embeddings")
    return v, v.select(F.col("vec_id").alias("query_id"), "embedding", F.when(F.col("vec_id") % 2 == 0, F.col("label")).alias("label"))


@query("vector_neighbors", "", None)
def vector_neighbors(spark, d):
    """The ten nearest of every row among all rows, half of them of its label only, through inverted lists; as many lists as the measured recall asks for."""
    v, q = _all_as_queries(spark, d)
    index = VX.build_index(v)
    return VX.search(index, q, 10, VX.probes_for(index, q)).withColumn("rank", F.col("rank").cast("long"))


@query("vector_neighbors_exact", "", """WITH q AS (SELECT vec_id AS query_id, embedding AS qe, CASE WHEN vec_id % 2 = 0 THEN label END AS ql FROM embeddings),
s AS (SELECT query_id, vec_id, round_even(list_cosine_similarity(embedding::DOUBLE[], qe::DOUBLE[]), 6) AS score FROM embeddings JOIN q ON ql IS NULL OR ql = label)
SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""")
def vector_neighbors_exact(spark, d):
    """The same, looking at all vectors: one list, so that a query is sent once a block of vectors and not once a list."""
    v, q = _all_as_queries(spark, d)
    return VX.search(VX.build_index(v, lists=1), q, 10).withColumn("rank", F.col("rank").cast("long"))


_NOISE = "CASE p_partkey % 5 WHEN 0 THEN 'milwaukee accessories' WHEN 1 THEN 'GENERAL ELECTRIC CO (GE)' WHEN 2 THEN '-- unbranded --' WHEN 3 THEN p_brand ELSE 'Wera Tools (X1)' END"


@query("manufacturer_match", "", f"""WITH r AS (SELECT p_partkey AS product_id, {_NOISE} AS raw FROM part), names AS (SELECT DISTINCT raw, trim(regexp_replace(raw, '\\s*\\(\\w+\\)\\s*$', '')) AS clean FROM r),
m(name, brand, code, pos) AS (VALUES {", ".join(f"({L.sql_text(a)}, {L.sql_text(b)}, {L.sql_text(c)}, {i})" for i, (a, b, c) in enumerate(L.MANUFACTURERS))}),
t AS (SELECT raw, clean, name, brand, code, pos, list_distinct(regexp_extract_all(lower(clean), '\\w+')) AS a, list_distinct(regexp_extract_all(lower(name), '\\w+')) AS b FROM names, m),
s AS (SELECT *, greatest(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), CASE WHEN contains(lower(name), lower(clean)) OR contains(lower(clean), lower(name)) THEN 0.8 ELSE 0 END::DOUBLE) AS score FROM t),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY raw ORDER BY score DESC, pos) AS rn FROM s) WHERE rn = 1)
SELECT product_id, CASE WHEN raw = '-- unbranded --' THEN 'Unknown Manufacturer' WHEN score >= 0.3 THEN name ELSE clean END AS manufacturer, CASE WHEN raw = '-- unbranded --' THEN 0.0::DOUBLE WHEN score >= 0.3 THEN round_even(score, 2) ELSE 0.1::DOUBLE END AS mfr_confidence FROM r JOIN best USING (raw)""")
def manufacturer_match(spark, d):
    r = C.table(spark, d, "part").select(F.col("p_partkey").alias("product_id"), F.expr(_NOISE).alias("raw"))
    return K.match_manufacturers(r, "raw").select("product_id", "manufacturer", "mfr_confidence")


_PATHS = f"CASE p_partkey % 4 WHEN 0 THEN upper({L.sql_text(L.CLASS_PATHS[4])}) WHEN 1 THEN 'Abrasives>Other' WHEN 2 THEN p_type ELSE 'Tools & Hardware>Hand Tools>' || p_name END"


@query("classpath_match", "", f"""WITH r AS (SELECT p_partkey AS product_id, {_PATHS} AS raw FROM part), p(path, pos) AS (VALUES {", ".join(f"({L.sql_text(x)}, {i})" for i, x in enumerate(L.CLASS_PATHS))}),
s AS (SELECT product_id, path, pos, CASE WHEN lower(trim(raw)) = lower(path) THEN 1.0::DOUBLE ELSE len(list_intersect(list_distinct(string_split(lower(trim(raw)), '>')), string_split(lower(path), '>'))) / len(list_distinct(string_split(lower(trim(raw)), '>'))) END AS score FROM r, p),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY score DESC, pos) AS rn FROM s) WHERE rn = 1)
SELECT product_id, CASE WHEN score >= 0.4 THEN path ELSE {L.sql_text(L.CLASS_PATHS[0])} END AS class_path, CASE WHEN score >= 0.4 THEN round_even(score, 2) ELSE 0.1::DOUBLE END AS class_confidence FROM b""")
def classpath_match(spark, d):
    path = f"CASE p_partkey % 4 WHEN 0 THEN upper({L.sql_text(L.CLASS_PATHS[4])}) WHEN 1 THEN 'Abrasives>Other' WHEN 2 THEN p_type ELSE concat('Tools & Hardware>Hand Tools>', p_name) END"
    r = C.table(spark, d, "part").select(F.col("p_partkey").alias("product_id"), F.expr(path).alias("raw"))
    return K.match_class_paths(r, "raw").select("product_id", "class_path", "class_confidence")


@query("token_overlap", "", """WITH t AS (SELECT p_partkey AS product_id, list_distinct(string_split(lower(p_name), ' ')) AS a, list_distinct(string_split(lower(p_type || ' ' || split_part(p_name, ' ', 1)), ' ')) AS b FROM part)
SELECT product_id, round_even(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS jaccard FROM t""")
def token_overlap(spark, d):
    a, b = F.split(F.lower("p_name"), " "), F.split(F.lower(F.concat_ws(" ", "p_type", F.split("p_name", " ")[0])), " ")
    return C.table(spark, d, "part").select(F.col("p_partkey").alias("product_id"), F.bround(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)), 6).alias("jaccard"))


# ---- part lists


@query("part_record_flags", "", """WITH r AS (SELECT p_partkey AS record_id, p_name || ' ' || p_type || ' ' || repeat('x', CAST(p_size % 60 AS INT)) AS mobile, CASE WHEN p_partkey % 6 = 0 THEN '' ELSE p_brand END AS brand, (p_partkey % 10) / 10 AS conf, CAST(50 + p_partkey % 50 AS DOUBLE) AS complete FROM part),
f AS (SELECT record_id, CASE WHEN length(mobile) < 45 OR length(mobile) > 90 THEN 1 ELSE 0 END AS a, CASE WHEN brand = '' THEN 1 ELSE 0 END AS b, CASE WHEN conf < 0.4 THEN 1 ELSE 0 END AS c, CASE WHEN complete < 75 THEN 1 ELSE 0 END AS d FROM r)
SELECT record_id, a + b + c + d AS n_flags, a + b + c + d > 0 AS needs_review FROM f""")
def part_record_flags(spark, d):
    r = C.table(spark, d, "part").selectExpr("p_partkey AS record_id", "concat(p_name, ' ', p_type, ' ', repeat('x', cast(p_size % 60 as int))) AS mobile", "if(p_partkey % 6 = 0, '', p_brand) AS brand", "(p_partkey % 10) / 10 AS conf", "cast(50 + p_partkey % 50 as double) AS complete")
    return PT.record_flags(r, "mobile", "brand", "conf", "complete").select("record_id", F.size("flags").alias("n_flags"), "needs_review")


_EXPECTED = "expected AS (SELECT p_partkey AS part, p_name AS name, p_brand AS brand, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_type END AS kind FROM part)"
_ACTUAL = "actual AS (SELECT p_partkey AS part, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS name, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_brand END AS brand, CASE WHEN p_partkey % 4 = 0 THEN 'OTHER' ELSE p_type END AS kind FROM part WHERE p_partkey % 11 <> 0)"
_DIFF = f"""{_EXPECTED}, {_ACTUAL}, e AS (SELECT part, 'name' AS c, name AS v FROM expected UNION ALL SELECT part, 'brand', brand FROM expected UNION ALL SELECT part, 'kind', kind FROM expected),
a AS (SELECT part, 'name' AS c, name AS v FROM actual UNION ALL SELECT part, 'brand', brand FROM actual UNION ALL SELECT part, 'kind', kind FROM actual),
diff AS (SELECT e.part, e.c AS column_name, CASE WHEN e.v = '' AND a.v = '' THEN 'BLANK_MATCH' WHEN a.v = '' THEN 'MISSING' WHEN e.v = '' THEN 'EXTRA' WHEN e.v = a.v THEN 'EXACT_MATCH' WHEN lower(e.v) = lower(a.v) THEN 'CASE_INSENSITIVE_MATCH' ELSE 'VALUE_MISMATCH' END AS match_status FROM e JOIN a ON e.part = a.part AND e.c = a.c)"""


def _diff(spark, d):
    p = C.table(spark, d, "part")
    expected = p.selectExpr("p_partkey AS part", "p_name AS name", "p_brand AS brand", "if(p_partkey % 7 = 0, '', p_type) AS kind")
    actual = p.where("p_partkey % 11 <> 0").selectExpr("p_partkey AS part", "if(p_partkey % 3 = 0, upper(p_name), p_name) AS name", "if(p_partkey % 5 = 0, '', p_brand) AS brand", "if(p_partkey % 4 = 0, 'OTHER', p_type) AS kind")
    return PT.accuracy_diff(expected, actual, "part")


@query("accuracy_diff", "", f"WITH {_DIFF} SELECT * FROM diff")
def accuracy_diff(spark, d):
    return _diff(spark, d)


_RATES = "count(*) AS evaluated, round_even(100.0 * count(*) FILTER (match_status IN ('EXACT_MATCH', 'BLANK_MATCH')) / count(*), 2) AS exact_rate, round_even(100.0 * count(*) FILTER (match_status IN ('EXACT_MATCH', 'BLANK_MATCH', 'CASE_INSENSITIVE_MATCH')) / count(*), 2) AS folded_rate"


@query("accuracy_overall", "", f"WITH {_DIFF} SELECT {_RATES} FROM diff")
def accuracy_overall(spark, d):
    return PT.accuracy(_diff(spark, d))


_STATUSES = ", ".join(f"count(*) FILTER (match_status = '{s.upper()}') AS {s}" for s in PT.STATUSES)


@query("accuracy_by_column", "", f"""WITH {_DIFF}, r AS (SELECT column_name, {_RATES}, {_STATUSES} FROM diff GROUP BY 1)
SELECT *, row_number() OVER (ORDER BY folded_rate, value_mismatch + missing, column_name) <= 2 AS worst, folded_rate = 100 AS best FROM r""")
def accuracy_by_column(spark, d):
    return PT.accuracy_by_column(_diff(spark, d), n_worst=2)


@query("accuracy_rollup", "", f"WITH {_DIFF} SELECT part % 10 AS bucket, column_name, count(*) AS evaluated, count(*) FILTER (match_status = 'EXACT_MATCH') AS exact_matches, grouping(part % 10) * 2 + grouping(column_name) AS level FROM diff GROUP BY ROLLUP (part % 10, column_name)")
def accuracy_rollup(spark, d):
    x = _diff(spark, d).withColumn("bucket", F.col("part") % 10)
    return x.rollup("bucket", "column_name").agg(F.count("*").alias("evaluated"), F.count_if(F.col("match_status") == "EXACT_MATCH").alias("exact_matches"), F.grouping_id().alias("level"))


@query("matched_keys", "", "SELECT p_partkey AS part FROM part WHERE p_partkey % 11 <> 0 INTERSECT SELECT l_partkey FROM lineitem")
def matched_keys(spark, d):
    return C.table(spark, d, "part").where("p_partkey % 11 <> 0").select(F.col("p_partkey").alias("part")).intersect(C.table(spark, d, "lineitem").select("l_partkey"))


def _invoices():
    text = F.col("text")
    return F.when(F.col("doc_id") % 3 == 0, text).when(F.col("doc_id") % 3 == 1, V.capitals(text)).otherwise(F.substring(V.capitals(text), 1, 40))


@query("compliance_check", "", """WITH x AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN upper(text) ELSE substr(upper(text), 1, 40) END AS v FROM documents)
SELECT count(*) AS evaluated, count(*) FILTER (length(v) > 40) AS too_long, count(*) FILTER (v <> upper(v)) AS not_upper, count(*) FILTER (length(v) > 40 OR v <> upper(v)) AS violations, count(*) FILTER (length(v) > 40 OR v <> upper(v)) = 0 AS compliant, true AS same_header FROM x""")
def compliance_check(spark, d):
    """Whole texts, texts in capitals, and those cut to 40 characters as invoice descriptions."""
    docs = C.table(spark, d, "documents")
    v = _invoices()
    return PT.compliance(docs.select("doc_id", v.alias("v")), "v", ["doc_id", "v"])


@query("invoice_violations", "", """WITH x AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN upper(text) ELSE substr(upper(text), 1, 40) END AS v FROM documents)
SELECT doc_id, length(v) > 40 AS too_long, v <> upper(v) AS not_upper FROM x""")
def invoice_violations(spark, d):
    v = _invoices()
    return PT.invoice_violations(C.table(spark, d, "documents").select("doc_id", v.alias("v")), "v").select("doc_id", "too_long", "not_upper")


# ---- table maintenance


@query("upsert_attributes", "claims attributes", """WITH new AS (SELECT * FROM attributes WHERE attribute_id % 3 = 0), old AS (SELECT attribute_id, product_id, 'old' AS raw_value FROM attributes WHERE attribute_id % 2 = 0)
SELECT coalesce(o.attribute_id, n.attribute_id) AS attribute_id, coalesce(o.product_id, n.product_id) AS product_id, coalesce(n.raw_value, o.raw_value) AS raw_value FROM old o FULL OUTER JOIN new n ON o.attribute_id = n.attribute_id""")
def upsert_attributes(spark, d):
    a = C.attributes(spark, d).select("attribute_id", "product_id", "raw_value")
    return M.upsert(a.where("attribute_id % 2 = 0").withColumn("raw_value", F.lit("old")), a.where("attribute_id % 3 = 0"), ["attribute_id"], keep=("product_id",))


@query("upsert_products", "products", """WITH o AS (SELECT sku, brand, category, 'o' || product_id AS note FROM products WHERE product_id % 2 = 0),
n AS (SELECT CASE WHEN product_id % 7 = 0 THEN sku || 'N' ELSE sku END AS sku, CASE WHEN product_id % 4 = 1 THEN 'UNKNOWN' ELSE brand END AS brand, CASE WHEN product_id % 9 = 0 THEN 'Uncategorized' ELSE category END AS category, CASE WHEN product_id % 5 = 0 THEN NULL ELSE 'n' END AS note FROM products WHERE product_id % 3 = 0)
SELECT sku, brand, coalesce(n.category, o.category) AS category, coalesce(n.note, o.note) AS note FROM o FULL OUTER JOIN n USING (sku, brand)""")
def upsert_products(spark, d):
    p = C.products(spark, d)
    old = p.where("product_id % 2 = 0").select("sku", "brand", "category", F.concat(F.lit("o"), "product_id").alias("note"))
    new = p.where("product_id % 3 = 0").selectExpr("if(product_id % 7 = 0, concat(sku, 'N'), sku) AS sku", "if(product_id % 4 = 1, if(product_id % 8 = 1, ' ', null), brand) AS brand", "if(product_id % 9 = 0, null, category) AS category", "if(product_id % 5 = 0, null, 'n') AS note")
    return M.upsert(old, M.named_products(new), ["sku", "brand"], if_null=("note",))


@query("audit_rows", "products", """WITH o AS (SELECT product_id, status FROM products WHERE product_id % 5 <> 0), n AS (SELECT product_id, CASE WHEN product_id % 4 = 0 THEN 'verified' ELSE status END AS status FROM products WHERE product_id % 7 <> 0)
SELECT product_id, CASE WHEN o.status IS NULL THEN 'created' WHEN n.status IS NULL THEN 'deleted' ELSE 'updated' END AS action FROM o FULL OUTER JOIN n USING (product_id) WHERE o.status IS DISTINCT FROM n.status""")
def audit_rows(spark, d):
    p = C.products(spark, d).select("product_id", "status")
    new = p.where("product_id % 7 <> 0").withColumn("status", F.when(F.col("product_id") % 4 == 0, "verified").otherwise(F.col("status")))
    return M.audit_rows(p.where("product_id % 5 <> 0"), new, "product_id").select("product_id", "action")


@query("product_versions", "", "SELECT l_partkey AS product_id, l_shipdate AS changed_at, count(*) AS n, dense_rank() OVER (PARTITION BY l_partkey ORDER BY l_shipdate) + 2 AS version_number FROM lineitem GROUP BY 1, 2")
def product_versions(spark, d):
    changes = C.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("product_id"), F.col("l_shipdate").alias("changed_at")).agg(F.count("*").alias("n"))
    held = C.products(spark, d).select("product_id").crossJoin(spark.range(2).select("id"))  # two earlier versions of each
    return M.next_versions(held, changes, "product_id", "changed_at")


@query("replace_open_issues", "claims attributes issues", """SELECT validation_id, product_id, status FROM issues WHERE status <> 'open' OR product_id % 2 <> 0
UNION ALL SELECT attribute_id + 10000000, product_id, 'open' FROM attributes WHERE product_id % 2 = 0 AND confidence < 0.6""")
def replace_open_issues(spark, d):
    a = C.attributes(spark, d)
    fresh = a.where("product_id % 2 = 0 and confidence < 0.6").selectExpr("attribute_id + 10000000 AS validation_id", "product_id", "'open' AS status")
    return M.replace_open_issues(C.issues(spark, d).select("validation_id", "product_id", "status"), fresh, C.products(spark, d).where("product_id % 2 = 0"))


_DECIDED = """x AS (SELECT validation_id, product_id, attribute_id, status, validation_id % 7 = 0 AS wrong, validation_id % 4 AS how, CASE WHEN validation_id % 3 = 0 THEN 'accept_source_a' END AS last,
  CASE WHEN validation_id % 8 < 4 THEN message END AS claim, product_id AS claim_source, CASE WHEN validation_id % 8 >= 4 THEN severity END AS plain, validation_id % 11 = 0 AS odd FROM issues WHERE validation_id % 9 <> 1),
y AS (SELECT *, CASE WHEN odd THEN 'undo' WHEN validation_id % 12 < 4 THEN 'accept_source_a' WHEN validation_id % 12 < 8 THEN 'accept_source_b' ELSE 'custom' END AS resolution, CASE WHEN validation_id % 5 = 0 THEN ' ' WHEN validation_id % 5 < 3 THEN ' v' || validation_id || ' ' END AS given FROM x),
v AS (SELECT *, CASE resolution WHEN 'accept_source_a' THEN coalesce(claim, given) WHEN 'accept_source_b' THEN coalesce(claim || '!', plain, given) WHEN 'custom' THEN nullif(trim(given), '') END AS val,
  CASE WHEN claim IS NOT NULL AND resolution = 'accept_source_a' THEN claim_source WHEN claim IS NOT NULL AND resolution = 'accept_source_b' THEN claim_source + 1 END AS src FROM y),
o AS (SELECT *, CASE WHEN wrong THEN 'wrong_product' WHEN status = 'resolved' THEN CASE WHEN last = resolution THEN 'already_resolved' ELSE 'conflict' END WHEN resolution = 'undo' THEN 'unsupported' WHEN val IS NULL THEN 'no_value' ELSE 'resolved' END AS outcome FROM v),
decided AS (SELECT validation_id, product_id, attribute_id, resolution, outcome, CASE WHEN outcome = 'resolved' THEN val END AS value, CASE WHEN outcome = 'resolved' THEN src END AS source_id FROM o)"""


def _reviewed(spark, d):
    """Issues with claims or plain values to choose from, and what decisions on most of them lead to."""
    i = C.issues(spark, d)
    claim = lambda value, source: F.when(F.col("validation_id") % 8 < 4, F.struct(F.expr(value).alias("raw_value"), F.expr(source).alias("source_id")))
    issues = i.select(
        "validation_id", "product_id", "attribute_id", "status", F.expr("if(validation_id % 3 = 0, 'accept_source_a', null)").alias("last_resolution"), claim("message", "product_id").alias("expected_claim"),
        F.when(F.col("validation_id") % 8 < 4, F.array(F.struct(F.expr("concat(message, '!')").alias("raw_value"), F.expr("product_id + 1").alias("source_id")))).alias("actual_claims"),
        F.when(F.col("validation_id") % 8 >= 4, F.col("severity")).alias("expected_value"), F.lit(None).cast("string").alias("actual_value"),
    )
    decisions = i.where("validation_id % 9 <> 1").selectExpr(
        "validation_id", "if(validation_id % 7 = 0, product_id + 1, product_id) AS product_id",
        "CASE WHEN validation_id % 11 = 0 THEN 'undo' WHEN validation_id % 12 < 4 THEN 'accept_source_a' WHEN validation_id % 12 < 8 THEN 'accept_source_b' ELSE 'custom' END AS resolution",
        "CASE WHEN validation_id % 5 = 0 THEN ' ' WHEN validation_id % 5 < 3 THEN concat(' v', validation_id, ' ') END AS resolved_value", "cast(null AS string) AS notes", "created_at AS decided_at",
    )
    return issues, DC.resolve_issues(issues, decisions)


@query("apply_resolutions", "claims attributes issues", f"WITH {_DECIDED} SELECT validation_id, outcome, value, source_id FROM decided")
def apply_resolutions(spark, d):
    return _reviewed(spark, d)[1].select("validation_id", "outcome", "value", "source_id")


@query("resolved_issues", "claims attributes issues", f"WITH {_DECIDED} SELECT i.validation_id, CASE WHEN outcome = 'resolved' THEN 'resolved' ELSE i.status END AS status, CASE WHEN outcome = 'resolved' THEN resolution WHEN i.validation_id % 3 = 0 THEN 'accept_source_a' END AS last_resolution FROM issues i LEFT JOIN decided USING (validation_id)")
def resolved_issues(spark, d):
    return DC.decided_issues(*_reviewed(spark, d)).select("validation_id", "status", "last_resolution")


@query("resolved_attributes", "claims attributes issues", f"WITH {_DECIDED} SELECT a.attribute_id, coalesce(value, raw_value) AS raw_value, CASE WHEN outcome = 'resolved' THEN 'verified' ELSE status END AS status FROM attributes a LEFT JOIN decided x ON x.attribute_id = a.attribute_id")
def resolved_attributes(spark, d):
    return DC.decided_attributes(C.attributes(spark, d), _reviewed(spark, d)[1]).select("attribute_id", "raw_value", "status")


@query("resolution_audit", "claims attributes issues", f"WITH {_DECIDED} SELECT 'validation_result' AS entity_type, validation_id AS entity_id, 'human_resolution' AS action, resolution, value AS resolved_value FROM decided WHERE outcome = 'resolved'")
def resolution_audit(spark, d):
    x = DC.resolution_audit(_reviewed(spark, d)[1])
    return x.select("entity_type", "entity_id", "action", F.get_json_object("details", "$.resolution").alias("resolution"), F.get_json_object("details", "$.resolved_value").alias("resolved_value"))


_KEPT = "NOT IN (SELECT product_id FROM products WHERE status = 'draft')"


@query("delete_cascade", "products claims attributes issues", f"""SELECT 'attributes' AS table_name, attribute_id AS id, count(*) AS n FROM attributes WHERE product_id {_KEPT} GROUP BY 2
UNION ALL SELECT 'issues', validation_id, count(*) FROM issues WHERE product_id {_KEPT} GROUP BY 2
UNION ALL SELECT 'versions', l_partkey, count(*) FROM lineitem WHERE l_partkey {_KEPT} GROUP BY 2
UNION ALL SELECT 'evidence', a.attribute_id, count(*) FROM attributes a JOIN claims c ON a.product_id = c.product_id AND a.attribute_name = c.attribute_name WHERE a.product_id {_KEPT} GROUP BY 2""")
def delete_cascade(spark, d):
    """Drafts go with their attributes, issues and versions, and with the evidence of those attributes."""
    a = C.attributes(spark, d)
    evidence = C.claims(spark, d).join(a.select("attribute_id", "product_id", "attribute_name"), ["product_id", "attribute_name"]).select("attribute_id", "source_id")
    versions = C.table(spark, d, "lineitem").select(F.col("l_partkey").alias("product_id"), "l_shipdate")
    left = M.delete_products(C.products(spark, d).where("status = 'draft'"), a, {"issues": C.issues(spark, d), "versions": versions}, {"evidence": evidence})
    key = {"attributes": "attribute_id", "issues": "validation_id", "versions": "product_id", "evidence": "attribute_id"}
    counted = [left[t].groupBy(F.lit(t).alias("table_name"), F.col(k).alias("id")).agg(F.count("*").alias("n")) for t, k in key.items()]
    return counted[0].unionByName(counted[1]).unionByName(counted[2]).unionByName(counted[3])


@query("result_cache_filter", "", """SELECT doc_id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0 AND doc_id % 2 = 0)""")
def result_cache_filter(spark, d):
    docs = C.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("cache_key"))
    results = docs.where("doc_id % 3 = 0").selectExpr("cache_key", "'valid' AS status", "if(doc_id % 2 = 0, timestamp'2024-06-01', timestamp'2024-01-01') AS expires_at")
    return M.without_cached(docs, results, F.lit("2024-03-01").cast("timestamp")).select("doc_id")


@query("retry_failed", "jobs", "SELECT job_id, CASE WHEN status = 'failed' THEN 'queued' ELSE status END AS status, CASE WHEN status = 'failed' THEN 0 ELSE failed_items END AS failed_items, CASE WHEN status = 'failed' THEN 2 ELSE 1 END AS attempt FROM jobs")
def retry_failed(spark, d):
    return M.retry_failed(C.jobs(spark, d).withColumn("attempt", F.lit(1))).select("job_id", "status", "failed_items", "attempt")


@query("run_summary", "jobs", "SELECT status, count(*) AS n FROM jobs GROUP BY 1")
def run_summary(spark, d):
    return C.jobs(spark, d).groupBy("status").agg(F.count("*").alias("n"))


@query("enrichment_status", "jobs", "SELECT count(*) AS total, count(*) FILTER (status = 'completed') AS enriched, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'queued') AS pending, round_even(100.0 * count(*) FILTER (status = 'completed') / count(*), 1) AS completion FROM jobs")
def enrichment_status(spark, d):
    of = lambda s: F.count_if(F.col("status") == s)
    return C.jobs(spark, d).agg(F.count("*").alias("total"), of("completed").alias("enriched"), of("failed").alias("failed"), of("queued").alias("pending"), F.bround(100.0 * of("completed") / F.count("*"), 1).alias("completion"))


# ---- ingestion and bulk work


@query("import_dedupe", "", "SELECT p_name AS part_num, min(p_partkey) AS first_row, count(*) AS n FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_partkey % 50 = 0) GROUP BY 1")
def import_dedupe(spark, d):
    p = C.table(spark, d, "part")
    return I.import_new(p.select(F.col("p_name").alias("part_num"), F.col("p_partkey").alias("row")), p.where("p_partkey % 50 = 0").select(F.col("p_name").alias("part_num")), "part_num", "row")


@query("document_dedupe", "", "SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS document_id FROM documents")
def document_dedupe(spark, d):
    return I.dedupe_documents(C.table(spark, d, "documents"), "doc_id", "text").select("doc_id", "document_id")


@query("ingest_file_gate", "", """SELECT page_id, CASE WHEN size = 0 THEN 'empty' WHEN size > 20000 THEN 'too_large' WHEN ext NOT IN ('pdf', 'html', 'txt') THEN 'extension' END AS reason
FROM (SELECT page_id, octet_length(encode(html)) AS size, ['html', 'pdf', 'exe', 'txt'][page_id % 4 + 1] AS ext FROM pages) WHERE ext <> 'pdf' OR size = 0 OR size > 20000
UNION ALL SELECT page_id, 'not_a_pdf' FROM (SELECT page_id, octet_length(encode(html)) AS size, ['html', 'pdf', 'exe', 'txt'][page_id % 4 + 1] AS ext FROM pages) WHERE ext = 'pdf' AND size BETWEEN 1 AND 20000""")
def ingest_file_gate(spark, d):
    files = C.table(spark, d, "pages").select("page_id", F.concat(F.lit("f."), F.element_at(F.array(*map(F.lit, ["html", "pdf", "exe", "txt"])), (F.col("page_id") % 4 + 1).cast("int"))).alias("path"), F.encode("html", "UTF-8").alias("content"))
    return I.gate_files(files, max_bytes=20000, extensions=["pdf", "html", "txt"]).select("page_id", "reason")


@query("table_claims", "", """WITH cells AS (SELECT p_partkey, p_partkey % 5 AS shape, UNNEST([['Brand', p_brand], ['Size', CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_size || ' mm' END], ['Type', p_type]]) AS c FROM part)
SELECT p_partkey AS document_id, lower(c[1]) AS name, CASE WHEN shape = 2 THEN trim('of ' || c[2]) ELSE c[2] END AS value FROM cells WHERE shape < 3 AND (shape = 2 OR c[2] <> '')
UNION ALL SELECT p_partkey, 'finish', 'n/a' FROM part WHERE p_partkey % 5 < 2""")
def table_claims(spark, d):
    """Tables of two headers, of none, of headers that tell names and values, of neither kind, and of numbers."""
    p = C.table(spark, d, "part").withColumn("shape", F.col("p_partkey") % 5)
    two = "array(array('Brand', p_brand), array('Size', if(p_partkey % 4 = 0, '', concat(p_size, ' mm'))), array('Type', p_type), array('Finish', 'n/a'), array('n/a', 'x'), array('7', 'x'), array('A', 'y'), array('Short'))"
    three = "array(array('1', concat('of ', p_brand), 'Brand'), array('x', concat('of ', if(p_partkey % 4 = 0, '', concat(p_size, ' mm'))), 'Size'), array('x', concat('of ', p_type), 'Type'), array('x', 'Rating', 'parameter'))"
    rows = f"CASE shape WHEN 2 THEN {three} WHEN 3 THEN {three} WHEN 4 THEN array(array('1', p_brand), array('2', p_type), array('Sum', '3')) ELSE {two} END AS rows"
    headers = "CASE shape WHEN 0 THEN array('Specification', 'Value') WHEN 1 THEN cast(array() as array<string>) WHEN 2 THEN array('No', ' RATING', 'Parameter') WHEN 3 THEN array('No', 'Price', 'Parameter') ELSE array('Name', 'Value') END AS headers"
    t = p.selectExpr("p_partkey AS document_id", headers, rows)
    return I.table_claims(t, blank_values=()).select("document_id", "name", "value")


_PAGE = 500
_TIDY = "trim(regexp_replace(lower(trim({})), '\\s+', ' ', 'g'))"


@query("verify_evidence", "", f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
p AS (SELECT doc_id, page, {_TIDY.format(f"substr(text, (page - 1) * {_PAGE} + 1, {_PAGE})")} AS t FROM (SELECT doc_id, text, unnest(range(1, 2 + greatest(0, length(text) - 1) // {_PAGE})) AS page FROM d)),
whole AS (SELECT doc_id, string_agg(t, ' ' ORDER BY page) AS corpus FROM p GROUP BY 1),
c AS (SELECT doc_id, k, CASE WHEN k < 4 THEN 'llm' WHEN k < 6 THEN 'deterministic' ELSE 'llm_inference' END AS method, CASE k WHEN 2 THEN 9 ELSE 1 END AS claimed,
  {_TIDY.format("CASE k WHEN 0 THEN substr(text, 11, 40) WHEN 1 THEN substr(text, 521, 40) WHEN 2 THEN substr(text, 11, 40) || ' qqqq zzzz xxxx' WHEN 3 THEN '  ' ELSE substr(text, 11, 40) END")} AS q,
  {_TIDY.format("CASE k WHEN 4 THEN substr(text, 491, 20) ELSE 'qqq ' || doc_id % 50 || ' zzz' END")} AS raw FROM d, range(7) r(k)),
w AS (SELECT *, list_filter(regexp_split_to_array(q, '[|\\s.,;\\-():/]+'), lambda t: length(t) >= 2) AS ts FROM c WHERE method = 'llm' AND q <> ''),
hit AS (SELECT doc_id, k, arg_min(page, CASE WHEN page = claimed THEN 0 ELSE page END) AS page FROM w JOIN p USING (doc_id)
  WHERE contains(t, q) OR (len(ts) >= 2 AND len(list_filter(ts, lambda x: contains(t, x))) >= 0.8 * len(ts)) GROUP BY 1, 2)
SELECT doc_id, k, CASE WHEN method = 'llm' AND page IS NULL THEN 'llm_inference' ELSE method END AS extraction_method, coalesce(page, claimed) AS page_number,
  CASE WHEN method = 'deterministic' THEN (raw <> '' AND (contains(corpus, raw) OR contains(replace(corpus, ' ', ''), replace(raw, ' ', '')))) OR (regexp_extract(raw, '\\d+(?:\\.\\d+)?') <> '' AND contains(corpus, regexp_extract(raw, '\\d+(?:\\.\\d+)?'))) ELSE page IS NOT NULL END AS evidence_verified
FROM c JOIN whole USING (doc_id) LEFT JOIN hit USING (doc_id, k)""")
def verify_evidence(spark, d):
    """Seven claims for each document, one of each kind, against its text in pages."""
    x = C.table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.coalesce("text", F.lit("")).alias("text"))
    pages = f"transform(sequence(1, 1 + cast(greatest(0, length(text) - 1) div {_PAGE} as int)), i -> struct(substring(text, (i - 1) * {_PAGE} + 1, {_PAGE}) as text))"
    claims = x.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(6)))).selectExpr(
        "document_id", "k", "CASE WHEN k < 4 THEN 'llm' WHEN k < 6 THEN 'deterministic' ELSE 'llm_inference' END AS extraction_method", "if(k = 2, 9L, 1L) AS page_number",
        "CASE k WHEN 1 THEN substring(text, 521, 40) WHEN 2 THEN concat(substring(text, 11, 40), ' qqqq zzzz xxxx') WHEN 3 THEN '  ' ELSE substring(text, 11, 40) END AS evidence_text",
        "if(k = 4, substring(text, 491, 20), concat('qqq ', document_id % 50, ' zzz')) AS raw_value",
    )
    got = I.verify_claims(claims, x.select("document_id", F.expr(pages).alias("pages")))
    return got.select(F.col("document_id").alias("doc_id"), "k", "extraction_method", "page_number", "evidence_verified")


@query("bulk_embed", "", """WITH h AS (SELECT doc_id, text, array_to_string(list_transform(range(24), lambda i: sha256(concat_ws(':', text, i))), '') AS h FROM documents),
v AS (SELECT doc_id, text, list_transform(range(384), lambda j: CASE WHEN coalesce(text, '') = '' THEN 0.0::DOUBLE ELSE ('0x' || substr(h, j * 4 + 1, 4))::INT / 65535.0::DOUBLE - 0.5::DOUBLE END) AS v FROM h),
n AS (SELECT doc_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM v)
SELECT doc_id, len(v) AS dims, CASE WHEN n = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS norm2, CASE WHEN n = 0 THEN 0.0 ELSE round_even(v[1] / n, 6) END::DOUBLE AS first FROM n""")
def bulk_embed(spark, d):
    return I.hash_vectors(C.table(spark, d, "documents"), "doc_id", "text", dims=384).select("doc_id", F.size("vector").alias("dims"), F.bround(F.aggregate("vector", F.lit(0.0), lambda s, v: s + v * v), 6).alias("norm2"), F.bround(F.col("vector")[0], 6).alias("first"))
