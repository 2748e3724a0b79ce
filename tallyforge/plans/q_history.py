"""Queries over versions, states as of a version or a day, and audits with states."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history as H
from . import catalog as C

Q: dict = {}
_FIELDS = {"supplier": "bigint", "quantity": "int", "flag": "string", "note": "string"}


def query(name: str, views: str, sql: str):
    def put(f):
        Q[name] = (f, C.with_views(views, sql) if views else sql)
        return f

    return put


_LOG = """st AS (SELECT l_partkey AS product_id, l_shipdate AS day, l_orderkey AS ord, l_linenumber AS line, l_suppkey % 3 AS supplier, CAST(l_quantity AS INT) % 4 AS quantity, l_returnflag AS flag, CASE WHEN l_quantity > 40 THEN NULL ELSE l_linestatus END AS note FROM lineitem),
b AS (SELECT *, row_number() OVER w AS rn, lag(supplier) OVER w AS s0, lag(quantity) OVER w AS q0, lag(flag) OVER w AS f0, lag(note) OVER w AS n0 FROM st WINDOW w AS (PARTITION BY product_id ORDER BY day, ord, line)),
c AS (SELECT *, rn = 1 OR supplier IS DISTINCT FROM s0 AS sc, rn = 1 OR quantity IS DISTINCT FROM q0 AS qc, rn = 1 OR flag IS DISTINCT FROM f0 AS fc, rn = 1 OR note IS DISTINCT FROM n0 AS nc FROM b),
v AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY day, ord, line) AS version_number FROM c WHERE sc OR qc OR fc OR nc)"""


def _states(spark, d):
    return C.table(spark, d, "lineitem").selectExpr(
        "l_partkey AS product_id", "l_shipdate AS day", "l_orderkey AS ord", "l_linenumber AS line", "l_suppkey % 3 AS supplier", "cast(l_quantity as int) % 4 AS quantity", "l_returnflag AS flag", "if(l_quantity > 40, null, l_linestatus) AS note"
    )


def _log(spark, d):
    return H.version_log(_states(spark, d), "product_id", ["day", "ord", "line"], list(_FIELDS), full_every=5)


@query("version_log", "", f"""WITH {_LOG}, x AS (SELECT *, (version_number - 1) % 5 = 0 AS is_full FROM v)
SELECT product_id, version_number, is_full, concat_ws(',', CASE WHEN is_full OR sc THEN 'supplier=' || supplier END, CASE WHEN is_full OR qc THEN 'quantity=' || quantity END, CASE WHEN is_full OR fc THEN 'flag=' || flag END, CASE WHEN is_full OR nc THEN 'note=' || coalesce(note, 'null') END) AS changes,
  concat_ws(',', CASE WHEN sc THEN 'supplier' END, CASE WHEN qc THEN 'quantity' END, CASE WHEN fc THEN 'flag' END, CASE WHEN nc THEN 'note' END) AS changed_fields FROM x""")
def version_log(spark, d):
    """Every change of the lines that name a product, a full state in five."""
    return _log(spark, d).select("product_id", "version_number", "is_full", H.as_text(F.col("changes"), list(_FIELDS)).alias("changes"), F.array_join("changed_fields", ",").alias("changed_fields"))


@query("version_as_of", "", f"WITH {_LOG}, m AS (SELECT product_id, 1 + (product_id * 7) % 40 AS as_of FROM (SELECT DISTINCT product_id FROM st)) SELECT product_id, as_of, version_number, supplier, quantity, flag, note FROM v JOIN m USING (product_id) WHERE version_number <= as_of QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY version_number DESC) = 1")
def version_as_of(spark, d):
    log = _log(spark, d)
    wanted = C.table(spark, d, "lineitem").select(F.col("l_partkey").alias("product_id")).distinct().withColumn("as_of", 1 + (F.col("product_id") * 7) % 40)
    return H.state_as_of(log, wanted, "product_id", _FIELDS)


@query("state_on_a_day", "", f"WITH {_LOG}, m AS (SELECT product_id, CAST(DATE '1995-01-01' + CAST(product_id % 1500 AS INT) AS DATE) AS as_of FROM (SELECT DISTINCT product_id FROM st)) SELECT product_id, as_of, version_number, supplier, quantity, flag, note FROM v JOIN m USING (product_id) WHERE day <= as_of QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY version_number DESC) = 1")
def state_on_a_day(spark, d):
    wanted = C.table(spark, d, "lineitem").select(F.col("l_partkey").alias("product_id")).distinct().withColumn("as_of", F.expr("date_add(date'1995-01-01', cast(product_id % 1500 as int))"))
    return H.state_as_of(_log(spark, d), wanted, "product_id", _FIELDS, by="day")


@query("audit_states", "products", """WITH o AS (SELECT product_id, status, quality_score, brand FROM products WHERE product_id % 5 <> 0), n AS (SELECT product_id, CASE WHEN product_id % 4 = 0 THEN 'verified' ELSE status END AS status, CASE WHEN product_id % 3 = 0 THEN NULL ELSE quality_score END AS quality_score, brand FROM products WHERE product_id % 7 <> 0),
x AS (SELECT product_id, o.product_id IS NULL AS made, n.product_id IS NULL AS gone, o.status AS so, n.status AS sn, o.quality_score AS qo, n.quality_score AS qn, o.brand AS bo, n.brand AS bn FROM o FULL OUTER JOIN n USING (product_id)),
y AS (SELECT *, made OR gone OR so IS DISTINCT FROM sn AS sc, made OR gone OR qo IS DISTINCT FROM qn AS qc, made OR gone OR bo IS DISTINCT FROM bn AS bc FROM x)
SELECT product_id, CASE WHEN made THEN 'created' WHEN gone THEN 'deleted' ELSE 'updated' END AS action, concat_ws(',', CASE WHEN sc THEN 'status' END, CASE WHEN qc THEN 'quality_score' END, CASE WHEN bc THEN 'brand' END) AS changed_fields,
  CASE WHEN NOT made THEN concat_ws(',', CASE WHEN sc THEN 'status=' || so END, CASE WHEN qc THEN 'quality_score=' || coalesce(CAST(CAST(qo AS BIGINT) AS VARCHAR), 'null') END, CASE WHEN bc THEN 'brand=' || bo END) ELSE '' END AS before,
  CASE WHEN NOT gone THEN concat_ws(',', CASE WHEN sc THEN 'status=' || sn END, CASE WHEN qc THEN 'quality_score=' || coalesce(CAST(CAST(qn AS BIGINT) AS VARCHAR), 'null') END, CASE WHEN bc THEN 'brand=' || bn END) ELSE '' END AS after FROM y WHERE sc OR qc OR bc""")
def audit_states(spark, d):
    fields = ["status", "quality_score", "brand"]
    p = C.products(spark, d).select("product_id", "status", F.col("quality_score").cast("long").alias("quality_score"), "brand")
    new = p.where("product_id % 7 <> 0").withColumn("status", F.when(F.col("product_id") % 4 == 0, "verified").otherwise(F.col("status"))).withColumn("quality_score", F.when(F.col("product_id") % 3 != 0, F.col("quality_score")))
    x = H.audit_log(p.where("product_id % 5 <> 0"), new, "product_id", fields)
    text = lambda c: F.coalesce(H.as_text(F.col(c), fields), F.lit(""))
    return x.select("product_id", "action", F.array_join("changed_fields", ",").alias("changed_fields"), text("before").alias("before"), text("after").alias("after"))
