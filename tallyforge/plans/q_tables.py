"""Queries that look names and paths up in tables of the data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lookup as K
from . import catalog as C

Q: dict = {}


def query(name: str, views: str, sql: str):
    def put(f):
        Q[name] = (f, C.with_views(views, sql) if views else sql)
        return f

    return put


_RAW = """CASE p_partkey % 7 WHEN 0 THEN upper(p_name) || ' (X1)' WHEN 1 THEN p_brand || ' ' || split_part(p_name, ' ', 1) WHEN 2 THEN p_type || ' ' || p_name WHEN 3 THEN substr(p_name, 2, 6)
  WHEN 4 THEN 'the ' || p_name || ' ' || p_brand || ' company' WHEN 5 THEN 'nothing like it' || p_size ELSE '-- unbranded --' END"""


@query("manufacturer_table_match", "", f"""WITH names AS (SELECT p_name || ' ' || p_brand AS name, min(p_partkey) AS place FROM part GROUP BY 1), r AS (SELECT p_partkey AS product_id, {_RAW} AS raw FROM part),
d AS (SELECT DISTINCT raw, trim(regexp_replace(raw, '\\s*\\(\\w+\\)\\s*$', '')) AS clean FROM r), t AS (SELECT raw, clean, list_distinct(regexp_extract_all(lower(clean), '\\w+')) AS a FROM d),
m AS (SELECT name, place, list_distinct(regexp_extract_all(lower(name), '\\w+')) AS b FROM names),
s AS (SELECT raw, clean, name, place, greatest(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))), CASE WHEN contains(lower(name), lower(clean)) OR contains(lower(clean), lower(name)) THEN 0.8 ELSE 0 END::DOUBLE) AS score FROM t, m),
best AS (SELECT raw, clean, arg_max(name, struct_pack(s := score, p := -place)) AS name, max(score) AS score FROM s GROUP BY 1, 2)
SELECT product_id, CASE WHEN raw = '-- unbranded --' THEN 'Unknown Manufacturer' WHEN score >= 0.3 THEN name ELSE clean END AS manufacturer, CASE WHEN raw = '-- unbranded --' THEN 0.0::DOUBLE WHEN score >= 0.3 THEN round_even(score, 2) ELSE 0.1::DOUBLE END AS mfr_confidence FROM r JOIN best USING (raw)""")
def manufacturer_table_match(spark, d):
    """All product names with their brands as the list, and free texts made of parts of them."""
    p = C.table(spark, d, "part")
    names = p.groupBy(F.concat_ws(" ", "p_name", "p_brand").alias("name")).agg(F.min("p_partkey").alias("place")).selectExpr("name", "place", "name AS brand", "'C' AS code")
    raw = _RAW.replace("split_part(p_name, ' ', 1)", "split(p_name, ' ')[0]")
    return K.match_names(p.select(F.col("p_partkey").alias("product_id"), F.expr(raw).alias("raw")), "raw", names).select("product_id", "manufacturer", "mfr_confidence")


_SEGMENTS = "CASE p_partkey % 4 WHEN 0 THEN upper(p_type || '>' || p_brand || '>' || p_name) WHEN 1 THEN p_brand || '>' || p_name || '>x' WHEN 2 THEN 'y>' || p_type || '>z' ELSE '' END"


@query("classpath_table_match", "", f"""WITH paths AS (SELECT p_type || '>' || p_brand || '>' || p_name AS path, min(p_partkey) AS place FROM part GROUP BY 1), r AS (SELECT p_partkey AS product_id, {_SEGMENTS} AS raw FROM part),
d AS (SELECT DISTINCT raw, list_distinct(string_split(lower(trim(raw)), '>')) AS a FROM r),
s AS (SELECT raw, path, place, CASE WHEN lower(trim(raw)) = lower(path) THEN 1.0::DOUBLE ELSE len(list_intersect(a, string_split(lower(path), '>'))) / len(a) END AS score FROM d, paths),
best AS (SELECT raw, arg_max(path, struct_pack(s := score, p := -place)) AS path, max(score) AS score FROM s GROUP BY 1)
SELECT product_id, CASE WHEN raw <> '' AND score >= 0.4 THEN path ELSE (SELECT arg_min(path, place) FROM paths) END AS class_path, CASE WHEN raw = '' THEN 0.0::DOUBLE WHEN score >= 0.4 THEN round_even(score, 2) ELSE 0.1::DOUBLE END AS class_confidence FROM r JOIN best USING (raw)""")
def classpath_table_match(spark, d):
    p = C.table(spark, d, "part")
    paths = p.groupBy(F.concat_ws(">", "p_type", "p_brand", "p_name").alias("path")).agg(F.min("p_partkey").alias("place"))
    return K.match_paths(p.select(F.col("p_partkey").alias("product_id"), F.expr(_SEGMENTS).alias("raw")), "raw", paths).select("product_id", "class_path", "class_confidence")
