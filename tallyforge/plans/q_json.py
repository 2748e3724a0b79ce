"""Queries over documents as JSON text of any shape."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scoring as S
from . import catalog as C

Q: dict = {}


def content_hash_nested(spark, d):
    """Every part as a nested document whose keys stand in one of three orders."""
    p = C.table(spark, d, "part")
    name, size, tags = "concat('\"name\": \"', p_name, '\"')", "concat('\"size\":{', if(p_partkey % 2 = 0, concat('\"value\":', p_size, ',\"unit\":\"mm\"'), concat('\"unit\" : \"mm\",\"value\":', p_size)), '}')", "concat('\"tags\":[\"', p_type, '\",{\"k\":', p_partkey % 7, ',\"j\":null}]')"
    text = f"CASE p_partkey % 3 WHEN 0 THEN concat('{{', {name}, ',', {size}, ',', {tags}, '}}') WHEN 1 THEN concat('{{', {tags}, ',', {name}, ' , ', {size}, '}}') ELSE concat('{{ ', {size}, ',', {tags}, ',', {name}, '}}') END"
    return p.select(F.col("p_partkey").alias("product_id"), S.json_hash(F.expr(text)).alias("content_hash"))


Q["content_hash_nested"] = (content_hash_nested, """SELECT p_partkey AS product_id, sha256('{"name":"' || p_name || '","size":{"unit":"mm","value":' || p_size || '},"tags":["' || p_type || '",{"j":null,"k":' || p_partkey % 7 || '}]}') AS content_hash FROM part""")

_RAW = """CASE event_id % 4 WHEN 0 THEN concat('{"attributes":[{"name":"', event_type, '","raw_value":"', event_id, '"},{"specification":"Net Value","value":', event_id, '},"odd"],"features":["', event_type, '",{"b":', event_id, ',"a":"x"},null]}')
  WHEN 1 THEN concat('{"features":"', event_type, '","attributes":[{"key":" ","val":1},{"property":"P Q","val":true,"data_type":"numeric"}]}') WHEN 2 THEN concat('not json ', event_id) ELSE '{"attributes":{"name":"no list"},"features":[7,[]]}' END"""


def extracted_records(spark, d):
    """Every event as what a model might say: lists and single values, objects in lists, aliases of keys, and no JSON at all."""
    out = S.records_from_json(C.table(spark, d, "events").select("event_id", F.expr(_RAW).alias("raw")), "raw", ["features"])
    said = F.array_join(F.transform("attributes", lambda a: F.concat_ws(":", a["name"], a["raw_value"], a["data_type"])), ";")
    return out.select("event_id", said.alias("attributes"), F.array_join("features", ";").alias("features"))


Q["extracted_records"] = (extracted_records, """SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type || ':' || event_id || ':text;net_value:' || CASE WHEN event_id = 0 THEN '' ELSE event_id::VARCHAR END || ':text' WHEN 1 THEN '_:1:text;p_q:True:numeric' ELSE '' END AS attributes,
  CASE event_id % 4 WHEN 0 THEN event_type || ';x' || CASE WHEN event_id = 0 THEN '' ELSE ': ' || event_id END WHEN 1 THEN event_type WHEN 2 THEN '' ELSE '7;[]' END AS features FROM events""")
