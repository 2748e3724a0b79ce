"""Canonical JSON, hashes that don't depend on the order of keys, and extracted records of any shape."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from tallyforge.operators import scoring as S


def _shuffled(x, rng):
    if isinstance(x, dict):
        keys = list(x)
        rng.shuffle(keys)
        return {k: _shuffled(x[k], rng) for k in keys}
    return [_shuffled(v, rng) for v in x] if isinstance(x, list) else x


def test_order_of_keys_at_any_depth_does_not_change_the_hash(spark):
    doc = {"b": [{"z": 1, "a": {"y": None, "x": [True, 2.5, "é \"q\""]}}, []], "a": {"k2": "v", "k1": {"n": -3}}, "Z": ""}
    rng = random.Random(1)
    texts = [json.dumps(_shuffled(doc, rng), indent=i % 3 or None) for i in range(6)]
    other = json.dumps(doc | {"Z": "!"})
    got = [r[0] for r in spark.createDataFrame([(t,) for t in [*texts, other, "not json", None]], "t string").select(S.json_hash(F.col("t"))).collect()]
    want = hashlib.sha256(json.dumps(doc, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    assert got[:6] == [want] * 6 and got[6] != want and got[7] == hashlib.sha256(b"not json").hexdigest() and got[8] is None


def test_nested_columns_are_hashed_by_name(spark):
    rows = spark.sql("SELECT map('b', named_struct('y', 1, 'x', array('q')), 'a', named_struct('y', 2, 'x', array())) AS m UNION ALL SELECT map('a', named_struct('y', 2, 'x', array()), 'b', named_struct('y', 1, 'x', array('q')))")
    got = [r[0] for r in rows.select(S.content_hash(m=F.col("m"), n=F.lit(1))).collect()]
    assert got == [hashlib.sha256(b'{"m":{"a":{"x":[],"y":2},"b":{"x":["q"],"y":1}},"n":1}').hexdigest()] * 2


def test_records_of_any_shape(spark):
    doc = {
        "attributes": [
            {"name": "power", "raw_value": "5 kW", "data_type": "numeric", "extraction_method": "deterministic"}, {"specification": "Rated Speed", "value": 1500}, {"name": "", "key": "Net Mass", "val": "3 kg", "data_type": "odd", "extraction_method": "?"},
            {"raw_value": 0, "value": "unused"}, {"name": "  "}, {"name": "list", "value": ["a", {"b": 1}]}, "text", None, {"property": "p", "raw_value": None, "value": False, "val": "x", "display_name": "P!"},
        ],
        "features": ["one", {"title": "Two", "n": 2, "off": False}, None, 3, True, {}, ["x"]], "keywords": "alone", "applications": {"a": 1}, "certifications": None,
    }
    lists = ["features", "keywords", "applications", "certifications", "images"]
    rows = spark.createDataFrame([(1, json.dumps(doc)), (2, "nope"), (3, None), (4, "[1]")], "id long, raw string")
    got = {r["id"]: r for r in S.records_from_json(rows, "raw", lists).collect()}
    assert [tuple(a) for a in got[1]["attributes"]] == [
        ("power", "power", "5 kW", "numeric", "deterministic"), ("rated_speed", "Rated Speed", "1500", "text", "llm"), ("net_mass", "Net Mass", "3 kg", "text", "llm"), ("unknown_attribute", "unknown_attribute", "0", "text", "llm"),
        ("list", "list", '["a",{"b":1}]', "text", "llm"), ("p", "P!", "x", "text", "llm"),
    ]
    assert got[1]["features"] == ["one", "2: Two", "3", "True", '["x"]'] and got[1]["keywords"] == ["alone"]
    assert got[1]["applications"] == got[1]["certifications"] == got[1]["images"] == []
    assert all(got[i]["attributes"] == [] and got[i]["features"] == [] for i in (2, 3, 4))


def test_a_field_is_looked_at_once(spark):
    """Names and values stand in many places of the expression; each is read once for all of them."""
    from tallyforge.operators.scoring import records_from_json

    raw = '{"attributes":[{"key":"Net Value","value":true},{"name":" "},{"label":1,"val":0}],"features":[{"b":2,"a":"x"},null,"y"]}'
    got = records_from_json(spark.createDataFrame([(1, raw)], "id long, raw string"), "raw", ["features"])
    spark.conf.set("spark.sql.debug.maxToStringFields", "100000")
    assert got._jdf.queryExecution().optimizedPlan().toString().lower().replace("_", "").count("schemaofvariant") <= 60
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    r = got.first()
    assert [(a["name"], a["display_name"], a["raw_value"]) for a in r["attributes"]] == [("net_value", "Net Value", "True"), ("unknown_attribute", "unknown_attribute", "")] and r["features"] == ["x: 2", "y"]
