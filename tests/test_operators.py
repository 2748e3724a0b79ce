import pytest
from pyspark.sql import functions as F

from tallyforge.functions import values as V
from tallyforge.operators import maintain as M
from tallyforge.operators import match as K
from tallyforge.operators import reconcile as R
from tallyforge.operators import validate as X
from tallyforge.sources import ingest as I

PRODUCT = "product_id long, sku string, brand string, model string, product_name string"


def test_resolution_levels_and_guards(spark):
    catalog = spark.createDataFrame([(1, "MX-500", "Acme", "M1", "Motor"), (2, "MX-500A", "Acme", "M2", "Pump"), (3, None, "Acme", "M3", "Fan")], PRODUCT)
    incoming = spark.createDataFrame(
        [(11, "mx 500", "ACME", None, None), (12, None, "acme", "m-2", None), (13, "OTHER", "acme", "m2", "Fan"), (14, None, "Beta", "M1", "Motor"), (15, "ZZ", "acme", None, "Motor")],
        PRODUCT.replace("product_id", "incoming_id"),
    )
    got = {r["incoming_id"]: (r["match_id"], r["method"]) for r in K.resolve_entities(incoming, catalog).collect()}
    assert got == {11: (1, "exact_sku_brand"), 12: (2, "model_brand"), 13: (None, "none"), 14: (None, "none"), 15: (None, "none")}


def test_pairs_are_kept_once_with_the_newest_score(spark):
    pairs = spark.createDataFrame([(2, 1, 0.5, "a", 1), (1, 2, 0.9, "b", 2), (3, 3, 1.0, "a", 1)], "a long, b long, score double, method string, seen_at long")
    assert [tuple(r) for r in K.record_pairs(pairs).collect()] == [(1, 2, 0.9, "b")]


def test_upsert_twice_changes_nothing_more(spark):
    old = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "k long, v string, made long")
    new = spark.createDataFrame([(2, None, 99), (3, "c", 30)], "k long, v string, made long")
    once = M.upsert(old, new, ["k"], keep=("made",), if_null=("v",))
    want = [(1, "a", 10), (2, "b", 20), (3, "c", 30)]
    assert sorted(map(tuple, once.collect())) == want
    assert sorted(map(tuple, M.upsert(once, new, ["k"], keep=("made",), if_null=("v",)).collect())) == want


def test_decisions(spark):
    issues = spark.createDataFrame([(1, 7, "open", None), (2, 7, "resolved", "custom"), (3, 7, "resolved", "custom"), (4, 7, "open", None)], "validation_id long, product_id long, status string, last_resolution string")
    decisions = spark.createDataFrame([(1, 7, "custom"), (2, 7, "custom"), (3, 7, "accept_source_a"), (4, 8, "custom")], "validation_id long, product_id long, resolution string")
    assert {r["validation_id"]: r["outcome"] for r in M.decide(issues, decisions).collect()} == {1: "resolved", 2: "already_resolved", 3: "conflict", 4: "wrong_product"}


def test_table_claims_and_a_price_table(spark):
    rows = [(1, ["Specification", "Value"], [["Voltage", "230 V"], ["Power", "5.5 kW"], ["Speed", "1440 RPM"], ["Weight", "32 kg"], ["Specification", "x"], ["Note", "-"]]), (2, ["No", "Price"], [["1", "5"], ["2", "6"], ["Sum", "11"]]), (3, ["a", "b", "c", "d"], [["x", "y", "z", "w"]])]
    got = I.table_claims(spark.createDataFrame(rows, "document_id long, headers array<string>, rows array<array<string>>")).collect()
    assert {(r["document_id"], r["name"], r["value"]) for r in got} == {(1, "voltage", "230 V"), (1, "power", "5.5 kW"), (1, "speed", "1440 RPM"), (1, "weight", "32 kg")}


def test_tables_without_headers_and_with_named_columns(spark):
    rows = [(1, None, [["Voltage", "n/a"], ["Power"], ["", "5"], ["\u2014", "x"]]), (2, ["No", "Value", "Item"], [["x", "5 kg", "Weight"], ["y", "6", "Item"], ["z", None, "Speed"]]), (3, None, [["a", "b", "c"]]), (4, ["Specification", "Other", "More"], [["q", "r", "s"]]), (5, None, None), (6, [], [])]
    got = I.table_claims(spark.createDataFrame(rows, "document_id long, headers array<string>, rows array<array<string>>"), blank_values=()).collect()
    assert {(r["document_id"], r["name"], r["value"]) for r in got} == {(1, "voltage", "n/a"), (2, "weight", "5 kg")}


def test_claims_are_verified_by_method_and_page(spark):
    pages = "document_id long, pages array<struct<text: string, tables: array<struct<headers: array<string>, rows: array<array<string>>>>>>"
    docs = spark.createDataFrame([(1, [("Rated  Voltage 230 V", None), ("Speed 1440", [(["Power"], [["5.5", "kW"]])]), (None, None)]), (2, None)], pages)
    rows = [
        (1, 1, "llm", None, "rated voltage", 1), (2, 1, "llm", None, "speed 1440 power", 1), (3, 1, "llm", None, "5.5 kw", 9), (4, 1, "llm", None, "torque 12 Nm", 2), (5, 1, "llm", None, " ", 1),
        (6, 1, "deterministic", "230V", None, None), (7, 1, "deterministic", "about 1440 rpm", None, 4), (8, 1, "deterministic", "77 kg", None, 1), (9, 1, "llm_inference", "230", "230", 1), (10, 2, "llm", None, "voltage", 1), (11, 3, "deterministic", None, None, 1),
    ]
    claims = spark.createDataFrame(rows, "id long, document_id long, extraction_method string, raw_value string, evidence_text string, page_number long")
    got = {r["id"]: (r["extraction_method"], r["page_number"], r["evidence_verified"]) for r in I.verify_claims(claims, docs).collect()}
    assert got == {
        1: ("llm", 1, True), 2: ("llm", 2, True), 3: ("llm", 2, True), 4: ("llm_inference", 2, False), 5: ("llm_inference", 1, False), 6: ("deterministic", None, True),
        7: ("deterministic", 4, True), 8: ("deterministic", 1, False), 9: ("llm_inference", 1, False), 10: ("llm_inference", 1, False), 11: ("deterministic", 1, False),
    }
    assert I.verify_claims(claims.limit(0), docs.drop("x")).count() == 0


def test_file_gate(spark):
    files = spark.createDataFrame([("a.pdf", b"%PDF-1"), ("b.pdf", b"hello"), ("c.exe", b"MZ"), ("d.txt", b""), ("e.TXT", b"ok"), ("f.txt", b"x" * 50)], "path string, content binary")
    got = {r["path"]: r["reason"] for r in I.gate_files(files, max_bytes=40).collect()}
    assert got == {"a.pdf": None, "b.pdf": "not_a_pdf", "c.exe": "extension", "d.txt": "empty", "e.TXT": None, "f.txt": "too_large"}


def test_part_list_from_csv(spark, tmp_path):
    (tmp_path / "parts.csv").write_text("\ufeffNum,Desc\nA1, drill \n ,nothing\nB2,\n", encoding="utf-8")
    assert sorted(map(tuple, I.read_part_list(spark, str(tmp_path), ["Num", "Desc"]).collect())) == [("A1", "drill"), ("B2", "")]


@pytest.mark.parametrize(("raw", "name", "confidence"), [("Milwaukee Accessory (MILW)", "Milwaukee Accessory", 1.0), ("-- Unbranded --", "Unknown Manufacturer", 0.0), ("-- No Such Brand --", "Unknown Manufacturer", 0.0), ("-- No Any Brand --", "-- No Any Brand --", 0.1), (None, "Unknown Manufacturer", 0.0), ("Zed", "Zed", 0.1)])
def test_manufacturers(spark, raw, name, confidence):
    got = K.match_manufacturers(spark.createDataFrame([(raw,)], "raw string"), "raw", ["-- no such brand --"]).first()
    assert (got["manufacturer"], got["mfr_confidence"]) == (name, confidence)


@pytest.mark.parametrize(("name", "concept"), [("power_rating", "power"), ("Rated Voltage", "voltage"), ("colour", None), ("kw", "power"), ("net mass", "weight")])
def test_concepts(spark, name, concept):
    assert spark.range(1).select(V.match_concept(F.lit(name)).alias("c")).first()["c"] == concept


def test_ranges(spark):
    rows = spark.createDataFrame([("voltage", "0"), ("speed", "0"), ("efficiency", "101"), ("power", "1,500"), ("length", "5d"), ("length", None)], "attribute_name string, value string")
    assert [r["range_issue"] for r in X.check_ranges(rows).collect()] == ["out_of_range", None, "out_of_range", None, "invalid_numeric_value", None]


def test_queries_survive_an_empty_catalog(spark):
    products = spark.createDataFrame([], "product_id long, category string")
    attributes = spark.createDataFrame([], "product_id long, attribute_name string, attribute_id long, raw_value string, confidence double, status string")
    assert X.completeness(products, attributes).count() == 0
    assert X.validate_catalog(products, attributes).count() == 0


def test_reconcile_standardises_units_and_counts_the_attributes_confidence(spark):
    from tallyforge.operators.reconcile import reconcile

    rows = [(1, "weight", 1, "10 pounds", 0.9), (1, "weight", 2, "4.535924 kg", 0.8), (1, "length", 1, "5 millimeter", 0.9), (1, "length", 2, "5 mm", 0.8), (1, "speed", 1, "100 RPM", 0.8)]
    claims = spark.createDataFrame(rows, "product_id long, attribute_name string, source_id long, raw_value string, trust double")
    own = spark.createDataFrame([(1, "speed", "100 RPM", 0.5), (1, "model", "X", 0.7)], "product_id long, attribute_name string, raw_value string, confidence double")
    got = {r["attribute_name"]: (r["status"], r["confidence"], r["winning_value"]) for r in reconcile(claims, own).collect()}
    assert got == {"weight": ("EQUIVALENT", 0.95, "10 pounds"), "length": ("EQUIVALENT", 0.95, "5 millimeter"), "speed": ("MISSING", 0.4, "100 RPM"), "model": ("MISSING", 0.7, "X")}
    assert {r["attribute_name"]: r["confidence"] for r in reconcile(claims).collect()}["speed"] == 0.8
    assert reconcile(claims.limit(0), own).count() == 2


def test_reconcile_broadcasts_no_catalog(spark):
    claims = spark.createDataFrame([(1, "power", 1, "10 W", 0.9), (1, "power", 2, "99 W", 0.8)], "product_id long, attribute_name string, source_id long, raw_value string, trust double")
    own = spark.createDataFrame([(1, "power", "x", 0.5), (2, "power", "y", 0.5)], "product_id long, attribute_name string, raw_value string, confidence double")
    got = R.reconcile(claims, own).where("status = 'CONFLICTING'").select("product_id", "winning_value")
    assert [tuple(r) for r in got.collect()] == [(1, "10 W")]
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
