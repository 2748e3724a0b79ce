from pyspark.sql import functions as F

from tallyforge.functions import values as V
from tallyforge.operators import listings as G
from tallyforge.operators import maintain as M
from tallyforge.operators import parts as PT
from tallyforge.sources import ingest as I


def test_filters_and_pages(spark):
    rows = spark.createDataFrame([(1, "a", 5.0, 1), (2, "a", 7.0, 2), (3, None, 6.0, 2), (4, "b", None, 3), (5, "a", 9.0, 2)], "id long, s string, q double, at long")
    ids = lambda df: [r["id"] for r in df.collect()]
    assert ids(G.page(G.matching(rows, {"s": "a"}, {"q": (5, 7)}), "id")) == [1, 2]
    assert ids(G.page(G.matching(rows, {"s": None}, {"q": (None, 7)}), "id")) == [1, 2, 3]
    assert ids(G.page(rows, "id", ("at",), offset=1, limit=3)) == [2, 3, 5]
    assert ids(G.page(rows, "id", limit=None)) == [1, 2, 3, 4, 5]
    assert ids(G.page(rows, "id", offset=9)) == []


def test_records_without_enrichment(spark):
    records = spark.createDataFrame([(1, "old"), (2, "old"), (3, "old")], "id long, status string")
    enriched = spark.createDataFrame([(1, "completed", 5, True), (2, "failed", None, None)], "id long, status string, score long, needs_review boolean")
    got = {r["id"]: tuple(r)[1:] for r in G.record_list(records, enriched, "id").collect()}
    assert got == {1: ("completed", 5, True), 2: ("failed", 0, False), 3: ("queued", 0, False)}
    assert [r["id"] for r in G.record_list(records, enriched, "id", status="failed").collect()] == [2]
    assert G.record_list(records, enriched, "id", status="queued").count() == 0
    assert [r["id"] for r in G.pending_records(records, enriched, "id").orderBy("id").collect()] == [2, 3]
    assert [r["id"] for r in G.pending_records(records, enriched, "id", limit=1).collect()] == [2]
    empty = G.with_total(records.limit(0), records)
    assert empty.count() == 0 and G.with_total(records.limit(1), records).first()["total"] == 3


def test_overview_of_nothing_is_null(spark):
    products = spark.createDataFrame([], "quality_score double, status string")
    states = spark.createDataFrame([("open",), ("queued",), ("completed",)], "status string")
    r = G.overview(products, states, states, states).first()
    assert (r["products"], r["avg_quality"], r["verification_rate"], r["backlog"], r["active_jobs"], r["processed_documents"]) == (0, None, None, 1, 1, 1)


def test_sources_of_evidence_documents_and_bare_documents(spark):
    sources = spark.createDataFrame([(1, "s1", None, 0.5), (2, "s2", 10, 0.9), (3, "s3", 11, 0.8)], "source_id long, source_name string, document_id long, trust double")
    evidence = spark.createDataFrame([(7, 1), (7, 1), (7, 2), (8, 9)], "product_id long, source_id long")
    links = spark.createDataFrame([(7, 10), (7, 11), (7, 12), (7, 12), (8, 99)], "product_id long, document_id long")
    documents = spark.createDataFrame([(10, "d10"), (12, "d12")], "document_id long, name string")
    got = {(r["source_id"], r["source_name"]): (r["trust"], r["association_type"]) for r in G.sources_of_products(evidence, links, sources, documents).collect()}
    assert got == {(1, "s1"): (0.5, "evidence_source"), (2, "s2"): (0.9, "evidence_source"), (3, "s3"): (0.8, "document_source"), (12, "d12"): (1.0, "document_source")}


def test_pages_and_their_text(spark):
    tables = "array<struct<headers:array<string>,rows:array<array<string>>>>"
    docs = spark.createDataFrame([(1, [(5, " A  b", [(["H"], [["x", None], ["Y"]])]), (None, None, None)]), (2, []), (3, None)], f"document_id long, pages array<struct<page_number:int,text:string,tables:{tables}>>")
    assert [(r["document_id"], r["page_number"], r["text"]) for r in I.explode_pages(docs).orderBy("page_number").collect()] == [(1, 2, None), (1, 5, " A  b")]
    got = {r["document_id"]: (r["pages"], r["corpus"]) for r in I.page_corpus(docs).collect()}
    assert got == {1: (["a b h x y", ""], "a b h x y "), 2: ([], ""), 3: ([], "")}


def test_delivery_columns(spark):
    rows = spark.createDataFrame([(1, ["f", None, "g"], [("n", "v")]), (None, None, None)], "id long, fs array<string>, at array<struct<name:string,value:string>>")
    out = PT.deliver(rows, ["id"], {"fs": (2, []), "at": (2, ["name", "value"])})
    assert out.columns == ["id", "fs_1", "fs_2", "at_1_name", "at_1_value", "at_2_name", "at_2_value"]
    assert sorted(map(tuple, out.collect())) == [("", "", "", "", "", "", ""), ("1", "f", "", "n", "v", "", "")]


def test_import_counts(spark):
    rows = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), (None,)], "k string")
    assert tuple(I.import_counts(rows, spark.createDataFrame([("c",)], "k string"), "k").first()) == (2, 3)
    assert tuple(I.import_counts(rows.limit(0), rows, "k").first()) == (0, 0)


def test_reindex(spark):
    index = spark.createDataFrame([(1, "h1", "old"), (2, "h2", "old"), (3, "h3", "old"), (4, None, "old")], "id long, h string, v string")
    rows = spark.createDataFrame([(1, "h1", "new"), (2, "x", "new"), (5, "h5", "new"), (4, None, "new"), (6, "h6", "new")], "id long, h string, v string")
    gone = spark.createDataFrame([(3,), (6,), (6,)], "id long")
    assert sorted((r["id"], r["v"]) for r in M.reindex(index, rows, "id", "h", gone).collect()) == [(1, "old"), (2, "new"), (4, "old"), (5, "new")]


def test_units_of_values(spark):
    raws = ["230 V", "50Hz", "-1,5 kW", "1440 r/min", "4 - 20 mA", "7", "yes", "abc", "", None, "5 m m"]
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, r string").orderBy("i")
    assert [r["u"] for r in rows.select(V.infer_unit(F.col("r")).alias("u")).collect()] == ["V", "Hz", "kW", "r/min", None, None, None, None, None, None, None]


def test_search_needs_a_text_and_a_product(spark):
    hits = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.8, 2), (2, 10, 0.9, 1)], "query_id long, product_id long, score double, rank int")
    queries = spark.createDataFrame([(1, "motor"), (2, " "), (3, None)], "query_id long, text string")
    products = spark.createDataFrame([(10, "P")], "product_id long, sku string")
    attributes = spark.createDataFrame([(10, "b", "2"), (10, "a", "1")], "product_id long, attribute_name string, raw_value string")
    got = G.search_results(hits, queries, products, attributes).collect()
    assert [(r["query_id"], r["sku"], [tuple(x) for x in r["attributes"]]) for r in got] == [(1, "P", [("a", "1"), ("b", "2")])]
    assert [r["attributes"] for r in G.search_results(hits, queries, products, attributes.limit(0)).collect()] == [None]
