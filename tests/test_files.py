"""Folders of documents behind a gate, and deliveries as files."""

import os

import pytest
from pyspark.sql import functions as F

from tallyforge.sources import files as S
from tallyforge.storage import fresh_path


def test_content_is_read_of_candidates_only(spark):
    path = fresh_path(spark, "up")
    rows = [("a.PDF", b"%PDF x"), ("b.pdf", b"<html>"), ("c.txt", b""), ("d.exe", b"x"), ("e.txt", b"y" * 5000), ("f.v2.htm", b"z"), (".pdf", b"%PDF"), ("noext", b"q"), ("e.exe", b"y" * 5000)]
    assert S.write_files(spark.createDataFrame(rows, "name string, content binary"), path) == 9
    os.makedirs(f"{path.removeprefix('file://')}/deep")
    with open(f"{path.removeprefix('file://')}/deep/g.csv", "w") as f:
        f.write("a,b")
    key = "spark.sql.sources.binaryFile.maxLength"
    spark.conf.set(key, "100")  # to read the content of a larger file is an error
    try:
        taken, turned = S.ingest_folder(spark, path, max_bytes=100)
        name = F.element_at(F.split("path", "/"), -1)
        assert {r[0]: bytes(r[1]) for r in taken.select(name, "content").collect()} == {"a.PDF": b"%PDF x", "f.v2.htm": b"z", "g.csv": b"a,b"}
        assert {r[0]: r[1] for r in turned.select(name, "reason").collect()} == {"b.pdf": "not_a_pdf", "c.txt": "empty", "d.exe": "extension", "e.txt": "too_large", "e.exe": "too_large", "noext": "extension"}
    finally:
        spark.conf.unset(key)


def test_a_delivery_comes_back_and_its_faults_are_found(spark):
    path = fresh_path(spark, "delivery")
    rows = spark.createDataFrame([(1, 'say "hi", twice\nand more', None), (2, "", "é"), (3, " pad ", "\\n")], "id long, a string, b string")
    header = ["b", "id", "missing", "a"]
    with pytest.raises(Exception, match="manifest"):
        S.read_delivery(spark, path)
    S.write_delivery(rows.repartition(2), path, header)
    back = S.read_delivery(spark, path)
    assert back.columns == header
    assert sorted(map(tuple, back.collect())) == [("", "1", "", 'say "hi", twice\nand more'), ("\\n", "3", "", " pad "), ("é", "2", "", "")]
    assert S.delivery_faults(spark, path, header).count() == 0
    assert {r["fault"] for r in S.delivery_faults(spark, path, sorted(header)).collect()} == {"header"}
    data = f"{path.removeprefix('file://')}/data"
    part = sorted(f for f in os.listdir(data) if f.endswith(".csv"))
    with open(f"{data}/stray.csv", "w") as f:
        f.write("b,id,missing,a\nx,9,,y\n")  # not in the manifest
    for f in [f for f in os.listdir(data) if f.endswith(".crc")]:
        os.remove(f"{data}/{f}")
    with open(f"{data}/{part[0]}", "a") as f:
        f.write("x,9,,y\n")
    assert S.read_delivery(spark, path).where("id = '9'").count() == 1
    assert [tuple(r) for r in S.delivery_faults(spark, path, header).collect()] == [(part[0], "size")]
    os.remove(f"{data}/{part[0]}")
    assert [tuple(r) for r in S.delivery_faults(spark, path, header).collect()] == [(part[0], "missing")]
    with pytest.raises(ValueError, match="holds a delivery"):
        S.write_delivery(rows, path, header)
    with pytest.raises(ValueError, match="not in the header"):
        S.write_delivery(rows, fresh_path(spark, "delivery"), ["id"])
    empty = fresh_path(spark, "delivery")
    S.write_delivery(rows.where("false"), empty, header)
    assert S.read_delivery(spark, empty).count() == 0


def test_a_document_of_many_claims(spark, monkeypatch):
    """10,000 claims of one document, with and without its text; the pages are joined once for so many claims."""
    from tallyforge.sources import ingest as I

    monkeypatch.setattr(I, "CLAIMS_A_ROW", 300)
    pages = [f"page {i} says value {i * 7} volts and item{i} here" for i in range(20)]
    docs = spark.createDataFrame([(1, [{"text": p} for p in pages]), (2, [])], "document_id long, pages array<struct<text:string>>")
    claims = spark.range(10_000).selectExpr("if(id % 100 = 99, null, if(id % 10 = 0, 2, 1)) AS document_id", "id AS row", "if(id % 2 = 0, 'llm', 'deterministic') AS extraction_method", "cast(id % 150 AS string) AS raw_value", "concat('item', id % 25, ' here') AS evidence_text", "1L AS page_number")
    got = {r["row"]: r for r in I.verify_claims(claims, docs).collect()}
    assert len(got) == 10_000
    corpus = " ".join(pages)
    for i in range(10_000):
        here, r = i % 100 != 99 and i % 10 != 0, got[i]
        if i % 2:
            assert r["evidence_verified"] == (here and str(i % 150) in corpus.replace(" ", "")) and r["page_number"] == 1
        else:
            found = here and i % 25 < 20
            assert (r["extraction_method"], r["evidence_verified"]) == (("llm", True) if found else ("llm_inference", False)), i
            assert not found or r["page_number"] == (i % 25) + 1
