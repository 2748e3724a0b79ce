"""Queries that write files, and read them behind a gate or back from a delivery."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import parts as PT
from ..sources import files as S
from ..storage import fresh_path
from . import catalog as C
from .q_listings import _LISTS, Q as LISTINGS, delivery_export

Q: dict = {}


def ingest_files(spark, d):
    """Every page as a file of one of six extensions, a third of the .pdf ones as PDF begin; files over 3000 bytes are too large."""
    path = fresh_path(spark, "uploads")
    ext = F.element_at(F.array(*map(F.lit, ["pdf", "HTM", "exe", "csv", "pdf", "docx"])), (F.col("page_id") % 6 + 1).cast("int"))
    body = F.when(F.col("page_id") % 5 == 0, F.lit("")).when(F.col("page_id") % 3 == 0, F.concat(F.lit("%PDF-1.7 "), F.coalesce("html", F.lit("")))).otherwise(F.coalesce("html", F.lit("")))
    S.write_files(C.table(spark, d, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".v1."), ext).alias("name"), F.encode(body, "UTF-8").alias("content")), path)
    taken, turned = S.ingest_folder(spark, path, max_bytes=3000)
    page = F.regexp_extract("path", r"/p(\d+)\.v1", 1).cast("long").alias("page_id")
    return taken.select(page, "length", F.lit(None).cast("string").alias("reason"), "file_hash").unionByName(turned.select(page, "length", "reason", F.lit(None).cast("string").alias("file_hash")))


Q["ingest_files"] = (ingest_files, """WITH f AS (SELECT page_id, ['pdf', 'htm', 'exe', 'csv', 'pdf', 'docx'][page_id % 6 + 1] AS ext, CASE WHEN page_id % 5 = 0 THEN '' WHEN page_id % 3 = 0 THEN '%PDF-1.7 ' || coalesce(html, '') ELSE coalesce(html, '') END AS body FROM pages),
g AS (SELECT *, octet_length(encode(body)) AS length FROM f),
r AS (SELECT *, CASE WHEN length > 3000 THEN 'too_large' WHEN length = 0 THEN 'empty' WHEN ext = 'exe' THEN 'extension' WHEN ext = 'pdf' AND NOT starts_with(body, '%PDF') THEN 'not_a_pdf' END AS reason FROM g)
SELECT page_id, length, reason, CASE WHEN reason IS NULL THEN sha256(body) END AS file_hash FROM r""")


def delivery_files(spark, d):
    """The delivery written as CSV by the template's header and read back."""
    path, rows = fresh_path(spark, "delivery"), delivery_export(spark, d)
    S.write_delivery(rows, path, rows.columns)
    return S.read_delivery(spark, path)


Q["delivery_files"] = (delivery_files, LISTINGS["delivery_export"][1])


def delivery_compliance(spark, d):
    """Every document's text as a description in a delivery of two columns, a third of them cut to 40 characters in capitals, judged from the files."""
    path = fresh_path(spark, "delivery")
    v = F.when(F.col("doc_id") % 3 == 2, F.substring(V.capitals(F.col("text")), 1, 40)).otherwise(F.col("text"))
    S.write_delivery(C.table(spark, d, "documents").select("doc_id", v.alias("description")), path, ["doc_id", "description", "note"])
    back = S.read_delivery(spark, path)
    faults = S.delivery_faults(spark, path, ["doc_id", "description", "note"]).count()
    return PT.compliance(back, "description", ["doc_id", "description", "note"]).withColumn("file_faults", F.lit(faults).cast("long"))


Q["delivery_compliance"] = (delivery_compliance, """WITH x AS (SELECT CASE WHEN doc_id % 3 = 2 THEN substr(upper(text), 1, 40) ELSE text END AS v FROM documents)
SELECT count(*) AS evaluated, count(*) FILTER (length(v) > 40) AS too_long, count(*) FILTER (v <> upper(v)) AS not_upper, count(*) FILTER (length(v) > 40 OR v <> upper(v)) AS violations, count(*) FILTER (length(v) > 40 OR v <> upper(v)) = 0 AS compliant, true AS same_header, 0::BIGINT AS file_faults FROM x""")
