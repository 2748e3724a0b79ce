"""Reading, gating and deduplicating inputs; claims and evidence from pages."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import values as V
from ..storage import stored


def read_part_list(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The ``columns`` of a supplier's CSV with header; the first is the part number, and rows without one are left out.  Nulls become ''."""
    rows = spark.read.option("header", True).csv(path)
    picked = rows.select(*[F.coalesce(F.trim(F.col(c)), F.lit("")).alias(c) for c in columns])
    return picked.where(F.col(columns[0]) != "")


def write_snapshot(table: DataFrame, path: str, *partitions: str) -> None:
    """Replace the partitions that ``table`` has and leave the others."""
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def import_new(rows: DataFrame, target: DataFrame, key: str, order: str) -> DataFrame:
    """(key, first_row, n) of keys that the target doesn't have; the first row of a key is the one to keep."""
    return rows.join(target.select(key).distinct(), key, "left_anti").groupBy(key).agg(F.min(order).alias("first_row"), F.count("*").alias("n"))


def import_counts(rows: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """One row: how many ``rows`` an import takes (the first of each key that the target doesn't have) and how many it skips."""
    known = target.select(key).distinct().withColumn("_known", F.lit(True))
    keys = rows.groupBy(key).agg(F.count("*").alias("n")).join(known, key, "left")
    out = keys.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count_if(F.col("_known").isNull() & F.col(key).isNotNull()).alias("imported"))
    return out.select("imported", (F.col("total") - F.col("imported")).alias("skipped"))


def dedupe_documents(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """``docs`` with ``document_id``, the least id with the same bytes.  Only ids and digests are shuffled."""
    keyed = docs.select(id_col, F.sha2(text, 256).alias("digest"))
    least = keyed.groupBy("digest").agg(F.min(id_col).alias("document_id"))
    return keyed.join(least, "digest")


# Extensions of documents that are taken.
EXTENSIONS = ["pdf", "xlsx", "xls", "docx", "pptx", "csv", "txt", "html", "htm"]


def gate_files(files: DataFrame, max_bytes: int = 50 << 20, extensions: list[str] | None = None) -> DataFrame:
    """``files`` (path, content) with ``reason``: why a file is turned away, null if it is taken."""
    size, ext = F.length("content"), F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1))
    reason = F.when(size == 0, "empty").when(size > max_bytes, "too_large").when(~ext.isin(extensions or EXTENSIONS), "extension")
    return files.withColumn("reason", reason.when((ext == "pdf") & (F.substring("content", 1, 4) != F.lit(b"%PDF")), "not_a_pdf"))


# Headers of columns that hold names and values.
NAME_HEADERS = ["specification", "parameter", "attribute", "property", "feature", "item", "name"]
VALUE_HEADERS = ["value", "rating", "quantity", "measurement", "reading", "data", "specification"]
_NUMBER = r"^\d+(?:\.\d+)?$"


def table_claims(tables: DataFrame, blank_values: tuple[str, ...] = ("n/a", "-", "\u2014")) -> DataFrame:
    """(document_id, name, display_name, value, ...) from tables (document_id, headers, rows) of names and values: one claim for each usable row.

    The columns are the first two of a table with two headers, or of one without headers whose first five rows have two cells at
    most; else those under the first header for names and the first for values.  A table with numbers in over 40 % of its first cells
    gives nothing, and neither does one with null rows or none.  Values that are ``blank_values``, whatever their case, are left out like
    empty ones; () keeps them.
    """
    first = F.transform(F.filter("rows", lambda r: F.size(r) > 0), lambda r: F.trim(r[0]))
    numeric = F.size(F.filter(first, lambda x: x.rlike(_NUMBER)))
    width = F.array_max(F.transform(F.slice("rows", 1, 5), F.size))
    headers = F.coalesce("headers", F.array().cast("array<string>"))
    keys = F.transform(headers, lambda h: F.lower(F.trim(F.coalesce(h, F.lit("")))))
    at = lambda words: F.array_position(F.transform(keys, lambda k: k.isin(words)), True) - 1
    narrow = (F.size(headers) == 2) | ((F.size(headers) == 0) & (width == 2))
    shaped = tables.where(numeric <= 0.4 * F.size(first)).select(
        "document_id", headers.alias("headers"), "rows", F.when(narrow, 0).when(F.size(headers) > 0, at(NAME_HEADERS)).otherwise(-1).cast("int").alias("k"), F.when(narrow, 1).when(F.size(headers) > 0, at(VALUE_HEADERS)).otherwise(-1).cast("int").alias("v")
    )
    cells = shaped.where("k >= 0 and v >= 0 and k <> v").select("document_id", "headers", "k", "v", F.explode("rows").alias("r"))
    cells = cells.select("document_id", "headers", F.trim(F.get("r", F.col("k"))).alias("n"), F.trim(F.get("r", F.col("v"))).alias("value"))
    repeats = F.exists("headers", lambda h: F.coalesce(F.lower(h) == F.lower("n"), F.lit(False)))
    name = V.canonical_attribute_name(F.col("n"))
    usable = (F.col("value") != "") & ~F.lower("value").isin(*blank_values) & ~F.lower("n").isin("", "n/a", "-", "\u2014") & ~F.col("n").rlike(_NUMBER) & ~repeats & (F.length(name) >= 2)
    return cells.where(usable).select(
        "document_id", name.alias("name"), F.col("n").alias("display_name"), "value", F.lit("deterministic").alias("extraction_method"), F.lit(0.88).alias("model_confidence"), F.concat_ws(" | ", "n", "value").alias("evidence_text")
    )


def _page_text(documents: DataFrame):
    """A function that gives the normalised text of a page of ``documents``: its text, then the headers and cells of its tables."""
    none = F.array().cast("array<string>")
    tables = "tables" in documents.schema["pages"].dataType.elementType.names

    def text(page):
        cells = none
        if tables:
            cells = F.coalesce(F.flatten(F.transform(page["tables"], lambda t: F.concat(F.coalesce(t["headers"], none), F.coalesce(F.flatten(t["rows"]), none)))), none)
        return F.trim(V.normalize_text(F.array_join(F.concat(F.array(F.coalesce(page["text"], F.lit(""))), cells), " ")))

    return text


def explode_pages(documents: DataFrame) -> DataFrame:
    """(document_id, page_number, ...): a row for each of ``pages``, with its own fields; pages without a number take their place.
    Documents without pages have no row."""
    fields = documents.schema["pages"].dataType.elementType.names
    rows = documents.select("document_id", F.posexplode("pages").alias("_at", "_page"))
    number = (F.col("_at") + 1).cast("long")
    if "page_number" in fields:
        number = F.coalesce(F.col("_page.page_number").cast("long"), number)
    return rows.select("document_id", number.alias("page_number"), *[F.col(f"_page.{c}") for c in fields if c != "page_number"])


def page_corpus(documents: DataFrame) -> DataFrame:
    """(document_id, pages, corpus): the normalised text of each page, with table headers and cells, and all of them joined by spaces."""
    out = documents.select("document_id", F.coalesce(F.transform("pages", _page_text(documents)), F.array().cast("array<string>")).alias("pages"))
    return out.withColumn("corpus", F.array_join("pages", " "))


#: Claims of a document that are held against its pages in one row.
CLAIMS_A_ROW = 512


def verify_claims(claims: DataFrame, documents: DataFrame) -> DataFrame:
    """``claims`` (document_id, extraction_method, raw_value, evidence_text, page_number, ...) with ``evidence_verified``, held against
    ``documents`` (document_id, pages: text and, where they have them, tables of headers and rows).

    deterministic: the value stands in the document, spaces aside, or else its first number does.  llm: the quote, or four fifths of
    its two or more words, stands on the claimed page or else on the first page that has it, whose number the claim then takes; a claim
    without a quote, or with one that is found nowhere, becomes llm_inference.  llm_inference and other methods: not verified.

    A document is a row.  Its claims are gathered first, some CLAIMS_A_ROW to a row, so its pages are copied once for so many claims and
    cleaned once for them; a document with a third of all claims is many such rows.  A claim whose document is missing, or null, is held against no text.
    """
    clean = lambda x: F.trim(V.normalize_text(F.coalesce(x, F.lit(""))))
    bare = lambda x: F.replace(x, F.lit(" "), F.lit(""))
    none = F.array().cast("array<string>")
    q, raw = clean(F.col("evidence_text")), clean(F.col("raw_value"))
    own = F.struct(
        F.struct(*[F.col(f"`{c}`") for c in claims.columns]).alias("row"), q.alias("q"), raw.alias("raw"),
        F.filter(F.split(q, r"[|\s.,;\-():/]+"), lambda t: F.length(t) >= 2).alias("words"), F.regexp_extract(raw, r"\d+(?:\.\d+)?", 0).alias("number"),
    )
    dealt = stored(claims.select(F.col("document_id").alias("doc"), own.alias("claim"), F.monotonically_increasing_id().alias("at")), "claims")
    sizes = dealt.groupBy("doc").agg(F.ceil(F.count("*") / CLAIMS_A_ROW).alias("parts")).select(F.col("doc").alias("counted"), "parts")
    rows = dealt.join(sizes, F.col("doc").eqNullSafe(F.col("counted"))).select("doc", "claim", F.pmod(F.xxhash64("at"), F.col("parts")).alias("part"))
    held = rows.groupBy("doc", "part").agg(F.collect_list("claim").alias("claims"))
    text = _page_text(documents)
    both = held.join(documents.select(F.col("document_id").alias("of"), "pages"), F.col("doc") == F.col("of"), "left")
    pages = F.coalesce(F.transform("pages", text), none)

    def judge(d: Column) -> Column:
        def one(c: Column) -> Column:
            def holds(page: Column) -> Column:
                found = F.size(F.filter(c["words"], lambda t: F.contains(page, t)))
                return F.contains(page, c["q"]) | ((F.size(c["words"]) >= 2) & (found >= 0.8 * F.size(c["words"])))

            number = c["row"]["page_number"]
            claimed = F.when(number >= 1, F.get(d["pages"], (number - 1).cast("int")))
            first = F.array_position(F.transform(d["pages"], holds), True)
            page = F.when(F.coalesce(holds(claimed), F.lit(False)), number).when(first > 0, first).cast("long")
            page = F.when((c["row"]["extraction_method"] == "llm") & (c["q"] != ""), page)
            stands = (c["raw"] != "") & (F.contains(d["corpus"], c["raw"]) | F.contains(d["bare"], bare(c["raw"])))
            stands = F.when(c["row"]["extraction_method"] == "deterministic", stands | ((c["number"] != "") & F.contains(d["corpus"], c["number"])))
            return F.struct(c["row"].alias("row"), page.alias("page"), stands.alias("stands"))

        return F.transform(d["claims"], one)

    corpus = lambda p: F.array_join(p, " ")
    whole = V.let(F.struct(pages.alias("pages"), F.col("claims").alias("claims")), lambda d: V.let(F.struct(d["pages"].alias("pages"), corpus(d["pages"]).alias("corpus"), bare(corpus(d["pages"])).alias("bare"), d["claims"].alias("claims")), judge))
    out = both.select(F.explode(whole).alias("x")).select("x.row", "x.page", "x.stands")
    method = F.col("row.extraction_method")
    new = {"extraction_method": F.when((method == "llm") & F.col("page").isNull(), "llm_inference").otherwise(method), "page_number": F.coalesce("page", "row.page_number")}
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in claims.columns], F.when(method == "deterministic", F.col("stands")).otherwise(F.col("page").isNotNull()).alias("evidence_verified"))


def hash_vectors(rows: DataFrame, id_col: str, text: str, dims: int = 384) -> DataFrame:
    """(id, vector): a deterministic unit vector of each text from salted digests, 16 values a digest; zeros for empty texts.

    A text is hashed once; each salt goes on from there.
    """
    schema = T.StructType([rows.schema[id_col], T.StructField("vector", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts = [str(i).encode() for i in range((dims + 15) // 16)]
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                v = np.zeros((batch.num_rows, dims))
                for i, x in enumerate(batch.column(1).to_pylist()):
                    if x:
                        begun = hashlib.sha256(x.encode() + b":")
                        digests = []
                        for salt in salts:
                            one = begun.copy()
                            one.update(salt)
                            digests.append(one.digest())
                        v[i] = np.frombuffer(b"".join(digests), ">u2")[:dims] / 65535.0 - 0.5
                n = np.sqrt((v * v).sum(1, keepdims=True))
                v = np.divide(v, n, out=np.zeros_like(v), where=n > 0)
                ends = pa.array(np.arange(len(v) + 1) * dims, pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(v.ravel()))], names=schema.names)

    return rows.select(id_col, text).mapInArrow(run, schema)

