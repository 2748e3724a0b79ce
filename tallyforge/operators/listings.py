"""Listings of products, documents, jobs and part records: filtered, ordered, paged and joined with what belongs to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import dealt_by_size

from .reports import percent


def matching(rows: DataFrame, equal: dict | None = None, between: dict | None = None) -> DataFrame:
    """``rows`` whose columns equal the values of ``equal`` and lie within the bounds of ``between``, ends included; None asks for nothing."""
    for c, value in (equal or {}).items():
        rows = rows if value is None else rows.where(F.col(c) == value)
    for c, (low, high) in (between or {}).items():
        rows = rows if low is None else rows.where(F.col(c) >= low)
        rows = rows if high is None else rows.where(F.col(c) <= high)
    return rows


def page(rows: DataFrame, key: str, newest: tuple[str, ...] = (), offset: int = 0, limit: int | None = 100) -> DataFrame:
    """The rows from ``offset`` on in the order of the ``newest`` columns, the latest first, then of ``key``; all of them if ``limit`` is None."""
    rows = rows.orderBy(*[F.desc(c) for c in newest], key).offset(offset)
    return rows if limit is None else rows.limit(limit)


def record_list(records: DataFrame, enriched: DataFrame, key: str, status: str | None = None, needs_review: bool | None = None) -> DataFrame:
    """``records`` with status, score and needs_review of their row in ``enriched`` (one a key at most); without one they are queued, 0 and false.

    A filter looks at the enriched side, so that it also leaves out the records that have none.
    """
    e = enriched.select(key, F.col("status").alias("_status"), F.col("score").alias("_score"), F.col("needs_review").alias("_review"))
    rows = matching(records.join(e, key, "left"), {"_status": status, "_review": needs_review})
    return rows.select(*[c for c in records.columns if c not in ("status", "score", "needs_review")], F.coalesce("_status", F.lit("queued")).alias("status"), F.coalesce("_score", F.lit(0)).alias("score"), F.coalesce("_review", F.lit(False)).alias("needs_review"))


def with_total(rows: DataFrame, of: DataFrame) -> DataFrame:
    """``rows`` of a page with ``total``, the number of rows that the page is taken from."""
    return rows.crossJoin(F.broadcast(of.agg(F.count("*").alias("total"))))  # one row


def pending_records(records: DataFrame, enriched: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """``records`` that nothing has enriched yet, or whose enrichment is queued or failed; the first ``limit`` by ``key`` if one is given."""
    done = enriched.where(~F.coalesce(F.col("status"), F.lit("")).isin("queued", "failed")).select(key).distinct()
    rows = records.join(done, key, "left_anti")
    return rows if limit is None else rows.orderBy(key).limit(limit)


def product_details(products: DataFrame, attributes: DataFrame) -> DataFrame:
    """``products`` with ``attributes``: a map from name to value (normalised, else raw), unit, raw_value, display_name, data_type, confidence,
    status and source_type.  Attributes have one row a name; those whose name is null are left out.  Products without any have a null map."""
    value = F.struct(F.coalesce("value", "raw_value").alias("value"), "unit", "raw_value", "display_name", "data_type", "confidence", "status", "source_type")
    entries = attributes.where("attribute_name is not null").groupBy("product_id").agg(F.map_from_entries(F.collect_list(F.struct("attribute_name", value))).alias("attributes"))
    return products.join(entries, "product_id", "left")


def sources_of_products(evidence: DataFrame, links: DataFrame, sources: DataFrame, documents: DataFrame, rows: int = 0) -> DataFrame:
    """(product_id, source_id, source_name, document_id, trust, association_type), one row a source of a product.

    They are the sources of the product's ``evidence`` (product_id, source_id), those of its documents in ``links`` (product_id,
    document_id), and for each linked document that no source stands for, the document itself with a trust of 1.  Sources that evidence
    names are evidence_source, others document_source.  ``rows``: about how many rows of evidence and links there are, so that large tables are
    dealt to more tasks.
    """
    s = sources.select("source_id", "source_name", "document_id", "trust")
    links = dealt_by_size(links.select("product_id", "document_id"), rows, "product_id", "document_id").distinct()
    shape = lambda df, used: df.select("product_id", "source_id", "source_name", "document_id", F.col("trust").cast("double").alias("trust"), F.lit(used).alias("used"))
    named = shape(evidence.select("product_id", "source_id").distinct().join(s, "source_id"), 1)
    linked = shape(links.join(s, "document_id"), 0)
    bare = links.join(s.where("document_id is not null").select("document_id").distinct(), "document_id", "left_anti")
    bare = shape(bare.join(documents.select("document_id", "name"), "document_id").select("product_id", F.col("document_id").alias("source_id"), F.col("name").alias("source_name"), "document_id", F.lit(1.0).alias("trust")), 0)
    out = dealt_by_size(named.unionByName(linked).unionByName(bare), rows, "product_id", "source_id").groupBy("product_id", "source_id", "source_name", "document_id", "trust").agg(F.max("used").alias("used"))
    return out.withColumn("association_type", F.when(F.col("used") == 1, "evidence_source").otherwise("document_source")).drop("used")


def job_progress(jobs: DataFrame, items: DataFrame) -> DataFrame:
    """``jobs`` (job_id, status) with the numbers of their ``items`` (job_id, status): total, completed, failed."""
    of = lambda s: F.count_if(F.col("status") == s)
    n = items.groupBy("job_id").agg(F.count("*").alias("total"), of("completed").alias("completed"), of("failed").alias("failed"))
    return jobs.select("job_id", "status").join(n, "job_id", "left").fillna(0, ["total", "completed", "failed"])


def overview(products: DataFrame, documents: DataFrame, jobs: DataFrame, issues: DataFrame) -> DataFrame:
    """One row of headline figures.  Averages and rates of no products are null; without products to review, the backlog is that of open issues."""
    n = F.count("*")
    p = products.agg(n.alias("products"), F.bround(F.avg("quality_score"), 1).alias("avg_quality"), F.when(n > 0, percent(F.count_if(F.col("status") == "verified"), n)).alias("verification_rate"), F.count_if(F.col("status") == "needs_review").alias("_review"))
    d = documents.agg(n.alias("documents"), F.count_if(F.col("status") == "completed").alias("processed_documents"))
    j = jobs.agg(F.count_if(F.col("status").isin("queued", "processing")).alias("active_jobs"))
    i = issues.agg(F.count_if(F.col("status") == "open").alias("_open"))
    one = p.crossJoin(d).crossJoin(j).crossJoin(i)  # one row each
    return one.withColumn("backlog", F.when(F.col("_review") > 0, F.col("_review")).otherwise(F.col("_open"))).drop("_review", "_open")


def search_results(hits: DataFrame, queries: DataFrame, products: DataFrame, attributes: DataFrame) -> DataFrame:
    """``hits`` (query_id, product_id, score, rank) of the ``queries`` (query_id, text) that say something, with the product as it is now
    and its attributes as a list of name and value in the order of names.  Hits whose product is gone are left out."""
    asked = queries.where(F.trim(F.coalesce(F.col("text"), F.lit(""))) != "").select("query_id").distinct()
    wanted = hits.join(asked, "query_id", "left_semi")
    own = attributes.join(wanted.select("product_id").distinct(), "product_id", "left_semi")
    lists = own.groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct(F.col("attribute_name").alias("name"), F.col("raw_value").alias("value")))).alias("attributes"))
    return wanted.join(products, "product_id").join(lists, "product_id", "left")
