"""A training corpus from raw documents, stage by stage.

Each stage takes the table that its predecessor kept and returns a table with the columns of documents (the last adds its own).
Between stages the tables are written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import decontaminate, jaccard, langid, mixing, substrings
from tallyforge.llm.shared import stored


def _column(name: str) -> Column:
    return F.col(f"`{name}`")


def _whole(docs: DataFrame) -> Column:
    """The rows of ``docs`` as one column, so that no name in them can meet one of a stage's own."""
    return F.struct(*[_column(c) for c in docs.columns]).alias("row")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps rows whose language is clear, each by its own text, whatever its doc_id; learns from their labels, from the two thirds that are not held out."""
    model = langid.train_dictionaries(docs.where(~langid.is_held_out(F.col("doc_id"))).select("text", "lang"))
    others = F.struct(*[_column(c) for c in docs.columns if c != "text"]).alias("row")
    kept = langid.classify(docs.select(others, F.col("text")), model).where("lang_kept")
    return kept.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def _with_keys(docs: DataFrame) -> DataFrame:
    """(key, row): each row of ``docs`` with a number that no two share, in the order of doc_id; null for rows without doc_id.

    It is the doc_id where none is repeated.  Otherwise rows are numbered in the order of doc_id, text and the other columns (the texts by hash).
    """
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return docs.select(F.col("doc_id").cast("long").alias("key"), _whole(docs))
    order = [F.col("row.doc_id"), F.xxhash64("row.text"), F.xxhash64("row")]
    dealt = docs.select(_whole(docs)).repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(dealt.select(F.when(F.col("row.doc_id").isNotNull(), F.monotonically_increasing_id()).alias("key"), "row"), "rows")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows keeps one, of the least doc_id.  Rows that share a doc_id are compared like others, so of exact
    copies with one id a single row stays; rows without doc_id all stay."""
    rows = _with_keys(docs)
    groups = jaccard.jaccard_components(rows.select("key", F.col("row.text").alias("text")), id_col="key")
    gone = groups.where("component_id < id").select(F.col("id").alias("gone"))
    return rows.join(gone, F.col("key") == F.col("gone"), "left_anti").select("row.*")


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes passages of 50 words or more that an earlier document has too out of the texts.

    A document that loses nothing keeps its text as it is; of others, what is left is joined by single spaces, and n_chars is counted
    anew.  Documents of which nothing is left go.  Each row is a document of its own, in the order of doc_id; rows that share one
    each lose what an earlier one of them has, and keep their own texts otherwise.  Rows without doc_id lose nothing.
    """
    rows = _with_keys(docs)
    left = substrings.remove_repeats(rows.select("key", F.col("row.text").alias("text")), id_col="key").where("n_removed > 0").select("id", F.col("text").alias("left"))
    out = rows.join(left, F.col("key") == F.col("id"), "left").where("left is null or left <> ''")
    new = {"text": F.coalesce("left", "row.text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("left").isNotNull(), F.length("left")).otherwise(F.col("row.n_chars")).cast("long")
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def decontaminate_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows whose own text holds a window of a benchmark item, whatever their doc_id: null, or that of other rows too."""
    others = [c for c in docs.columns if c != "text"]
    found = decontaminate.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=others)
    return found.where("n_hit = 0").select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws documents by source; a row for each time one is drawn, with its place in the stream.  Rows that share a doc_id, or have
    none, share a place in their source and are drawn together."""
    return mixing.mix_sources(docs, mixing.count_words(F.col("text")))


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("benchmark_decontamination", decontaminate_benchmarks),
    ("source_mixing", mix),
]

#: Compression and bisection have no SQL; tests hold the stages against small planted tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
