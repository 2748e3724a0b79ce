"""Structured Streaming jobs over document uploads, processing steps and claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import reconcile as R
from .bucketed import BucketedTable, first_of, last_of


def dedupe_uploads(uploads: DataFrame, delay: str = "1 day") -> DataFrame:
    """Uploads (ts, content) with ``content_hash``, each content once within ``delay``; state older than that is dropped."""
    hashed = uploads.withColumn("content_hash", F.sha2("content", 256))
    return hashed.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["content_hash"])


def stage_counts(steps: DataFrame, size: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Steps by window and stage; rows later than ``delay`` are dropped."""
    w = F.window("created_at", size, slide) if slide else F.window("created_at", size)
    out = steps.withWatermark("created_at", delay).groupBy(w.alias("w"), "stage").agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "stage", "n")


def stale_jobs(steps: DataFrame, gap: str = "2 minutes", delay: str = "10 minutes") -> DataFrame:
    """Runs of steps of a job that nothing followed for ``gap``: the moment it counts as stale is the end."""
    w = F.session_window("created_at", gap)
    out = steps.withWatermark("created_at", delay).groupBy(w.alias("w"), "job_id").agg(F.count("*").alias("steps"))
    return out.select("job_id", F.col("w.start").alias("active_from"), F.col("w.end").alias("stale_at"), "steps")


def latest_status(steps: DataFrame) -> DataFrame:
    """The newest step of each job in a batch or in all of a table."""
    return steps.groupBy("job_id").agg(F.max_by(F.struct("stage", "created_at", "step_id"), F.struct("created_at", "step_id")).alias("x")).select("job_id", "x.*")


def keep_latest(stream: DataFrame, path: str, checkpoint: str, buckets: int = 64, **trigger):
    """The newest step of each job, batch by batch, in the table that ``latest_table`` reads."""
    table = latest_table(stream.sparkSession, path, stream.schema, buckets)

    def one(batch: DataFrame, batch_id: int) -> None:
        table.append(batch_id, latest_status(batch))

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latest_table(spark: SparkSession, path: str, steps: T.StructType, buckets: int = 64) -> BucketedTable:
    schema = T.StructType([steps[c] for c in ("job_id", "stage", "created_at", "step_id")])
    return BucketedTable(spark, path, schema, ["job_id"], last_of(["job_id"], "created_at", "step_id"), buckets)


class ReconciledStream:
    """Reconciles the attributes (product_id, attribute_name) that new claims touch, batch by batch, with all their claims so far.

    ``claims`` and ``results`` are bucketed tables under ``path``.  Of one source's claims of an attribute the first counts, by batch.
    ``attributes``: as in ``reconcile``; only rows of touched attributes are looked at.  A batch opens the claims of the buckets it
    touches.  A replayed batch reads the claims as they were then, so it gives what it gave before.
    """

    def __init__(self, spark: SparkSession, path: str, claims: T.StructType, attributes: DataFrame | None = None, buckets: int = 64, most_files: int = 4):
        self.attributes = attributes
        own = [*R.KEY, "source_id"]
        self.claims = BucketedTable(spark, f"{path}/claims", claims, R.KEY, first_of(own, "batch", "trust", "raw_value"), buckets, most_files)
        result = R.reconcile(spark.createDataFrame([], claims), attributes and attributes.limit(0)).schema
        self.results = BucketedTable(spark, f"{path}/reconciled", result, R.KEY, last_of(R.KEY, "batch"), buckets, most_files)

    def take(self, batch: DataFrame, batch_id: int) -> None:
        touched = self.claims.touched(batch)
        self.claims.append(batch_id, batch, touched)
        keys = batch.select(*R.KEY).distinct()
        held = self.claims.read(touched, batch_id).drop("batch").join(keys, R.KEY, "left_semi")
        known = None if self.attributes is None else self.attributes.join(keys, R.KEY, "left_semi")
        self.results.append(batch_id, R.reconcile(held, known), touched)  # a row for each of the batch's keys, in the same buckets

    def start(self, stream: DataFrame, checkpoint: str, **trigger):
        return stream.writeStream.foreachBatch(self.take).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
