"""Queries that write and read back: streams over the events, run to their end, and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reconcile as R
from ..sources import ingest as I
from ..storage import fresh_path
from ..streaming import streams as S
from ..streaming import timers as T
from . import catalog as C
from .q_catalog import RECONCILED, declared

Q: dict = {}


def _folder(spark) -> str:
    return fresh_path(spark, "stream")


def scan_part_list_csv(spark, d):
    """The part table as a supplier's CSV, read again."""
    path = f"{_folder(spark)}/parts.csv"
    number = "if(p_partkey % 9 = 0, ' ', concat('P', p_partkey))"
    C.table(spark, d, "part").selectExpr(f"{number} AS num", "concat(' ', p_name) AS name", "if(p_partkey % 4 = 0, null, p_brand) AS brand").write.option("header", True).csv(path)
    return I.read_part_list(spark, path, ["num", "name", "brand"])


def snapshot_write(spark, d):
    """Products by status; then the drafts alone are written again, and the other partitions stay."""
    path = f"{_folder(spark)}/products"
    p = C.products(spark, d).select("product_id", "quality_score", "status")
    I.write_snapshot(p, path, "status")
    I.write_snapshot(p.where("status = 'draft' and product_id % 2 = 0"), path, "status")
    return spark.read.parquet(path).select("product_id", "quality_score", F.col("status").cast("string").alias("status"))


def _is_folder(spark, d) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/events.parquet")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()


def _steps(spark, d):
    schema = C.table(spark, d, "events").schema
    folder = _is_folder(spark, d)
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet" if folder else "events.parquet").parquet(f"{d}/events.parquet" if folder else d)
    return raw.selectExpr("event_id AS step_id", "user_id AS job_id", "event_type AS stage", "cast(ts as timestamp) AS created_at", "value")


def _run(spark, out, mode):
    path = _folder(spark)
    out.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/out")


def _local(df, *columns):
    """Times as the input has them, without a zone."""
    return df.withColumns({c: df[c].cast("timestamp_ntz") for c in columns})


def stream_stage_counts(spark, d):
    return _local(_run(spark, S.stage_counts(_steps(spark, d)), "append"), "window_start", "window_end")


def stream_stale_jobs(spark, d):
    return _local(_run(spark, S.stale_jobs(_steps(spark, d)), "append"), "active_from", "stale_at")


def stream_stale_timers(spark, d):
    with T.rocksdb_state(spark):
        return _local(_run(spark, T.stale_jobs_by_timer(_steps(spark, d)), "append"), "active_from", "stale_at")


def stream_dedupe(spark, d):
    """Events as uploads of their properties: each content once a day."""
    uploads = _steps(spark, d).selectExpr("created_at AS ts", "concat_ws(':', stage, cast(value AS int)) AS content")
    return _local(_run(spark, S.dedupe_uploads(uploads), "append"), "ts")


def stream_latest_status(spark, d):
    path, steps = _folder(spark), _steps(spark, d)
    S.keep_latest(steps, f"{path}/table", f"{path}/state").awaitTermination()
    return S.latest_table(spark, f"{path}/table", steps.schema).read().select("job_id", "step_id", "stage")


def stream_reconcile(spark, d):
    """All claims in some four batches, reconciled as they come with the confidence of the catalog's attributes; in the end as if all had been there at once."""
    path, claims = _folder(spark), C.claims(spark, d)
    claims.repartition(4, "source_id").write.parquet(f"{path}/new")
    stream = spark.readStream.schema(claims.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/new")
    kept = S.ReconciledStream(spark, path, claims.schema, declared(spark, d), buckets=8)
    kept.start(stream, f"{path}/state").awaitTermination()
    return kept.results.read().select(*R.KEY, "n_claims", "winner", "status", "confidence")


#: Which of two uploads within a day comes first in a batch isn't fixed, so there is no SQL.
Q["stream_dedupe"] = (stream_dedupe, None)
Q["stream_latest_status"] = (stream_latest_status, "SELECT user_id AS job_id, arg_max(event_id, struct_pack(a := ts, b := event_id)) AS step_id, arg_max(event_type, struct_pack(a := ts, b := event_id)) AS stage FROM events GROUP BY 1")
#: Windows still open at the end of the input aren't written in append mode: those that end after the last event less the delay.
Q["stream_stage_counts"] = (stream_stage_counts, "WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type AS stage, count(*) AS n FROM events GROUP BY 1, 2) SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, stage, n FROM w WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)")
Q["stream_stale_jobs"] = (stream_stale_jobs, """WITH e AS (SELECT user_id AS job_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY job_id ORDER BY ts) AS k FROM e)
SELECT job_id, min(ts) AS active_from, max(ts) + INTERVAL 2 MINUTE AS stale_at, count(*) AS steps FROM s GROUP BY job_id, k HAVING max(ts) + INTERVAL 2 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
Q["stream_stale_timers"] = (stream_stale_timers, Q["stream_stale_jobs"][1])
Q["scan_part_list_csv"] = (scan_part_list_csv, "SELECT 'P' || p_partkey AS num, trim(p_name) AS name, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_brand END AS brand FROM part WHERE p_partkey % 9 <> 0")
Q["snapshot_write"] = (snapshot_write, C.with_views("products", "SELECT product_id, quality_score, status FROM products WHERE status <> 'draft' OR product_id % 2 = 0"))
Q["stream_reconcile"] = (stream_reconcile, C.with_views("products claims", f"WITH {RECONCILED} SELECT product_id, attribute_name, n_claims, winner, status, confidence FROM rec WHERE winner IS NOT NULL"))
