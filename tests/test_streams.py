"""Streams with state: late and out-of-order rows, restarts, replays, and what a batch reads."""

import random
from datetime import datetime, timedelta

from tallyforge.operators import reconcile as R
from tallyforge.storage import fresh_path
from tallyforge.streaming import streams as S
from tallyforge.streaming import timers as T

START = datetime(2024, 1, 1)
STEPS = "job_id long, created_at timestamp"


def _write(spark, path, rows, name):
    spark.createDataFrame([(j, START + timedelta(seconds=s)) for j, s in rows], STEPS).coalesce(1).write.parquet(f"{path}/in/{name}")


def _run(spark, path):
    steps = spark.readStream.schema(STEPS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{path}/in")
    with T.rocksdb_state(spark):
        out = T.stale_jobs_by_timer(steps, 120, "300 seconds")
        out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(out.schema).parquet(f"{path}/out").collect()
    since = lambda t: (t - START).total_seconds()
    return sorted((r["job_id"], since(r["active_from"]), since(r["stale_at"]), r["steps"]) for r in got)


def test_timers_with_late_rows_and_a_restart(spark):
    path = fresh_path(spark, "timers")
    _write(spark, path, [(1, 0), (1, 100), (2, 0), (1, 400), (3, 500)], "a")
    first = _run(spark, path)  # the watermark is 200: job 2's run ends at 120, job 1's first at 220
    assert first == [(2, 0.0, 120.0, 1)]
    # after the restart: 210 links two of job 1's runs in part (100 -> 210 -> 310), out of order; job 2 at 10 is too late
    _write(spark, path, [(1, 310), (1, 210), (2, 10), (4, 1000)], "b")
    second = _run(spark, path)
    assert second == [(1, 0.0, 520.0, 5), (2, 0.0, 120.0, 1), (3, 500.0, 620.0, 1)]
    _write(spark, path, [(5, 5000)], "c")
    assert _run(spark, path) == [*second, (4, 1000.0, 1120.0, 1)]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


CLAIMS = "product_id long, attribute_name string, source_id long, raw_value string, trust double"


def _as_batches(spark, kept, rows, n):
    for b in range(n):
        kept.take(spark.createDataFrame(rows[b::n], CLAIMS), b)


def test_reconciled_batches_are_as_one(spark):
    rng = random.Random(5)
    rows = [(p, rng.choice(["power", "speed"]), s, f"{rng.choice([1, 1, 1, 2])} {rng.choice(['kW', 'W'])}", rng.choice([0.5, 0.7, 0.9])) for p in range(30) for s in range(5)]
    attributes = spark.createDataFrame([(p, "power", "1 kW", 0.6) for p in range(30)], "product_id long, attribute_name string, raw_value string, confidence double")
    kept = S.ReconciledStream(spark, fresh_path(spark, "table"), spark.createDataFrame([], CLAIMS).schema, attributes, buckets=4, most_files=3)
    _as_batches(spark, kept, rows, 9)
    seen = {(p, a) for p, a, *_ in rows}
    want = {(r["product_id"], r["attribute_name"]): r for r in R.reconcile(spark.createDataFrame(rows, CLAIMS), attributes).collect()}
    got = kept.results.read().drop("batch").collect()
    assert {(r["product_id"], r["attribute_name"]) for r in got} == seen
    assert all(tuple(r) == tuple(want[r["product_id"], r["attribute_name"]]) for r in got)
    assert all(len(files) <= 3 for t in (kept.claims, kept.results) for files in t.live().values())


def test_a_batch_opens_the_files_of_its_buckets_only(spark):
    kept = S.ReconciledStream(spark, fresh_path(spark, "table"), spark.createDataFrame([], CLAIMS).schema, buckets=16)
    kept.take(spark.createDataFrame([(p, "power", 1, "1 kW", 0.5) for p in range(200)], CLAIMS), 0)
    batch = spark.createDataFrame([(7, "power", 2, "1 kW", 0.9)], CLAIMS)
    kept.take(batch, 1)
    own = kept.claims.touched(batch)
    assert len(own) == 1 and kept.claims.read(own).inputFiles() and all(f"/bucket={own[0]}/" in f for f in kept.claims.read(own).inputFiles())
    before, after = kept.results.live(0), kept.results.live(1)
    assert {b for b in after if after[b] != before.get(b)} == set(own)
    assert kept.results.read(own).where("product_id = 7").first()["status"] == "AGREEMENT"


def test_replays_failed_attempts_and_vacuum(spark):
    path = fresh_path(spark, "table")
    kept = S.ReconciledStream(spark, path, spark.createDataFrame([], CLAIMS).schema, buckets=2, most_files=2)
    batches = [spark.createDataFrame([(p, "power", s, f"{p} W", 0.5 + s / 10) for p in range(4)], CLAIMS) for s in range(4)]
    for b, rows in enumerate(batches):
        kept.take(rows, b)
        kept.take(rows, b)  # a replay changes nothing
    # a batch that failed between its claims and its results: the replay sees the claims of that batch, and none of later ones
    kept.claims.append(4, spark.createDataFrame([(1, "power", 9, "7 W", 0.99)], CLAIMS))
    assert kept.results.read().where("product_id = 1").first()["n_claims"] == 4
    kept.take(spark.createDataFrame([(1, "power", 9, "7 W", 0.99)], CLAIMS), 4)
    spark.createDataFrame([(1,)], "x long").write.parquet(f"{path}/reconciled/data/batch=9-left/bucket=0")  # of an attempt that was lost
    state = sorted(map(tuple, kept.results.read().collect()))
    one = kept.results.read().where("product_id = 1").first()
    assert (one["n_claims"], one["status"], one["winner"]) == (5, "CONFLICTING", 9)
    assert kept.results.vacuum(keep=1) > 0 and kept.results.batches() == [4]
    assert sorted(map(tuple, kept.results.read().collect())) == state
    # the first claim of a source counts
    kept.take(spark.createDataFrame([(1, "power", 9, "8 W", 1.0)], CLAIMS), 5)
    assert kept.results.read().where("product_id = 1").first()["winning_value"] == "7 W"


def test_an_empty_table_and_batch(spark):
    kept = S.ReconciledStream(spark, fresh_path(spark, "table"), spark.createDataFrame([], CLAIMS).schema)
    assert kept.results.read().count() == 0
    kept.take(spark.createDataFrame([], CLAIMS), 0)
    assert kept.results.read().count() == 0 and kept.results.batches() == [0]


def test_a_job_has_one_timer():
    import pandas as pd

    from tallyforge.streaming.timers import Runs

    class Held:
        rows: list = []
        timers: set = set()

        def getListState(self, *_):
            return self

        def exists(self):
            return bool(self.rows)

        def get(self):
            return iter(self.rows)

        def put(self, rows):
            self.rows = list(rows)

        def clear(self):
            self.rows = []

        def registerTimer(self, t):
            self.timers.add(t)

        def deleteTimer(self, t):
            self.timers.remove(t)

    class Now:
        def __init__(self, ms):
            self.getExpiryTimeInMs = self.getCurrentWatermarkInMs = lambda: ms

    held, runs = Held(), Runs(2000, "job_id")
    runs.init(held)
    list(runs.handleInputRows(("a",), iter([pd.DataFrame({"us": [50_000, 1000, 100_000, 2500]})]), None))
    assert held.timers == {5} and len(held.rows) == 3  # 2500 and 2000 more, in whole ms
    list(runs.handleInputRows(("a",), iter([pd.DataFrame({"us": [4000]})]), None))
    assert held.timers == {6}
    held.timers.remove(6)
    out = pd.concat(runs.handleExpiredTimer(("a",), Now(60), Now(6)))
    assert out[["active_from", "stale_at", "steps"]].values.tolist() == [[1000, 6000, 3], [50_000, 52_000, 1]]
    assert held.timers == {102} and held.rows == [(100_000, 100_000, 1)]


def test_buckets_of_a_batch_are_looked_up_once(spark, monkeypatch):
    from tallyforge.streaming.bucketed import BucketedTable

    seen, own = [], BucketedTable.touched
    monkeypatch.setattr(BucketedTable, "touched", lambda self, rows: seen.append(self.path) or own(self, rows))
    kept = S.ReconciledStream(spark, fresh_path(spark, "table"), spark.createDataFrame([], CLAIMS).schema, buckets=2)
    kept.take(spark.createDataFrame([(1, "power", 1, "7 W", 0.9), (2, "power", 1, "8 W", 0.9)], CLAIMS), 0)
    assert len(seen) == 1 and kept.results.read().count() == 2
