"""Tables that streams keep: a log of files by key bucket, with a manifest for each batch.

A batch writes files for the buckets it touches and then a manifest that names the live files of every bucket; the manifest with the
highest number is the table.  A reader of some keys opens the files of their buckets only.  A bucket of many files is
folded into one in passing, by the batch that touches it.  Files that no manifest names, such as those of a failed attempt, don't count.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import delete, listed, publish, read_text


class BucketedTable:
    """Rows of ``schema`` by bucket of ``keys`` under ``path``.

    ``fold`` makes one row of those of a key: it is used by ``read`` and when files are folded, so it must give the same whether rows
    were folded before or not (the newest, the first, a sum).  It may use the column ``batch``, the number of the batch that wrote a row.
    ``most_files``: live files of a bucket after which it is folded.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], fold: Callable[[DataFrame], DataFrame], buckets: int = 64, most_files: int = 4):
        self.spark, self.path, self.keys, self.fold, self.buckets, self.most_files = spark, path, keys, fold, buckets, most_files
        self.schema = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])

    # ---- manifests

    def _manifest(self, batch: int) -> str:
        return f"{self.path}/manifests/{batch:012d}.json"

    def batches(self) -> list[int]:
        """The batches that have a manifest, in order."""
        names = [n for n, _, _ in listed(self.spark, f"{self.path}/manifests")]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())

    def live(self, batch: int | None = None) -> dict[int, list[str]]:
        """The live folders of each bucket, now or as of ``batch``."""
        done = [b for b in self.batches() if batch is None or b <= batch]
        if not done:
            return {}
        return {int(k): v for k, v in json.loads(read_text(self.spark, self._manifest(done[-1]))).items()}

    # ---- rows

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets of ``rows``; ``buckets`` numbers at most."""
        return sorted(r["bucket"] for r in rows.select(self.bucket().alias("bucket")).distinct().collect())

    def files(self, buckets: list[int] | None = None, batch: int | None = None) -> list[str]:
        return [f"{self.path}/{f}" for b, files in sorted(self.live(batch).items()) if buckets is None or b in buckets for f in files]

    def _rows(self, files: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*files) if files else self.spark.createDataFrame([], self.schema)

    def read(self, buckets: list[int] | None = None, batch: int | None = None) -> DataFrame:
        """The table, or the rows of some buckets, now or as of a batch.  Only their files are opened."""
        return self.fold(self._rows(self.files(buckets, batch)))

    def append(self, batch: int, rows: DataFrame, touched: list[int] | None = None) -> bool:
        """Adds the rows of a batch; false, and nothing is written, if its manifest is there, as when a batch is replayed.
        ``touched``: the buckets of ``rows`` where they are known, so that ``rows`` are computed once.

        A batch of a hot key is split over files by its size.  Buckets with ``most_files`` folders are written anew, folded.
        """
        if batch in self.batches():
            return False
        live = self.live()
        touched = self.touched(rows) if touched is None else touched
        full = [b for b in touched if len(live.get(b, [])) + 1 > self.most_files]
        name = f"data/batch={batch}-{uuid.uuid4().hex[:8]}"
        new = rows.select(*[f.name for f in self.schema.fields[:-1]]).withColumn("batch", F.lit(batch).cast("long"))
        if full:
            old = self._rows(self.files(full))
            again = self.fold(old.unionByName(new.where(self.bucket().isin(full))))
            new = new.where(~self.bucket().isin(full)).unionByName(again.select(*self.schema.names))
        new.withColumn("bucket", self.bucket()).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{name}")
        for b in touched:
            live[b] = [*([] if b in full else live.get(b, [])), f"{name}/bucket={b}"]
        if not publish(self.spark, self._manifest(batch), json.dumps({str(k): v for k, v in sorted(live.items())})):
            raise RuntimeError(f"batch {batch} of {self.path} was written by another job")
        return True

    def vacuum(self, keep: int = 2) -> int:
        """Deletes manifests but the last ``keep`` and the files that none of these names; returns how many folders went.  Not while a batch is written."""
        done = self.batches()
        held = {f for b in done[-keep:] for files in self.live(b).values() for f in files}
        gone = []
        for batch, _, _ in listed(self.spark, f"{self.path}/data"):
            parts = [n for n, _, folder in listed(self.spark, f"{self.path}/data/{batch}") if folder]
            stale = [f"{self.path}/data/{batch}/{n}" for n in parts if f"data/{batch}/{n}" not in held]
            gone += [f"{self.path}/data/{batch}"] if len(stale) == len(parts) else stale
        delete(self.spark, *gone, *[self._manifest(b) for b in done[:-keep]])
        return len(gone)


def first_of(keys: list[str], *order: str) -> Callable[[DataFrame], DataFrame]:
    """Of each key the first row by ``order``."""
    return lambda rows: _pick(F.min_by, rows, keys, order)


def last_of(keys: list[str], *order: str) -> Callable[[DataFrame], DataFrame]:
    """Of each key the last row by ``order``."""
    return lambda rows: _pick(F.max_by, rows, keys, order)


def _pick(by: Callable, rows: DataFrame, keys: list[str], order: tuple[str, ...]) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(by(F.struct(*rest), F.struct(*order)).alias("x")).select(*keys, "x.*").select(*rows.columns)
