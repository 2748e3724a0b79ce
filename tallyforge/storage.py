"""Tables in the folder that all executors share: durable steps of a plan, and files that queries write and read back."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``.  Where it is unset, a local session gets a temp folder; on a cluster that is an error, since each
    executor would write to a disk of its own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back: its lineage is cut, and a lost executor costs none of it."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that a task aggregates or sorts, about.
ROWS_A_TASK = 1 << 19


def dealt_by_size(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` of some ``rows`` rows dealt by ``keys`` to as many tasks as that asks for, the session's number of partitions at least, so that
    a task's memory doesn't grow with the table.  What is grouped by these keys, and maybe more, isn't shuffled again."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_A_TASK)), *keys)


def delete(spark: SparkSession, *paths: str) -> None:
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """A small file that appears whole or not at all: written under another name, then renamed.  False if ``path`` is there already."""
    final, fs = _fs(spark, path)
    hidden, _ = _fs(spark, f"{path.rpartition('/')[0]}/_{uuid.uuid4().hex}")
    out = fs.create(hidden)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.exists(final) and fs.rename(hidden, final):
        return True
    fs.delete(hidden, False)
    return False


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def listed(spark: SparkSession, path: str) -> list[tuple[str, int, bool]]:
    """(name, bytes, is a folder) of what stands in a folder, by name; nothing if there is none."""
    p, fs = _fs(spark, path)
    return sorted((s.getPath().getName(), s.getLen(), s.isDirectory()) for s in fs.listStatus(p)) if fs.exists(p) else []
