"""Helpers that several operators share: durable intermediate tables and bounded membership filters."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach (``spark.checkpoint.dir``).  Where it is unset, a local session gets a temp folder; on a
    cluster that is an error, since each executor would write to a disk of its own."""
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
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``stored`` that nothing reads any more: all that was made from them is stored itself."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def long_rows(df: DataFrame, rows: int = 1000) -> DataFrame:
    """``df``, whose rows hold whole texts: batches for Python get ``rows`` rows at most, where the session allows more, so that
    their buffers stay small on either side."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(key, "10000")) <= rows:
        conf.set(key, str(rows))
    return df


def bit_of(col: str, log2_bits: int) -> Column:
    """Position of a 64-bit value in a bitmap of 2**log2_bits bits."""
    return F.shiftrightunsigned(F.xxhash64(F.col(col)), 64 - log2_bits)


def bits_for(rows: int) -> int:
    """log2 of the bits of a bitmap for so many values: 32 or more for each, between 1 and 16 MB.

    With more than 2**25 values it fills up and lets more and more pass, which costs work and nothing else: an exact join follows.
    """
    return min(27, max(23, rows.bit_length() + 5))


def bitmap(df: DataFrame, position: Column, log2_bits: int) -> np.ndarray:
    """The set of ``position`` values as packed bits, merged on the executors.

    At most 2**(log2_bits-6) rows reach the driver, however large ``df`` is.
    """
    words = (
        df.select(position.alias("p"))
        .groupBy(F.shiftright("p", 6).alias("w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits"))
        .toPandas()
    )
    out = np.zeros(1 << (log2_bits - 6), dtype=np.uint64)
    out[words["w"].to_numpy(dtype=np.int64)] = words["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    return out


def has_bit(bits: np.ndarray, position: np.ndarray) -> np.ndarray:
    word = bits[(position >> np.uint64(6)).astype(np.int64)]
    return ((word >> (position & np.uint64(63))) & np.uint64(1)).astype(bool)
