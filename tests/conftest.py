import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    scratch = tempfile.mkdtemp(prefix="spark-")
    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{scratch}/shared").config("spark.local.dir", scratch)
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def connected(folder):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


@pytest.fixture(scope="session")
def duck():
    return connected(SMALL)


def rows_of(df):
    """Rows as comparable tuples, columns by name, numbers to six digits."""
    import math

    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("NaT", "<NA>", "nan"):
            return ""
        if isinstance(v, (bool, int, float)) or type(v).__module__ == "numpy" or type(v).__name__ == "Decimal":
            return f"{float(v):.6g}"
        return str(v).removesuffix(" 00:00:00")

    columns = sorted(df.columns)
    return sorted(tuple(one(v) for v in row) for row in df[columns].itertuples(index=False, name=None))


@pytest.fixture(scope="session")
def same(spark, duck):
    """Checks a registered query against its SQL, on the smallest tables unless others are named."""

    def check(query, sql, folder=SMALL):
        got, want = query(spark, folder).toPandas(), (duck if folder == SMALL else connected(folder)).sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows_of(got) == rows_of(want)

    return check
