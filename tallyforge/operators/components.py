"""Connected components by alternating large and small stars; no group is gathered and nothing but two totals reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the least node that links lead to.

    Self-links and nulls are left out, repeated links count once.  A round stores its links; the last one changes nothing, after about
    the logarithm of the longest path.
    """
    pair = lambda x, y: F.struct(F.greatest(x, y).alias("hi"), F.least(x, y).alias("lo"))
    now = stored(links.select(pair("a", "b").alias("p")).select("p.*").where("hi > lo").distinct(), "links")
    before = None
    for _ in range(most_rounds):
        ends = now.select(F.explode(F.array(F.struct(F.col("hi").alias("u"), F.col("lo").alias("v")), F.struct(F.col("lo").alias("u"), F.col("hi").alias("v")))).alias("e")).select("e.*")
        least = ends.groupBy("u").agg(F.min("v").alias("w")).select(F.col("u").alias("of"), F.least("u", "w").alias("m"))
        large = ends.where("v > u").join(least, F.col("u") == F.col("of")).select(pair("v", "m").alias("p")).select("p.*").where("hi > lo").distinct()
        down = large.groupBy("hi").agg(F.min("lo").alias("m")).select(F.col("hi").alias("of"), "m")
        small = large.join(down, F.col("hi") == F.col("of")).select(F.explode(F.array(pair("hi", "m"), pair("lo", "m"))).alias("p")).select("p.*").where("hi > lo").distinct()
        now = stored(small, "links")
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first()
        if state == before:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionAll(now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
        before = state
    raise RuntimeError(f"components still change after {most_rounds} rounds")
