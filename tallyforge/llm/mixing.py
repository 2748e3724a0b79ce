"""Mixing sources to target weights: temperature on token shares, then budgeted permutations of blocks.

The weights are shares ** alpha, normalised.  Smaller alpha flattens them.  Alpha is bisected from 1 down to the least that a
repetition limit allows, to meet a target entropy.  Each source then gets weight * budget tokens, dealt out of its documents as
whole passes and one part of a pass.  A document is in the same block of its source in every pass; each pass has the blocks in a
permutation of its own, and the documents of each in hash order, so that cutting it at the budget needs totals of blocks and the
order inside one block only, never one running sum over a source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

#: Blocks of a source: a power of two, of at most BLOCK_TOKENS on average, larger ones beyond MOST_BLOCKS.
BLOCK_TOKENS, MOST_BLOCKS = 1 << 16, 4096
#: Rows of the driver's table of sources; more sources are an error.
MOST_SOURCES = 100_000


def weights_at(shares: dict[str, float], alpha: float) -> dict[str, float]:
    top = max((s for s in shares.values() if s > 0), default=1.0)
    raw = {k: (s / top) ** alpha if s > 0 else 0.0 for k, s in shares.items()}
    total = sum(raw.values()) or 1.0
    return {k: x / total for k, x in raw.items()}


def entropy(weights: dict[str, float]) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def solve_alpha(tokens: dict[str, int], budget: float, target_entropy: float | None = None, max_repeats: float | None = None, steps: int = 60) -> float:
    """The exponent in [0, 1]: the largest that reaches ``target_entropy`` (0 if none does), raised to the least with which no
    source is read more than ``max_repeats`` times (1 if none does, which is then the nearest).  Both quantities are monotonic."""
    total = sum(tokens.values())
    if not total:
        return 1.0
    shares = {k: n / total for k, n in tokens.items()}

    def bisect(good, low: float, high: float) -> float:
        for _ in range(steps):
            mid = (low + high) / 2
            low, high = (mid, high) if good(mid) else (low, mid)
        return (low + high) / 2

    alpha = 1.0
    if target_entropy is not None and entropy(weights_at(shares, 1.0)) < target_entropy:
        alpha = bisect(lambda a: entropy(weights_at(shares, a)) >= target_entropy, 0.0, 1.0)
    if max_repeats is not None:
        most = lambda a: max(w * budget / tokens[k] for k, w in weights_at(shares, a).items() if tokens[k])
        if most(alpha) > max_repeats:
            alpha = 1.0 if most(1.0) > max_repeats else bisect(lambda a: most(a) > max_repeats, alpha, 1.0)
    return alpha


def budgets(tokens: dict[str, int], budget: int, alpha: float) -> dict[str, int]:
    """Tokens for each source, by largest remainders: they sum to ``budget`` unless there are no tokens."""
    total = sum(tokens.values())
    if not total:
        return {k: 0 for k in tokens}
    w = weights_at({k: n / total for k, n in tokens.items()}, alpha)
    exact = {k: x * budget for k, x in w.items()}
    out = {k: math.floor(x) for k, x in exact.items()}
    for k in sorted(exact, key=lambda k: (out[k] - exact[k], k))[: budget - sum(out.values())]:
        out[k] += 1 if tokens[k] else 0
    return out


def _unit(*cols: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def _block(seed: int) -> Column:
    """The number of a document's block, whatever the pass."""
    return F.floor(_unit(F.lit(seed), F.lit("block"), F.col("id")) * F.col("blocks")).cast("int")


def _half() -> Column:
    """The least power of two whose square is ``blocks`` or more, 2 at least."""
    return F.greatest(F.lit(2), F.pow(F.lit(2), F.ceil(F.log2("blocks") / 2)).cast("int"))


def _place(seed: int, pass_: Column) -> Column:
    """Where a document stands in a pass, in [0, blocks): the place of its block, and in that by hash.

    The place of a block is a permutation of block numbers that each source and pass has of its own: three rounds of an odd
    multiple and a sum modulo the power of two ``blocks``, and a shifted xor; each step can be undone, so no two blocks meet.
    """
    at = F.col("block").cast("long")
    for i in range(3):
        key = lambda of, i=i: F.xxhash64(F.lit(seed), F.lit(f"{of}{i}"), F.col("src"), pass_).bitwiseAND(F.lit((1 << 20) - 1))
        at = (at * (2 * key("times") + 1) + key("plus")) % F.col("blocks")
        at = at.bitwiseXOR(F.floor(at / F.col("half")))
    return at + _unit(F.lit(seed), F.col("id"), pass_)


def _blocks(tokens: int) -> int:
    return min(MOST_BLOCKS, 1 << (-(-max(tokens, 1) // BLOCK_TOKENS) - 1).bit_length())


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix_sources(
    docs: DataFrame, tokens: Column, source: str = "source", id_col: str = "doc_id", budget: int | None = None,
    target_entropy_share: float = 0.97, max_repeats: float = 4.0, seed: int = 7,
) -> DataFrame:
    """``docs`` with a row for each time a document is drawn, and ``mix_tokens``, ``mix_pass``, ``mix_block``, ``mix_order``.

    ``budget`` tokens are drawn in all, by default as many as there are.  ``target_entropy_share`` is the entropy of the weights
    to reach, as a share of that of equal weights.  A source never gets more than ``max_repeats`` times its tokens, unless the whole
    budget does.  ``mix_order`` in [0, 1) is the place in the mixed stream: blocks of all sources are spread evenly over it, each
    source and pass in its own permutation.  ``mix_block`` is the number of a document's block, the same in every pass.  A document is whole or not drawn; the one that crosses a source's budget is drawn.

    A null source is a source of its own.  Documents without tokens are drawn like others, but not from a source without any.
    Repeated rows and equal ids (nulls too) share a place and are drawn together, each as often.  An empty table gives none.
    ``tokens`` of a row is 0 or more.  Columns of the new names in ``docs`` are replaced.

    Only counts by source, block, and the rows of one block of each source are shuffled; documents stay where they are read.
    """
    new = ["mix_tokens", "mix_pass", "mix_block", "mix_order"]
    kept = [c for c in docs.columns if c not in new]
    counted = stored(docs.select(docs[source].cast("string").alias("src"), docs[id_col].cast("string").alias("id"), tokens.alias("n")), "counts")
    sizes = counted.groupBy("src").agg(F.sum("n").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(sizes) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    name = lambda s: "s" + s if s is not None else "null"  # noqa: E731  keys apart from any name
    count = {name(r["src"]): r["n"] or 0 for r in sizes}
    total = budget if budget is not None else sum(count.values())
    alpha = solve_alpha(count, total, target_entropy_share * math.log(max(1, sum(n > 0 for n in count.values()))), max_repeats)
    share = budgets(count, total, alpha)
    plan = [
        (r["src"], share[k] // max(1, count[k]), share[k] % max(1, count[k]), _blocks(count[k]), max(share[k], 1) / max(1, count[k]))
        for r in sizes
        for k in [name(r["src"])]
    ]
    sources = docs.sparkSession.createDataFrame(plan, "s string, passes long, rest long, blocks int, drawn double")

    # where the last pass of each source is cut: the block that crosses the budget, then the place in it
    part = counted.join(F.broadcast(sources.where("rest > 0")), F.col("src").eqNullSafe(F.col("s"))).withColumn("block", _block(seed)).withColumn("half", _half()).withColumn("place", _place(seed, F.col("passes"))).withColumn("at", F.floor("place"))
    by_block = part.groupBy("src", "at", "rest").agg(F.sum("n").alias("bn"))
    before = Window.partitionBy("src").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)  # MOST_BLOCKS rows at most
    crossing = by_block.withColumn("sofar", F.coalesce(F.sum("bn").over(before), F.lit(0))).where("sofar < rest and sofar + bn >= rest")
    crossing = crossing.select(F.col("src").alias("cs"), F.col("at").alias("ca"), "sofar")
    inside = Window.partitionBy("src").orderBy("place").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    own = part.join(F.broadcast(crossing), F.col("src").eqNullSafe(F.col("cs")) & (F.col("at") == F.col("ca")))  # a row for each source at most
    cuts = own.withColumn("upto", F.col("sofar") + F.sum("n").over(inside)).where("upto >= rest").groupBy("src").agg(F.min("place").alias("cut")).withColumnRenamed("src", "cut_src")
    sources = sources.join(cuts, F.col("s").eqNullSafe(F.col("cut_src")), "left").select(*[F.col(c).alias(f"_{c}") for c in ("s", "passes", "blocks", "drawn", "cut")])

    rows = docs.select(F.struct(*[docs[c] for c in kept]).alias("row"), docs[source].cast("string").alias("src"), docs[id_col].cast("string").alias("id"), tokens.alias("n"))
    rows = rows.join(F.broadcast(sources), F.col("src").eqNullSafe(F.col("_s"))).select("row", "src", "id", "n", F.col("_passes").alias("passes"), F.col("_blocks").alias("blocks"), F.col("_drawn").alias("drawn"), F.col("_cut").alias("cut"))
    rows = rows.withColumn("block", _block(seed)).withColumn("half", _half())
    times = F.col("passes") + F.when(_place(seed, F.col("passes")) <= F.col("cut"), 1).otherwise(0)
    drawn = rows.where(times > 0).withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), times - 1))).withColumn("place", _place(seed, F.col("pass")))
    order = F.least((F.col("pass") + F.col("place") / F.col("blocks")) / F.col("drawn"), F.lit(1 - 2**-53))
    return drawn.select("row.*", F.col("n").alias("mix_tokens"), F.col("pass").alias("mix_pass"), F.col("block").alias("mix_block"), order.alias("mix_order"))


def op1_source_mixing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counted = docs.select("doc_id", "source", count_words(F.col("text")).alias("n_words"))
    return mix_sources(counted, F.col("n_words")).drop("n_words")
