"""Document fingerprints by winnowing, in built-in expressions only.

The words of a text (lowered, at white space) give k-gram hashes, rolled up by doubling: of 1, 2, 4 words and then k.  Of every
``WINDOW`` grams in a row the least hash is taken, the rightmost of equal ones, with its position.  So any run of WINDOW + K - 1 words
that two texts share puts a common hash into both fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words in a gram, and grams in a window: these figures are built into the doubling below.
K, WINDOW = 5, 4
BUCKET_ROWS, MOST_QUANTILES = 4096, 256


def winnow(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with ``out``: array<struct<hash:bigint,pos:int>>, the fingerprint of ``text`` in the order of the text.

    ``pos`` is the number of a gram's first word.  A text of fewer than K words is one gram; null and empty texts, and texts of white
    space, have an empty fingerprint.  Whole texts are used.  Columns that begin with ``out`` and two underscores are taken.
    """
    c = {name: f"{out}__{name}" for name in ("w", "h", "h2", "h4", "g", "p", "m2", "sel")}
    after = lambda x, n: f"slice({x}, {n + 1}, greatest(size({x}) - {n}, 0))"
    df = df.withColumn(c["w"], F.expr(f"filter(split(translate(lower(coalesce({text}, '')), '\\t\\n\\u000B\\f\\r', '     '), ' '), x -> x <> '')"))
    df = df.withColumn(c["h"], F.expr(f"transform({c['w']}, x -> xxhash64(x))"))
    df = df.withColumn(c["h2"], F.expr(f"zip_with({c['h']}, {after(c['h'], 1)}, (a, b) -> xxhash64(a, b))"))
    df = df.withColumn(c["h4"], F.expr(f"zip_with({c['h2']}, {after(c['h2'], 2)}, (a, b) -> xxhash64(a, b))"))
    # with fewer words than K, the missing ones count as nulls and the first gram is that of all words
    df = df.withColumn(c["g"], F.expr(f"slice(zip_with({c['h4']}, {after(c['h'], 4)}, (a, b) -> xxhash64(a, b)), 1, greatest(size({c['h']}) - {K - 1}, least(size({c['h']}), 1)))"))
    # 32 bits of the hash, then the position from the right: the least is the rightmost of the least
    df = df.withColumn(c["p"], F.expr(f"transform({c['g']}, (x, i) -> shiftleft(shiftrightunsigned(x, 32), 31) | cast(2147483647 - i as bigint))"))
    df = df.withColumn(c["m2"], F.expr(f"zip_with({c['p']}, {after(c['p'], 1)}, (a, b) -> least(a, b))"))
    df = df.withColumn(c["sel"], F.expr(f"array_distinct(slice(zip_with({c['m2']}, {after(c['m2'], 2)}, (a, b) -> least(a, b)), 1, greatest(size({c['p']}) - {WINDOW - 1}, least(size({c['p']}), 1))))"))
    pos = "cast(2147483647 - (x & 2147483647L) as int)"
    return df.withColumn(out, F.expr(f"transform({c['sel']}, x -> struct(get({c['g']}, {pos}) as hash, {pos} as pos))")).drop(*c.values())


def likeness(a: str, b: str) -> Column:
    """Share of common hashes of two fingerprints: 1 if both are empty, 0 if one is."""
    x, y = F.col(f"{a}.hash"), F.col(f"{b}.hash")
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def digest(a: str) -> Column:
    """A fingerprint's hashes as one string."""
    return F.sha2(F.col(f"{a}.hash").cast("string"), 256)


def _bucket(rows: DataFrame, bucket_rows: int) -> Column:
    """A number that doesn't fall as ``id`` rises, the same for about ``bucket_rows`` rows: ranges between up to MOST_QUANTILES
    quantiles, each cut into equal parts if there are more rows than that."""
    n, low, high = rows.agg(F.count("*"), F.min("id"), F.max("id")).first()
    if not n:
        return F.lit(0).cast("long")
    ranges = min(MOST_QUANTILES, -(-n // bucket_rows))
    cuts = rows.agg(F.percentile_approx("id", [i / ranges for i in range(1, ranges)], 100 * MOST_QUANTILES)).first()[0] if ranges > 1 else []
    bounds = sorted({low, *cuts})
    k = F.expr(f"size(filter(array({','.join(f'{x}L' for x in bounds)}), b -> b <= id))") if len(bounds) > 1 else F.lit(1)
    parts = -(-n // (ranges * bucket_rows))
    if parts == 1:
        return k.cast("long")
    edges = [*bounds, high + 1]
    one = lambda values: F.element_at(F.array(*[F.lit(x).cast("decimal(20,0)") for x in values]), k)
    start, width = one(edges[:-1]), one([y - x for x, y in zip(edges, edges[1:], strict=False)])
    return (k * parts + F.floor((F.col("id").cast("decimal(20,0)") - start) * parts / width)).cast("long")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(id, n_chars, edited, fp, edited_fp, near_edited, near_next) of each row of ``docs``.

    The next document is that of the next smaller id; after the smallest comes the largest.  Rows of one id follow each other in the
    order of their texts, the largest first, and repeated rows are all there; a single row is its own next.  The edited text has the
    last floor(n / 2) code points replaced by the first as many of the next one's, or all if it has fewer.  Null texts are empty.
    Rows without id are left out.  Integer ids.

    Ids are dealt into ranges of about ``bucket_rows`` rows, so that the order is that of small sorted groups and of the table of
    their largest ids.  The ranges are cut at quantiles of the ids, so outliers and clusters of ids don't matter.  Rows of one id
    stay in one range, where they are sorted with spilling.
    """
    rows = docs.where(docs[id_col].isNotNull()).select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("bucket", _bucket(rows, bucket_rows))

    order = Window.partitionBy("bucket").orderBy(F.desc("id"), F.desc("text"))
    parts = winnow(rows.repartition("bucket"), "text", "fp")
    parts = parts.withColumn("lead_text", F.lead("text").over(order)).withColumn("lead_fp", F.lead("fp").over(order))

    # the first document of each bucket follows the last of the bucket above it, and that of the highest follows the very last
    heads = rows.groupBy("bucket").agg(F.max("id").alias("head"))
    down = Window.orderBy(F.desc("bucket"))
    top = heads.agg(F.max("head").alias("top"))
    heads = heads.select(F.col("bucket").alias("b"), F.lead("head").over(down).alias("head")).crossJoin(F.broadcast(top)).select("b", F.coalesce("head", "top").alias("head"))
    first = rows.join(heads, rows["id"] == heads["head"]).groupBy("b").agg(F.max("text").alias("head_text"))
    first = winnow(first, "head_text", "head_fp")

    parts = parts.join(first, F.col("bucket") == F.col("b"), "left")
    parts = parts.withColumn("next_text", F.coalesce("lead_text", "head_text")).withColumn("next_fp", F.coalesce("lead_fp", "head_fp")).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    parts = parts.withColumn("edited", F.concat(F.left("text", F.col("n_chars").cast("int") - half), F.left("next_text", half)))
    parts = winnow(parts.select("id", "n_chars", "edited", "fp", "next_fp"), "edited", "edited_fp")
    return parts.select("id", "n_chars", "edited", "fp", "edited_fp", likeness("fp", "edited_fp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"))


def op10_document_fingerprints(spark, sf_dir):
    out = fingerprint_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(
        F.col("id").alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), digest("fp").alias("fingerprint"), digest("edited_fp").alias("edited_fingerprint"),
        "near_edited", "near_next", F.size("fp").cast("long").alias("n_selected"),
    )
