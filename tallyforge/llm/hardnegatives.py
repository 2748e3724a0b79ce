"""Hard negatives by exact inner products over an STR-packed R-tree.

Vectors of whole numbers are dealt by label and the coordinate that spreads most, and packed by sort-tile-recursive: each slab
is sorted by the next coordinate and cut again, until a leaf has LEAF vectors.  A leaf keeps its minimum bounding box; in a task, FAN
neighbouring boxes make one above them, up to a root.  For an anchor a box gives an interval for each coordinate's product, and their
sums bound every inner product inside.  A queue takes the box with the highest bound first.  Boxes whose interval misses the wanted
scores go, and those whose bound is strictly below the k-th score so far; at the k-th score itself ids still decide.

Anchors are a stated set of queries: they are sent in blocks of a fixed size against all leaves.  Boxes of many independent
coordinates bound little, so the search is exact but may visit most leaves.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import fresh_path, stored

LEAF, FAN, TREE = 128, 16, 4096
#: Rows that are looked at for the coordinates that spread most; coordinates that packing uses.
SAMPLE, TILED = 4096, 4
#: Components are less than this; scores then fit 64 bits for up to 2048 coordinates.
LARGEST = 1 << 26
#: What bounds in floats may be off beyond 2**53.
SLACK = 2.0**20


def whole_numbers(vector: Column) -> Column:
    """floor(256 * x) of each component; null if the vector or a component is null or not finite.  LARGEST or more is an error."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    small = F.forall(vector, lambda x: F.abs(x.cast("double")) * 256 < LARGEST - 1)
    checked = F.when(small, F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("int"))).otherwise(F.raise_error(F.lit(f"a component times 256 is {LARGEST} or more")))
    return F.when(good, checked)


def str_order(v: np.ndarray, coordinates: list[int]) -> list[np.ndarray]:
    """The rows of each leaf by sort-tile-recursive over ``coordinates``."""

    def cut(rows: np.ndarray, left: list[int]) -> list[np.ndarray]:
        leaves = -(-rows.size // LEAF)
        if leaves <= 1:
            return [rows]
        rows = rows[np.argsort(v[rows, left[0]], kind="stable")]
        slabs = leaves if len(left) == 1 else -(-int(round(leaves ** (1 / len(left)) * 1e6)) // 1_000_000)
        size = -(-leaves // slabs) * LEAF
        return [leaf for i in range(0, rows.size, size) for leaf in ([rows[i : i + size]] if len(left) == 1 else cut(rows[i : i + size], left[1:]))]

    return cut(np.arange(len(v)), coordinates)


def pack(vectors: DataFrame, rows_a_task: int = 32_768) -> DataFrame:
    """Leaves (ids, labels, values, low, high) of ``vectors`` (id, label, v), stored: the values of LEAF vectors one after the other.

    Every vector is in one leaf; shorter vectors count as if zeros followed.  Equal vectors are told apart by id when they are dealt, so
    that a hot one spreads over tasks.
    """
    spark = vectors.sparkSession
    size = vectors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    dims = max(1, size["d"] or 1)
    seen = vectors.select("v").limit(SAMPLE).toPandas()["v"]
    spread = np.var([np.pad(np.asarray(x, dtype=float), (0, dims - len(x))) for x in seen], axis=0) if len(seen) else np.zeros(dims)
    tiled = np.argsort(-spread, kind="stable")[:TILED].tolist()
    tasks = max(2, -(-size["n"] // rows_a_task))
    by = [F.col("label"), F.get(F.col("v"), F.lit(tiled[0])), F.col("id")]
    dealt = vectors.select("id", "label", "v").repartitionByRange(tasks, *by).sortWithinPartitions(*by)

    def leaves(ids: np.ndarray, labels: np.ndarray, v: np.ndarray) -> Iterator[tuple]:
        for rows in str_order(v, tiled):
            yield ids[rows], labels[rows], v[rows].ravel(), v[rows].min(0), v[rows].max(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = 0

        def flush() -> pa.RecordBatch:
            made = list(leaves(*(np.concatenate([h[i] for h in held]) for i in range(3))))
            return pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], pa.list_(kind)) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))], names=["ids", "labels", "values", "low", "high"])

        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                lists = part.column(2)
                lengths = np.diff(lists.offsets.to_numpy())
                v = np.zeros((part.num_rows, dims), dtype=np.int32)
                v[np.arange(dims) < lengths[:, None]] = lists.flatten().to_numpy()
                held.append((part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_numpy(zero_copy_only=False), v))
                n += part.num_rows
                if n >= TREE:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    return stored(dealt.mapInArrow(run, "ids array<long>, labels array<long>, values array<int>, low array<int>, high array<int>"), "leaves")


class Tree:
    """Boxes over the leaves of one batch, FAN to one, and their bounds for anchors."""

    def __init__(self, low: np.ndarray, high: np.ndarray):
        self.leaves = len(low)
        self.children: list[range] = [range(0)] * self.leaves
        lows, highs, first, level = [low], [high], 0, self.leaves
        while level > 1:
            starts = np.arange(0, level, FAN)
            lows.append(np.minimum.reduceat(lows[-1], starts)), highs.append(np.maximum.reduceat(highs[-1], starts))
            self.children += [range(first + s, first + min(s + FAN, level)) for s in starts.tolist()]
            first, level = first + level, starts.size
        self.low, self.high = np.concatenate(lows), np.concatenate(highs)
        self.root = len(self.low) - 1

    def bounds(self, q: np.ndarray) -> tuple[list[list[float]], list[list[float]]]:
        """Least and largest inner product with each anchor that a box allows."""
        plus, minus = np.maximum(q, 0), np.minimum(q, 0)
        return (plus @ self.low.T + minus @ self.high.T).tolist(), (plus @ self.high.T + minus @ self.low.T).tolist()


class Best:
    """The ``k`` best (score, id, label) with scores in [low, high]."""

    __slots__ = ("floor", "found", "high", "k")

    def __init__(self, k: int, low: float, high: float):
        self.k, self.floor, self.high, self.found = k, low, high, []

    def take(self, score: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        fits = np.flatnonzero((score >= self.floor) & (score <= self.high))
        if fits.size > 4 * self.k:  # those below the k-th of these can't stay
            fits = fits[score[fits] >= np.partition(score[fits], -self.k)[-self.k]]
        if fits.size:
            found = self.found + list(zip((-score[fits]).tolist(), ids[fits].tolist(), labels[fits].tolist(), strict=True))
            found.sort()
            self.found = found[: self.k]
            if len(self.found) == self.k:
                self.floor = max(self.floor, -self.found[-1][0])


class Leaves:
    """The vectors of one batch by leaf."""

    def __init__(self, batch: pa.RecordBatch, largest: float, anchors: np.ndarray):
        at = batch.column(0).offsets.to_numpy()
        self.at = (at - at[0]).tolist()
        self.ids, self.labels = batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy()
        self.exact = float(largest) * float(np.abs(anchors).max(initial=0)) * anchors.shape[1] < 2**53  # floats hold such sums of products
        kind = float if self.exact else np.int64
        self.values, self.queries = batch.column(2).flatten().to_numpy().reshape(-1, anchors.shape[1]).astype(kind), anchors.astype(kind)
        starts = np.array(self.at[:-1])
        least, most = np.minimum.reduceat(self.labels, starts), np.maximum.reduceat(self.labels, starts)
        self.label = [a if a == b else None for a, b in zip(least.tolist(), most.tolist(), strict=True)]  # of leaves with one only

    def candidates(self, n: int, own: int, label: int, query: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score, id and label of the vectors of leaf ``n`` that have the anchor's label, or another, and not its id."""
        of = slice(self.at[n], self.at[n + 1])
        ids, labels = self.ids[of], self.labels[of]
        if self.label[n] is not None and (self.label[n] == label) != same:
            return ids[:0], ids[:0], ids[:0]
        keep = ids != own if self.label[n] is not None else (ids != own) & ((labels == label) == same)
        return (self.values[of] @ query)[keep], ids[keep], labels[keep]


def search(tree: Tree, above: list[float], below: list[float], wanted: list[Best], leaf: Callable) -> None:
    """Best-first: ``leaf(i)`` gives scores, ids and labels of the candidates of leaf i."""
    queue = [(-above[tree.root], tree.root)]
    while queue:
        bound, node = heapq.heappop(queue)
        if not any(-bound >= w.floor and below[node] <= w.high for w in wanted):
            continue
        if node < tree.leaves:
            got = leaf(node)
            for w in wanted:
                if -bound >= w.floor and below[node] <= w.high:
                    w.take(*got)
        else:
            for c in tree.children[node]:
                if any(above[c] >= w.floor and below[c] <= w.high for w in wanted):
                    heapq.heappush(queue, (-above[c], c))


def _searched(leaves: DataFrame, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, windows: list[list[tuple[int, int]]], k: int, same: bool) -> DataFrame:
    """(anchor, window, id, label, score): of every task its ``k`` best for each anchor and window, of the anchor's label or of others.

    Rows with the anchor's own id don't count.  Anchors are arrays of a block; ``windows`` are [low, high] of scores.
    """
    sent = leaves.sparkSession.sparkContext.broadcast((ids, labels, q, windows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_ids, own_labels, anchors, wanted = sent.value
        best = [[Best(k, low, high) for low, high in w] for w in wanted]
        dims = anchors.shape[1]
        for whole in batches:
            for i in range(0, whole.num_rows, TREE // LEAF * FAN):
                batch = whole.slice(i, TREE // LEAF * FAN)
                low, high = (np.asarray(batch.column(j).flatten()).reshape(batch.num_rows, dims).astype(float) for j in (3, 4))
                tree = Tree(low, high)
                held = Leaves(batch, max(np.abs(low).max(initial=0), np.abs(high).max(initial=0)), anchors)
                for j in range(0, len(anchors), 256):
                    below, above = tree.bounds(anchors[j : j + 256].astype(float))
                    for a in range(j, min(j + 256, len(anchors))):
                        if best[a]:
                            one = partial(held.candidates, own=own_ids[a], label=own_labels[a], query=held.queries[a], same=same)
                            search(tree, above[a - j] if held.exact else [x + SLACK for x in above[a - j]], below[a - j] if held.exact else [x - SLACK for x in below[a - j]], best[a], one)
        out = [(int(own_ids[a]), w, i, lab, int(-s)) for a, each in enumerate(best) for w, b in enumerate(each) for s, i, lab in b.found]
        for i in range(0, len(out), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out[i : i + 10_000]], pa.int64()) for c in range(5)], names=["anchor", "window", "id", "label", "score"])

    found = leaves.mapInArrow(run, "anchor long, window long, id long, label long, score long")
    w = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id", "label")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mine_hard_negatives(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, block_bytes: int = 4 << 20) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), exact.

    ``vectors`` and ``anchors`` have id, label and v, vectors of whole numbers as ``whole_numbers`` gives them.  An anchor's positives
    are its ``positives`` best other rows of its label; its negatives for a positive are the ``negatives`` best rows of other labels
    whose score times 100 is from ``least`` to ``most`` times the positive's (nothing fits a negative one).  Ties go to the smaller id.

    Rows with a null id, label or v take no part.  Rows that share an id each count, but never for an anchor of that id; of anchors that
    share one, the least (label, v) counts.  An anchor without positives or negatives has no rows; other columns are left out.
    Empty vectors score 0, and shorter ones as if zeros followed.  Anchors go in blocks of ``block_bytes``, each a pass over the leaves for positives and one
    for negatives; a block's positives, some rows an anchor, come to the driver in between.
    """
    spark = vectors.sparkSession
    whole = "id is not null and label is not null and v is not null"
    one = lambda df: df.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "v").where(whole)
    leaves = pack(stored(one(vectors), "vectors"))
    asked = stored(one(anchors).groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.*"), "anchors")
    size = asked.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    width = leaves.agg(F.max(F.size("low"))).first()[0] or 1
    blocks = max(1, -(-size["n"] * max(width, size["d"] or 1) * 8 // block_bytes))
    path = fresh_path(spark, "hard-negatives")
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).orderBy("id").toPandas()
        ids, labels = rows["id"].to_numpy(dtype=np.int64), rows["label"].to_numpy(dtype=np.int64)
        q = np.zeros((len(rows), width), dtype=np.int64)
        for i, v in enumerate(rows["v"]):
            q[i, : min(width, len(v))] = v[:width]  # what is beyond all vectors' length meets zeros
        near = _searched(leaves, ids, labels, q, [[(-np.inf, np.inf)]] * len(rows), positives, True).select("anchor", "rank", "id", "score").orderBy("anchor", "rank").toPandas()
        of = {a: part for a, part in near.groupby("anchor")}
        windows = [[(-(-least * s // 100), most * s // 100) for s in of[a]["score"].tolist()] if a in of else [] for a in ids.tolist()]
        got = _searched(leaves, ids, labels, q, windows, negatives, False)
        pairs = spark.createDataFrame([(int(a), int(r) - 1, int(i), int(s)) for a, r, i, s in near.itertuples(index=False, name=None)], "anchor long, window long, positive_id long, positive_score long")
        out = got.join(F.broadcast(pairs), ["anchor", "window"]).select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out.write.mode("append").parquet(path)
    return spark.read.schema("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long").parquet(path)


def op12_hard_negatives(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("label is not null").select(F.col("vec_id").alias("id"), label.alias("label"), whole_numbers(F.col("embedding")).alias("v"))
    return mine_hard_negatives(rows, rows.where("id % 100 = 0"))


OP12_SQL = """WITH e AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.id % 100 = 0 AND a.id <> b.id),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS rn FROM s WHERE same) WHERE rn <= 5),
n AS (SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""
