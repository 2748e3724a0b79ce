"""Nearest vectors of large tables for large tables: inverted lists on trained centroids, exact scores of the candidates.

Centroids are trained on a bounded sample by spherical k-means; every vector stands in the list of its nearest centroid.  A query
looks at the lists of its nearest ``probes`` centroids.  How many it takes for a wanted recall depends on the data: few where
vectors cluster, most of them where they don't; ``probes_for`` measures it on a bounded sample of queries against brute force.

Lists that are near each other make cells of some ``SHARES`` parts of all vectors, or more where a part would be too large for a task, and
queries are dealt alike.  A query is sent to a cell once, with bits for the lists that it wants there, and a vector once for each
deal of queries, so that what is sent grows with the tables.  A list with a third of all vectors is cut over cells.  What leaves a
task is its best ``k`` of each query.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import stored

#: Rows of a block of a list, the least of a cell; the least of a deal of queries.
ROWS, QUERIES = 4096, 2048
#: Cells and deals of queries, as long as their vectors take no more bytes than ``MOST_BYTES`` as doubles.
SHARES, MOST_BYTES = 8, 1 << 26
#: Vectors that centroids are trained on; lists at most, so that the centroids stay a few MB.
SAMPLE, MOST_LISTS = 32_768, 8192
_ROUNDS = 8


class Index(NamedTuple):
    """``lists``: (vec_id, label, v, list, block) of all vectors, v of as many numbers as a centroid; ``blocks``: (list, n, blocks)."""

    centroids: np.ndarray
    lists: DataFrame
    blocks: DataFrame


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; those of length 0 stay."""
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def train_centroids(sample: np.ndarray, lists: int) -> np.ndarray:
    """Spherical k-means from spread-out seeds; a centroid without vectors takes a vector that is far from its own."""
    pick = np.random.default_rng(0)
    x = unit(sample.astype(np.float64))
    c = x[pick.choice(len(x), size=min(lists, len(x)), replace=False)]
    for _ in range(_ROUNDS):
        score = x @ c.T
        near = score.argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        empty = np.flatnonzero(np.bincount(near, minlength=len(c)) == 0)
        if empty.size:
            sums[empty] = x[np.argsort(score.max(1), kind="stable")[: empty.size]]
        c = unit(sums)
    return c


def _matrix(lists: list, dims: int) -> np.ndarray:
    """Lists as rows of ``dims`` numbers, filled with zeros; nulls and numbers that aren't finite are zeros."""
    out = np.zeros((len(lists), dims))
    for i, v in enumerate(lists):
        if v is not None:
            w = np.asarray(v, dtype=float)[:dims]  # None is nan
            out[i, : w.size] = w
    return np.nan_to_num(out, copy=False, nan=0.0, posinf=0.0, neginf=0.0)


def _numbers(column: pa.Array, dims: int) -> np.ndarray:
    """``_matrix`` of a column of lists, at once where none is null, short or long."""
    flat = column.flatten()
    if column.null_count or flat.null_count or set(column.value_lengths().unique().to_pylist()) - {dims}:
        return _matrix(column.to_pylist(), dims)
    return np.nan_to_num(flat.to_numpy(zero_copy_only=False).reshape(-1, dims).astype(float), nan=0.0, posinf=0.0, neginf=0.0)


def _typed(df: DataFrame, vector: str) -> Column:
    """Vectors of floats as they are, others as doubles."""
    return F.col(vector).cast("array<float>" if isinstance(df.schema[vector].dataType, T.ArrayType) and isinstance(df.schema[vector].dataType.elementType, T.FloatType) else "array<double>")


def _lists(x: np.ndarray, like: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()).cast(like.value_type))


def _scored_batches(batches: Iterator[pa.RecordBatch], at: int, c: np.ndarray, most_rows: int = 1024) -> Iterator[tuple[list[pa.Array], np.ndarray]]:
    """Columns of ``most_rows`` rows at most, the vectors at ``at`` with as many numbers as a centroid, and their scores with the centroids."""
    for whole in batches:
        for i in range(0, whole.num_rows, most_rows):
            columns = list(whole.slice(i, most_rows).columns)
            x = _numbers(columns[at], c.shape[1])
            columns[at] = _lists(x, columns[at].type)
            yield columns, unit(x) @ c.T


def _placed(vectors: DataFrame, vector: str, centroids: np.ndarray) -> DataFrame:
    """``vectors`` with ``list``, the nearest centroid of each."""
    sent, at = vectors.sparkSession.sparkContext.broadcast(centroids), vectors.columns.index(vector)
    schema = T.StructType([*vectors.schema.fields, T.StructField("list", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, score in _scored_batches(batches, at, sent.value):
            yield pa.RecordBatch.from_arrays([*columns, pa.array(score.argmax(1).astype(np.int32))], names=schema.names)

    return vectors.mapInArrow(run, schema)


def build_index(vectors: DataFrame, lists: int | None = None) -> Index:
    """An index of all ``vectors`` (vec_id, embedding, label).  ``lists``: about the root of the number of vectors unless given.

    Shorter vectors count as if zeros followed, null ones and null or not-finite components as zeros.
    """
    size = vectors.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d")).first()
    dims = max(1, size["d"] or 1)
    share = min(1.0, 2 * SAMPLE / max(1, size["n"]))
    rows = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(10**9)) < int(share * 10**9)) if share < 1 else vectors
    sample = _matrix(rows.select("embedding").where("embedding is not null").limit(SAMPLE).toPandas()["embedding"].tolist() or [[0.0]], dims)
    n_lists = min(MOST_LISTS, lists or max(1, round(size["n"] ** 0.5)))
    centroids = train_centroids(sample, n_lists)
    placed = _placed(vectors.select("vec_id", "label", _typed(vectors, "embedding").alias("v")), "v", centroids)
    placed = stored(placed, "lists")
    blocks = placed.groupBy("list").agg(F.count("*").alias("n")).select("list", "n", F.ceil(F.col("n") / ROWS).cast("int").alias("blocks"))
    blocks = stored(blocks, "blocks")  # a row a list, MOST_LISTS at most
    dealt = placed.join(F.broadcast(blocks.drop("n")), "list").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    return Index(centroids, dealt.drop("blocks"), blocks)


class Cells(NamedTuple):
    """Non-empty lists in an order in which near ones are together (``order``), where the rows of each begin (``rows``), and the places of the
    lists of each cell, from and to.  A block stands in the cell that its first row falls in, ``size`` rows to a cell."""

    size: int
    order: np.ndarray
    rows: list[tuple[int, int, int, int, int]]
    places: list[tuple[int, int]]


def _share(n: int, least: int, most: int) -> int:
    return max(1, min(most, max(least, -(-n // SHARES))))


def _cells(index: Index, k: int) -> Cells:
    """From a row a list, ``MOST_LISTS`` at most."""
    held = {r["list"]: (r["n"], r["blocks"]) for r in index.blocks.collect()}
    size = _share(sum(n for n, _ in held.values()), ROWS, _most_rows(index, k))
    c = index.centroids
    near = (unit(c) @ train_centroids(c, SHARES).T).argmax(1)
    order = [int(x) for x in np.argsort(near, kind="stable") if x in held]
    rows, places, start = [], {}, 0
    for place, x in enumerate(order):
        n, blocks = held[x]
        rows.append((x, place, start, n, blocks))
        for cell in range(start // size, (start * blocks + n * (blocks - 1)) // (size * blocks) + 1):
            a, _ = places.get(cell, (place, place))
            places[cell] = a, place
        start += n
    return Cells(size, np.array(order, dtype=np.int64), rows, [places.get(i, (0, -1)) for i in range(max(places, default=-1) + 1)])


def _most_rows(index: Index, k: int) -> int:
    """As many rows as a task holds: vectors, and the best ``k`` of each query."""
    return max(1, MOST_BYTES // max(8 * index.centroids.shape[1], 16 * k))


def _asked(index: Index, cells: Cells, queries: DataFrame, probes: int) -> DataFrame:
    """(query_id, ql, q, cell, bits): a row for each cell in which a query wants a list, with a bit for each of the cell's lists."""
    rows = queries.select("query_id", F.col("label").alias("ql"), _typed(queries, "embedding").alias("q"))
    sent = queries.sparkSession.sparkContext.broadcast((index.centroids, cells.order, cells.places))
    schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("bits", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, order, places = sent.value
        for columns, score in _scored_batches(batches, 2, c):
            wants = np.ones(score.shape, dtype=bool)
            if probes < len(c):
                wants[:] = False
                np.put_along_axis(wants, np.argpartition(-score, probes - 1, axis=1)[:, :probes], True, axis=1)
            wants = wants[:, order]
            for cell, (a, b) in enumerate(places):
                own = wants[:, a : b + 1]
                some = np.flatnonzero(own.any(axis=1))
                if some.size:
                    bits = pa.array([x.tobytes() for x in np.packbits(own[some], axis=1)], pa.binary())
                    yield pa.RecordBatch.from_arrays([*[x.take(pa.array(some)) for x in columns], pa.array(np.full(some.size, cell, dtype=np.int32)), bits], names=schema.names)

    return rows.mapInArrow(run, schema)


def _best(q: np.ndarray, wants: np.ndarray, asks: np.ndarray, v: np.ndarray, labels: np.ndarray, ranks: np.ndarray, places: np.ndarray, k: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Scores and rows of the best ``k`` of each query among the lists it asks for (a column of ``asks`` for each place); -inf where there are fewer.

    Scores count with six digits, ties by ``ranks``.  Within a list the ranks rise, so what only equals a query's last hit comes too late
    there: a hot vector's copies are not looked at again and again.
    """
    best, rows = np.full((len(q), k), -np.inf), np.full((len(q), k), len(v))
    ranks = np.append(ranks, np.iinfo(np.int64).max)
    by_list = np.lexsort((ranks[:-1], places))
    starts = np.searchsorted(places[by_list], np.arange(asks.shape[1] + 1))
    by_label = np.argsort(wants, kind="stable")

    def take(i: np.ndarray, j: np.ndarray, s: np.ndarray) -> None:
        own = np.unique(i)
        i, j, s = np.concatenate([np.repeat(own, k), i]), np.concatenate([rows[own].ravel(), j]), np.concatenate([best[own].ravel(), s])
        o = np.lexsort((ranks[j], -s, i))
        i, j, s = i[o], j[o], s[o]
        nth = np.arange(len(i)) - np.searchsorted(i, i)
        top = nth < k
        best[i[top], nth[top]], rows[i[top], nth[top]] = s[top], j[top]

    for place in range(asks.shape[1]):
        whole = by_list[starts[place] : starts[place + 1]]
        asking = by_label[asks[by_label, place]] if whole.size else whole
        for a in range(0, len(asking), 512):
            few = asking[a : a + 512]
            free = np.isnan(wants[few])
            held = whole[labels[whole] == wants[few[0]]] if not free.any() and (wants[few] == wants[few[0]]).all() else whole
            mixed = len(held) == len(whole) and not free.all()
            for b in range(0, len(held), 1024):
                some = held[b : b + 1024]
                score = q[few] @ v[some].T
                if mixed:
                    score[~(free[:, None] | (wants[few][:, None] == labels[some][None, :]))] = -np.inf
                last = best[few, -1]
                least = np.maximum(np.where(ranks[rows[few, -1]] < ranks[some[0]], last + 4e-7, last - 6e-7), threshold - 6e-7)
                if len(some) > k and np.isneginf(last).any():
                    least = np.maximum(least, np.partition(score, -k, axis=1)[:, -k] - 6e-7)
                i, j = np.nonzero(score >= least[:, None])
                s = np.round(score[i, j], 6)
                fits = s >= threshold
                if fits.any():
                    take(few[i[fits]], some[j[fits]], s[fits])
    return best, rows


def _scored(index: Index, queries: DataFrame, k: int, probes: int, threshold: float) -> DataFrame:
    cells, spark = _cells(index, k), queries.sparkSession
    parts = -(-max(1, (n := queries.count())) // _share(n, QUERIES, _most_rows(index, k)))
    ask = _asked(index, cells, queries, probes).withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int"))
    starts = spark.createDataFrame(cells.rows, "of int, place int, start long, n long, blocks long")
    held = index.lists.join(F.broadcast(starts), F.col("list") == F.col("of"))
    held = held.withColumn("cell", F.expr(f"(start * blocks + n * block) div ({cells.size} * blocks)").cast("int"))
    held = held.select("vec_id", "label", "v", "cell", "place", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    first, dims = [a for a, _ in cells.places], index.centroids.shape[1]

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks()
        i, j, s = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
        if left.num_rows and right.num_rows:
            q, v = (unit(t.column(n).combine_chunks().flatten().to_numpy().reshape(-1, dims).astype(float)) for t, n in ((left, "q"), (right, "v")))
            wants, labels = (t[n].to_pandas().to_numpy(dtype=float) for t, n in ((left, "ql"), (right, "label")))
            ranks = np.empty(len(v), dtype=np.int64)
            ranks[np.argsort(right["vec_id"].to_numpy(), kind="stable")] = np.arange(len(v))
            places = right["place"].to_numpy() - first[left["cell"][0].as_py()]
            asks = np.unpackbits(np.frombuffer(b"".join(left["bits"].to_pylist()), dtype=np.uint8).reshape(len(q), -1), axis=1).astype(bool)
            best, rows = _best(q, wants, asks, v, labels, ranks, places, k, threshold)
            i, nth = np.nonzero(best > -np.inf)
            j, s = rows[i, nth], best[i, nth]
        return pa.table({"query_id": left["query_id"].take(pa.array(i)), "vec_id": right["vec_id"].take(pa.array(j)), "score": pa.array(s)})

    kinds = queries.schema["query_id"].dataType.simpleString(), index.lists.schema["vec_id"].dataType.simpleString()
    return ask.groupBy("cell", "part").cogroup(held.groupBy("cell", "part")).applyInArrow(meet, f"query_id {kinds[0]}, vec_id {kinds[1]}, score double")


def search(index: Index, queries: DataFrame, k: int = 10, probes: int | None = None, threshold: float = -2.0) -> DataFrame:
    """(query_id, vec_id, score, rank): the ``k`` nearest by cosine among the vectors of the looked-at lists with the query's label, where
    it has one, and a score of ``threshold`` or more.

    ``queries``: (query_id, embedding, label), each query_id once.  ``probes``: lists a query looks at; all if None, which is exact.
    Ties go to the smaller vec_id.  Scores are rounded to six digits.
    """
    found = _scored(index, queries, k, probes or len(index.centroids), threshold)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact hits that were found, where a hit of an equal score counts as well."""
    least = exact.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    got = found.join(least, "query_id").groupBy("query_id", "n").agg(F.count_if(F.col("score") >= F.col("least")).alias("hits"))
    both = least.select("query_id", "n").join(got.select("query_id", "hits"), "query_id", "left").agg(F.sum(F.least(F.coalesce("hits", F.lit(0)), "n")).alias("a"), F.sum("n").alias("b")).first()
    return both["a"] / both["b"] if both["b"] else 1.0


def probes_for(index: Index, queries: DataFrame, k: int = 10, target: float = 0.95, sample: int = 64, threshold: float = -2.0) -> int:
    """The least number of lists, in powers of 1.5, that finds ``target`` of the hits of ``sample`` queries (those of the least hashes).

    Brute force looks at these queries only, one pass over the vectors; how many of its hits a number of lists finds follows from
    the lists that they stand in.  The sample's vectors and hits go through the driver.
    """
    few = stored(queries.orderBy(F.xxhash64("query_id"), "query_id").limit(sample), "sample")
    exact = stored(search(index, few, k, None, threshold), "exact")
    hits = index.lists.select("vec_id", "list").join(F.broadcast(exact.select("vec_id", "query_id")), "vec_id").groupBy("query_id", "vec_id").agg(F.min("list").alias("list")).collect()
    asked = few.select("query_id", "embedding").collect()
    score = unit(_matrix([r["embedding"] for r in asked], index.centroids.shape[1])) @ index.centroids.T
    nth = dict(zip((r["query_id"] for r in asked), np.argsort(np.argsort(-score, axis=1), axis=1), strict=True))
    needed = np.array([nth[r["query_id"]][r["list"]] for r in hits])
    n = 1.0
    while n < len(index.centroids):
        if not needed.size or (needed < int(n)).mean() >= target:
            return int(n)
        n = max(n + 1, n * 1.5)
    return len(index.centroids)
