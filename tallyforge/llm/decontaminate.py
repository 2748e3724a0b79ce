"""Benchmark decontamination: suffix arrays of shards of the training texts, searched for every suffix of the test items."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .shared import long_rows, stored

RULE = "letters_lower"


class Suffixes(NamedTuple):
    """The suffixes of all test items, each cut at the window, as ranks of words."""

    vocabulary: np.ndarray  # sorted word hashes; rank i + 1
    low: np.ndarray  # sort keys: a window, then zeros
    high: np.ndarray  # a window, then the largest rank
    size: np.ndarray  # words of each window
    item: np.ndarray  # item number
    at: np.ndarray  # first word in the item
    names: list  # item ids
    seen: np.ndarray  # hashed first two ranks of any window
    single: np.ndarray  # by rank: is it a window of one word


_SEEN = 20
#: Blocks of suffixes that a stage holds: each takes a Python worker of a task slot, and its suffixes stay in that worker.
BLOCKS_A_STAGE = 4


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a.astype(np.uint64) * np.uint64(0x9E3779B1) + b.astype(np.uint64) * np.uint64(0x85EBCA77)) >> np.uint64(8)) & np.uint64((1 << _SEEN) - 1)


def _keys(ranks: np.ndarray) -> np.ndarray:
    """Rows of ranks as byte strings that sort like them."""
    return np.ascontiguousarray(ranks.astype(">u4")).view(f"S{4 * ranks.shape[1]}").ravel()


def suffixes_of(items: pd.DataFrame, window: int) -> Suffixes:
    cut = W.cut(pa.array(items["text"], pa.string()), RULE)
    vocabulary = np.unique(cut.hash)
    rank = np.append(np.searchsorted(vocabulary, cut.hash) + 1, np.zeros(window, dtype=np.int64)).astype(np.uint32)
    words = np.diff(cut.first)
    windows = np.where(words > 0, np.maximum(1, words - window + 1), 0)
    item = np.repeat(np.arange(len(items)), windows)
    at = np.arange(item.size) - np.repeat(np.cumsum(windows) - windows, windows)
    size = np.minimum(words[item], window)
    ranks = np.lib.stride_tricks.sliding_window_view(rank, window)[cut.first[item] + at] * (np.arange(window) < size[:, None])
    past = np.arange(window) >= size[:, None]
    seen = np.zeros(1 << _SEEN, dtype=bool)
    single = np.zeros(vocabulary.size + 1, dtype=bool)
    if size.size:
        long = size > 1
        if window > 1:
            seen[_pair(ranks[long, 0], ranks[long, 1]).astype(np.int64)] = True
        single[ranks[~long, 0]] = True
    return Suffixes(vocabulary, _keys(ranks), _keys(np.where(past, 0xFFFFFFFF, ranks)), size, item, at, list(items["item_id"]), seen, single)


def search_shard(cut: W.Words, test: Suffixes, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(word of the shard, number of the test suffix) of each place where a whole window stands."""
    none = np.zeros(0, dtype=np.int64)
    n = cut.hash.size
    if not n or not test.size.size:
        return none, none
    slot = np.zeros(1 << 18, dtype=bool)
    slot[(test.vocabulary >> np.uint64(46)).astype(np.int64)] = True
    maybe = np.flatnonzero(slot[(cut.hash >> np.uint64(46)).astype(np.int64)])
    where = np.minimum(np.searchsorted(test.vocabulary, cut.hash[maybe]), test.vocabulary.size - 1)
    rank = np.zeros(n + window, dtype=np.int64)
    good = test.vocabulary[where] == cut.hash[maybe]
    rank[maybe[good]] = where[good] + 1
    text_end = np.repeat(cut.first[1:], np.diff(cut.first))
    known = maybe[good]
    follows = known + 1 < text_end[known]
    keep = test.single[rank[known]] | (follows & (rank[known + 1] > 0) & test.seen[_pair(rank[known], rank[known + 1]).astype(np.int64)])
    place = known[keep]  # where a suffix of the shard can begin a window
    if not place.size:
        return none, none
    reach = place[:, None] + np.arange(window)
    suffix = _keys(np.where(reach < text_end[place][:, None], rank[reach], 0))
    order = np.argsort(suffix, kind="stable")  # the shard's suffix array, of such suffixes
    array = suffix[order]
    low, high = np.searchsorted(array, test.low, "left"), np.searchsorted(array, test.high, "right")
    count = high - low
    which = np.repeat(np.arange(count.size), count)
    inside = np.arange(which.size) - np.repeat(np.cumsum(count) - count, count)
    return place[order[low[which] + inside]], which


def longest(place: np.ndarray, which: np.ndarray, test: Suffixes) -> np.ndarray:
    """Maximal matches from those of windows, rows (word, item number, word of the item, words): windows that follow each
    other both in the text and in the item are one match."""
    if not place.size:
        return np.zeros((0, 4), dtype=np.int64)
    item, at, size = test.item[which], test.at[which], test.size[which]
    order = np.lexsort((place, place - at, item))
    item, at, size, place = item[order], at[order], size[order], place[order]
    new = np.ones(place.size, dtype=bool)
    new[1:] = (item[1:] != item[:-1]) | (place[1:] != place[:-1] + 1) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], place.size) - 1
    return np.stack([place[first], item[first], at[first], place[last] - place[first] + size[last]], axis=1)


_MATCH = pa.list_(pa.struct([("item_id", pa.string()), ("item_word", pa.int64()), ("word", pa.int64()), ("n_words", pa.int64())]))


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 4 << 20, id_col: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """Per row of ``docs``: id, n_words, n_hit (words inside any occurrence of a window of any item) and ``matches``, the longest
    verbatim matches with their places.

    A-Z are lowered, words are runs of digits, a-z and anything beyond ASCII, over whole texts.  A window is ``window`` words in
    a row of an item; an item of fewer is one window.  Items without words, or null, match nothing.  Null and empty documents have
    no words.  Repeated rows give a row each; repeated items count once.  Each row is judged by its own text, whatever its id.
    Where ``carry`` names columns of ``docs``, ``text`` and a struct ``row`` of these columns stand in the result too.

    The suffixes of the items go to every task in blocks of at most ``block_bytes`` of text (an item longer than that is a block
    of its own), about 16 times as large when sent; with a larger benchmark the documents pass one block after the other without a
    shuffle, ``BLOCKS_A_STAGE`` of them in a stage, after which they are stored.  Very long texts are searched alone.  Columns of
    ``docs`` may have any names.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    n_bytes = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-n_bytes // block_bytes))
    fields = "item_id:string,item_word:long,word:long,n_words:long"
    row = [F.struct(*[F.col(c) for c in carry]).alias("row")] if carry else []
    out = long_rows(docs).select(F.col(id_col).alias("id"), F.col("text").cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"), F.expr(f"cast(array() as array<struct<{fields}>>)").alias("matches"), *row)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in out.schema.fields])
    for k in range(n_blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k).toPandas()
        sent = docs.sparkSession.sparkContext.broadcast(suffixes_of(block, window))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            test = sent.value
            for batch in W.slices(batches, "text", 1 << 20):
                cut = W.cut(batch.column(1), RULE)
                place, which = search_shard(cut, test, window)
                found = batch.column(3).to_pylist()
                rows = longest(place, which, test)
                text = np.searchsorted(cut.first, rows[:, 0], side="right") - 1
                for t, (word, item, at, n) in zip(text, rows.tolist(), strict=True):
                    found[t].append({"item_id": test.names[item], "item_word": at, "word": word - int(cut.first[t]), "n_words": n})
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(cut.first)), pa.array(found, _MATCH), *batch.columns[4:]], names=schema.names)

        out = out.mapInArrow(search, schema)
        if k % BLOCKS_A_STAGE == BLOCKS_A_STAGE - 1 and k + 1 < n_blocks:
            out = stored(out, "searched")
    # words inside any match: the matches in order, each counted from where the ones before it end
    span = "array_sort(transform(matches, m -> struct(m.word as a, m.word + m.n_words as b)))"
    hit = f"aggregate({span}, struct(0L as n, 0L as e), (s, m) -> struct(s.n + greatest(m.b - greatest(m.a, s.e), 0L) as n, greatest(s.e, m.b) as e), s -> s.n)"
    return out.select("id", "n_words", F.expr(hit).alias("n_hit"), "matches", *(["text", "row"] if carry else []))


def op3_benchmark_decontamination(spark, sf_dir):
    found = find_contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    items = F.array_sort(F.array_distinct("matches.item_id"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP3_SQL = r"""
WITH dl AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (
  SELECT item_id, least(len(ws), 10) AS n, array_to_string(ws[p:p + least(len(ws), 10) - 1], ' ') AS t
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS p FROM items WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT n FROM win),
dwin AS (
  SELECT doc_id, n, p, array_to_string(ws[p:p + n - 1], ' ') AS t
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM dl, lens WHERE len(ws) >= n)),
hits AS (SELECT d.doc_id, d.p, d.n, w.item_id FROM dwin d JOIN win w ON d.n = w.n AND d.t = w.t),
covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(l.ws), 0) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(f.n_items, 0) AS n_items,
       sha256(coalesce(f.s, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM documents d LEFT JOIN dl l USING (doc_id) LEFT JOIN covered c USING (doc_id) LEFT JOIN found f USING (doc_id)
"""
