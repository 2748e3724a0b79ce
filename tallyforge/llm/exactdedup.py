"""Exact deduplication by an index of cuckoo filters that takes and gives back live digests.

A digest is the SHA-256 of a text without its white space.  Digests are dealt to shards by their first bits.  A shard has a cuckoo
filter (four 16-bit tags a bucket, two buckets a digest) and buckets of stored keys, the digests of its live rows.  A batch asks the
filters first: what they don't know is new, and only hits are held against the stored keys.  New digests go into the filters; where one
overflows, it is built anew from the stored keys with twice the buckets.  When the last row of a digest is deleted, its tag is taken out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import discard, stored

SPACES = " \t\n\x0b\x0c\r"
SLOTS, MOST_KICKS = 4, 200
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)


class CuckooFilter:
    """Tags of 16 bits in buckets of SLOTS, 0 where free; digests as rows of 32 bytes.  All digests of a call move at once."""

    def __init__(self, log2: int, tags: np.ndarray | None = None):
        self.log2 = log2
        self.tags = np.zeros((1 << log2, SLOTS), dtype=np.uint16) if tags is None else tags.reshape(1 << log2, SLOTS)

    def place(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First bucket and tag: other bits of the digest than those that choose the shard."""
        words = np.ascontiguousarray(digests).view(np.uint64).reshape(-1, 4)
        tag = (words[:, 2] & np.uint64(0xFFFF)).astype(np.uint16)
        return (words[:, 1] & np.uint64((1 << self.log2) - 1)).astype(np.int64), np.where(tag == 0, np.uint16(1), tag)

    def other(self, bucket: np.ndarray, tag: np.ndarray) -> np.ndarray:
        """The other bucket of a tag; the way back is the same."""
        step = ((tag.astype(np.uint64) * _MIX) >> np.uint64(40)) & np.uint64((1 << self.log2) - 1)
        return bucket ^ step.astype(np.int64)

    def has(self, digests: np.ndarray) -> np.ndarray:
        bucket, tag = self.place(digests)
        return (self.tags[bucket] == tag[:, None]).any(1) | (self.tags[self.other(bucket, tag)] == tag[:, None]).any(1)

    def insert(self, digests: np.ndarray) -> bool:
        """False if they don't fit: then some tags are lost, and the filter must be built anew."""
        at, tag = self.place(digests)
        pick = np.random.default_rng(at.size)
        for turn in range(MOST_KICKS):
            order = np.argsort(at, kind="stable")
            at, tag = at[order], tag[order]
            new = np.append(True, at[1:] != at[:-1])[: at.size]
            rank = np.arange(at.size) - np.flatnonzero(new)[np.cumsum(new) - 1]
            free = self.tags[at] == 0
            fits = rank < free.sum(1)
            slot = np.argmax(np.cumsum(free, axis=1) == rank[:, None] + 1, axis=1)
            self.tags[at[fits], slot[fits]] = tag[fits]
            at, tag, new = at[~fits], tag[~fits], new[~fits]
            if not at.size:
                return True
            if turn:  # the second time a tag finds both its buckets full, one of each bucket changes places
                first = np.append(True, at[1:] != at[:-1])
                slot = pick.integers(0, SLOTS, int(first.sum()))
                out = self.tags[at[first], slot]
                self.tags[at[first], slot] = tag[first]
                tag[first] = out
            at = self.other(at, tag)
        return False

    def delete(self, digests: np.ndarray) -> None:
        """One tag for each digest; only digests that were inserted and not deleted since."""
        bucket, tag = self.place(digests)
        second = self.other(bucket, tag)
        while bucket.size:
            here, there = self.tags[bucket] == tag[:, None], self.tags[second] == tag[:, None]
            at = np.where(here.any(1), bucket, second)
            slot = np.argmax(np.where(here.any(1)[:, None], here, there), axis=1)
            if not (here.any(1) | there.any(1)).all():
                raise ValueError("a digest is not in the filter")
            _, one = np.unique(at * SLOTS + slot, return_index=True)  # equal tags take a slot each, in turn
            self.tags[at[one], slot[one]] = 0
            left = np.ones(bucket.size, dtype=bool)
            left[one] = False
            bucket, tag, second = bucket[left], tag[left], second[left]


def built(digests: np.ndarray, log2: int) -> CuckooFilter:
    """A filter of all ``digests``, of 2**log2 buckets or more."""
    while not (new := CuckooFilter(log2)).insert(digests):
        log2 += 1
    return new


def _digests(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    values = column.cast(pa.binary(32))
    chunks = values.chunks if isinstance(values, pa.ChunkedArray) else [values]
    flat = [np.frombuffer(c.buffers()[1], dtype=np.uint8)[c.offset * 32 : (c.offset + len(c)) * 32] for c in chunks if len(c)]
    return (np.concatenate(flat) if flat else np.zeros(0, dtype=np.uint8)).reshape(-1, 32)


def without_spaces(text: Column) -> Column:
    """The text without the characters of SPACES; null is ''."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for c in SPACES:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


_FILTER = "shard int, log2 int, tags binary"
_SCHEMA = f"{_FILTER}, fits boolean"


class CuckooIndex:
    """Live rows, their digests as stored keys, and a filter a shard.  All three are Parquet tables in the shared folder; each call
    writes what it adds before it returns, so a lost executor costs tasks and no state.

    ``shards`` bounds what a task holds: a shard's filter (about 2.3 bytes a digest) and its distinct digests of one batch.  Choose it
    so that a shard gets some 100,000 digests; filters grow by doubling from ``2**log2`` buckets.
    """

    def __init__(self, spark: SparkSession, shards: int = 64, log2: int = 6):
        self.shards, self.log2 = shards, log2
        self.filters = stored(spark.range(shards).select(F.col("id").cast("int").alias("shard"), F.lit(log2).alias("log2"), F.unhex(F.repeat(F.lit("00"), (2 * SLOTS) << log2)).alias("tags")), "filters")
        self.keys: list[DataFrame] = []
        self.rows: list[DataFrame] = []
        #: What the last call did: digests asked for, filter hits, hits that no stored key bore out, filters built anew.
        self.last: dict[str, int] = {}

    def _all(self, tables: list[DataFrame]) -> DataFrame:
        out = tables[0]
        for t in tables[1:]:
            out = out.unionByName(t)
        return out

    def _shard(self) -> Column:
        return F.pmod(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), F.lit(self.shards)).cast("int")

    def probe(self, digests: DataFrame) -> DataFrame:
        """(shard, digest, hit) for distinct digests (shard, digest): false means that no live row has it."""

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            f = CuckooFilter(right["log2"][0].as_py(), np.frombuffer(right["tags"][0].as_py(), dtype=np.uint16))
            return left.append_column("hit", pa.array(f.has(_digests(left["digest"]))))

        return digests.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInArrow(run, "shard int, digest binary, hit boolean")

    def _change(self, digests: DataFrame, remove: bool) -> None:
        """Filters with distinct digests put in or taken out; those that overflow are built anew from the stored keys."""

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            f, own = CuckooFilter(right["log2"][0].as_py(), np.frombuffer(right["tags"][0].as_py(), dtype=np.uint16).copy()), _digests(left["digest"])
            fits = True
            if remove:
                f.delete(own)
            else:
                fits = f.insert(own)
            return pa.table({"shard": right["shard"], "log2": right["log2"], "tags": pa.array([f.tags.tobytes() if fits else b""], pa.binary()), "fits": pa.array([fits])})

        was = self.filters
        now = stored(digests.groupBy("shard").cogroup(was.groupBy("shard")).applyInArrow(run, _SCHEMA), "filters")
        full = now.where("not fits").select("shard", "log2")
        self.last["rebuilt"] = full.count()
        self.filters = now.drop("fits")
        self.filters.stored_at = now.stored_at
        if self.last["rebuilt"]:

            def grow(left: pa.Table, right: pa.Table) -> pa.Table:
                f = built(_digests(left["digest"]), right["log2"][0].as_py() + 1)
                return pa.table({"shard": right["shard"], "log2": pa.array([f.log2], pa.int32()), "tags": pa.array([f.tags.tobytes()], pa.binary())})

            keys = self._all(self.keys).join(full.select("shard"), "shard", "left_semi")
            larger = keys.groupBy("shard").cogroup(full.groupBy("shard")).applyInArrow(grow, _FILTER)
            self.filters = stored(now.where("fits").select("shard", "log2", "tags").unionByName(larger), "filters")
            discard(now)
        discard(was)

    def insert(self, batch: DataFrame) -> DataFrame:
        """Takes rows (row, id, size, digest) as ``digested`` gives them, row by row unique in the index; returns (shard, digest, known)
        of the batch's distinct digests: known are those that a live row had before.

        Copies within a batch are reduced to one digest before anything is shuffled, so a hot text costs a row a task.
        """
        asked = batch.groupBy("digest").agg(F.lit(1).alias("one")).select(self._shard().alias("shard"), "digest")
        seen = stored(self.probe(asked), "probed")
        if self.keys:
            known = stored(seen.where("hit").join(self._all(self.keys), ["shard", "digest"], "left_semi").select("shard", "digest"), "known")
        else:
            known = stored(seen.where("false").select("shard", "digest"), "known")
        borne_out = known.count()
        new = stored(seen.where("not hit").select("shard", "digest").unionByName(seen.where("hit").select("shard", "digest").join(known, ["shard", "digest"], "left_anti")), "keys")
        n = seen.agg(F.count("*").alias("n"), F.count_if("hit").alias("hits")).first()
        self.last = {"asked": n["n"], "hits": n["hits"], "false_hits": n["hits"] - borne_out}
        self.keys.append(new)
        self.rows.append(batch)
        self._change(new, remove=False)
        return new.withColumn("known", F.lit(False)).unionByName(known.withColumn("known", F.lit(True)))

    def delete(self, ids: DataFrame) -> None:
        """Deletes the live rows with these ids (a column ``id``; others, nulls and repeated ones don't matter).  A digest that no row
        has any more leaves the filters and the stored keys, and counts as new when it comes again."""
        if not self.rows:
            return
        wanted, rows = ids.select("id").where("id is not null").distinct(), self._all(self.rows)
        left = stored(rows.join(wanted, "id", "left_anti").select("row", "id", "size", "digest"), "rows")
        touched = rows.join(wanted, "id", "left_semi").groupBy("digest").agg(F.lit(1).alias("one")).select("digest")
        live = left.groupBy("digest").agg(F.lit(1).alias("one")).select("digest")
        dead = stored(touched.join(live, "digest", "left_anti").select(self._shard().alias("shard"), "digest"), "dead")
        keys = stored(self._all(self.keys).join(dead, ["shard", "digest"], "left_anti").select("shard", "digest"), "keys")
        self.last = {}
        self._change(dead, remove=True)
        self.rows, self.keys = [left], [keys]

    def groups(self) -> DataFrame:
        """(id, keep_id, group_size, kept, digest) of all live rows.  Of equal texts the row with the most code points stays, then of the
        least id (null is last), then the first row that came with it."""
        rows = self._all(self.rows)
        order = F.struct((-F.col("size")).alias("s"), F.col("id").isNull().alias("n"), F.col("id").alias("i"), F.col("row").alias("r"))
        best = stored(rows.groupBy("digest").agg(F.min(order).alias("best"), F.count("*").alias("group_size")).select("digest", F.col("best.i").alias("keep_id"), F.col("best.r").alias("keep_row"), "group_size"), "groups")
        return rows.join(best, "digest").select("id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "digest")


def digested(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, size, digest) of each row, stored: code points of the text, and the SHA-256 of what is left of it without white space.

    Null counts as empty; all empty texts are equal.  Repeated rows and rows without an id are rows of their own.  A long text is hashed
    whole; other columns, whatever their names, are left out.
    """
    text = F.col(text_col).cast("string")
    one = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.length(F.coalesce(text, F.lit(""))).cast("long").alias("size"), F.unhex(F.sha2(without_spaces(text), 256)).alias("digest"))
    return stored(one, "digests")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", loads: int = 4, digests_a_shard: int = 100_000) -> DataFrame:
    """(id, keep_id, group_size, kept, digest) of each row of ``docs``, through an index that is fed in ``loads`` batches.

    The number of shards follows the number of rows.  Edge cases as in ``digested`` and ``CuckooIndex.groups``; no rows, no result rows.
    """
    rows = digested(docs, id_col, text_col)
    index = CuckooIndex(docs.sparkSession, shards=max(12, -(-rows.count() // digests_a_shard)))
    for load in range(loads):
        index.insert(rows.where(F.pmod(F.xxhash64("row"), F.lit(loads)) == load))
    return index.groups()


def op11_exact_dedup(spark, sf_dir):
    out = deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").cast("long").alias("doc_id"), F.col("keep_id").cast("long").alias("keep_id"), "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP11_SQL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size, row_number() OVER w = 1 AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h ORDER BY length(text) DESC, doc_id)"""
