"""Names and paths looked up in tables of any length, by token indexes that tasks hold in blocks of a bounded size.

A block of the table is broadcast as an inverted index: for each token the entries that have it.  For a looked-up value the entries
of its tokens are counted, which gives all overlaps at once, so the best entry is exact and no pair of a value and an entry is ever a
row.  Each distinct value is looked up once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values as V

#: Bytes of a block's names.
BLOCK_BYTES = 8 << 20
_WORD = re.compile(r"\w+")


def name_tokens(text: str) -> list[str]:
    return list(dict.fromkeys(_WORD.findall(text.lower())))


def path_segments(text: str) -> list[str]:
    return list(dict.fromkeys(text.lower().split(">")))


class TokenIndex:
    """Entries in the order of their places in the table."""

    def __init__(self, texts: list[str], tokens: Callable[[str], list[str]]):
        self.tokens, self.texts = tokens, [t.lower() for t in texts]
        lists = [tokens(t) for t in texts]
        self.size = np.array([len(x) for x in lists])
        own = sorted((t, i) for i, x in enumerate(lists) for t in x)
        self.entries = np.array([i for _, i in own], dtype=np.int64)
        self.span: dict[str, tuple[int, int]] = {}
        for at, (t, _) in enumerate(own):
            self.span[t] = (self.span.get(t, (at, 0))[0], at + 1)
        self.joined = "\n" + "\n".join(t.replace("\n", "\r") for t in self.texts) + "\n"
        self.starts = np.cumsum([1, *[len(t) + 1 for t in self.texts]])[:-1]
        self.first: dict[str, int] = {}
        for i, t in reversed(list(enumerate(self.texts))):
            self.first[t] = i
        self.lengths = sorted({len(t) for t in self.texts})

    def overlaps(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The entries that share a token, in order, and how many."""
        parts = [self.entries[slice(*self.span[t])] for t in tokens if t in self.span]
        return np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))

    def containing(self, text: str) -> int | None:
        """The first entry that contains ``text``."""
        at = self.joined.find(text.replace("\n", "\r"))
        return None if at < 0 or not self.texts else int(max(0, np.searchsorted(self.starts, max(at, 1), side="right") - 1))

    def contained(self, text: str) -> int | None:
        """The first entry that ``text`` contains."""
        found = None
        for n in self.lengths:
            if n > len(text):
                break
            for i in range(len(text) - n + 1):
                at = self.first.get(text[i : i + n])
                if at is not None and (found is None or at < found):
                    found = at
        return found

    def name(self, text: str) -> tuple[float, int]:
        """The best entry by the Jaccard likeness of tokens, 0.8 or more where one contains the other; the first of ties."""
        own, low = self.tokens(text), text.lower()
        at, both = self.overlaps(own)
        found = [(0.0, 0)]
        if at.size:
            score = both / (len(own) + self.size[at] - both)
            best = int(score.argmax())  # the first of ties
            found.append((float(score[best]), -int(at[best])))
        for i in (self.containing(low), self.contained(low)):
            if i is not None:
                found.append((0.8, -i))
        return max(found)

    def path(self, text: str) -> tuple[float, int]:
        """The best entry by the share of the value's segments that it has; 1 where they are the same; the first of ties."""
        own, found = self.tokens(text), [(0.0, 0)]
        at, both = self.overlaps(own)
        if at.size:
            best = int(both.argmax())
            found.append((float(both[best] / max(1, len(own))), -int(at[best])))
        if text.lower() in self.first:
            found.append((1.0, -self.first[text.lower()]))
        return max(found)


def _looked_up(values: DataFrame, table: DataFrame, text: str, place: str, tokens: Callable[[str], list[str]], how: str) -> DataFrame:
    """(value, score, place) for distinct non-null ``values``: the best entry of ``table``, block by block."""
    spark = values.sparkSession
    size = table.agg(F.sum(F.octet_length(text)).alias("b")).first()["b"] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    found = None
    for b in range(blocks):
        part = table.where(F.pmod(F.xxhash64(place), F.lit(blocks)) == b) if blocks > 1 else table
        rows = part.where(F.col(text).isNotNull()).select(F.col(text).alias("t"), F.col(place).cast("long").alias("p")).orderBy("p", "t").toPandas()
        if not len(rows):
            continue
        sent = spark.sparkContext.broadcast((rows["t"].tolist(), rows["p"].to_numpy()))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            texts, places = sent.value
            index = TokenIndex(texts, tokens)
            best = getattr(index, how)
            for batch in batches:
                got = [best(v) for v in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.float64()), pa.array([int(places[-g[1]]) for g in got], pa.int64())], names=["value", "score", "place"])

        one = values.mapInArrow(run, "value string, score double, place long")
        found = one if found is None else found.unionByName(one)
    if found is None:
        return values.select("value", F.lit(0.0).alias("score"), F.lit(None).cast("long").alias("place"))
    return found.groupBy("value").agg(F.max(F.struct("score", (-F.col("place")).alias("p"))).alias("x")).select("value", "x.score", (-F.col("x.p")).alias("place"))


def match_names(rows: DataFrame, raw: str, names: DataFrame, least: float = 0.3, placeholders: Sequence[str] = ()) -> DataFrame:
    """``rows`` with manufacturer, mfr_brand, mfr_code, mfr_confidence, as ``match_manufacturers`` but from ``names`` (place, name, brand, code).

    Places order ties and each stand once.  Null and placeholder values are unknown; a value without a name of ``least`` likeness stays as it is, with 0.1.
    """
    given = rows.select(F.col(raw).alias("_raw")).distinct()
    clean = F.trim(F.regexp_replace("_raw", r"\s*\((?U:\w+)\)\s*$", ""))
    given = given.withColumn("_clean", clean)
    best = _looked_up(given.where("_clean is not null").select(F.col("_clean").alias("value")).distinct(), names, "name", "place", name_tokens, "name").select(F.col("value").alias("_value"), F.col("score").alias("_score"), F.col("place").alias("_best"))
    entry = names.select(F.col("place").cast("long").alias("_place"), F.struct("name", "brand", "code").alias("_entry"))
    found = given.join(best, F.col("_clean") == F.col("_value"), "left").join(entry, F.col("_best") == F.col("_place"), "left")
    none, hit = V.is_placeholder(F.col("_raw"), placeholders), F.coalesce(F.col("_score") >= least, F.lit(False))
    pick = lambda missing, one, own: F.when(none, missing).when(hit, one).otherwise(own)
    found = found.select(
        "_raw", pick(F.lit("Unknown Manufacturer"), F.col("_entry.name"), F.col("_clean")).alias("manufacturer"), pick(F.lit("Unbranded"), F.col("_entry.brand"), F.col("_clean")).alias("mfr_brand"),
        pick(F.lit("UNKNOWN"), F.col("_entry.code"), F.lit("UNKNOWN")).alias("mfr_code"), pick(F.lit(0.0), F.bround("_score", 2), F.lit(0.1)).alias("mfr_confidence"),
    )
    return rows.join(found, F.col(raw).eqNullSafe(F.col("_raw"))).drop("_raw")


def match_paths(rows: DataFrame, raw: str, paths: DataFrame, least: float = 0.4) -> DataFrame:
    """``rows`` with class_path and class_confidence, as ``match_class_paths`` but from ``paths`` (place, path).

    A value that is null or empty gets the first path with 0, and one without a path of ``least`` the first with 0.1.
    """
    given = rows.select(F.col(raw).alias("_raw")).distinct().withColumn("_clean", F.trim("_raw"))
    best = _looked_up(given.where("_clean is not null").select(F.col("_clean").alias("value")).distinct(), paths, "path", "place", path_segments, "path").select(F.col("value").alias("_value"), F.col("score").alias("_score"), F.col("place").alias("_best"))
    first = paths.agg(F.min_by("path", "place").alias("_first"))
    entry = paths.select(F.col("place").cast("long").alias("_place"), F.col("path").alias("_path"))
    found = given.join(best, F.col("_clean") == F.col("_value"), "left").join(entry, F.col("_best") == F.col("_place"), "left").crossJoin(F.broadcast(first))  # one row
    blank, hit = F.col("_raw").isNull() | (F.col("_raw") == ""), F.coalesce(F.col("_score") >= least, F.lit(False))
    found = found.select("_raw", F.when(blank | ~hit, F.col("_first")).otherwise(F.col("_path")).alias("class_path"), F.when(blank, 0.0).when(hit, F.bround("_score", 2)).otherwise(0.1).alias("class_confidence"))
    return rows.join(found, F.col(raw).eqNullSafe(F.col("_raw"))).drop("_raw")
