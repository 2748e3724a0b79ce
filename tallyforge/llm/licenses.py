"""Licence scans: exact phrases, and notices with a few edits found from exact seeds."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import long_rows
from .words import LOWER, RULES

#: Words in a row that name a licence.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Short notices, as words, with the label they stand for and the edits they may have.
NOTICES = [
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 6),
    ("the software is provided as is without warranty of any kind", "mit", 5),
    ("released under the mit license", "mit", 2),
    ("mit license", "mit", 1),
    ("licensed under the apache license version 2 0", "apache", 4),
    ("apache license", "apache", 1),
    ("gnu general public license", "gpl", 3),
    ("gnu lesser general public license", "lgpl", 3),
    ("gnu affero general public license", "agpl", 3),
    ("mozilla public license", "mpl", 2),
    ("eclipse public license", "epl", 2),
    ("boost software license", "bsl", 2),
    ("redistribution and use in source and binary forms", "bsd", 4),
    ("creative commons attribution", "cc-by", 3),
    ("creative commons attribution sharealike", "cc-by-sa", 3),
]

_TABLE = bytes(int(LOWER[i]) if RULES["letters_lower"][1][i] else 0x20 for i in range(256))

MATCH = "array<struct<label:string,word:long,n_words:long,errors:int,similarity:double>>"


@cache
def _compiled(notices: tuple[tuple[str, str, int], ...]) -> list:
    """Each notice with its k + 1 seeds: whatever k edits do, one of the seeds stays as it is."""
    out = []
    for text, label, k in notices:
        b = text.encode()
        cuts = [round(i * len(b) / (k + 1)) for i in range(k + 2)]
        seeds = [(b[i:j], i) for i, j in zip(cuts, cuts[1:], strict=False)]
        out.append((regex.compile(rb"(?b)(?<= )(?:" + regex.escape(b) + rb"){e<=%d}(?= )" % k), b, label, k, seeds))
    return out


def scan_text(words: list[bytes], phrases: dict[str, str], notices: tuple) -> tuple[list[tuple[int, str]], list[tuple]]:
    """Places of the phrases, and of the notices: (label, first word, words, edits, similarity)."""
    line = b" " + b" ".join(words) + b" "
    spaces = np.zeros(0, dtype=np.int64)

    def spaces_before(at: int) -> int:
        nonlocal spaces
        if not spaces.size:  # only texts with a hit pay for it
            spaces = np.flatnonzero(np.frombuffer(line, dtype=np.uint8) == 0x20)
        return int(np.searchsorted(spaces, at))

    base = []
    for phrase, label in phrases.items():
        p = b" " + phrase.encode() + b" "
        at = line.find(p)
        while at >= 0:
            base.append((spaces_before(at), label))
            at = line.find(p, at + 1)
    found = {}
    for pattern, notice, label, k, seeds in _compiled(notices):
        done = -1
        starts = set()
        for seed, offset in seeds:
            at = line.find(seed)
            while at >= 0:
                starts.add(at - offset)
                at = line.find(seed, at + 1)
        for s in sorted(starts):
            if s <= done:
                continue
            low, high = max(0, s - k - 1), min(len(line), s + len(notice) + k + 1)
            if m := pattern.search(line, low, high):
                edits = sum(m.fuzzy_counts)
                first = spaces_before(m.start()) - 1
                found[(label, first)] = max(found.get((label, first), (0, 0, 0.0)), (spaces_before(m.end()) - first, edits, 1 - edits / len(notice)), key=lambda x: x[2])
                done = m.end() - k - 1 if edits == 0 else s
    return base, [(label, first, *rest) for (label, first), rest in found.items()]


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text: str = "text", phrases: dict[str, str] | None = None, notices: list | None = None) -> DataFrame:
    """Per row of ``docs``: id, n_words, places of phrases (``base``) and of notices with bounded edits (``matches``).

    A-Z are lowered; words are runs of digits, letters a-z and anything beyond ASCII, of the whole text.  A notice matches where its
    words, with spaces between, stand between word borders with at most its number of edited characters.  Null and empty texts
    have no words and no places.  Repeated rows give a row each.  A notice longer than the text can't match.  Places of different notices
    may overlap; of two matches of one label at one word the more alike stays.  The work for a text is linear in its length and hits.
    """
    phrases, notices = PHRASES if phrases is None else phrases, tuple(NOTICES if notices is None else map(tuple, notices))
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, n_words long, base array<struct<word:long,label:string>>, matches {MATCH}"
    base_t = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
    match_t = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("n_words", pa.int64()), ("errors", pa.int32()), ("similarity", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, base, matches = [], [], []
            for t in batch.column(1).cast(pa.binary()):
                words = (t.as_py() or b"").translate(_TABLE).split()
                b, m = scan_text(words, phrases, notices)
                n.append(len(words)), base.append([{"word": w, "label": x} for w, x in b])
                matches.append([dict(zip(("label", "word", "n_words", "errors", "similarity"), x, strict=True)) for x in m])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(base, base_t), pa.array(matches, match_t)], names=["id", "n_words", "base", "matches"])

    return long_rows(docs).select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def op6_license_scan(spark, sf_dir):
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.word").alias("first_word"),
        F.array_max("base.word").alias("last_word"),
        joined(F.col("base.label")).alias("base_labels"),
        joined(F.concat("base.label", "matches.label")).alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max("matches.similarity"), F.lit(0.0))).alias("score"),
        F.size("matches").cast("long").alias("n_matches"),
    )
