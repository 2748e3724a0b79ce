"""Alignment of two tokenizers over whole texts.

Both tokenizations of a text are lists of byte offsets where tokens end.  Each element of the shorter list is looked for in the
longer one by galloping: steps that double from a known place until they pass it, then a binary search in between.  Offsets that both
lists have cut a text into groups; the difference of two neighbours' ranks in the other list is the range of tokens that overlap.

Texts are cut at single spaces between other characters before they are encoded.  Neither tokenizer has a token across such a place (its files are
checked for that; else texts are encoded whole), so the parts of a text are encoded apart, and each distinct word once a worker.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .shared import long_rows, stored

#: A token pair is a number: the first tokenizer's id, then B_BITS bits for the second's.
B_BITS = 20
#: Words that a worker remembers, and characters in them; beyond either it starts anew.
MOST_WORDS, MOST_CHARS = 400_000, 16 << 20
#: Elements of the shorter list that start from one place of the longer.
STRIDE = 32
_BREAK = re.compile(r"(?<=\S) (?=\S)")
_HEX_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


class Pair(NamedTuple):
    """The files of a tokenizer of ``tokenizers`` (byte-level BPE) and of a ``sentencepiece`` model, some MB."""

    a: bytes
    b: bytes


def load_pair(spark: SparkSession, path_a: str, path_b: str) -> Pair:
    """Reads the files on the driver; tasks get them by broadcast, so executors need no copy."""

    def one(path: str) -> bytes:
        if "://" in path:
            return bytes(spark.read.format("binaryFile").load(path).first()["content"])
        with open(path, "rb") as f:
            return f.read()

    return Pair(one(path_a), one(path_b))


def byte_letters() -> dict[str, int]:
    """The bytes that the letters of a byte-level vocabulary stand for: printable ones for themselves, others in order from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For each element of ``short`` how many of ``long`` are less; both ascend.  All elements of ``short`` step at once.

    Every STRIDE-th element finds its place first, by the same search; those after it start there.
    """
    if not short.size or not long.size:
        return np.zeros(short.size, dtype=np.int64)
    if short.size > STRIDE:
        start = np.repeat(gallop(short[::STRIDE], long), STRIDE)[: short.size]
    else:
        start = np.zeros(short.size, dtype=np.int64)
    low, step = start, np.ones(short.size, dtype=np.int64)  # all before low are less
    going = np.flatnonzero(long[np.minimum(low, long.size - 1)] < short)
    high = np.where(long[np.minimum(low, long.size - 1)] < short, long.size, low)
    while going.size:  # exponential: low moves while what it steps on is less
        probe = low[going] + step[going]
        inside = probe < long.size
        less = np.zeros(going.size, dtype=bool)
        less[inside] = long[probe[inside]] < short[going[inside]]
        high[going[~less]] = np.minimum(probe[~less], long.size)
        going = going[less]
        low[going] = probe[less]
        step[going] *= 2
    while (open_ := np.flatnonzero(low < high)).size:  # binary: long[high] is not less, or the end
        middle = (low[open_] + high[open_]) >> 1
        less = long[middle] < short[open_]
        low[open_[less]] = middle[less] + 1
        high[open_[~less]] = middle[~less]
    return low


def _concatenated(table: pa.Array, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of ``table[ids]`` one after the other, and where each starts, with the end."""
    parts, starts, base = [], [np.zeros(1, dtype=np.int64)], 0
    for i in range(0, max(ids.size, 1), 1 << 22):  # offsets of an array are 32 bits wide
        taken = table.take(pa.array(ids[i : i + (1 << 22)]))
        _, offsets, data = taken.buffers()
        at = np.frombuffer(offsets, dtype=np.int32)[taken.offset : taken.offset + len(taken) + 1].astype(np.int64) if offsets is not None and len(taken) else np.zeros(1, dtype=np.int64)
        parts.append(np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, dtype=np.uint8))
        starts.append(at[1:] - at[0] + base)
        base += int(at[-1] - at[0])
    return (parts[0] if len(parts) == 1 else np.concatenate(parts)), np.concatenate(starts)


class _Flat:
    """Lists of ids one after the other that grow."""

    def __init__(self) -> None:
        self.ids, self.at, self.n, self.size = np.zeros(1 << 16, dtype=np.int32), np.zeros(1 << 14, dtype=np.int64), 0, 0

    def extend(self, ids: np.ndarray, ends: np.ndarray) -> None:
        """More lists: their ids, and where each ends in them."""
        while self.size + ids.size > self.ids.size:
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n + ends.size + 1 > self.at.size:
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        self.ids[self.size : self.size + ids.size] = ids
        self.at[self.n + 1 : self.n + 1 + ends.size] = self.size + ends
        self.n, self.size = self.n + ends.size, self.size + ids.size

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the lists ``which``, and how many each has."""
        n = self.at[which + 1] - self.at[which]
        return self.ids[_ranges(self.at[which], n)], n


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each, n times."""
    return np.arange(int(n.sum())) + np.repeat(start - (np.cumsum(n) - n), n)


class Encoder:
    """Both tokenizers in a worker."""

    def __init__(self, pair: Pair):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        spec = json.loads(pair.a)
        self.a = Tokenizer.from_str(pair.a.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pair.b)
        letters = byte_letters()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        entries = [b""] * (max(vocabulary.values()) + 1)
        special = {t["content"] for t in spec.get("added_tokens", [])}
        for text, i in vocabulary.items():
            entries[i] = text.encode() if text in special else bytes(letters[c] for c in text)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if max(len(entries), len(pieces)) > 1 << B_BITS:
            raise ValueError(f"a vocabulary has more than {1 << B_BITS} entries")
        self.table_a = pa.array(entries, pa.binary())
        self.table_b = pa.array([bytes([int(m[1], 16)]) if self.b.is_byte(i) and (m := _HEX_BYTE.fullmatch(p)) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)], pa.binary())
        splits = (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and spec["pre_tokenizer"].get("use_regex", True) and not spec["pre_tokenizer"].get("add_prefix_space") and not spec.get("normalizer")
        self.cuts = bool(splits) and not any(re.search("[^▁]▁", p) for p in pieces) and self.b.normalize(" a  b ") == "▁▁a▁▁b▁"
        self.forget()

    def forget(self) -> None:
        self.plain: dict[str, int] = {}  # parts without white space at their ends
        self.number: dict[str, int] = {}  # other parts
        self.chars, self.ids_a, self.ids_b = 0, _Flat(), _Flat()

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The parts of all texts by number, and how many each text has."""
        if self.ids_a.n > MOST_WORDS or self.chars > MOST_CHARS:
            self.forget()
        found, counts, known = [], [], self.plain.get
        words, others = [], []  # new ones
        for t in texts:
            parts = t.split(" ") if t and self.cuts else []
            got = list(map(known, parts))
            if None in got:
                missing = dict.fromkeys(w for w, n in zip(parts, got, strict=True) if n is None)
                if all(w and w.strip() == w for w in missing):
                    words += missing
                    self.plain.update(zip(missing, itertools.count(len(words) - len(missing) + self.ids_a.n), strict=False))
                    got = list(map(known, parts))
                else:  # spaces that stand together or beside other white space
                    got, parts = None, []
            if t and (got is None or not parts):
                got = _BREAK.split(t) if self.cuts else [t]
                others.append((len(found), got))
            found.append(got), counts.append(len(got))
        self.learn(words)
        for at, parts in others:
            fresh = [w for w in dict.fromkeys(parts) if w not in self.number]
            self.learn([w for w in fresh if w.strip() == w and w not in self.plain])
            for w in fresh:
                if w not in self.plain:
                    self.number[w] = self.ids_a.n
                    self.learn_one(w)
            found[at] = [self.number[w] if w in self.number else self.plain[w] for w in parts]
        return np.fromiter(itertools.chain.from_iterable(found), dtype=np.int64), np.array(counts, dtype=np.int64)

    def learn(self, words: list[str]) -> None:
        """Encodes parts without white space at their ends, all in one text; those of ``words`` that ``plain`` lacks get their number here."""
        if not words:
            return
        self.plain.update(zip(words, itertools.count(self.ids_a.n), strict=False))
        text = " ".join(words)
        self.chars += len(text)
        a, b = (np.array(x, dtype=np.int32) for x in (self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text, num_threads=1)))
        wanted = np.frombuffer((" " + text).encode(), dtype=np.uint8)
        ends = np.cumsum([len(w.encode()) + 1 for w in words])
        for ids, table, flat, alone in ((a, self.table_a, self.ids_a, lambda w: self.a.encode(" " + w, add_special_tokens=False).ids), (b, self.table_b, self.ids_b, lambda w: self.b.encode(w))):
            data, at = _concatenated(table, ids)
            if np.array_equal(data, wanted):
                flat.extend(ids, np.searchsorted(at[1:], ends) + 1)
            else:
                each = [alone(w) for w in words]
                flat.extend(np.fromiter(itertools.chain.from_iterable(each), dtype=np.int32), np.cumsum([len(x) for x in each]))

    def learn_one(self, part: str) -> None:
        self.chars += len(part)
        for ids, flat in ((self.a.encode(" " + part, add_special_tokens=False).ids, self.ids_a), (self.b.encode(part, num_threads=1), self.ids_b)):
            flat.extend(np.array(ids, dtype=np.int32), np.array([len(ids)]))


class Aligned(NamedTuple):
    """Tokens of a slice of texts; every array of a text stands together, in the order of texts."""

    a: np.ndarray  # ids
    b: np.ndarray
    n_a: np.ndarray  # tokens of each text
    n_b: np.ndarray
    cut_a: np.ndarray  # whether a group ends with this token
    cut_b: np.ndarray
    link_text: np.ndarray  # text, a and b of each overlapping pair
    link_a: np.ndarray
    link_b: np.ndarray


def _per_text(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums over runs of lengths ``n``."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    at = np.concatenate([[0], np.cumsum(n)])
    return sums[at[1:]] - sums[at[:-1]]


def align_slice(encoder: Encoder, texts: list[str]) -> Aligned:
    """The alignment of each text; of those whose bytes a tokenizer doesn't give back, and empty ones, there are no tokens."""
    number, n_words = encoder.numbers(texts)
    expected = np.frombuffer("".join([" " + t if t else "" for t in texts]).encode(), dtype=np.uint8)
    size = np.array([len(t.encode()) + 1 if t else 0 for t in texts], dtype=np.int64)
    keep = np.ones(len(texts), dtype=bool)
    while True:
        a, per_word_a = encoder.ids_a.take(number)
        b, per_word_b = encoder.ids_b.take(number)
        n_a, n_b = _per_text(per_word_a, n_words), _per_text(per_word_b, n_words)
        bytes_a, at_a = _concatenated(encoder.table_a, a)
        bytes_b, at_b = _concatenated(encoder.table_b, b)
        wanted = expected if keep.all() else expected[np.repeat(keep, size)]
        if np.array_equal(bytes_a, wanted) and np.array_equal(bytes_b, wanted):
            break
        held = np.where(keep, size, 0)
        end_w, end_a, end_b = np.cumsum(held), at_a[np.cumsum(n_a)], at_b[np.cumsum(n_b)]
        for i in np.flatnonzero(keep):
            w = wanted[end_w[i] - held[i] : end_w[i]]
            first_a, first_b = end_a[i - 1] if i else 0, end_b[i - 1] if i else 0
            keep[i] = np.array_equal(bytes_a[first_a : end_a[i]], w) and np.array_equal(bytes_b[first_b : end_b[i]], w)
        number, n_words = number[np.repeat(keep, n_words)], np.where(keep, n_words, 0)
    ends_a, ends_b = at_a[1:], at_b[1:]
    cut_a, cut_b = np.zeros(a.size, dtype=bool), np.zeros(b.size, dtype=bool)
    links = []
    text_a, text_b = np.repeat(np.arange(len(texts)), n_a), np.repeat(np.arange(len(texts)), n_b)
    shorter_a = n_a <= n_b
    for mine, theirs, ends, others, cut, cut_other, text, n_theirs, pick in ((a, b, ends_a, ends_b, cut_a, cut_b, text_a, n_b, shorter_a), (b, a, ends_b, ends_a, cut_b, cut_a, text_b, n_a, ~shorter_a)):
        chosen = np.flatnonzero(pick[text])
        if not chosen.size:
            continue
        rank = gallop(ends[chosen], others)
        same = others[rank] == ends[chosen]
        cut[chosen[same]] = True
        cut_other[rank[same]] = True
        own = text[chosen]
        first = np.concatenate([[0], rank[:-1] + same[:-1]])
        begins = np.concatenate([[True], own[1:] != own[:-1]])
        first[begins] = (np.cumsum(n_theirs) - n_theirs)[own[begins]]
        n = rank - first + 1
        pairs = np.repeat(mine[chosen], n), theirs[_ranges(first, n)]
        links.append((np.repeat(own, n), *(pairs if mine is a else pairs[::-1])))
    none = np.zeros(0, dtype=np.int64)
    link = [np.concatenate([none, *[x[i] for x in links]]) for i in range(3)]
    return Aligned(a, b, n_a, n_b, cut_a, cut_b, *link)


class GroupText:
    """``a1,a2|b1;a3|b2,b3`` of each text, from strings of all ids made once."""

    def __init__(self, size_a: int, size_b: int):
        each = [[str(i) + "," for i in range(size_a)], [str(i) + "|" for i in range(size_a)], [str(i) + "," for i in range(size_b)], [str(i) + ";" for i in range(size_b)], [str(i) for i in range(size_b)]]
        self.base = np.concatenate([[0], np.cumsum([len(x) for x in each])])
        self.strings = pa.array([s.encode() for x in each for s in x], pa.binary())

    def digests(self, x: Aligned) -> list[str]:
        group_a, group_b = np.cumsum(x.cut_a) - x.cut_a, np.cumsum(x.cut_b) - x.cut_b
        n_groups = int(x.cut_a.sum())
        to_a, to_b = np.cumsum(np.bincount(group_a, minlength=n_groups)), np.cumsum(np.bincount(group_b, minlength=n_groups))
        before_b = np.concatenate([[0], to_b])
        which = np.zeros(x.a.size + x.b.size, dtype=np.int64)
        which[np.arange(x.a.size) + before_b[group_a]] = x.a + self.base[x.cut_a.astype(np.int64)]
        kind = 2 + x.cut_b.astype(np.int64)
        last = np.cumsum(x.n_b)[x.n_b > 0] - 1
        kind[last] = 4
        which[np.arange(x.b.size) + (to_a[group_b] if n_groups else group_b)] = x.b + self.base[kind]
        data, at = _concatenated(self.strings, which)
        ends = at[np.cumsum(x.n_a + x.n_b)]
        view = memoryview(np.ascontiguousarray(data))
        return [hashlib.sha256(view[i:j]).hexdigest() if n else "" for i, j, n in zip([0, *ends[:-1].tolist()], ends.tolist(), x.n_a.tolist())]


def token_groups(docs: DataFrame, pair: Pair, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, a_ids, b_ids, a_ends, b_ends): the tokens of each text and, for each group, how many tokens of either stand up to its end.

    Null and empty texts, and those whose bytes (after a space in front) a tokenizer doesn't give back, have empty lists.  Rows that
    share an id, or have none, stay rows of their own; other columns are left out.  A long text is taken whole: a
    task holds about 60 bytes for each of its tokens.
    """
    sent = docs.sparkSession.sparkContext.broadcast(pair)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(sent.value)
        for batch in W.slices(batches, "text"):
            x = align_slice(encoder, [t or "" for t in batch.column(1).to_pylist()])
            lists = []
            for ids, n in ((x.a, x.n_a), (x.b, x.n_b)):
                lists.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(ids, pa.int32())))
            for cut, n in ((x.cut_a, x.n_a), (x.cut_b, x.n_b)):
                place = np.flatnonzero(cut) + 1
                text = np.repeat(np.arange(n.size), n)[cut]
                groups = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n.size))])
                lists.append(pa.ListArray.from_arrays(pa.array(groups, pa.int32()), pa.array(place - (np.cumsum(n) - n)[text], pa.int32())))
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=["id", "a_ids", "b_ids", "a_ends", "b_ends"])

    rows = long_rows(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, a_ids array<int>, b_ids array<int>, a_ends array<int>, b_ends array<int>")


def linked_pairs(docs: DataFrame, pair: Pair, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times): of each text its distinct linked token pairs and how often
    each is linked.  ``row`` tells rows apart.  Edge cases as in ``token_groups``."""
    sent = docs.sparkSession.sparkContext.broadcast(pair)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(sent.value)
        group_text = GroupText(len(encoder.table_a), len(encoder.table_b))
        for batch in W.slices(batches, "text"):
            x = align_slice(encoder, [t or "" for t in batch.column(2).to_pylist()])
            n = x.n_a.size
            key = np.sort(x.link_text << 2 * B_BITS | x.link_a.astype(np.int64) << B_BITS | x.link_b)
            new = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: key.size])
            times = np.diff(np.append(new, key.size))
            text, code = key[new] >> 2 * B_BITS, key[new] & ((1 << 2 * B_BITS) - 1)
            at = pa.array(np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n))]), pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(v, kind)) for v, kind in ((code, pa.int64()), (times, pa.int32()))]
            numbers = [x.n_a, x.n_b, _per_text(x.cut_a, x.n_a), np.bincount(x.link_text, minlength=n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(v, pa.int64()) for v in numbers], pa.array(group_text.digests(x), pa.string()), *lists], names=names)

    names = ["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
    rows = long_rows(docs).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"row long, id {rows.schema['id'].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>")


def pair_counts(linked: DataFrame) -> DataFrame:
    """(pair, n, best): how many texts hold each pair linked, and whether that is the most of its first token (ties too)."""
    counts = stored(linked.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pairs")
    most = counts.groupBy(F.shiftright("pair", B_BITS).alias("a")).agg(F.max("n").alias("most"))
    return stored(counts.join(most, F.shiftright("pair", B_BITS) == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pair-counts")


def score_links(linked: DataFrame, counts: DataFrame, most_sent: int = 1 << 20) -> DataFrame:
    """``linked`` without its lists, with ``n_best`` (links whose pair is its first token's most frequent) and ``count_sum``.

    The pairs that stand in most texts are broadcast, ``most_sent`` at most (17 bytes each); links of the others, the rarest, are joined by shuffle.
    """
    sizes = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("level")).agg(F.count("*").alias("c")).orderBy(F.desc("level")).collect()  # 63 rows at most
    level, total = 64, 0
    for r in sizes:
        total += r["c"]
        if total > most_sent:
            break
        level = r["level"]
    heavy = F.col("n") >= (1 << min(level, 62))
    sent = counts.where(heavy).orderBy("pair").toPandas()
    known = linked.sparkSession.sparkContext.broadcast((sent["pair"].to_numpy(dtype=np.int64), sent["n"].to_numpy(dtype=np.int64), sent["best"].to_numpy(dtype=bool)))
    result = ["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = known.value
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(len(result))
            code, times = lists.flatten().to_numpy(), batch.column(len(result) + 1).flatten().to_numpy().astype(np.int64)
            per_row = np.diff(lists.offsets.to_numpy())
            at = np.minimum(np.searchsorted(pair, code), max(pair.size - 1, 0))
            there = pair[at] == code if pair.size else np.zeros(code.size, dtype=bool)
            count = np.where(there, n[at], 0) if pair.size else np.zeros(code.size, dtype=np.int64)
            top = there & best[at] if pair.size else there
            left = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(_per_text(~there, per_row))]), pa.int32()), pa.array(v[~there], kind)) for v, kind in ((code, pa.int64()), (times, pa.int32()))]
            sums = [pa.array(_per_text(v, per_row), pa.int64()) for v in (times * top, times * count)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(result)], *sums, *left], names=[*result, "n_best", "count_sum", "pairs", "times"])

    kept = [f"{f.name} {f.dataType.simpleString()}" for f in linked.schema.fields if f.name in result]
    done = linked.select(*result, "pairs", "times").mapInArrow(run, ", ".join([*kept, "n_best long", "count_sum long", "pairs array<long>", "times array<int>"]))
    if sum(r["c"] for r in sizes) == len(sent):
        return done.drop("pairs", "times", "row")
    done = stored(done, "scored")
    rest = done.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", "x.pairs", "x.times")
    more = rest.join(counts.where(~heavy), F.col("pairs") == F.col("pair")).groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    out = done.drop("pairs", "times").join(more, "row", "left")
    return out.withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))}).drop("more_best", "more_sum", "row")


TOKENIZERS = "/opt/tokenizers"


def op13_cross_tokenizer_alignment(spark, sf_dir, tokenizers: str = TOKENIZERS):
    pair = load_pair(spark, f"{tokenizers}/byte_bpe_50k.json", f"{tokenizers}/piece_bpe_32k.model")
    linked = stored(linked_pairs(spark.read.parquet(f"{sf_dir}/documents.parquet"), pair), "linked")
    out = score_links(linked, pair_counts(linked))
    return out.select(F.col("id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
