"""Substring dedup: passages that also stand in an earlier document, by matching statistics on suffix automata.

Every window of ``window`` words has an anchor, the least hash of its runs of ``ANCHOR`` words: equal windows have equal anchors,
wherever they stand.  Consecutive windows with one anchor are a fragment.  Fragments without an anchor in another document
can't be copied and go no further.  What is left falls into reference shards by anchor:

* equal fragments: all but those of the least document are covered whole;
* different fragments of one anchor: a suffix automaton takes them in order of their least document; before a fragment is
  added, its matching statistics against the automaton give the maximal spans to remove;
* anchors of more than ``shard_words`` words in different fragments (a passage in very many contexts) would make an automaton without
  bound; there each fragment is held against that of the least document, and then against the least one of those that differ from it
  in the same way, which costs a few rows a fragment.  Partial aggregates keep both free of hot groups.

Shards reach the tasks by a shuffle on the anchor and not by broadcast: for a corpus against itself they grow with the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .shared import bit_of, bitmap, bits_for, has_bit, long_rows, stored

RULE, ANCHOR = "spaced", 8


class SuffixAutomaton:
    """Of word sequences that are added one after the other, with matching statistics of a sequence against all of them."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, sequence: list[int]) -> None:
        last = 0
        for w in sequence:
            last = self._extend(last, w)

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:  # only in a sequence after the first
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        now = len(nxt)
        nxt.append({}), link.append(0), length.append(length[last] + 1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = now
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[now] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return now

    def _clone(self, p: int, w: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q])), link.append(link[q]), length.append(length[p] + 1)
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = copy
            p = link[p]
        link[q] = copy
        return copy

    def statistics(self, sequence: list[int]) -> list[int]:
        """For each word, the length of the longest run that ends there and stands in a sequence added before."""
        nxt, link, length = self.next, self.link, self.length
        state = n = 0
        out = []
        for w in sequence:
            while state and w not in nxt[state]:
                state = link[state]
                n = length[state]
            if w in nxt[state]:
                state, n = nxt[state][w], n + 1
            else:
                state = n = 0
            out.append(n)
        return out


def covered(statistics: list[int], window: int) -> list[tuple[int, int]]:
    """Maximal spans of words inside a match of at least ``window`` words."""
    out: list[tuple[int, int]] = []
    for i, n in enumerate(statistics):
        if n >= window:
            a = i + 1 - n
            while out and out[-1][1] >= a:
                a = min(a, out.pop()[0])
            out.append((a, i + 1))
    return out


def cut_fragments(h: np.ndarray, edges: np.ndarray, window: int, k: int) -> tuple[np.ndarray, ...]:
    """The fragments of word sequences h[edges[i]:edges[i+1]]: sequence, anchor, hash, first word (in h) and words of each."""
    empty = np.zeros(0, dtype=np.int64)
    if h.size < window:
        return empty, empty.view(np.uint64), empty.view(np.uint64), empty, empty
    least = W.sliding_min(W.grams(h, k), window - k + 1)
    sequence = np.repeat(np.arange(edges.size - 1), np.diff(edges))[: least.size]
    valid = edges[1:][sequence] >= np.arange(least.size) + window
    new, ends = valid.copy(), valid.copy()
    new[1:] &= ~valid[:-1] | (least[1:] != least[:-1]) | (sequence[1:] != sequence[:-1])
    ends[:-1] &= ~valid[1:] | (least[1:] != least[:-1]) | (sequence[1:] != sequence[:-1])
    first, last = np.flatnonzero(new), np.flatnonzero(ends)
    return sequence[first], least[first], W.Spans(h)(first, last + window), first, last + window - first


def _fragments(docs: DataFrame, window: int) -> DataFrame:
    """(id, anchor, fragment, at, n): the fragments of each text, as hashes, with their first word and their words."""
    k = min(ANCHOR, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "text"):
            cut = W.cut(batch.column(1), RULE)
            text, anchor, whole, first, n = cut_fragments(cut.hash, cut.first, window, k)
            if first.size:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(text)), pa.array(W.signed(anchor)), pa.array(W.signed(whole)), pa.array((first - cut.first[text]).astype(np.int32)), pa.array(n.astype(np.int32))],
                    names=["id", "anchor", "fragment", "at", "n"],
                )

    return docs.mapInArrow(run, "id long, anchor long, fragment long, at int, n int")


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` with an id in ``ids`` (and a few more), by a bitmap of bounded size: a join that follows moves few texts."""
    log2 = bits_for(ids.count())
    sent = docs.sparkSession.sparkContext.broadcast(bitmap(ids, bit_of("id", log2), log2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = has_bit(sent.value, batch.column(2).to_numpy().astype(np.uint64))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(mask)) for c in batch.columns[:2]], names=["id", "text"])

    return docs.where("id is not null").withColumn("bit", bit_of("id", log2)).mapInArrow(run, "id long, text string")


def _shard_words(docs: DataFrame, shards: DataFrame) -> DataFrame:
    """The words (hashes) of each fragment of ``shards`` (id, anchor, fragment, at, n, hot) from its document."""
    wanted = stored(shards.groupBy("id").agg(F.collect_list(F.struct("anchor", "at", "n", "hot")).alias("parts")), "wanted")
    rows = _only(docs, wanted.select("id")).join(wanted, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "text"):
            cut = W.cut(batch.column(1), RULE)
            ids, anchor, at, hot, lists = [], [], [], [], []
            for i, (id_, parts) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                h = cut.hash[cut.first[i] : cut.first[i + 1]]
                for p in parts:
                    if p["at"] + p["n"] <= h.size:
                        ids.append(id_), anchor.append(p["anchor"]), at.append(p["at"]), hot.append(p["hot"]), lists.append(W.signed(h[p["at"] : p["at"] + p["n"]]))
            if ids:
                edges = np.append(0, np.cumsum([x.size for x in lists])).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(anchor, pa.int64()), pa.array(at, pa.int32()), pa.array(hot, pa.bool_()), pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(lists)))],
                    names=["id", "anchor", "at", "hot", "words"],
                )

    return rows.mapInArrow(run, "id long, anchor long, at int, hot boolean, words array<long>")


_SPAN = "id long, at int, n int"


def _by_automata(shards: DataFrame, window: int) -> DataFrame:
    """Spans (id, at, n) that an earlier document of the shard has too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, automaton, waiting, owner = None, SuffixAutomaton(), [], None
        for batch in batches:
            ids, ats, ns = [], [], []
            for id_, a, at, row in zip(*(batch.column(c).to_pylist() for c in ("id", "anchor", "at")), batch.column("words"), strict=True):
                words = row.values.to_numpy().tolist()
                if a != anchor:
                    anchor, automaton, waiting, owner = a, SuffixAutomaton(), [], id_
                if id_ != owner:  # a document's own fragments don't cover each other
                    for x in waiting:
                        automaton.add(x)
                    waiting, owner = [], id_
                for low, high in covered(automaton.statistics(words), window):
                    ids.append(id_), ats.append(at + low), ns.append(high - low)
                waiting.append(words)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ats, pa.int32()), pa.array(ns, pa.int32())], names=["id", "at", "n"])

    return shards.repartition("anchor").sortWithinPartitions("anchor", "id", "at").select("id", "anchor", "at", "words").mapInArrow(run, _SPAN)


_ROW = "group long, id long, at int, lo int, hi int, run int, words array<long>"


def hold(h: np.ndarray, window: int, k: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a fragment's words, each place of its anchor (the hash of ``k`` words) that is the first in some windows, with the least and
    the largest number of words that these windows have before it."""
    place = np.flatnonzero(W.grams(h, k) == np.uint64(anchor))
    before = np.append(-1, place[:-1])
    hi = place - np.maximum(before + 1, 0)  # no window of these begins at or before the place before
    lo = np.maximum(0, place + window - h.size)
    hi = np.minimum(hi, window - k)
    good = lo <= hi
    return place[good], lo[good], hi[good]


def against_pivot(group: np.ndarray, lo: np.ndarray, hi: np.ndarray, words: np.ndarray, edges: np.ndarray, phi: np.ndarray, plo: np.ndarray, pwords: np.ndarray, pedges: np.ndarray, window: int, k: int) -> tuple[np.ndarray, ...]:
    """How many words before and after the anchor each row has in common with its pivot, and the keys of the rows that differ from
    it in the same next word on the left, and on the right."""
    need = window - k
    reach = np.arange(need)

    def side(words, at, n):  # noqa: ANN001
        inside = reach < n[:, None]
        return np.where(inside, words[np.clip(at, 0, words.size - 1)], 0), inside

    def common(x, y):  # noqa: ANN001
        same = (x[0] == y[0]) & x[1] & y[1]
        return np.where(same.all(axis=1), need, (~same).argmax(axis=1)) if need else np.zeros(len(group), dtype=np.int64)

    mid, pmid = (edges[:-1] + hi)[:, None], (pedges[:-1] + phi)[:, None]
    left, right = side(words, mid - 1 - reach, hi), side(words, mid + k + reach, need - lo)
    n_left = common(left, side(pwords, pmid - 1 - reach, phi))
    n_right = common(right, side(pwords, pmid + k + reach, need - plo))
    row, last = np.arange(group.size), max(0, need - 1)

    def key(x, n, salt):  # noqa: ANN001
        return W.mix(W.mix(group.view(np.uint64) + np.uint64(salt)) ^ W.mix(x[0][row, np.minimum(n, last)].view(np.uint64) + n.astype(np.uint64)))

    return n_left, n_right, key(left, n_left, 0x1F83D9AB), key(right, n_right, 0x5BE0CD19)


def _by_pivots(shards: DataFrame, window: int, levels: int) -> DataFrame:
    """The same for shards of any size, without a row for each window.

    A window is its anchor with l words before it and the rest after it.  In each group the row of the least document is the pivot.  A row
    that has L words before and R after the anchor in common with it is covered where l <= L and window - k - l <= R.  Each other
    window differs from the pivot on the left (l > L) or else on the right, and so does any copy of it: rows of equal L and equal next
    word make a group of the next level, and so on the right.  Contexts that no two documents share end there.
    Places of one content that overlap within a fragment are one row.  What is left after ``levels`` levels is cut into windows, which look up their least document by hash.
    """
    k = min(ANCHOR, window)
    need = window - k

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for id_, anchor, at, row in zip(*(batch.column(c).to_pylist() for c in ("id", "anchor", "at")), batch.column("words"), strict=True):
                h = row.values.to_numpy().view(np.uint64)
                place, lo, hi = hold(h, window, k, anchor % (1 << 64))
                # places of one content that overlap, as in a line that is repeated on and on, are one row: what covers one covers the run
                content = W.Spans(h)(place - hi, place + window - lo) ^ W.mix((lo * window + hi).astype(np.uint64))
                order = np.lexsort((place, content))
                new = np.ones(place.size, dtype=bool)
                new[1:] = (content[order][1:] != content[order][:-1]) | (np.diff(place[order]) > window)
                first = np.flatnonzero(new)
                run = (place[order[np.append(first[1:], place.size) - 1]] - place[order[first]]) if place.size else place
                first = order[first]
                place, lo, hi = place[first], lo[first], hi[first]
                for i in range(0, place.size, 4096):
                    p, low, high, on = place[i : i + 4096], lo[i : i + 4096], hi[i : i + 4096], run[i : i + 4096]
                    n = high + window - low
                    reach = np.append(0, np.cumsum(n))
                    inside = np.arange(reach[-1]) - np.repeat(reach[:-1], n) + np.repeat(p - high, n)
                    lists = pa.ListArray.from_arrays(pa.array(reach.astype(np.int32)), pa.array(W.signed(h[inside])))
                    same = lambda x, m=p.size: pa.array(np.full(m, x, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([same(anchor), same(id_), *[pa.array(x.astype(np.int32)) for x in (at + p - high, low, high, on)], lists], names=["group", "id", "at", "lo", "hi", "run", "words"])

    def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of n > 0 are spans (id, at, n), the others are rows of the next level."""
        for batch in batches:
            if not batch.num_rows:
                continue
            get = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
            lists, plists = batch.column("words"), batch.column("pwords")
            words, pwords = lists.flatten().to_numpy(), plists.flatten().to_numpy()
            edges, pedges = (x.offsets.to_numpy().astype(np.int64) - x.offsets[0].as_py() for x in (lists, plists))
            group, id_, at = get("group"), get("id"), get("at").astype(np.int64)
            lo, hi, run, plo, phi = (get(c).astype(np.int64) for c in ("lo", "hi", "run", "plo", "phi"))
            left, right, left_key, right_key = against_pivot(group, lo, hi, words, edges, phi, plo, pwords, pedges, window, k)
            low, high = np.maximum(lo, need - right), np.minimum(hi, left)
            hit = np.flatnonzero(low <= high)
            out = [(np.zeros(hit.size, dtype=np.int64), id_[hit], (at + hi - high)[hit], lo[hit], hi[hit], run[hit], (high - low + window + run)[hit], edges[hit], edges[hit])]
            for rows, l0, h0, key in (
                (np.flatnonzero(np.maximum(left + 1, lo) <= hi), np.maximum(left + 1, lo), hi, left_key),
                (np.flatnonzero(lo <= np.minimum(np.minimum(left, hi), need - right - 1)), lo, np.minimum(np.minimum(left, hi), need - right - 1), right_key),
            ):
                start = (edges[:-1] + hi - h0)[rows]
                out.append((W.signed(key)[rows], id_[rows], (at + hi - h0)[rows], l0[rows], h0[rows], run[rows], np.zeros(rows.size, dtype=np.int64), start, start + (h0 - l0 + window)[rows]))
            group, id_, at, lo, hi, run, n, first, last = (np.concatenate(x) for x in zip(*out, strict=True))
            length = last - first
            reach = np.append(0, np.cumsum(length))
            inside = np.arange(reach[-1]) - np.repeat(reach[:-1], length) + np.repeat(first, length)
            made = pa.ListArray.from_arrays(pa.array(reach.astype(np.int32)), pa.array(words[inside]))
            yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(id_), *[pa.array(x.astype(np.int32)) for x in (at, lo, hi, run, n)], made], names=["group", "id", "at", "lo", "hi", "run", "n", "words"])

    def windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("words")
            h, edges = lists.flatten().to_numpy().view(np.uint64), lists.offsets.to_numpy().astype(np.int64)
            edges -= edges[0]
            n = np.diff(edges) - window + 1
            row = np.repeat(np.arange(n.size), n)
            inside = np.arange(row.size) - np.repeat(np.cumsum(n) - n, n)
            start = edges[row] + inside
            at = batch.column("at").to_numpy()[row] + inside
            n = batch.column("run").to_numpy()[row] + window
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row)), *[pa.array(x.astype(np.int32)) for x in (at, n)], pa.array(W.signed(W.Spans(h)(start, start + window)))], names=["id", "at", "n", "window"])

    rows = stored(shards.select("id", "anchor", "at", "words").mapInArrow(begin, _ROW), "rows")
    spans = rows.where("false").select("id", "at", F.lit(0).alias("n"))
    for _ in range(levels):
        pivots = rows.groupBy("group").agg(F.min(F.struct("id", "at", "lo", "hi", "words")).alias("p"), F.max("id").alias("most")).where("p.id < most")
        pivots = pivots.select("group", F.col("p.id").alias("pid"), F.col("p.lo").alias("plo"), F.col("p.hi").alias("phi"), F.col("p.words").alias("pwords"))
        both = rows.join(pivots, "group").where("id > pid").select("group", "id", "at", "lo", "hi", "run", "words", "plo", "phi", "pwords")
        made = stored(both.mapInArrow(level, "group long, id long, at int, lo int, hi int, run int, n int, words array<long>"), "level")
        spans = spans.unionAll(made.where("n > 0").select("id", "at", "n"))
        rows = made.where("n = 0").drop("n")
        if rows.isEmpty():
            return spans
    windows = stored(rows.select("id", "at", "run", "words").repartition("id", "at").mapInArrow(windows_of, "id long, at int, n int, window long"), "windows")
    first = windows.groupBy("window").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most")
    return spans.unionAll(windows.join(first, "window").where("id > least").select("id", "at", "n"))


def repeated_spans(docs: DataFrame, window: int = 50, shard_words: int = 6000, levels: int = 8) -> DataFrame:
    """(id, spans): the spans array<struct<at:int,n:int>> of words of each document (id, text) that a document of smaller id has too.

    Shards of up to ``shard_words`` words get an automaton, which has at most twice as many states; those of more go by pivots."""
    found = stored(_fragments(docs.where("id is not null"), window), "fragments")
    shared = found.groupBy("anchor").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("anchor")
    found = stored(found.join(shared, "anchor"), "shared")

    distinct = stored(found.groupBy("anchor", "fragment").agg(F.min(F.struct("id", "at", "n")).alias("least"), F.count("*").alias("copies")), "distinct")
    whole = found.join(distinct.where("copies > 1").select("anchor", "fragment", F.col("least.id").alias("least")), ["anchor", "fragment"]).where("id > least").select("id", "at", "n")

    many = distinct.groupBy("anchor").agg(F.count("*").alias("fragments"), F.sum("least.n").alias("total")).where("fragments > 1")
    shards = distinct.join(many, "anchor").select("least.id", "anchor", "least.at", "least.n", (F.col("total") > shard_words).alias("hot"))
    words = stored(_shard_words(docs, shards), "shards")
    spans = whole.unionAll(_by_automata(words.where("not hot"), window)).unionAll(_by_pivots(words.where("hot"), window, levels))
    return spans.groupBy("id").agg(F.collect_set(F.struct("at", "n")).alias("spans"))


def remove_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text: str = "text", shard_words: int = 6000, levels: int = 8) -> DataFrame:
    """(id, n_words, n_removed, text) of each row of ``docs``: what is left of a text, its words joined by one space.

    Words are runs of anything but ASCII white space, unchanged, of whole texts.  A word goes if it is in ``window`` consecutive
    words of its document that also start in a document with a smaller id; all judged on the input.  Null texts have no words and
    give ''.  Documents under ``window`` words lose nothing.  Rows without id lose nothing; rows with one id are one document: they
    don't cover each other, and all lose the same words, the spans found in any of them.
    """
    rows = long_rows(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    spans = stored(repeated_spans(rows, window, shard_words, levels), "spans")
    log2 = bits_for(spans.count())
    sent = docs.sparkSession.sparkContext.broadcast(bitmap(spans, bit_of("id", log2), log2))

    def finished(ids: pa.Array, texts: pa.Array, spans: list) -> pa.RecordBatch:
        n, removed, left = [], [], []
        for t, gone_spans in zip(texts.cast(pa.binary()), spans, strict=True):
            words = (t.as_py() or b"").split()
            n.append(len(words))
            if gone_spans:
                gone = np.zeros(len(words) + 1, dtype=np.int64)
                for s in gone_spans:
                    if s["at"] < len(words):
                        gone[s["at"]] += 1
                        gone[min(len(words), s["at"] + s["n"])] -= 1
                stay = np.cumsum(gone)[:-1] == 0
                words = [words[i] for i in np.flatnonzero(stay)]
            removed.append(n[-1] - len(words)), left.append(b" ".join(words))
        return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(left, pa.binary()).cast(pa.string())], names=["id", "n_words", "n_removed", "text"])

    def touched(batch: pa.RecordBatch) -> np.ndarray:
        return has_bit(sent.value, batch.column(2).to_numpy().astype(np.uint64)) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)

    def maybe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = touched(batch)
            if mask.any():
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(mask)) for c in batch.columns[:2]], names=["id", "text"])

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(~touched(batch)))
            for part in W.slices([batch], "text"):
                yield finished(part.column(0), part.column(1), [None] * part.num_rows)

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices([batch], "text"):
                yield finished(part.column(0), part.column(1), part.column(2).to_pylist())

    schema = "id long, n_words long, n_removed long, text string"
    probe = rows.withColumn("bit", F.coalesce(bit_of("id", log2), F.lit(0)))
    some = probe.mapInArrow(maybe, "id long, text string").join(spans, "id", "left").select("id", "text", "spans")
    return probe.mapInArrow(untouched, schema).unionAll(some.mapInArrow(cut_out, schema))


def op7_substring_dedup(spark, sf_dir):
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, p, sha256(array_to_string(ws[p:p + 49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS p FROM d WHERE len(ws) >= 50)),
first AS (SELECT h, min(doc_id) AS least FROM w GROUP BY h),
gone AS (SELECT doc_id, q FROM (SELECT w.doc_id, unnest(range(w.p, w.p + 50)) AS q FROM w JOIN first USING (h) WHERE w.doc_id > first.least) GROUP BY ALL),
word AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS q FROM d),
kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.q) AS t, count(*) AS n FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.q = word.q WHERE gone.q IS NULL GROUP BY word.doc_id)
SELECT d.doc_id, len(d.ws) AS n_words, len(d.ws) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM d LEFT JOIN kept k USING (doc_id)
"""
