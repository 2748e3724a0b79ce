"""N-gram Jaccard join by vertical partitioning.

All n-grams stand in one global order: those that look frequent in a sample of documents come last, and within either part
the order is that of a 64-bit hash.  Which n-grams count as frequent only moves work; it can't change the result.  Documents meet
in their first n-grams of that order.  For candidate pairs the order is cut into fragments, the overlap is counted in each
fragment on its own, and the counts are summed per pair, so no whole sets are compared.

Only components are asked for, so links are looked for in steps, each linear in the rows of the table of first n-grams:

1. each set is held against one partner, the likeliest of the centres of its n-grams;
2. rounds over n-grams of many sets, as in Boruvka's algorithm: each set outside its n-gram's largest component proposes its nearest
   set of another component, until a round adds few links or none;
3. all pairs that share a first n-gram and are still in different components are refuted by exact bounds, or else counted.

No link is lost in step 3.  If A and B link, their symmetric difference d is at most (|A| + |B|) / 7.  So they share one of their first
n/4 + 1 n-grams, all of which are given; the first one they share stands so early in both that what follows can hold the overlap;
they share as many of these first n-grams as what follows leaves open; and their parity sketches (each n-gram flips one of 512
bits) differ in at most d bits.  Pairs that fail a bound never leave the task that has their group in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .components import components
from .shared import bit_of, bitmap, bits_for, discard, has_bit, long_rows, stored

RULE, FRAGMENTS, SALTS = "spaced_lower", 8, 16
#: One document in 16 is looked at for frequent n-grams; in three of those an n-gram is frequent.
SAMPLE, FREQUENT_IN = 16, 3
#: 64-bit words of a parity sketch; rows of an n-gram that are compared at once; rows of one that are compared with the others' at
#: once; rows that are sent to all tasks at most.
SKETCH, BLOCK, LAGS, SMALL = 8, 4096, 16, 100_000
#: A round of fewer pairs is the last: the step after it counts what is left.
FEW = 1000


def shingle_sets(cut: W.Words, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text; of fewer than k words, the whole sequence; without words none."""
    g, spans = W.grams(cut.hash, k), None
    for a, b in zip(cut.first[:-1].tolist(), cut.first[1:].tolist(), strict=True):
        if b - a >= k:
            t = np.sort(g[a : b - k + 1])
            yield t if t.size < 2 else t[np.append(True, t[1:] != t[:-1])]
        elif b > a:
            spans = spans or W.Spans(cut.hash)
            yield spans(np.array([a]), np.array([b]))
        else:
            yield g[:0]


def _set_id(t: np.ndarray) -> int:
    """A hash of a set of shingles."""
    return int(W.signed(W.mix(np.array([W.mix(t ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(t.size)], dtype=np.uint64)))[0])


def parity_sketch(t: np.ndarray) -> np.ndarray:
    """64 * SKETCH bits, each the parity of the shingles that fall on it: two sketches differ in no more bits than their sets do in shingles."""
    odd = np.bincount((t & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def _sampled_shingles(docs: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "text"):
            sets = list(shingle_sets(W.cut(batch.column(1), RULE), k))
            yield pa.RecordBatch.from_arrays([pa.array(W.signed(np.concatenate(sets)))], names=["gram"])

    return docs.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0).mapInArrow(run, "gram long")


def _sketches(docs: DataFrame, k: int, often: DataFrame) -> DataFrame:
    """(id, set, n, n_rare, sketch, grams): of each row its set, the set's sketch and its first n/4 + 1 shingles in the global order."""
    log2 = bits_for(often.count())
    sent = docs.sparkSession.sparkContext.broadcast(bitmap(often, F.shiftrightunsigned("gram", 64 - log2), log2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for batch in W.slices(batches, "text"):
            ids, n, rare_n, sketches, grams, at = [], [], [], [], [], [0]
            for t in shingle_sets(W.cut(batch.column(1), RULE), k):
                frequent = has_bit(bits, t >> np.uint64(64 - log2))
                n_rare, prefix = t.size - int(frequent.sum()), t.size // 4 + 1
                ids.append(_set_id(t) if t.size else None), n.append(t.size), rare_n.append(n_rare), sketches.append(parity_sketch(t))
                grams += [t[~frequent][:prefix], t[frequent][: max(0, prefix - n_rare)]]
                at.append(at[-1] + sum(x.size for x in grams[-2:]))
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(W.signed(np.concatenate(grams))))
            wide = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * SKETCH), pa.array(W.signed(np.concatenate(sketches))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(rare_n, pa.int64()), wide, lists], names=["id", "set", "n", "n_rare", "sketch", "grams"])

    return docs.mapInArrow(run, "id long, set long, n long, n_rare long, sketch array<long>, grams array<long>")


SIDE = ("r", "set", "n", "pos")
PAIR = [c + x for x in "ab" for c in SIDE]


def _meet(firsts: DataFrame) -> DataFrame:
    """Of each (n-gram, salt) of two sets or more, its centre as side a with every set as side b, the centre too; of frequent n-grams also
    where a salt has one set only.

    The centre is the set with the fewest rare n-grams: among copies with edits, the one that is closest to what they share.

    A streaming pass over sorted rows that holds one row besides the batch, whatever the size of a group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, alone = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if last is not None:
                cols = [np.append(x, y) for x, y in zip(last, cols, strict=True)]
            gram, salt = cols[:2]
            new = np.ones(gram.size, dtype=bool)
            new[1:] = (gram[1:] != gram[:-1]) | (salt[1:] != salt[:-1])
            begin = np.maximum.accumulate(np.where(new, np.arange(gram.size), 0))
            # a centre of a rare n-gram meets itself once a second set of its group comes
            again = np.append(~new[1:], False) & new & (salt < 0) | new & (salt >= 0)
            if last is not None and (salt[0] >= 0 or not alone):
                again[0] = False
            i = np.sort(np.concatenate([np.flatnonzero(~new), np.flatnonzero(again)]))
            c = begin[i]
            head = begin[-1]
            alone = bool(new[-1])
            last = [x[head : head + 1].copy() for x in cols]
            yield pa.RecordBatch.from_arrays([pa.array(gram[i]), pa.array(salt[i] >= 0), *[pa.array(x[c]) for x in cols[2:]], *[pa.array(x[i]) for x in cols[2:]]], names=["gram", "often", *PAIR])

    return (
        firsts.select("gram", "salt", *SIDE).repartition("gram", "salt").sortWithinPartitions("gram", "salt", "r", "set")
        .mapInArrow(run, "gram long, often boolean, ra int, seta long, na int, posa int, rb int, setb long, nb int, posb int")
    )


def _may_link() -> Column:
    """Sizes and places that let two sets of one n-gram link, if it is the first that they share."""
    left = F.least(F.col("na") - F.col("posa"), F.col("nb") - F.col("posb"))
    return (4 * F.least("na", "nb") >= 3 * F.greatest("na", "nb")) & (7 * left >= 3 * (F.col("na") + F.col("nb")))


def _plausible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b, na, nb) that their sketches don't refute."""
    side = lambda x: sets.select(F.col("set").alias(x), F.col("sketch").alias("s" + x))
    apart = F.expr("aggregate(zip_with(sa, sb, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)")
    return pairs.join(side("a"), "a").join(side("b"), "b").where(7 * apart <= F.col("na") + F.col("nb")).select("a", "b", "na", "nb")


class Rows(NamedTuple):
    """Rows of whole n-gram groups, one after the other."""

    group: np.ndarray
    set: np.ndarray
    n: np.ndarray
    pos: np.ndarray
    root: np.ndarray
    part: np.ndarray  # the block that a row is of
    two: np.ndarray  # whether only rows of different blocks are compared
    main: np.ndarray  # the largest component of the group
    sketch: np.ndarray


def unrefuted(r: Rows, lags: int = LAGS, rows: int = 64) -> Iterator[tuple[np.ndarray, ...]]:
    """Pairs (i, j) of rows of one group in different components that sizes and sketches don't refute, with whether the places let
    them link here, and by how far they miss the bound.  Small groups are compared all together, row by row at each distance up to ``lags``."""

    def judged(i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        ni, nj = r.n[i], r.n[j]
        may = (r.root[i] != r.root[j]) & (4 * np.minimum(ni, nj) >= 3 * np.maximum(ni, nj)) & ~(r.two[i] & (r.part[i] == r.part[j]))
        i, j = i[may], j[may]
        for at in range(0, i.size, 1 << 16):
            p, q = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            slack = r.n[p] + r.n[q] - 7 * np.bitwise_count(r.sketch[p] ^ r.sketch[q]).sum(axis=1, dtype=np.int64)
            keep = slack >= 0
            p, q, slack = p[keep], q[keep], slack[keep]
            if p.size:
                yield p, q, 7 * np.minimum(r.n[p] - r.pos[p], r.n[q] - r.pos[q]) >= 3 * (r.n[p] + r.n[q]), slack

    size = np.bincount(r.group)
    small = size[r.group] <= lags
    for lag in range(1, min(lags, r.group.size)):
        i = np.flatnonzero(small[:-lag] & (r.group[lag:] == r.group[:-lag]))
        if not i.size:
            break
        yield from judged(i, i + lag)
    begin = np.cumsum(size) - size
    for g in np.flatnonzero(size > lags).tolist():
        own = np.arange(begin[g], begin[g] + size[g])
        in_main = r.root[own] == r.main[own[0]]
        own = np.concatenate([own[~in_main], own[in_main]])  # pairs within the main component don't come up at all
        outside = own.size - int(in_main.sum())
        for first in range(0, outside, rows):
            x, y = own[first : min(outside, first + rows)], own[first + 1 :]
            i, j = np.nonzero(np.arange(y.size)[None, :] >= np.arange(x.size)[:, None])  # each pair once
            yield from judged(x[i], y[j])


def _apart(shared: DataFrame, sets: DataFrame, roots: DataFrame, nearest: bool) -> DataFrame:
    """Pairs of sets that share an n-gram of ``shared`` (gram, set, n, pos, blocks), are in different components, and are not refuted by sketches.

    ``nearest``: (set, na, other, nb, slack), for each n-gram and set outside its main component the nearest one.  Else (a, b, na, nb, fits),
    a row for each n-gram that a pair shares, and whether it may be the first of a link.

    Groups of more than BLOCK rows are cut into blocks, and each two blocks meet in a task of their own.
    """
    with_root = sets.select("set", "sketch").join(roots.select(F.col("node").alias("set"), "root"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    now = shared.withColumn("part", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int")).join(with_root, "set").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    now = now.select("gram", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "set", "n", "pos", "root", "part", "sketch")

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[Rows]:
        held: list[np.ndarray] = []

        def rows(cols: list[np.ndarray], new: np.ndarray) -> Rows:
            _, low, high, set_, n, pos, root, part, sketch = cols
            group = np.cumsum(new) - 1
            # the largest component of each group: the longest run of rows in the order of group and component
            order = np.lexsort((root, group))
            start = np.flatnonzero(np.append(True, (group[order][1:] != group[order][:-1]) | (root[order][1:] != root[order][:-1])))
            length, run = np.diff(np.append(start, root.size)), order[start]
            main = np.zeros(int(group[-1]) + 1, dtype=np.int64)
            by_length = np.argsort(length, kind="stable")
            main[group[run[by_length]]] = root[run[by_length]]
            return Rows(group, set_, n.astype(np.int64), pos.astype(np.int64), root, part, low != high, main[group], sketch)

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:-1]] + [batch.column("sketch").flatten().to_numpy().view(np.uint64).reshape(-1, SKETCH)]
            cols = [np.concatenate([x, y]) for x, y in zip(held, cols, strict=True)] if held else cols
            new = np.append(True, (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1]))
            last = int(np.flatnonzero(new)[-1])  # its group may go on
            if last:
                yield rows([c[:last] for c in cols], new[:last])
            held = [c[last:].copy() for c in cols]
        if held:
            yield rows(held, np.append(True, np.zeros(held[0].size - 1, dtype=bool)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in groups(batches):
            best, whom = np.full(r.n.size, -1, dtype=np.int64), np.zeros(r.n.size, dtype=np.int64)
            for p, q, fits, slack in unrefuted(r):
                if nearest:
                    order = np.argsort(slack, kind="stable")
                    for x, y in ((p[order], q[order]), (q[order], p[order])):
                        top, who = np.full(r.n.size, -1, dtype=np.int64), np.zeros(r.n.size, dtype=np.int64)
                        top[x], who[x] = slack[order], y  # the last counts, which is the nearest
                        better = top > best
                        best[better], whom[better] = top[better], who[better]
                else:
                    a, b = np.where(r.set[p] < r.set[q], p, q), np.where(r.set[p] < r.set[q], q, p)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (r.set[a], r.set[b], r.n[a].astype(np.int32), r.n[b].astype(np.int32), fits)], names=["a", "b", "na", "nb", "fits"])
            x = np.flatnonzero((best >= 0) & (r.root != r.main))
            if x.size:
                y = whom[x]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (r.set[x], r.set[y], r.n[x].astype(np.int32), r.n[y].astype(np.int32), best[x])], names=["set", "other", "na", "nb", "slack"])

    keys = ("gram", "low", "high")
    schema = "set long, other long, na int, nb int, slack long" if nearest else "a long, b long, na int, nb int, fits boolean"
    return now.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _verified(docs: DataFrame, sets: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose overlap, counted by fragment and summed, makes them link; stored."""
    needed = pairs.select(F.col("a").alias("set")).unionAll(pairs.select(F.col("b").alias("set"))).distinct()
    owners = stored(sets.join(needed, "set", "left_semi").select(F.col("rep").alias("id")), "owners")
    n_owners = owners.count()
    shift = np.uint64(64 - FRAGMENTS.bit_length() + 1)
    log2 = bits_for(n_owners)
    sent = None if n_owners <= SMALL else docs.sparkSession.sparkContext.broadcast(bitmap(owners, bit_of("id", log2), log2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if sent is not None:
                batch = batch.filter(pa.array(has_bit(sent.value, batch.column(2).to_numpy().astype(np.uint64))))
            for part in W.slices([batch], "text"):
                set_, fragment, grams, at = [], [], [], [0]
                for t in shingle_sets(W.cut(part.column(1), RULE), k):
                    if t.size:
                        own = _set_id(t)
                        edges = np.searchsorted(t >> shift, np.arange(FRAGMENTS + 1, dtype=np.uint64))
                        for f in range(FRAGMENTS):
                            if edges[f + 1] > edges[f]:
                                set_.append(own), fragment.append(f), grams.append(t[edges[f] : edges[f + 1]]), at.append(at[-1] + int(edges[f + 1] - edges[f]))
                if grams:
                    lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(W.signed(np.concatenate(grams))))
                    yield pa.RecordBatch.from_arrays([pa.array(set_, pa.int64()), pa.array(fragment, pa.int32()), lists], names=["set", "fragment", "grams"])

    probe = docs.where("id is not null")
    if sent is None:  # a few ids go to all tasks; more of them as bits
        probe = probe.join(F.broadcast(owners), "id", "left_semi")
    else:
        probe = probe.withColumn("bit", bit_of("id", log2))
    cut = probe.mapInArrow(run, "set long, fragment int, grams array<long>").join(needed, "set", "left_semi")
    cut = stored(cut.groupBy("set", "fragment").agg(F.first("grams").alias("grams")), "fragments")
    by_fragment = pairs.select("a", "b", "na", "nb", F.explode(F.expr(f"sequence(0, {FRAGMENTS - 1})")).alias("fragment"))
    left = cut.select(F.col("set").alias("a"), "fragment", F.col("grams").alias("ga"))
    right = cut.select(F.col("set").alias("b"), "fragment", F.col("grams").alias("gb"))
    partial = by_fragment.join(left, ["a", "fragment"]).join(right, ["b", "fragment"]).select("a", "b", "na", "nb", F.size(F.array_intersect("ga", "gb")).cast("long").alias("part"))
    both = F.sum("part")
    linked = partial.groupBy("a", "b", "na", "nb").agg(both.alias("overlap")).where(100 * F.col("overlap") >= percent * (F.col("na") + F.col("nb") - F.col("overlap")))
    links = stored(linked.select("a", "b"), "links")
    discard(cut, owners)
    return links


def _ordered(a: str, b: str) -> list[Column]:
    """Columns a, b, na, nb of a pair with the lesser set first."""
    swap = F.col(a) > F.col(b)
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.when(swap, F.col("nb")).otherwise(F.col("na")).alias("na"), F.when(swap, F.col("na")).otherwise(F.col("nb")).alias("nb")]


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 5, percent: int = 75, max_rounds: int = 8, counts: list[int] | None = None) -> DataFrame:
    """(id, n_shingles, component_id) of each row of ``docs``: the least id of those reachable by links.

    A-Z are lowered, words are runs of anything but ASCII white space, of whole texts.  A document's set is its distinct shingles of
    ``k`` words, or its whole sequence of words if it has fewer.  Two link when 100 * intersection >= ``percent`` * union, for
    ``percent`` of 75 or more.  Null and empty texts, and texts of white space, have an empty set and link with nothing.  Rows with
    equal sets, repeated ones too, are one node.  Rows without id take no part and have no component.  Ids are integers.

    Equal sets become one node before anything is compared.  Up to ``max_rounds`` rounds look for the nearest set of another component;
    fewer rounds only leave more pairs to the last step, as does a round of few pairs, which is the last.  ``counts``, if given, receives the number of pairs counted in each step.
    """
    if not 75 <= percent <= 100:
        raise ValueError("percent must be 75 to 100")  # the bounds above are those of 75
    rows = long_rows(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    often = stored(_sampled_shingles(rows, k).groupBy("gram").count().where(F.col("count") >= FREQUENT_IN).select("gram"), "often")
    sketches = stored(_sketches(rows, k, often), "sketches")
    owned = stored(sketches.select("id", "set", F.col("n").alias("n_shingles")), "owned")

    first = lambda *cols: [F.first(c).alias(c) for c in cols]
    firsts = stored(sketches.where("set is not null and id is not null").groupBy("set").agg(F.min("id").alias("rep"), *first("n", "n_rare", "sketch", "grams")), "firsts")
    sets = stored(firsts.select("set", "rep", "sketch"), "sets")
    discard(often, sketches)
    prefixes, firsts = firsts, firsts.select("set", "n", "n_rare", F.posexplode("grams").alias("pos", "gram"))
    salt = F.when(F.col("pos") >= F.col("n_rare"), F.pmod(F.xxhash64("set"), F.lit(SALTS)).cast("int")).otherwise(-1)
    firsts = firsts.select("gram", salt.alias("salt"), "set", F.col("n").cast("int").alias("n"), F.col("n_rare").cast("int").alias("r"), "pos")
    met = stored(_meet(firsts), "met")
    discard(prefixes)

    # 1: of each set the centre that it meets most often; frequent n-grams have one centre for all salts
    frequent = met.where("often").select("gram", *[F.col(c + "b") for c in SIDE])
    head = frequent.groupBy("gram").agg(F.min(F.struct(*[F.col(c + "b").alias(c + "a") for c in SIDE])).alias("h"))
    near = met.where("not often").select(*PAIR).unionAll(frequent.join(head, "gram").select(*[F.col(f"h.{c}a") for c in SIDE], *[c + "b" for c in SIDE]))
    near = near.where("seta <> setb").where(_may_link()).groupBy("seta", "na", "setb", "nb").agg(F.count("*").alias("shared"))
    near = near.groupBy("setb", "nb").agg(F.max_by(F.struct("seta", "na"), F.struct("shared", "seta")).alias("c")).select("setb", "nb", "c.*")
    tested = stored(_plausible(near.select(*_ordered("seta", "setb")).distinct(), sets), "pairs")
    links = _verified(rows, sets, tested, k, percent)
    roots = components(links)
    if counts is not None:
        counts.append(tested.count())

    # what shares a first n-gram with a set of another component
    members = met.select("gram", F.col("setb").alias("set"), F.col("nb").alias("n"), F.col("posb").alias("pos")).join(roots.withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    several = members.groupBy("gram").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("size")).where("x < y").select("gram", "size", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    shared = stored(members.join(several, "gram").select("gram", "set", "n", "pos", "size", "blocks"), "shared")
    discard(met)

    # 2: rounds of nearest sets
    for _ in range(max_rounds):
        nearest = _apart(shared.where(F.col("size") > LAGS), sets, roots, True)
        nearest = nearest.groupBy("set", "na").agg(F.max_by(F.struct("other", "nb"), F.struct("slack", "other")).alias("c")).select("set", "na", "c.*")
        new = stored(nearest.select(*_ordered("set", "other")).distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
        n_new = new.count()
        if counts is not None:
            counts.append(n_new)
        if not n_new:
            break
        found = _verified(rows, sets, new, k, percent)
        tested, links = tested.unionAll(new), links.unionAll(found)
        if found.isEmpty():
            break
        roots = components(links)
        if n_new < FEW:
            break

    # 3: all that is left in different components
    rest = _apart(shared, sets, roots, False).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("common"), F.max("fits").alias("fits"))
    after = F.greatest(F.col("na") - F.floor(F.col("na") / 4) - 1, F.col("nb") - F.floor(F.col("nb") / 4) - 1)
    rest = rest.where(F.col("fits") & (7 * (F.col("common") + after) >= 3 * (F.col("na") + F.col("nb")))).select("a", "b", "na", "nb")
    rest = stored(rest.join(tested.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
    n_rest = rest.count()
    if counts is not None:
        counts.append(n_rest)
    if n_rest:
        roots = components(links.unionAll(_verified(rows, sets, rest, k, percent)))
    discard(shared)

    named = roots.join(sets.select(F.col("set").alias("node"), "rep"), "node")
    least = named.groupBy("root").agg(F.min("rep").alias("least"))
    of_set = sets.select("set", "rep").join(roots.join(least, "root").select(F.col("node").alias("set"), "least"), "set", "left").select("set", F.coalesce("least", "rep").alias("component_id"))
    out = owned.join(of_set, "set", "left")
    return out.select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))


def op9_ngram_jaccard_join(spark, sf_dir):
    out = jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[p:p + least(len(ws), 5) - 1], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS p FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
overlap AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (
  SELECT a, b FROM overlap JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT reach.doc_id, edge.b FROM reach JOIN edge ON edge.a = reach.r)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) m USING (doc_id)
"""
