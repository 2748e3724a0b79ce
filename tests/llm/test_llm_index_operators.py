"""Exact dedup, hard negatives and tokenizer alignment against brute force, with their edge cases."""

import collections
import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyforge.llm import alignment as A
from tallyforge.llm import exactdedup as X
from tallyforge.llm import hardnegatives as H

SMALL = "/root/testdata/sf0.001"

# ---- exact dedup


def _random_digests(n, seed):
    return np.random.default_rng(seed).integers(0, 256, (n, 32), dtype=np.uint8)


def test_filter_takes_and_gives_back_digests():
    held, other = _random_digests(900, 1), _random_digests(5000, 2)
    f = X.built(held, 4)
    assert f.log2 >= 8 and f.has(held).all() and f.has(other).mean() < 0.01
    f.delete(held[:400])
    assert f.has(held[400:]).all() and f.has(held[:400]).mean() < 0.05
    assert f.insert(held[:400]) and f.has(held).all()
    f.delete(held)
    assert not f.tags.any()


def test_filter_says_when_it_overflows_and_equal_tags_share_its_buckets():
    assert not X.CuckooFilter(2).insert(_random_digests(17, 3))
    same = np.repeat(_random_digests(1, 4), 8, axis=0)
    f = X.CuckooFilter(6)
    assert f.insert(same) and (f.tags > 0).sum() == 8
    f.delete(same[:3])
    assert (f.tags > 0).sum() == 5 and f.has(same).all()
    with pytest.raises(ValueError):
        f.delete(_random_digests(1, 9))


def _groups(rows):
    groups = collections.defaultdict(list)
    for at, (i, t) in enumerate(rows):
        groups["".join(c for c in t or "" if c not in X.SPACES)].append((-len(t or ""), i is None, i or 0, at))
    out = []
    for text, group in groups.items():
        best = min(group)
        for g in group:
            out.append((rows[g[3]][0], rows[best[3]][0], len(group), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = [(1, "a b"), (2, "ab"), (3, "a  b"), (4, "a\tb "), (4, "a\tb "), (5, ""), (6, None), (7, " \n"), (None, "x"), (9, "x"), (9, "x"), (10, "x "), (11, "A b"), (12, "é" * 70_000), (13, "é" * 70_000 + " ")]


def test_groups_of_equal_texts_in_any_number_of_loads(spark):
    docs = spark.createDataFrame(ROWS * 2 + [(i, f"t{i % 40}") for i in range(100, 400)], "doc_id long, text string").selectExpr("doc_id", "text", "1 AS digest", "2 AS id", "3 AS shard")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for loads in (1, 3):
        got = X.deduplicate(docs, loads=loads, digests_a_shard=10).collect()
        assert sorted([(r["id"], r["keep_id"], r["group_size"], r["digest"].hex()) for r in got], key=str) == _groups(rows)
        assert sum(r["kept"] for r in got) == len({r["digest"] for r in got})
        assert all(r["id"] == r["keep_id"] for r in got if r["kept"])


def test_no_rows(spark):
    assert X.deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_index_inserts_deletes_and_grows_from_its_keys(spark):
    table = lambda rows: X.digested(spark.createDataFrame(rows, "doc_id long, text string"))
    index = X.CuckooIndex(spark, shards=3, log2=2)
    known = lambda out: {r["digest"].hex(): r["known"] for r in out.collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert not any(known(index.insert(table([(i, f"t{i}") for i in range(100)]))).values())
    assert index.last["rebuilt"] == 3  # 48 slots for 100 digests
    second = known(index.insert(table([(200, "t 5"), (201, "t5"), (202, "new")])))
    assert second == {sha("t5"): True, sha("new"): False} and index.last["asked"] == 2
    index.delete(spark.createDataFrame([(5,), (200,), (7,), (None,), (7,), (999,)], "id long"))
    third = known(index.insert(table([(300, "t5"), (301, "t7"), (302, "t8")])))
    assert third == {sha("t5"): True, sha("t7"): False, sha("t8"): True}
    index.delete(spark.createDataFrame([(i,) for i in range(1000)], "id long"))
    assert index.groups().count() == 0 and index.keys[0].count() == 0
    assert all(not any(r["tags"]) for r in index.filters.collect())
    assert known(index.insert(table([(1, "t5")]))) == {sha("t5"): False}


# ---- hard negatives


def _mined(vectors, anchors, positives=5, negatives=10, least=30, most=90):
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: E731, B905
    for a, label, q in anchors:
        scored = sorted((-dot(q, v), i, lab) for i, lab, v in vectors if i != a)
        for p, i, _ in [s for s in scored if s[2] == label][:positives]:
            fits = [s for s in scored if s[2] != label and least * -p <= 100 * -s[0] <= most * -p][:negatives]
            out += [(a, i, r, n, -p, -s) for r, (s, n, _) in enumerate(fits, 1)]
    return sorted(out)


def _vectors(n, dims, spread, labels, seed):
    rng = random.Random(seed)
    return [(i, rng.randrange(labels), [rng.randint(-spread, spread) for _ in range(dims)]) for i in range(n)]


@pytest.mark.parametrize(("n", "dims", "spread", "labels", "block"), [(900, 3, 2, 3, 1 << 20), (700, 5, 40, 2, 500), (300, 1, 1, 4, 1 << 20)])
def test_negatives_against_brute_force(spark, monkeypatch, n, dims, spread, labels, block):
    """Many ties, several leaves and levels, several blocks of anchors; a hot vector in the last third."""
    monkeypatch.setattr(H, "LEAF", 16)
    monkeypatch.setattr(H, "FAN", 3)
    monkeypatch.setattr(H, "TREE", 64)
    rows = _vectors(n, dims, spread, labels, n)
    rows = rows[: n * 2 // 3] + [(i, lab, [1] * dims) for i, lab, _ in rows[n * 2 // 3 :]]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id long, label int, v array<int>, rank string")
    got = H.mine_hard_negatives(df, df.where("id % 20 = 0"), block_bytes=block)
    assert sorted(map(tuple, got.collect())) == _mined(rows, [r for r in rows if r[0] % 20 == 0])


def test_boxes_prune_where_vectors_cluster():
    rng = np.random.default_rng(0)
    v = np.concatenate([rng.integers(-3, 3, (200, 4)) + c for c in rng.integers(-500, 500, (20, 4))])
    leaves = H.str_order(v, [0, 1])
    assert sorted(np.concatenate(leaves).tolist()) == list(range(len(v))) and max(x.size for x in leaves) <= H.LEAF
    tree = H.Tree(np.array([v[x].min(0) for x in leaves], dtype=float), np.array([v[x].max(0) for x in leaves], dtype=float))
    q, seen = v[5].astype(float), []

    def leaf(n):
        seen.append(n)
        return v[leaves[n]] @ q, leaves[n], leaves[n]

    below, above = tree.bounds(q[None])
    best = H.Best(5, -np.inf, np.inf)
    H.search(tree, above[0], below[0], [best], leaf)
    assert [(-s, i) for s, i, _ in best.found] == sorted(((int(v[i] @ q), i) for i in range(len(v))), key=lambda x: (-x[0], x[1]))[:5]
    assert len(seen) < len(leaves) / 3


def test_edge_cases_of_vectors(spark):
    nan, inf = math.nan, math.inf
    raw = [(0, 1, [1.0, 0.5]), (1, 1, [0.9, 0.5]), (1, 1, [0.9, 0.5]), (2, 2, [0.5, 0.2]), (2, 2, [0.5, 0.2]), (3, 2, [0.4]), (4, 2, []), (5, None, [1.0, 1.0]), (6, 2, None), (7, 2, [nan, 0.0]), (8, 2, [inf, 0.0]), (9, 2, [None, 0.1]), (None, 2, [0.5, 0.5]), (100, 3, [0.0, 0.0]), (0, 4, [0.1, 0.1])]
    df = spark.createDataFrame(raw, "id long, label int, x array<float>").select("id", "label", H.whole_numbers("x").alias("v"))
    whole = [(r["id"], r["label"], list(r["v"])) for r in df.collect() if None not in (r["id"], r["label"], r["v"])]
    assert len(whole) == 9
    got = H.mine_hard_negatives(df, df.where("id % 100 = 0"))
    anchors = [(0, 1, [256, 128]), (100, 3, [0, 0])]
    assert sorted(map(tuple, got.collect())) == _mined(whole, anchors)
    none = df.where("false")
    assert H.mine_hard_negatives(none, none).count() == 0 and H.mine_hard_negatives(df, none).count() == 0 and H.mine_hard_negatives(none, df).count() == 0
    with pytest.raises(Exception, match="times 256"):
        spark.createDataFrame([([1e6],)], "x array<double>").select(H.whole_numbers("x")).collect()


def test_large_components_stay_exact(spark):
    top = (1 << 26) - 2
    rows = [(i, i % 2, [top - i, -(top - 3 * i), top, i]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, label int, v array<int>")
    assert sorted(map(tuple, H.mine_hard_negatives(df, df, least=0, most=100).collect())) == _mined(rows, rows, least=0, most=100)


# ---- tokenizer alignment


@pytest.fixture(scope="module")
def pair(spark):
    return A.load_pair(spark, f"{A.TOKENIZERS}/byte_bpe_50k.json", f"{A.TOKENIZERS}/piece_bpe_32k.model")


@pytest.fixture(scope="module")
def encoder(pair):
    return A.Encoder(pair)


def _aligned(encoder, text):
    """(a ids, b ids, groups, links) from whole texts, by sets of offsets; None where bytes differ."""
    if not text:
        return None
    ids = encoder.a.encode(" " + text, add_special_tokens=False).ids, encoder.b.encode(text)
    tokens = [[table[i].as_py() for i in x] for table, x in zip((encoder.table_a, encoder.table_b), ids, strict=True)]
    if any(b"".join(t) != (" " + text).encode() for t in tokens):
        return None
    ends = [np.cumsum([len(t) for t in x]).tolist() for x in tokens]
    groups, done = [], [0, 0]
    for c in sorted(set(ends[0]) & set(ends[1])):
        now = [e.index(c) + 1 for e in ends]
        groups.append(tuple(x[i:j] for x, i, j in zip(ids, done, now, strict=True)))
        done = now
    links = collections.Counter()
    spans = [list(zip([0, *e], e)) for e in ends]  # noqa: B905
    for (s, e), a in zip(spans[0], ids[0], strict=True):
        for (s2, e2), b in zip(spans[1], ids[1], strict=True):
            if s < e2 and s2 < e:
                links[a, b] += 1
    return (*ids, groups, links)


PARTS = ["a", "the", "  ", " ", "\n", "\t", "é", "日本", "\x1c", "▁", "ﬁ", "'s", "don't", "123", "!!", "<|endoftext|>", "<s>", "<0x41>", "😀", "　", "\x00", "\u0085", " ", "zz", " foo", " bar", "x́"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS) | st.text(max_size=3), max_size=12).map("".join), min_size=1, max_size=6))
def test_slices_against_whole_texts(encoder, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    x = A.align_slice(encoder, texts)
    digests = A.GroupText(len(encoder.table_a), len(encoder.table_b)).digests(x) if len(texts) % 3 == 0 else None
    at_a = at_b = 0
    for i, t in enumerate(texts):
        want = _aligned(encoder, t)
        n_a, n_b = int(x.n_a[i]), int(x.n_b[i])
        here = x.link_text == i
        if want is None:
            assert n_a == n_b == here.sum() == 0
        else:
            assert x.a[at_a : at_a + n_a].tolist() == want[0] and x.b[at_b : at_b + n_b].tolist() == want[1]
            assert x.cut_a[at_a : at_a + n_a].sum() == x.cut_b[at_b : at_b + n_b].sum() == len(want[2])
            assert collections.Counter(zip(x.link_a[here].tolist(), x.link_b[here].tolist(), strict=True)) == want[3]
        if digests:
            text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in want[2]) if want else None
            assert digests[i] == (hashlib.sha256(text.encode()).hexdigest() if want else "")
        at_a, at_b = at_a + n_a, at_b + n_b


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 2000), max_size=120), st.sets(st.integers(0, 2000), max_size=300))
def test_galloping_finds_ranks(short, long):
    a, b = np.array(sorted(short), dtype=np.int64), np.array(sorted(long), dtype=np.int64)
    assert A.gallop(a, b).tolist() == np.searchsorted(b, a).tolist()


def _expected(encoder, rows):
    all_ = [(i, _aligned(encoder, t)) for i, t in rows]
    held = collections.Counter(p for _, x in all_ if x for p in x[3])
    most = collections.defaultdict(int)
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    out = []
    for i, x in all_:
        if x is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in x[2])
        out.append((i, len(x[0]), len(x[1]), len(x[2]), sum(x[3].values()), sum(n for p, n in x[3].items() if held[p] == most[p[0]]), sum(n * held[p] for p, n in x[3].items()), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


TEXTS = [(1, "Hello world, hello tokenizers"), (2, "Hello world, hello tokenizers"), (3, None), (4, ""), (5, "a▁b"), (5, "plain"), (None, "no id here"), (7, "<|endoftext|> and <s> stay text"), (8, " lead"), (9, "x " * 9000 + "\n\n" + "y" * 3000)]


def test_alignment_with_pairs_sent_and_joined(spark, pair, encoder):
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in TEXTS], "doc_id long, text string, row int, pairs int")
    linked = A.stored(A.linked_pairs(docs, pair), "linked")
    counts = A.pair_counts(linked)
    columns = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    for most in (1 << 20, 3, 0):
        got = [tuple(r[c] for c in columns) for r in A.score_links(linked, counts, most_sent=most).collect()]
        assert sorted(got, key=str) == _expected(encoder, TEXTS)
    assert A.score_links(A.linked_pairs(docs.where("false"), pair), counts.where("false")).count() == 0


def test_groups_as_lists(spark, pair, encoder):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    got = {r["id"]: r for r in A.token_groups(docs, pair).collect() if r["id"] not in (None, 5)}
    for i, t in TEXTS:
        if i in got:
            want = _aligned(encoder, t)
            r = got[i]
            groups = [(r["a_ids"][a0:a1], r["b_ids"][b0:b1]) for a0, a1, b0, b1 in zip([0, *r["a_ends"]], r["a_ends"], [0, *r["b_ends"]], r["b_ends"])]  # noqa: B905
            assert groups == (want[2] if want else [])


def test_alignment_query_against_brute_force(spark, encoder):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = A.op13_cross_tokenizer_alignment(spark, SMALL)
    assert sorted(map(tuple, got.collect()), key=str) == _expected(encoder, [(r["doc_id"], r["text"]) for r in docs])
