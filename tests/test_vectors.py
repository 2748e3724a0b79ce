"""The vector index against brute force: exact where all lists are looked at, and with a measured recall where not."""

import numpy as np
import pytest

from tallyforge.operators import vectors as X


def _frame(spark, v, labels=None, name="vec_id"):
    rows = [(i, [float(c) for c in x], None if labels is None else labels[i]) for i, x in enumerate(v)]
    return spark.createDataFrame(rows, f"{name} long, embedding array<float>, label int")


def _brute(v, q, k, labels=None, wanted=None, threshold=-2.0):
    v, q = (X.unit(np.asarray(x, dtype=np.float32).astype(float)) for x in (v, q))
    out = []
    for i, x in enumerate(q):
        s = np.round(v @ x, 6)
        fits = [j for j in range(len(v)) if s[j] >= threshold and (wanted is None or wanted[i] is None or wanted[i] == labels[j])]
        out += [(i, j, s[j], r) for r, j in enumerate(sorted(fits, key=lambda j: (-s[j], j))[:k], 1)]
    return out


def _rows(df):
    return sorted((r["query_id"], r["vec_id"], round(r["score"], 6), r["rank"]) for r in df.collect())


@pytest.mark.parametrize(("rows", "queries"), [(4096, 2048), (50, 30)])
def test_all_lists_are_exact_with_a_hot_vector(spark, monkeypatch, rows, queries):
    """A third of all rows and of all queries are one vector; small blocks cut its list."""
    monkeypatch.setattr(X, "ROWS", rows)
    monkeypatch.setattr(X, "QUERIES", queries)
    rng = np.random.default_rng(1)
    v, labels = rng.normal(size=(600, 8)), [int(x) for x in rng.integers(0, 3, 600)]
    v[400:] = v[0]
    wanted = [labels[i] if i % 2 else None for i in range(600)]
    q = _frame(spark, v, wanted, "query_id")
    index = X.build_index(_frame(spark, v, labels), lists=12)
    assert index.lists.count() == 600 and index.lists.groupBy("list", "block").count().agg({"count": "max"}).first()[0] <= 2 * rows
    want = _brute(v, v, 5, labels, wanted)
    assert _rows(X.search(index, q, 5)) == sorted((a, b, round(float(s), 6), r) for a, b, s, r in want)
    near = X.search(index, q, 5, threshold=0.7)
    assert _rows(near) == sorted((a, b, round(float(s), 6), r) for a, b, s, r in _brute(v, v, 5, labels, wanted, 0.7))


def test_few_lists_find_most_neighbours_of_clustered_vectors(spark):
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.normal(scale=0.15, size=(60, 16)) + c for c in rng.normal(size=(40, 16))])
    index = X.build_index(_frame(spark, v))
    q = _frame(spark, v, name="query_id")
    probes = X.probes_for(index, q, 10, target=0.95)
    assert probes <= len(index.centroids) / 4
    assert X.recall(X.search(index, q, 10, probes), X.search(index, q, 10)) >= 0.9


def test_recall_on_the_embeddings(spark):
    """Random directions, the worst case: the query asks for as many lists as 0.95 on a sample takes."""
    from tallyforge.plans.q_more import _all_as_queries

    v, q = _all_as_queries(spark, "/root/testdata/sf0.1")
    index = X.build_index(v)
    probes = X.probes_for(index, q)
    assert probes < len(index.centroids)
    assert X.recall(X.search(index, q, 10, probes), X.search(index, q, 10)) >= 0.9


def test_edge_cases(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [1.0], 2), (3, None, 1), (4, [float("nan"), 1.0], 1), (5, [None, 1.0], None), (6, [0.0, 0.0], 1)]
    v = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, list string")
    q = spark.createDataFrame([(1, [1.0, 0.0], None), (2, [0.0, 2.0], 1), (3, None, None)], "query_id long, embedding array<float>, label int")
    got = _rows(X.search(X.build_index(v, lists=3), q, 2))
    assert got == sorted([(1, 1, 1.0, 1), (1, 2, 1.0, 2), (2, 4, 1.0, 1), (2, 1, 0.0, 2), (3, 1, 0.0, 1), (3, 2, 0.0, 2)])
    none = v.where("false")
    assert X.search(X.build_index(none), q, 2).count() == 0 and X.search(X.build_index(v), q.where("false"), 2).count() == 0


def test_topk_meets_in_blocks_and_is_exact(spark):
    import numpy as np

    from tallyforge.operators.match import vector_topk

    x = np.random.default_rng(1).normal(size=(300, 8))
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    q = v.where("vec_id % 50 = 0").selectExpr("vec_id AS query_id", "embedding", "if(vec_id % 100 = 0, label, null) AS label")
    got = vector_topk(v, q, 4)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    for i in range(0, 300, 50):
        s = np.round(u @ u[i], 6)
        ids = [j for j in np.lexsort((np.arange(300), -s)) if i % 100 or j % 3 == i % 3][:4]
        assert [r["vec_id"] for r in sorted(got.where(f"query_id = {i}").collect(), key=lambda r: r["rank"])] == ids


def test_exact_neighbours_send_a_query_once_a_block(spark, monkeypatch):
    from tallyforge.operators import vectors as X
    from tallyforge.plans.queries import QUERIES

    made, build = [], X.build_index
    monkeypatch.setattr(X, "build_index", lambda *a, **k: made.append(build(*a, **k)) or made[-1])
    QUERIES["vector_neighbors_exact"](spark, "/root/testdata/sf0.001")
    assert [len(i.centroids) for i in made] == [1]


@pytest.mark.parametrize("probes", [None, 6])
def test_a_query_is_sent_once_a_cell_and_a_vector_once_a_deal(spark, monkeypatch, probes):
    """64 lists and half of all vectors the same, cut over cells: what is sent doesn't grow with the lists."""
    monkeypatch.setattr(X, "ROWS", 16)
    monkeypatch.setattr(X, "QUERIES", 16)
    rng = np.random.default_rng(3)
    v, labels = rng.normal(size=(512, 8)), [int(x) for x in rng.integers(0, 3, 512)]
    v[256:] = v[0]
    wanted = [labels[i] if i % 2 else None for i in range(512)]
    q, index = _frame(spark, v, wanted, "query_id"), X.build_index(_frame(spark, v, labels), lists=64)
    cells = X._cells(index, 5)
    asked = X._asked(index, cells, q, probes or 64)
    assert len(cells.places) <= X.SHARES and asked.groupBy("query_id", "cell").count().where("count > 1").isEmpty() and asked.count() <= 512 * X.SHARES
    got = _rows(X.search(index, q, 5, probes))
    if probes is None:
        assert got == sorted((a, b, round(float(s), 6), r) for a, b, s, r in _brute(v, v, 5, labels, wanted))
    else:
        c = index.centroids
        mine, near = (X.unit(v.astype(np.float32).astype(float)) @ c.T).argmax(1), np.argsort(-(X.unit(v.astype(np.float32).astype(float)) @ c.T), axis=1)[:, :probes]
        every = _brute(v, v, 512, labels, wanted)
        seen, left = [], {i: 0 for i in range(512)}
        for a, b, s, _ in every:
            if mine[b] in near[a] and left[a] < 5:
                left[a] += 1
                seen.append((a, b, round(float(s), 6), left[a]))
        assert got == sorted(seen)
