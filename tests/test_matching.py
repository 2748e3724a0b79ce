"""Duplicates of a catalog and the cascade with vectors, on small tables by brute force."""

import itertools
import random

import pytest

from tallyforge.operators import match as K
from tallyforge.operators import vectors as X
from tallyforge.plans.q_more import Q

FIELDS = "product_id long, sku string, model string, brand string, product_name string"


def _level(a, b):
    same = lambda c: a[c] is not None and a[c] == b[c]
    apart = lambda c: a[c] is not None and b[c] is not None and a[c] != b[c]
    if not same(3):
        return None
    return 1 if same(1) else 2 if same(2) and not apart(1) else 3 if same(4) and not apart(1) and not apart(2) else None


def _expected(rows):
    root, links = {r[0]: r[0] for r in rows}, {r[0]: [] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(rows, 2):
        if level := _level(a, b):
            links[a[0]].append(level), links[b[0]].append(level)
            x, y = sorted((find(a[0]), find(b[0])))
            root[y] = x
    name = {1: ("exact_sku_brand", 1.0), 2: ("model_brand", 0.95), 3: ("name_brand", 0.9), None: ("none", 0.0)}
    return sorted((i, find(i), len(levels), *name[min(levels, default=None)]) for i, levels in links.items())


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_duplicates_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    few = lambda s, n: rng.choice([None, *[f"{s}{i}" for i in range(n)]])
    rows = [(i, few("s", 30), few("m", 25), rng.choice(["b", "b", "b", "c", None]), few("n", 15 if seed % 2 else 60)) for i in range(150)]
    got = K.duplicate_candidates(spark.createDataFrame([(*r, "x") for r in rows], FIELDS + ", id string"))
    assert sorted(map(tuple, got.collect())) == _expected(rows)


def test_a_hot_key_makes_no_pairs(spark):
    """4000 rows of one name and brand, 8 million pairs, give rows in proportion."""
    rows = [(i, None, None, "b", "n") for i in range(4000)] + [(4000, "s", "m", "c", "n")]
    out = K.duplicate_candidates(spark.createDataFrame(rows, FIELDS))
    got = {r["product_id"]: r for r in out.collect()}
    assert len(got) == 4001 and got[7]["n_links"] == 3999 and got[7]["group_id"] == 0 and (got[4000]["group_id"], got[4000]["method"]) == (4000, "none")
    assert K.duplicate_candidates(spark.createDataFrame([], FIELDS)).count() == 0


def test_duplicates_and_vectors_on_larger_tables(same):
    for name in ("duplicate_candidates", "entity_resolve_vectors"):
        same(*Q[name], "/root/testdata/sf0.01")


def test_open_rows_alone_get_vector_candidates(spark):
    catalog = spark.createDataFrame([(1, "A-1", "m1", "b", "one"), (2, "A 1", "m2", "b", "two"), (3, "C", "m3", "b", "three"), (4, "D", "m4", "x", "four")], FIELDS)
    incoming = catalog.sparkSession.createDataFrame([(11, "a1", None, "B", "z"), (12, "zz", None, "b", "z"), (13, None, None, "q", "z"), (14, "D9", None, "x", "z")], FIELDS.replace("product_id", "incoming_id"))
    v = {1: [1.0, 0.0], 2: [0.0, 1.0], 3: [0.8, 0.6], 4: [-1.0, 0.0]}
    index = X.build_index(spark.createDataFrame([(k, x, None) for k, x in v.items()], "vec_id long, embedding array<float>, label int"), lists=2)
    asked = spark.createDataFrame([(11, v[1]), (12, v[3]), (13, v[3]), (14, v[4])], "incoming_id long, embedding array<float>")
    got = {r["incoming_id"]: r for r in K.resolve_with_vectors(incoming, catalog, asked, index).collect()}
    assert (got[11]["match_id"], got[11]["method"], got[11]["n_equal"], got[11]["review"], got[11]["candidates"]) == (1, "exact_sku_brand", 2, True, [])
    assert (got[12]["method"], got[12]["confidence"], got[12]["candidates"]) == ("none", 1.0, [])  # all hits are of its brand with another sku
    assert got[13]["method"] == "vector_candidates" and got[13]["review"] and [c["product_id"] for c in got[13]["candidates"]] == [3, 1]
    assert (got[14]["method"], got[14]["confidence"]) == ("none", 1.0)


def test_keys_are_matched_without_the_driver(spark):
    """No side is broadcast, small as it may look."""
    from tallyforge.operators.match import resolve_entities

    rows = spark.createDataFrame([(1, "A-1", "m", "b", "n"), (2, None, "m", "b", "n"), (3, None, None, "c", "n")], "product_id long, sku string, model string, brand string, product_name string")
    got = resolve_entities(rows.selectExpr("product_id + 10 AS incoming_id", "sku", "model", "brand", "product_name"), rows)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == [(11, 1, "exact_sku_brand", 1.0), (12, 1, "model_brand", 0.95), (13, 3, "name_brand", 0.9)]
