"""Names and paths in long tables against all pairs."""

import random
import time

import pytest

from tallyforge.operators import lookup as K
from tallyforge.operators import match as M

NAMES = "place long, name string, brand string, code string"


def _brute(raw, names):
    """(score, place) of the best name by the rule, over all of them."""
    own, best = set(K.name_tokens(raw)), (0.0, None)
    for place, name in names:
        other = set(K.name_tokens(name))
        score = len(own & other) / len(own | other) if own | other else 0.0
        if name.lower() in raw.lower() or raw.lower() in name.lower():
            score = max(score, 0.8)
        if best[1] is None or score > best[0]:
            best = (score, place)
    return best


@pytest.mark.parametrize("block", [1 << 23, 300])
def test_names_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(K, "BLOCK_BYTES", block)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)] + ["Tools", "Co", "Ünï", "3m"]
    names = [(i, " ".join(rng.choices(words, k=rng.randint(1, 4)))) for i in range(120)] + [(200, "W1"), (201, "ab")]
    raws = [" ".join(rng.choices(words, k=rng.randint(1, 5))) for _ in range(150)] + ["cab driver", "b", "Co (X1)", "zzz", "ünï tools", "w", ""]
    table = spark.createDataFrame([(p, n, f"b{p}", f"c{p}") for p, n in names], NAMES)
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(raws)] + [(998, None), (999, "-- Unbranded --")], "id long, raw string")
    got = {r["id"]: r for r in K.match_names(rows, "raw", table).collect()}
    assert len(got) == len(raws) + 2 and got[998]["manufacturer"] == got[999]["manufacturer"] == "Unknown Manufacturer"
    for i, raw in enumerate(raws):
        if raw:
            score, place = _brute(raw.removesuffix(" (X1)"), names)
            want = (dict(names)[place], f"b{place}", f"c{place}", round(score, 2)) if score >= 0.3 else (raw, raw, "UNKNOWN", 0.1)
            assert tuple(got[i])[2:] == want, raw


def test_a_list_of_100_000_names(spark):
    rng = random.Random(4)
    names = [(i, f"{rng.choice('abcdefgh')}{rng.randrange(40_000)} {rng.choice(['tools', 'works', 'inc'])} {rng.randrange(500)}") for i in range(100_000)]
    raws = [names[rng.randrange(100_000)][1].replace(" ", "  ").upper() for _ in range(20)] + [f"{names[7][1].split()[0]} tools", "inc", "some tools inc", "qqq"]
    table = spark.createDataFrame([(p, n, n, "c") for p, n in names], NAMES)
    start = time.time()
    got = {r["raw"]: r for r in K.match_names(spark.createDataFrame([(r,) for r in raws], "raw string"), "raw", table).collect()}
    assert time.time() - start < 60
    by_place = dict(names)
    for raw in raws:
        score, place = _brute(raw, names)
        assert got[raw]["manufacturer"] == (by_place[place] if score >= 0.3 else raw) and got[raw]["mfr_confidence"] == (round(score, 2) if score >= 0.3 else 0.1)


def test_the_short_lists_give_what_the_expressions_give(spark):
    from tallyforge.functions import lookups as L

    raws = spark.createDataFrame([(x,) for n in L.MANUFACTURERS for x in (n[0], n[0].upper() + " (AB1)", n[0].split()[0], n[0][2:], n[1])] + [(None,), ("nothing",)], "raw string")
    table = spark.createDataFrame([(i, *n) for i, n in enumerate(L.MANUFACTURERS)], NAMES)
    assert sorted(map(str, K.match_names(raws, "raw", table).collect())) == sorted(map(str, M.match_manufacturers(raws, "raw").collect()))
    paths = spark.createDataFrame(list(enumerate(L.CLASS_PATHS)), "place long, path string")
    raws = spark.createDataFrame([(x,) for p in L.CLASS_PATHS for x in (p, p.lower() + ">x", " " + p.upper(), p.split(">")[0] + ">a>b")] + [(None,), ("",), ("q",)], "raw string")
    assert sorted(map(str, K.match_paths(raws, "raw", paths).collect())) == sorted(map(str, M.match_class_paths(raws, "raw").collect()))
    assert K.match_paths(raws.where("false"), "raw", paths).count() == 0
