"""Versions, states as of a version or time, and audits against a replay in Python."""

import random

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import history as H

FIELDS = {"a": "bigint", "b": "string", "c": "double"}


def _replay(rows, full_every):
    out, state, number = [], {}, {}
    for key, t, *values in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        now = dict(zip(FIELDS, values, strict=True))
        changed = [f for f in FIELDS if key not in state or state[key][f] != now[f]]
        if changed:
            number[key] = number.get(key, 0) + 1
            full = (number[key] - 1) % full_every == 0
            out.append((key, number[key], t, full, {f: now[f] for f in FIELDS if full or f in changed}, changed, now))
        state[key] = now
    return out


@pytest.fixture
def many_parts(spark):
    """Small ranges, so that the hot key spans several tasks."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("full_every", [1, 3, 100])
def test_versions_of_a_hot_key_over_tasks(spark, many_parts, full_every):
    rng = random.Random(full_every)
    rows = [(1 if i % 3 else rng.choice([2, 3, 4, None]), i, rng.choice([1, 2, None]), rng.choice(["x", "y"]), rng.choice([0.5, None])) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, t long, a long, b string, c double").repartition(3)
    log = H.version_log(df, "k", ["t"], list(FIELDS), full_every)
    kinds = lambda f: F.try_variant_get(F.col("changes")[f], "$", FIELDS[f]).alias(f)
    got = log.select("k", "version_number", "at.t", "is_full", F.map_keys("changes").alias("names"), *[kinds(f) for f in FIELDS], "changed_fields").collect()
    want = _replay(rows, full_every)
    assert H._dealt(df, "k", ["t"], list(FIELDS)).where("key = 1").select("part").distinct().count() > 1
    assert sorted([(r["k"], r["version_number"], r["t"], r["is_full"], {f: r[f] for f in r["names"]}, r["changed_fields"]) for r in got], key=str) == sorted([w[:6] for w in want], key=str)

    ask = [(k, v) for k in (1, 2, 3, 9) for v in (0, 1, 2, 7, 50, 1000)]
    state = H.state_as_of(log, spark.createDataFrame([*ask, *ask], "k long, as_of long"), "k", FIELDS).collect()
    expected = []
    for k, v in ask:
        upto = [w for w in want if w[0] == k and w[1] <= v]
        if upto:
            expected.append((k, v, upto[-1][1], *upto[-1][6].values()))
    assert sorted(map(tuple, state), key=str) == sorted(expected, key=str)
    at = H.state_as_of(log, spark.createDataFrame([(1, 200)], "k long, as_of long"), "k", FIELDS, by="t").first()
    last = [w for w in want if w[0] == 1 and w[2] <= 200][-1]
    assert tuple(at) == (1, 200, last[1], *last[6].values())


def test_repeated_states_and_none(spark):
    df = spark.createDataFrame([(1, 1, 5, "x", None), (1, 1, 5, "x", None), (1, 2, 5, "x", None)], "k long, t long, a long, b string, c double")
    assert H.version_log(df, "k", ["t"], list(FIELDS)).count() == 1
    assert H.version_log(df.where("false"), "k", ["t"], list(FIELDS)).count() == 0


def test_audit_shows_what_changed_with_both_states(spark):
    old = spark.createDataFrame([(1, 5, "x", 0.5), (2, 6, "y", None), (3, 7, "z", 1.0)], "k long, a long, b string, c double")
    new = spark.createDataFrame([(1, 5, "x", 0.5), (2, None, "y", 2.0), (4, 8, "w", None)], "k long, a long, b string, c double")
    text = lambda c: H.as_text(F.col(c), list(FIELDS)).alias(c)
    got = H.audit_log(old, new, "k", list(FIELDS)).select("k", "action", "changed_fields", text("before"), text("after")).orderBy("k").collect()
    assert [tuple(r) for r in got] == [(2, "updated", ["a", "c"], "a=6,c=null", "a=null,c=2.0"), (3, "deleted", ["a", "b", "c"], "a=7,b=z,c=1.0", ""), (4, "created", ["a", "b", "c"], "", "a=8,b=w,c=null")]


def test_versions_take_one_window_where_no_key_is_hot(spark, monkeypatch):
    """Keys that a task can hold are neither dealt by ranges nor stored, and a log is read once for the states as of a version."""
    kept, put = [], H.stored
    monkeypatch.setattr(H, "stored", lambda df, name: kept.append(name) or put(df, name))
    rng = random.Random(7)
    rows = [(k, t, rng.choice([1, 2, None]), rng.choice(["x", "y"]), None) for k in range(100) for t in range(12)]
    log = H.version_log(spark.createDataFrame(rows, "k long, t long, a long, b string, c double"), "k", ["t"], list(FIELDS), 3)
    assert kept == ["hot"] and log._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 2
    want = _replay(rows, 3)
    assert sorted((r["k"], r["version_number"], r["t"], r["is_full"], r["changed_fields"]) for r in log.select("*", "at.t").collect()) == sorted((*w[:4], w[5]) for w in want)
    got = H.state_as_of(log, spark.createDataFrame([(k, 5) for k in range(100)], "k long, as_of long"), "k", FIELDS)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 2
    last = {w[0]: w for w in want if w[1] <= 5}
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(k, 5, w[1], *w[6].values()) for k, w in last.items()], key=str)
