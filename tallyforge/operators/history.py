"""Versions of keyed rows: field-level changes as variants, full states now and then, and the state as of any version or time.

Versions are made in one window by key, and read by key again without a shuffle between.  States of a key with more than one in ``SHARE``
of all rows are dealt by ranges of (key, order) instead, so that a key with a third of all rows is many tasks; what a task can't see, the
state before its first row and the number of versions before it, comes from a small table of the keys that span tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import stored


#: A key with more than one in so many rows is dealt over tasks; there are fewer such keys than this.
SHARE = 64


def _over() -> WindowSpec:
    """Over a row for each range and spanning key."""
    return Window.partitionBy("key").orderBy("part")


def _hot_keys(states: DataFrame, key: str) -> DataFrame | None:
    """(hot), a row a key with more than one in ``SHARE`` of all rows; None where there is none."""
    counts = states.groupBy(F.col(key).alias("hot")).count()
    hot = stored(counts.where(F.col("count") * SHARE > states.count()).select("hot"), "hot")
    return None if hot.isEmpty() else hot


def _dealt(states: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """(key, at, state, part), stored: rows in ranges of (key, at), ``part`` the number of the range."""
    rows = states.select(F.col(key).alias("key"), F.struct(*order).alias("at"), F.struct(*fields).alias("state"))
    return stored(rows.repartitionByRange("key", "at", F.xxhash64("state")).withColumn("part", F.spark_partition_id()), "states")


def _spanning(rows: DataFrame, *what: Column) -> DataFrame:
    """(key, part, ...) of the keys that stand in more than one range; such rows are fewer than twice the ranges."""
    ends = rows.groupBy("key").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a < b").select("key")
    return rows.join(ends, "key", "left_semi").groupBy("key", "part").agg(*what)


def with_previous(rows: DataFrame) -> DataFrame:
    """Stored rows (key, at, state, part), as dealt by ranges of (key, at), with ``before``, the key's state before each; null for the first.

    Within a range it is a window; the first row of a range gets the last state of the key's range before it.
    """
    w = Window.partitionBy("part", "key").orderBy("at", F.xxhash64("state"))
    last = _spanning(rows, F.max_by("state", F.struct("at", F.xxhash64("state").alias("h"))).alias("last"))
    carried = last.select(F.col("key").alias("k"), F.col("part").alias("p"), F.lag("last").over(_over()).alias("carried")).where("carried is not null")
    seen = rows.withColumn("before", F.lag("state").over(w)).withColumn("n", F.row_number().over(w))
    seen = seen.join(F.broadcast(carried), F.col("key").eqNullSafe(F.col("k")) & (F.col("part") == F.col("p")) & (F.col("n") == 1), "left")
    return seen.select(*rows.columns, F.coalesce("before", "carried").alias("before"))


def version_log(states: DataFrame, key: str, order: list[str], fields: list[str], full_every: int = 10) -> DataFrame:
    """(key, version_number, at, is_full, changes, changed_fields): a version for each state that differs from the one before it.

    ``changes`` is a map of variants: all fields of the first version and of every ``full_every``-th after it, else those that
    changed.  ``changed_fields`` names the latter in order, all of them in the first version.  ``at``: the ``order`` columns.
    States in the same order are taken in the order of a hash; repeated ones change nothing.  A null is a value like any other.
    """
    hot = _hot_keys(states, key)
    if hot is None:
        return _numbered(states, key, order, fields, full_every)
    is_hot = F.col(key).eqNullSafe(F.col("hot"))
    few, many = (states.join(F.broadcast(hot), is_hot, how) for how in ("left_anti", "left_semi"))
    return _numbered(few, key, order, fields, full_every).unionByName(_numbered_over_ranges(many, key, order, fields, full_every))


def _changed(seen: DataFrame, fields: list[str]) -> DataFrame:
    """Rows (state, was) that differ, with ``changed_fields``."""
    differs = lambda f: ~F.col(f"state.{f}").eqNullSafe(F.col(f"was.{f}"))
    names = F.filter(F.array(*[F.when(F.col("was").isNull() | differs(f), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    return seen.withColumn("changed_fields", names).where(F.size("changed_fields") > 0)


def _versions(kept: DataFrame, number: Column, key: str, fields: list[str], full_every: int) -> DataFrame:
    full = (number - 1) % full_every == 0
    entry = lambda f: F.when(full | F.array_contains("changed_fields", f), F.struct(F.lit(f).alias("key"), F.col(f"state.{f}").cast(T.VariantType()).alias("value")))
    changes = F.map_from_entries(F.filter(F.array(*[entry(f) for f in fields]), lambda x: x.isNotNull()))
    return kept.select(F.col("key").alias(key), number.alias("version_number"), "at", full.alias("is_full"), changes.alias("changes"), "changed_fields")


def _numbered(states: DataFrame, key: str, order: list[str], fields: list[str], full_every: int) -> DataFrame:
    """The versions of keys of which a task holds all rows: one shuffle and one sort."""
    rows = states.select(F.col(key).alias("key"), F.struct(*order).alias("at"), F.struct(*fields).alias("state"))
    w = Window.partitionBy("key").orderBy("at", F.xxhash64("state"))
    kept = _changed(rows.withColumn("was", F.lag("state").over(w)), fields).withColumn("n", F.row_number().over(w).cast("long"))
    return _versions(kept, F.col("n"), key, fields, full_every)


def _numbered_over_ranges(states: DataFrame, key: str, order: list[str], fields: list[str], full_every: int) -> DataFrame:
    """The versions of keys that span tasks."""
    w = Window.partitionBy("part", "key").orderBy("at", F.xxhash64("state"))
    seen = with_previous(_dealt(states, key, order, fields)).withColumnRenamed("before", "was")
    kept = stored(_changed(seen, fields).select("key", "at", "state", "part", "changed_fields"), "changes")
    counts = _spanning(kept, F.count("*").alias("c"))
    sums = counts.select(F.col("key").alias("k"), F.col("part").alias("p"), F.sum("c").over(_over().rowsBetween(Window.unboundedPreceding, -1)).alias("held"))
    out = kept.withColumn("n", F.row_number().over(w)).join(F.broadcast(sums), F.col("key").eqNullSafe(F.col("k")) & (F.col("part") == F.col("p")), "left")
    return _versions(out, (F.col("n") + F.coalesce("held", F.lit(0))).cast("long"), key, fields, full_every)


def state_as_of(log: DataFrame, wanted: DataFrame, key: str, fields: dict[str, str], by: str = "version_number") -> DataFrame:
    """The state of each row of ``wanted`` (key, as_of): that of the key's last version whose ``by`` is ``as_of`` or less.

    ``by``: version_number, or a field of ``at``.  ``fields``: their types.  Of each field the last change counts, by an aggregate, so
    that a long chain is never gathered; a full state overrules all before it, so the log is read once.  Keys without such a full
    version are left out.  Each (key, as_of) counts once.
    """
    place = F.col("version_number") if by == "version_number" else F.col(f"at.{by}")
    held = log.select(F.col(key).alias("_key"), place.alias("_place"), "version_number", "is_full", "changes")
    asked = wanted.select(F.col(key).alias("_asked"), F.col("as_of").alias("_as_of")).distinct()
    upto = held.join(asked, (F.col("_key") == F.col("_asked")) & (F.col("_place") <= F.col("_as_of")))
    newest = [F.max_by(F.struct(F.try_variant_get(F.col("changes")[f], "$", kind).alias("v")), F.when(F.map_contains_key("changes", f), F.col("version_number"))).alias(f"_{i}") for i, (f, kind) in enumerate(fields.items())]
    out = upto.groupBy("_key", "_as_of").agg(F.max("version_number").alias("version_number"), F.max("is_full").alias("_full"), *newest).where("_full")
    return out.select(F.col("_key").alias(key), F.col("_as_of").alias("as_of"), "version_number", *[F.col(f"_{i}.v").alias(f) for i, f in enumerate(fields)])


def audit_log(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, action, changed_fields, before, after) of created, updated and deleted rows: the states are maps of variants with the fields
    that changed, and null where there is no row.  Each key stands once on either side."""
    pick = lambda df, name: df.select(F.col(key).alias("key"), F.struct(*fields).alias(name))
    both = pick(old, "o").join(pick(new, "n"), "key", "full_outer")
    differs = lambda f: F.col("o").isNull() | F.col("n").isNull() | ~F.col(f"o.{f}").eqNullSafe(F.col(f"n.{f}"))
    both = both.withColumn("changed_fields", F.filter(F.array(*[F.when(differs(f), F.lit(f)) for f in fields]), lambda x: x.isNotNull())).where(F.size("changed_fields") > 0)

    def state(side: str) -> Column:
        entries = F.array(*[F.when(differs(f), F.struct(F.lit(f).alias("key"), F.col(f"{side}.{f}").cast(T.VariantType()).alias("value"))) for f in fields])
        return F.when(F.col(side).isNotNull(), F.map_from_entries(F.filter(entries, lambda x: x.isNotNull())))

    action = F.when(F.col("o").isNull(), "created").when(F.col("n").isNull(), "deleted").otherwise("updated")
    return both.select(F.col("key").alias(key), action.alias("action"), "changed_fields", state("o").alias("before"), state("n").alias("after"))


def as_text(states: Column, fields: list[str]) -> Column:
    """A map of variants as ``field=value`` by commas, fields in the given order; null values as ``null``."""
    one = lambda f: F.when(F.map_contains_key(states, f), F.concat(F.lit(f"{f}="), F.coalesce(F.try_variant_get(states[f], "$", "string"), F.lit("null"))))
    return F.concat_ws(",", *[one(f) for f in fields])
