"""Supplier part lists: flags, accuracy and compliance, delivery columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values as V


def record_flags(records: DataFrame, mobile: str, brand: str, class_confidence: str, completeness: str) -> DataFrame:
    """``records`` with ``flags`` and ``needs_review``: description length, blank brand, weak class path, incomplete."""
    m = F.col(mobile)
    flags = F.array(
        F.when((m != "") & ~F.length(m).between(45, 90), "mobile_description_length"),
        F.when(F.coalesce(F.trim(F.col(brand)), F.lit("")) == "", "blank_brand"),
        F.when(F.col(class_confidence) < 0.4, "weak_class_path"),
        F.when(F.col(completeness) < 75, "incomplete"),
    )
    out = records.withColumn("flags", F.filter(flags, lambda x: x.isNotNull()))
    return out.withColumn("needs_review", F.size("flags") > 0)


def accuracy_diff(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(key, column_name, match_status) for each field of the rows that both have, on trimmed values."""
    fields = [c for c in expected.columns if c != key and c in actual.columns]
    clean = lambda df: df.select(key, *[F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in fields])
    long = lambda df, v: clean(df).unpivot(key, fields, "column_name", v)
    e, a = F.col("expected"), F.col("actual")
    status = F.when((e == "") & (a == ""), "BLANK_MATCH").when(a == "", "MISSING").when(e == "", "EXTRA").when(e == a, "EXACT_MATCH").when(F.lower(e) == F.lower(a), "CASE_INSENSITIVE_MATCH").otherwise("VALUE_MISMATCH")
    return long(expected, "expected").join(long(actual, "actual"), [key, "column_name"]).select(key, "column_name", status.alias("match_status"))


def accuracy(diff: DataFrame, *by: str) -> DataFrame:
    exact = F.count_if(F.col("match_status").isin("EXACT_MATCH", "BLANK_MATCH"))
    folded = F.count_if(F.col("match_status").isin("EXACT_MATCH", "BLANK_MATCH", "CASE_INSENSITIVE_MATCH"))
    rate = lambda x: F.bround(F.coalesce(100.0 * F.try_divide(x, F.count("*")), F.lit(0.0)), 2)
    return diff.groupBy(*by).agg(F.count("*").alias("evaluated"), rate(exact).alias("exact_rate"), rate(folded).alias("folded_rate"))


STATUSES = ["exact_match", "case_insensitive_match", "blank_match", "value_mismatch", "missing", "extra"]


def accuracy_by_column(diff: DataFrame, n_worst: int = 15) -> DataFrame:
    """Rates and counts by status of each column; ``worst`` for the ``n_worst`` of the lowest rate (then of the most mismatches and missing
    values, then by name), ``best`` where all match.  A row a column, so the ranking is small."""
    counts = diff.groupBy("column_name").agg(*[F.count_if(F.col("match_status") == s.upper()).alias(s) for s in STATUSES])
    out = accuracy(diff, "column_name").join(counts, "column_name")
    worst = out.orderBy("folded_rate", F.col("value_mismatch") + F.col("missing"), "column_name").limit(n_worst).select("column_name", F.lit(True).alias("worst"))
    return out.join(worst, "column_name", "left").withColumns({"worst": F.coalesce("worst", F.lit(False)), "best": F.col("folded_rate") == 100})


def invoice_violations(rows: DataFrame, column: str) -> DataFrame:
    return rows.withColumn("too_long", F.length(column) > 40).withColumn("not_upper", F.col(column) != V.capitals(F.col(column)))


def compliance(rows: DataFrame, invoice: str, header: list[str]) -> DataFrame:
    """One row: how many rows there are, how many have an invoice description over 40 characters, not in capitals or either, whether
    none has, and whether the columns are those of ``header`` in order.  Null descriptions count as compliant."""
    r = invoice_violations(rows, invoice)
    either = F.coalesce(F.col("too_long"), F.lit(False)) | F.coalesce(F.col("not_upper"), F.lit(False))
    out = r.agg(F.count("*").alias("evaluated"), F.count_if("too_long").alias("too_long"), F.count_if("not_upper").alias("not_upper"), F.count_if(either).alias("violations"))
    return out.withColumns({"compliant": F.col("violations") == 0, "same_header": F.lit(rows.columns == header)})


def spread(rows: DataFrame, column: str, prefix: str, n: int) -> DataFrame:
    """The first ``n`` elements of a list as columns, '' where there is none."""
    rest = [c for c in rows.columns if c != column]
    return rows.select(*rest, *[F.coalesce(F.get(column, F.lit(i)), F.lit("")).alias(f"{prefix}_{i + 1}") for i in range(n)])


def deliver(rows: DataFrame, columns: list[str], lists: dict[str, tuple[int, list[str]]]) -> DataFrame:
    """``rows`` as a delivery: ``columns`` as text, then each list of ``lists`` (how many elements, and which of their fields, none for plain
    ones) spread to columns like features_1 or attributes_1_name.  Whatever is missing is ''; elements beyond those asked for are left out,
    as a delivery has a fixed header."""
    text = lambda c, name: F.coalesce(c.cast("string"), F.lit("")).alias(name)
    out = [text(F.col(c), c) for c in columns]
    for name, (n, fields) in lists.items():
        for i in range(n):
            at = F.get(name, F.lit(i))
            out += [text(at[f], f"{name}_{i + 1}_{f}") for f in fields] or [text(at, f"{name}_{i + 1}")]
    return rows.select(*out)
