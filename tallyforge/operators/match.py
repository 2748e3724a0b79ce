"""Entity resolution, duplicate pairs, vector search and name matching."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lookups as L
from ..functions import values as V
from ..storage import stored
from . import vectors as X
from .components import components


def _keyed(rows: DataFrame, id_col: str, prefix: str) -> DataFrame:
    key = V.normalize_identifier
    return rows.select(
        F.col(id_col).alias(f"{prefix}id"), key(F.col("sku")).alias(f"{prefix}sku"), key(F.col("model")).alias(f"{prefix}model"),
        V.normalize_text(F.col("brand")).alias(f"{prefix}brand"), V.normalize_text(F.col("product_name")).alias(f"{prefix}name"),
    )


#: Levels of a match in order: method, confidence, what must be equal besides the brand, what must not be there and differ.
LEVELS = [("exact_sku_brand", 1.0, "sku", ()), ("model_brand", 0.95, "model", ("sku",)), ("name_brand", 0.9, "name", ("sku", "model"))]


def resolve_entities(incoming: DataFrame, catalog: DataFrame, incoming_id: str = "incoming_id", catalog_id: str = "product_id") -> DataFrame:
    """(incoming_id, match_id, method, confidence): sku and brand, else model and brand, else name and brand, else none.

    A level is an equi-join; its guards (skus or models that are both there and differ) are join conditions, and neither side goes through the
    driver.  The least catalog id of
    the best level wins by an aggregate, so that a common name doesn't gather its rows."""
    return matched(incoming, catalog, incoming_id, catalog_id).drop("n_equal", "review")


def matched(incoming: DataFrame, catalog: DataFrame, incoming_id: str = "incoming_id", catalog_id: str = "product_id") -> DataFrame:
    """``resolve_entities`` with ``n_equal``, how many catalog rows the best level found, and ``review``, whether that is more than one."""
    i, c = _keyed(incoming, incoming_id, "i_"), _keyed(catalog, catalog_id, "c_")
    apart = lambda k: F.coalesce(F.col(f"i_{k}") != F.col(f"c_{k}"), F.lit(False))
    found, left = None, i
    for method, confidence, key, guards in LEVELS:
        on = (F.col(f"i_{key}") == F.col(f"c_{key}")) & (F.col("i_brand") == F.col("c_brand"))
        for g in guards:
            on = on & ~apart(g)
        one = left.join(c.hint("merge"), on).groupBy("i_id").agg(F.min("c_id").alias("match_id"), F.count("*").alias("n_equal"))
        one = one.select("i_id", "match_id", F.lit(method).alias("method"), F.lit(confidence).alias("confidence"), "n_equal")
        found = one if found is None else found.unionByName(one)
        left = i.join(found.select("i_id").hint("merge"), "i_id", "left_anti")
    out = i.select("i_id").join(found.hint("merge"), "i_id", "left")
    return out.select(
        F.col("i_id").alias(incoming_id), "match_id", F.coalesce("method", F.lit("none")).alias("method"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("n_equal", F.lit(0)).alias("n_equal"), F.coalesce(F.col("n_equal") > 1, F.lit(False)).alias("review"),
    )


def resolve_with_vectors(
    incoming: DataFrame, catalog: DataFrame, incoming_vectors: DataFrame, index: X.Index, threshold: float = 0.70, k: int = 5, probes: int | None = None
) -> DataFrame:
    """(incoming_id, match_id, method, confidence, n_equal, review, candidates): the cascade of ``matched`` whose last level looks for vectors.

    Only rows that no key resolves are searched in ``index`` (of the catalog's vectors by product_id as vec_id).  ``incoming_vectors``:
    (incoming_id, embedding).  Candidates are as in ``semantic_candidates``: (product_id, score), best first.  They are for people to decide
    on: such rows have the method vector_candidates, no match_id, the best hit's score as confidence, and review.  A row whose hits all go
    by the guard keeps that confidence with the method none.
    """
    keyed = stored(matched(incoming, catalog), "matched")
    open_ = keyed.where("method = 'none'").select("incoming_id")
    asked = incoming_vectors.join(open_, "incoming_id", "left_semi").select(F.col("incoming_id").alias("query_id"), "embedding", F.lit(None).cast("int").alias("label"))
    hits = stored(X.search(index, asked, k, probes, threshold), "hits")
    best = hits.groupBy("query_id").agg(F.max("score").alias("best"))
    near = semantic_candidates(hits, incoming, catalog, threshold, k).groupBy("incoming_id").agg(F.sort_array(F.collect_list(F.struct("rank", "product_id", "score"))).alias("c"))  # k at most
    out = keyed.join(best, F.col("incoming_id") == F.col("query_id"), "left").join(near, "incoming_id", "left")
    some = F.col("c").isNotNull()
    return out.select(
        "incoming_id", "match_id", F.when(some, "vector_candidates").otherwise(F.col("method")).alias("method"), F.coalesce("best", "confidence").alias("confidence"), "n_equal", (F.col("review") | some).alias("review"),
        F.coalesce(F.transform("c", lambda x: F.struct(x.product_id.alias("product_id"), x.score.alias("score"))), F.array().cast("array<struct<product_id:bigint,score:double>>")).alias("candidates"),
    )


def duplicate_groups(products: DataFrame) -> DataFrame:
    """(product_id, group_id, n): products of equal name and brand, each with the least id of its group.  Linear in the group size."""
    keyed = products.select("product_id", V.normalize_text(F.col("brand")).alias("b"), V.normalize_text(F.col("product_name")).alias("nm"))
    groups = keyed.groupBy("b", "nm").agg(F.min("product_id").alias("group_id"), F.count("*").alias("n")).where("n > 1")
    return keyed.join(groups, ["b", "nm"]).select("product_id", "group_id", "n")


def duplicate_candidates(products: DataFrame) -> DataFrame:
    """(product_id, group_id, n_links, method, score) of every product: the catalog resolved against itself.

    Two products are linked by the best level of ``LEVELS`` that holds for them.  ``n_links`` counts the others a product is linked with,
    ``method`` and ``score`` are those of its best link (none and 0 without one), and ``group_id`` is the least product that links lead to.

    No pairs are made.  In a block (the rows of one key and brand) it depends only on which of the guarded fields are null or equal whether
    two rows link, so counts of the block by those fields give each row's links; and rows that link with all others, or two sets
    that link with each other, become a star around their least row.  A block with a third of all rows is one aggregate with partial
    sums, and its counts come back by a join of n:1.

    Rows without a brand, or with no key at all, are alone.  Each product_id is taken to stand once; a repeated one is two rows that link.
    """
    rows = stored(_keyed(products, "product_id", ""), "keyed")
    at = lambda c: F.col(c).isNull()
    one = lambda cond: F.count_if(cond)
    # links of the first level: same sku
    by_sku = stored(rows.where("sku is not null and brand is not null").groupBy("sku", "brand").agg(F.count("*").alias("n_sku"), F.min("id").alias("least_sku")), "by-sku")
    # of the second: same model, and a sku is missing (equal skus are the first's)
    by_model = stored(
        rows.where("model is not null and brand is not null").groupBy("model", "brand").agg(F.count("*").alias("n_model"), one(at("sku")).alias("m_no_sku"), F.min("id").alias("least_model")), "by-model"
    )
    # of the third: same name, a sku is missing and a model is missing
    free, without_sku, without_model = at("sku") & at("model"), at("sku") & ~at("model"), ~at("sku") & at("model")
    by_name = stored(
        rows.where("name is not null and brand is not null").groupBy("name", "brand").agg(
            F.count("*").alias("n_name"), one(free).alias("n_free"), one(at("sku")).alias("n_no_sku"), one(at("model")).alias("n_no_model"),
            F.min("id").alias("least_name"), F.min(F.when(without_sku, F.col("id"))).alias("least_no_sku"), F.min(F.when(without_model, F.col("id"))).alias("least_no_model"),
        ), "by-name",
    )
    x = rows.join(by_sku, ["sku", "brand"], "left").join(by_model, ["model", "brand"], "left").join(by_name, ["name", "brand"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    first = F.greatest(zero(F.col("n_sku")) - 1, F.lit(0))
    second = zero(F.when(at("sku"), F.col("n_model") - 1).otherwise(F.col("m_no_sku")))
    third = zero(F.when(free, F.col("n_name") - 1).when(without_sku, F.col("n_no_model")).when(without_model, F.col("n_no_sku")).otherwise(F.col("n_free")))
    # rows of the third level that the second has already: same model, which then isn't missing in both, so none
    cross = F.col("least_no_sku").isNotNull() & F.col("least_no_model").isNotNull() & (without_sku | without_model)
    star = F.when(F.col("n_free") > 0, F.col("least_name")).when(cross, F.least("least_no_sku", "least_no_model"))
    x = stored(x.select("id", first.alias("n1"), second.alias("n2"), third.alias("n3"), F.array("least_sku", F.when(F.col("m_no_sku") > 0, F.col("least_model")), star).alias("to")), "linked")
    groups = components(x.select(F.col("id").alias("a"), F.explode("to").alias("b")).where("b is not null"))
    pick = lambda i, none: F.when(F.col("n1") > 0, LEVELS[0][i]).when(F.col("n2") > 0, LEVELS[1][i]).when(F.col("n3") > 0, LEVELS[2][i]).otherwise(none)
    return x.join(groups, F.col("id") == F.col("node"), "left").select(F.col("id").alias("product_id"), F.coalesce("root", "id").alias("group_id"), (F.col("n1") + F.col("n2") + F.col("n3")).alias("n_links"), pick(0, "none").alias("method"), pick(1, 0.0).alias("score"))


def record_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b, score, method, seen_at) once each, the smaller id first, the newest score; equal ids are left out."""
    p = pairs.where("a <> b").select(F.least("a", "b").alias("product_id"), F.greatest("a", "b").alias("candidate_id"), "score", "method", "seen_at")
    return p.groupBy("product_id", "candidate_id").agg(F.max_by(F.struct("score", "method"), F.struct("seen_at", "score")).alias("x")).select("product_id", "candidate_id", "x.*")


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, vec_id, score, rank): the ``k`` nearest by cosine among vectors with the query's label, where it has one.

    Exact: vectors and queries meet as matrices in blocks of bounded size, and what leaves a task is its best ``k`` of each query."""
    return X.search(X.build_index(vectors, lists=1), queries, k)


def semantic_candidates(hits: DataFrame, incoming: DataFrame, catalog: DataFrame, threshold: float = 0.70, k: int = 5) -> DataFrame:
    """(incoming_id, product_id, score, rank, confidence): candidates for review among the ``k`` nearest products of each incoming row.

    ``hits`` (query_id, vec_id, score, rank) are those of ``vector_topk``.  Those under ``threshold`` go, and those of the same brand with
    another part number, both there.  The confidence is the best hit's score at the threshold or over it, even if that hit went.
    """
    near = hits.where((F.col("rank") <= k) & (F.col("score") >= threshold))
    best = near.groupBy("query_id").agg(F.max("score").alias("confidence"))
    i = _keyed(incoming, "incoming_id", "i_").select("i_id", "i_sku", "i_brand")
    c = _keyed(catalog, "product_id", "c_").select("c_id", "c_sku", "c_brand")
    both = near.join(i, F.col("query_id") == F.col("i_id")).join(c, F.col("vec_id") == F.col("c_id"))
    other = F.coalesce((F.col("i_brand") == F.col("c_brand")) & (F.col("i_sku") != F.col("c_sku")), F.lit(False))
    return both.where(~other).join(best, "query_id").select(F.col("query_id").alias("incoming_id"), F.col("vec_id").alias("product_id"), "score", "rank", "confidence")


def match_manufacturers(rows: DataFrame, raw: str, placeholders: Sequence[str] = ()) -> DataFrame:
    """``rows`` with name, brand, code and confidence of the manufacturer, found once for each distinct raw name.

    ``placeholders``: names in lower case that stand for none, besides those that always do."""
    names = rows.select(F.col(raw).alias("_raw")).distinct()
    tokens = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\w+"), F.lit(0)))
    clean = F.trim(F.regexp_replace("_raw", r"\s*\((?U:\w+)\)\s*$", ""))
    names = names.withColumn("clean", clean).withColumn("t", tokens(F.col("clean")))
    best = F.lit(None)
    scored = []
    for pos, (name, brand, code) in enumerate(L.MANUFACTURERS):
        own = F.array(*[F.lit(t) for t in sorted(set(_tokens(name)))])
        jaccard = F.when(F.size("t") > 0, F.size(F.array_intersect("t", own)) / F.size(F.array_union("t", own))).otherwise(0.0)
        inside = F.lit(name.lower()).contains(F.lower("clean")) | F.lower(F.col("clean")).contains(name.lower())
        score = F.when(inside, F.greatest(jaccard, F.lit(0.8))).otherwise(jaccard)
        scored.append(F.struct(score.alias("score"), F.lit(-pos).alias("pos"), F.lit(name).alias("name"), F.lit(brand).alias("brand"), F.lit(code).alias("code")))
    best = F.array_max(F.array(*scored))
    names = names.withColumn("best", best)
    none = V.is_placeholder(F.col("_raw"), placeholders)
    hit = F.col("best.score") >= 0.3
    pick = lambda missing, found, raw_: F.when(none, missing).when(hit, found).otherwise(raw_)
    names = names.select(
        "_raw",
        pick(F.lit("Unknown Manufacturer"), F.col("best.name"), F.col("clean")).alias("manufacturer"),
        pick(F.lit("Unbranded"), F.col("best.brand"), F.col("clean")).alias("mfr_brand"),
        pick(F.lit("UNKNOWN"), F.col("best.code"), F.lit("UNKNOWN")).alias("mfr_code"),
        pick(F.lit(0.0), F.bround("best.score", 2), F.lit(0.1)).alias("mfr_confidence"),
    )
    return rows.join(names, F.col(raw).eqNullSafe(F.col("_raw"))).drop("_raw")


def _tokens(name: str) -> list[str]:
    import re

    return re.findall(r"\w+", name.lower())


def match_class_paths(rows: DataFrame, raw: str) -> DataFrame:
    """``rows`` with ``class_path`` and ``class_confidence``: the approved path that shares most segments."""
    segments = F.array_distinct(F.split(F.lower(F.trim(F.col(raw))), ">"))
    scored = []
    for pos, path in enumerate(L.CLASS_PATHS):
        own = F.array(*[F.lit(s) for s in dict.fromkeys(path.lower().split(">"))])
        score = F.when(F.lower(F.trim(F.col(raw))) == path.lower(), 1.0).otherwise(F.size(F.array_intersect(segments, own)) / F.greatest(F.size(segments), F.lit(1)))
        scored.append(F.struct(score.alias("score"), F.lit(-pos).alias("pos"), F.lit(path).alias("path")))
    best = F.array_max(F.array(*scored))
    blank = F.col(raw).isNull() | (F.col(raw) == "")
    rows = rows.withColumn("_best", best)
    first = F.lit(L.CLASS_PATHS[0])
    hit = F.col("_best.score") >= 0.4
    return rows.withColumn("class_path", F.when(blank | ~hit, first).otherwise(F.col("_best.path"))).withColumn("class_confidence", F.when(blank, 0.0).when(hit, F.bround("_best.score", 2)).otherwise(0.1)).drop("_best")
