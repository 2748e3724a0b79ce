"""Claims, search payloads and bulk model calls."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V


def text_to_pages(files: DataFrame) -> DataFrame:
    """``files`` with ``pages``: text bytes as one page; bytes that aren't UTF-8 are replaced."""
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return files.withColumn("pages", F.array(F.struct(F.lit(1).cast("long").alias("page_number"), text.alias("text"))))


def canonical_json(text: Column) -> Column:
    """JSON without spaces, the keys of all its objects, however deep, in order; null where it isn't JSON or an object has a key twice.

    A variant keeps an object's fields by name, so reading and writing one is all it takes.
    """
    return F.to_json(F.try_parse_json(text))


def content_hash(**fields: Column) -> Column:
    """SHA-256 of the JSON of the fields, of structs, maps and lists too, in the order of their names at every level.  Null fields are left out."""
    return F.sha2(canonical_json(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))), 256)


def json_hash(text: Column) -> Column:
    """SHA-256 of a parsed document as JSON text, whatever the order of its keys; of text that isn't JSON, that of the text."""
    return F.sha2(F.coalesce(canonical_json(text), text), 256)


_NAMES = ["name", "specification", "key", "attribute", "property", "label"]
_TYPES = ["text", "numeric", "boolean", "category", "structured"]


def attributes_from_json(rows: DataFrame, raw: str) -> DataFrame:
    """``rows`` without ``raw`` but with name, value, data_type and extraction_method read from it; blank names are left out."""
    get = lambda *keys: F.coalesce(*[F.get_json_object(F.col(raw), f"$.{k}") for k in keys])
    kind, method = get("data_type"), get("extraction_method")
    out = rows.withColumns(
        {
            "name": F.trim(get(*_NAMES)), "value": get("value", "val"),
            "data_type": F.when(kind.isin(_TYPES), kind).otherwise("text"), "extraction_method": F.when(method.isin("deterministic", "llm", "llm_inference"), method).otherwise("llm"),
        }
    )
    return out.where("name is not null and name <> ''").drop(raw)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named there: within functions over lists nothing else sees to that."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _as_text(value: Column) -> Column:
    """Strings as they are, True and False, other values as JSON."""

    def of(x: Column) -> Column:
        return F.when(x["kind"] == "STRING", x["v"].cast("string")).when(x["kind"] == "BOOLEAN", F.initcap(F.to_json(x["v"]))).otherwise(F.to_json(x["v"]))

    return _once(value, lambda v: _once(F.struct(v.alias("v"), F.schema_of_variant(v).alias("kind")), of))


def _words(value: Column) -> Column:
    """A variant as text: as ``_as_text``; null where there is none or it says nothing (false, 0, '', empty)."""

    def of(x: Column) -> Column:
        return F.when((x["kind"] == "STRING") & (x["text"] != "") | ~x["text"].isin("", "null", "False", "0", "0.0", "[]", "{}"), x["text"])

    return _once(value, lambda v: _once(F.struct(_as_text(v).alias("text"), F.schema_of_variant(v).alias("kind")), of))


def string_list(value: Column) -> Column:
    """A variant as a list of strings: a string alone is one; of a list, strings as they are, objects as their values joined by ': ' in the
    order of their keys, other values as text and nulls left out.  What is neither a string nor a list gives none."""
    none = F.array().cast("array<string>")
    kind = F.schema_of_variant(value)
    items = F.try_variant_get(value, "$", "array<variant>")

    def flat(item: Column) -> Column:
        own = F.map_values(F.try_variant_get(item, "$", "map<string,variant>"))
        joined = F.array_join(F.filter(F.transform(own, _words), lambda x: x.isNotNull()), ": ")
        plain = _as_text(item)
        return _once(F.schema_of_variant(item), lambda kind: F.when(kind.startswith("OBJECT"), _once(joined, lambda x: F.when(x != "", x))).when(kind != "VOID", plain))

    return F.when(kind.startswith("ARRAY"), F.filter(F.transform(items, flat), lambda x: x.isNotNull())).when((kind == "STRING") & (value.cast("string") != ""), F.array(value.cast("string"))).otherwise(none)


def records_from_json(rows: DataFrame, raw: str, lists: list[str]) -> DataFrame:
    """``rows`` without ``raw`` but with what an extraction says in it: ``attributes`` (name, display_name, raw_value, data_type, extraction_method)
    and a list of strings for each of ``lists``.

    Name: the first of name, specification, key, attribute and property that says something, else unknown_attribute; where it isn't
    given as ``name``, in lower case with _ for spaces, the words as they were being the display name.  Value: raw_value, else
    value, else val, as text.  Unknown types are text, and unknown methods llm.  Attributes with a blank name, and items that aren't objects, are left out.  Text that isn't JSON has
    no attributes and empty lists.
    """
    doc = F.try_parse_json(raw)
    at = lambda v, k: F.try_variant_get(v, f"$.{k}", "variant")

    def one(item: Column) -> Column:
        named = lambda own: F.struct(own.alias("own"), F.coalesce(own, *[_words(at(item, k)) for k in ("specification", "key", "attribute", "property")], F.lit("unknown_attribute")).alias("given"))
        chosen = lambda x: F.struct(F.coalesce(x["own"], F.replace(F.lower(x["given"]), F.lit(" "), F.lit("_"))).alias("name"), x["given"].alias("given"))
        return F.when(F.schema_of_variant(item).startswith("OBJECT"), _once(_words(at(item, "name")), lambda own: _once(named(own), lambda x: _once(chosen(x), lambda y: read(item, y["name"], y["given"])))))

    def read(item: Column, name: Column, given: Column) -> Column:
        raw_value = at(item, "raw_value")
        value = F.coalesce(F.when(~F.is_variant_null(raw_value), _as_text(raw_value)), _words(at(item, "value")), _words(at(item, "val")), F.lit(""))
        kind, method = (F.try_variant_get(item, f"$.{k}", "string") for k in ("data_type", "extraction_method"))
        return F.when(
            F.trim(name) != "",
            F.struct(
                name.alias("name"), F.coalesce(_words(at(item, "display_name")), given).alias("display_name"), value.alias("raw_value"), F.when(kind.isin(_TYPES), kind).otherwise("text").alias("data_type"),
                F.when(method.isin("deterministic", "llm", "llm_inference"), method).otherwise("llm").alias("extraction_method"),
            ),
        )

    items = F.coalesce(F.try_variant_get(at(F.col("_doc"), "attributes"), "$", "array<variant>"), F.array().cast("array<variant>"))
    found = F.filter(F.transform(items, one), lambda x: x.isNotNull())
    out = rows.withColumn("_doc", doc)
    return out.select(*[c for c in rows.columns if c != raw], found.alias("attributes"), *[F.coalesce(string_list(at(F.col("_doc"), name)), F.array().cast("array<string>")).alias(name) for name in lists])


def header_differences(template: Column, header: Column) -> Column:
    """Places at which two headers differ, counting those that only one has."""
    pairs = F.zip_with(template, header, lambda a, b: ~a.eqNullSafe(b))
    return F.size(F.filter(pairs, lambda x: x)).cast("long")


def norm(column: str) -> Column:
    return F.sqrt(F.aggregate(column, F.lit(0.0), lambda s, v: s + v * v))


def l2_normalize(column: str) -> Column:
    """A vector of length 1; of a zero vector, equal parts."""
    n = norm(column)
    return F.when(n == 0, F.transform(column, lambda v: 1 / F.sqrt(F.size(column)))).otherwise(F.transform(column, lambda v: v / n))


def search_payload(products: DataFrame, attributes: DataFrame) -> DataFrame:
    """(product_id, payload): what a search can filter on, with the attributes as a map.  A product has one row a name."""
    entries = attributes.groupBy("product_id").agg(F.map_from_entries(F.collect_list(F.struct("attribute_name", "raw_value"))).alias("attributes"))
    p = products.join(entries, "product_id", "left")
    return p.select("product_id", F.struct("brand", "category", "status", "quality_score", "attributes").alias("payload"))


def display_value(normalized: Column, raw: Column, unit: Column) -> Column:
    """The normalised value, else the raw one without its unit at the end."""
    ends = F.endswith(F.lower(raw), F.lower(unit)) & (unit != "")
    bare = F.when(ends, F.rtrim(F.left(raw, F.length(raw) - F.length(unit)))).otherwise(raw)
    return F.coalesce(V.blank_to_null(normalized), bare)


def brand_or(found: Column, own: Column, maker: Column) -> Column:
    """The brand found, else the record's unless it is a placeholder, else the manufacturer."""
    return F.when(found != "Unbranded", found).when(~V.is_placeholder(own), own).otherwise(maker)


def merge_claims(sure: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """``sure`` claims and those of ``others`` about something else."""
    return sure.unionByName(others.join(sure.select(*keys).distinct(), keys, "left_anti").select(*others.columns))


def conflict_counts(attributes: DataFrame, claims: DataFrame, keys: list[str]) -> DataFrame:
    """(attribute_id, conflicts): claims whose text differs from the attribute's."""
    a = attributes.select("attribute_id", *keys, V.normalize_text(F.col("raw_value")).alias("_held"))
    both = claims.select(*keys, V.normalize_text(F.col("raw_value")).alias("_new")).join(a, keys)
    return both.groupBy("attribute_id").agg(F.count_if(F.col("_new") != F.col("_held")).alias("conflicts"))


# Ratings that a description may only name if the verified data do.
RATINGS = ["ip65", "ip66", "ip67", "ip68", "class h", "ie3", "ie4", "ul listed", "5-year warranty"]


def check_claims(rows: DataFrame, description: str, verified: str, features: str, applications: str) -> DataFrame:
    """``rows`` with ``checked``: struct(valid, unsupported, supported, total, clean_features, clean_applications).

    Every number of ``description`` must stand in the ``verified`` text as a number of its own, and every rating of RATINGS that it names must stand
    there too; a feature with a number that doesn't is dropped.  Applications stay.  ``unsupported`` says what is wrong in this order;
    ``total`` is 1 at least.  Null texts are empty, and null lists have nothing.
    """
    none = F.array().cast("array<string>")
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    said, own = low(description), low(verified)

    def judge(s: Column) -> Column:
        known = s["known"]
        odd = lambda text: F.filter(V.numbers_in(text), lambda n: ~F.array_contains(known, n))
        wrong = F.filter(s["numbers"], lambda n: ~F.array_contains(known, n))
        claims = F.filter(F.array(*[F.lit(r) for r in RATINGS]), lambda r: F.contains(s["said"], r) & ~F.contains(s["own"], r))
        first = F.transform(s["features"], lambda f: F.struct(f.alias("f"), F.get(odd(F.lower(f)), F.lit(0)).alias("n")))
        bad, clean = F.filter(first, lambda x: x["n"].isNotNull()), F.filter(first, lambda x: x["n"].isNull())
        told = F.concat(
            F.transform(wrong, lambda n: F.concat(F.lit("Unsupported numeric spec claim: '"), n, F.lit("' found in description."))),
            F.transform(claims, lambda r: F.concat(F.lit("Unsupported certification/rating claim: '"), r, F.lit("' in AI text."))),
            F.transform(bad, lambda x: F.concat(F.lit("Unsupported feature claim: '"), x["f"], F.lit("' contains unverified number '"), x["n"], F.lit("'."))),
        )
        good = F.size(s["numbers"]) - F.size(wrong) + F.size(clean) + F.size(s["applications"])
        total = F.size(s["numbers"]) + F.size(claims) + F.size(s["features"]) + F.size(s["applications"])
        return F.struct((F.size(told) == 0).alias("valid"), told.alias("unsupported"), good.cast("long").alias("supported"), F.greatest(F.lit(1), total).cast("long").alias("total"), F.transform(clean, lambda x: x["f"]).alias("clean_features"), s["applications"].alias("clean_applications"))

    parts = F.struct(
        said.alias("said"), own.alias("own"), V.numbers_in(said).alias("numbers"), F.array_distinct(V.numbers_in(own)).alias("known"), F.coalesce(F.col(features), none).alias("features"), F.coalesce(F.col(applications), none).alias("applications"),
    )
    return rows.withColumn("checked", V.let(parts, judge))


def part_products(parts: DataFrame) -> DataFrame:
    """Part records as products: categories from the class path, confidence 0.9, status by the review flag."""
    segments = F.split("class_path", ">")
    return parts.withColumns({"category": segments[0], "subcategory": F.element_at(segments, -1), "confidence": F.lit(0.9), "status": F.when(F.col("needs_review"), "needs_review").otherwise("verified")})


def bulk_extract(pages: DataFrame, id_col: str, text: str, model: Callable[[list[str]], list[str]]) -> DataFrame:
    """(id, name, value, data_type, extraction_method): claims that a batch function returns as a JSON list for each text."""
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, answer in zip(batch[id_col], model([t or "" for t in batch[text]]), strict=True):
                out += [(key, json.dumps(c)) for c in json.loads(answer)]
            yield pd.DataFrame(out, columns=[id_col, "raw"])

    return attributes_from_json(pages.select(id_col, text).mapInPandas(run, f"{id_col} {kind}, raw string"), "raw")
