"""Queries over column functions: values, units, names, keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lookups as L
from ..functions import values as V
from . import catalog as C

Q: dict = {}


def query(name: str, views: str, sql: str):
    def put(f):
        Q[name] = (f, C.with_views(views, sql) if views else sql)
        return f

    return put


#: Raw spellings made from keys, so that every branch of a rule is met.
_SPELL = "CASE {k} % 8 WHEN 0 THEN {n} || ' V' WHEN 1 THEN {n} || ',5kW' WHEN 2 THEN ' ' || {n} || 'RPM ' WHEN 3 THEN {n} || ' 3/4 in' WHEN 4 THEN {n} || '-1/2' WHEN 5 THEN 'N/A - ' || {n} WHEN 6 THEN {n} || ' volts' ELSE {n} || '/0 mm' END"


@query("normalize_numeric", "", f"""
WITH r AS (SELECT p_partkey AS product_id, {_SPELL.format(k='p_partkey', n='p_size')} AS raw FROM part),
x AS (SELECT product_id, trim(raw) AS t FROM r),
m AS (SELECT *, regexp_matches(t, '^[+-]?\\d+([.,]\\d+)?([eE][+-]?\\d+)?\\s*[a-zA-Z°%/]*$') AS plain,
  regexp_extract(t, '^(?:(\\d+)[\\s\\-])?(\\d+)/(\\d+)\\s*([a-zA-Z°%/]+)?$', ['w', 'a', 'b', 'u']) AS f FROM x)
SELECT product_id, CASE WHEN plain THEN CAST(replace(regexp_extract(t, '^([+-]?\\d+(?:[.,]\\d+)?)', 1), ',', '.') AS DOUBLE)
  WHEN f.a <> '' AND TRY_CAST(f.b AS DOUBLE) <> 0 THEN round_even(CASE WHEN f.w = '' THEN 0 ELSE TRY_CAST(f.w AS DOUBLE) END + TRY_CAST(f.a AS DOUBLE) / TRY_CAST(f.b AS DOUBLE), 4) END AS num,
  CASE WHEN plain OR (f.a <> '' AND TRY_CAST(f.b AS DOUBLE) <> 0) THEN 'numeric' ELSE 'text' END AS data_type,
  CASE WHEN plain OR (f.a <> '' AND TRY_CAST(f.b AS DOUBLE) <> 0) THEN
    coalesce({L.sql_map({k: v for k, v in L.UNIT_ALIASES.items() if v})}[lower(CASE WHEN plain THEN regexp_extract(t, '([a-zA-Z°%/]+)$', 1) ELSE f.u END)], nullif(CASE WHEN plain THEN regexp_extract(t, '([a-zA-Z°%/]+)$', 1) ELSE f.u END, '')) END AS unit
FROM m""")  # fmt: skip
def normalize_numeric(spark, d):
    r = C.table(spark, d, "part").select(F.col("p_partkey").alias("product_id"), F.expr(_SPELL.format(k="p_partkey", n="p_size")).alias("raw"))
    v = V.normalize_value(F.col("raw"), F.lit("numeric"), F.lit(None).cast("string"))
    return r.select("product_id", v.alias("v")).select("product_id", F.col("v.norm_num").alias("num"), F.col("v.data_type").alias("data_type"), F.col("v.unit").alias("unit"))


_WORDS = ["Yes", " no ", "TRUE", "off", "n/a", "maybe", "1", "Included"]


@query("normalize_boolean", "", f"SELECT event_id, CASE WHEN w IN {tuple(L.TRUE_WORDS)} THEN true WHEN w IN {tuple(L.FALSE_WORDS)} THEN false END AS value FROM (SELECT event_id, lower(trim({L.sql_list(_WORDS)}[event_id % 8 + 1])) AS w FROM events)")
def normalize_boolean(spark, d):
    w = F.element_at(F.array(*map(F.lit, _WORDS)), (F.col("event_id") % 8 + 1).cast("int"))
    return C.table(spark, d, "events").select("event_id", V.boolean_value(w).alias("value"))


@query("normalize_structured", "", """
WITH r AS (SELECT p_partkey AS product_id, CASE p_partkey % 3 WHEN 0 THEN p_name || '; ' || p_brand || ';' WHEN 1 THEN p_name || ', ' || p_brand ELSE p_name END AS raw FROM part),
s AS (SELECT product_id, raw, list_filter(list_transform(string_split(raw, CASE WHEN contains(raw, ';') THEN ';' ELSE ',' END), lambda x: trim(x)), lambda x: x <> '') AS parts FROM r)
SELECT product_id, CASE WHEN len(parts) > 1 THEN array_to_string(parts, '|') END AS parts, CASE WHEN len(parts) > 1 THEN NULL ELSE raw END AS text FROM s""")
def normalize_structured(spark, d):
    raw = F.expr("CASE p_partkey % 3 WHEN 0 THEN p_name || '; ' || p_brand || ';' WHEN 1 THEN p_name || ', ' || p_brand ELSE p_name END")
    v = V.normalize_value(raw, F.lit("structured"), F.lit(None).cast("string"))
    return C.table(spark, d, "part").select(F.col("p_partkey").alias("product_id"), v.alias("v")).select("product_id", F.array_join("v.norm_list", "|").alias("parts"), F.col("v.norm_text").alias("text"))


@query("to_si", "claims", """SELECT product_id, source_id, attribute_name, round_even(CASE WHEN source_id % 7 = 0 AND k IN (0, 1, 4) THEN w / 1000 * 1000.0 WHEN k = 3 THEN w / 1000.0 ELSE w END, 6) AS value,
  ['W', 'V', 'RPM', 'kg', 'Hz'][k + 1] AS unit FROM claims""")
def to_si(spark, d):
    x = F.col("raw_value")
    unit = F.regexp_extract(x, V.NUMBER_UNIT, 2)
    return C.claims(spark, d).select("product_id", "source_id", "attribute_name", F.bround(V.si_value(V.numeric_value(x), unit), 6).alias("value"), V.si_unit(unit).alias("unit"))


_UNIT_TEXTS = ["kilowatts", " RPM ", "pounds", "furlong", "°c", "m3/h", "Hz", "IP"]


@query("standardize_unit", "", f"""SELECT event_id, CASE WHEN lower(trim(u)) IN ('ip', '') THEN NULL ELSE coalesce({L.sql_map({k: v for k, v in L.UNIT_ALIASES.items() if v})}[lower(trim(u))], trim(u)) END AS unit
FROM (SELECT event_id, {L.sql_list(_UNIT_TEXTS)}[event_id % 8 + 1] AS u FROM events)""")  # fmt: skip
def standardize_unit(spark, d):
    return C.table(spark, d, "events").select("event_id", V.standardize_unit(F.element_at(F.array(*map(F.lit, _UNIT_TEXTS)), (F.col("event_id") % 8 + 1).cast("int"))).alias("unit"))


@query("canonical_unit", "", f"""SELECT event_id, coalesce({L.sql_map(L.UNIT_SYNONYMS)}[lower(trim(u))], trim(u)) AS unit FROM (SELECT event_id, {L.sql_list(_UNIT_TEXTS)}[event_id % 8 + 1] AS u FROM events)""")
def canonical_unit(spark, d):
    return C.table(spark, d, "events").select("event_id", V.canonical_unit(F.element_at(F.array(*map(F.lit, _UNIT_TEXTS)), (F.col("event_id") % 8 + 1).cast("int"))).alias("unit"))


@query("split_value_unit", "claims", f"""SELECT product_id, source_id, attribute_name, regexp_extract(raw_value, '^([+-]?\\d+(?:\\.\\d+)?)\\s*([a-zA-Z°%/³]+)$', 1) AS number,
  coalesce({L.sql_map(L.UNIT_SYNONYMS)}[lower(regexp_extract(raw_value, '([a-zA-Z°%/³]+)$', 1))], regexp_extract(raw_value, '([a-zA-Z°%/³]+)$', 1)) AS unit FROM claims""")
def split_value_unit(spark, d):
    return C.claims(spark, d).select("product_id", "source_id", "attribute_name", F.regexp_extract(F.trim("raw_value"), V.SPLIT_UNIT, 1).alias("number"), V.embedded_unit(F.col("raw_value")).alias("unit"))


_NAMES = ["Rated Voltage (AC)", "power_rating", "no load speed", "Net Weight", "kw", "colour", "ampacity", "line frequency"]


def _concept_sql(n: str) -> str:
    whens = [f"WHEN contains({n}, '{c}') OR contains('{c}', {n}) THEN '{c}'" for c in L.CONCEPT_UNITS]
    whens += ["WHEN " + " OR ".join(f"contains({n}, '{w}')" for w in words) + f" THEN '{c}'" for words, c in L.CONCEPT_WORDS]
    return "CASE " + " ".join(whens) + " END"


@query("match_concept", "", f"SELECT event_id, {_concept_sql('n')} AS concept FROM (SELECT event_id, replace(lower({L.sql_list(_NAMES)}[event_id % 8 + 1]), ' ', '_') AS n FROM events)")
def match_concept(spark, d):
    return C.table(spark, d, "events").select("event_id", V.match_concept(F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("event_id") % 8 + 1).cast("int"))).alias("concept"))


@query("canonical_attribute_name", "", f"""SELECT event_id, regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(lower(trim(n)), '\\([^)]*\\)', '', 'g'), '[^a-z0-9\\s_]', '', 'g')), '\\s+', '_', 'g'), '_+', '_', 'g') AS name
FROM (SELECT event_id, {L.sql_list(_NAMES)}[event_id % 8 + 1] || ' ' || event_type AS n FROM events)""")
def canonical_attribute_name(spark, d):
    n = F.concat_ws(" ", F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("event_id") % 8 + 1).cast("int")), "event_type")
    return C.table(spark, d, "events").select("event_id", V.canonical_attribute_name(n).alias("name"))


_RULE_SQL = """CASE key WHEN 'industrial_motor' THEN 'industrial_motor' WHEN 'motor' THEN 'motor' WHEN 'pump' THEN 'pump' WHEN 'transformer' THEN 'transformer' ELSE
  CASE WHEN contains(key, 'industrial_motor') OR contains('industrial_motor', key) THEN 'industrial_motor' WHEN contains(key, 'motor') OR contains('motor', key) THEN 'motor'
       WHEN contains(key, 'pump') OR contains('pump', key) THEN 'pump' WHEN contains(key, 'transformer') OR contains('transformer', key) THEN 'transformer' ELSE 'generic' END END"""
KEYED = f"keyed AS (SELECT *, {_RULE_SQL} AS rule FROM (SELECT *, replace(regexp_replace(lower(trim(category)), '[ -]', '_', 'g'), '&', 'and') AS key FROM products))"


@query("category_rules", "products", f"WITH {KEYED} SELECT product_id, category, rule FROM keyed")
def category_rules(spark, d):
    return C.products(spark, d).select("product_id", "category", V.category_key(F.col("category")).alias("rule"))


@query("normalize_identifier", "products", "SELECT product_id, nullif(lower(regexp_replace(sku, '[^a-zA-Z0-9]', '', 'g')), '') AS key, regexp_replace(lower(trim(product_name)), '\\s+', ' ', 'g') AS name FROM products")
def normalize_identifier(spark, d):
    return C.products(spark, d).select("product_id", V.normalize_identifier(F.col("sku")).alias("key"), V.normalize_text(F.col("product_name")).alias("name"))


@query("repair_mojibake", "", "SELECT doc_id, sha256(text) AS h, sha256(text) AS untouched FROM documents")
def repair_mojibake(spark, d):
    """Texts are broken by reading their UTF-8 as Latin-1, then repaired; and texts as they are, which hold neither mark, stay."""
    docs = C.table(spark, d, "documents").select("doc_id", "text", F.decode(F.encode("text", "UTF-8"), "ISO-8859-1").alias("b"))
    return docs.select("doc_id", F.sha2(V.repair_mojibake(F.col("b")), 256).alias("h"), F.sha2(V.repair_mojibake(F.col("text")), 256).alias("untouched"))


@query("decimal_to_fraction", "", """
WITH x AS (SELECT p_partkey AS product_id, p_partkey % 60 + (p_partkey % 128) / 128 AS v FROM part),
y AS (SELECT product_id, v, CAST(floor(v) AS BIGINT) AS w, v - floor(v) AS r, greatest(1, least(63, CAST(ceil((v - floor(v)) * 64 - 0.5) AS INT))) AS n FROM x),
z AS (SELECT *, gcd(n, 64) AS g FROM y)
SELECT product_id, CASE WHEN r < 0.0078 THEN CAST(w AS VARCHAR) WHEN r > 0.9921 THEN CAST(w + 1 AS VARCHAR) WHEN w = 0 THEN (n // g) || '/' || (64 // g) ELSE w || '-' || (n // g) || '/' || (64 // g) END AS fraction FROM z""")
def decimal_to_fraction(spark, d):
    return C.table(spark, d, "part").select(F.col("p_partkey").alias("product_id"), V.decimal_to_fraction(F.expr("p_partkey % 60 + (p_partkey % 128) / 128D")).alias("fraction"))


_UOM = "CASE p_partkey % 5 WHEN 0 THEN p_size || '.25 inches' WHEN 1 THEN p_size || 'V' WHEN 2 THEN p_size || ' discs' WHEN 3 THEN p_size || '.5' ELSE '' END"


@query("clean_uom", "", f"""
WITH x AS (SELECT p_partkey AS product_id, p_size, p_partkey % 5 AS k, {_UOM} AS raw FROM part)
SELECT product_id, CASE k WHEN 0 THEN p_size || '-1/4 in' WHEN 1 THEN p_size || ' V' WHEN 2 THEN p_size || ' disc' WHEN 3 THEN p_size || '-1/2 ft' ELSE '' END AS formatted FROM x""")
def clean_uom(spark, d):
    p = C.table(spark, d, "part").select(F.col("p_partkey").alias("product_id"), F.expr(_UOM).alias("raw"), F.expr("if(p_partkey % 5 = 3, 'feet', if(p_partkey % 5 = 1, 'volts', NULL))").alias("uom"))
    return p.select("product_id", V.format_value_uom(V.clean_part_value(F.col("raw"), F.col("uom"))).alias("formatted"))


@query("invoice_desc", "", "SELECT doc_id, trim(substr(trim(upper(replace(text, 'ß', 'SS'))), 1, 40)) AS invoice FROM documents")
def invoice_desc(spark, d):
    return C.table(spark, d, "documents").select("doc_id", V.invoice_description(F.col("text")).alias("invoice"))


@query("record_completeness", "products", "SELECT product_id, round_even(100.0 * ((product_name <> '')::INT + (brand <> '')::INT + (CASE WHEN product_id % 4 = 0 THEN 0 ELSE 1 END)) / 3, 2) AS completeness FROM products")
def record_completeness(spark, d):
    p = C.products(spark, d).withColumn("note", F.when(F.col("product_id") % 4 == 0, "").otherwise("x"))
    filled = sum((F.when(F.coalesce(F.col(c), F.lit("")) != "", 1).otherwise(0) for c in ("product_name", "brand", "note")), F.lit(0))
    return p.select("product_id", F.bround(100.0 * filled / 3, 2).alias("completeness"))


@query("confidence_score", "claims", """
WITH s AS (SELECT product_id, source_id, attribute_name, trust, CASE source_id % 4 WHEN 0 THEN 'deterministic' WHEN 1 THEN 'llm' WHEN 2 THEN 'llm_inference' ELSE 'other' END AS m, w % 2 = 0 AS v, w % 3 = 0 AS n, (w % 100) / 100 AS c, w % 4 AS k FROM claims),
t AS (SELECT *, CASE m WHEN 'deterministic' THEN 76 WHEN 'llm' THEN 68 WHEN 'llm_inference' THEN 48 ELSE 60 END + CASE WHEN v THEN 12 WHEN m = 'llm' THEN -4 ELSE 0 END + CASE WHEN n THEN 4 ELSE 0 END + CASE WHEN c >= 0.85 THEN 6 WHEN c < 0.4 THEN -10 ELSE 0 END - least(20, 8 * k) AS p FROM s),
u AS (SELECT *, round_even(greatest(0.0::DOUBLE, least(100.0::DOUBLE, p * greatest(0.8::DOUBLE, least(1.0::DOUBLE, trust)))), 1) AS score FROM t)
SELECT product_id, source_id, attribute_name, score, CASE WHEN score >= 85 THEN 'verified' WHEN score >= 60 THEN 'extracted' ELSE 'needs_review' END AS status FROM u""")
def confidence_score(spark, d):
    c = C.claims(spark, d)
    kilo = (F.col("source_id") % 7 == 0) & (F.col("attribute_name") != "speed")
    w = F.when(kilo, F.regexp_replace(F.split("raw_value", " ")[0], "[.]", "")).otherwise(F.split("raw_value", " ")[0]).cast("long")
    c = c.withColumn("w", w).withColumn("m", F.expr("CASE source_id % 4 WHEN 0 THEN 'deterministic' WHEN 1 THEN 'llm' WHEN 2 THEN 'llm_inference' ELSE 'other' END"))
    score = V.confidence_score(F.col("m"), F.col("w") % 2 == 0, F.col("w") % 3 == 0, (F.col("w") % 100) / 100, F.col("trust"), F.col("w") % 4)
    return c.withColumn("score", score).select("product_id", "source_id", "attribute_name", "score", V.status_from_confidence(F.col("score")).alias("status"))


@query("claim_check", "", """
WITH d AS (SELECT doc_id, regexp_extract_all(text, '\\b\\d+(?:\\.\\d+)?\\b') AS ns, CAST(doc_id AS VARCHAR) AS own FROM documents)
SELECT doc_id, len(list_distinct(ns)) AS n_numbers, len(list_filter(list_distinct(ns), lambda x: x <> own AND x <> '10' AND x <> '24')) AS n_unsupported FROM d""")
def claim_check(spark, d):
    """Numbers of a text that its verified values don't hold."""
    numbers = F.array_distinct(V.numbers_in(F.col("text")))
    verified = F.array(F.col("doc_id").cast("string"), F.lit("10"), F.lit("24"))
    return C.table(spark, d, "documents").select("doc_id", F.size(numbers).cast("long").alias("n_numbers"), F.size(F.array_except(numbers, verified)).cast("long").alias("n_unsupported"))


@query("cache_key", "", "SELECT doc_id, sha256(concat_ws(':', sha256(text), 'model', 'v1')) AS cache_key FROM documents")
def cache_key(spark, d):
    return C.table(spark, d, "documents").select("doc_id", F.sha2(F.concat_ws(":", F.sha2("text", 256), F.lit("model"), F.lit("v1")), 256).alias("cache_key"))


@query("search_text", "products attributes", """
WITH a AS (SELECT product_id, string_agg(attribute_name || ': ' || raw_value, chr(10) ORDER BY attribute_name) AS specs FROM attributes GROUP BY product_id),
t AS (SELECT p.product_id, concat_ws(chr(10) || chr(10), 'Product: ' || product_name, 'Brand: ' || brand, 'Specifications:' || chr(10) || specs) AS text FROM products p LEFT JOIN a USING (product_id))
SELECT product_id, length(text) AS n_chars, sha256(text) AS content_hash FROM t""")
def search_text(spark, d):
    a = C.attributes(spark, d).groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct("attribute_name", "raw_value"))).alias("specs"))  # five attributes at most
    lines = F.array_join(F.transform("specs", lambda s: F.concat(s["attribute_name"], F.lit(": "), s["raw_value"])), "\n")
    text = F.concat_ws("\n\n", F.concat(F.lit("Product: "), "product_name"), F.concat(F.lit("Brand: "), "brand"), F.concat(F.lit("Specifications:\n"), lines))
    return C.products(spark, d).join(a, "product_id", "left").select("product_id", text.alias("t")).select("product_id", F.length("t").cast("long").alias("n_chars"), F.sha2("t", 256).alias("content_hash"))


@query("is_stale", "steps", "SELECT step_id, created_at < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 2 MINUTE AS stale FROM steps")
def is_stale(spark, d):
    return C.steps(spark, d).select("step_id", (F.col("created_at") < F.expr("TIMESTAMP'2024-01-20 00:00:00' - INTERVAL '2' MINUTE")).alias("stale"))


@query("enrichment_confidence", "claims", """
WITH s AS (SELECT product_id, source_id, attribute_name, trust, w % 3 AS bad, (w % 10) / 10 AS a, (w % 7) / 7 AS b FROM claims)
SELECT product_id, source_id, attribute_name, round_even(CASE WHEN bad > 0 THEN greatest(0.1::DOUBLE, 0.48 - 0.1 * bad) ELSE greatest(0.2::DOUBLE, least(0.95::DOUBLE, 0.35 * a + 0.25 * b + 0.15 * trust + 0.15 + 0.1 * a)) END, 4) AS confidence FROM s""")
def enrichment_confidence(spark, d):
    kilo = (F.col("source_id") % 7 == 0) & (F.col("attribute_name") != "speed")
    w = F.when(kilo, F.regexp_replace(F.split("raw_value", " ")[0], "[.]", "")).otherwise(F.split("raw_value", " ")[0]).cast("long")
    c = C.claims(spark, d).withColumn("w", w)
    c = c.withColumn("bad", F.col("w") % 3).withColumn("a", (F.col("w") % 10) / 10).withColumn("b", (F.col("w") % 7) / 7)
    good = F.expr("greatest(0.2D, least(0.95D, 0.35D * a + 0.25D * b + 0.15D * trust + 0.15D + 0.1D * a))")
    return c.select("product_id", "source_id", "attribute_name", F.bround(F.when(F.col("bad") > 0, F.expr("greatest(0.1D, 0.48D - 0.1D * bad)")).otherwise(good), 4).alias("confidence"))
