"""The pipeline's stages with odd columns and empty tables, and the whole of it against brute force on a planted table."""

import random

import pytest
from pyspark.sql import functions as F
from test_llm_operators import DOCS, brute_jaccard, brute_repeats

import corpus_pipeline as P
from tallyforge.llm import langid, licenses

CLASHING = ["__row", "__gone", "__id", "__text", "lang_kept", "lang_pred", "key", "row", "id", "left", "gone", "component_id", "n_hit", "n_removed", "matches", "src", "pass", "place"]


def _benchmark(spark, path, texts):
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def _words(p, n):
    return " ".join(f"{p}{i}" for i in range(n))


@pytest.mark.parametrize("n", range(len(P.STAGES)))
def test_a_stage_keeps_columns_of_any_name(spark, tmp_path, n):
    _benchmark(spark, tmp_path, [_words("k", 14)])
    text = _words("lorem ipsum dolor ", 60)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate([text, text, "aa " + text, _words("k", 20), _words("some other words ", 80)])], DOCS)
    docs = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in CLASHING})
    out = P.STAGES[n][1](spark, docs, str(tmp_path))
    assert out.columns[: len(docs.columns)] == docs.columns and (n == 4 or out.columns == docs.columns)
    got = out.collect()
    assert got and all(r[c] == f"{c}{r['doc_id']}" for r in got for c in CLASHING)


@pytest.mark.parametrize("n", range(len(P.STAGES)))
def test_a_stage_of_an_empty_table_is_empty(spark, tmp_path, n):
    _benchmark(spark, tmp_path, [])
    out = P.STAGES[n][1](spark, spark.createDataFrame([], DOCS), str(tmp_path))
    assert out.count() == 0 and out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]


def test_texts_that_are_numbers(spark):
    docs = spark.createDataFrame([(1, 123), (2, None)], "doc_id long, text int")
    assert [r["lang_pred"] for r in langid.classify(docs, {"en": b"the words of english", "de": b"die deutschen woerter"}).orderBy("doc_id").collect()] == ["und", "und"]
    assert [r["n_words"] for r in licenses.scan_licenses(docs).orderBy("id").collect()] == [1, 0]


LETTERS = {"en": "the quick brown fox jumps over lazy dogs while seven wizards boil mighty jars of wax", "de": "der schnelle braune fuchs springt ueber faule hunde waehrend sieben zauberer wachs kochen"}


def _planted(seed):
    """(doc_id, text, lang, source): prose of two languages, copies with small edits, passages that repeat, benchmark items, texts without letters."""
    rng = random.Random(seed)
    prose = lambda lang, n: " ".join(f"{rng.choice(LETTERS[lang].split())}{rng.choice('abcdefgh')}{rng.choice('abcdefgh')}" for _ in range(n))
    passage, item = prose("en", 70), prose("de", 15)
    texts = []
    for i in range(60):
        lang = "en" if i % 3 else "de"
        t = prose(lang, rng.randrange(40, 160))
        if i % 10 == 3:
            t = f"{t} {passage} {prose(lang, 10)}"
        if i % 15 == 4:
            t = f"{t} {item} {prose(lang, 5)}"
        texts.append((t, lang))
        if i % 6 == 0:
            w = t.split()
            w[rng.randrange(len(w))] = "edited"
            texts += [(t, lang), (" ".join(w), lang)]
    texts += [("12 34 56", "en"), ("", "de"), (None, "en")]
    return [(i, t, lang, "big" if i % 3 else "small") for i, (t, lang) in enumerate(texts)], item


@pytest.mark.parametrize("seed", [1, 2])
def test_the_whole_pipeline_on_a_planted_table(spark, tmp_path, seed):
    rows, item = _planted(seed)
    spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    _benchmark(spark, tmp_path, [item])
    got = P.run(spark, str(tmp_path)).collect()

    docs = [(i, t, s) for i, t, _, s in rows if t and any(c.isalpha() for c in t)]  # every text of letters is clear, by its length or its margin
    clear = {r["doc_id"] for r in P.identify_language(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()}
    assert clear <= {i for i, _, _ in docs} and len(clear) >= 0.95 * len(docs)
    docs = [d for d in docs if d[0] in clear]
    _, root = brute_jaccard([t for _, t, _ in docs])
    docs = [d for n, d in enumerate(docs) if root[n] == n]
    _, kept = brute_repeats([t for _, t, _ in docs], 50)
    docs = [(i, k if k != " ".join(t.split()) else t, s) for (i, t, s), k in zip(docs, kept, strict=True)]
    wanted = item.split()
    windows = {tuple(wanted[j : j + 10]) for j in range(len(wanted) - 9)}
    hit = lambda t: any(tuple(w[j : j + 10]) in windows for w in [t.split()] for j in range(len(w) - 9))
    docs = {i: (t, s) for i, t, s in docs if t and not hit(t)}

    assert {r["doc_id"] for r in got} <= set(docs) and all((r["text"], r["source"]) == docs[r["doc_id"]] for r in got)
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    words = {i: len(t.split()) for i, (t, _) in docs.items()}
    drawn = sum(words[r["doc_id"]] for r in got)
    longest = max(words.values())
    assert sum(words.values()) <= drawn + 2 and drawn <= sum(words.values()) + 2 * longest + 2
    share = sum(words[r["doc_id"]] for r in got if r["source"] == "small") / drawn
    assert share > sum(words[i] for i, (_, s) in docs.items() if s == "small") / sum(words.values())  # the small source gains
