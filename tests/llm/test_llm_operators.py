"""Edge cases of the operators: nulls, empty tables and texts, ties, repeated rows, clashing names, and brute force on random texts."""

import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import chat, decontaminate, fingerprints, jaccard, langid, licenses, mixing, substrings, urlfilter, warc
from tallyforge.llm import words as W
from tallyforge.llm.components import components
from tallyforge.llm.shared import fresh_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank, tiny and long texts, a repeated row, rows without id, and columns with names that operators use inside."""
    long = " ".join(f"w{i % 997}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, long), (6, long), (7, "a b c d"), (7, "a b c d"), (None, "no id here"), (8, "é ünï © 日本語 テキスト")]
    df = spark.createDataFrame([(i, t, "en", None, 0) for i, t in rows], DOCS)
    return df.withColumns({c: F.lit("x") for c in ("id", "spans", "grams", "set", "fp", "lead_text", "bucket", "matches", "row", "pass")})


def test_words_are_those_of_the_rules():
    import re

    texts = ["Ab c\td", None, "", "  x", "É1-2_b\x00c", "y"]
    for rule, pattern in {"spaced": r"[^\x20\x09-\x0D]+", "spaced_lower": r"[^\x20\x09-\x0D]+", "letters_lower": r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"}.items():
        cut = W.cut(pa.array(texts), rule)
        for i, t in enumerate(texts):
            low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "") if rule != "spaced" else t or ""
            assert cut.first[i + 1] - cut.first[i] == len(re.findall(pattern, low))
    a, b = W.cut(pa.array(["Hello World", "hello world"]), "spaced_lower").hash.reshape(2, 2)
    assert (a == b).all()


def brute_jaccard(texts):
    import re

    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


def near_texts(seed, n=60):
    rng = random.Random(seed)
    base = [[f"{rng.choice('abcdefgh')}{rng.randrange(400)}" for _ in range(rng.randrange(1, 400))] for _ in range(n // 6)]
    shared = [f"p{i}" for i in range(70)]
    out = []
    for _ in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        if rng.random() < 0.3:
            at = rng.randrange(len(w) + 1)
            w[at:at] = shared[: rng.randrange(40, 70)]
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_against_brute_force(spark, seed):
    texts = near_texts(seed) + [None, "", "x", "X"]
    got = jaccard.jaccard_components(frame(spark, texts)).toPandas().sort_values("id")
    n, roots = brute_jaccard(texts)
    assert got["n_shingles"].tolist() == n and got["component_id"].tolist() == roots


def test_jaccard_of_many_near_copies_with_frequent_shingles(spark):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(200)]
    texts = []
    for i in range(150):
        w = list(base) if i % 3 else list(base[:120])
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = f"q{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    got = jaccard.jaccard_components(frame(spark, texts)).toPandas().sort_values("id")
    assert got["component_id"].tolist() == brute_jaccard(texts)[1]


def test_jaccard_counts_few_pairs_of_near_copies_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 50)  # so that groups are cut into blocks
    rng, base, sums = random.Random(7), [f"b{i}" for i in range(150)], []
    for m in (100, 200):
        texts = []
        for _ in range(m):
            w = list(base)
            for x in rng.sample(range(150), 3):
                w[x] = f"q{rng.randrange(10**9)}"
            texts.append(" ".join(w))
        counts = []
        got = jaccard.jaccard_components(frame(spark, texts), counts=counts).toPandas().sort_values("id")
        assert got["component_id"].tolist() == brute_jaccard(texts)[1]
        sums.append(sum(counts))
        assert sum(counts) <= 6 * m  # of m * (m - 1) / 2


def brute_repeats(texts, window):
    words = [(t or "").split() for t in texts]
    seen, gone = {}, []
    for i, w in enumerate(words):
        for p in range(len(w) - window + 1):
            seen.setdefault(tuple(w[p : p + window]), i)
    for i, w in enumerate(words):
        hit = set()
        for p in range(len(w) - window + 1):
            if seen[tuple(w[p : p + window])] < i:
                hit.update(range(p, p + window))
        gone.append([x for j, x in enumerate(w) if j not in hit])
    return [len(w) for w in words], [" ".join(g) for g in gone]


@pytest.mark.parametrize(("seed", "shard", "levels"), [(1, 6000, 8), (2, 1, 8), (3, 200, 8), (4, 1, 1)])
def test_substrings_against_brute_force(spark, seed, shard, levels):
    rng = random.Random(seed)
    texts = near_texts(seed) + ["a " * 300, "a " * 80 + "b", None, "", "q " + "a b " * 90, "a b " * 120 + "c", "x a b c d " * 40, "y " + "x a b c d " * 30 + "z"]
    passage = [f"p{i}" for i in range(55)]
    texts += [" ".join([f"u{rng.randrange(10**6)}" for _ in range(20)] + passage + [f"v{rng.randrange(10**6)}" for _ in range(20)]) for _ in range(20)]
    got = substrings.remove_repeats(frame(spark, texts), shard_words=shard, levels=levels).toPandas().sort_values("id")
    n, kept = brute_repeats(texts, 50)
    assert got["n_words"].tolist() == n and got["text"].tolist() == kept


def test_automaton_statistics_against_brute_force():
    rng = random.Random(3)
    for _ in range(50):
        automaton, held = substrings.SuffixAutomaton(), []
        for _ in range(4):
            s = [rng.randrange(3) for _ in range(rng.randrange(1, 30))]
            stats = automaton.statistics(s)
            runs = {tuple(h[i:j]) for h in held for i in range(len(h)) for j in range(i + 1, len(h) + 1)}
            assert stats == [max([n for n in range(1, e + 2) if tuple(s[e + 1 - n : e + 1]) in runs], default=0) for e in range(len(s))]
            automaton.add(s)
            held.append(s)


def test_decontamination_places_and_blocks(spark):
    item = " ".join(f"k{i}" for i in range(14))
    bench = spark.createDataFrame([(1, item), (2, "tiny item"), (3, None), (4, ""), (5, item)], "item_id long, text string")
    docs = frame(spark, ["x " + item.upper() + " y", "a Tiny, ITEM b", " ".join(f"k{i}" for i in range(9)), None, "", "k0 k1 k2"])
    for block in (16 << 20, 10):
        got = decontaminate.find_contamination(docs, bench, block_bytes=block).toPandas().sort_values("id")
        assert got["n_hit"].tolist() == [14, 2, 0, 0, 0, 0]
        first = {(m["item_id"], m["item_word"], m["word"], m["n_words"]) for m in got["matches"].iloc[0]}
        assert first == {("1", 0, 1, 14), ("5", 0, 1, 14)}


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100), (7, 3)], "a long, b long")
    assert {r["node"]: r["root"] for r in components(edges).collect()} == {i: 0 for i in range(41)}
    assert components(edges.limit(0)).count() == 0


def test_licence_edits_and_spans(spark):
    docs = frame(spark, ["released under the MIT licence today", "gnu generl public licens", "nothing", None, "Apache License, apache LICENSE"])
    got = {r["id"]: r for r in licenses.scan_licenses(docs).collect()}
    assert [m["label"] for m in got[0]["matches"]] and {m["label"] for m in got[0]["matches"]} == {"mit"}
    assert {(m["label"], m["word"], m["errors"]) for m in got[1]["matches"]} == {("gpl", 0, 2)}
    assert not got[2]["matches"] and not got[3]["matches"] and got[3]["n_words"] == 0
    assert [b["word"] for b in got[4]["base"]] == [0, 2]


def test_language_edges(spark, odd):
    model = langid.train_dictionaries(frame(spark, ["the cat sat on the mat " * 20]))
    got = langid.classify(odd.select("doc_id", "text", "set"), model).toPandas()
    assert got.loc[got["text"].isna(), "lang_pred"].tolist() == ["und"] and "set" in got
    assert set(langid.classify(odd.select("doc_id", "text"), {}).toPandas()["lang_pred"]) == {"und"}
    assert langid.train_dictionaries(odd.where("false")) == {}


def test_language_of_a_long_text_is_that_of_most_of_it(spark):
    rng = random.Random(4)
    vocabulary = {k: ["".join(rng.choice(letters) for _ in range(rng.randrange(3, 9))) for _ in range(3000)] for k, letters in (("aa", "abcdefghijk"), ("bb", "ghijklmnopq"))}
    some = lambda k, n: " ".join(rng.choice(vocabulary[k]) for _ in range(n))
    model = langid.train_dictionaries(spark.createDataFrame([(k, some(k, 600)) for k in ("aa", "bb") for _ in range(40)], "lang string, text string"))
    texts = {"short": some("bb", 2000), "long": some("bb", 200_000), "hidden": some("aa", 15_000) + " " + some("bb", 200_000)}
    got = {r["doc_id"]: r for r in langid.classify(spark.createDataFrame(list(texts.items()), "doc_id string, text string"), model).collect()}
    assert {k: (r["lang_pred"], r["lang_kept"]) for k, r in got.items()} == {k: ("bb", True) for k in texts}
    assert got["long"]["lang_score"] == pytest.approx(got["short"]["lang_score"], rel=0.2)  # the margin doesn't shrink with the length
    assert b"".join(langid.pieces(b"x" * 40_000)) == b"x" * 40_000 and max(map(len, langid.pieces(b"x" * 40_000))) <= langid.PIECE_BYTES and langid.pieces(b"") == []


def test_chat_folds_edits_and_regenerations(spark):
    rows = [
        (1, 1, "m1", "start", "user", None), (1, 2, "m1", "delta", None, "hi "), (1, 3, "m1", "delta", None, "there"),
        (1, 4, "m2", "start", "assistant", None), (1, 5, "m2", "delta", None, "bad"), (1, 6, "m2", "regenerate", None, None), (1, 7, "m2", "delta", None, "go\\od<|im_end|>"),
        (1, 8, "m1", "edit", None, "hello"), (1, 9, "m3", "start", "user", None), (1, 10, "m3", "delete", None, None),
    ]
    log = spark.createDataFrame(rows, "conv_id long, seq long, message_id string, kind string, role string, payload string")
    messages = chat.fold_events(log)
    assert [(r["role"], r["text"]) for r in messages.orderBy("position").collect()] == [("user", "hello"), ("assistant", "go\\od<|im_end|>")]
    back = chat.read_back(chat.render(messages)).first()
    assert (back["n_turns"], back["loss_chars"]) == (2, len("go\\od<|im_end|>"))
    assert chat.fold_events(log.limit(0)).count() == 0
    with pytest.raises(Exception, match="unknown event"):
        chat.fold_events(log.withColumn("kind", F.lit("zap"))).collect()


def test_the_log_of_a_table_folds_back_to_it_by_every_kind_of_event(spark):
    turns = [(c, t, "assistant" if t % 2 else "user", f"{c} {t} é<|im_end|>\\ " * (t * 9)) for c in range(6) for t in range(8)]
    turns += [(9, None, "user", "last"), (9, 1, None, None), (9, 1, None, None), (9, 0, "user", "first"), (None, 0, "user", "nowhere")]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("kind", F.lit("clash"))
    log = chat.events_of_turns(table, delta_chars=50)
    assert {r["kind"] for r in log.select("kind").distinct().collect()} == {"start", "delta", "edit", "regenerate", "delete"}
    got = [(r["conv_id"], r["role"], r["text"]) for r in chat.fold_events(log).orderBy("conv_id", "position").collect()]
    assert got == [(c, r, x) for c, _, r, x in turns[:48]] + [(9, "user", "first"), (9, "", ""), (9, "", ""), (9, "user", "last")]
    assert chat.events_of_turns(table.limit(0)).count() == 0


def test_warc_round_trip_and_seek(spark):
    pages = spark.createDataFrame([(1, "http://a/%\n", "x"), (2, None, "x"), (3, "u", None), (4, "u", ""), (5, "v", "é" * 300_000), (None, "n", "n")], "page_id long, url string, html string")
    path = fresh_path(spark, "warc")
    index = warc.write_bundles(pages, path, frame_bytes=64, bundle_bytes=200)
    back = {r["page_id"]: r for r in warc.read_records(index, path).collect()}
    assert {k: (r["type"], r["refers_to"]) for k, r in back.items()} == {1: ("revisit", 2), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None)}
    assert all(r["checked"] for r in back.values()) and back[5]["payload_bytes"] == 600_000
    large = warc.write_bundles(pages, fresh_path(spark, "warc"), least_bytes=1)
    assert large.count() == 5
    assert warc.write_bundles(pages.limit(0), fresh_path(spark, "warc")).count() == 0


def test_alpha_meets_entropy_and_limit():
    tokens = {"a": 900, "b": 90, "c": 10}
    alpha = mixing.solve_alpha(tokens, 1000, target_entropy=0.8)
    w = mixing.weights_at({k: n / 1000 for k, n in tokens.items()}, alpha)
    assert abs(mixing.entropy(w) - 0.8) < 1e-6
    alpha = mixing.solve_alpha(tokens, 1000, target_entropy=1.09, max_repeats=4)
    w = mixing.weights_at({k: n / 1000 for k, n in tokens.items()}, alpha)
    assert max(w[k] * 1000 / tokens[k] for k in tokens) <= 4 + 1e-6
    assert sum(mixing.budgets(tokens, 1000, alpha).values()) == 1000
    assert mixing.budgets({"a": 0}, 10, 1.0) == {"a": 0}


def test_mixing_draws_budgets(spark):
    docs = spark.createDataFrame([(i, "big" if i % 10 else None, 10) for i in range(400)], "doc_id long, source string, n long")
    got = mixing.mix_sources(docs, F.col("n"), target_entropy_share=1.0, max_repeats=3.0).toPandas()
    by = got.groupby(got["source"].isna())["n"].sum()
    assert by[True] == pytest.approx(1200, abs=10) and by[False] == pytest.approx(2800, abs=10)
    assert got["mix_pass"].max() <= 2 and (got.groupby("doc_id").size() <= 3).all()
    assert mixing.mix_sources(docs.limit(0), F.col("n")).count() == 0


def test_mixing_permutes_fixed_blocks(spark):
    docs = spark.createDataFrame([(i, "a" if i % 8 else "b", 1 << 13) for i in range(1600)], "doc_id long, source string, n long")
    got = mixing.mix_sources(docs, F.col("n"), target_entropy_share=1.0).toPandas().sort_values("mix_order")
    assert (got.groupby("doc_id")["mix_block"].nunique() == 1).all()  # a document's block is the same in every pass
    runs = {}
    for (source, n), part in got.groupby(["source", "mix_pass"]):
        blocks = part["mix_block"].tolist()
        runs[source, n] = [x for x, before in zip(blocks, [None, *blocks], strict=False) if x != before]
        assert len(runs[source, n]) == len(set(blocks))  # the documents of a block follow each other
    whole = [runs["b", n] for n in range(3)]
    assert all(sorted(x) == sorted(whole[0]) and x != sorted(x) for x in whole) and whole[0] != whole[1] != whole[2] != whole[0]
    by = got.groupby("source")["mix_tokens"].sum()
    assert by.sum() == pytest.approx(1600 << 13, abs=2 << 13) and by["b"] == pytest.approx(4 * 200 << 13, abs=1 << 13)


def test_winnowing_takes_the_rightmost_least_of_each_window(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abc") for _ in range(n)) for n in (0, 1, 4, 5, 8, 9, 40, 120)]
    df = frame(spark, texts)
    got = {r["doc_id"]: [(x["hash"], x["pos"]) for x in r["fp"]] for r in fingerprints.winnow(df, "text", "fp").collect()}
    k, w = fingerprints.K, fingerprints.WINDOW
    all_hashes = {r["doc_id"]: r["fp__g"] for r in _with_grams(df).collect()}
    for i, t in enumerate(texts):
        g = all_hashes[i]
        assert len(g) == max(len(t.split()) - k + 1, 1 if t else 0)
        top = [(x % 2**64) >> 32 for x in g]
        want = []
        for s in range(max(len(g) - w + 1, 1 if g else 0)):
            p = max(range(s, min(s + w, len(g))), key=lambda j: (-top[j], j))
            if not want or want[-1] != (g[p], p):
                want.append((g[p], p))
        assert got[i] == want


def _with_grams(df):
    class Keep(type(df)):
        pass

    held = {}
    original = type(df).drop

    def drop(self, *cols):
        return self if cols and str(cols[0]).startswith("fp__") else original(self, *cols)

    type(df).drop = drop
    try:
        held["df"] = fingerprints.winnow(df, "text", "fp")
    finally:
        type(df).drop = original
    return held["df"]


def test_fingerprints_of_one_and_of_equal_ids(spark, odd):
    one = fingerprints.fingerprint_edits(frame(spark, ["abc d"])).first()
    assert one["edited"] == "abcab" and one["near_next"] == 1.0
    assert fingerprints.fingerprint_edits(odd, bucket_rows=2).count() == 9
    assert fingerprints.fingerprint_edits(odd.limit(0)).count() == 0


def test_urls_learn_from_rules(spark):
    urls = [(i, f"http://h.example.com/{'bad' if i % 2 else 'good'}/{i}") for i in range(200)] + [(900, "http://H.example.com/bad/x?y"), (901, "nonsense"), (902, None), (903, "a://")]
    rules = [("block", "example.com/bad/1"), ("allow", "example.com/good/")]
    got = {r["id"]: r for r in urlfilter.filter_urls(spark.createDataFrame(urls, "page_id long, url string"), rules).collect()}
    assert got[33]["rule"] is None and got[33]["verdict"] == "block"
    assert got[2]["verdict"] == "allow" and got[900]["host"] == "h.example.com" and got[900]["path"] == "/bad/x"
    assert (got[901]["host"], got[902]["path"], got[903]["host"]) == ("", "", "")
    assert urlfilter.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_urls_are_not_blocked_by_the_prior_alone(spark):
    urls = [(i, f"http://hot.net/x/{i}") for i in range(300)] + [(900, "http://other.example.org/a/b"), (901, "http://other.example.org/a/c"), (902, "http://third.org/fr/a"), (903, "http://third.org/b")]
    got = {r["id"]: r for r in urlfilter.filter_urls(spark.createDataFrame(urls, "page_id long, url string")).collect()}
    assert got[0]["verdict"] == "block" and got[900]["purity"] >= 0.8
    assert [got[i]["verdict"] for i in (900, 901, 903)] == ["allow"] * 3


def test_odd_rows_go_through_everything(spark, odd):
    assert jaccard.jaccard_components(odd).count() == odd.count()
    left = substrings.remove_repeats(odd).toPandas()
    assert len(left) == odd.count() and left.loc[left["id"] == 6, "n_removed"].tolist() == [30_000]
    bench = spark.createDataFrame([(1, "no id here")], "item_id long, text string")
    assert decontaminate.find_contamination(odd, bench).where("n_hit > 0").count() == 1
    assert licenses.scan_licenses(odd).count() == odd.count()
    mixed = mixing.mix_sources(odd, mixing.count_words(F.col("text")))
    assert "row" in mixed.columns and mixed.count() > 0


@pytest.mark.parametrize("f", [jaccard.jaccard_components, substrings.remove_repeats, licenses.scan_licenses])
def test_empty_tables(spark, f):
    assert f(frame(spark, ["x"]).limit(0)).count() == 0


def test_broken_bits_of_the_kernels():
    x = np.array([5, 3, 9, 1, 7], dtype=np.uint64)
    for width in range(1, 6):
        assert W.sliding_min(x, width).tolist() == [min(x[i : i + width]) for i in range(5 - width + 1)]
    assert pd.Series(W.powers(np.uint64(3), 4)).tolist() == [1, 3, 9, 27]


def test_pipeline_stages_judge_rows_with_null_and_repeated_ids(spark, tmp_path):
    import corpus_pipeline as P

    words = lambda p, n: " ".join(f"{p}{i}" for i in range(n))
    item, passage = words("k", 14), words("p", 60)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = lambda f, rows: sorted(((r["doc_id"], r["text"]) for r in f(spark, spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS), str(tmp_path)).collect()), key=str)

    # 3: a contaminated row goes though its id is null, a clean one stays though its id is that of a contaminated one
    rows = [(None, "x " + item), (None, "clean"), (1, item), (1, "also clean"), (2, "fine")]
    assert stage(P.decontaminate_benchmarks, rows) == sorted([(None, "clean"), (1, "also clean"), (2, "fine")], key=str)

    # 7: rows of one id keep their own texts
    rows = [(1, passage), (2, "aa " + passage + " bb"), (2, words("q", 70)), (2, "cc dd " + passage), (None, passage), (3, words("r", 5))]
    assert stage(P.drop_repeated_passages, rows) == sorted([(1, passage), (2, "aa bb"), (2, words("q", 70)), (2, "cc dd"), (None, passage), (3, words("r", 5))], key=str)

    # 9: of exact copies with one id one stays
    rows = [(5, passage), (5, passage), (5, words("q", 70)), (6, passage), (None, passage), (None, passage)]
    assert stage(P.drop_near_copies, rows) == sorted([(5, passage), (5, words("q", 70)), (None, passage), (None, passage)], key=str)

    # 8 and 1: every row by its own text; rows of one id are drawn alike
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in [(1, passage), (1, "123"), (None, passage), (None, ""), (2, words("q", 70))]], DOCS)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in P.identify_language(spark, docs, str(tmp_path)).collect()) == sorted([(1, passage), (0, passage), (2, words("q", 70))])
    drawn = P.mix(spark, docs, str(tmp_path)).toPandas()
    assert drawn[drawn["doc_id"] == 1].groupby("text").size().nunique() == 1
