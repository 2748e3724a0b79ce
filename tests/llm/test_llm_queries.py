"""Registered queries against their SQL, or against brute force where there is none, over whole small tables."""

import hashlib
import re
import zlib

import pytest

from tallyforge.llm.queries import ORACLE_SQL, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(name, same):
    same(QUERIES[name], ORACLE_SQL[name])


def test_mixing_meets_its_budget(spark, docs):
    got = QUERIES["op1_source_mixing"](spark, SMALL).toPandas()
    words = {k: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for k, t in docs.items()}
    assert all(words[k] == n for k, n in zip(got["doc_id"], got["mix_tokens"], strict=True))
    longest = max(words.values())
    assert sum(words.values()) <= got["mix_tokens"].sum() + 1 <= sum(words.values()) + 20 * longest + 1
    assert got["mix_order"].between(0, 1).all()


def test_licenses_against_brute_force(spark, docs):
    got = QUERIES["op6_license_scan"](spark, SMALL).toPandas().set_index("doc_id")
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    for k, t in docs.items():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        at = [(i, lab) for p, lab in phrases.items() for n in [len(p.split())] for i in range(len(words) - n + 1) if words[i : i + n] == p.split()]
        row = got.loc[k]
        assert (row["n_words"], row["n_base"], row["base_labels"]) == (len(words), len(at), ",".join(sorted({lab for _, lab in at})))
        if at:
            assert (row["first_word"], row["last_word"]) == (min(at)[0], max(at)[0])
        assert set(row["base_labels"].split(",")) <= set(row["labels"].split(",")) | {""}


def test_language_of_held_out_documents(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = QUERIES["op8_language_id"](spark, SMALL).toPandas()
    assert all(h == (zlib.crc32(str(k).encode()) % 3 == 1) for k, h in zip(got["doc_id"], got["held_out"], strict=True))
    held = got[got["held_out"]]
    assert (held["lang_pred"] == held["doc_id"].map(truth)).mean() >= 0.9
    assert got["score"].between(0, 1).all()


def test_urls_against_brute_force(spark):
    got = QUERIES["op5_url_filter"](spark, SMALL).toPandas().set_index("page_id")
    rules = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
    for r in spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "url").collect():
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", r["url"] or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [(len(x), x, v) for v, x in rules for h, _, p in [x.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        row = got.loc[r["page_id"]]
        assert (row["host"], row["path"]) == (host, path)
        if fits:
            assert (row["rule"], row["verdict"]) == max(fits)[1:]
        else:
            assert row["rule"] is None and row["verdict"] in ("allow", "block")


def _winnow(text, k=5, w=4):
    """The places that winnowing takes, by brute force over hashes that the query doesn't share."""
    words = text.lower().replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\f", " ").replace("\r", " ").split(" ")
    words = [x for x in words if x]
    return [tuple(words[i : i + k]) for i in range(max(len(words) - k + 1, min(1, len(words))))]


def test_fingerprints_against_brute_force(spark, docs):
    got = QUERIES["op10_document_fingerprints"](spark, SMALL).toPandas().set_index("doc_id")
    ids = sorted(docs, reverse=True)
    for i, k in enumerate(ids):
        t, nxt = docs[k], docs[ids[(i + 1) % len(ids)]]
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        row = got.loc[k]
        assert (row["n_chars"], row["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= row["near_next"] <= 1 and 0 <= row["near_edited"] <= 1
        a, b = set(_winnow(t)), set(_winnow(edited))
        if not a & b:
            assert row["near_edited"] == (1.0 if not a and not b else 0.0)
        m = len(_winnow(t))
        assert (m > 0) <= row["n_selected"] <= m
        if m >= 4:
            assert row["n_selected"] >= m // 4
    by_text = {}
    for k, t in docs.items():
        assert by_text.setdefault(t, got.loc[k, "fingerprint"]) == got.loc[k, "fingerprint"]
