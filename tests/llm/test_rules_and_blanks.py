"""URL rules of any form against str.startswith, and SentencePiece ids with U+2581 on both paths."""

import random

import pytest

from gridloom.llm import sentencepiece_codec, url_filter

HOSTS = ["com", "a.com", "b.a.com", "A.com", "x.net", "net", "", "co", "..com"]
PATHS = ["", "/", "en", "/en", "/en/", "/en/x", "//", "/en//", "e", "/e", "/en/xy", "x", None]


def _fits(rules, host, path):
    best = None
    for verdict, h, p in rules:
        h, p = ".".join(x for x in h.lower().split(".") if x), p or ""
        if host and (not h or host == h or host.endswith("." + h)) and path.startswith(p):
            key = (len(h + p), len(h), verdict == "block")
            if best is None or key > best[0]:
                best = (key, h + p, verdict)
    return best and best[1:]


def test_rules_of_any_form_equal_startswith(spark):
    rng = random.Random(8)
    urls = [f"https://{h}{p}{q}" for h in ["a.com", "b.a.com", "c.b.a.com", "xa.com", "x.net", "com", "co.", "a..com", "", "y.org"] for p in ["", "/", "/en", "/en/", "/en/x", "/en/xyz", "/e", "//", "/en//z", "/ene/x"] for q in ["", "?en", "#/en/"]]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate([*urls, None, "en/x", urls[3]])], "page_id long, url string")
    for seed in range(6):
        rng.seed(seed)
        rules = [(rng.choice(["allow", "block"]), rng.choice(HOSTS), rng.choice(PATHS)) for _ in range(rng.randint(1, 14))]
        trie = {r.page_id: r for r in url_filter.filter_urls(pages, rules).collect()}
        for r in trie.values():
            assert (r.rule and (r.rule, r.verdict)) == _fits(rules, r.host, r.path) or (r.rule == "" and _fits(rules, r.host, r.path) == ("", r.verdict)), (rules, r)
            assert r.rule is not None or r.verdict == "allow"
        joined = url_filter.filter_urls(pages, spark.createDataFrame(rules, "verdict string, host string, path string"), max_rule_bytes=-1)
        assert {r.page_id: tuple(r) for r in joined.collect()} == {i: tuple(r) for i, r in trie.items()}
        again = url_filter.filter_urls(pages, spark.createDataFrame(rules, "verdict string, host string, path string"))
        assert {r.page_id: tuple(r) for r in again.collect()} == {i: tuple(r) for i, r in trie.items()}


def test_many_rules_on_one_host_are_joined(spark):
    rules = [("block" if i % 2 else "allow", "a.com", f"/p{i}") for i in range(3000)]
    pages = spark.createDataFrame([(i, f"http://s.a.com/p{i}/x") for i in range(500)], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules, max_rule_bytes=1000).collect()}
    assert got == {i: (f"a.com/p{i}", "block" if i % 2 else "allow") for i in range(500)}


@pytest.mark.parametrize("chunk", [37, sentencepiece_codec.CHUNK])
def test_ids_with_the_blank_symbol_equal_the_library(spark, chunk):
    c = sentencepiece_codec.codec(sentencepiece_codec.MODEL)
    rng = random.Random(2)
    pool = ["▁", " ", "▁", " ", " ", "\n", "a", "the", "b", "é", "漢", "．", "1", "  "]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(1, 14))) for _ in range(4000 if chunk > 37 else 60)]
    texts += ["".join(rng.choice(pool) for _ in range(rng.randint(40, 160))) for _ in range(60)] + ["▁ ", " ▁", "▁", "▁a▁ b", "a▁ "]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.ids for r in sentencepiece_codec.encode(rows, chunk=chunk).collect()}
    want = c.sp.encode(texts, num_threads=1)
    assert [i for i, w in enumerate(want) if got[i] != w] == []
