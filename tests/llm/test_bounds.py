"""Items beyond one broadcast and texts beyond one block: the results of the plain ways."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from gridloom.llm import decontaminate, language, words
from tests.llm.test_operators import docs


@pytest.fixture(scope="module")
def leaks(spark):
    rng = random.Random(12)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 25)))) for i in range(60)] + [(60, None), (61, ""), (None, "w1 w2 w3"), (3, "w9 w8 w7 w6")]
    rows = []
    for i in range(120):
        words = [rng.choice(vocab) for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.5:
            piece = (rng.choice(items)[1] or "").split()
            for _ in range(rng.randint(0, 3)):
                if piece:
                    piece[rng.randrange(len(piece))] = "zz"
            words[3:3] = piece
        rows.append((i, " ".join(words)))
    rows += [(500, None), (501, ""), rows[0], (None, rows[1][1]), (502, " ".join(t for _, t in rows if t) * 3)]
    return rows, spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("candidates", [2000, 3])
def test_joined_items_match_like_broadcast_ones(spark, leaks, monkeypatch, candidates):
    rows, items = leaks
    d = docs(spark, rows)
    want = Counter(map(str, decontaminate.contaminated(d, items).collect()))
    clean = Counter(map(str, decontaminate.drop_contaminated(d, items).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 10)
    monkeypatch.setattr(decontaminate, "CANDIDATES", candidates)
    assert Counter(map(str, decontaminate.contaminated(d, items).collect())) == want and len(want) > 50
    assert Counter(map(str, decontaminate.drop_contaminated(d.withColumnRenamed("held_out", "_uid"), items).drop("_uid").collect())) == Counter(map(str, [r for r in decontaminate.drop_contaminated(d, items).drop("held_out").collect()]))
    assert Counter(map(str, decontaminate.drop_contaminated(d, items).collect())) == clean and 0 < sum(clean.values()) < len(rows)
    assert decontaminate.contaminated(d.limit(0), items).count() == 0


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(8)
    kinds = {"aa": "banana kaboba nabaka".split(), "bb": "ditto mitti tidom".split(), "ru": "привет мир слово".split()}
    rows = [(i, " ".join(rng.choice(kinds[k]) for _ in range(rng.randint(3, 30))), k) for i, k in enumerate(rng.choice(list(kinds)) for _ in range(200))]
    return language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string")), kinds


def _mixed(rng, kinds, n):
    words = []
    while len(words) < n:
        words += [rng.choice(kinds[k]) for k in [rng.choice(list(kinds))] for _ in range(rng.randint(1, 12))]
    return "".join(w.title() * (rng.random() < 0.3) or w for w in words[:1]) + "".join(rng.choice([" ", ", ", "\n", " 12 ", "! "]) + w for w in words[1:n])


def test_blocks_of_a_long_text_label_like_the_whole(model):
    m, kinds = model
    rng = random.Random(3)
    texts = [_mixed(rng, kinds, rng.randint(1, 300)) for _ in range(60)] + ["", "123 !!", "x" * 300, "ΑΣ ΑΣ. Σ " * 20]
    want = language.identify(texts, m, 12.0)
    for most in (1, 7, 50, 400):
        got = language.identify(texts, m, 12.0, giant=most)
        assert [g[0] for g in got] == [w[0] for w in want]
        assert np.allclose([g[1] for g in got], [w[1] for w in want])


def test_scores_equal_a_plain_count(spark):
    """Fitted probabilities, script narrowing, Viterbi and the score, from a plain program over the same samples."""
    import math

    rows = [(i, t, k) for i, (t, k) in enumerate([("abba baba", "p"), ("acca caca ab", "q"), ("где где", "r"), ("abca", "p"), ("caba", "q")] * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = language.fit(df)
    seen = {}
    for i, t, k in rows:
        if not df.sparkSession.createDataFrame([(i,)], "doc_id long").select(language.held_out()).first()[0]:
            seen.setdefault(k, set()).add(t)

    def grams(word):
        c = [0, *map(ord, word), 0]
        for j in range(1, len(c)):
            yield ("1", c[j])
            yield ("2", c[j - 1], c[j])
            yield ("3", *(c[j - 2 : j] if j >= 2 and c[j - 1] else (0, c[j - 1])), c[j])

    counts = {k: {n: Counter(g for t in ts for w in t.split() for g in grams(w) if g[0] == n) for n in "123"} for k, ts in seen.items()}
    langs = sorted(counts)
    assert m["langs"] == langs

    def score(word, k):
        return sum(math.log((counts[k][g[0]][g] + 0.2) / (sum(counts[k][g[0]].values()) + 0.2 * (1 << language.BITS))) for g in grams(word))

    for text in ["abba acca", "caca baba ab", "где abba", "abca где где caca caca caca"]:
        words = text.split()
        fits = [[k for k in langs if (ord(w[0]) > 1000) == (k == "r")] for w in words]
        best = None
        import itertools

        for labels in itertools.product(*fits):
            total = sum(score(w, k) for w, k in zip(words, labels, strict=True)) - 12.0 * sum(a != b for a, b in itertools.pairwise(labels))
            if best is None or total > best[0]:
                best = (total, labels)
        share = Counter()
        for w, k in zip(words, best[1], strict=True):
            share[k] += len(w)
        top = max(share.values())
        got = language.identify([text], m, 12.0)[0]
        assert got[1] == pytest.approx(top / sum(share.values())) and share[got[0]] == top


def test_a_giant_text_stays_within_its_block(model):
    m, kinds = model
    text = _mixed(random.Random(1), kinds, 20_000) * 6
    assert len(text) > 800_000
    language.identify(["warm up"], m, 12.0)
    tracemalloc.start()
    got = language.identify([text], m, 12.0, giant=50_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20 and got[0][0] in kinds


def test_pieces_of_texts_with_words_longer_than_a_block(monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a", "é", "bb"]) * rng.choice([1, 3, 40]) + rng.choice(["", "", " ", "\n", "\v", "\t "]) for _ in range(rng.randint(0, 60))).encode() for _ in range(200)]
    want = words.hash_words(texts)
    for block in (8, 33, 100):
        monkeypatch.setattr(words, "_BLOCK", block)
        got = words.hash_words(texts)
        assert all((x == y).all() for x, y in zip(got, want, strict=True))
        assert all(b"".join(words._cut(t)) == t for t in texts)
