"""Quality votes, token alignment and the conversation trie against brute force: nulls, ties, repeats, long texts, clashing columns."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from gridloom.llm import conversation_trie, quality, token_alignment
from gridloom.llm.common import held_out
from tests.llm.test_operators import DOCS, docs

POOL = ["a", "the", "ñ", "漢", "字", "😀", "‍", " ", "  ", "\n", "\t", " ", " ", ".", "'s", "<|endoftext|>", "▁", "é", "1", "23", "!!!", "<0x41>", "&&&", "\x1c", "\x85", "ﬁ", "thouea", "Éê", "</s>", "　", "🏽", "नम", "𝔘", " "]


# --- quality ----------------------------------------------------------------------------------


def _prose(rng):
    return " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(20, 80)))


@pytest.fixture(scope="module")
def quality_tables(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        t, good = _prose(rng), rng.random() < 0.7
        if not good:
            t = " ".join(w + rng.choice(["###", "$$$"]) for w in t.split()) if rng.random() < 0.5 else t.upper()
        rows.append((i, t))
        labels.append((i, int(good), 0))
    rows += [(400, None), (401, ""), (402, "  \n"), rows[0], (None, rows[1][1]), (403, rows[2][1] * 300)]
    labels += [labels[0], (None, 1, 0), (7, None, 0), (999_999, 1, 1)]
    return rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_held_out_accuracy_and_edges(spark, quality_tables):
    rows, labels = quality_tables
    d = docs(spark, rows)
    model = quality.fit(d, labels, dims=16)
    got = quality.score_quality(d, model).collect()
    assert len(got) == len(rows)
    truth = {r.doc_id: r.quality for r in labels.collect() if r.doc_id is not None}
    checked = [r.predicted == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth and truth[r.doc_id] is not None]
    assert len(checked) > 60 and np.mean(checked) > 0.95
    assert all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r for r in got}
    assert by_id[400].score == by_id[401].score == by_id[402].score == pytest.approx(model["base"])
    assert by_id[403].predicted == by_id[2].predicted
    kept = quality.keep_quality(d, model).collect()
    assert len(kept) == sum(r.predicted for r in got) and kept[0].asDict().keys() == d.collect()[0].asDict().keys()


def test_quality_votes_equal_brute_force(quality_tables, spark):
    rows, labels = quality_tables
    model = quality.fit(docs(spark, rows), labels, dims=16, max_rows=100)
    assert 30 < len(model["vectors"]) < 250
    texts = [t or "" for _, t in rows[:60]] + [""]
    z = quality.vectors(texts, model)
    k = 7
    for v, s in zip(z, quality.vote(z, model, k), strict=True):
        sims = sorted(((float(v @ u), y, w) for u, y, w in zip(model["vectors"], model["labels"], model["weights"], strict=True)), reverse=True)
        near = [x for x in sims[:k] if x[0] > 1e-6]
        total = sum(a * w for a, _, w in near)
        want = sum(a * w * y for a, y, w in near) / total if total else model["base"]
        assert s == pytest.approx(want, abs=1e-4)


def test_quality_terms_hold_words_shapes_and_repeats():
    row, term, share = quality.terms(["Abc abc x9!! abc", "", "abc"])
    assert set(row.tolist()) == {0, 2}
    first = dict(zip(term[row == 0].tolist(), share[row == 0].tolist(), strict=True))
    assert first[quality._REPEATED] == pytest.approx(0.5)  # the second and the fourth word
    words = {t: s for t, s in first.items() if t < quality._HALF}
    assert sorted(words.values()) == pytest.approx([0.25, 0.75])
    assert quality._shape(b"Abc x9!! zz") == b"Aa a0! a"


def test_quality_without_labels_or_rows(spark, quality_tables):
    rows, labels = quality_tables
    d = docs(spark, rows[:5])
    model = quality.fit(d, labels.where("false"))
    assert {r.score for r in quality.score_quality(d, model).collect()} == {0.5}
    empty = docs(spark, [])
    assert quality.score_quality(empty, quality.fit(empty, labels)).count() == 0


def test_quality_learns_nothing_from_held_out_labels(spark, quality_tables):
    rows, labels = quality_tables
    d = docs(spark, rows)
    flipped = labels.selectExpr("doc_id", "case when pmod(crc32(coalesce(cast(doc_id as string), '')), 4) = 2 then 1 - quality else quality end as quality")
    a, b = (quality.score_quality(d, quality.fit(d, x, dims=8)).select("score").collect() for x in (labels, flipped))
    assert np.allclose([r[0] for r in a], [r[0] for r in b], atol=1e-5)
    assert labels.where(held_out()).count() > 0


# --- token alignment --------------------------------------------------------------------------


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(token_alignment.A_FILE)
    a.encode_special_tokens = True
    al = token_alignment.Aligner(token_alignment.A_FILE, token_alignment.B_FILE)
    return a, sentencepiece.SentencePieceProcessor(model_file=token_alignment.B_FILE), al


def _aligned(libraries, text):
    """What the libraries make of the whole text: ids, ends, groups, links of id pairs; None if the bytes differ."""
    tok, sp, al = libraries
    a, b = tok.encode(" " + (text or ""), add_special_tokens=False).ids, sp.encode(text or "")
    bytes_a, bytes_b = [al.a_bytes[i] for i in a], [al.b_bytes[i] for i in b]
    if not text or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return None
    ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
    groups, links, x, y = [], Counter(), 0, 0
    for c in sorted(set(ends_a) & set(ends_b)):
        i, j = ends_a.index(c) + 1, ends_b.index(c) + 1
        groups.append((a[x:i], b[y:j]))
        links.update((p, q) for p in a[x:i] for q in b[y:j])
        x, y = i, j
    return a, ends_a, b, ends_b, groups, links


def test_alignment_equals_the_libraries(spark, libraries, monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice(POOL) for _ in range(rng.randint(0, 25))) for _ in range(700)]
    texts += [None, "", " ", "x", "one two", "one two", "漢" * 40, "a b " * 200, "😀" * 30 + " z", "<|endoftext|>", "▁"]
    d = docs(spark, [(i, t) for i, t in enumerate(texts)] + [(None, "one two")])
    got = {r.doc_id: r for r in token_alignment.align(d.repartition(3), block=3000).collect()}
    want = {i: _aligned(libraries, t) for i, t in enumerate(texts)} | {None: _aligned(libraries, "one two")}
    assert got.keys() == want.keys()
    count = Counter(p for v in want.values() if v for p in v[5])
    top: dict[int, int] = {}
    for (a, _), n in count.items():
        top[a] = max(top.get(a, 0), n)
    assert sum(v is None for v in want.values()) > 20 and sum(v is not None for v in want.values()) > 300
    for i, v in want.items():
        r = got[i]
        if v is None:
            assert tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "")
            continue
        a, _, b, _, groups, links = v
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        best = sum(m for p, m in links.items() if count[p] == top[p[0]])
        assert tuple(r)[1:] == (len(a), len(b), len(groups), sum(links.values()), best, sum(m * count[p] for p, m in links.items()), hashlib.sha256(text.encode()).hexdigest())


def test_alignment_of_long_texts_in_parts(libraries, monkeypatch):
    rng = random.Random(6)
    monkeypatch.setattr(token_alignment, "PART", 40)
    monkeypatch.setattr(token_alignment, "WORDS", 60)
    texts = ["".join(rng.choice(POOL[:14]) for _ in range(n)) for n in [*[rng.randint(100, 400) for _ in range(60)], 3000]]
    block = token_alignment._Block(token_alignment.Aligner(token_alignment.A_FILE, token_alignment.B_FILE))
    block.add(texts)
    counts, digests, places, links, pairs, n = block.rows()
    for i, t in enumerate(texts):
        v = _aligned(libraries, t)
        a, _, b, _, groups, want = v
        assert counts[i].tolist() == [len(a), len(b), len(groups), sum(want.values())]
        assert digests[i] == hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups).encode()).hexdigest()
        found = {divmod(int(pairs[p]), 1 << 20): int(m) for p, m in zip(np.frombuffer(places[i], "<i4"), np.frombuffer(links[i], "<i8"), strict=True)}
        assert found == dict(want)
    assert n.tolist() == [sum(divmod(int(p), 1 << 20) in _aligned(libraries, t)[5] for t in texts) for p in pairs[:5]] + n.tolist()[5:]


def test_token_spans(spark, libraries):
    texts = ["añ b\n\n 漢字😀 x", "one  two", None, "▁", "a b c"]
    got = token_alignment.token_spans(docs(spark, list(enumerate(texts)))).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        v = _aligned(libraries, t)
        assert (r.a_ids, r.a_ends, r.b_ids, r.b_ends) == (([], [], [], []) if v is None else v[:4])


def test_alignment_of_an_empty_table_and_missing_files(spark):
    assert token_alignment.align(docs(spark, [])).count() == 0
    with pytest.raises(FileNotFoundError):
        token_alignment.align(docs(spark, []), a_file="/nowhere.json")


def test_alignment_of_megabytes(spark, libraries):
    text = "Thouea erly añ 漢字, the!! " * 100_000
    r = token_alignment.align(docs(spark, [(1, text), (2, "x" * 50_000)])).where("doc_id = 1").first()
    short = token_alignment.align(docs(spark, [(1, text[:2600])])).first()
    assert r.n_a > 900 * short.n_a and r.n_links > 900 * short.n_links


# --- conversation trie ------------------------------------------------------------------------

CONV = "conv_id long, turn long, role string, text string, conv int, depth string, n int"


def _conversations(seed, n, texts=3, longest=7):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        c = rng.randint(0, 450)
        rows += [(c, rng.choice([None, *range(6)]), rng.choice(["user", "assistant", None]), rng.choice([None, "", "hé", *["t" * k for k in range(texts)]]), 1, "d", 2) for _ in range(rng.randint(0, longest))]
    return rows


def _trie(rows):
    turns: dict[int, list] = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            r, t = role or "", text or ""
            digest = hashlib.md5(f"{len(r)} {r}{t}".encode()).hexdigest()
            turns.setdefault(c, []).append(((turn is not None, turn or 0), digest, (r, t)))
    listed = {c: [x[2] for x in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, own in listed.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = listed.get(c - c % 100, [])[:h] + own[h:]
    nodes: dict[tuple, list] = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append(c)
    kids = Counter(k[:-1] for k in nodes if k)
    leaves, saved = Counter(), Counter()
    for k, members in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(members) - 1) * (len(k[-1][1]) if k else 0)
    out = set()
    for k, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if built[c] == list(k))))
        out.add((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), kids[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("local_nodes", [2, 9, 50_000])
def test_trie_equals_brute_force(spark, local_nodes):
    rows = _conversations(local_nodes, 120)
    rows += [rows[0], rows[0], (None, 1, "user", "x", 1, "d", 2), (None, None, None, None, 1, "d", 2)]
    got = conversation_trie.prefix_trie(spark.createDataFrame(rows, CONV), local_nodes=local_nodes).drop("x1", "x2").collect()
    want = _trie(rows)
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_trie_of_a_long_conversation_and_equal_ones(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "BLOCK", 16)
    rows = [(7, i, "user", f"t{i % 5}", 1, "d", 2) for i in range(300)] + [(c, i, "user", "same", 1, "d", 2) for c in range(101, 180) for i in range(9)]
    got = conversation_trie.prefix_trie(spark.createDataFrame(rows, CONV), local_nodes=40).drop("x1", "x2").collect()
    assert {tuple(r) for r in got} == _trie(rows)
    shared = conversation_trie.shared_prefixes(conversation_trie.prefix_trie(spark.createDataFrame(rows, CONV)), 5).collect()
    assert shared and all(r.n_convs >= 5 for r in shared)


def test_trie_without_conversations(spark):
    assert conversation_trie.prefix_trie(spark.createDataFrame([], CONV)).count() == 0
    alone = conversation_trie.prefix_trie(spark.createDataFrame([(None, 1, "a", "b", 1, "d", 2)], CONV))
    assert alone.count() == 0


def test_centroid_rounds_equal_plain_sums():
    rng = np.random.default_rng(3)
    for shape in ("random", "chain", "star"):
        n = 300
        parent = np.array([-1, *(rng.integers(0, i) if shape == "random" else i - 1 if shape == "chain" else 0 for i in range(1, n))])
        parent[150] = -1
        top = np.zeros(n, np.int64)
        for i in range(n):
            top[i] = i if parent[i] < 0 else top[parent[i]]
        values = rng.integers(-9, 9, (n, 2))
        want, w = values.copy(), np.ones(n, np.int64)
        for i in range(n - 1, 0, -1):
            if parent[i] >= 0:
                want[parent[i]] += want[i]
                w[parent[i]] += w[i]
        assert (conversation_trie.solve(top, parent, w, values) == want).all()
