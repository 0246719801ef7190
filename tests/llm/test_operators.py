"""The corpus operators against brute force on small tables: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from gridloom.llm import decontaminate, exact_dedup, jaccard_join, language, sentencepiece_codec, sharding, substring_dedup, toxicity, url_filter, warc, words
from gridloom.llm.components import connected_components
from gridloom.llm.common import held_out

DOCS = "doc_id long, text string, row long, held_out string, n int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 5, "x", 1) for i, t in rows], DOCS)


def sample_texts(seed=1):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 120))) for _ in range(25)]
    out = list(base)
    for t in base[:12]:
        for _ in range(rng.randint(1, 6)):
            w = t.split()
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            out.append(rng.choice([" ", "\n", "\t "]).join(w))
    passage = " ".join(rng.choice(vocab) for _ in range(45))
    out += [f"{a} {passage} {b}" for a, b in zip(base[12:18], base[18:24], strict=True)]
    out += ["", None, "  \n", "One two", "one TWO", "a b c d e", "a b c d", passage, base[0], base[0]]
    rng.shuffle(out)
    rows = list(enumerate(out))
    return [*rows, rows[3], (None, base[1]), (None, None), (7_000_000_000, base[2])]


def test_word_hashes_match_split():
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab \t\n\v\f\ré") for _ in range(rng.randint(0, 60))).encode() for _ in range(300)]
    texts += [b"x" * 1_200_000 + b" y", (b"ab cd\n" * 200_000), b""]
    h, o = words.hash_words(texts)
    flat = [w for t in texts for w in t.split()]
    assert np.diff(o).tolist() == [len(t.split()) for t in texts]
    seen = {}
    for w, x in zip(flat, h.tolist(), strict=True):
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)
    w = words.windows(h[:1000], 5)
    assert len(w) == 996 and len(set(w.tolist())) == len({tuple(h[i : i + 5].tolist()) for i in range(996)})


@pytest.mark.parametrize("n", [0, 1, 2, 39, 40, 41, 700])
def test_sharding_is_a_gapless_permutation(spark, n):
    got = sharding.shard_rows(docs(spark, [(i, f"text {i} é") for i in range(n)])).collect()
    assert len(got) == n
    per = Counter(r.shard for r in got)
    assert not per or max(per.values()) - min(per.values() if len(per) == 40 else [0]) <= 1
    for s in per:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(per[s]))
    for r in got:
        t = f"text {r.doc_id} é".encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(t) + 16, zlib.crc32(t), "rows", None)


def test_sharding_repeated_and_null_rows_and_reproducible(spark):
    rows = [(1, "same")] * 500 + [(None, None)] * 3 + [(2, "")]
    a = sorted(map(str, sharding.shard_rows(docs(spark, rows)).collect()))
    random.Random(1).shuffle(rows)
    b = sorted(map(str, sharding.shard_rows(docs(spark, rows).repartition(7)).collect()))
    assert a == b and len(a) == 504
    got = sharding.shard_rows(docs(spark, rows)).collect()
    assert sorted((r.shard, r.slot) for r in got) == sorted((i % 40, i // 40) for i in range(504))
    assert next(r for r in got if r.doc_id is None).size == 16


def feistel(x, a, b, seed, rounds=6):
    """The permutation again, from its definition."""
    prime, keys, z = 2147483647, [], seed % 2147483647
    for _ in range(rounds):
        z = (z * 48271 + 11) % prime
        k = z
        z = (z * 48271 + 11) % prime
        keys.append((k, 1 + z % (prime - 1)))
    left, right = divmod(x, b)
    for i, (k, m) in enumerate(keys):
        other, size = (right, a) if i % 2 == 0 else (left, b)
        t = (other + k) % prime
        shift = (t * t % prime * m + other) % prime
        left, right = ((left + shift) % size, right) if i % 2 == 0 else (left, (right + shift) % size)
    return left * b + right


@pytest.mark.parametrize("n", [1, 5, 90, 1000])
def test_shard_and_slot_equal_brute_force(spark, n):
    import math

    df = docs(spark, [(i, f"t{i}") for i in range(n)])
    x = {r.doc_id: r["_x"] for r in sharding.numbered_rows(df, bucket_rows=7).collect()}
    assert sorted(x.values()) == list(range(n))
    a = max(1, math.ceil(math.sqrt(n)))
    b = -(-n // a)
    assert sorted(feistel(i, a, b, 20260101) for i in range(a * b)) == list(range(a * b))
    for r in sharding.shard_rows(df, bucket_rows=7).collect():
        p = feistel(x[r.doc_id], a, b, 20260101)
        while p >= n:
            p = feistel(p, a, b, 20260101)
        assert (r.shard, r.slot) == (p % 40, p // 40)


def test_cycle_walk_leaves_no_gap(spark):
    """A grid much larger than the count: most rows walk, some beyond the single steps."""
    from pyspark.sql import functions as F

    df = spark.range(30).select(F.col("id").alias("_x"), F.lit(30).cast("long").alias("_total"), F.lit(40).cast("long").alias("_a"), F.lit(30).cast("long").alias("_b"))
    got = {r["_x"]: r["_p"] for r in sharding.walk(sharding.permute(df, "_x", "_y", 3), 3).collect()}
    for x, p in got.items():
        y = feistel(x, 40, 30, 3)
        while y >= 30:
            y = feistel(y, 40, 30, 3)
        assert p == y
    assert sorted(got.values()) == list(range(30))


def test_feistel_forms_agree(spark):
    from pyspark.sql import functions as F

    df = spark.range(7 * 9).select("id", F.lit(7).cast("long").alias("_a"), F.lit(9).cast("long").alias("_b"))
    got = sharding.permute(df, "id", "y", 5).withColumn("z", sharding.permute_value(F.col("id"), F.col("_a"), F.col("_b"), 5)).collect()
    assert sorted(r.y for r in got) == list(range(63)) and all(r.y == r.z for r in got)


def brute_components(rows):
    sets = []
    for i, (d, t) in enumerate(rows):
        w = (t or "").encode().lower().split()
        sets.append((d, frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    best = {}
    for i, (d, s) in enumerate(sets):
        if s and d is not None:
            best[find(i)] = min(best.get(find(i), d), d)
    return sorted((str(d), len(s), str(best.get(find(i)) if s else d)) for i, (d, s) in enumerate(sets))


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_join(spark, seed, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HEAVY", 4)
    monkeypatch.setattr(jaccard_join, "LIST_ROWS", 3)
    rows = sample_texts(seed)
    got = jaccard_join.ngram_jaccard_join(docs(spark, rows), row_col="row").collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_components(rows)
    assert all(r.row == 5 for r in got)


def test_jaccard_join_family_of_near_copies(spark):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(90)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(i % 6):
            w[rng.randrange(90)] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = jaccard_join.ngram_jaccard_join(docs(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_components(rows)


def test_jaccard_join_of_short_texts_with_a_common_shingle(spark, monkeypatch):
    """One shingle in many unrelated short texts of all sizes, some of them linked only among themselves."""
    monkeypatch.setattr(jaccard_join, "LIST_ROWS", 10)
    rng = random.Random(6)
    common = "the licence of this text is"
    rows = [(i, common + " " + " ".join(f"u{rng.randrange(8)}" for _ in range(rng.randint(0, 9)))) for i in range(120)]
    rows += [(200 + i, common + " open " + "x " * i) for i in range(12)] + [(300, "x" * 400_000 + " y"), (301, None)]
    got = jaccard_join.ngram_jaccard_join(docs(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_components(rows)


def test_jaccard_join_empty(spark):
    assert jaccard_join.ngram_jaccard_join(docs(spark, [])).collect() == []
    assert [tuple(r)[:3] for r in jaccard_join.ngram_jaccard_join(docs(spark, [(1, None)])).collect()] == [(1, 0, 1)]


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(300, 300)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    near = {}
    for a, b in links:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for start in near:
        seen, todo = {start}, [start]
        while todo:
            for y in near[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        assert got[start] == min(seen)
    assert set(got) == set(near)


@pytest.fixture(scope="module")
def codec():
    return sentencepiece_codec.codec(sentencepiece_codec.MODEL)


def test_codec_equals_library(codec):
    for s in ["", " ", "  ", "a ", " a", "a  b", "\n", "a\n b ", "🙂 x", "   ", "Ünder the sea,  twice\t!", "x" * 300]:
        assert codec.encode([s])[0] == codec.sp.encode(s)


def test_boundary_state_scan_equals_library(codec):
    """Matrices of chunks cut anywhere, combined in any order, and independent backtraces."""
    from functools import reduce

    rng = random.Random(4)
    P = sentencepiece_codec.product
    texts = ["".join(rng.choice("abcdetheingstion_éß🙂1\n" + "  " * k) for _ in range(rng.randint(1, 60))) for k in range(4) for _ in range(60)]
    for s in [*texts, " " * 40, ".................................." * 3, "the " * 30, "▁a▁ b"]:
        chunks = sentencepiece_codec.cut_text(s, rng.randint(3, 40), codec.longest)
        ms = [codec.matrix(c) for c in chunks]
        at = rng.randint(0, len(ms))
        whole = reduce(P, ms)
        assert whole.shape == (1, 1) and whole[0, 0] == 0
        if 0 < at < len(ms):
            assert (P(reduce(P, ms[:at]), reduce(P, ms[at:])) == whole).all()
        states = sentencepiece_codec.inner_states(ms, 0, 0)
        parts = [codec.backtrace(c, i, o) for c, i, o in zip(chunks, states, states[1:], strict=False)]
        assert [i for ids, _ in parts for i in ids] == codec.sp.encode(s), s
        assert "".join(t for _, t in parts) == " " + s


def test_giant_text_without_blanks_is_spread(spark, codec, monkeypatch):
    monkeypatch.setattr(sentencepiece_codec, "FAN_IN", 3)
    rng = random.Random(5)
    rows = [(1, "".join(rng.choice("thequickbrownfoxéß🙂") for _ in range(999))), (2, " ".join("w" * rng.randint(1, 30) for _ in range(200))), (3, "漢字かな" * 300), (3, " " * 900)]
    seen = []
    real = sentencepiece_codec.chunk_states
    monkeypatch.setattr(sentencepiece_codec, "chunk_states", lambda m: (seen.append(m), real(m))[1])
    got = sorted((r.doc_id, r.ids, r.round_trip) for r in sentencepiece_codec.encode(docs(spark, rows), chunk=100).collect())
    assert got == sorted((d, codec.sp.encode(t), True) for d, t in rows)
    per = Counter(r["_uid"] for r in seen[0].select("_uid").collect())
    assert sorted(per.values()) == sorted(-(-(len(t) + 1) // 100) for _, t in rows)


def test_sentencepiece_operator(spark, codec):
    long = " ".join(f"word{i} the" for i in range(300)) + " " + "thisisonelongword" * 20 + "  end"
    rows = [(1, "hello world"), (2, None), (3, ""), (4, long), (4, long), (None, "x")]
    out = sentencepiece_codec.encode(docs(spark, rows), chunk=64, keep=["row"])
    got = sorted(((str(r.doc_id), r.ids, r.n_tokens, r.ids_sha256, r.round_trip, r.row) for r in out.collect()), key=str)
    want = []
    for d, t in rows:
        ids = codec.sp.encode(t or "")
        want.append((str(d), ids, len(ids), hashlib.sha256(np.asarray(ids, "<i4").tobytes()).hexdigest(), True, 5))
    assert got == sorted(want, key=str)
    back = {r.doc_id: r.text for r in sentencepiece_codec.decode(out.where("doc_id in (1, 4)")).collect()}
    assert back == {1: "hello world", 4: long}
    odd = spark.createDataFrame([(1, None), (None, [codec.blank]), (2, [])], "doc_id long, ids array<int>")
    assert sorted(map(tuple, sentencepiece_codec.decode(odd).collect()), key=str) == [(1, None), (2, ""), (None, "")]
    assert sentencepiece_codec.encode(docs(spark, [])).collect() == []


def brute_warc(rows):
    """(page_id, bytes, digest, type, refers_to) of each (page_id, url, html)."""
    top = {}
    for i, _, h in rows:
        top[h or ""] = max(top.get(h or "", -1), -1 if i is None else i)
    want, used = [], set()
    for i, _, h in sorted(rows, key=lambda r: (-1 if r[0] is None else r[0])):
        b = (h or "").encode()
        first = (-1 if i is None else i) == top[h or ""] and (h or "") not in used
        if first:
            used.add(h or "")
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if first else "revisit", None if first or top[h or ""] < 0 else top[h or ""]))
    return sorted(map(str, want))


PAGES = "page_id long, url string, html string, value string, _key string, _first int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "v", "k", 1) for r in rows], PAGES)


def test_warc_round_trip(spark):
    fake = "<p>WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n</p>"
    html = ["a", "a", "", None, fake, fake, "é\r\n\r\nx\r\n", "tail\r\n\r\n", "\r\n\r\n\r\nWARC/1.0\r\nContent-Length: 0\r\n\r\n", "a", "HTTP/1.1 200\r\n\r\nnested", "z" * 300_000]
    rows = [(i, f"http://h/{i} ?\r\n" if i % 2 else None, h) for i, h in enumerate(html)] + [(0, "http://h/0", "a"), (None, "u", "alone"), (None, None, "alone"), (50, "u", "twice"), (50, "u", "twice"), (50, "v", "twice")]
    df = pages(spark, rows)
    assert sorted(str(tuple(r)) for r in warc.warc_round_trip(df).collect()) == brute_warc(rows)
    assert warc.warc_round_trip(df.limit(0)).collect() == []


def test_warc_of_shuffled_input(spark, tmp_path):
    """Rows whose place differs each time that Spark evaluates them."""
    rng = random.Random(11)
    rows = [(i, "u", f"page {i // 2} " * 20) for i in range(600)] + [(7, "u", "page 3 " * 20)] * 5
    rng.shuffle(rows)
    pages(spark, rows).write.parquet(str(tmp_path / "p"))
    stored = spark.read.parquet(str(tmp_path / "p"))
    for df in (stored.repartition(6), pages(spark, rows).repartition(5), stored.orderBy("html"), stored.unionByName(stored.limit(0)).repartition(3, "url")):
        assert sorted(str(tuple(r)) for r in warc.warc_round_trip(df).collect()) == brute_warc(rows)


def test_warc_returns_payloads_and_splits_archives(spark, tmp_path):
    df = spark.createDataFrame([(i, "http://h", f"page {i} " * 50) for i in range(30)], "page_id long, url string, html string")
    warc.write_warc(df.coalesce(1), str(tmp_path / "w"), file_bytes=1500)
    files = list((tmp_path / "w").glob("*.warc.gz"))
    assert len(files) > 3 and not (tmp_path / "w" / "_writing").exists()
    for size in (64, 1000, 1 << 20):
        got = {r.page_id: r.payload.decode() for r in warc.read_warc(spark, str(tmp_path / "w"), payload=True, block_bytes=size).collect()}
        assert got == {i: f"page {i} " * 50 for i in range(30)}


def test_warc_folders(tmp_path):
    for name in (str(tmp_path), f"file://{tmp_path}", f"file:{tmp_path}"):
        assert warc._folder(name)[1].rstrip("/") == str(tmp_path)


def test_warc_records_are_gzip_members(spark, tmp_path):
    import gzip
    import zlib as z

    df = spark.createDataFrame([(i, "http://h", f"page {i}") for i in range(9)], "page_id long, url string, html string")
    warc.write_warc(df.coalesce(1), str(tmp_path / "w"))
    n = 0
    for f in (tmp_path / "w").glob("*.warc.gz"):
        data = f.read_bytes()
        whole = gzip.decompress(data)
        while data:
            d = z.decompressobj(31)
            assert d.decompress(data).startswith(b"WARC/1.1\r\n")
            data, n = d.unused_data, n + 1
        assert whole.count(b"WARC/1.1\r\n") <= 9
    assert n == 9


def test_false_candidates_cost_offsets_only():
    import time

    fake = b"WARC/1.1\r\nContent-Length: 900000000\r\n\r\n" * 20_000
    record = lambda body: b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    data = b"".join(record(x) + b"\r\n\r\n" for x in (b"one", fake, b"WARC/1.1\r\n" * 50_000, b"two"))
    began = time.time()
    got = list(warc._records((("f", p) for p in data[:-4].split(b"\r\n\r\n")), False, 1 << 16))
    assert [r[7] for r in got] == [3, len(fake), 10 * 50_000, 3] and time.time() - began < 10
    cut = list(warc._records((("f", p) for p in data[:-9].split(b"\r\n\r\n")), False, 1 << 16))
    assert len(cut) >= 3


def test_pointer_jumping_equals_walking():
    rng = random.Random(12)
    for _ in range(200):
        starts = sorted(rng.sample(range(100), rng.randint(1, 40)))
        succ = [s + rng.randint(1, 20) for s in starts]
        entry = rng.choice([0, starts[0], rng.randrange(100)])
        want, at, of = [], entry, dict(zip(starts, succ, strict=True))
        while at in of:
            want.append(starts.index(at))
            at = of[at]
        assert warc.jump(np.array(starts), np.array(succ), entry).tolist() == want


def brute_substrings(rows, size):
    texts = [(d, (t or "").encode().split()) for d, t in rows]
    seen = Counter(tuple(w[i : i + size]) for _, w in texts for i in range(len(w) - size + 1))
    out = []
    for d, w in texts:
        gone = set()
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone.update(range(i, i + size))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((str(d), len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_substring_dedup(spark, seed, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CUT_BITS", 3)
    monkeypatch.setattr(substring_dedup, "HEAVY", 3)
    rows = sample_texts(seed) + [(900, "again and " * 60), (901, " ".join(f"z{i}" for i in range(40)) + " mid " + " ".join(f"z{i}" for i in range(40)))]
    got = substring_dedup.substring_dedup(docs(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_substrings(rows, 35)


def test_paths_are_told_apart_by_their_words():
    """Equal rolling hashes don't make equal paths or windows."""
    out = substring_dedup._Source("a b\tcd  e")
    assert out.digests(np.array([0, 1]), np.array([2, 4]), 4) == [hashlib.blake2b(x, digest_size=4).digest() for x in (b"a b", b"b cd e")]
    same, live = np.zeros(40, np.uint64), np.ones(6, bool)
    one, two = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    digest = lambda t: substring_dedup._paths(t, same, live, 35)[0]
    assert digest(one) == digest(one.replace(" ", "\n ")) and not set(digest(one)) & set(digest(two))


def test_substring_dedup_of_a_long_periodic_text(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(f"{rng.randrange(10**9)}" for _ in range(90))) for i in range(4)]
    rows += [(9, rows[0][1].replace(" ", "\n")), (10, "x " + " ".join(rows[1][1].split()[10:60]) + " y"), (11, "a " * 20_000 + rows[2][1])]
    got = substring_dedup.substring_dedup(docs(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_substrings(rows, 35)


def test_substring_dedup_empty(spark):
    assert substring_dedup.substring_dedup(docs(spark, [])).collect() == []
    assert [(r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(docs(spark, [(1, None)]), texts=True).collect()] == [(0, 0)]


def distance(a, b):
    """Least edits of a to any substring of b."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [row[0] + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_myers_equals_dynamic_programming():
    rng = random.Random(6)
    for _ in range(300):
        a, b = [rng.randrange(4) for _ in range(rng.randint(1, 90))], [rng.randrange(4) for _ in range(rng.randint(0, 60))]
        assert decontaminate.myers(a, b)[0] == distance(a, b)


def test_decontamination(spark):
    rng = random.Random(7)
    vocab = [f"v{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(n))) for i, n in enumerate([1, 4, 12, 25, 40, 33])] + [(9, None), (10, "..."), (None, "solo item words")]
    rows = []
    for i in range(60):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 50))]
        if i % 2:
            p = (items[rng.randrange(2, 6)][1]).split()
            for _ in range(rng.randint(0, 9)):
                k = rng.randrange(len(p))
                p[k : k + 1] = rng.choice([[], [rng.choice(vocab).upper()], [p[k], "extra"]])
            w[len(w) // 2 : len(w) // 2] = p
        rows.append((i, ", ".join(w)))
    rows += [(70, None), (None, "Solo, ITEM words!"), (3, rows[3][1])]
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    got = sorted(str((r.doc_id, r.item_id, r.distance)) for r in decontaminate.contaminated(docs(spark, rows), bench).collect())
    want = []
    for d, t in rows:
        w = decontaminate.normalised(t or "").split()
        for i, s in items:
            p = decontaminate.normalised(s or "").split()
            if p and (k := distance(p, w)) <= int(len(p) * 0.2):
                want.append(str((d, i, k)))
    assert got == sorted(want) and len(got) > 20
    clean = decontaminate.drop_contaminated(docs(spark, rows), bench)
    dirty = {w.split(",")[0][1:] for w in want}
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(d) for d, _ in rows if str(d) not in dirty)
    assert clean.columns == docs(spark, rows).columns
    assert decontaminate.contaminated(docs(spark, []), bench).collect() == decontaminate.contaminated(docs(spark, rows), bench.limit(0)).collect() == []


def test_decontamination_in_blocks(spark, monkeypatch):
    rng = random.Random(13)
    items = [(i, " ".join(f"v{rng.randrange(50)}" for _ in range(rng.randint(5, 30)))) for i in range(40)]
    rows = [(i, "a b " + items[i % 40][1] + " c") for i in range(0, 90, 3)] + [(500, "nothing here"), (501, None), (502, ("z " * 60_000) + items[3][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(str, decontaminate.contaminated(docs(spark, rows), bench).collect()))
    clean = sorted(map(str, decontaminate.drop_contaminated(docs(spark, rows), bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 800)
    assert decontaminate._listed(bench, "item_id", "text")[1] > 800
    assert sorted(map(str, decontaminate.contaminated(docs(spark, rows), bench).collect())) == whole and len(whole) >= 31
    assert sorted(map(str, decontaminate.drop_contaminated(docs(spark, rows), bench).collect())) == clean and len(clean) == 2


@pytest.mark.parametrize("first", [2, 48])
def test_exact_dedup(spark, first, monkeypatch):
    monkeypatch.setattr(exact_dedup, "FIRST", first)
    monkeypatch.setattr(exact_dedup, "FACTOR", 2)
    rows = sample_texts(4) + [(2000, "x" * 5000 + "a"), (2001, "x" * 5000 + "b"), (1999, "x " * 5000 + "b"), (2002, "x" * 5000 + "b")]
    got = exact_dedup.exact_dedup(docs(spark, rows)).collect()
    norm = {}
    for d, t in rows:
        norm.setdefault("".join((t or "").translate({c: None for c in (32, 9, 10, 11, 12, 13)})), []).append((d, t or ""))
    want = []
    for key, group in norm.items():
        best = min(group, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0))
        left = 1
        for d, t in group:
            keep = (d, t) == best and left
            left -= bool(keep)
            want.append((str(d), str(best[0]), len(group), bool(keep), hashlib.sha256(key.encode()).hexdigest()))
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in got) == sorted(want)
    assert exact_dedup.exact_dedup(docs(spark, [])).collect() == []


def test_viterbi_equals_brute_force():
    import itertools

    rng = np.random.default_rng(1)
    for _ in range(60):
        sizes = rng.integers(0, 5, 4)
        o = np.concatenate([[0], np.cumsum(sizes)])
        s = rng.normal(0, 3, (o[-1], 3)).astype(np.float32)
        got = language.label_words(s, o, 2.0)
        for i in range(4):
            part = s[o[i] : o[i + 1]]
            value = lambda p, part=part: sum(part[j, x] for j, x in enumerate(p)) - 2.0 * sum(a != b for a, b in itertools.pairwise(p))
            if len(part):
                best = max(value(p) for p in itertools.product(range(3), repeat=len(part)))
                assert abs(value(got[o[i] : o[i + 1]].tolist()) - best) < 1e-4


def test_language(spark):
    rng = random.Random(8)
    kinds = {"aa": "banana kaboba nabaka".split(), "bb": "ditto mitti tidom".split(), "ru": "привет мир слово".split()}
    rows = [(i, " ".join(rng.choice(kinds[k]) for _ in range(rng.randint(3, 30))), k) for i, k in enumerate(rng.choice(list(kinds)) for _ in range(200))]
    rows += [(500, None, "aa"), (501, "12 34 !", None), (None, "banana ditto mitti tidom ditto", None), (0, rows[0][1], "aa")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, score int")
    got = language.identify_language(df, language.fit(df)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert (by[500].lang_pred, by[501].lang_pred, by[None].lang_pred) == ("und", "und", "bb")
    truth = {r[0]: r[2] for r in rows[:200]}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert held and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in language.identify_language(df, language.fit(df.limit(0))).collect()} == {"und"}
    for r in got[:20]:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_two_hundred_languages(spark):
    """Labels and back pointers beyond 127, and a rare language beyond the sample's bound."""
    s = np.zeros((6, 200), np.float32)
    s[:, 150] = 5
    s[3:, 199] = 40
    assert language.label_words(s, np.array([0, 6]), 2.0).tolist() == [150, 150, 150, 199, 199, 199]
    rng = random.Random(4)
    word = lambda k: "".join(chr(0x4E00 + 40 * k + rng.randrange(40)) for _ in range(4))
    rows = [(i, " ".join(word(k) for _ in range(12)), f"l{k:03}") for i, k in enumerate([*range(200)] + [rng.randrange(200) for _ in range(2200)])]
    rows += [(5000 + i, "banana bandana", "common") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.identify_language(df, language.fit(df, max_rows=2000)).collect()}
    held = [r for r in rows[:2400] if got[r[0]].held_out]
    assert max(int(r[2][1:]) for r in held) > 150 and len({r[2] for r in held}) > 127 and np.mean([got[i].lang_pred == lang for i, _, lang in held]) > 0.9
    assert got[5001].lang_pred == "common"


def test_language_spans_of_mixed_text():
    model = {"langs": ["a", "b"], "logp": np.zeros((language._SIZE, 2), np.float32), "scripts": np.ones((len(language.SCRIPT_STARTS), 2), bool)}
    _, f = language._features(language._codes(["xxxx"]))
    model["logp"][f.ravel(), 0] = 2
    _, f = language._features(language._codes(["yyyy"]))
    model["logp"][f.ravel(), 1] = 2
    assert language.identify(["xxxx yyyy yyyy", "xxxx xxxx yyyy", ""], model, 1.0) == [("b", 8 / 12), ("a", 8 / 12), ("und", 0.0)]


def test_factorization_machine_learns_an_interaction(spark):
    rng = random.Random(9)
    texts, y = [], []
    for _ in range(1500):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        texts.append(" ".join([*(["insult"] if a else []), *(["group"] if b else []), *[f"n{rng.randrange(50)}" for _ in range(8)]]))
        y.append(int(a and b))
    t, o = toxicity._terms(texts)
    model = toxicity.fit_fm([np.unique(t[o[i] : o[i + 1]]) for i in range(len(texts))], np.array(y))
    s = toxicity.score_texts(["insult x", "group x", "Insult, GROUP!", ""], model)
    assert s[2] > 0.6 and max(s[0], s[1], s[3]) < 0.3
    df = docs(spark, [*enumerate(texts), (None, None)])
    labels = spark.createDataFrame([(i, v, 3) for i, v in enumerate(y)] + [(None, 1, 1), (5, None, 1)], "doc_id long, toxic int, score int")
    got = toxicity.score_toxicity(df, toxicity.fit(df, labels)).collect()
    held = [r for r in got if r.held_out and r.doc_id is not None]
    assert len(got) == len(texts) + 1 and np.mean([r.predicted == y[r.doc_id] for r in held]) > 0.95
    kept = toxicity.drop_toxic(df, toxicity.fit(df, labels))
    assert kept.columns == df.columns and 0 < kept.count() < df.count()
    assert toxicity.score_toxicity(df.limit(0), toxicity.fit(df, labels.limit(0))).collect() == []


def test_factorization_machine_equals_the_pairwise_sum():
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{j}" for j in rng.integers(0, 30, rng.integers(0, 20))) for _ in range(60)] + ["", "unknown words only"]
    terms = sorted({int(x) for t in texts[:40] for x in toxicity._terms([t])[0]})[:20]
    model = {"bias": -0.7, "terms": np.array(terms, np.int32), "w": rng.normal(0, 1, len(terms)), "v": rng.normal(0, 1, (len(terms), 4))}
    got = toxicity.score_texts(texts, model)
    for text, s in zip(texts, got, strict=True):
        have = [i for i, x in enumerate(terms) if x in {int(y) for w in text.split() for y in toxicity._terms([w])[0]}]
        f = -0.7 + sum(model["w"][i] for i in have) + sum(float(model["v"][i] @ model["v"][j]) for i in have for j in have if i < j)
        assert abs(s - 1 / (1 + np.exp(-f))) < 1e-9


@pytest.mark.parametrize("seed", [1, 2])
def test_factorization_machine_learns_a_pair_without_marginal_effects(seed):
    """label = insult XOR group: neither word tells anything alone."""
    rng = random.Random(seed)
    texts, y = [], []
    for _ in range(4000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        texts.append(" ".join([*(["insult"] if a else []), *(["group"] if b else []), *[f"n{rng.randrange(50)}" for _ in range(8)]]))
        y.append(int(a != b))
    t, o = toxicity._terms(texts)
    model = toxicity.fit_fm([np.unique(t[o[i] : o[i + 1]]) for i in range(3000)], np.array(y[:3000]))
    right = (toxicity.score_texts(texts[3000:], model) >= 0.5) == np.array(y[3000:], bool)
    assert right.mean() > 0.95


def test_hash_share_at_any_size(spark):
    from gridloom.llm.common import hash_limit, hash_share

    low = -(1 << 63)
    assert [hash_limit(x) for x in (1.0, 0.5, 2**-40, 1e-15, 0.0)] == [(1 << 63) - 1, -1, low + (1 << 24) - 1, low + 18446 - 1, low]
    from pyspark.sql import functions as F

    n = spark.range(400_000).where(hash_share(F.xxhash64("id"), 1e-4)).count()
    assert 15 < n < 80 and spark.range(1000).where(hash_share(F.xxhash64("id"), 1.0)).count() == 1000


def test_toxicity_sample_is_bounded_per_class_and_id(spark):
    """A rare class is learnt beyond the bound, its base rate stays, and a hot id in either table counts once."""
    ids = [i for i in range(8000) if zlib.crc32(str(i).encode()) % 4 != 2]
    rare = set(ids[:60])
    df = docs(spark, [(i, "awful x" if i in rare else f"x n{i % 7}") for i in ids] + [(ids[100], "awful")] * 500)
    labels = spark.createDataFrame([(i, int(i in rare)) for i in ids] + [(ids[0], 0)] + [(ids[1], 1)] * 3000, "doc_id long, toxic int")
    model = toxicity.fit(df, labels, max_rows=1000)
    s = toxicity.score_texts(["awful x", "x n3"], model)
    assert s[0] > 0.5 and s[1] < 0.05
    assert abs(toxicity.fit(docs(spark, [(i, "x") for i in ids]), labels, max_rows=1000)["bias"] - np.log(60 / (len(ids) - 60))) < 0.4


def test_toxicity_fit_learns_from_all_rows_under_its_bound(spark):
    """18,000 labelled rows: a word in 20 toxic ones has z > 4 over all of them, and not over half."""
    ids = [i for i in range(24_000) if zlib.crc32(str(i).encode()) % 4 != 2]
    hinted = set([i for i in ids if i % 2][:20])
    assert 17_000 < len(ids) < 20_000
    df = docs(spark, [(i, "hint x" if i in hinted else "x") for i in ids])
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    t, _ = toxicity._terms(["hint"])
    assert list(toxicity.fit(df, labels)["terms"]) == list(t)


def test_url_filter(spark):
    rng = random.Random(10)
    hosts = ["example.com", "a.example.com", "notexample.com", "example.net", "x.y.example.net", "org", "EXAMPLE.Com:80", "com", "", "net"]
    paths = ["", "/", "/en", "/en/", "/en/7", "/en/76/x", "/de/8", "/de/9", "/es/", "/es", "/de/"]
    urls = [f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q=/en/', '#/de/'])}" for _ in range(300)] + [None, "no scheme", "://", "a://b://c/en/"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(None, "http://x.com/en/1", "h")], "page_id long, url string, host string")
    for r in url_filter.filter_urls(df).collect():
        u = "http://x.com/en/1" if r.page_id is None else urls[r.page_id]
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = rest[:cut].translate({c: c + 32 for c in range(65, 91)}), rest[cut:].split("?")[0].split("#")[0]
        fits = [(len(h) + len(p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best and best[1], best[2] if best else "allow"), u
    assert url_filter.filter_urls(df.limit(0)).collect() == []


def test_url_rules_by_total_length_and_any_case(spark):
    rules = [("block", "com", "/very/long/path/"), ("allow", "example.com", "/very"), ("block", "Mixed.ORG", "/a"), ("allow", "x.io", "/bc"), ("block", "io", "/bc/d")]
    urls = ["http://example.com/very/long/path/x", "http://example.com/very/x", "http://a.mixed.org/ab", "http://x.io/bc/d", "http://" + "h" * 100_000 + ".com/very/long/path/" + "p" * 300_000]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = [(r.rule, r.verdict) for r in sorted(url_filter.filter_urls(df, rules).collect())]
    assert got == [("com/very/long/path/", "block"), ("example.com/very", "allow"), ("mixed.org/a", "block"), ("x.io/bc", "allow"), ("com/very/long/path/", "block")]


def test_very_long_texts(spark):
    """A text of some MB among short ones, in the operators that read texts whole in one pass."""
    long = ("banana kaboba " * 200_000).strip()
    rows = [(0, long), (1, "banana"), (2, "привет мир"), (3, None)] + [(10 + i, ["banana kaboba nabaka", "привет мир слово"][i % 2]) for i in range(60)]
    df = spark.createDataFrame([(i, t, ["aa", "ru"][i % 2]) for i, t in rows], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in sharding.shard_rows(df).collect()}
    assert got[0].size == len(long) + 16 and got[0].text_crc32 == zlib.crc32(long.encode()) and got[3].size == 16
    model = language.fit(df)
    label = {r.doc_id: r for r in language.identify_language(df, model).collect()}
    assert label[0].lang_pred == label[1].lang_pred and label[0].score > 0.99 and label[3].lang_pred == "und"
    labels = spark.createDataFrame([(10 + i, i % 2) for i in range(60)], "doc_id long, toxic int")
    score = {r.doc_id: r.score for r in toxicity.score_toxicity(df, toxicity.fit(df, labels)).collect()}
    assert score[0] < 0.3 < score[2]


def test_held_out_rule(spark):
    got = spark.range(50).select("id", held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)
