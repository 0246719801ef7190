"""Benchmark decontamination: pigeonhole pieces, exact piece hits, Myers bit-parallel verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import materialize, slices, text_or_empty
from gridloom.llm.occurrences import bit_at, occurrence_bitmaps
from gridloom.llm.words import hash_words, windows

#: ASCII punctuation separates words here; letters outside ASCII stay.
_PUNCT = bytes(32 if chr(i) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else i for i in range(256))
#: Most bytes of item text whose index is broadcast; more items are joined.
BLOCK_BYTES = 4 << 20
#: Candidate items of one document that one task verifies.
CANDIDATES = 2000


def normalised(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace").translate(_PUNCT)


def myers(pattern: list[int], text: list[int]) -> tuple[int, int]:
    """Least edit distance of the pattern to any substring of the text, and the end of the first such substring (Myers 1999, symbols are words)."""
    m = len(pattern)
    peq: dict[int, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | (1 << i)
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, where = mask, 0, m, m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = (mv | ~(xh | pv)) & mask
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & mask
        mh = (mh << 1) & mask
        pv = (mh | ~(xv | ph)) & mask
        mv = ph & xv
        if score < best:
            best, where = score, j + 1
    return best, where


def cut_pieces(words: list[np.ndarray], error_rate: float) -> tuple[list[int], list[list[tuple[int, int, int]]]]:
    """Each item's budget, and its budget + 1 pieces as (size, hash, offset); an item without words has none."""
    budget = [int(len(w) * error_rate) for w in words]
    sizes = [len(w) // (k + 1) for w, k in zip(words, budget, strict=True)]
    return budget, [[(n, int(windows(w[p * n : p * n + n], n)[0]), p * n) for p in range(k + 1)] if n else [] for w, k, n in zip(words, budget, sizes, strict=True)]


def index_items(items: list[tuple[int | None, str]], error_rate: float) -> dict:
    """Words of each item and, by piece length, the sorted hashes of its budget + 1 pieces with (item, offset)."""
    h, o = hash_words([normalised(t) for _, t in items])
    words = [h[o[i] : o[i + 1]] for i in range(len(items))]
    budget, cut = cut_pieces(words, error_rate)
    pieces: dict[int, list[tuple[int, int, int]]] = {}
    for i, found in enumerate(cut):
        for size, piece, a in found:
            pieces.setdefault(size, []).append((piece, i, a))
    by_size = {}
    for size, found in pieces.items():
        found.sort()
        keys = np.array([x[0] for x in found], np.uint64)
        bits = np.zeros(1 << 20, bool)
        bits[(keys >> np.uint64(44)).astype(np.int64)] = True
        by_size[size] = (keys, bits, np.array([x[1] for x in found]), np.array([x[2] for x in found]))
    return {"ids": [i for i, _ in items], "words": [w.tolist() for w in words], "budget": budget, "pieces": by_size}


def match_text(w: np.ndarray, index: dict, found: dict[int, set[int]]) -> list[tuple[int, int, int]]:
    """(item number, distance, word position of the end) of the items within budget; found: item -> possible starts."""
    out = []
    for item in sorted(found):
        pattern, k = index["words"][item], index["budget"][item]
        m, best = len(pattern), None
        spans: list[list[int]] = []
        for a in sorted(found[item]):
            lo, hi = max(0, a - k), min(len(w), a + m + k)
            if spans and lo <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], hi)
            else:
                spans.append([lo, hi])
        for lo, hi in spans:
            d, end = myers(pattern, w[lo:hi].tolist())
            if d <= k and (best is None or d < best[1]):
                best = (item, d, lo + end)
        if best:
            out.append(best)
    return out


def find_items(texts: list[str | None], index: dict) -> list[tuple[int, tuple[int, int, int]]]:
    """(text number, match) of every item that a text holds within its budget."""
    h, o = hash_words([normalised(t or "") for t in texts])
    hits: dict[int, dict[int, set[int]]] = {}
    for size, (keys, bits, item, off) in index["pieces"].items():
        g = windows(h, size)
        pos = np.flatnonzero(bits[(g >> np.uint64(44)).astype(np.int64)])
        left, right = np.searchsorted(keys, g[pos], "left"), np.searchsorted(keys, g[pos], "right")
        on = right > left
        for p, a, z in zip(pos[on].tolist(), left[on].tolist(), right[on].tolist(), strict=True):
            d = int(np.searchsorted(o, p, "right") - 1)
            if p + size <= o[d + 1]:
                for x in range(a, z):
                    hits.setdefault(d, {}).setdefault(int(item[x]), set()).add(int(p - o[d] - off[x]))
    return [(d, r) for d in sorted(hits) for r in match_text(h[o[d] : o[d + 1]], index, hits[d])]


def _listed(items: DataFrame, item_id: str, item_text: str) -> tuple[DataFrame, int]:
    """Items with text as (i, t), and the bytes of their texts."""
    query = items.select(F.col(item_id).cast("long").alias("i"), text_or_empty(item_text).alias("t")).where("t <> ''")
    return query, query.agg(F.sum(F.octet_length("t"))).first()[0] or 0


def _index(query: DataFrame, error_rate: float):
    listed = sorted(((r.i, r.t) for r in query.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    return query.sparkSession.sparkContext.broadcast(index_items(listed, error_rate))


def _joined(rows: DataFrame, query: DataFrame, error_rate: float) -> DataFrame:
    """(_uid, doc_id, item_id, n_words, distance, end_word): the same matches for any number of items.

    rows: _uid, doc_id, text, written. Pieces are rows, marked in a filter of fixed size that is broadcast, so only
    windows that may be a piece leave the scan; these meet the pieces by size and hash. Each pair of a document and an item
    is verified once, with all places it may begin at, next to the document's text, CANDIDATES pairs at a time.
    """
    keyed = materialize(query.withColumn("_item", F.monotonically_increasing_id()), "items")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            h, o = hash_words([normalised(t) for t in b["t"].to_pylist()])
            words = [h[o[i] : o[i + 1]] for i in range(b.num_rows)]
            budget, found = cut_pieces(words, error_rate)
            kind = pa.list_(pa.struct([("size", pa.int32()), ("h", pa.int64()), ("off", pa.int32())]))
            listed = [[{"size": n, "h": x - (1 << 64) if x >> 63 else x, "off": a} for n, x, a in f] for f in found]
            yield pa.RecordBatch.from_arrays([b["_item"], b["i"], pa.array(budget, pa.int32()), pa.array([w.tobytes() for w in words], pa.binary()), pa.array(listed, kind)], ["_item", "i", "k", "words", "pieces"])

    parts = materialize(keyed.mapInArrow(cut, "_item long, i long, k int, words binary, pieces array<struct<size: int, h: long, off: int>>"), "pieces")
    pieces = parts.select("_item", F.inline("pieces"))
    sizes = sorted(r[0] for r in pieces.select("size").distinct().collect())
    if not sizes:
        return rows.sparkSession.createDataFrame([], "_uid long, doc_id long, item_id long, n_words int, distance int, end_word int")
    marks = occurrence_bitmaps(pieces, lambda b, _: (b["h"].to_numpy().view(np.uint64),), ((0, 1),), F.lit(1))[0]
    shared = rows.sparkSession.sparkContext.broadcast(marks)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            h, o = hash_words([normalised(t) for t in b["text"].to_pylist()])
            uid = b["_uid"].to_numpy()
            for size in sizes:
                g = windows(h, size)
                pos = np.flatnonzero(bit_at(shared.value, g))
                d = np.searchsorted(o, pos, "right") - 1
                pos, d = pos[pos + size <= o[d + 1]], d[pos + size <= o[d + 1]]
                yield pa.RecordBatch.from_arrays([pa.array(uid[d]), pa.array(np.full(len(pos), size, np.int32)), pa.array(g[pos].view(np.int64)), pa.array((pos - o[d]).astype(np.int32))], ["_uid", "size", "h", "pos"])

    found = rows.select("_uid", "text").mapInArrow(hits, "_uid long, size int, h long, pos int").join(pieces, ["size", "h"])
    pairs = materialize(found.groupBy("_uid", "_item").agg(F.array_sort(F.collect_set(F.col("pos") - F.col("off"))).alias("starts")), "candidates")
    counts = materialize(pairs.groupBy("_uid").agg(F.ceil(F.count(F.lit(1)) / CANDIDATES).alias("_parts")), "counts")
    mine = pairs.join(counts, "_uid").withColumn("_part", F.pmod(F.xxhash64("_item"), F.col("_parts"))).drop("_parts").join(parts.drop("pieces"), "_item")
    places = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))
    texts = rows.join(counts.select(F.col("_uid").alias("_of"), places.alias("_place")), F.col("_uid") == F.col("_of"))

    def verify(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["_uid", "doc_id", "item_id", "n_words", "distance", "end_word"]
        out = []
        if left.num_rows and right.num_rows:
            h, _ = hash_words([normalised(left["text"][0].as_py())])
            words = [np.frombuffer(w, np.uint64).tolist() for w in right["words"].to_pylist()]
            index = {"words": words, "budget": right["k"].to_pylist()}
            ids = right["i"].to_pylist()
            for item, d, end in match_text(h, index, {n: set(s) for n, s in enumerate(right["starts"].to_pylist())}):
                out.append((left["_uid"][0].as_py(), left["doc_id"][0].as_py(), ids[item], len(words[item]), d, end))
        kinds = [pa.int64()] * 3 + [pa.int32()] * 3
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=names)

    return texts.groupBy("_of", "_place").cogroup(mine.groupBy("_uid", "_part")).applyInArrow(verify, "_uid long, doc_id long, item_id long, n_words int, distance int, end_word int")


def contaminated(docs: DataFrame, items: DataFrame, error_rate: float = 0.2, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_words, distance, end_word) for every item that a document holds within its error budget.

    Words are compared in lower case without ASCII punctuation. An item of m words may differ from a
    substring of the document by floor(m * error_rate) word edits; it is cut into one piece more
    than that, so one piece must occur unchanged. Items of up to ``BLOCK_BYTES`` of text are
    broadcast, for one pass over the documents without a shuffle; more are joined by their pieces.
    The best match of each (row, item) is returned. Items without words match nothing; null texts
    hold nothing; repeated rows and null ids are kept; empty tables give an empty result; other
    columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    names = ["doc_id", "item_id", "n_words", "distance", "end_word"]

    def search(index_var):
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = index_var.value
            for b in slices(batches):
                if got := find_items(b["text"].to_pylist(), index):
                    ids = b["doc_id"].take(pa.array([d for d, _ in got]))
                    cols = [[index["ids"][r[0]] for _, r in got], [len(index["words"][r[0]]) for _, r in got], [r[1] for _, r in got], [r[2] for _, r in got]]
                    yield pa.RecordBatch.from_arrays([ids, pa.array(cols[0], pa.int64()), *[pa.array(c, pa.int32()) for c in cols[1:]]], names)

        return task

    query, total = _listed(items, item_id, item_text)
    if total <= BLOCK_BYTES:
        return rows.mapInArrow(search(_index(query, error_rate)), "doc_id long, item_id long, n_words int, distance int, end_word int")
    return _joined(materialize(rows.withColumn("_uid", F.monotonically_increasing_id()), "numbered"), query, error_rate).drop("_uid")


def drop_contaminated(docs: DataFrame, items: DataFrame, error_rate: float = 0.2, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that hold no item, with all their columns; see ``contaminated``. Null and empty texts hold none and stay, as do repeated rows."""

    def keep(index_var):
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                clean = np.ones(b.num_rows, bool)
                clean[[d for d, _ in find_items(b[text_col].to_pylist(), index_var.value)]] = False
                yield b.filter(pa.array(clean))

        return task

    query, total = _listed(items, item_id, item_text)
    if total <= BLOCK_BYTES:
        return docs.mapInArrow(keep(_index(query, error_rate)), docs.schema)
    names, key = {c.lower() for c in docs.columns}, "_uid"
    while key in names:
        key += "_"
    numbered = materialize(docs.withColumn(key, F.monotonically_increasing_id()), "numbered")
    rows = numbered.select(F.col(key).alias("_uid"), F.lit(None).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    bad = _joined(rows, query, error_rate).select(F.col("_uid").alias(key)).distinct()
    return numbered.join(bad, key, "left_anti").select(*docs.columns)
