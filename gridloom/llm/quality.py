"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import hash_share, held_out, slices, text_or_empty
from gridloom.llm.words import hash_words

#: Half of the hashed terms are words, half are word shapes.
BITS = 16
_HALF = 1 << (BITS - 1)
_REPEATED = _HALF  # the shape of a word that was already one of the two words before
_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
_SHAPE = np.frombuffer(bytes(65 if chr(i).isupper() and i < 128 else 97 if i >= 128 or chr(i).islower() else 48 if chr(i).isdigit() else i for i in range(256)), np.uint8)


def _shape(text: bytes) -> bytes:
    """Letters as A or a, digits as 0, and runs of one such byte as one; words stay apart."""
    s = _SHAPE[np.frombuffer(text, np.uint8)]
    return s[np.concatenate([[True], s[1:] != s[:-1]])].tobytes() if len(s) else b""


def terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashed terms of each text, in order: (row, term, share of the text's words). Words are lower-cased (A-Z)."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    h, at = hash_words([t.translate(_LOWER) for t in raw])
    s, _ = hash_words([_shape(t) for t in raw])
    n = np.diff(at)
    row = np.repeat(np.arange(len(texts)), n)
    again = np.zeros(len(h), bool)
    for k in (1, 2):
        again[k:] |= (h[k:] == h[:-k]) & (row[k:] == row[:-k])
    shift = np.uint64(64 - BITS + 1)
    word, shape = (h >> shift).astype(np.int64), _HALF + 1 + (s >> shift).astype(np.int64) % (_HALF - 1)
    keys, count = np.unique(np.concatenate([(row << BITS) + word, (row << BITS) + shape, (row[again] << BITS) + _REPEATED]), return_counts=True)
    row, term = keys >> BITS, (keys & ((1 << BITS) - 1)).astype(np.int32)
    return row, term, (count / n[row]).astype(np.float32)


def _weighted(row: np.ndarray, term: np.ndarray, share: np.ndarray, idf: np.ndarray, n: int) -> np.ndarray:
    """Square roots of shares times the inverse document frequencies; the words and the shapes of a text have norm 1 each."""
    x = np.sqrt(share) * idf[term]
    part = row * 2 + (term >= _HALF)
    norm = np.sqrt(np.bincount(part, x * x, 2 * n))
    return (x / np.maximum(norm, 1e-12)[part]).astype(np.float32)


def _times(row: np.ndarray, term: np.ndarray, x: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The sparse rows (row, term, x), sorted by row, times v, some entries at a time."""
    out, begin = np.zeros((n, v.shape[1]), np.float32), np.searchsorted(row, np.arange(n + 1))
    for lo in range(0, n, 64):
        hi = min(n, lo + 64)
        a, b = begin[lo], begin[hi]
        some = np.flatnonzero(np.diff(begin[lo : hi + 1]))
        if len(some):
            out[lo + some] = np.add.reduceat(v[term[a:b]] * x[a:b, None], begin[lo:hi][some] - a)
    return out


def _back(row: np.ndarray, term: np.ndarray, x: np.ndarray, u: np.ndarray, size: int) -> np.ndarray:
    """The transposed sparse rows times u."""
    order = np.argsort(term, kind="stable")
    return _times(term[order], row[order], x[order], u, size)


def _unit(z: np.ndarray) -> np.ndarray:
    return z / np.maximum(np.sqrt((z * z).sum(1, keepdims=True)), 1e-12)


def latent(row: np.ndarray, term: np.ndarray, x: np.ndarray, n: int, dims: int, seed: int = 11, turns: int = 4) -> np.ndarray:
    """The leading right singular vectors of the sparse rows (terms x dims), by subspace iteration."""
    q = np.random.default_rng(seed).normal(size=(1 << BITS, dims + 8)).astype(np.float32)
    for _ in range(turns):
        q, _ = np.linalg.qr(_back(row, term, x, np.linalg.qr(_times(row, term, x, q, n))[0], 1 << BITS))
    _, _, vt = np.linalg.svd(_times(row, term, x, q.astype(np.float32), n), full_matrices=False)
    return (q @ vt.T[:, :dims]).astype(np.float32)


def vote(z: np.ndarray, model: dict, k: int) -> np.ndarray:
    """Score of unit vectors: the mean label of the k labelled vectors with the largest cosine, all ties of the k-th included, weighted by cosine (negative: 0) and the label's weight.

    Products are exact, a block of documents against all labelled vectors. No similar vector: the base rate.
    """
    out = np.full(len(z), model["base"])
    known, y, w = model["vectors"], model["labels"], model["weights"]
    if not len(known):
        return out
    k = min(k, len(known))
    for at in range(0, len(z), 256):
        sims = z[at : at + 256] @ known.T
        least = np.partition(sims, len(known) - k, axis=1)[:, len(known) - k]
        sims[(sims < least[:, None]) | (sims < 1e-6)] = 0
        all_, ones = sims @ w, sims @ (w * y)
        out[at : at + 256] = np.where(all_ > 0, ones / np.where(all_ > 0, all_, 1), model["base"])
    return np.clip(out, 0, 1)


def vectors(texts: list[str], model: dict) -> np.ndarray:
    row, term, share = terms(texts)
    return _unit(_times(row, term, _weighted(row, term, share, model["idf"], len(texts)), model["basis"], len(texts)))


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """In how many of all documents each hashed term is, and their number. One row per term and task is summed; 2**BITS sums reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(1 << BITS, np.int64), 0
        for b in slices(batches):
            df += np.bincount(terms(b["t"].to_pylist())[1], minlength=1 << BITS)
            n += b.num_rows
        on = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(on, -1).astype(np.int32)), pa.array(np.append(df[on], n))], ["term", "n"])

    df = np.zeros(1 << BITS, np.int64)
    total = 0
    for r in docs.select(text_or_empty(text_col).alias("t")).mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        if r.term < 0:
            total = r.n
        else:
            df[r.term] = r.n
    return df, total


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 4_000, dims: int = 64, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> dict:
    """Labelled vectors of about ``max_rows`` ids chosen by hash, never held-out ones, and the latent space they span.

    Inverse document frequencies come from all documents. A repeated id in ``labels`` counts once, with its most
    frequent label (1 on a tie), and with the first of its texts. A class that would get less than a tenth of
    ``max_rows`` gets that many or all it has; votes are weighted by the inverse of a class's share. The chosen ids
    and the sparse rows fitted in one task are bounded by ``max_rows``. Null ids or labels are left out; without
    labelled texts every score is 0.5.
    """
    df, total = document_frequencies(docs, text_col)
    idf = np.log((1 + total) / (1 + df)).astype(np.float32) + 1
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).cast("long").alias("_id")).agg((F.avg(F.col(label_col).cast("int")) >= 0.5).cast("int").alias("_y"))
    count = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    all_ = sum(count.values())
    share = {c: min(1.0, max_rows * max(k / all_, 0.1) / k) if all_ > max_rows else 1.0 for c, k in count.items()}
    chosen = known.where(F.when(F.col("_y") == 1, hash_share(F.xxhash64("_id"), share.get(1, 1.0))).otherwise(hash_share(F.xxhash64("_id"), share.get(0, 1.0))))
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text_or_empty(text_col).alias("_t")).join(F.broadcast(chosen), "_id")

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            row, term, part = terms(b["_t"].to_pylist())
            cut = np.searchsorted(row, np.arange(b.num_rows + 1))
            packed = [[a[cut[i] : cut[i + 1]].tobytes() for i in range(b.num_rows)] for a in (term, part)]
            yield pa.RecordBatch.from_arrays([b["_id"], b["_y"], *[pa.array(x, pa.binary()) for x in packed]], ["_id", "_y", "term", "part"])

    def span(pdf):
        import pandas as pd

        pdf = pdf.sort_values("_id")
        n = len(pdf)
        term, part = (np.concatenate([np.frombuffer(x, t) for x in pdf[c]]) for c, t in (("term", np.int32), ("part", np.float32)))
        row = np.repeat(np.arange(n), [len(x) // 4 for x in pdf["term"]])
        x = _weighted(row, term, part, idf, n)
        basis = latent(row, term, x, n, dims) if len(x) else np.zeros((1 << BITS, dims), np.float32)
        z = _unit(_times(row, term, x, basis, n))
        return pd.DataFrame({"basis": [basis.tobytes()], "vectors": [z.tobytes()], "labels": [pdf["_y"].to_numpy(np.float32).tobytes()]})

    listed = rows.select("_id", "_y", "_t").mapInArrow(sparse, "_id long, _y int, term binary, part binary").groupBy("_id", "_y").agg(F.min(F.struct("term", "part")).alias("x")).select("_id", "_y", "x.*")
    got = listed.withColumn("_g", F.lit(0)).groupBy("_g").applyInPandas(span, "basis binary, vectors binary, labels binary").collect()
    if not got:
        return {"idf": idf, "basis": np.zeros((1 << BITS, dims), np.float32), "vectors": np.zeros((0, dims), np.float32), "labels": np.zeros(0, np.float32), "weights": np.zeros(0, np.float32), "base": 0.5}
    y = np.frombuffer(got[0].labels, np.float32)
    w = np.where(y == 1, 1 / share.get(1, 1.0), 1 / share.get(0, 1.0)).astype(np.float32)
    return {"idf": idf, "basis": np.frombuffer(got[0].basis, np.float32).reshape(1 << BITS, dims), "vectors": np.frombuffer(got[0].vectors, np.float32).reshape(-1, dims), "labels": y, "weights": w, "base": float((w * y).sum() / w.sum())}


def _scores(texts: pa.Array, model: dict, k: int) -> np.ndarray:
    parts = [vote(vectors([t or "" for t in texts.slice(at, 250).to_pylist()], model), model, k) for at in range(0, len(texts), 250)]
    return np.concatenate(parts) if parts else np.zeros(0)


def score_quality(docs: DataFrame, model: dict, k: int = 15, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1) and prediction of each whole text, in one pass without a shuffle.

    The labelled vectors, at most about ``max_rows``, and the basis of fixed size are broadcast. Null and empty
    texts get the base rate. Repeated rows and null ids are kept; equal texts get equal scores; an empty table
    gives an empty result; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), text_or_empty(text_col).alias("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            s = _scores(b["text"], shared.value, k)
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["held_out"], pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(task, "doc_id long, held_out boolean, score double, predicted int")


def keep_quality(docs: DataFrame, model: dict, k: int = 15, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows that score at least the threshold, with all their columns; null and empty texts score the base rate, repeated rows alike."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield b.filter(pa.array(_scores(b[text_col], shared.value, k) >= threshold))

    return docs.mapInArrow(task, docs.schema)
