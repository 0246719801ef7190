"""Toxicity: a factorization machine over hashed terms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import hash_share, held_out, slices, text_or_empty
from gridloom.llm.words import hash_words

BITS = 20
_PUNCT = bytes(32 if chr(i) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else i for i in range(256))


def _terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed terms of all texts (lower-cased words without ASCII punctuation), and offsets."""
    h, offsets = hash_words([t.lower().encode("utf-8", "replace").translate(_PUNCT) for t in texts])
    return (h >> np.uint64(64 - BITS)).astype(np.int32), offsets


def _sigmoid(f: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(f, -30, 30)))


def _machine(cols: np.ndarray, rows: np.ndarray, n: int, b: float, w: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of n documents given as (row, term) entries, and each document's sum of factors."""
    xv = np.stack([np.bincount(rows, v[cols, k], n) for k in range(v.shape[1])], 1)
    return b + np.bincount(rows, w[cols] - 0.5 * (v[cols] ** 2).sum(1), n) + 0.5 * (xv**2).sum(1), xv


def _score_tests(blocks: list[tuple[np.ndarray, np.ndarray]], offsets: list[int], y: np.ndarray, f: np.ndarray, tables: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """For every term the z values of the score tests that its weight, and that its factors, are 0.

    A factor's gradient sums residual times the other terms' factors; ``tables`` holds one factor of all
    terms each. The term's own weight is taken out, so that a pair shows without any marginal effect.
    """
    p = _sigmoid(f)
    res, var = p - y, p * (1 - p)
    g, e = np.zeros(size), np.full(size, 1e-9)
    for at, (rows, cols) in zip(offsets, blocks, strict=True):
        g += np.bincount(cols, res[at + rows], size)
        e += np.bincount(cols, var[at + rows], size)
    most = np.zeros(size)
    for u in tables:
        a, c, d = np.zeros(size), np.zeros(size), np.zeros(size)
        for at, (rows, cols) in zip(offsets, blocks, strict=True):
            t = np.bincount(rows, u[cols])[rows] - u[cols]
            q = var[at + rows] * t
            a += np.bincount(cols, res[at + rows] * t, size)
            c += np.bincount(cols, q, size)
            d += np.bincount(cols, q * t, size)
        spread = d - c * c / e
        most = np.maximum(most, np.abs(a - c / e * g) / np.sqrt(np.where(spread > 1e-6 * (d + 1e-9), spread, np.inf)))
    return np.abs(g) / np.sqrt(e), most


def fit_fm(docs: list[np.ndarray], labels: np.ndarray, rank: int = 4, rounds: int = 4, steps: int = 150, least: tuple[float, float] = (4.0, 6.0), seed: int = 7) -> dict:
    """A factorization machine on presence features, over all hashed terms of the documents.

    Each round tests every term (score tests of its weight and of its factors, against the model so
    far; factors also in random directions, which shows pairs whose members have no effect alone),
    adds all terms beyond the z values ``least`` and goes on training bias, weights and factors of
    all added terms on the log loss by Adam with L2 decay. Terms that stay below keep 0, so the
    model has no bound on terms and noise stays out. No documents or one class only: the base rate.
    """
    y = np.asarray(labels, np.float64)
    n, n1 = len(y), y.sum()
    base = float(np.log((n1 + 0.5) / (n - n1 + 0.5)))
    empty = {"bias": base, "terms": np.zeros(0, np.int32), "w": np.zeros(0), "v": np.zeros((0, rank))}
    if n == 0 or n1 in (0, n):
        return empty
    # a thousand documents at a time, so that the entries of all of them are never copied at once
    offsets = list(range(0, n, 1000))
    found = np.zeros(1 << BITS, bool)
    for d in docs:
        found[d] = True
    names = np.flatnonzero(found).astype(np.int32)
    place = np.zeros(1 << BITS, np.int32)
    place[names] = np.arange(len(names))
    blocks = [(np.repeat(np.arange(len(part), dtype=np.int32), [len(d) for d in part]), place[np.concatenate(part)]) for part in (docs[at : at + 1000] for at in offsets)]
    size = len(names)
    rng = np.random.default_rng(seed)
    b, w, v, used = np.array([base]), np.zeros(size), np.zeros((size, rank)), np.zeros(size, bool)
    f = np.full(n, base)
    for _ in range(rounds):
        tables = [rng.choice([-1.0, 1.0], size) for _ in range(rank)] + ([v[:, k] for k in range(rank)] if used.any() else [])
        alone, paired = _score_tests(blocks, offsets, y, f, tables, size)
        new = ((alone >= least[0]) | (paired >= least[1])) & ~used
        if not new.any():
            break
        used |= new
        v[new] = rng.normal(0, 0.05, (int(new.sum()), rank))
        terms = np.flatnonzero(used)
        col = np.full(size, -1, np.int32)
        col[terms] = np.arange(len(terms))
        entries = [(at + rows[col[cols] >= 0], col[cols][col[cols] >= 0]) for at, (rows, cols) in zip(offsets, blocks, strict=True)]
        rows, cols = (np.concatenate([x[i] for x in entries]) for i in (0, 1))
        par = {"b": b, "w": w[terms], "v": v[terms]}
        m, s = {k: np.zeros_like(a) for k, a in par.items()}, {k: np.zeros_like(a) for k, a in par.items()}
        decay = {"b": 0.0, "w": 1e-4, "v": 1e-3}
        for t in range(1, steps + 1):
            f, xv = _machine(cols, rows, n, par["b"][0], par["w"], par["v"])
            r = (_sigmoid(f) - y) / n
            gw = np.bincount(cols, r[rows], len(terms))
            gv = np.stack([np.bincount(cols, r[rows] * xv[rows, k], len(terms)) for k in range(rank)], 1) - gw[:, None] * par["v"]
            for k, g in {"b": np.array([r.sum()]), "w": gw, "v": gv}.items():
                grad = g + decay[k] * par[k]
                m[k] = 0.9 * m[k] + 0.1 * grad
                s[k] = 0.999 * s[k] + 0.001 * grad**2
                par[k] = par[k] - 0.05 * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
        b, w[terms], v[terms] = par["b"], par["w"], par["v"]
        f, _ = _machine(cols, rows, n, b[0], par["w"], par["v"])
    terms = np.flatnonzero(used)
    return {"bias": float(b[0]), "terms": names[terms], "w": w[terms], "v": v[terms]}


def score_texts(texts: list[str], model: dict) -> np.ndarray:
    terms, offsets = _terms(texts)
    f = np.full(len(texts), model["bias"])
    if len(model["terms"]):
        place = np.full(1 << BITS, -1, np.int32)
        place[model["terms"]] = np.arange(len(model["terms"]))
        p = place[terms]
        hit = np.flatnonzero(p >= 0)
        row = np.searchsorted(offsets, hit, "right") - 1
        pairs = np.unique(row.astype(np.int64) * len(model["terms"]) + p[hit])
        row, p = pairs // len(model["terms"]), pairs % len(model["terms"])
        xv = np.zeros((len(texts), model["v"].shape[1]))
        np.add.at(xv, row, model["v"][p])
        f += np.bincount(row, model["w"][p] - 0.5 * (model["v"][p] ** 2).sum(1), len(texts)) + 0.5 * (xv**2).sum(1)
    return _sigmoid(f)


def _scores(texts: pa.Array, model: dict) -> np.ndarray:
    parts = [score_texts([t or "" for t in texts.slice(at, 500).to_pylist()], model) for at in range(0, len(texts), 500)]
    return np.concatenate(parts) if parts else np.zeros(0)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict:
    """Fit on about ``max_rows`` labelled ids chosen by hash, never on held-out ids.

    A repeated id in ``labels`` counts once, with its most frequent label (1 on a tie), and with one
    of its texts. Both classes are chosen with the same share; a class that would get less than a
    tenth of ``max_rows`` gets that many or all it has, and the bias is corrected for it. The chosen
    (id, label) pairs are bounded by ``max_rows`` and broadcast to find their whole texts in one
    scan; the bounded term lists are fitted in one task. Null ids or labels are left out; without
    labelled texts the score is 0.5.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).cast("long").alias("_id")).agg((F.avg(F.col(label_col).cast("int")) >= 0.5).cast("int").alias("_y"))
    count = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(count.values())
    share = {c: min(1.0, max_rows * max(k / total, 0.1) / k) if total > max_rows else 1.0 for c, k in count.items()}
    shift = float(np.log(share.get(0, 1.0) / share.get(1, 1.0)))
    chosen = known.where(F.when(F.col("_y") == 1, hash_share(F.xxhash64("_id"), share.get(1, 1.0))).otherwise(hash_share(F.xxhash64("_id"), share.get(0, 1.0))))
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text_or_empty(text_col).alias("_t")).join(F.broadcast(chosen), "_id")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            t, o = _terms(b["_t"].to_pylist())
            out = [np.unique(t[o[i] : o[i + 1]]).tobytes() for i in range(len(o) - 1)]
            yield pa.RecordBatch.from_arrays([b["_id"], b["_y"], pa.array(out, pa.binary())], ["_id", "_y", "terms"])

    def one(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["_id", "_y", "terms"])
        got = fit_fm([np.frombuffer(x, np.int32) for x in pdf["terms"]], pdf["_y"].to_numpy())
        return pd.DataFrame({"bias": [got["bias"] + shift], "terms": [got["terms"].tobytes()], "w": [got["w"].tobytes()], "v": [got["v"].tobytes()], "rank": [got["v"].shape[1]]})

    listed = rows.select("_id", "_y", "_t").mapInArrow(terms, "_id long, _y int, terms binary").groupBy("_id", "_y").agg(F.min("terms").alias("terms"))
    got = listed.withColumn("_g", F.lit(0)).groupBy("_g").applyInPandas(one, "bias double, terms binary, w binary, v binary, rank int").collect()
    if not got:
        return {"bias": 0.0, "terms": np.zeros(0, np.int32), "w": np.zeros(0), "v": np.zeros((0, 4))}
    r = got[0]
    return {"bias": r.bias, "terms": np.frombuffer(r.terms, np.int32), "w": np.frombuffer(r.w), "v": np.frombuffer(r.v).reshape(-1, r["rank"])}


def score_toxicity(docs: DataFrame, model: dict, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1) and prediction of each whole text, in one pass without a shuffle.

    Null and empty texts get the model's base rate. Repeated rows and null ids are kept; an empty
    table gives an empty result; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), text_or_empty(text_col).alias("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            s = _scores(b["text"], shared.value)
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["held_out"], pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(task, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: dict, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows that score below the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield b.filter(pa.array(_scores(b[text_col], shared.value) < threshold))

    return docs.mapInArrow(task, docs.schema)
