"""Language identification: script ranges, then Viterbi over per-word scores with a switching penalty."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import hash_limit, held_out, text_or_empty

#: First code points of script ranges, in order; the script of a letter is the last that begins at or before it.
#: Fixed values of the Unicode block chart (Latin, Greek, Cyrillic, Armenian, Hebrew, Arabic, Indic, Thai and others, Georgian, Hangul Jamo, others, Latin and Greek additions, Kana, Han, Hangul, others).
SCRIPT_STARTS = np.array([0x0000, 0x0370, 0x0400, 0x0530, 0x0590, 0x0600, 0x0900, 0x0E00, 0x10A0, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x3040, 0x3400, 0xAC00, 0xD7B0])
BITS = 15  # features of each n-gram order
_SIZE = 3 << BITS
_LETTER = np.zeros(0x110000, bool)
#: Characters of a text that are scored at once, about 100 bytes each at the peak.
GIANT = 2_000_000
_BREAK = re.compile(r"[\s!?;()\"。，、！？；]")


def _letters() -> np.ndarray:
    if not _LETTER[97]:
        _LETTER[:] = [chr(i).isalpha() for i in range(0x110000)]
    return _LETTER


def _codes(texts: list[str]) -> np.ndarray:
    """Lower-cased code points with 0 for what is no letter, and two zeros behind each text, so a text's words end alike wherever it stands."""
    joined = "".join([t + "\0\0" for t in texts]).lower()
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    c[~_letters()[c]] = 0
    return c


def _features(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions at or right after letters, and there the hashed 1-, 2- and 3-grams (3 columns)."""
    p1, p2 = np.zeros_like(c), np.zeros_like(c)
    p1[1:], p2[2:] = c[:-1], c[:-2]
    p2[p1 == 0] = 0
    at = np.flatnonzero((c != 0) | (p1 != 0))
    a, b, d = c[at].astype(np.uint64), p1[at].astype(np.uint64), p2[at].astype(np.uint64)
    m = np.uint64(0x9E3779B97F4A7C15)
    shift = np.uint64(64 - BITS)
    one = (a * m) >> shift
    two = ((a + (b << np.uint64(21))) * m) >> shift
    three = ((a + (b << np.uint64(21)) + (d << np.uint64(42))) * m) >> shift
    return at, np.stack([one, two + np.uint64(1 << BITS), three + np.uint64(2 << BITS)], 1).astype(np.int64)


def _groups(texts: list[str], most: int = 2_000_000) -> Iterator[list[int]]:
    group, size = [], 0
    for i, t in enumerate(texts):
        if group and size + len(t) > most:
            yield group
            group, size = [], 0
        group.append(i)
        size += len(t)
    if group:
        yield group


def fit(docs: DataFrame, max_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict:
    """Per-language n-gram log probabilities and scripts, from about ``max_rows`` labelled texts chosen by hash.

    Each language has the same part of ``max_rows``, or all its texts if they are fewer, so a rare
    one is learnt too; equal texts of a language count once, so a hot row can't fill the sample (their
    number is a sketch's estimate, within about 5 %). The bound is on the fitted rows only; their whole texts are counted in Spark tasks, one count vector
    per language and task. Rows with null lang are left out. Memory grows with the number of
    languages (0.4 MB each).
    """
    rows = docs.where(F.col(lang_col).isNotNull() & ~held_out(id_col)).select(F.col(lang_col).cast("string").alias("lang"), text_or_empty(text_col).alias("text"))
    counts = {r.lang: max(r.n, 1) for r in rows.groupBy("lang").agg(F.approx_count_distinct("text").alias("n")).collect()}
    each = max_rows / max(len(counts), 1)
    spark = docs.sparkSession
    limits = spark.createDataFrame([(lang, hash_limit(each / n)) for lang, n in sorted(counts.items())], "lang string, _limit long")
    chosen = rows.join(F.broadcast(limits), "lang").withColumn("_h", F.xxhash64("text")).where("_h <= _limit").dropDuplicates(["lang", "_h"]).select("lang", "text")
    n_scripts = len(SCRIPT_STARTS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            langs = b["lang"].to_pylist()
            for lang in sorted(set(langs)):
                mine = b["text"].filter(pa.array([x == lang for x in langs])).to_pylist()
                total = sums.setdefault(lang, np.zeros(_SIZE + n_scripts, np.int64))
                for g in _groups(mine):
                    c = _codes([mine[i] for i in g])
                    _, f = _features(c)
                    total[:_SIZE] += np.bincount(f.ravel(), minlength=_SIZE)
                    total[_SIZE:] += np.bincount(np.searchsorted(SCRIPT_STARTS, c[c != 0], "right") - 1, minlength=n_scripts)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["lang", "counts"])

    def add(pdf):
        total = sum(np.frombuffer(x, np.int64) for x in pdf["counts"])
        return pdf.iloc[:1].assign(counts=[total.tobytes()])

    got = sorted(chosen.mapInArrow(count, "lang string, counts binary").groupBy("lang").applyInPandas(add, "lang string, counts binary").collect())
    langs, tables, scripts = [r.lang for r in got], [], []
    for r in got:
        v = np.frombuffer(r.counts, np.int64).astype(np.float64)
        parts = []
        for k in range(3):
            c = v[k << BITS : (k + 1) << BITS] + 0.2
            parts.append(np.log(c / c.sum()))
        tables.append(np.concatenate(parts))
        letters = v[_SIZE:]
        scripts.append(letters > 0.01 * max(letters.sum(), 1))
    return {"langs": langs, "logp": np.array(tables, np.float32).T.copy() if tables else np.zeros((_SIZE, 0), np.float32), "scripts": np.array(scripts, bool).T if scripts else np.zeros((n_scripts, 0), bool)}


def label_words(scores: np.ndarray, offsets: np.ndarray, penalty: float) -> np.ndarray:
    """Viterbi labels of each text's words (rows of scores; text i has rows offsets[i] to offsets[i+1]); a change of label costs ``penalty``. All texts go forward in step."""
    lengths = np.diff(offsets)
    order = np.argsort(-lengths, kind="stable")
    begin, lengths = offsets[:-1][order], lengths[order]
    longest = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(longest), "left")
    labels = np.zeros(len(scores), np.int32)
    best_before = np.zeros(len(scores), np.int32)
    switched = np.zeros(scores.shape, bool)
    delta = np.zeros((len(order), scores.shape[1]), np.float32)
    for t in range(longest):
        n = active[t]
        rows, d = begin[:n] + t, delta[:n]
        if t:
            best = d.argmax(1)
            top = d[np.arange(n), best] - penalty
            best_before[rows] = best
            sw = d < top[:, None]
            switched[rows] = sw
            d = np.where(sw, top[:, None], d)
        delta[:n] = d + scores[rows]
    state = delta.argmax(1).astype(np.int32)
    for t in range(longest - 1, -1, -1):
        n = active[t]
        rows, s = begin[:n] + t, state[:n]
        labels[rows] = s
        if t:
            state[:n] = np.where(switched[rows, s], best_before[rows], s)
    return labels


def _word_scores(texts: list[str], model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(scores by language, letters, text) of each word of the texts in a row; None without any letter."""
    langs = model["langs"]
    c = _codes(texts)
    # lower() may lengthen a text, so ends are taken from the lower-cased ones
    ends = np.cumsum([len(t.lower()) + 2 for t in texts])
    at, f = _features(c)
    if not len(at) or not langs:
        return None
    first = np.flatnonzero((c[at] != 0) & ((at == 0) | (c[at - 1] == 0)))
    starts = at[first]
    score = np.empty((len(first), len(langs)), np.float32)
    step = 800_000 // max(len(langs), 4)
    for a in range(0, len(first), step):
        lo, hi = first[a], first[a + step] if a + step < len(first) else len(at)
        score[a : a + step] = np.add.reduceat(model["logp"][f[lo:hi]].sum(1), first[a : a + step] - lo, 0)
    script = np.searchsorted(SCRIPT_STARTS, c[starts], "right") - 1
    fits = model["scripts"][script]
    fits[~fits.any(1)] = True
    score[~fits] = -1e6
    return score, np.add.reduceat((c[at] != 0).astype(np.int64), first), np.searchsorted(ends, starts, "right")


def _blocks(text: str, most: int) -> Iterator[str]:
    """A long text in blocks of about ``most`` characters, cut behind white space or a mark that neither ends in a letter nor bears on the case of one."""
    at = 0
    while len(text) - at > most and (m := _BREAK.search(text, at + most)):
        yield text[at : m.end()]
        at = m.end()
    yield text[at:]


def identify_giant(text: str, model: dict, penalty: float, most: int) -> tuple[str, float]:
    """``identify`` for one text of any length, whose words are scored in blocks.

    Viterbi's vector goes from block to block, and with each state the letters that the best path to it has given to every
    language, so no word is remembered and memory follows the block, not the text.
    """
    langs = model["langs"]
    delta, letters = None, np.zeros((len(langs), len(langs)))
    for part in _blocks(text, most):
        got = _word_scores([part], model)
        if got is None:
            continue
        for row, n in zip(got[0], got[1].tolist(), strict=True):
            if delta is None:
                delta = np.zeros(len(langs), np.float32)
            else:
                best = int(delta.argmax())
                top = delta[best] - np.float32(penalty)
                behind = delta < top
                if behind.any():
                    letters[behind] = letters[best]
                    delta = np.where(behind, top, delta)
            delta = delta + row
            letters[np.diag_indices(len(langs))] += n
    if delta is None:
        return "und", 0.0
    mine = letters[int(delta.argmax())]
    return langs[int(mine.argmax())], float(mine.max() / mine.sum())


def identify(texts: list[str], model: dict, penalty: float, giant: int = GIANT) -> list[tuple[str, float]]:
    """(language, share of the letters that are labelled with it) for each text; no letter: ("und", 0). Texts beyond ``giant`` characters go block by block."""
    langs, out = model["langs"], [("und", 0.0)] * len(texts)
    short = [i for i, t in enumerate(texts) if len(t) <= giant]
    for g in _groups([texts[i] for i in short], 8_000_000 // max(len(langs), 4)):
        g = [short[k] for k in g]
        got = _word_scores([texts[i] for i in g], model)
        if got is None:
            continue
        score, size, of = got
        offsets = np.searchsorted(of, np.arange(len(g) + 1))
        label = label_words(score, offsets, penalty)
        weight = np.zeros((len(g), len(langs)))
        np.add.at(weight, (of, label), size)
        top, total = weight.argmax(1), weight.sum(1)
        for j, i in enumerate(g):
            if total[j]:
                out[i] = (langs[top[j]], float(weight[j, top[j]] / total[j]))
    for i in sorted(set(range(len(texts))) - set(short)):
        out[i] = identify_giant(texts[i], model, penalty, giant)
    return out


def identify_language(docs: DataFrame, model: dict, penalty: float = 12.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Language of each document: the label with most letters after Viterbi, and its share of the letters as score.

    Words are runs of letters; a word's script leaves only languages that were learnt with it. Whole
    texts are read, in one pass without a shuffle; the model is broadcast, its size is fixed by the
    feature count and the number of languages. Long texts are scored in blocks of ``GIANT`` characters. Null or letterless text gives ``und`` and 0; without
    any learnt language all rows give ``und``. Repeated rows and null ids are kept; other columns
    are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [x for at in range(0, b.num_rows, 1000) for x in identify(b["text"].slice(at, 1000).to_pylist(), shared.value, penalty)]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["held_out"], pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(task, "doc_id long, held_out boolean, lang_pred string, score double")
