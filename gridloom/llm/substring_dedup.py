"""Substring deduplication over a compacted de Bruijn graph of word windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import materialize, text_or_empty
from gridloom.llm.occurrences import Marks, bit_at, occurrence_bitmaps
from gridloom.llm.words import hash_words, windows

#: A node is kept as a path's end when its hash has this many trailing zero bits: paths of 32 windows on average.
CUT_BITS = 5
#: A window that so many once-found paths list is heavy: its rows are dealt to SALTS tasks.
HEAVY, SALTS = 1000, 32


def _seeds(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Minimiser seeds: positions and hashes of short word runs so that each window of ``size`` words holds at least one; and the run length."""
    k = max(1, size // 2 - 1)
    g = windows(h, k)
    w = size - k + 1
    if len(g) < w:
        return np.zeros(0, np.int64), g[:0], k
    view = np.lib.stride_tricks.sliding_window_view(g, w)
    at = np.unique(view.argmin(1) + np.arange(len(view))) if len(view) < 200_000 else np.unique(np.concatenate([view[a : a + 200_000].argmin(1) + np.arange(a, min(a + 200_000, len(view))) for a in range(0, len(view), 200_000)]))
    return at, g[at], k


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return hash_words([t.encode("utf-8", "replace") for t in texts])


def _live(d: np.ndarray, size: int, twice: Marks) -> np.ndarray | None:
    """Which windows hold a seed that the corpus has twice; None if no window does."""
    count = len(d) - size + 1
    if count <= 0:
        return None
    p, g, k = _seeds(d, size)
    p = p[bit_at(twice, g)]
    if not len(p):
        return None
    mark = np.zeros(count + 1, np.int32)
    np.add.at(mark, np.maximum(0, p + k - size), 1)
    np.add.at(mark, np.minimum(count, p + 1), -1)
    return np.cumsum(mark[:-1]) > 0


class _Source:
    """A text's words joined by one blank, to read them at their coordinates."""

    def __init__(self, text: str):
        self.data = b" ".join(text.encode("utf-8", "replace").split())
        gaps = np.flatnonzero(np.frombuffer(self.data, np.uint8) == 32)
        self.first, self.last = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(self.data)]])

    def digests(self, begin: np.ndarray, stop: np.ndarray, size: int) -> list[bytes]:
        """Digest of the words [begin, stop) of each span."""
        return [hashlib.blake2b(self.data[a:z], digest_size=size).digest() for a, z in zip(self.first[begin].tolist(), self.last[stop - 1].tolist(), strict=True)]


def _paths(text: str, d: np.ndarray, live: np.ndarray, size: int) -> tuple:
    """The text's paths between kept nodes that hold a live window: digest of their words, end nodes (None at the text's ends), first and last window."""
    count = len(live)
    nodes = windows(d, size - 1)
    cut = np.flatnonzero(nodes & np.uint64((1 << CUT_BITS) - 1) == 0)
    cut = cut[(cut > 0) & (cut < count)]
    begin, stop = np.concatenate([[0], cut]), np.concatenate([cut, [count]])
    used = np.flatnonzero(np.add.reduceat(live.astype(np.int64), begin) > 0)
    begin, stop = begin[used], stop[used]
    digest = _Source(text).digests(begin, stop + size - 1, 16)
    ends = nodes.view(np.int64)
    src = [int(ends[a]) if a else None for a in begin.tolist()]
    dst = [int(ends[z]) if z < count else None for z in stop.tolist()]
    return digest, src, dst, begin.tolist(), stop.tolist()


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


_SCAN = "row long, doc_id long, n_words long, kept_sha256 string, text string, path array<binary>, src array<long>, dst array<long>, start array<int>, stop array<int>"


def analyse(docs: DataFrame, size: int = 35, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The scanned texts (one row each) and their repeated word spans (row, start, end).

    Windows of ``size`` words are the edges of a de Bruijn graph whose nodes are runs of size - 1
    words.

    - Seeds: minimiser runs, one in every window at least, are counted over the whole corpus.
      Windows without a repeated seed can't repeat; a text without any is finished in the scan
      (a bitmap of fixed size, false marks only cost work).
    - Local compaction: between two kept nodes (chosen by hash) a text's edges are one path, a row
      with its end nodes, source coordinates and a 128-bit digest of the words that stand there.
      Paths found at two or more source coordinates are repeated as a whole.
    - Joins compact chains of repeated paths over nodes that have one path in and one path out, by
      pointer doubling; a text's run through such a chain becomes one span.
    - Paths found once, and one copy of every repeated path, list those windows that may occur in
      both or twice (bitmaps again). A window with two source coordinates marks its span: besides
      its rolling 64-bit hash the words read at both coordinates must agree in a 32-bit digest.

    Rolling hashes only choose candidates and nodes; without the digests' agreement no word goes.
    Windows in very many places are dealt to SALTS tasks each.
    """
    spark = docs.sparkSession
    base = docs.select(text_or_empty(text_col).alias("text"), F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"))

    def seeds(rows: pa.RecordBatch, _: set) -> tuple[np.ndarray]:
        h, o = _words(rows["text"].to_pylist())
        return (np.concatenate([np.zeros(0, np.uint64), *[_seeds(h[o[i] : o[i + 1]], size)[1] for i in range(rows.num_rows)]]),)

    twice = spark.sparkContext.broadcast(occurrence_bitmaps(base.select("text"), seeds, ((0, 2),), F.octet_length("text") / 55)[0])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                texts = part["text"].to_pylist()
                h, o = _words(texts)
                sha, kept, found = [], [], []
                for i, text in enumerate(texts):
                    d = h[o[i] : o[i + 1]]
                    live = _live(d, size, twice.value)
                    found.append(([], [], [], [], []) if live is None else _paths(text, d, live, size))
                    kept.append(None if live is None else text)
                    sha.append(_sha(text.encode("utf-8", "replace").split()) if live is None else None)
                types = [pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
                lists = [pa.array([f[k] for f in found], pa.list_(t)) for k, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([part["row"], part["doc_id"], pa.array(np.diff(o)), pa.array(sha, pa.string()), pa.array(kept, pa.string()), *lists], ["row", "doc_id", "n_words", "kept_sha256", "text", "path", "src", "dst", "start", "stop"])

    table = materialize(base.mapInArrow(scan, _SCAN), "scanned", "zstd")
    seen = table.where("text is not null").select("row", F.explode(F.arrays_zip("path", "src", "dst", "start", "stop")).alias("x")).select("row", "x.*")
    counted = seen.groupBy("path").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("row", "start")).alias("one"), F.min("src").alias("src"), F.min("dst").alias("dst"), F.min(F.col("stop") - F.col("start")).alias("len"))
    # from here on a path is a number: the table is written once, so the numbers stay
    counted = materialize(counted.withColumn("pid", F.monotonically_increasing_id()), "path-counts")
    first = (F.col("one.row") == F.col("row")) & (F.col("one.start") == F.col("start"))
    placed = seen.select("row", "path", "start", "stop").join(counted.select("path", "pid", "c", "one"), "path")
    placed = materialize(placed.select("row", "pid", "start", "stop", (F.col("c") > 1).alias("twice"), first.alias("first")), "placed", "zstd")
    chains = compact(counted.where("c > 1").select(F.col("pid").alias("path"), "src", "dst", "len"))
    runs = (
        placed.where("twice").select("row", F.col("pid").alias("path"), "start", "stop")
        .join(chains, "path")
        .groupBy("row", "chain", (F.col("start") - F.col("offset")).alias("shift"))
        .agg(F.min("start").alias("a"), F.max("stop").alias("z"), F.collect_set(F.struct("start", "stop")).alias("each"))
    )
    covered = F.aggregate("each", F.lit(0), lambda n, x: n + x["stop"] - x["start"])
    joined = F.when(covered == F.col("z") - F.col("a"), F.array(F.struct(F.col("a").alias("start"), F.col("z").alias("stop")))).otherwise(F.col("each"))
    whole = runs.select("row", F.explode(joined).alias("x")).select("row", "x.start", (F.col("x.stop") + (size - 1)).alias("end"))

    # windows of the paths found once (asks) and of one copy of each repeated path
    told = placed.where("first or not twice").groupBy("row").agg(F.collect_list(F.struct("start", "stop", (~F.col("twice")).alias("asks"))).alias("parts"))
    listed = materialize(table.where("text is not null").select("row", "text").join(told, "row"), "listed", "zstd")

    def spread(part: pa.RecordBatch) -> Iterator[tuple[int, bool, np.ndarray, np.ndarray]]:
        """(row number, asks, hashes, positions) of the live windows of each listed path."""
        h, o = _words(part["text"].to_pylist())
        for i, paths in enumerate(part["parts"].to_pylist()):
            d = h[o[i] : o[i + 1]]
            live, edge = _live(d, size, twice.value), windows(d, size)
            for x in paths:
                at = np.flatnonzero(live[x["start"] : x["stop"]]) + x["start"]
                yield i, x["asks"], edge[at], at

    def listing(part: pa.RecordBatch, _: set) -> tuple[np.ndarray, np.ndarray]:
        """Windows of the paths found once, and of the copies."""
        found = list(spread(part))
        return tuple(np.concatenate([np.zeros(0, np.uint64), *[w for _, a, w, _ in found if a == asks]]) for asks in (True, False))

    wanted = ((0, 1), (0, 2), (0, HEAVY), (1, 1))
    once, again, heavy, other = (spark.sparkContext.broadcast(m) for m in occurrence_bitmaps(listed.select("text", "parts"), listing, wanted, F.octet_length("text") / 10, 25))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 500):
                part = b.slice(start, 500)
                texts = part["text"].to_pylist()
                rows, ask, wins, ats, proofs, source = [], [], [], [], [], (-1, None)
                for i, asks, w, at in spread(part):
                    on = bit_at(again.value, w) | bit_at(other.value, w) if asks else bit_at(once.value, w)
                    w, at = w[on], at[on]
                    if not len(w):
                        continue
                    if source[0] != i:
                        source = (i, _Source(texts[i]))
                    wins.append(w)
                    ats.append(at)
                    rows.append(np.full(len(w), i))
                    ask.append(np.full(len(w), asks))
                    proofs.append(np.frombuffer(b"".join(source[1].digests(at, at + size, 4)), np.int32))
                if rows:
                    w = np.concatenate(wins)
                    key = np.concatenate(proofs).astype(np.int64) << 1 | bit_at(heavy.value, w)
                    cols = [part["row"].take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(ask)), pa.array(w.view(np.int64)), pa.array(key), pa.array(np.concatenate(ats).astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(cols, ["row", "asks", "win", "key", "at"])

    # key: the words' digest, and in the last bit whether the window is heavy; few and full columns keep the exchanges small
    cand = materialize(listed.mapInArrow(candidates, "row long, asks boolean, win long, key long, at int"), "windows", "zstd")
    both = cand.groupBy("win", "key").agg(F.sum(F.when(F.col("asks"), F.lit(1)).otherwise(F.lit(1 << 32))).alias("w"))
    asking, copies = F.col("w") % (1 << 32), F.floor(F.col("w") / (1 << 32))
    is_heavy = F.col("key") % 2 != 0
    salts = F.when(is_heavy, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    double = both.where((asking >= 1) & (asking + copies > 1)).select("win", F.explode(F.transform(salts, lambda s: F.col("key") * SALTS + s)).alias("key"))
    salt = F.when(is_heavy, F.pmod(F.xxhash64("row", "at"), F.lit(SALTS))).otherwise(0)
    marked = cand.where("asks").select("win", (F.col("key") * SALTS + salt).alias("key"), "row", "at").join(double, ["win", "key"]).select("row", F.col("at").alias("start"), (F.col("at") + size).alias("end"))
    return table, whole.unionByName(marked)


def repeated_spans(docs: DataFrame, size: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, end): word spans made of repeated windows; spans of one text may overlap."""
    table, spans = analyse(docs, size, id_col, text_col)
    return table.select("row", "doc_id").join(spans, "row").select("doc_id", "start", "end")


def compact(edges: DataFrame) -> DataFrame:
    """(path, chain, offset): maximal chains of paths over nodes with one path in and one out, and each path's offset in windows.

    Pointer doubling towards the head; only paths that haven't reached one go on to the next round.
    A cycle of such nodes has no head; its paths stay chains of their own.
    """
    out = edges.where("src is not null").groupBy("src").agg(F.count(F.lit(1)).alias("o"))
    into = edges.where("dst is not null").groupBy("dst").agg(F.count(F.lit(1)).alias("i"), F.min("path").alias("before"), F.min("len").alias("blen"))
    through = out.where("o = 1").join(into.where("i = 1"), out.src == into.dst).select(out.src.alias("src"), "before", "blen")
    first = edges.join(through, "src", "left").select("path", F.col("before").alias("up"), F.coalesce("blen", F.lit(0)).cast("long").alias("dist"))
    state = materialize(first.withColumn("up", F.when(F.col("up") != F.col("path"), F.col("up"))), "chain")
    done = [state.where("up is null").select("path", F.col("path").alias("chain"), F.lit(0).cast("long").alias("offset"))]
    live, before = state.where("up is not null"), -1
    while True:
        now = live.count()
        if now == 0 or now == before:
            break
        before = now
        heads = done[0]
        for d in done[1:]:
            heads = heads.unionByName(d)
        ahead = live.select(F.col("path").alias("up"), F.col("up").alias("up2"), F.col("dist").alias("d2"))
        top = heads.select(F.col("path").alias("up"), "chain", "offset")
        step = materialize(
            live.join(ahead, "up", "left").join(top, "up", "left").select("path", F.col("up2").alias("up"), (F.col("dist") + F.coalesce("d2", F.lit(0))).alias("dist"), "chain", (F.col("dist") + F.col("offset")).alias("offset")),
            "chain",
        )
        done.append(step.where("chain is not null").select("path", "chain", "offset"))
        live = step.where("chain is null").select("path", "up", "dist")
    done.append(live.select("path", F.col("path").alias("chain"), F.lit(0).cast("long").alias("offset")))
    result = done[0]
    for d in done[1:]:
        result = result.unionByName(d)
    return result


def substring_dedup(docs: DataFrame, size: int = 35, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256[, kept_text] after removing words covered by repeated windows.

    A window is ``size`` consecutive words (maximal runs outside [\\x20\\x09-\\x0D]) of one whole text;
    it is repeated when its words also start anywhere else, the same text included. Windows are
    judged on the input. Kept words are joined by one blank; ``kept_text`` is null where nothing was
    looked at again (n_removed is 0 and the words stay as they are).

    Null text has no words; shorter texts keep all words; repeated rows repeat each other; null ids
    are kept; an empty table gives an empty result; other columns are not read. Spans of a text meet
    in one row, bounded by the text.
    """
    table, spans = analyse(docs, size, id_col, text_col)
    per_text = spans.groupBy("row").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    both = table.where("text is not null").select("row", "doc_id", "text").join(per_text, "row", "left").select("doc_id", "text", F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, sha, kept = [], [], [], []
            for text, starts, ends in zip(b["text"].to_pylist(), b["starts"].to_pylist(), b["ends"].to_pylist(), strict=True):
                words = text.encode("utf-8", "replace").split()
                n.append(len(words))
                if starts:
                    mark = np.zeros(len(words) + 1, np.int64)
                    np.add.at(mark, starts, 1)
                    np.add.at(mark, ends, -1)
                    cover = np.cumsum(mark[:-1]) > 0
                    words = [w for w, c in zip(words, cover.tolist(), strict=True) if not c]
                gone.append(n[-1] - len(words))
                sha.append(_sha(words))
                kept.append(b" ".join(words).decode("utf-8", "replace") if texts else None)
            cols = [b["doc_id"], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays([*cols, *([pa.array(kept, pa.string())] if texts else [])], ["doc_id", "n_words", "n_removed", "kept_sha256", *(["kept_text"] if texts else [])])

    seen = both.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if texts else ""))
    rest = table.where("text is null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", *([F.lit(None).cast("string").alias("kept_text")] if texts else []))
    return seen.unionByName(rest)
