"""SentencePiece encoding and decoding; giant texts by a max-plus scan over chunks.

The encoding of a byte-pair model is a path through the lattice of pieces: a token sequence is the
encoding exactly when every neighbouring pair of tokens is one that the model itself makes of the
pair's text. In the max-plus semiring such a step weighs 0 and any other minus infinity. A giant
text is cut every ``chunk`` characters, wherever that falls. The state at a cut is the token that ends
at or hangs over it, so a chunk is a matrix over the states of its two cuts, made from the chunk and
a piece's length of context alone. Matrices are rows; a tree of grouped products combines them, the
way back down the tree gives each chunk its entry and exit state, and every chunk is then traced
back on its own. Blanks keep this cheap: no piece crosses a blank that follows a non-blank (checked on
the vocabulary), so between the first and the last such place of a chunk there is one state, and the
words there are encoded one by one; only the parts of words at the cuts, and runs without blanks, are
walked through the lattice.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import materialize, new_path, slices, text_or_empty

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Most characters of a chunk; longer texts are giant.
CHUNK = 16_384
_CACHE = 100_000
_LONG = 64  # longer words aren't remembered
_WORD = re.compile(r" +[^ ]*")
#: Matrices that one task multiplies: the fan-in of the tree.
FAN_IN = 64


class Codec:
    """One model with a bounded memory of encoded words."""

    def __init__(self, model: str | bytes):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model) if isinstance(model, bytes) else sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        self.splits = not any("▁" in p.lstrip("▁") for p in pieces)
        self.blank = self.sp.piece_to_id("▁")
        self.longest = max(len(p) for i, p in enumerate(pieces) if not (self.sp.is_control(i) or self.sp.is_byte(i)))
        self.ids = {p: i for i, p in enumerate(pieces) if not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i))}
        self.words: dict[str, list[int]] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def encode(self, texts: list[str], first: bool = True) -> list[list[int]]:
        """Ids of texts. first: the texts begin documents; else each begins with a blank that the library's dummy prefix stands for.

        To the model U+2581 is a blank, so both are one symbol before a text is cut into words.
        """
        texts = [t.replace("▁", " ") for t in texts]
        if not self.splits:
            return self.sp.encode(texts if first else [t[1:] for t in texts], num_threads=1)
        split = [[w[1:] for w in _WORD.findall(" " + t if first else t)] for t in texts]
        new = list({w for words in split for w in words if w not in self.words and w})
        if len(self.words) + len(new) > _CACHE:
            self.words = {}
            new = list({w for words in split for w in words if w})
        coded = dict(zip(new, self.sp.encode(new, num_threads=1), strict=True))
        coded[""] = [self.blank]
        out = [[i for w in words for i in (coded.get(w) or self.words[w])] if t else [] for t, words in zip(texts, split, strict=True)]
        self.words.update((w, ids) for w, ids in coded.items() if len(w) <= _LONG)
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.sp.decode(ids, num_threads=1)

    # --- boundary states inside runs without blanks -------------------------------------------

    def symbols(self, a: str) -> list[int]:
        """Ids of one lattice token: a piece, or a character that is none (its bytes)."""
        if a in self.ids:
            return [self.ids[a]]
        return self.raw(a)

    def raw(self, s: str) -> list[int]:
        """Encoding without the dummy prefix: behind a newline, whose tokens are taken off again."""
        mark = "\n"
        head = self.sp.encode(mark)
        both = self.sp.encode(mark + s.replace("▁", " "))
        return both[len(head) :] if both[: len(head)] == head else self.sp.encode(s)

    def fits(self, a: str, b: str) -> bool:
        """Whether tokens a and b stay apart: the model encodes a+b as these two."""
        got = self.pairs.get((a, b))
        if got is None:
            if len(self.pairs) > _CACHE:
                self.pairs = {}
            got = self.pairs[(a, b)] = self.raw(a + b) == self.symbols(a) + self.symbols(b)
        return got

    def tokens_at(self, s: str, i: int, hi: int) -> list[str]:
        """Lattice tokens that begin at i and end by hi."""
        out = [s[i : i + n] for n in range(1, min(self.longest, hi - i) + 1) if s[i : i + n] in self.ids]
        return out if out and len(out[0]) == 1 else [s[i], *out]

    def states(self, s: str, at: int) -> list[tuple[int, int]]:
        """States at the cut ``at``: the lattice tokens [a, b) with a < at <= b, in order; the same from either side's context."""
        return [(a, a + len(t)) for a in range(max(0, at - self.longest), at) for t in self.tokens_at(s, a, len(s)) if a + len(t) >= at]

    def walk(self, s: str, entries: list, lo: int, hi: int) -> tuple[dict, dict]:
        """Tokens that valid paths from the entries reach until they end at or beyond hi: token -> set of entries (bits), token -> one predecessor. An entry is a token, or None for a path that begins at lo."""
        bits: dict = {}
        back: dict = {}
        ends: dict[int, list] = {}
        for n, e in enumerate(entries):
            bits[e] = bits.get(e, 0) | 1 << n
            ends.setdefault(lo if e is None else e[1], []).append(e)
        for i in range(min(ends, default=hi), hi):
            if i not in ends:
                continue
            for t in self.tokens_at(s, i, len(s)):
                for before in ends[i]:
                    if before is None or self.fits(s[before[0] : before[1]], t):
                        tok = (i, i + len(t))
                        if tok not in bits:
                            bits[tok], back[tok] = 0, before
                            ends.setdefault(tok[1], []).append(tok)
                        bits[tok] |= bits[before]
        return bits, back

    def safe(self, s: str, lo: int, hi: int) -> tuple[int, int] | None:
        """The first and last place in [lo, hi] where a blank follows a non-blank; None without any."""
        if not self.splits:
            return None
        last = s.rfind("▁", lo, hi + 1)
        while last > 0 and s[last - 1] == "▁":
            last -= 1
        if last < max(lo, 1):
            return None
        first = s.find("▁", lo, last + 1)
        while s[first - 1] == "▁":  # inside a run of blanks that began before lo
            first = s.find("▁", first + 1, last + 1)
        return first, last

    def frame(self, c: Chunk) -> tuple[str, int, int, list, list, int | None, int | None]:
        """The chunk with blanks as pieces have them, its cuts, the states at them, and the places between which it has one state."""
        s, lo, hi = c.part.replace(" ", "▁"), c.lo, c.lo + c.size
        first, last = self.safe(s, lo, hi) or (None, None)
        if c.no == 0 and self.splits:
            first, last = lo, last or lo
        if c.last and first is not None:
            last = hi
        return s, lo, hi, [None] if c.no == 0 else self.states(s, lo), [None] if c.last else self.states(s, hi), first, last

    def matrix(self, c: Chunk) -> np.ndarray:
        """Transfer matrix of a chunk: weight 0 from each entry state to the exit states that a valid path reaches, else minus infinity. A text's start and end are one state each."""
        s, lo, hi, entries, exits, first, last = self.frame(c)
        if first is None:
            bits, _ = self.walk(s, entries, lo, hi)
            reach = [[any(b >> n & 1 for t, b in bits.items() if t and t[1] == hi) if x is None else bits.get(x, 0) >> n & 1 for x in exits] for n in range(len(entries))]
        else:
            bits, _ = self.walk(s, entries, lo, first)
            head = [e is None or any(b >> n & 1 for t, b in bits.items() if t and t[1] == first) for n, e in enumerate(entries)]
            tail = [True] if c.last else [x in self.walk_from(s, last, hi) for x in exits]
            reach = [[h and t for t in tail] for h in head]
        return np.where(np.array(reach, bool).reshape(len(entries), len(exits)), np.float32(0), -np.float32(np.inf))

    def walk_from(self, s: str, at: int, hi: int) -> dict:
        return self.walk(s, [None], at, hi)[0] if at < hi else {t: 1 for t in self.states(s, hi) if t[1] == hi}

    def path(self, s: str, entry, lo: int, hi: int, end) -> list[int]:
        """Ids of the path's tokens from the entry to the token ``end``, or to one that ends at ``hi`` if that is None."""
        _, back = self.walk(s, [entry], lo, hi)
        t = end if end is not None else next((t for t in sorted(back) if t[1] == hi), entry)
        found = []
        while t != entry and t is not None:
            found.append(t)
            t = back[t]
        return [i for a, b in reversed(found) for i in self.symbols(s[a:b])]

    def backtrace(self, c: Chunk, entry: int, leave: int) -> tuple[list[int], str]:
        """Ids of the tokens that begin in the chunk, between the given states, and their text."""
        s, lo, hi, entries, exits, first, last = self.frame(c)
        e, x = entries[entry], exits[leave]
        if first is None:
            ids = self.path(s, e, lo, hi, x)
        else:
            ids = [] if e is None else self.path(s, e, lo, first, None)
            ids += self.encode([s[first:last].replace("▁", " ")], False)[0]
            if not c.last and last < hi:
                ids += self.path(s, None, last, hi, x)
        return ids, c.part[lo if e is None else e[1] : hi if x is None else x[1]]


@dataclass(frozen=True)
class Chunk:
    """Characters lo to lo + size of ``part`` are chunk ``no`` of a text; the rest is context."""

    no: int
    last: bool
    lo: int
    size: int
    part: str


def cut_text(text: str, chunk: int, context: int) -> list[Chunk]:
    """Chunks of ``chunk`` characters of the text with its dummy blank, with ``context`` characters around each."""
    full = " " + text
    return [Chunk(no, at + chunk >= len(full), min(at, context), min(chunk, len(full) - at), full[max(0, at - context) : at + chunk + context]) for no, at in enumerate(range(0, len(full), chunk))]


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[:, :, None] + b[None]).max(1)


def inner_states(matrices: list[np.ndarray], entry: int, leave: int) -> list[int]:
    """States at all cuts of a row of matrices on the path from state ``entry`` to state ``leave``."""
    ahead = [np.where(np.arange(matrices[0].shape[0]) == entry, np.float32(0), -np.float32(np.inf))[None]]
    for m in matrices:
        ahead.append(product(ahead[-1], m))
    behind = np.where(np.arange(matrices[-1].shape[1]) == leave, np.float32(0), -np.float32(np.inf))[:, None]
    found = [leave]
    for m, f in zip(reversed(matrices), reversed(ahead[:-1]), strict=True):
        behind = product(m, behind)
        found.append(int((f[0] + behind[:, 0]).argmax()))
    return found[::-1]


@lru_cache(maxsize=2)
def codec(model: str | bytes) -> Codec:
    return Codec(model)


def _packed(m: np.ndarray) -> bytes:
    return np.packbits(m == 0).tobytes()


def _unpacked(data: bytes, rows: int, cols: int) -> np.ndarray:
    on = np.unpackbits(np.frombuffer(data, np.uint8), count=rows * cols).reshape(rows, cols)
    return np.where(on == 1, np.float32(0), -np.float32(np.inf))


def chunk_states(matrices: DataFrame) -> DataFrame:
    """(_uid, _no, _in, _out): the states at the two cuts of each chunk, from matrices (_uid, _no, _rows, _cols, _m).

    Up: the matrices of FAN_IN neighbours become one, until each text has one. Down: a group's
    entry and exit states give those of its members. A group is FAN_IN small matrices at most.
    """
    kind = "_uid long, _no int, _rows int, _cols int, _m binary"

    def listed(table: pa.Table) -> list[np.ndarray]:
        return [_unpacked(*x) for x in zip(*(table[c].to_pylist() for c in ("_m", "_rows", "_cols")), strict=True)]

    def up(table: pa.Table) -> pa.Table:
        table = table.sort_by("_no")
        m = reduce(product, listed(table))
        cols = [table["_uid"][:1].combine_chunks(), pa.array([table["_no"][0].as_py() // FAN_IN], pa.int32()), pa.array([m.shape[0]], pa.int32()), pa.array([m.shape[1]], pa.int32()), pa.array([_packed(m)], pa.binary())]
        return pa.table(cols, names=["_uid", "_no", "_rows", "_cols", "_m"])

    def down(table: pa.Table) -> pa.Table:
        table = table.sort_by("_no")
        at = inner_states(listed(table), table["_pin"][0].as_py(), table["_pout"][0].as_py())
        return pa.table([table["_uid"], table["_no"], pa.array(at[:-1], pa.int32()), pa.array(at[1:], pa.int32())], names=["_uid", "_no", "_in", "_out"])

    group = F.floor(F.col("_no") / FAN_IN).cast("int").alias("_up")
    levels = [matrices]
    while (levels[-1].agg(F.max("_no")).first()[0] or 0) > 0:
        levels.append(materialize(levels[-1].groupBy("_uid", group).applyInArrow(up, kind), "matrices"))
    states = levels[-1].select("_uid", "_no", F.lit(0).alias("_in"), F.lit(0).alias("_out"))
    for level in reversed(levels[:-1]):
        above = states.select("_uid", F.col("_no").alias("_up"), F.col("_in").alias("_pin"), F.col("_out").alias("_pout"))
        states = level.withColumn("_up", group).join(above.hint("merge"), ["_uid", "_up"]).groupBy("_uid", "_up").applyInArrow(down, "_uid long, _no int, _in int, _out int")
    return states


def _digest(ids: list[int]) -> str:
    return hashlib.sha256(np.asarray(ids, "<i4").tobytes()).hexdigest()


def encode(docs: DataFrame, model: str = MODEL, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, keep: list[str] | None = None) -> DataFrame:
    """Token ids of each whole text: doc_id, n_tokens, ids_sha256 (little-endian 32-bit ids), round_trip[, ids].

    A text of at most ``chunk`` characters is one chunk and encoded where it is read. Longer texts
    are cut into chunks of that length, which are spread over tasks; their matrices, combined in a
    tree, give the states at the cuts, and each chunk is traced back on its own, so a text without
    any blank is spread as well. A text's chunks meet again as id arrays, bounded by the text itself.
    ``round_trip`` says whether decoding gives the text back. Null text has no tokens; repeated rows and null ids are kept; an empty table gives an
    empty result. The model file must exist on every worker; its path is a parameter.
    """
    if not os.path.exists(model):
        raise FileNotFoundError(model)
    extra = [F.col(c).alias(f"_k{j}") for j, c in enumerate(keep or [])]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("_text"), *extra)
    kinds = dict(rows.dtypes)
    more = "".join(f", `_k{j}` {kinds[f'_k{j}']}" for j in range(len(extra)))
    id_type = ", ids array<int>" if ids else ""

    def results(c: Codec, got: list[list[int]], texts: list[str]) -> list[pa.Array]:
        same = [a == b for a, b in zip(c.decode(got), texts, strict=True)]
        cols = [pa.array([len(g) for g in got], pa.int64()), pa.array([_digest(g) for g in got]), pa.array(same)]
        return [*cols, pa.array(got, pa.list_(pa.int32()))] if ids else cols

    names = ["n_tokens", "ids_sha256", "round_trip", *(["ids"] if ids else [])]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for part in slices(batches):
            piece = part["_text"].to_pylist()
            yield pa.RecordBatch.from_arrays([part["doc_id"], *results(c, c.encode(piece), piece), *part.columns[2:]], ["doc_id", *names, *part.schema.names[2:]])

    small = rows.where(F.length("_text") <= chunk).mapInArrow(whole, f"doc_id long, n_tokens long, ids_sha256 string, round_trip boolean{id_type}{more}")
    giant = rows.where(F.length("_text") > chunk).withColumn("_uid", F.monotonically_increasing_id())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = codec(model).longest
        for b in slices(batches, 100):
            for i, t in enumerate(b["_text"].to_pylist()):
                parts = cut_text(t, chunk, context)
                head = [b[x].slice(i, 1).take(pa.array([0] * len(parts))) for x in ("_uid", "doc_id", *b.schema.names[2:-1])]
                own = [pa.array([p.no for p in parts], pa.int32()), pa.array([p.last for p in parts]), pa.array([p.lo for p in parts], pa.int32()), pa.array([p.size for p in parts], pa.int32()), pa.array([p.part for p in parts])]
                yield pa.RecordBatch.from_arrays([head[0], head[1], *own, *head[2:]], ["_uid", "doc_id", "_no", "_last", "_lo", "_size", "_part", *b.schema.names[2:-1]])

    # small row groups: the chunks of one text are read by many tasks
    path = new_path(docs.sparkSession, "chunks")
    chunks = giant.mapInArrow(cut, f"_uid long, doc_id long, _no int, _last boolean, _lo int, _size int, _part string{more}")
    chunks.write.option("parquet.block.size", 8 << 20).parquet(path)
    chunks = docs.sparkSession.read.schema(chunks.schema).parquet(path)

    def listed(b: pa.RecordBatch) -> list[Chunk]:
        return [Chunk(*x) for x in zip(*(b[c].to_pylist() for c in ("_no", "_last", "_lo", "_size", "_part")), strict=True)]

    def matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in slices(batches, 100):
            ms = [c.matrix(x) for x in listed(b)]
            cols = [pa.array([m.shape[0] for m in ms], pa.int32()), pa.array([m.shape[1] for m in ms], pa.int32()), pa.array([_packed(m) for m in ms], pa.binary())]
            yield pa.RecordBatch.from_arrays([b["_uid"], b["_no"], *cols], ["_uid", "_no", "_rows", "_cols", "_m"])

    fields = ["_no", "_last", "_lo", "_size", "_part"]
    matrices = materialize(chunks.select("_uid", *fields).mapInArrow(matrix, "_uid long, _no int, _rows int, _cols int, _m binary"), "matrices")
    placed = chunks.join(chunk_states(matrices).hint("merge"), ["_uid", "_no"]).select("_uid", "doc_id", *fields, "_in", "_out", *[f"_k{j}" for j in range(len(extra))])

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in slices(batches, 100):
            got = [c.backtrace(x, i, o) for x, i, o in zip(listed(b), b["_in"].to_pylist(), b["_out"].to_pylist(), strict=True)]
            good = [x == t.removeprefix(" ") for x, (_, t) in zip(c.decode([ids for ids, _ in got]), got, strict=True)]
            yield pa.RecordBatch.from_arrays([b["_uid"], b["doc_id"], b["_no"], pa.array([ids for ids, _ in got], pa.list_(pa.int32())), pa.array(good), *b.columns[9:]], ["_uid", "doc_id", "_no", "_ids", "_good", *b.schema.names[9:]])

    coded = placed.mapInArrow(trace, f"_uid long, doc_id long, _no int, _ids array<int>, _good boolean{more}")
    kept = [F.first(f"_k{j}").alias(f"_k{j}") for j in range(len(extra))]
    met = coded.groupBy("_uid").agg(F.first("doc_id").alias("doc_id"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_no", "_ids"))), lambda x: x["_ids"])).alias("_all"), F.every("_good").alias("round_trip"), *kept)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 100):
            got = [x.values.to_numpy() if x.values is not None else np.zeros(0, np.int32) for x in b["_all"]]
            cols = [b["doc_id"], pa.array([len(g) for g in got], pa.int64()), pa.array([hashlib.sha256(np.asarray(g, "<i4").tobytes()).hexdigest() for g in got]), b["round_trip"], *([b["_all"]] if ids else [])]
            yield pa.RecordBatch.from_arrays([*cols, *b.columns[3:]], ["doc_id", *names, *b.schema.names[3:]])

    large = met.select("doc_id", "_all", "round_trip", *[f"_k{j}" for j in range(len(extra))]).mapInArrow(joined, f"doc_id long, n_tokens long, ids_sha256 string, round_trip boolean{id_type}{more}")
    out = small.unionByName(large)
    return out.select("doc_id", *names, *[F.col(f"_k{j}").alias(c) for j, c in enumerate(keep or []) if c != id_col])


def decode(coded: DataFrame, model: str = MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Texts of token id arrays; null ids give null text, no ids the empty text; repeated rows and null doc_ids are kept."""
    rows = coded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([None if x is None else c.decode([x])[0] for x in b["ids"].to_pylist()], pa.string())], ["doc_id", "text"])

    return rows.mapInArrow(task, "doc_id long, text string")
