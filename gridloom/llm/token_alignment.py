"""Cross-tokenizer alignment: tokens of a byte-level BPE (A) and of a SentencePiece model (B) over the same bytes.

Tokenizers' character offsets and the spans of SentencePiece's proto (``immutable_proto`` in older releases) are
coarse cuts: where a token's span ends before the next one's begins, its end is known. Tokens that end
inside a character, and byte-fallback tokens, whose spans are empty, get their ends from the lengths of their decoded
bytes, counted from the last coarse cut. Where tokens of both end, a group ends; all pairs in a group are linked.

Both tokenizers begin a token at a blank between two characters that are no white space, so a text is
cut there into words, each distinct one is encoded and aligned once, and a text's results are those of its words in a
row. Texts of any length are read a million characters at a time.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import materialize, slices

A_FILE = "/opt/tokenizers/byte_bpe_50k.json"
B_FILE = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters of text that share a table of id pairs, and characters that are cut into words at once.
BLOCK, PART = 4 << 20, 1 << 20
#: Distinct words, and their characters, that are remembered.
WORDS, CHARS = 300_000, 8 << 20
_CUT = re.compile(r"(?<=\S) (?=\S)")


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _ends(lens: np.ndarray, coarse: np.ndarray, known: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Byte ends of tokens: ``coarse`` where ``known``, else the last known end, or the word's start ``base``, plus the decoded bytes since."""
    total = np.cumsum(lens)
    at = np.maximum.accumulate(np.where(known, np.arange(len(lens)), -1))
    before = np.maximum(at, 0)
    start = total - lens
    fresh = (at < 0) | (base > coarse[before])  # no known end yet in this word
    first = np.searchsorted(base, base, "left")
    return np.where(known, coarse, np.where(fresh, base + total - start[first], coarse[before] + total - total[before]))


class Aligner:
    """Both tokenizers and the aligned words so far, as flat arrays."""

    def __init__(self, a_file: str, b_file: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        alphabet = byte_alphabet()
        special = {i: t.content.encode() for i, t in self.a.get_added_tokens_decoder().items()}
        names = {i: w for w, i in self.a.get_vocab().items()}
        self.a_bytes = [special[i] if i in special else bytes(alphabet[c] for c in names.get(i, "")) for i in range(max(names) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.spelling = np.array([str(i) for i in range(max(len(self.a_bytes), len(pieces)))], object)
        self.a_len, self.b_len = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.chars = 0
        self.text: list[str] = []  # groups as text
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.flat: tuple[np.ndarray, ...] | None = None

    def encode(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """Tokens of the words, each with a blank before it, one after the other.

        Which words have the right bytes in both; where each word begins in the bytes of all; and for A and B ids, byte ends
        and words of the tokens of these words. Words without white space at an end are encoded in one text, which both
        tokenizers cut at the blanks; if their bytes don't come back so, and for others, each word is a text.
        """
        raw = [b" " + w.encode("utf-8", "replace") for w in words]
        begin = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        data = b"".join(raw)
        chars = np.append(np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80), begin[-1])
        plain = all("▁" not in w and w and not (w[0].isspace() or w[-1].isspace()) for w in words)
        whole = [" ".join(words)] if plain else words
        a = [self.a.encode(" " + w, add_special_tokens=False) for w in whole]
        b = self.b.encode(whole, return_type="proto", num_threads=1)
        a_ids, b_parts = [x.ids for x in a], [[(p.id, p.begin, p.end) for p in x.pieces] for x in b]
        n_a, n_b = np.array([len(x) for x in a_ids], np.int64), np.array([len(x) for x in b_parts], np.int64)
        ida = np.fromiter(chain.from_iterable(a_ids), np.int64, n_a.sum())
        off = np.fromiter(chain.from_iterable(chain.from_iterable(x.offsets for x in a)), np.int64, 2 * n_a.sum()).reshape(-1, 2)
        got = np.fromiter(chain.from_iterable(chain.from_iterable(b_parts)), np.int64, 3 * n_b.sum()).reshape(-1, 3)
        idb = got[:, 0]
        bytes_a, bytes_b = (list(map(t.__getitem__, ids.tolist())) for t, ids in ((self.a_bytes, ida), (self.b_bytes, idb)))
        text_of = np.array([0]) if plain else np.arange(len(words))  # the first word of each encoded text
        ta, tb = np.repeat(text_of, n_a), np.repeat(text_of, n_b)
        if plain:
            good = np.ones(len(words), bool)
            if not b"".join(bytes_a) == b"".join(bytes_b) == data:
                if len(words) > 1:
                    return self.halves(words)
                good[:] = False
        else:
            ca, cb = np.cumsum(n_a).tolist(), np.cumsum(n_b).tolist()
            good = np.array([b"".join(bytes_a[ca[i - 1] if i else 0 : ca[i]]) == b"".join(bytes_b[cb[i - 1] if i else 0 : cb[i]]) == raw[i] for i in range(len(words))], bool)

        def ends(ids: np.ndarray, lens: np.ndarray, text: np.ndarray, lo: np.ndarray, hi: np.ndarray, coarse: np.ndarray) -> tuple[np.ndarray, ...]:
            keep = good[text]
            ids, text, lo, hi, coarse = ids[keep], text[keep], lo[keep], hi[keep], coarse[keep]
            last = np.append(text[1:] != text[:-1], True) if len(text) else np.zeros(0, bool)
            known = last | ((np.append(lo[1:], 0) >= hi) & (hi > lo))
            end = _ends(lens[ids], coarse, known, begin[text])
            return ids, end, np.searchsorted(begin, end, "left") - 1

        first = np.searchsorted(chars, begin)
        of_a = ends(ida, self.a_len, ta, off[:, 0], off[:, 1], chars[np.minimum(first[ta] + off[:, 1], len(chars) - 1)])
        of_b = ends(idb, self.b_len, tb, got[:, 1], got[:, 2], begin[tb] + 1 + got[:, 2])
        if plain and good.all() and not (np.isin(begin[1:], of_a[1]).all() and np.isin(begin[1:], of_b[1]).all()):
            return self.halves(words)
        return good, begin, *of_a, *of_b

    def halves(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """encode of either half, put together."""
        cut = len(words) // 2
        x, y = self.encode(words[:cut]), self.encode(words[cut:])
        at = x[1][-1]
        return np.append(x[0], y[0]), np.append(x[1][:-1], y[1] + at), *(np.append(x[k], y[k] + shift) for k, shift in ((2, 0), (3, at), (4, cut), (5, 0), (6, at), (7, cut)))

    def learn(self, words: list[str]) -> None:
        """Encode and align words that aren't known yet: each is a blank and the word."""
        n = len(words)
        good, _, ida, end_a, wa, idb, end_b, wb = self.encode(words)
        cuts = np.intersect1d(end_a, end_b, assume_unique=True)
        ga, gb = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
        word = np.zeros(len(cuts), np.int64)  # the word of each group
        word[ga] = wa
        # linked pairs of ids of each group, with their number; equal ids of a group are counted first
        ua, ca = np.unique((ga << 20) + ida, return_counts=True)
        ub, cb = np.unique((gb << 20) + idb, return_counts=True)
        lo = np.searchsorted(ub >> 20, ua >> 20)
        many = np.searchsorted(ub >> 20, ua >> 20, "right") - lo
        at = np.repeat(np.arange(len(ua)), many)
        other = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
        pair = ((ua[at] & 0xFFFFF) << 20) + (ub[other] & 0xFFFFF)
        links, owner = ca[at] * cb[other], word[ua[at] >> 20]
        owner, pair, links = _Block._merged(owner, pair, links)
        per = [np.bincount(x, y, n).astype(np.int64) for x, y in ((wa, None), (wb, None), (word, None), (owner, links))]
        self.parts.append((*per, np.bincount(owner, minlength=n), pair, links, good))
        self.flat = None
        # the groups as text: tokens of A, then of B, group by group, each with what follows it
        group, side = np.concatenate([ga, gb]), np.repeat([0, 1], [len(ga), len(gb)])
        order = np.argsort(2 * group + side, kind="stable")
        group, side, ids = group[order], side[order], np.concatenate([ida, idb])[order]
        after = np.zeros(len(ids), np.int64)
        if len(ids):
            after[:-1] = np.where(group[1:] != group[:-1], np.where(word[group[1:]] != word[group[:-1]], 3, 2), side[1:] != side[:-1])
            after[-1] = 3
        spelled: list[str] = [""] * (2 * len(ids))
        spelled[0::2] = self.spelling[ids].tolist()
        spelled[1::2] = np.array([",", "|", ";", "\n"], object)[after].tolist()
        texts, base = [""] * n, len(self.text)
        for w, t in zip(np.unique(word).tolist(), "".join(spelled).split("\n"), strict=False):
            texts[w] = t
        self.text += texts
        self.index.update(zip(words, range(base, base + n), strict=True))
        self.chars += sum(map(len, words))

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words of all texts in a row, and each text's number of words."""
        split = [_CUT.split(t) for t in texts]
        all_ = [w for s in split for w in s]
        ix = np.fromiter(map(self.index.get, all_, repeat(-1)), np.int64, len(all_))
        missing = np.flatnonzero(ix < 0).tolist()
        new = list({all_[i] for i in missing})
        if len(self.index) + len(new) > WORDS or self.chars + sum(map(len, new)) > CHARS:
            self.clear()
            new, missing = list(set(all_)), range(len(all_))
        odd = [w for w in new if "▁" in w or not w or w[0].isspace() or w[-1].isspace()]
        if odd:
            self.learn(odd)
            new = [w for w in new if w not in self.index]
        for at in range(0, len(new), 4_000):
            self.learn(new[at : at + 4_000])
        if new or odd:
            ix[missing] = np.fromiter((self.index[all_[i]] for i in missing), np.int64, len(missing))
        return ix, np.array([len(s) for s in split], np.int64)

    def tables(self) -> tuple[np.ndarray, ...]:
        """n_a, n_b, n_groups, n_links of each word; places of its pairs; pairs and their links."""
        if self.flat is None:
            self.parts = [tuple(np.concatenate(x) for x in zip(*self.parts, strict=True))]
            *per, count, pair, links, good = self.parts[0]
            self.flat = (*per, np.concatenate([[0], np.cumsum(count)]), pair, links, good)
        return self.flat


@lru_cache(maxsize=1)
def aligner(a_file: str, b_file: str) -> Aligner:
    return Aligner(a_file, b_file)


def _parts(text: str) -> list[str]:
    """A long text cut at blanks between characters that are no white space, about PART characters each."""
    out, at = [], 0
    while len(text) - at > PART and (m := _CUT.search(text, at + PART)):
        out.append(text[at : m.start()])
        at = m.end()
    out.append(text[at:])
    return out


class _Block:
    """Counts, digests and linked id pairs of the documents of one block."""

    def __init__(self, al: Aligner):
        self.al, self.n, self.chars = al, 0, 0
        self.counts: list[np.ndarray] = []
        self.digests: list[str] = []
        self.pairs: list[tuple[np.ndarray, ...]] = []

    def add(self, texts: list[str]) -> None:
        group: list[str] = []
        for t in texts:
            if len(t) > PART:
                self._some(group)
                group = []
                self._giant(t)
            else:
                group.append(t)
                if sum(map(len, group[-64:])) > PART or len(group) >= 512:
                    self._some(group)
                    group = []
        self._some(group)

    def _count(self, texts: list[str], doc: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words, their number for each text, and the four counts (-1: bytes differ); keeps the pairs."""
        ix, n = self.al.words(texts)
        na, nb, ng, nl, at, pair, links, good = self.al.tables()
        row = np.repeat(np.arange(len(texts)), n)
        ok = np.bincount(row, ~good[ix], len(texts)) == 0
        counts = np.stack([np.bincount(row, x[ix], len(texts)).astype(np.int64) for x in (na, nb, ng, nl)], 1)
        counts[~ok] = -1
        key, many = np.unique(row[ok[row]] * len(good) + ix[ok[row]], return_counts=True)
        row, w = key // len(good), key % len(good)
        size = at[w + 1] - at[w]
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(at[w], size)
        self.pairs.append(self._merged(np.repeat(np.asarray(doc)[row], size), pair[place], links[place] * np.repeat(many, size)))
        return ix, n, counts

    @staticmethod
    def _merged(doc: np.ndarray, pair: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, ...]:
        key = (doc << 40) + pair
        order = np.argsort(key)
        key, links = key[order], links[order]
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        return key[start] >> 40, key[start] & ((1 << 40) - 1), np.add.reduceat(links, start) if len(start) else links

    def _some(self, texts: list[str]) -> None:
        full = [i for i, t in enumerate(texts) if t]
        counts, digests = np.zeros((len(texts), 4), np.int64), [""] * len(texts)
        if full:
            ix, n, got = self._count([texts[i] for i in full], [self.n + i for i in full])
            counts[full] = np.maximum(got, 0)
            names, z = self.al.text, 0
            for i, k, ok in zip(full, n.tolist(), (got[:, 0] >= 0).tolist(), strict=True):
                if ok:
                    digests[i] = hashlib.sha256(";".join([names[j] for j in ix[z : z + k].tolist()]).encode()).hexdigest()
                z += k
        self.counts.append(counts)
        self.digests += digests
        self.n += len(texts)
        self.chars += sum(map(len, texts))

    def _giant(self, text: str) -> None:
        h, total, ok, mark = hashlib.sha256(), np.zeros(4, np.int64), True, len(self.pairs)
        for no, part in enumerate(_parts(text)):
            ix, _, got = self._count([part], [self.n])
            ok &= bool(got[0, 0] >= 0)
            total += got[0]
            h.update(((";" if no else "") + ";".join([self.al.text[j] for j in ix.tolist()])).encode())
        if not ok:
            del self.pairs[mark:]
        self.counts.append(total[None] if ok else np.zeros((1, 4), np.int64))
        self.digests.append(h.hexdigest() if ok else "")
        self.n += 1
        self.chars += len(text)

    def rows(self) -> tuple[np.ndarray, list[str], list[bytes], list[bytes], np.ndarray, np.ndarray]:
        """Counts, digests, each document's pairs (places in the block's sorted pairs) and links, the block's pairs and their number of documents."""
        doc, pair, links = self._merged(*(np.concatenate(x) for x in zip(*self.pairs, strict=True))) if self.pairs else (np.zeros(0, np.int64),) * 3
        known, place, count = np.unique(pair, return_inverse=True, return_counts=True)
        cut = np.searchsorted(doc, np.arange(self.n + 1))
        place, links = place.astype("<i4"), links.astype("<i8")
        packed = [[x[cut[i] : cut[i + 1]].tobytes() for i in range(self.n)] for x in (place, links)]
        counts = np.concatenate(self.counts) if self.counts else np.zeros((0, 4), np.int64)
        return counts, self.digests, *packed, known, count


_COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def align(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each whole text.

    The count of an id pair is the number of documents that hold it linked; n_best counts the links whose pair has the
    highest count of all pairs of its A id, count_sum adds the counts up over the links. Texts whose joined token bytes
    aren't a blank and the text (those with U+2581, say), null and empty ones have zeros and ''. Repeated rows are documents of
    their own, null ids are kept, an empty table gives an empty result, other columns are not read.

    A task aligns blocks of ``block`` characters: a document keeps its pairs as places in its block's list. Only the
    blocks' lists are shuffled by pair, summed, and joined back; then each block meets its own counts. A run without such
    blanks is encoded as one word, by the libraries, in one task.
    """
    for path in (a_file, b_file):
        if not os.path.exists(path):
            raise FileNotFoundError(path)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    kind = "block long, doc_id long, head boolean, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, places binary, links binary"
    names = [x.split()[0] for x in kind.split(", ")]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al, no, ids = aligner(a_file, b_file), TaskContext.get().partitionId() << 32, []
        now = _Block(al)

        def close() -> Iterator[pa.RecordBatch]:
            counts, digests, places, links, pairs, n = now.rows()
            for lo in range(0, len(ids), 200):
                part = slice(lo, lo + 200)
                size = len(ids[part])
                yield pa.RecordBatch.from_arrays([pa.array([no] * size), pa.array(ids[part], pa.int64()), pa.array([False] * size), *[pa.array(c) for c in counts[part].T], pa.array(digests[part]), pa.array(places[part], pa.binary()), pa.array(links[part], pa.binary())], names)
            none = [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array([no]), pa.nulls(1, pa.int64()), pa.array([True]), *none, pa.array([pairs.astype("<i8").tobytes()], pa.binary()), pa.array([n.astype("<i8").tobytes()], pa.binary())], names)

        for b in slices(batches, 200):
            now.add(b["t"].to_pylist())
            ids += b["doc_id"].to_pylist()
            if now.chars >= block:
                yield from close()
                now, ids, no = _Block(al), [], no + 1
        if ids:
            yield from close()

    held = materialize(rows.mapInArrow(task, kind), "aligned", "zstd")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, x, n in zip(b["block"].to_pylist(), b["places"].to_pylist(), b["links"].to_pylist(), strict=True):
                pair = np.frombuffer(x, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), at)), pa.array(np.arange(len(pair), dtype=np.int32)), pa.array((pair >> 20).astype(np.int32)), pa.array((pair & 0xFFFFF).astype(np.int32)), pa.array(np.frombuffer(n, "<i8"))], ["block", "i", "a", "b", "n"])

    pairs = held.where("head").select("block", "places", "links").mapInArrow(unpack, "block long, i int, a int, b int, n long")
    counts = pairs.groupBy("a", "b").agg(F.sum("n").alias("c"))
    counts = counts.withColumn("top", F.col("c") == F.max("c").over(Window.partitionBy("a")))
    back = pairs.join(counts, ["a", "b"]).select("block", "i", "c", "top")

    def total(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("i")
        c, top = right["c"].to_numpy(), right["top"].to_numpy()
        places, links = left["places"].to_pylist(), left["links"].to_pylist()
        place, link = np.frombuffer(b"".join(places), "<i4"), np.frombuffer(b"".join(links), "<i8")
        cut = np.concatenate([[0], np.cumsum([len(x) // 4 for x in places])]).astype(np.int64)
        sums = [np.concatenate([[0], np.cumsum(x)]) for x in (link * top[place], link * c[place])]
        best, all_ = (s[cut[1:]] - s[cut[:-1]] for s in sums)
        cols = [left["doc_id"], *[left[x] for x in _COUNTS], pa.array(best.astype(np.int64)), pa.array(all_.astype(np.int64)), left["groups_sha256"]]
        return pa.table(cols, names=["doc_id", *_COUNTS, "n_best", "count_sum", "groups_sha256"])

    own = held.where("not head").drop("head").groupBy("block")
    return own.cogroup(back.groupBy("block")).applyInArrow(total, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def token_spans(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, a_ids, a_ends, b_ids, b_ends: the tokens of both and where they end, in bytes of a blank and the text.

    Null, empty and unequal texts have empty arrays; repeated rows and null ids are kept.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))

    def one(al: Aligner, text: str) -> list[np.ndarray]:
        out: list[list[np.ndarray]] = [[], [], [], []]
        at = 0
        for part in _parts(text) if text else []:
            good, begin, ida, end_a, _, idb, end_b, _ = al.encode(_CUT.split(part))
            if not good.all():
                return [np.zeros(0, np.int64)] * 4
            for k, x in enumerate((ida, end_a + at, idb, end_b + at)):
                out[k].append(x)
            at += int(begin[-1])
        return [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = aligner(a_file, b_file)
        for b in slices(batches, 100):
            got = [one(al, t) for t in b["t"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], *[pa.array([g[k] for g in got], pa.list_(pa.int64())) for k in range(4)]], ["doc_id", "a_ids", "a_ends", "b_ids", "b_ends"])

    return rows.mapInArrow(task, "doc_id long, a_ids array<long>, a_ends array<long>, b_ids array<long>, b_ends array<long>")
