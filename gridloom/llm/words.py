"""Vectorised word, shingle and window hashes of whole texts (numpy, inside Arrow tasks).

A word is a maximal run of bytes outside [\\x20\\x09-\\x0D]. Hashes are 64-bit: a polynomial over
random byte weights, finished with a mixing step; two different inputs agree with a chance of
about 2**-56. Texts are hashed in blocks of half a MB, so memory doesn't follow the text length.
"""

from __future__ import annotations

import hashlib

import numpy as np

_U = np.uint64
_B = 0x9E3779B97F4A7C15  # = 5 mod 8, so powers stay far apart
_C = 0xC2B2AE3D27D4EB4D
_BLOCK = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_WEIGHT = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD1342543DE82EF95))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        n = max(n, 1 << 16)
        up, down = np.full(n, _U(base)), np.full(n, _U(pow(base, -1, 1 << 64)))
        up[0] = down[0] = _U(1)
        have = _POWERS[base] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return have


def _spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    space = np.ones(len(data) + 2, bool)
    space[1:-1] = _IS_SPACE[data]
    edges = np.flatnonzero(space[1:] != space[:-1])
    return edges[0::2], edges[1::2]


def _block(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of words and their hashes in one block."""
    starts, ends = _spans(data)
    up, down = _powers(_B, len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_WEIGHT[data] * up[: len(data)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return starts, mix(h ^ ((ends - starts).astype(np.uint64) << _U(48)))


def _cut(text: bytes) -> list[bytes]:
    """Pieces of about a block, cut at white space only; a word longer than a block is one piece."""
    pieces, at, data = [], 0, np.frombuffer(text, np.uint8)
    while len(text) - at > _BLOCK:
        end = max(text.rfind(c, at + 1, at + _BLOCK) for c in (b" ", b"\n", b"\t"))
        if end <= at:
            end = at + _BLOCK
            while end < len(text) and not (space := _IS_SPACE[data[end : end + _BLOCK]]).any():
                end += _BLOCK
            end = end + int(space.argmax()) if end < len(text) else len(text)
        pieces.append(text[at:end])
        at = end
    return [*pieces, text[at:]]


def hash_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and the offsets of each text's words (len(texts) + 1)."""
    counts, hashes = np.zeros(len(texts) + 1, np.int64), []
    group: list[bytes] = []
    which: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal group, which, size
        if group:
            begin = np.cumsum([0] + [len(t) + 1 for t in group])
            starts, h = _block(np.frombuffer(b"\n".join(group), np.uint8))
            of = np.searchsorted(begin, starts, "right") - 1
            np.add.at(counts, np.asarray(which)[of] + 1, 1)
            hashes.append(h)
        group, which, size = [], [], 0

    for i, text in enumerate(texts):
        for piece in _cut(text) if len(text) > _BLOCK else (text,):
            if size + len(piece) > _BLOCK:
                flush()
            group.append(piece)
            which.append(i)
            size += len(piece) + 1
    flush()
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.cumsum(counts)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive word hashes: len(h) - k + 1 values, none if h is shorter."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, step = np.empty(n, np.uint64), 1 << 18
    for a in range(0, n, step):
        b = min(n, a + step)
        part = h[a : b + k - 1]
        up, down = _powers(_C, len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=sums[1:])
        out[a:b] = mix((sums[k:] - sums[: b - a]) * down[: b - a] + _U(k))
    return out


def shingle_set(h: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct k-word shingles; fewer words: the whole sequence as one; no words: empty."""
    if len(h) == 0:
        return h
    return np.unique(windows(h, k)) if len(h) >= k else windows(h, len(h))


def digest(tokens: np.ndarray) -> bytes:
    """128-bit digest of an array of tokens."""
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
