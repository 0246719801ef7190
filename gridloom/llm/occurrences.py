"""Which 64-bit tokens occur how often in the whole corpus, as bitmaps of a fixed size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most bits of a bitmap (16 MB), whatever the input; the only thing that is broadcast. Small inputs take fewer.
BITS = 27
_FLUSH = 1_000_000


class Marks:
    """A Bloom filter with two bits for each marked token, both in the slice of the token's bucket."""

    def __init__(self, data: np.ndarray, bucket_bits: int):
        self.data, self.bucket_bits, self.bits = data, bucket_bits, (8 * len(data)).bit_length() - 1


def _places(fp: np.ndarray, local: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of 32-bit fingerprints within a slice of 2**local bits."""
    down = np.uint32(32 - local)
    return (fp >> down).astype(np.int64), ((fp * np.uint32(0x9E3779B1)) >> down).astype(np.int64)


def bit_at(marks: Marks, tokens: np.ndarray) -> np.ndarray:
    """Which tokens are marked (or seem so)."""
    local = marks.bits - marks.bucket_bits
    base = (tokens >> np.uint64(64 - marks.bucket_bits)).astype(np.int64) << local
    out = np.ones(len(tokens), bool)
    for p in _places((tokens >> np.uint64(32 - marks.bucket_bits)).astype(np.uint32), local):
        p = p + base
        out &= (marks.data[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & np.uint8(1) != 0
    return out


def occurrence_bitmaps(rows: DataFrame, tokens: Callable[[pa.RecordBatch, set], tuple[np.ndarray, ...]], at_least: tuple[tuple[int, int], ...], expected: Column, most_bits: int = BITS) -> list[Marks]:
    """Filters that mark the tokens of a kind that are counted so many times: one for each (kind, least count) of ``at_least``.

    ``tokens(some rows, set kept for the task)`` gives the tokens of the rows, an array for each
    kind; ``expected`` is about their number per row. Every token of every row is counted: tasks send
    sorted distinct 32-bit fingerprints per bucket, with counts, so a frequent token is sent once per
    million tokens; a bucket is one group, and their number follows the input up to 2**20, so each
    stays at about a million fingerprints up to 7 * 10**11 tokens and grows in proportion beyond.
    Tokens that share 40 or more leading bits count together, and some others seem marked: callers
    may only use the marks where a false one costs work, not results.
    """
    total = int(rows.agg(F.sum(expected)).first()[0] or 0)
    bits = min(most_bits, max(20, total.bit_length() + 3))
    bucket_bits = min(20, max(8, (total // 700_000).bit_length()))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: set = set()
        held: dict[int, list[np.ndarray]] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            rows = []
            for kind, parts in held.items():
                key, count = np.unique(np.concatenate(parts) >> np.uint64(32 - bucket_bits), return_counts=True)
                bucket = (key >> np.uint64(32)).astype(np.int32)
                fp, count = key.astype(np.uint32), np.minimum(count, 255).astype(np.uint8)
                edge = np.flatnonzero(np.diff(bucket)) + 1
                cut = [0, *edge.tolist(), len(key)]
                rows += [(int(bucket[a]), kind, fp[a:b].tobytes(), count[a:b].tobytes()) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            types = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["bucket", "kind", "fps", "counts"])

        for b in batches:
            for at in range(0, b.num_rows, 500):
                for kind, t in enumerate(tokens(b.slice(at, 500), state)):
                    if len(t):
                        held.setdefault(kind, []).append(t)
                        size += len(t)
                if size >= _FLUSH:
                    yield flush()
                    held, size = {}, 0
        if size:
            yield flush()

    local = bits - bucket_bits

    def merge(table: pa.Table) -> pa.Table:
        kinds = table["kind"].to_pylist()
        out = {"bucket": pa.array([table["bucket"][0].as_py()], pa.int32())}
        marks = [np.zeros(1 << local, bool) for _ in at_least]
        for kind in set(kinds):
            mine = table.filter(pa.array([k == kind for k in kinds]))
            fp = np.concatenate([np.frombuffer(x, np.uint32) for x in mine["fps"].to_pylist()])
            count = np.concatenate([np.frombuffer(x, np.uint8) for x in mine["counts"].to_pylist()]).astype(np.int64)
            order = np.argsort(fp, kind="stable")
            fp, count = fp[order], count[order]
            first = np.flatnonzero(np.concatenate([[True], fp[1:] != fp[:-1]]))
            sums = np.add.reduceat(count, first)
            one, two = _places(fp[first], local)
            for m, (of, least) in zip(marks, at_least, strict=True):
                if of == kind:
                    m[one[sums >= least]] = m[two[sums >= least]] = True
        for i, m in enumerate(marks):
            out[f"b{i}"] = pa.array([np.packbits(m).tobytes()], pa.binary())
        return pa.table(out)

    schema = "bucket int" + "".join(f", b{i} binary" for i in range(len(at_least)))
    slices = rows.mapInArrow(emit, "bucket int, kind int, fps binary, counts binary").groupBy("bucket").applyInArrow(merge, schema)
    maps = [np.zeros(1 << (bits - 3), np.uint8) for _ in at_least]
    width = 1 << (local - 3)
    for row in slices.toLocalIterator():  # at most 2**bits bits in all, for each map
        for i, m in enumerate(maps):
            m[row.bucket * width : (row.bucket + 1) * width] = np.frombuffer(row[f"b{i}"], np.uint8)
    return [Marks(m, bucket_bits) for m in maps]
