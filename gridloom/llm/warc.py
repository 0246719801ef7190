"""WARC archives: writing with revisit records, and reading by boundary-chain verification."""

from __future__ import annotations

import base64
import gzip
import hashlib
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from gridloom.llm.common import materialize, new_path, text_or_empty

_CRLF2 = b"\r\n\r\n"
_SEPARATOR = re.compile(rb"\r\n(?=\r\n)")
_MAGIC = re.compile(rb"WARC/1\.[01](?=\r\n)")
_LENGTH = re.compile(rb"\r\nContent-Length:[ \t]*(\d{1,18})[ \t]*(?=\r\n)", re.IGNORECASE)
#: Compressed bytes after which a task goes on in a new archive.
FILE_BYTES = 128 << 20
#: Bytes of an archive that are searched for records at a time.
BLOCK = 4 << 20


def _folder(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and place of a folder that Spark names by a URI or a local path."""
    if "://" not in path and not path.startswith("file:"):
        path = os.path.abspath(path)
    return pyarrow.fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", re.sub("^file:/(?!/)", "file:///", path)))


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


class _ArchiveWriter(DataSourceArrowWriter):
    """Writes the column ``value`` (binary) as gzip members, one per record, so that each record can be read alone.

    A task writes below ``_writing`` under names of its own; the driver moves the files of committed
    tasks into place, so a repeated or lost task leaves nothing that readers see.
    """

    def __init__(self, path: str, file_bytes: int):
        self.path, self.file_bytes = path, file_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        fs, root = _folder(self.path)
        fs.create_dir(f"{root}/_writing", recursive=True)
        names, out, size = [], None, 0
        for batch in iterator:
            for value in batch["value"]:
                if out is None:
                    names.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, size = fs.open_output_stream(f"{root}/_writing/{names[-1]}", compression=None), 0
                member = gzip.compress(value.as_py() + _CRLF2, mtime=0)
                out.write(member)
                size += len(member)
                if size >= self.file_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return _Written(names)

    def commit(self, messages: list[_Written | None]) -> None:
        fs, root = _folder(self.path)
        fs.create_dir(f"{root}/_writing", recursive=True)
        for name in [n for m in messages if m for n in m.names]:
            fs.move(f"{root}/_writing/{name}", f"{root}/{name}")
        fs.delete_dir(f"{root}/_writing")

    def abort(self, messages: list[_Written | None]) -> None:
        fs, root = _folder(self.path)
        if fs.get_file_info(f"{root}/_writing").type != pyarrow.fs.FileType.NotFound:
            fs.delete_dir(f"{root}/_writing")


class _Archives(DataSource):
    """Spark's sink for archives."""

    @classmethod
    def name(cls) -> str:
        return "gridloom_warc"

    def writer(self, schema, overwrite: bool) -> _ArchiveWriter:
        return _ArchiveWriter(self.options["path"], int(self.options["filebytes"]))


def _uuid(hex32: Column) -> Column:
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(hex32, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _ranked(rows: DataFrame) -> DataFrame:
    """rows with _first (whether the row is its payload's response) and _best (the response's page id); one row per row.

    No row number is made: rows that equal the response in payload, page id and URL are counted and
    written out again, so the choice is the same however often Spark evaluates it.
    """
    sizes = rows.groupBy("_key", "_id").agg(F.count(F.lit(1)).alias("_n"))
    best = sizes.groupBy("_key").agg(F.max(F.struct("_id", "_n")).alias("b")).select("_key", F.col("b._id").alias("_best"), F.col("b._n").alias("_n"))
    best = materialize(best, "warc-best")
    top = F.col("_id").eqNullSafe(F.col("_best"))
    cols = [*rows.columns, "_best", "_first"]
    plain = rows.join(best.hint("merge"), "_key").withColumn("_first", top).where(~(top & (F.col("_n") > 1))).select(*cols)
    if best.where("_n > 1").isEmpty():
        return plain
    tied = rows.join(best.where("_n > 1").hint("merge"), "_key").where(top)
    tied = materialize(tied.groupBy("_key", "_id", "_url", "_sha1", "_best").agg(F.count(F.lit(1)).alias("_c"), F.first("_html").alias("_html")), "warc-tied")
    one = tied.groupBy("_key").agg(F.max("_url").alias("_top")).hint("merge")
    tied = tied.join(one, "_key").withColumn("_lead", (F.col("_url") == F.col("_top")).cast("long"))
    run = 65536
    runs = tied.where("_c > _lead").withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_c") - F.col("_lead") - 1, F.lit(run).cast("long"))))
    others = runs.withColumn("_i", F.explode(F.sequence(F.col("_run"), F.least(F.col("_run") + run, F.col("_c") - F.col("_lead")) - 1)))
    return plain.unionByName(tied.where("_lead = 1").withColumn("_first", F.lit(True)).select(*cols)).unionByName(others.withColumn("_first", F.lit(False)).select(*cols))


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", file_bytes: int = FILE_BYTES) -> None:
    """Write one record per row into gzip archives below ``path``, each record a gzip member.

    Of records with equal payloads (by SHA-256) the one with the largest page id (null lowest; of
    repeated ids the one with the largest URL; of wholly equal rows one) is a ``response`` with the
    payload; the others are ``revisit`` records without a block that refer to it. Null html is an
    empty payload; a null or odd URL is written with blanks and control characters percent-encoded;
    an empty table writes no archive; other columns are not read. Payloads are shuffled once, by
    digest; equal payloads of a hot group are split by the skew join.
    """
    payload = text_or_empty(html_col)
    rows = pages.select(
        F.col(id_col).cast("long").alias("_id"),
        F.regexp_replace(text_or_empty(url_col), r"[\x00-\x20\x7f]", "%20").alias("_url"),
        payload.alias("_html"),
        F.sha2(payload, 256).alias("_key"),
        F.sha1(payload.cast("binary")).alias("_sha1"),
    )
    first, response = F.col("_first"), _uuid(F.md5("_key"))
    b32 = F.concat(*[F.lpad(F.conv(F.substring("_sha1", 10 * g + 1, 10), 16, 32), 8, "0") for g in range(4)])
    b32 = F.translate(F.upper(b32), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("_html").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(first, F.concat(http, F.col("_html"))).otherwise(F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(first, "response").otherwise("revisit"),
        F.lit("\r\nWARC-Record-ID: "), F.when(first, response).otherwise(F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">"))),
        F.lit("\r\nWARC-Date: 2026-01-01T00:00:00Z\r\nWARC-Target-URI: "), F.col("_url"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), b32,
        F.when(F.col("_id").isNotNull(), F.concat(F.lit("\r\nX-Page-Id: "), F.col("_id").cast("string"))).otherwise(""),
        F.when(first, F.lit("")).otherwise(F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), response)),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"),
    )
    pages.sparkSession.dataSource.register(_Archives)
    _ranked(rows).select(F.concat(head, block).cast("binary").alias("value")).write.format("gridloom_warc").mode("append").option("filebytes", file_bytes).save(path)


def links(buf: bytes, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Candidate records of a block that begins at offset ``base``: start, block start, block length, successor; every magic with a length is one, also inside payloads.

    Only offsets are kept, and each position of the block is looked at once, whatever the candidates claim.
    """
    starts = np.array([m.start() for m in _MAGIC.finditer(buf)], np.int64)
    ends = np.array([m.start() for m in _SEPARATOR.finditer(buf)], np.int64)
    told = [(m.start(), m.end(), int(m[1])) for m in _LENGTH.finditer(buf)]
    place, close, size = (np.array([t[i] for t in told], np.int64) for i in range(3))
    e, t = np.searchsorted(ends, starts), np.searchsorted(place, starts)
    good = (e < len(ends)) & (t < len(place))
    starts, e, t = starts[good], e[good], t[good]
    good = close[t] <= ends[e]
    starts, e, t = starts[good], e[good], t[good]
    block = base + ends[e] + 4
    return base + starts, block, size[t], block + size[t] + 4


def jump(starts: np.ndarray, succ: np.ndarray, entry: int) -> np.ndarray:
    """Numbers of the candidates on the chain from ``entry``, by pointer jumping: after round k the chain's first 2**k records are known."""
    n = len(starts)
    at = int(np.searchsorted(starts, entry))
    if at == n or starts[at] != entry:
        return np.zeros(0, np.int64)
    far = np.searchsorted(starts, succ)
    far[(far == n) | (starts[np.minimum(far, n - 1)] != succ)] = n
    far = np.append(far, n)
    seen = np.zeros(n + 1, bool)
    seen[at] = True
    while True:
        new = seen.copy()
        new[far[seen]] = True
        if (new == seen).all():
            return np.flatnonzero(seen[:n])
        seen, far = new, far[far]


@dataclass
class _Record:
    """A record on the chain; its block is hashed as it comes."""

    file: str
    start: int
    fields: dict[str, str]
    left: int
    keep: bool
    head: bytes | None = b""
    size: int = 0
    sha: "hashlib._Hash" = field(default_factory=hashlib.sha1)
    parts: list[bytes] = field(default_factory=list)

    def feed(self, data: bytes) -> None:
        self.left -= len(data)
        if self.head is not None:  # still within the HTTP header, of which the last bytes are held
            data = self.head + data
            if len(data) < 5 and self.left:
                self.head = data
                return
            if data.startswith(b"HTTP/") or self.head.startswith(b"\0"):
                data = data.removeprefix(b"\0")
                at = data.find(_CRLF2)
                if at < 0:
                    self.head = b"\0" + data[-3:]
                    return
                data = data[at + 4 :]
            self.head = None
        self.sha.update(data)
        self.size += len(data)
        if self.keep:
            self.parts.append(data)

    def row(self) -> tuple:
        page = self.fields.get("x-page-id", "")
        return (self.file, self.start, self.fields.get("warc-type"), self.fields.get("warc-record-id"), self.fields.get("warc-refers-to"), int(page) if re.fullmatch(r"-?\d{1,18}|-?\d{19}", page) else None,
                self.fields.get("warc-target-uri"), self.size, base64.b32encode(self.sha.digest()).decode(), b"".join(self.parts) if self.keep else None)


def _fields(header: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in header.decode("utf-8", "replace").split("\r\n")[1:])}


def _records(pieces: Iterator[tuple[str, bytes]], keep: bool, block_bytes: int) -> Iterator[tuple]:
    """Records of archives whose pieces come in order: block by block the candidates' links, the chain by pointer jumping, then the hashes of what is on it."""
    name, base, entry, buf, size, open_ = None, 0, 0, [], 0, None

    def settle() -> Iterator[tuple]:
        nonlocal base, entry, open_
        data = b"".join(buf)
        if open_ is not None:
            open_.feed(data[: open_.left])
            if open_.left == 0:
                yield open_.row()
                open_ = None
        if entry < base + len(data):
            starts, block, length, succ = links(data, base)
            chain = jump(starts, succ, entry)
            for i in chain.tolist():
                a, z = int(block[i]) - base, int(block[i] + length[i]) - base
                open_ = _Record(name, int(starts[i]), _fields(data[int(starts[i]) - base : a - 4]), int(length[i]), keep)
                open_.feed(data[a:z])
                if open_.left == 0:
                    yield open_.row()
                    open_ = None
            entry = int(succ[chain[-1]]) if len(chain) else 1 << 62  # a broken chain reaches nothing more
        base += len(data)

    for file, piece in pieces:
        if file != name:
            yield from settle()
            name, base, entry, buf, size, open_ = file, 0, 0, [], 0, None
        buf += [piece, _CRLF2]
        size += len(piece) + 4
        if size >= block_bytes:
            yield from settle()
            buf, size = [], 0
    yield from settle()


_FIELDS = "file string, start long, record_type string, record_id string, refers_id string, page_id long, url string, payload_bytes long, payload_digest string, payload binary"


def read_warc(spark: SparkSession, path: str, payload: bool = False, block_bytes: int = BLOCK) -> DataFrame:
    """Records of the gzip archives below ``path``: page_id, url, record_type, payload_bytes, payload_digest, refers_to[, payload].

    A gzip archive can't be split, so a task reads it in order, a block at a time. Every magic in a
    block is a candidate with the offset where its successor would start; pointer jumping over these
    links keeps only the candidates that are reached from the file's start (the block's entry is
    where the chain left the blocks before), so a magic inside a payload is rejected. Candidates
    cost two offsets each; only records on the chain are parsed and hashed, as they stream by.
    A record cut off by the archive's end is left out. Revisits take the length and digest of the
    payload they refer to, by one join of record headers. Payloads stay in the task unless asked for.
    """
    pieces = spark.read.schema("value string").option("lineSep", "\r\n\r\n").option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(f.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[f.split()[1]]) for f in _FIELDS.split(", ")])
        rows = ((f, v) for b in batches for f, v in zip(b["file"].to_pylist(), b["value"].to_pylist(), strict=True))
        held, size = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)

        for r in _records(rows, payload, block_bytes):
            held.append(r)
            size += 400 + (r[7] if payload else 0)
            if size > 4 << 20:
                yield batch()
                held, size = [], 0
        if held:
            yield batch()

    records = materialize(pieces.mapInArrow(task, _FIELDS), "warc-records")
    told = records.where("record_type = 'response'").select(
        F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to"),
        F.col("payload_bytes").alias("_bytes"), F.col("payload_digest").alias("_digest"), *([F.col("payload").alias("_payload")] if payload else []),
    )
    out = records.join(told.hint("merge"), "refers_id", "left")
    known = F.col("refers_id").isNotNull()
    cols = [
        F.col("page_id"), F.col("url"), F.when(known, F.col("_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(known, F.col("_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"), F.col("record_type"), F.col("refers_to"),
    ]
    return out.select(*cols, *([F.when(known, F.col("_payload")).otherwise(F.col("payload")).alias("payload")] if payload else []))


def warc_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write all pages as archives into the shared folder and read them back: one row per page; nulls, ties and repeated rows as in ``write_warc``, an empty table gives an empty result."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_warc(pages, path, id_col, url_col, html_col)
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
