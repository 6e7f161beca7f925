"""WARC archives with a two-level capture index.

Archives hold one gzip member per record, in the shared folder. The index sorts the
captures by reversed-host URL key into compressed blocks; a sparse directory keeps each
block's first key. A lookup binary-searches the list of index shards, then the shard's
directory, then the block, and ends in one range read of the archive. Pages with equal
payloads of ``REVISIT_BYTES`` or more are stored once: the one with the largest page_id is
the response, the others are revisit records that refer to it.

Files are reached through ``pyarrow.fs`` (file, s3, gs, or hdfs where libhdfs is present).
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import new_path, written

REVISIT_BYTES = 1000
BLOCK_LINES = 1000
#: Captures of an index shard, and lookups of a task: both are many small keys, but costly each.
SHARD, LOOKUPS = 250_000, 8192
DATE = "2024-01-01T00:00:00Z"
NO_ID = -(2**63)


def url_key(url: Column) -> Column:
    """``http://a.example.com/x?y#z`` -> ``com,example,a)/x?y``; null gives the empty key."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    rest = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^#]*)", 1)
    return F.coalesce(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest), F.lit(""))


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def _clean(url: str) -> str:
    return url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _plain(url: str) -> str:
    return url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record_bytes(page_id, url, payload: bytes, refers_to=None, refers_key: str = "") -> bytes:
    """One gzip member with a response record, or a revisit record without payload."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = head if refers_to is not None else head + payload
    fields = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {_clean(url)}"] if url is not None else []),
        f"WARC-Payload-Digest: sha1:{hashlib.sha1(payload).hexdigest()}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Refers-To-Target-URI: {_clean(refers_key)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if refers_to is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return gzip.compress("\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 1, mtime=0)


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of one gzip member; raises where lengths don't fit."""
    data = gzip.decompress(member)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    size = int(fields["Content-Length"])
    if not head.startswith(b"WARC/1.1") or rest[size:] != b"\r\n\r\n":
        raise ValueError("broken WARC record")
    return fields, rest[:size].partition(b"\r\n\r\n")[2]


def _page(urn: str) -> int | None:
    inner = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(inner) if inner else None


@dataclass(frozen=True)
class Archive:
    """Where an archive lies, and its captures: ``key, page_id, file, offset, length``."""

    path: str
    captures: DataFrame
    shards: tuple[tuple[tuple[str, int], str], ...]


def revisits(pages: DataFrame) -> DataFrame:
    """``page_id, digest, refers_to, refers_key`` of the payloads that a page of a larger id
    carries too: the largest page_id (of several rows, the largest key) is the response. Rows
    without a page_id take no part."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    slim = pages.where(F.octet_length(F.coalesce("html", F.lit(""))) >= REVISIT_BYTES).select("page_id", url_key(F.col("url")).alias("key"), F.sha1(payload).alias("digest"))
    slim = written(slim.where("page_id is not null"), "warc-digests")
    first = slim.groupBy("digest").agg(F.count("*").alias("n"), F.max(F.struct("page_id", "key")).alias("r")).where("n > 1")
    first = written(first.select("digest", F.col("r.page_id").alias("refers_to"), F.col("r.key").alias("refers_key")), "warc-first")
    return written(slim.join(first, "digest").where("page_id <> refers_to").select("page_id", "digest", "refers_to", "refers_key").distinct(), "warc-revisits")


def write_archive(pages: DataFrame) -> Archive:
    """Archive ``pages(page_id, url, html)`` and index it. Null html is an empty payload; null
    url has the empty key. Rows that repeat a page_id are records of their own, revisits or
    responses by their own payloads (rows that repeat id and payload of the response are
    responses too, since a record can't revisit its own page)."""
    path = new_path(pages.sparkSession, "warc")
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"), url_key(F.col("url")).alias("key"))
    rows = rows.withColumn("digest", F.sha1("payload")).join(revisits(pages), ["page_id", "digest"], "left").select("page_id", "url", "payload", "key", "refers_to", "refers_key")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, base = _open(path)
        place.create_dir(base, recursive=True)
        name, at, out = f"{uuid.uuid4().hex}.warc.gz", 0, None
        for batch in batches:
            found = []
            for page_id, url, payload, key, refers_to, refers_key in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                member = record_bytes(page_id, url, payload, refers_to, refers_key or "")
                out = out or place.open_output_stream(f"{base}/{name}", compression=None)
                out.write(member)
                found.append((key, page_id, name, at, len(member)))
                at += len(member)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["key", "page_id", "file", "offset", "length"])
        if out:
            out.close()

    captures = written(rows.mapInArrow(store, "key string, page_id long, file string, offset long, length long"), "warc-captures")
    order = [F.col("key"), F.coalesce("page_id", F.lit(NO_ID)), F.col("file"), F.col("offset")]
    ranged = captures.repartitionByRange(1 + captures.count() // SHARD, *order).sortWithinPartitions(*order)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, base = _open(path)
        name, at, out, directory, lines = uuid.uuid4().hex, 0, None, [], []

        def flush():
            nonlocal at, out
            out = out or place.open_output_stream(f"{base}/{name}.blocks", compression=None)
            block = zlib.compress(json.dumps(lines).encode())
            out.write(block)
            directory.append([lines[0][:2], at, len(block)])
            at += len(block)
            lines.clear()

        for batch in batches:
            for key, page_id, *where in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines.append([key, NO_ID if page_id is None else page_id, *where])
                if len(lines) == BLOCK_LINES:
                    flush()
        if lines:
            flush()
        if out:
            out.close()
            with place.open_output_stream(f"{base}/{name}.directory", compression=None) as f:
                f.write(json.dumps(directory).encode())
            (key, page_id), _, _ = directory[0]
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([page_id], pa.int64()), pa.array([name])], ["key", "page_id", "shard"])

    # One row per index partition: a bounded list, whatever the number of captures.
    shards = written(ranged.mapInArrow(index, "key string, page_id long, shard string"), "warc-shards")
    return Archive(path, captures, tuple(sorted(((r.key, r.page_id), r.shard) for r in shards.collect())))


class Reader:
    """Lookups in one archive, with small caches of directories, blocks and open files."""

    def __init__(self, path: str, shards):
        self.place, self.base = _open(path)
        self.first, self.names = [tuple(k) for k, _ in shards], [n for _, n in shards]
        self.kept: dict[str, OrderedDict] = {"directory": OrderedDict(), "block": OrderedDict(), "file": OrderedDict(), "digest": OrderedDict()}

    def _cached(self, kind: str, name, make, most: int):
        kept = self.kept[kind]
        if name not in kept:
            kept[name] = make()
            if len(kept) > most:
                old = kept.popitem(last=False)[1]
                if kind == "file":
                    old.close()
        kept.move_to_end(name)
        return kept[name]

    def _range(self, name: str, at: int, n: int) -> bytes:
        f = self._cached("file", name, lambda: self.place.open_input_file(f"{self.base}/{name}"), 32)
        f.seek(at)
        return f.read(n)

    def _directory(self, shard: str):
        def load():
            with self.place.open_input_stream(f"{self.base}/{shard}.directory", compression=None) as f:
                return [((k, p), at, n) for (k, p), at, n in json.loads(f.read())]

        return self._cached("directory", shard, load, 8)

    def find(self, key: str, page_id: int) -> Iterator[tuple[str, int, int]]:
        """Archive ranges of the captures of a page."""
        goal = (key, page_id)
        s = max(0, bisect.bisect_left(self.first, goal) - 1)
        while s < len(self.first) and self.first[s] <= goal:
            shard, directory = self.names[s], self._directory(self.names[s])
            b = max(0, bisect.bisect_left(directory, goal, key=lambda x: x[0]) - 1)
            while b < len(directory) and directory[b][0] <= goal:
                _, at, n = directory[b]
                lines = self._cached("block", (shard, b), lambda: json.loads(zlib.decompress(self._range(f"{shard}.blocks", at, n))), 8)  # noqa: B023
                i = bisect.bisect_left(lines, goal, key=lambda x: (x[0], x[1]))
                while i < len(lines) and (lines[i][0], lines[i][1]) == goal:
                    yield tuple(lines[i][2:])
                    i += 1
                b += 1
            s += 1

    def read(self, where) -> tuple[dict[str, str], bytes]:
        return parse_record(self._range(*where))

    def full(self, fields: dict[str, str], payload: bytes) -> tuple[int, str]:
        """Size and digest of a record's full payload, a revisit's being its response's."""
        if fields["WARC-Type"] == "revisit":
            goal = (_plain(fields["WARC-Refers-To-Target-URI"]), _page(fields["WARC-Refers-To"]))
            size, digest = self._cached("digest", goal, lambda: self.full(*self.read(next(self.find(*goal)))), 4096)
        else:
            size, digest = len(payload), hashlib.sha1(payload).hexdigest()
        if f"sha1:{digest}" != fields["WARC-Payload-Digest"]:
            raise ValueError("a payload doesn't have the digest of its record")
        return size, digest


def look_up(archive: Archive, wanted: DataFrame) -> DataFrame:
    """``wanted(key, page_id)`` -> ``page_id, url, payload_bytes, payload_digest,
    record_type, refers_to``, one row per capture found, read from the archive. Repeated
    rows are looked up once; a null page_id is that of pages without one; a key that isn't in
    the archive gives no row; other columns are ignored, whatever their names."""
    path, shards = archive.path, archive.shards
    order = [F.col("key"), F.coalesce("page_id", F.lit(NO_ID))]
    rows = written(wanted.select("key", F.coalesce("page_id", F.lit(NO_ID)).alias("page_id")).distinct(), "warc-wanted")
    rows = rows.repartitionByRange(1 + rows.count() // LOOKUPS, *order).sortWithinPartitions(*order)
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(path, shards)
        for batch in batches:
            found = []
            for key, page_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for where in reader.find(key, page_id):
                    fields, payload = reader.read(where)
                    size, digest = reader.full(fields, payload)
                    url = fields.get("WARC-Target-URI")
                    refers = fields.get("WARC-Refers-To")
                    found.append((_page(fields["WARC-Record-ID"]), None if url is None else _plain(url), size, digest, fields["WARC-Type"], None if refers is None else _page(refers)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names)

    return rows.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")
