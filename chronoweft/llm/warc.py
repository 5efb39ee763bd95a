"""WARC archives: a deterministic sharded writer, and a reader.

Writing takes three steps. (1) Digest, length and page_id of each page, computed in the JVM, decide which
record of each group of equal payloads is the response; of the groups with more than one record only the
revisits go on, as small rows. (2) Pages and revisit rows are range-sorted together by page_id, so each
task meets a page and its decision side by side: the payloads are shuffled once. (3) Each task writes its
range as gzip members, one a record, regenerates headers and digests, and rolls the file by compressed
size. A file is written under a temporary name of its own and renamed when it is whole; a second attempt
writes the same bytes to the same name. The manifest, written through Spark's committer last, lists files,
record counts and digests; readers follow the manifest only, so files of lost attempts don't count.

Files go to the shared folder through pyarrow's file systems (``file://``, ``hdfs://``, ``s3://``...).

Defined cases: a null html is an empty payload, a null url an empty target; a group's records with the
same page_id (repeated rows) are told apart by an ordinal, and one of them is the response; a null page_id
is below all others; an empty table gives an empty manifest and result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweft.llm.common import bounded_batches, cut, drop_cut, shared_path, tidy

ROLL_BYTES = 64 << 20
SHARD_BYTES = 128 << 20
LEVEL = 3
DATE = "2000-01-01T00:00:00Z"
"""Given to every record: archives are the same on every run."""
SCHEME = "urn:page:"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_BYTES = 1 << 20


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if urlsplit(uri).scheme else f"file://{uri}")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page_id: int | None, ordinal: int, url: str, payload: bytes, refers_to: tuple[int | None, int] | None) -> bytes:
    """One record, not compressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{name_of(page_id, ordinal)}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url, safe='%:/?#[]@!$&()*+,;=~._-' + chr(39))}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{name_of(*refers_to)}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def name_of(page_id: int | None, ordinal: int) -> str:
    return f"{SCHEME}{'none' if page_id is None else page_id}" + (f":{ordinal}" if ordinal else "")


def page_of(name: str) -> int | None:
    own = name.strip("<>").removeprefix(SCHEME).split(":")[0]
    return None if own == "none" else int(own)


def member(data: bytes) -> bytes:
    """A gzip member without time or name, so equal records give equal bytes."""
    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return deflate.compress(data) + deflate.flush()


class Roller:
    """Writes members to files that roll by compressed size; yields a manifest row as each is whole."""

    def __init__(self, folder: str, prefix: str, roll_bytes: int):
        self.system, self.folder = open_fs(folder)
        self.prefix, self.roll_bytes, self.number = prefix, roll_bytes, 0
        self.stream = None

    def _open(self) -> None:
        self.name = f"{self.prefix}-{self.number:05d}.warc.gz"
        self.temporary = f"{self.folder}/.{self.name}.{uuid.uuid4().hex}.tmp"
        self.stream = self.system.open_output_stream(self.temporary, compression=None)
        self.size = self.records = 0
        self.sha = hashlib.sha256()
        body = b"software: chronoweft\r\nformat: WARC File Format 1.1\r\n"
        head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:file:{self.name}>\r\nWARC-Date: {DATE}\r\nWARC-Filename: {self.name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n"
        self._put(head.encode() + body + b"\r\n\r\n")

    def _put(self, data: bytes) -> None:
        packed = member(data)
        self.stream.write(packed)
        self.sha.update(packed)
        self.size += len(packed)

    def add(self, data: bytes) -> Iterator[tuple]:
        if self.stream is None:
            self._open()
        self._put(data)
        self.records += 1
        if self.size >= self.roll_bytes:
            yield from self.close()

    def close(self) -> Iterator[tuple]:
        if self.stream is not None:
            self.stream.close()
            self.system.move(self.temporary, f"{self.folder}/{self.name}")
            self.stream = None
            self.number += 1
            yield self.name, self.size, self.records, self.sha.hexdigest()


MANIFEST = "file string, bytes long, records long, sha256 string"


def write_archives(pages: DataFrame, folder: str, least_revisit: int = 0, roll_bytes: int = ROLL_BYTES, shards: int | None = None) -> DataFrame:
    """Write a record per row of ``pages`` below ``folder``; the manifest as a table.

    Of the records with equal payloads of at least ``least_revisit`` bytes, that with the largest page_id
    is a response and the others revisit it.
    """
    spark = pages.sparkSession
    system, path = open_fs(folder)
    system.create_dir(path, recursive=True)
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    light = cut(pages.select("page_id", F.unhex(F.sha1(html)).alias("digest"), F.octet_length(html).alias("size")), "warc-digests")
    if shards is None:
        total = light.agg(F.sum("size").alias("n")).first()["n"] or 0
        shards = max(2 * spark.sparkContext.defaultParallelism, -(-total // SHARD_BYTES))
    many = light.where(F.col("size") >= least_revisit).groupBy("digest").agg(F.max("page_id").alias("target"), F.count("*").alias("n")).where("n > 1")
    revisits = light.where(F.col("size") >= least_revisit).join(many, "digest").select("page_id", "digest", "target").distinct()
    kind = dict(pages.dtypes)["page_id"]
    rows = pages.select("page_id", F.lit(1).alias("kind"), F.coalesce("url", F.lit("")).alias("url"), html.alias("html"), F.lit(None).cast(kind).alias("target")).unionByName(
        revisits.select("page_id", F.lit(0).alias("kind"), F.lit("").alias("url"), F.col("digest").alias("html"), "target")
    )
    sorted_rows = bounded_batches(rows).repartitionByRange(shards, "page_id").sortWithinPartitions("page_id", "kind", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, found = None, []
        page, targets, seen, ordinal = object(), {}, {}, 0
        for batch in batches:
            for page_id, kind_, url, body, target in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if page_id != page:
                    page, targets, seen, ordinal = page_id, {}, {}, 0
                if kind_ == 0:
                    targets[body] = target
                    continue
                if roller is None:
                    roller = Roller(folder, f"shard-{'none' if page_id is None else page_id}", roll_bytes)
                digest = hashlib.sha1(body).digest()
                refers = None
                if digest in targets:
                    if targets[digest] != page_id:
                        refers = (targets[digest], 0)
                    elif digest in seen:
                        refers = (page_id, seen[digest])
                    else:
                        seen[digest] = ordinal
                found += roller.add(record("revisit" if refers else "response", page_id, ordinal, url, body, refers))
                ordinal += 1
        if roller:
            found += roller.close()
        if found:
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], [x.split()[0] for x in MANIFEST.split(", ")])

    sorted_rows.mapInArrow(tidy(run), MANIFEST).write.mode("overwrite").json(f"{folder}/manifest")
    drop_cut(light)
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(f"{folder}/manifest")


class Counted:
    """A stream that keeps the size and digest of what was read."""

    def __init__(self, stream):
        self.stream, self.size, self.sha = stream, 0, hashlib.sha256()

    def read(self, n: int) -> bytes:
        data = self.stream.read(n)
        self.size += len(data)
        self.sha.update(data)
        return data


def members(stream) -> Iterator[bytes]:
    """The decompressed gzip members of a stream, one at a time."""
    inflate, parts, data = zlib.decompressobj(31), [], b""
    while True:
        if not data and not (data := stream.read(READ_BYTES)):
            break
        parts.append(inflate.decompress(data))
        data = b""
        if inflate.eof:
            data = inflate.unused_data
            yield b"".join(parts)
            inflate, parts = zlib.decompressobj(31), []
    if parts:
        raise ValueError("an archive ends within a record")


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """A record's headers and block, the block's length and digest checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    if len(rest) != len(block) + 4 or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"{headers['WARC-Record-ID']}: wrong length")
    if "WARC-Block-Digest" in headers and headers["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
        raise ValueError(f"{headers['WARC-Record-ID']}: wrong block digest")
    return headers, block


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per page record of the files in the manifest: page_id, payload_bytes, payload_digest,
    record_type, refers_to and url. Payload and block digests are checked against the stored bytes, and each
    file's size, records and digest against the manifest."""
    files = manifest.count()
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]

    def rows(name: str, want: tuple[int, int, str]) -> Iterator[tuple]:
        system, path = open_fs(f"{folder}/{name}")
        records = 0
        with system.open_input_stream(path, compression=None) as file:
            stream = Counted(file)
            for raw in members(stream):
                headers, block = parse(raw)
                if headers["WARC-Type"] == "warcinfo":
                    continue
                http, _, payload = block.partition(b"\r\n\r\n")
                digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                n = int(http.rpartition(b"Content-Length: ")[2])
                if headers["WARC-Type"] == "response" and (len(payload) != n or base32_sha1(payload) != digest):
                    raise ValueError(f"{headers['WARC-Record-ID']}: wrong payload")
                to = headers.get("WARC-Refers-To")
                records += 1
                yield page_of(headers["WARC-Record-ID"]), n, digest, headers["WARC-Type"], page_of(to) if to else None, headers["WARC-Target-URI"]

        if (stream.size, records, stream.sha.hexdigest()) != want:
            raise ValueError(f"{name}: not the file that its manifest lists")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, *want in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = []
                for row in rows(name, tuple(want)):
                    found.append(row)
                    if len(found) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names)
                        found = []
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names)

    spread = manifest.select("file", "bytes", "records", "sha256").repartition(max(1, files))
    return spread.mapInArrow(tidy(run), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def archive_round_trip(pages: DataFrame, **how) -> DataFrame:
    """Write ``pages`` to new archives in the shared folder and read them back. The result is read from the
    archives whenever it is computed, so they stay; :func:`delete_archives` removes a folder of them."""
    folder = shared_path(pages.sparkSession, "warc")
    manifest = write_archives(pages, folder, **how)
    return read_archives(manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def delete_archives(folder: str) -> None:
    """Remove a folder that :func:`write_archives` filled, when nothing reads it any more."""
    system, path = open_fs(folder)
    system.delete_dir(path)


# The revisit target of a repeated row is its own page_id; SQL has no such rows to tell apart here.
ORACLE_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, upper(sha1(payload)) AS hex FROM p),
bits AS (
  SELECT page_id, payload_bytes, hex,
    list_aggregate(list_transform(range(0, 40), lambda i: lpad(bin(strpos('0123456789ABCDEF', hex[i + 1]) - 1), 4, '0')), 'string_agg', '') AS b
  FROM d),
coded AS (
  SELECT page_id, payload_bytes,
    list_aggregate(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + 16 * b[5 * i + 1]::INT + 8 * b[5 * i + 2]::INT + 4 * b[5 * i + 3]::INT + 2 * b[5 * i + 4]::INT + b[5 * i + 5]::INT]), 'string_agg', '') AS payload_digest
  FROM bits),
best AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS target FROM coded)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = target THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = target THEN NULL ELSE target END AS refers_to
FROM best
"""
