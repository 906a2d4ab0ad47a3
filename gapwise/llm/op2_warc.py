"""Deterministic sharded WARC archives of pages.

Pages are range-sorted by id; each task writes its range as gzipped records, one member each, and starts a new file when the
compressed size reaches a bound.  Headers and digests are made from the payload.  Of equal payloads
one is stored as a response, the others refer to it.  Files are committed through temporary names and a manifest.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapwise.llm import files
from gapwise.llm.common import attach, keep_table

WRITTEN = (
    "partition int, number int, temporary string, name string, records bigint, bytes bigint, "
    "file_digest string, first_page bigint, last_page bigint"
)
RECORDS = (
    "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, "
    "refers_to bigint, valid boolean"
)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class WarcParams:
    """roll_bytes: compressed size at which a file ends.  revisit_bytes: least payload that may be referred to.
    date: of all records, fixed so that the same pages give the same files.  level: of gzip.
    """

    roll_bytes: int = 64 * 1024 * 1024
    revisit_bytes: int = 100
    date: str = "2024-01-01T00:00:00Z"
    level: int = 6


# -- records -----------------------------------------------------------------------------


def record_id(page_id: int | None, digest: str, repeat: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}:{digest}:{repeat}')}>"


def _record(headers: list[tuple[str, str]], block: bytes, params: WarcParams) -> bytes:
    headers = [*headers, ("WARC-Block-Digest", "sha256:" + hashlib.sha256(block).hexdigest())]
    headers.append(("Content-Length", str(len(block))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", params.level, mtime=0)


def page_record(
    page_id: int | None, url: str | None, payload: bytes, digest: str, repeat: int, refers_to: tuple | None, params: WarcParams
) -> bytes:
    """A response, or a revisit of ``refers_to`` (a tuple of the response's page id)."""
    uri = "".join(c if c > " " and c != "\x7f" else "%%%02X" % ord(c) for c in url or "") or f"urn:page:{page_id}"
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, digest, repeat)),
        ("WARC-Date", params.date),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http;msgtype=response"),
        ("Page-Payload-Length", str(len(payload))),
    ]
    if page_id is not None:
        headers.append(("Page-Id", str(page_id)))
    if refers_to is not None:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to[0], digest, 0))]
        if refers_to[0] is not None:
            headers.append(("Page-Refers-To", str(refers_to[0])))
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return _record(headers, block if refers_to is not None else block + payload, params)


def info_record(name: str, params: WarcParams) -> bytes:
    block = f"filename: {name}\r\nformat: WARC File Format 1.1\r\n".encode()
    headers = [
        ("WARC-Type", "warcinfo"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, name)}>"),
        ("WARC-Date", params.date),
        ("Content-Type", "application/warc-fields"),
    ]
    return _record(headers, block, params)


def members(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time; a cut member is an error."""
    coder, parts = zlib.decompressobj(31), []
    for chunk in chunks:
        while chunk:
            parts.append(coder.decompress(chunk))
            if not coder.eof:
                break
            yield b"".join(parts)
            chunk, coder, parts = coder.unused_data, zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("the archive ends within a record")


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(headers["Content-Length"])]
    if len(block) < int(headers["Content-Length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record of another length than its header says")
    return headers, block


# -- writing -------------------------------------------------------------------------------


class _Archive:
    """The files of one task."""

    def __init__(self, folder: str, params: WarcParams):
        self.files, self.params, self.stream, self.rows = files.FileWriter(folder, ".warc.gz"), params, None, []

    def add(self, page_id: int | None, record: bytes) -> None:
        if self.stream is None:
            self.temporary, self.name, self.number = self.files.next()
            self.stream, self.hash = self.files.open(self.temporary), hashlib.sha256()
            self.records = self.bytes = 0
            self.first = page_id
            self._put(info_record(self.name, self.params))
        self._put(record)
        self.records += 1
        self.last = page_id
        if self.bytes >= self.params.roll_bytes:
            self.close()

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.hash.update(data)
        self.bytes += len(data)

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.rows.append(
                (self.files.partition, self.number, self.temporary, self.name, self.records, self.bytes,
                 self.hash.hexdigest(), self.first, self.last)
            )
            self.stream = None


def write_archives(pages: DataFrame, folder: str, params: WarcParams = WarcParams()) -> DataFrame:
    """Write a record per row of ``pages`` (``page_id``, ``url``, ``html``) and return the committed manifest.

    A null html is an empty payload, a null url a URN of the id.  Of equal payloads of at least ``revisit_bytes`` the
    smallest page id is the response; among rows of one id and payload the first is, and missing ids come last.
    Rows are in ascending order of id, missing ids first.  An empty table gives an empty manifest.
    """
    pages = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"),
    )
    hashed = pages.withColumn("digest", F.sha2("payload", 256))
    ids = hashed.where(F.octet_length("payload") >= params.revisit_bytes).select("page_id", "digest")
    groups = ids.groupBy("digest").agg(
        F.min(F.struct(F.col("page_id").isNull(), "page_id")).alias("first"), F.count("*").alias("rows")
    )
    groups = groups.where("rows > 1").select("digest", F.col("first.page_id").alias("first"), F.lit(1).alias("known"))
    marks, _ = keep_table(
        attach(ids, groups, "digest", F.col("page_id")).where("known = 1").select("page_id", "digest", "first").distinct(),
        "warc-marks",
    )
    # Marks travel with the pages of their range, and come first of their id.
    none = F.lit(None)
    both = hashed.select("page_id", F.lit(1).alias("kind"), "digest", none.cast("long").alias("first"), "url", "payload").union(
        marks.select("page_id", F.lit(0).alias("kind"), "digest", "first", none.cast("string"), none.cast("binary"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = None
        current, firsts, repeats = object(), {}, {}
        for batch in batches:
            archive = archive or _Archive(folder, params)
            columns = [batch.column(i) for i in range(batch.num_columns)]
            for at in range(batch.num_rows):
                page_id, kind, digest, first, url, payload = (c[at].as_py() for c in columns)
                if page_id != current:
                    current, firsts, repeats = page_id, {}, {}
                if kind == 0:
                    firsts[digest] = first
                    continue
                repeat = repeats.get(digest, 0)
                repeats[digest] = repeat + 1
                again = digest in firsts and (firsts[digest] != page_id or repeat > 0)
                refers_to = (firsts[digest],) if again else None
                archive.add(page_id, page_record(page_id, url, payload, digest, repeat, refers_to, params))
        if archive is not None:
            archive.close()
            names = [part.split()[0] for part in WRITTEN.split(", ")]
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            found = list(zip(*archive.rows)) or [()] * len(names)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(found, kinds)], names=names)

    partitions = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = both.repartitionByRange(partitions, "page_id").sortWithinPartitions("page_id", "kind", "digest", "url")
    return files.commit(ranged.mapInArrow(run, WRITTEN), folder)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The page records of all committed files.  ``valid`` says whether the digests in a record's headers hold.

    Length and digest are those of the full payload: of a response computed from what is stored, of a revisit from
    its headers.
    """

    def read(store: fs.FileSystem, path: str, row: dict) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in RECORDS.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
        found = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*found)) or [()] * len(names)
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        with store.open_input_stream(path, compression=None) as stream:
            for record in members(iter(lambda: stream.read(1 << 20), b"")):
                headers, block = parse(record)
                if headers["WARC-Type"] == "warcinfo":
                    continue
                whole = "sha256:" + hashlib.sha256(block).hexdigest() == headers["WARC-Block-Digest"]
                stated = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                length, digest = int(headers["Page-Payload-Length"]), stated
                if headers["WARC-Type"] == "response":
                    payload = block.partition(b"\r\n\r\n")[2]
                    length, digest = len(payload), hashlib.sha256(payload).hexdigest()
                page, first = headers.get("Page-Id"), headers.get("Page-Refers-To")
                found.append(
                    (int(page) if page else None, headers["WARC-Target-URI"], length, digest, headers["WARC-Type"],
                     int(first) if first else None, whole and digest == stated)
                )
                if len(found) == 4096:
                    yield batch()
                    found.clear()
        yield batch()

    return files.each_file(files.manifest(spark, folder), read, folder, RECORDS)
