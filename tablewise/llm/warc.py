"""WARC archives as a Spark data source, in Python: writing, planning, pushed predicates, skipping.

Each record is a gzip member of its own whose header names its length (the ``sl`` field), so a
reader that has parsed the WARC header jumps over a payload nobody asked for without decoding it.
Members without that field, and plain ``.warc`` files, are read too. Equality and ``in`` predicates
on the record type and on the header columns are pushed into the reader. The scan is planned by
files: a partition holds files of bounded total size, a larger file alone.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage,
)

from tablewise.llm.common import filesystem, new_folder
from tablewise.session import materialize

SCHEMA = ("record_id string, record_type string, target_uri string, refers_to string, payload_digest string, "
          "payload_length bigint, payload binary")
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri",
           "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}
FILE_BYTES = 64 << 20
MANIFEST = "_files.json"
_CHUNK = 1 << 16
_BATCH_BYTES = 4 << 20
_DATE = "2000-01-01T00:00:00Z"


def gzip_member(data: bytes, level: int = 4) -> bytes:
    """One gzip member with its own and its content's length in an extra field."""
    coder = zlib.compressobj(level, zlib.DEFLATED, -15)
    packed = coder.compress(data) + coder.flush()
    total = 24 + len(packed) + 8
    sizes = struct.pack("<II", *(n if n < 1 << 32 else 0 for n in (total, len(data))))
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<H", 8) + sizes
    return head + packed + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(record_id: str, kind: str, uri: str | None, refers_to: str | None, digest: str, payload: bytes, date: str = _DATE) -> bytes:
    """A response with its payload, or a revisit with the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}",
             f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
             f"Content-Length: {len(block)}"]
    if uri is not None:  # a line break would end the header
        lines.append("WARC-Target-URI: " + uri.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{refers_to}>",
                  "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_header(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    out = {"": lines[0]}
    for line in lines[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


class _Bytes:
    """Content of one gzip member or of a plain file, read on demand from ``start``."""

    def __init__(self, source, start: int, packed: bool, chunk: int = _CHUNK):
        self.chunk = chunk
        self.source, self.at, self.coder = source, start, zlib.decompressobj(31) if packed else None
        self.held, self.pos = b"", 0

    def more(self, want: int) -> bool:
        """Have ``want`` bytes ready if the content has them."""
        while len(self.held) - self.pos < want:
            if self.coder is not None and self.coder.eof:
                return False
            if self.coder is not None and self.coder.unconsumed_tail:
                new = self.coder.decompress(self.coder.unconsumed_tail, _CHUNK)
            else:
                self.source.seek(self.at)
                raw = self.source.read(self.chunk)
                self.at += len(raw)
                if not raw:
                    return False
                new = self.coder.decompress(raw, _CHUNK) if self.coder is not None else raw
            self.held, self.pos = self.held[self.pos:] + new, 0
        return True

    def until(self, mark: bytes) -> bytes | None:
        size, scanned = _CHUNK // 16, 0
        while True:
            full = self.more(size)
            found = self.held.find(mark, self.pos + scanned)
            if found >= 0:
                out, self.pos = self.held[self.pos:found], found + len(mark)
                return out
            if not full:
                return None
            scanned = max(0, len(self.held) - self.pos - len(mark))
            size = len(self.held) - self.pos + _CHUNK

    def take(self, n: int) -> bytes:
        if not self.more(n):
            raise EOFError("the record ends early")
        out, self.pos = self.held[self.pos:self.pos + n], self.pos + n
        return out

    def end(self) -> int:
        """Place in the file behind what was used."""
        if self.coder is None:
            return self.at - (len(self.held) - self.pos)
        while not self.coder.eof:
            self.pos = len(self.held)
            if not self.more(1):
                break
        return self.at - len(self.coder.unused_data)


def read_records(source, packed: bool, wanted, payload: bool):
    """Header-first reading of one open file; ``wanted`` judges a header, others are skipped undecoded."""
    at, size = 0, source.size()
    while at < size:
        skip = 0
        if packed:
            source.seek(at)
            lead = source.read(24)
            if len(lead) == 24 and lead[3] & 4 and lead[12:14] == b"sl":
                skip = struct.unpack_from("<I", lead, 16)[0]
        content = _Bytes(source, at, packed, min(skip or _CHUNK, _CHUNK if payload else _CHUNK // 16))
        head = content.until(b"\r\n\r\n")
        if head is None:
            return
        fields = parse_header(head.lstrip(b"\r\n"))
        length = int(fields.get("content-length", 0))
        row = None
        if wanted(fields):
            http, body_length = b"", length
            if fields.get("content-type", "").startswith("application/http"):
                http = content.until(b"\r\n\r\n") or b""
                inner = parse_header(http)
                body_length = int(inner.get("content-length", length - len(http) - 4))
                rest = length - len(http) - 4
            else:
                rest = length
            body = content.take(rest) if payload and rest and fields.get("warc-type") != "revisit" else (
                b"" if payload and fields.get("warc-type") != "revisit" else None)
            row = fields, body_length, body
            consumed = rest if body is None else 0
        else:
            consumed = length
        if skip:
            at += skip
        elif packed:
            at = content.end()
        else:
            at = content.end() + consumed + 4
        if row:
            yield row


@dataclass
class _Files(InputPartition):
    files: tuple


class WarcReader(DataSourceReader):
    def __init__(self, schema, options):
        self.columns = [f.name for f in schema.fields]
        self.path = options["path"]
        self.bytes = int(options.get("partitionBytes", FILE_BYTES))
        self.keep: dict[str, set] = {}
        if types := options.get("types"):
            self.keep["record_type"] = set(types.split(","))

    def partitions(self):
        from pyarrow import fs

        system, base = filesystem(self.path)
        manifest = system.get_file_info(f"{base}/{MANIFEST}")
        if manifest.type == fs.FileType.File:
            with system.open_input_stream(f"{base}/{MANIFEST}") as f:
                files = [tuple(x) for x in json.loads(f.read())]
        else:
            files = sorted((i.path[len(base) + 1:], i.size) for i in system.get_file_info(
                fs.FileSelector(base, recursive=True)) if i.is_file and i.path.endswith((".warc", ".warc.gz")))
        out, held, size = [], [], 0
        for name, n in files:
            if held and size + n > self.bytes:
                out.append(_Files(tuple(held)))
                held, size = [], 0
            held.append(name)
            size += n
        return out + [_Files(tuple(held))]

    def _wanted(self, fields) -> bool:
        return all(_field(fields, c) in values for c, values in self.keep.items())

    def read(self, partition):
        system, base = filesystem(self.path)
        payload = "payload" in self.columns
        rows, size = [], 0
        for name in partition.files:
            with system.open_input_file(f"{base}/{name}") as source:
                for fields, length, body in read_records(source, name.endswith(".gz"), self._wanted, payload):
                    values = {c: _field(fields, c) for c in HEADERS} | {"payload_length": length, "payload": body}
                    rows.append([values.get(c) for c in self.columns])
                    size += len(body or b"") + 256
                    if size > _BATCH_BYTES:
                        yield self._batch(rows)
                        rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows) -> pa.RecordBatch:
        kinds = {"payload_length": pa.int64(), "payload": pa.binary()}
        return pa.RecordBatch.from_arrays(
            [pa.array(v, kinds.get(c, pa.string())) for c, v in zip(self.columns, zip(*rows))], self.columns)


class PushingReader(WarcReader):
    """With ``spark.sql.python.filterPushdown.enabled``: Spark refuses readers with predicates otherwise."""

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if column in HEADERS:
                values = set(f.value) if isinstance(f, In) else {f.value}
                self.keep[column] = self.keep.get(column, values) & values
            else:
                yield f


def _field(fields: dict[str, str], column: str):
    value = fields.get(HEADERS[column])
    if value is None:
        return None
    if column in ("record_id", "refers_to"):
        return value.strip("<>")
    return value.removeprefix("sha1:") if column == "payload_digest" else value


@dataclass
class _Written(WriterCommitMessage):
    files: tuple


class WarcWriter(DataSourceArrowWriter):
    """Rows ``(record_id, record_type, target_uri, refers_to, payload_digest, payload)`` to gzip members.

    A task writes files of its own names; the commit lists those of the successful tasks in a
    manifest, so what a lost executor left behind is never read.
    """

    def __init__(self, options):
        self.path, self.limit = options["path"], int(options.get("fileBytes", FILE_BYTES))

    def write(self, batches):
        from pyspark import TaskContext

        system, base = filesystem(self.path)
        system.create_dir(base, recursive=True)
        part, files, stream, size = TaskContext.get().partitionId(), [], None, 0
        for batch in batches:
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                row = {n: c[i].as_py() for n, c in columns.items()}
                if stream is None:
                    name = f"{part:05d}-{len(files):03d}-{uuid.uuid4().hex}.warc.gz"
                    stream, size = system.open_output_stream(f"{base}/{name}", compression=None), 0
                data = gzip_member(record(row["record_id"], row["record_type"], row["target_uri"], row["refers_to"],
                                          row["payload_digest"], row["payload"] or b""))
                stream.write(data)
                size += len(data)
                if size >= self.limit:
                    stream.close()
                    files.append((name, size))
                    stream = None
        if stream is not None:
            stream.close()
            files.append((name, size))
        return _Written(tuple(files))

    def commit(self, messages):
        system, base = filesystem(self.path)
        system.create_dir(base, recursive=True)
        with system.open_output_stream(f"{base}/{MANIFEST}") as f:
            f.write(json.dumps([x for m in messages if m is not None for x in m.files]).encode())

    def abort(self, messages):
        pass


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return (PushingReader if self.options.get("push") == "true" else WarcReader)(schema, self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def read_warc(spark: SparkSession, path: str, columns: str = SCHEMA, types: str | None = None) -> DataFrame:
    """Records of a folder. Leave ``payload`` out of ``columns`` and no payload is decoded.

    ``types`` names record types by comma. Predicates are pushed if the session allows it.
    """
    spark.dataSource.register(WarcSource)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    reader = spark.read.format("warc").schema(columns).option("push", push)
    return (reader.option("types", types) if types else reader).load(path)


def write_warc(records: DataFrame, path: str) -> None:
    records.sparkSession.dataSource.register(WarcSource)
    records.write.format("warc").mode("append").save(path)


def base32(hexes):
    """Upper-case base32 of a SHA-1 given as 40 hexadecimal digits: eight times 20 bits."""
    letters, parts = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), []
    for k in range(8):
        bits = F.conv(F.substring(hexes, 5 * k + 1, 5), 16, 10).cast("int")
        parts += [F.substr(letters, F.shiftright(bits, 15 - 5 * j).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for j in range(4)]
    return F.concat(*parts)


def archive_records(pages: DataFrame, least: int = 0) -> DataFrame:
    """Records of ``pages (page_id, url, html)``: of equal payloads of at least ``least`` bytes, the one with
    the smallest page_id is the response and the others revisit it; smaller ones are all responses.

    Null html is an empty payload. Rows that repeat the smallest page_id are all responses, as are
    rows without a page_id. Only ids and digests are grouped and joined; payloads move only if the
    revisits are too many to be broadcast.
    """
    own = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
                       F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    own = own.withColumn("sha", F.sha1("payload"))
    light = materialize(own.filter(F.length("payload") >= least).select("page_id", "sha"), "digests")
    firsts = materialize(light.groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
                         .filter("n > 1").select("sha", "first"), "firsts")
    revisits = materialize(light.join(firsts, "sha").filter("page_id > first").distinct(), "revisits")
    joined = own.join(revisits, ["page_id", "sha"], "left")
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("none")))
    return joined.select(
        name(F.col("page_id")).alias("record_id"),
        F.when(F.col("first").isNull(), "response").otherwise("revisit").alias("record_type"),
        F.col("url").alias("target_uri"), F.when(F.col("first").isNotNull(), name(F.col("first"))).alias("refers_to"),
        base32(F.col("sha")).alias("payload_digest"), "payload")


def archive(pages: DataFrame, folder: str | None = None, least: int = 0) -> DataFrame:
    """Write the archives of all pages and read their records back, payloads of responses included."""
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    write_warc(archive_records(pages, least), folder)
    return read_warc(spark, folder)


def page_report(records: DataFrame) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` of records read back.

    A response's figures are taken from its payload, a revisit's from its headers.
    """
    number = lambda c: F.expr(f"try_cast(substring({c}, 10) as bigint)")
    return records.select(
        number("record_id").alias("page_id"),
        F.coalesce(F.length("payload"), "payload_length").cast("bigint").alias("payload_bytes"),
        F.coalesce(base32(F.sha1("payload")), "payload_digest").alias("payload_digest"),
        "record_type", number("refers_to").alias("refers_to"))
