"""WARC archives as a PySpark Python data source, and archiving of pages with revisit records.

Writing: each task streams gzip members, one a record, to a file of its own; only files named by a committed
manifest exist for readers, so files of lost or repeated tasks are never read. A member's gzip header carries the
member's length (extra field ``sl``), and the manifest carries record offsets about SPLIT_BYTES apart.

Reading: a partition is a byte range of one file. A record's headers are inflated first and tested against the
pushed-down predicates; the rest of a rejected member is skipped by its length, never inflated. The payload is
decoded only if the schema asks for it. Archives of others (no manifest, no length field, no gzip) are read too:
a file is a partition then.

Defined cases: null html is an empty payload; a null url has no target URI, and reads back as null; control
characters and spaces in a url are percent-encoded; pages of one payload that share the largest page_id are all responses; null
page_ids sort first; an empty table gives an archive without files, which reads as no rows.
"""

from __future__ import annotations

import base64
import io
import json
import re
import struct
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from tarn.llm.common import fresh_path

SCHEMA = "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_length long, headers map<string,string>, payload binary"
SPLIT_BYTES, ROLL_BYTES, LEAST_REVISIT = 16 << 20, 256 << 20, 1000
HEADER_OF = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}
MANIFEST = "_manifest"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if re.match(r"[a-zA-Z][\w+.-]*:", path):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def member(record: bytes, level: int = 6) -> bytes:
    """A gzip member that states its own and its content's length."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    size = 10 + 2 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size, len(record) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def clean(value: str) -> str:
    """A header value on one line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(kind: str, record_id: str, uri: str | None, digest: str, payload: bytes | None, length: int, refers_to: str | None) -> bytes:
    """A response with its payload, or a revisit without."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
    block = http + (payload or b"") if kind == "response" else http
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
    if uri is not None:
        head.append(f"WARC-Target-URI: {clean(uri)}")
    if kind == "revisit":
        head += [f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return ("WARC/1.1\r\n" + "\r\n".join([*head, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse_head(raw: bytes) -> tuple[dict[str, str], int] | None:
    """Headers by lower-case name and the offset of the block; None while the blank line isn't there."""
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        return None
    out: dict[str, str] = {}
    last = None
    for line in raw[:end].decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in " \t" and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            k, v = line.split(":", 1)
            out[last := k.strip().lower()] = v.strip()
    return out, end + 4


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    """What follows the HTTP headers of an HTTP block, else the block."""
    if headers.get("content-type", "").startswith("application/http"):
        at = block.find(b"\r\n\r\n")
        return block[at + 4 :] if at >= 0 else block
    return block


def http_length(block: bytes) -> int | None:
    m = re.search(rb"(?i)\r\nContent-Length:\s*(\d+)", block)
    return int(m[1]) if m else None


def records(stream, start: int, end: int, wanted, need_block: bool):
    """(headers, block or None, HTTP length) of the records that begin in [start, end) and are wanted by their headers."""
    stream.seek(start)
    at = start
    while at < end:
        first = stream.read(24)
        if len(first) < 4:
            return
        if first[:2] != b"\x1f\x8b":
            yield from _plain(stream, at, end, wanted, need_block)
            return
        stated = struct.unpack("<I", first[16:20])[0] if first[3] & 4 and first[12:14] == b"sl" else None
        inflate, raw, fed = zlib.decompressobj(31), b"", first
        parsed = None
        while parsed is None:
            raw += inflate.decompress(fed, 4096)
            parsed = parse_head(raw)
            if parsed is None:
                fed = inflate.unconsumed_tail or stream.read(4096)
                if not fed:
                    return
        headers, begin = parsed
        take = wanted(headers)
        length = int(headers.get("content-length", 0))
        most = begin + length if take and need_block else begin + min(length, 512) if take else 0
        while len(raw) < most and not inflate.eof:
            fed = inflate.unconsumed_tail or stream.read(1 << 16)
            if not fed:
                break
            raw += inflate.decompress(fed, max(4096, most - len(raw)))
        if take:
            block = raw[begin : begin + length]
            yield headers, block if need_block else None, http_length(block[:512])
        if stated:
            at += stated
        else:
            while not inflate.eof:
                fed = inflate.unconsumed_tail or stream.read(1 << 16)
                if not fed:
                    return
                inflate.decompress(fed, 1 << 16)
            at = stream.tell() - len(inflate.unused_data)
        stream.seek(at)


def _plain(stream, start: int, end: int, wanted, need_block: bool):
    at = start
    while at < end:
        stream.seek(at)
        raw, parsed = b"", None
        while parsed is None:
            more = stream.read(4096)
            if not more:
                return
            raw += more
            lead = len(raw) - len(raw.lstrip(b"\r\n"))
            parsed = parse_head(raw[lead:])
        headers, begin = parsed
        length = int(headers.get("content-length", 0))
        if wanted(headers):
            stream.seek(at + lead + begin)
            block = stream.read(length if need_block else min(length, 512))
            yield headers, block if need_block else None, http_length(block[:512])
        at += lead + begin + length + 4


def bare(value: str | None) -> str | None:
    return value.strip("<>") if value else value


def hex_digest(value: str | None) -> str | None:
    """Lower-case hex of a labelled digest, in hex or base 32."""
    if not value:
        return None
    body = value.split(":", 1)[-1]
    if len(body) == 32:
        try:
            return base64.b32decode(body.upper()).hex()
        except ValueError:
            return body
    return body.lower()


READ = {"record_id": bare, "refers_to": bare, "payload_digest": hex_digest}


class WarcPartition(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class WarcReader(DataSourceReader):
    def __init__(self, path: str, names: list[str], fields):
        self.path, self.names, self.fields, self.tests = path, names, fields, []

    def pushFilters(self, filters):
        """Takes predicates on record type and header columns; hands the others back."""
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column in HEADER_OF and isinstance(f, EqualTo | In | IsNotNull | StringStartsWith):
                self.tests.append((column, type(f).__name__, list(f.value) if isinstance(f, In) else getattr(f, "value", None)))
            else:
                yield f

    def partitions(self):
        files, root = _open(self.path)
        manifest = files.get_file_info(f"{root}/{MANIFEST}")
        if manifest.type == pafs.FileType.File:
            with files.open_input_stream(f"{root}/{MANIFEST}") as f:
                listed = json.loads(f.read())
            parts = [WarcPartition(x["name"], a, b) for x in listed for a, b in zip(x["starts"], [*x["starts"][1:], x["bytes"]], strict=True)]
        else:
            found = files.get_file_info(pafs.FileSelector(root, recursive=True)) if files.get_file_info(root).type == pafs.FileType.Directory else [files.get_file_info(root)]
            parts = [WarcPartition(x.path, 0, x.size) for x in found if re.search(r"\.warc(\.gz)?$", x.path) and x.size]
        return parts or [WarcPartition("", 0, 0)]

    def _wanted(self, headers: dict[str, str]) -> bool:
        for column, kind, value in self.tests:
            own = headers.get(HEADER_OF[column])
            own = READ.get(column, lambda v: v)(own)
            ok = own is not None and (kind == "IsNotNull" or kind == "EqualTo" and own == value or kind == "In" and own in value or kind == "StringStartsWith" and own.startswith(value))
            if not ok:
                return False
        return True

    def read(self, partition):
        if not partition.path:
            return
        files, root = _open(self.path)
        path = partition.path if "/" in partition.path else f"{root}/{partition.path}"
        schema = pa.schema([(n, {"payload": pa.binary(), "payload_length": pa.int64(), "headers": pa.map_(pa.string(), pa.string())}.get(n, pa.string())) for n in self.names])
        rows, held = [], 0
        with files.open_input_file(path) as f:
            for headers, block, http in records(_Buffered(f), partition.start, partition.end, self._wanted, "payload" in self.names):
                row = {}
                for n in self.names:
                    if n == "payload":
                        row[n] = payload_of(headers, block)
                    elif n == "payload_length":
                        row[n] = http if http is not None else int(headers.get("content-length", 0))
                    elif n == "headers":
                        row[n] = list(headers.items())
                    else:
                        row[n] = READ.get(n, lambda v: v)(headers.get(HEADER_OF[n]))
                rows.append(row)
                held += len(block or b"") + 200
                if held > 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class _Buffered:
    """Short reads from a window of the file, so that a small record costs no call to the store."""

    def __init__(self, raw, window: int = 1 << 20):
        self.raw, self.window, self.base, self.buf, self.at = raw, window, 0, b"", 0

    def seek(self, at: int) -> None:
        self.at = at

    def tell(self) -> int:
        return self.at

    def read(self, n: int) -> bytes:
        i = self.at - self.base
        if i < 0 or i + n > len(self.buf):
            self.raw.seek(self.at)
            self.base, self.buf, i = self.at, self.raw.read(max(n, self.window)), 0
        out = self.buf[i : i + n]
        self.at += len(out)
        return out


class WarcCommit(WriterCommitMessage):
    def __init__(self, files: list[dict]):
        self.files = files


class WarcWriter(DataSourceArrowWriter):
    """Rows of (record_type, record_id, target_uri, refers_to, payload_digest, payload_length, payload)."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator):
        files, root = _open(self.path)
        files.create_dir(root, recursive=True)
        done, out, now = [], None, None
        for batch in iterator:
            columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("record_type", "record_id", "target_uri", "payload_digest", "payload", "payload_length", "refers_to")]
            for row in zip(*columns, strict=True):
                if out is None or now["bytes"] > ROLL_BYTES:
                    if out is not None:
                        out.close()
                    now = {"name": f"{uuid.uuid4().hex}.warc.gz", "bytes": 0, "starts": [0]}
                    done.append(now)
                    out = files.open_output_stream(f"{root}/{now['name']}", compression=None)
                data = member(record(*row))
                if now["bytes"] - now["starts"][-1] > SPLIT_BYTES:
                    now["starts"].append(now["bytes"])
                out.write(data)
                now["bytes"] += len(data)
        if out is not None:
            out.close()
        return WarcCommit(done)

    def commit(self, messages):
        files, root = _open(self.path)
        files.create_dir(root, recursive=True)
        listed = []
        if files.get_file_info(f"{root}/{MANIFEST}").type == pafs.FileType.File:
            with files.open_input_stream(f"{root}/{MANIFEST}") as f:
                listed = json.loads(f.read())
        listed += [x for m in messages if m for x in m.files]
        with files.open_output_stream(f"{root}/{MANIFEST}.new") as f:
            f.write(json.dumps(listed).encode())
        files.move(f"{root}/{MANIFEST}.new", f"{root}/{MANIFEST}")

    def abort(self, messages):
        files, root = _open(self.path)
        for x in (x for m in messages if m for x in m.files):
            files.delete_file(f"{root}/{x['name']}")


class WarcSource(DataSource):
    """spark.read.format("warc").load(path); with a schema of fewer of SCHEMA's columns, only those are made."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options["path"], schema.names, schema)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options["path"])


def register(spark) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def with_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Pages as records: of equal payloads of at least ``least`` bytes, the one with the largest page_id is the response.

    Only digests cross the network for the choice; the join that brings it back to the pages is split by AQE where
    one payload is very frequent.
    """
    x = pages.select("page_id", F.col("url").alias("target_uri"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    x = x.withColumns({"payload_digest": F.sha1("payload"), "payload_length": F.length("payload").cast("long")})
    groups = x.where(F.col("payload_length") >= least).groupBy(F.col("payload_digest").alias("_d"), F.col("payload_length").alias("_l")).agg(F.max("page_id").alias("_keep"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    x = x.join(groups, (F.col("payload_digest") == F.col("_d")) & (F.col("payload_length") == F.col("_l")), "left")
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    revisit = F.col("_n").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_keep"))
    return x.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), urn("page_id").alias("record_id"), "target_uri",
        F.when(revisit, urn("_keep")).alias("refers_to"), "payload_digest", "payload_length", F.when(~revisit, F.col("payload")).alias("payload"),
    )


def archive(pages: DataFrame, path: str | None = None) -> str:
    """Write pages as an archive in a shared folder; returns its path."""
    spark = pages.sparkSession
    register(spark)
    path = path or fresh_path(spark, "warc")
    with_revisits(pages).write.format("warc").mode("append").save(path)
    return path


def listing(spark, path: str) -> DataFrame:
    """A row for each record, read back: payloads of responses are decoded and digested, revisits are told by their headers."""
    register(spark)
    base = "record_type string, record_id string, refers_to string, payload_digest string, payload_length long"
    read = lambda more: spark.read.format("warc").schema(base + more).load(path)
    number = lambda c: F.nullif(F.regexp_extract(c, "([^:]*)$", 1), F.lit("")).cast("long")
    full = read(", payload binary").where("record_type = 'response'").select("record_type", "record_id", "refers_to", F.sha1("payload").alias("payload_digest"), F.length("payload").cast("long").alias("payload_bytes"))
    short = read("").where("record_type = 'revisit'").select("record_type", "record_id", "refers_to", "payload_digest", F.col("payload_length").alias("payload_bytes"))
    return full.unionByName(short).select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.when(F.col("refers_to").isNotNull(), number("refers_to")).alias("refers_to"))


ORACLE_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to FROM q
"""


def read_bytes(data: bytes, wanted=lambda h: True, need_block: bool = True) -> list:
    """Records of an archive in memory, for tests and small tools."""
    return list(records(io.BytesIO(data), 0, len(data), wanted, need_block))
