"""WARC archives as a PySpark data source.

Reading: the driver lists files and packs them into partitions; predicates on the record type and on other headers are pushed to the reader,
which parses a record's headers first. A record that they rule out is skipped without its payload being decoded: by
Content-Length in a plain file; in a gzip file by the length of its member, which the writer puts into the gzip header of each
record. Members without it are inflated and read on through, whether they hold one record, many, or a part of one. With the option
``payload=false`` no payload is decoded.

A file that ends within a record or a gzip member fails the read; with the option ``truncated=keep`` the record is returned as far
as it goes, with the column truncated set.

Writing: each task writes files of ``roll_bytes`` at most under names of their own; the commit adds a manifest of the files that
count, and of the manifests that it replaces where the mode is overwrite. Readers go by the manifests if there are any, so what failed or
repeated tasks leave behind is never read. Entries of the map ``headers`` are written, but for those that columns hold and those
that describe the block (Content-Type, Content-Length).

Files are opened by pyarrow's file systems, by URI: local and shared folders, S3, and HDFS where libhdfs is present.

Defined cases: null header columns are left out; a null payload is empty; line breaks in header values become blanks; an
empty folder gives no records; records of other types than response and revisit keep their type; of records with the same id
and payload all are responses.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from docloom.llm.common import cut, fresh_path, join_small, table

SCHEMA = "record_type string, record_id string, target_uri string, date string, refers_to string, payload_digest string, payload_length bigint, headers map<string,string>, payload binary, truncated boolean"
#: The header that each column is.
HEADERS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest", "payload_length": "X-Payload-Length"}
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_END = b"\r\n\r\n"
_BUFFER = 1 << 16


def record(headers: dict[str, str], payload: bytes) -> bytes:
    """The bytes of one record."""
    block = _HTTP + payload
    lines = [b"WARC/1.1", *[f"{k}: {' '.join(str(v).split(chr(13)))}".replace("\n", " ").encode() for k, v in headers.items()]]
    lines += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + _END + block + _END


def member(data: bytes, level: int = 1) -> bytes:
    """A gzip member that holds data, and its own length in an extra field."""
    pack = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = pack.compress(data) + pack.flush()
    extra = struct.pack("<2sHI", b"sl", 4, 20 + len(body) + 8)
    return struct.pack("<4BI2BH", 0x1F, 0x8B, 8, 4, 0, 0, 255, len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


class Truncated(ValueError):
    """A file that ends too soon."""


class _Input:
    """A file read from the front, with skips."""

    def __init__(self, file):
        self.file, self.size, self.at, self.held = file, file.size(), 0, b""

    def peek(self, n: int) -> bytes:
        if len(self.held) < n and (left := self.size - self.at - len(self.held)) > 0:
            more = self.file.read_at(min(max(n - len(self.held), _BUFFER), left), self.at + len(self.held))
            self.held = self.held + more if self.held else more
        return self.held[:n]

    def skip(self, n: int) -> bool:
        """Whether there was so much."""
        self.at, self.held = self.at + n, self.held[n:]
        return self.at <= self.size

    def mark(self) -> None:
        return None


class _Inflated:
    """A gzip file of any number of members, read like a plain one."""

    def __init__(self, file):
        self.file, self.held, self.inflate, self.alone = _Input(file), bytearray(), None, False

    def _more(self) -> bool:
        data = self.file.peek(_BUFFER if self.held else 2048)
        if not data:
            if self.inflate and not self.inflate.eof:
                raise Truncated
            return False
        if self.inflate is None or self.inflate.eof:
            self.inflate = zlib.decompressobj(31)
        self.held += self.inflate.decompress(data)
        self.file.skip(len(data) - len(self.inflate.unused_data))
        return True

    def peek(self, n: int) -> bytes:
        while len(self.held) < n and not (self.alone and self.inflate and self.inflate.eof) and self._more():
            pass
        return bytes(self.held[:n])

    def skip(self, n: int) -> bool:
        while len(self.held) < n:
            n -= len(self.held)
            self.held.clear()
            if not self._more():
                return False
        del self.held[:n]
        return True

    def mark(self) -> int | None:
        """Where the record that begins here ends in the file, if it is a member's only one."""
        if self.held or self.inflate and not self.inflate.eof:
            return None
        head = self.file.peek(20)
        self.alone = len(head) == 20 and head[3] == 4 and head[12:14] == b"sl"
        if not self.alone:
            return None
        self.inflate = None
        return self.file.at + struct.unpack("<I", head[16:20])[0]

    def leave(self, end: int) -> bool:
        self.held.clear()
        self.inflate, self.alone = None, False
        return self.file.skip(end - self.file.at)


def parse_headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if k}


def _payload(headers: dict[str, str], block: bytes) -> bytes:
    return block.partition(_END)[2] if headers.get("Content-Type", "").startswith("application/http") else block


def records(file: _Input | _Inflated, wanted, payload: bool) -> Iterator[tuple[dict[str, str], bytes | None, bool]]:
    """Headers, payload (null if not asked for) and whether the file ended within it."""
    try:
        while True:
            end_of_member, size = file.mark(), 1024
            while end_of_member is None and file.peek(2) == b"\r\n":  # blank lines before a record
                file.skip(2)
                end_of_member = file.mark()
            while (end := (seen := file.peek(size)).find(_END)) < 0 and len(seen) == size:
                size *= 4
            if end < 0 and not seen.strip():
                return
            if end < 0:
                yield parse_headers(seen), None, True
                return
            headers = parse_headers(seen[:end])
            file.skip(end + 4)
            length = int(headers.get("Content-Length", 0))
            asked = wanted(headers)
            if asked and payload:
                block = file.peek(length)
                yield headers, _payload(headers, block), len(block) < length
            if end_of_member is not None:
                whole = file.leave(end_of_member)
            else:
                whole = file.skip(length)
            if asked and not payload:
                yield headers, None, not whole
            if not whole:
                if not asked:
                    yield {}, None, True
                return
    except Truncated:
        yield {}, None, True


@dataclass
class Files(InputPartition):
    paths: list[str]


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() != "false"
        self.bytes = int(options.get("partition_bytes", 64 << 20))
        self.fail = options.get("truncated", "fail").lower() != "keep"
        self.tests: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name in HEADERS and name != "payload_length" and isinstance(f, EqualTo):
                self.tests.append((HEADERS[name], "in", (f.value,)))
            elif name in HEADERS and name != "payload_length" and isinstance(f, In):
                self.tests.append((HEADERS[name], "in", tuple(f.value)))
            elif name in HEADERS and isinstance(f, StringStartsWith):
                self.tests.append((HEADERS[name], "prefix", (f.value,)))
            elif name in HEADERS and isinstance(f, IsNotNull):
                self.tests.append((HEADERS[name], "some", ()))
            else:
                yield f

    def partitions(self) -> list[Files]:
        fs, root = pafs.FileSystem.from_uri(self.path)
        found = {x.base_name: x for x in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if x.is_file}
        manifests = [x for x in found if x.startswith("_committed-")]
        if manifests:
            said = {x: json.loads(fs.open_input_stream(found[x].path).read()) for x in manifests}
            gone = {x for m in said.values() for x in m["replaces"]}
            names = sorted(n for x, m in said.items() if x not in gone for n in m["files"])
        else:
            names = sorted(x for x in found if x.endswith((".warc", ".warc.gz")))
        out, size = [], self.bytes
        for n in names:
            if size + found[n].size > self.bytes:
                out.append(Files([]))
                size = 0
            out[-1].paths.append(found[n].path)
            size += found[n].size
        return out or [Files([])]

    def wanted(self, headers: dict[str, str]) -> bool:
        for name, kind, values in self.tests:
            have = headers.get(name)
            if have is None or kind == "in" and have not in values or kind == "prefix" and not have.startswith(values[0]):
                return False
        return True

    def read(self, partition: Files) -> Iterator[tuple]:
        fs, _ = pafs.FileSystem.from_uri(self.path)
        for path in partition.paths:
            with fs.open_input_file(path) as file:
                source = _Inflated(file) if path.endswith(".gz") else _Input(file)
                for headers, payload, truncated in records(source, self.wanted, self.payload):
                    if truncated and self.fail:
                        raise Truncated(f"{path} ends within a record")
                    row = [headers.get(h) for h in HEADERS.values()]
                    row[-1] = int(row[-1]) if row[-1] else None
                    yield (*row, headers, payload, truncated)


class WarcWriter(DataSourceWriter):
    def __init__(self, schema: StructType, options: dict[str, str], overwrite: bool = False):
        self.names, self.overwrite = schema.names, overwrite
        self.path = options["path"]
        self.gzip = options.get("compression", "gzip") == "gzip"
        self.roll = int(options.get("roll_bytes", 128 << 20))

    def write(self, iterator) -> Written:
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        names, out = [], None
        reserved = {"Content-Type", "Content-Length", *HEADERS.values()}
        for row in iterator:
            headers = {h: row[c] for c, h in HEADERS.items() if c in self.names and row[c] is not None}
            more = row["headers"] if "headers" in self.names else None
            headers |= {k: v for k, v in (more or {}).items() if k not in reserved and v is not None}
            data = record(headers, bytes(row["payload"] or b""))
            if out is None or out.tell() > self.roll:
                if out is not None:
                    out.close()
                names.append(f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.gzip)
                out = fs.open_output_stream(f"{root}/{names[-1]}", compression=None)
            out.write(member(data) if self.gzip else data)
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        before = {x.base_name: x.path for x in fs.get_file_info(pafs.FileSelector(root)) if x.is_file} if self.overwrite else {}
        files = [n for m in messages if m for n in m.names]
        before = {name: path for name, path in before.items() if name not in files}
        manifest = {"files": files, "replaces": [x for x in before if x.startswith("_committed-")]}
        with fs.open_output_stream(f"{root}/_committed-{uuid.uuid4().hex}", compression=None) as out:
            out.write(json.dumps(manifest).encode())
        # manifests go last: until then the new one hides them
        for name in sorted(before, key=lambda x: x.startswith("_committed-")):
            if name.startswith("_committed-") or name.endswith((".warc", ".warc.gz")):
                fs.delete_file(before[name])

    def abort(self, messages) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        for name in [n for m in messages if m for n in m.names]:
            fs.delete_file(f"{root}/{name}")


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(schema, self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def archive(pages: DataFrame, path: str, least: int = 1000) -> None:
    """Writes a record for each row of pages (page_id, url, html). Of equal payloads of `least` bytes or more, the one with the largest
    page_id is the response, the others revisit it; of several such rows (or where none has an id) the one with the largest url, then the last."""
    register(pages.sparkSession)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("bigint"))
    # of the same page_id (or none) the largest url counts, then the place in the table
    rows = rows.withColumn("who", F.struct("page_id", "url", F.monotonically_increasing_id().alias("place")))
    same = rows.where(F.col("size") >= least).groupBy("digest").agg(F.max("who").alias("last_who"), F.count("*").alias("n"))
    rows = join_small(rows, cut(same.where("n > 1").select("digest", "last_who"), "copies"), ["digest"])
    again = F.coalesce(F.col("size") >= least, F.lit(False)) & F.col("last_who").isNotNull() & ~F.col("who").eqNullSafe(F.col("last_who"))
    urn = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    out = rows.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        urn("page_id").alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit("1970-01-01T00:00:00Z").alias("date"),
        F.when(again, urn("last_who.page_id")).alias("refers_to"),
        F.concat(F.lit("sha1:"), "digest").alias("payload_digest"),
        F.col("size").alias("payload_length"),
        F.lit(None).cast("map<string,string>").alias("headers"),
        F.when(~again, F.col("payload")).alias("payload"),
    )
    out.write.format("warc").mode("append").save(path)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    archive(table(spark, sf_dir, "pages"), path)
    page = lambda c: F.nullif(F.regexp_extract(c, "^<urn:x-page:(.*)>$", 1), F.lit("")).cast("bigint")
    # the type is pushed to the reader; of revisits only headers are read, where the writer put the full payload's size and digest
    full = spark.read.format("warc").load(path).where("record_type = 'response'")
    again = spark.read.format("warc").option("payload", "false").load(path).where("record_type = 'revisit'")
    own = [F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.sha1("payload").alias("payload_digest")]
    said = [F.col("payload_length").alias("payload_bytes"), F.substring_index("payload_digest", ":", -1).alias("payload_digest")]
    rest = ["record_type", page("refers_to").alias("refers_to")]
    return full.select(page("record_id").alias("page_id"), *own, *rest).union(again.select(page("record_id").alias("page_id"), *said, *rest))


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to
FROM m
"""
