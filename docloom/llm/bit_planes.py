"""Token ids in files of bit planes: a PySpark data source, and the job that fills it from documents.

A file: the magic, then blocks, then an index, then the index's length and the magic. A block is 65,536 ids (the last of a file: fewer) as unsigned
integers of `width` bytes, transposed into planes - of `planes` = bit, plane i holds bit i of each id; of byte, byte i - each compressed on its own
with zstandard. The index (a JSON head, then arrays in zstandard) has the offset, number of ids and plane sizes of each block, and each
document's id and end. A manifest, written when all tasks are done, names the files in order with their documents, ids and range of document ids:
files of lost or repeated tasks are not in it, and so are never read. A save replaces what the folder held before. Filters on doc_id skip files by the manifest, and blocks by the index.

Nulls: a null text is empty and has the end id alone; rows without doc_id come first. Documents of the same id are ordered by a hash of their ids, then
by their place. Very long texts are encoded whole; a document may span blocks, not files. An empty table gives a manifest without files. Columns
other than doc_id and text are not looked at.
"""

from __future__ import annotations

import functools
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from docloom.llm.common import Words, batches, fresh_path, mix, table
from docloom.shared import cut, cuts, drop_cuts

MAGIC = b"IDPLANE1"
BLOCK = 1 << 16
SCHEMA = "doc_id bigint, start bigint, n_tokens bigint, ids binary"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def to_planes(ids: np.ndarray, width: int, planes: str) -> list[bytes]:
    """The planes of ids: 8 * width of bits, or width of bytes."""
    rows = ids.astype(f"<u{width}").view(np.uint8).reshape(-1, width)
    if planes == "bit":
        return [p.tobytes() for p in np.packbits(np.unpackbits(rows, axis=1, bitorder="little").T, axis=1)]
    return [p.tobytes() for p in np.ascontiguousarray(rows.T)]


def from_planes(parts: list[bytes], n: int, width: int, planes: str) -> np.ndarray:
    stacked = np.frombuffer(b"".join(parts), np.uint8).reshape(len(parts), -1)
    rows = np.packbits(np.unpackbits(stacked, axis=1, count=n).T, axis=1, bitorder="little") if planes == "bit" else stacked.T
    return np.ascontiguousarray(rows).view(f"<u{width}").ravel().astype(np.uint32)


class PlaneFile:
    """Writes a file: documents one after the other, blocks as they are full."""

    def __init__(self, out, width: int, planes: str, level: int):
        self.out, self.width, self.planes, self.pack = out, width, planes, zstandard.ZstdCompressor(level=level)
        self.at, self.held, self.n_held, self.n = len(MAGIC), [], 0, 0
        self.blocks, self.docs, self.ends = [], [], []
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> 8 * self.width:
            raise ValueError(f"an id of {int(ids.max())} is too large for {self.width} bytes")
        self.docs.append(doc_id)
        self.n += len(ids)
        self.ends.append(self.n)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= BLOCK:
            self.flush(self.n_held // BLOCK * BLOCK)

    def flush(self, upto: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        for low in range(0, upto, BLOCK):
            parts = [self.pack.compress(p) for p in to_planes(ids[low : min(low + BLOCK, upto)], self.width, self.planes)]
            self.blocks.append([self.at, min(BLOCK, upto - low), *map(len, parts)])
            for p in parts:
                self.out.write(p)
                self.at += len(p)
        self.held, self.n_held = [ids[upto:]], len(ids) - upto

    def close(self) -> None:
        self.flush(self.n_held)
        known = np.array([d is not None for d in self.docs], np.uint8)
        arrays = [np.array(self.blocks, "<i8").reshape(len(self.blocks), -1), np.array([d or 0 for d in self.docs], "<i8"), known, np.array(self.ends, "<i8")]
        packed = [self.pack.compress(a.tobytes()) for a in arrays]
        head = json.dumps({"width": self.width, "planes": self.planes, "blocks": len(self.blocks), "docs": len(self.docs), "sizes": list(map(len, packed))}).encode()
        self.out.write(b"".join([head, *packed, len(head).to_bytes(8, "little"), (len(head) + sum(map(len, packed))).to_bytes(8, "little"), MAGIC]))
        self.out.close()


class PlaneIndex:
    """The index of a file, and its blocks by number."""

    def __init__(self, file):
        size = file.size()
        tail = file.read_at(24, size - 24) if size >= 24 + len(MAGIC) else b""
        if tail[16:] != MAGIC:
            raise ValueError("not a whole file of planes")
        n_head, n_all = int.from_bytes(tail[:8], "little"), int.from_bytes(tail[8:16], "little")
        data = file.read_at(n_all, size - 24 - n_all)
        head, at, arrays = json.loads(data[:n_head]), n_head, []
        for n in head["sizes"]:
            arrays.append(zstandard.decompress(data[at : at + n]))
            at += n
        self.file, self.width, self.planes = file, head["width"], head["planes"]
        self.blocks = np.frombuffer(arrays[0], "<i8").reshape(head["blocks"], -1)
        self.known = np.frombuffer(arrays[2], np.uint8).astype(bool)
        self.docs, self.ends = np.frombuffer(arrays[1], "<i8"), np.frombuffer(arrays[3], "<i8")
        self._last = (-1, None)

    def block(self, i: int) -> np.ndarray:
        if self._last[0] != i:
            offset, n, *sizes = self.blocks[i].tolist()
            data, cuts = self.file.read_at(sum(sizes), offset), np.cumsum([0, *sizes]).tolist()
            parts = [zstandard.decompress(data[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            self._last = (i, from_planes(parts, n, self.width, self.planes))
        return self._last[1]

    def ids(self, low: int, high: int) -> np.ndarray:
        """The ids from low to high; only blocks that have some are read."""
        parts = [self.block(i)[max(low - i * BLOCK, 0) : high - i * BLOCK] for i in range(low // BLOCK, -(-high // BLOCK))] if high > low else []
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


@dataclass
class Part(InputPartition):
    name: str
    start: int


@dataclass
class Done(WriterCommitMessage):
    part: int
    files: list[dict]


class PlaneReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.low, self.high, self.some = options["path"], None, None, None

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            if getattr(f, "attribute", None) != ("doc_id",) or not isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                yield f
                continue
            if isinstance(f, (EqualTo, In)):
                some = set(f.value) if isinstance(f, In) else {f.value}
                self.some = some if self.some is None else self.some & some
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                low = f.value + isinstance(f, GreaterThan)
                self.low = low if self.low is None else max(self.low, low)
            else:
                high = f.value - isinstance(f, LessThan)
                self.high = high if self.high is None else min(self.high, high)

    def _asked(self) -> bool:
        return not self.low is self.high is self.some is None

    def _wanted(self, docs: np.ndarray, known: np.ndarray) -> np.ndarray:
        out = known.copy() if self._asked() else np.ones(len(docs), bool)
        out &= (docs >= self.low) if self.low is not None else True
        out &= (docs <= self.high) if self.high is not None else True
        return out & np.isin(docs, np.array(sorted(self.some), np.int64)) if self.some is not None else out

    def partitions(self) -> list[Part]:
        fs, root = pafs.FileSystem.from_uri(self.path)
        with fs.open_input_stream(f"{root}/_manifest.json", compression=None) as file:
            files = json.loads(file.read())
        out, start = [], 0
        for f in files:
            least, most = f["least"], f["most"]
            none = self._asked() and (most is None or self.low is not None and most < self.low or self.high is not None and least > self.high or self.some is not None and not any(least <= v <= most for v in self.some))
            if not none:
                out.append(Part(f["name"], start))
            start += f["ids"]
        return out or [Part("", 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        fs, root = pafs.FileSystem.from_uri(self.path)
        with fs.open_input_file(f"{root}/{partition.name}") as file:
            index = PlaneIndex(file)
            starts = np.concatenate(([0], index.ends[:-1])) if len(index.ends) else index.ends
            rows, size = [], 0
            for i in np.flatnonzero(self._wanted(index.docs, index.known)).tolist():
                low, high = int(starts[i]), int(index.ends[i])
                rows.append((int(index.docs[i]) if index.known[i] else None, partition.start + low, high - low, index.ids(low, high).tobytes()))
                size += 4 * (high - low) + 32
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class PlaneWriter(DataSourceArrowWriter):
    """Rows (doc_id, ids): ids as little-endian unsigned 32-bit integers, or of `width` bytes where `packed` is true; in order within and across partitions."""

    def __init__(self, options):
        self.path, self.width, self.planes = options["path"], int(options.get("width", 4)), options.get("planes", "bit")
        self.level, self.packed = int(options.get("level", 3)), options.get("packed", "false").lower() == "true"
        if self.width not in (1, 2, 4) or self.planes not in ("bit", "byte"):
            raise ValueError("width is 1, 2 or 4; planes are bit or byte")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Done:
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        name, file, kind = f"part-{uuid.uuid4().hex}.planes", None, f"<u{self.width if self.packed else 4}"
        for batch in iterator:
            docs, ids = batch.column(batch.schema.get_field_index("doc_id")), batch.column(batch.schema.get_field_index("ids"))
            for doc, data in zip(docs.to_pylist(), ids, strict=True):
                file = file or PlaneFile(fs.open_output_stream(f"{root}/{name}", compression=None), self.width, self.planes, self.level)
                file.add(doc, np.frombuffer(data.as_buffer() or b"", kind).astype(np.uint32))
        if file is None:
            return Done(TaskContext.get().partitionId(), [])
        file.close()
        known = [d for d in file.docs if d is not None]
        said = {"name": name, "docs": len(file.docs), "ids": file.n, "least": min(known, default=None), "most": max(known, default=None)}
        return Done(TaskContext.get().partitionId(), [said])

    def commit(self, messages) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        files = [f for m in sorted((m for m in messages if m), key=lambda m: m.part) for f in m.files]
        # written aside and moved, so that readers find a whole manifest or the one before
        fresh = f"{root}/_manifest-{uuid.uuid4().hex}"
        with fs.open_output_stream(fresh, compression=None) as out:
            out.write(json.dumps(files).encode())
        fs.move(fresh, f"{root}/_manifest.json")

    def abort(self, messages) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        for name in [f["name"] for m in messages if m for f in m.files]:
            fs.delete_file(f"{root}/{name}")


class PlaneDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "idplanes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> PlaneReader:
        return PlaneReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> PlaneWriter:
        return PlaneWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PlaneDataSource)


def pieces(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces of texts begin (and the last ends): at each text, and at ASCII white space that follows a character which is none. A byte-level
    tokenizer takes white space together with what follows it, so no token goes over such a place and nothing before it tells how to go on."""
    space = (data == 0x20) | (data >= 9) & (data <= 13)
    before = np.concatenate((np.zeros(min(len(data), 1), np.uint8), data[:-1]))
    begins = np.zeros(len(data) + 1, bool)
    begins[:-1] = space & (before > 0x20) & (before < 0x7F)
    other = np.flatnonzero(space & (before >= 0x80))  # white space beyond ASCII: U+0085, U+00A0, U+1680, U+2000 to U+205F, U+3000; some others stay whole, too
    third, second, first = (data[np.maximum(other - k, 0)] for k in (3, 2, 1))
    near = (second == 0xC2) & np.isin(first, (0x85, 0xA0)) | np.isin(third.astype(np.int64) * 256 + second, (0xE19A, 0xE280, 0xE281, 0xE380))
    begins[other[~near]] = True
    begins[offsets] = True
    return np.flatnonzero(begins)


def hashed(data: np.ndarray, at: np.ndarray, plus: int = 1) -> np.ndarray:
    """A 64-bit hash of each run of bytes; another for another plus."""
    size = np.diff(at)
    if not len(size):
        return np.zeros(0, np.uint64)
    place = np.arange(len(data)) - np.repeat(at[:-1], size)
    values = mix(data.astype(np.uint64) * np.uint64(plus)) if plus > 1 else data.astype(np.uint64) + np.uint64(1)
    return mix(np.add.reduceat(values * Words.powers(int(size.max()))[place], at[:-1]) + size.astype(np.uint64))


class Encoder:
    """Encodes texts piece by piece: the tokenizer sees each distinct piece once, and again only when `most` pieces were kept. Pieces are told apart by
    64 bits within a batch and 128 across."""

    def __init__(self, tokenizer: str, most: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(tokenizer), most
        self.line = self.ids("\n")
        self.clear()

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def clear(self) -> None:
        """Of each kept piece, by the first hash: both hashes, and where its ids begin and end in the pool."""
        self.keys, self.checks, self.begin, self.end = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def fresh(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, and how many each has. A blank and what is no white space, as most are, goes to the tokenizer many at a time, between line
        feeds: such a piece is taken for itself there, and the line feed's id, which it cannot have, tells where it ends."""
        plain = [i for i, t in enumerate(texts) if t[:1] == " " and len(t.split()) == 1 and not t[1:2].isspace() and not t[-1:].isspace() and "<|" not in t]
        counts, out = np.zeros(len(texts), np.int64), [None] * len(texts)
        for low in range(0, len(plain) if len(self.line) == 1 else 0, 1000):
            some = plain[low : low + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast(["\n".join([texts[i] for i in some])], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.append(np.flatnonzero(ids == self.line[0]), len(ids))
            if len(ends) == len(some):
                for i, a, b in zip(some, [0, *(ends[:-1] + 1).tolist()], ends.tolist(), strict=True):
                    out[i] = ids[a:b]
        others = [i for i, x in enumerate(out) if x is None]
        for i, found in zip(others, self.tokenizer.encode_batch_fast([texts[i] for i in others], add_special_tokens=False), strict=True):
            out[i] = np.array(found.ids, np.uint32)
        counts = np.array([len(x) for x in out], np.int64)
        return np.concatenate(out) if out else np.zeros(0, np.uint32), counts

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        at = pieces(data, offsets)
        keys, first, which = np.unique(hashed(data, at), return_index=True, return_inverse=True)
        if len(self.keys) > self.most:
            self.clear()
        begin, size = at[first], at[first + 1] - at[first]
        one = np.concatenate(([0], np.cumsum(size)))
        checks = hashed(data[np.repeat(begin - one[:-1], size) + np.arange(one[-1])], one, 0x9E3779B1)
        place = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        known = (self.keys[place] == keys) & (self.checks[place] == checks) if len(self.keys) else np.zeros(len(keys), bool)
        start, end, pool = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), self.pool
        start[known], end[known] = self.begin[place[known]], self.end[place[known]]
        if not known.all():
            raw, new = data.tobytes(), np.flatnonzero(~known)
            ids, counts = self.fresh([raw[a : a + n].decode() for a, n in zip(begin[new].tolist(), size[new].tolist(), strict=True)])
            end[new] = len(pool) + np.cumsum(counts)
            start[new] = end[new] - counts
            pool = self.pool = np.concatenate((pool, ids))
            merged = np.concatenate((self.keys, keys[new]))
            order = np.argsort(merged, kind="stable")
            self.keys = merged[order]
            self.checks, self.begin, self.end = (np.concatenate(x)[order] for x in ((self.checks, checks[new]), (self.begin, start[new]), (self.end, end[new])))
        each = (end - start)[which]
        upto = np.concatenate(([0], np.cumsum(each)))
        out = pool[np.repeat(start[which] - upto[:-1], each) + np.arange(upto[-1])]
        return out, np.diff(upto[np.searchsorted(at, offsets)])


@functools.cache
def encoder_of(tokenizer: str) -> Encoder:
    """One for a worker process, which runs many tasks."""
    return Encoder(tokenizer)


def _encode(tokenizer: str, end_id: int | None, width: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, place = encoder_of(tokenizer), 0
        for part in parts:
            for batch in batches(part, "text", 4 << 20):
                ids, counts = encoder(batch.column("text"))
                if end_id is not None:
                    ids, counts = np.insert(ids, np.cumsum(counts), end_id), counts + 1
                if len(ids) and int(ids.max()) >> 8 * width:
                    raise ValueError(f"an id of {int(ids.max())} is too large for {width} bytes")
                ends = np.concatenate(([0], np.cumsum(counts))) * width
                values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids.astype(f"<u{width}"))])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").cast(pa.int64()), pa.array(np.arange(place, place + len(counts))), pa.array(counts.astype(np.int64)), values.cast(pa.binary())],
                    names=["doc_id", "place", "n_tokens", "ids"],
                )
                place += len(counts)

    return run


def encoded(docs: DataFrame, tokenizer: str, end_id: int | None = None, width: int = 4) -> DataFrame:
    """(doc_id, part, place, n_tokens, ids): the ids of each whole text, of `width` bytes each. tokenizer: the path of its file, the same on all executors."""
    schema = "doc_id bigint, place bigint, n_tokens bigint, ids binary"
    return docs.select("doc_id", "text").mapInArrow(_encode(tokenizer, end_id, width), schema).withColumn("part", F.spark_partition_id())


def write_planes(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None, width: int = 2, planes: str = "bit", file_ids: int = 1 << 26) -> None:
    """Encodes docs (doc_id, text) and writes their ids in ascending doc_id order: `file_ids` ids a file, or a file for each shuffle partition if that
    is more. Ids are shuffled (once, by range), texts are not."""
    spark = docs.sparkSession
    register(spark)
    before = cuts(spark)
    rows = cut(encoded(docs, tokenizer, end_id, width), "ids", "zstd")
    total = rows.agg(F.sum("n_tokens")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // file_ids))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("ids"), F.col("part"), F.col("place")]
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ordered.select("doc_id", "ids").write.format("idplanes").option("width", width).option("planes", planes).option("packed", "true").mode("append").save(path)
    drop_cuts(spark, [p for p in cuts(spark) if p not in before])


def op12_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = fresh_path(spark, "planes")
    write_planes(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    back = spark.read.format("idplanes").load(path)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
