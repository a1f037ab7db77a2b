"""Helpers that the operators of this subpackage share: tables, shared folders, words of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.shared import cut, fresh_path, shared_dir, spread  # noqa: F401

#: Separators of the two kinds of words. FOLDED words: ASCII letters and digits and all that is not ASCII.
SPACES = bytes([0x20, *range(0x09, 0x0E)])
FOLDED_SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_TILE = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def packed(docs: DataFrame, text: str) -> tuple[DataFrame, list]:
    """docs as (kept_row, text), and the expressions that make its columns again: no name of its columns can clash with an operator's own."""
    rest = [c for c in docs.columns if c != text]
    row = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)])
    columns = [F.col("text" if c == text else f"kept_row.c{rest.index(c)}").alias(c) for c in docs.columns]
    return docs.select(row.alias("kept_row"), F.col(f"`{text}`").cast("string").alias("text")), columns


def join_small(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    how: str = "left",
    max_rows: int = 20_000,
    salts: int = 64,
    rows: int | None = None,
) -> DataFrame:
    """left joined with right, which has few rows, and few per key. Where the number of its rows is not given it is counted: up to
    max_rows it is broadcast; beyond that it is repeated once per salt, so that a key which holds a large part of left is spread over
    several tasks. Null keys match null keys. right should be cheap to compute twice (a table read, or a result of cut())."""
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    rest = [c for c in right.columns if c not in keys]
    out = [F.col(f"l.{c}").alias(c) for c in left.columns] + [F.col(f"r.{c}").alias(c) for c in rest]
    if (right.count() if rows is None else rows) <= max_rows:
        return left.alias("l").join(F.broadcast(right).alias("r"), on, how).select(out)
    left = left.withColumn("_salt", (F.rand(7) * salts).cast("int"))
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.alias("l").join(right.alias("r"), [*on, F.col("l._salt") == F.col("r._salt")], how).select(out)


def hot_keys(counts: DataFrame, key: str, count: str, least: int = 1000) -> DataFrame:
    """The keys that hold more than a ten-thousandth of all rows (and ``least`` rows): 10,000 at most, whatever the table."""
    total = counts.agg(F.sum(count)).first()[0] or 0
    return cut(counts.where(F.col(count) > max(total / 10_000, least)).select(key), "hot")


def join_hot(left: DataFrame, right: DataFrame, key: str, hot: DataFrame, how: str = "left") -> DataFrame:
    """left joined with right, one row per key, by shuffle; but the keys of hot_keys() meet a broadcast part of right, so that none of them
    has its rows in one task. Both sides should be cheap to read twice. A key that is null stays without a partner."""
    marked = left.join(F.broadcast(hot.select(key, F.lit(True).alias("_hot"))), key, "left")
    cold = marked.where("_hot IS NULL").drop("_hot").join(right, key, how)
    few = right.join(F.broadcast(hot), key, "left_semi")
    return cold.unionByName(marked.where("_hot").drop("_hot").join(F.broadcast(few), key, how))


def hash_mod(column: str, n: int):
    """crc32 of the value as text, mod n; null for null."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))


def _table_for(separators: bytes, lower: bool) -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32 * lower
    out[list(separators)] = 0
    return out


class Words:
    """The words of a column of texts, without a Python object for each.

    hashes: a 64-bit hash for each word, if lower ASCII letters in either case alike; start, end: its bytes within data;
    first: for each text (and once more, at the end), the index of its first word. Null is an empty text.
    """

    _powers = np.ones(1, np.uint64)

    def __init__(self, texts: pa.Array, separators: bytes = SPACES, hashed: bool = True, lower: bool = True):
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        texts = texts.cast(pa.large_string())
        if texts.null_count:
            texts = texts.fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = texts.buffers()[2] if len(texts) else None
        self.data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0]
        n = len(self.data)
        fold = _table_for(separators, lower)
        borders = np.zeros(n + 1, bool)
        borders[self.offsets] = True
        starts, ends, hashes = [], [], []
        lo = 0
        while lo < n:
            hi = min(n, lo + _TILE)
            while hi < n:  # a tile ends where no word goes on
                near = fold[self.data[hi : hi + 4096]] == 0
                near |= borders[hi : hi + len(near)]
                if near.any():
                    hi += int(near.argmax())
                    break
                hi += len(near)
            hi = min(hi, n)
            f = fold[self.data[lo:hi]]
            inside = f != 0
            before = np.concatenate(([False], inside[:-1])) & ~borders[lo:hi]
            after = np.concatenate((inside[1:], [False])) & ~borders[lo + 1 : hi + 1]
            s, e = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
            starts.append(s + lo)
            ends.append(e + lo)
            if hashed and len(s):
                size = e - s
                at = np.cumsum(size) - size
                place = np.arange(size.sum()) - np.repeat(at, size)
                hashes.append(np.add.reduceat(f[inside].astype(np.uint64) * self.powers(int(size.max()))[place], at) + size.astype(np.uint64))
            lo = hi
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.start, self.end = join(starts, np.int64), join(ends, np.int64)
        self.hashes = mix(join(hashes, np.uint64)) if hashed else None
        self.first = np.searchsorted(self.start, self.offsets)

    @classmethod
    def powers(cls, n: int) -> np.ndarray:
        if len(cls._powers) < n:
            out = np.full(max(n, 256), 0x9E3779B97F4A7C55, np.uint64)
            out[0] = 0xD6E8FEB86659FD93
            cls._powers = np.multiply.accumulate(out)
        return cls._powers

    def __len__(self) -> int:
        return len(self.first) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads each bit over all."""
    h = h.copy()
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xA0761D6478BD642F)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    return h ^ (h >> np.uint64(32))


def shingles(words: Words, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word windows of each text, in order, and the index of each text's first (and the end). A text of
    fewer words, but not none, has one window: all its words."""
    h, counts = words.hashes, words.counts
    sizes = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    first = np.concatenate(([0], np.cumsum(sizes)))
    doc = np.repeat(np.arange(len(words)), sizes)
    at = words.first[:-1][doc] + np.arange(first[-1]) - first[:-1][doc]
    left = words.first[1:][doc] - at  # words from here to the end of the text
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        have = left > k
        part = h[np.where(have, at + k, 0)] if len(h) else np.zeros(0, np.uint64)
        out = out * np.uint64(0xC2B2AE3D27D4EB4F) + np.where(have, part, np.uint64(k + 1))
    return mix(out), first


def batches(of: pa.RecordBatch, column: str, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about so many bytes of text each, one row at least."""
    size = np.asarray(pc.binary_length(of.column(column)).fill_null(0)).astype(np.int64)
    group = np.cumsum(size) // most
    edges = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1, [len(size)])) if len(size) else []
    for lo, hi in zip(edges[:-1], edges[1:], strict=True) if len(size) else ():
        yield of.slice(int(lo), int(hi - lo))
