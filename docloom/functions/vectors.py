"""Vector functions over arrays of floats, and a deterministic embedder."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.batches import filled, token_codes
from docloom.functions.text import tokens


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def score(metric: str, a: Column, b: Column) -> Column:
    """Higher is better: cosine, inner_product, or l2 (the negative distance)."""
    if metric == "cosine":
        return cosine(a, b)
    if metric == "inner_product":
        return dot(a, b)
    if metric == "l2":
        return F.lit(0.0) - l2(a, b)
    raise ValueError(f"no such metric: {metric}")


def bucket(token: Column, dimensions: int) -> Column:
    """The dimension that a token counts in."""
    return F.pmod(F.conv(F.substring(F.md5(token.cast("binary")), 1, 8), 16, 10).cast("bigint"), F.lit(dimensions)).cast("int")


def sign(token: Column) -> Column:
    return F.when(F.conv(F.substring(F.md5(token.cast("binary")), 9, 1), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)


def hashed_parts(rows: DataFrame, keys: list[str], text: str, dimensions: int = 64) -> DataFrame:
    """(keys, dim, x): the non-zero parts of the hashing embedder's unit vectors. Sparse rows are what joins and dot products
    of many texts need; :func:`hashed_vectors` makes arrays of them."""
    term = rows.select(*keys, F.explode(tokens(F.col(text))).alias("t"))
    parts = term.groupBy(*keys, bucket(F.col("t"), dimensions).alias("dim")).agg(F.sum(sign(F.col("t"))).alias("x")).where("x != 0")
    size = parts.groupBy(*keys).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return parts.join(size, keys).select(*keys, "dim", (F.col("x") / F.col("norm")).alias("x"))


class Places(dict):
    """Where a token counts: its dimension, and beyond the dimensions where its sign is negative. As bucket() and sign() say; kept for up to 100,000 tokens."""

    def __init__(self, dimensions: int):
        super().__init__()
        self.dimensions = dimensions

    def __missing__(self, token: str) -> int:
        digest = hashlib.md5(token.encode()).hexdigest()
        if len(self) >= 100_000:
            self.clear()
        self[token] = at = int(digest[:8], 16) % self.dimensions + self.dimensions * (int(digest[8], 16) % 2)
        return at


def places_of(names: pa.Array, dimensions: int, end: bytes = b"") -> np.ndarray:
    """Where each token, with what stands behind it, counts, as Places says."""
    said = names.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
    digest = np.frombuffer(b"".join([hashlib.md5(t + end).digest() for t in said]), ">u4").reshape(-1, 4)
    return digest[:, 0].astype(np.int64) % dimensions + dimensions * (digest[:, 1].astype(np.int64) >> 28 & 1)


def kinds(rows: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)


def merged(batch: pa.RecordBatch, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each key of a batch, and for each row, which of these is of its key."""
    code = np.zeros(len(batch), np.int64)
    for k in keys:
        part = batch.column(k).dictionary_encode("encode").indices.to_numpy()
        _, code = np.unique(code * len(batch) + part, return_inverse=True)
    _, first, own = np.unique(code, return_index=True, return_inverse=True)
    return first, own


def listed(batch: pa.RecordBatch, keys: list[str], first: np.ndarray, sums: np.ndarray, unit: bool = False) -> pa.RecordBatch:
    """Rows `first` of a batch's keys with their sums; zeros are left out. unit: as unit vectors."""
    some = np.flatnonzero(sums.any(axis=1))
    sums = sums[some] / np.sqrt((sums[some] ** 2).sum(axis=1, keepdims=True)) if unit else sums[some]
    edges = pa.array(np.arange(len(some) + 1) * sums.shape[1], pa.int32())
    return pa.RecordBatch.from_arrays([*[batch.column(k).take(pa.array(first[some])) for k in keys], pa.ListArray.from_arrays(edges, pa.array(sums.ravel()))], names=[*keys, "embedding"])


def summed(parts: DataFrame, keys: list[str], unit: bool = False) -> DataFrame:
    """(keys, embedding): integer parts (keys, embedding) of equal keys added up; zeros have no row. A short row for each text is shuffled."""

    def add(of: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in of:
            if len(batch):
                lists = batch.column("vs")
                sizes, each = lists.value_lengths().to_numpy(), lists.flatten()
                sums = np.add.reduceat(each.flatten().to_numpy().reshape(len(each), -1), np.cumsum(sizes) - sizes)
                yield listed(batch, keys, np.arange(len(batch)), sums if unit else sums.astype(float), unit)

    return parts.groupBy(*keys).agg(F.collect_list("embedding").alias("vs")).mapInArrow(add, f"{kinds(parts, keys)}, embedding array<double>")


def hashed_vectors(rows: DataFrame, keys: list[str], text: str, dimensions: int = 64, unique: bool = False) -> DataFrame:
    """(keys, embedding): unit vectors of token counts, each token in a dimension and with a sign by its hash. Texts without a
    token have no row; texts of equal keys count as one. Tokens are summed where the text is. unique: keys don't repeat, so nothing is shuffled."""

    def count(of: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filled(of, "_text"):
            first, own = (np.arange(len(batch)),) * 2 if unique else merged(batch, keys)
            text, code, names = token_codes(batch.column("_text"))
            both = np.bincount(own[text] * 2 * dimensions + places_of(names, dimensions)[code], minlength=2 * dimensions * len(first)).reshape(-1, 2, dimensions)
            yield listed(batch, keys, first, both[:, 0] - both[:, 1], unique)

    made = rows.select(*keys, F.lower(text).alias("_text")).mapInArrow(count, f"{kinds(rows, keys)}, embedding array<{'double' if unique else 'bigint'}>")
    return made if unique else summed(made, keys, True)
