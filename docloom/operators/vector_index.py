"""A kept index of vectors: coarse cells, product-quantised residuals, exact rescoring.

Cells and codebooks are fit on a bounded sample (`train_rows` rows, those of the least hashes); every row is indexed. Rows are laid out by cell, and a
cell that holds many rows is split over files by a hash of the id. A search asks the `probes` cells nearest to each query: their codes, a byte for each
part of the vector, give an approximate cosine for every row, and the `rescore` best of each query are compared exactly. Only files and row groups of
these cells are read; with probes = cells and rescore = all rows the answer is exact.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.search import top_k, unit_matrix
from docloom.shared import cut


def _lloyd(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Centres of so many groups of a bounded sample."""
    centres = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = (x @ centres.T - (centres**2).sum(1) / 2).argmax(1)
        size = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centres)
    return centres


class Coder:
    """Cells, and a codebook for each part of what a vector is beside its cell's centre."""

    def __init__(self, cells: np.ndarray, books: np.ndarray):
        self.cells, self.books = cells, books  # cell, dimension; part, code, dimension of the part

    @classmethod
    def fit(cls, sample: np.ndarray, cells: np.ndarray, parts: int, codes: int = 256) -> Coder:
        rest = sample - cells[cls._near(sample, cells)]
        split = rest.reshape(len(rest), parts, -1).transpose(1, 0, 2)
        books = [_lloyd(p, codes, seed=i) for i, p in enumerate(split)]
        return cls(cells, np.array(books))

    @staticmethod
    def _near(x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        return (x @ cells.T - (cells**2).sum(1) / 2).argmax(1)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = self._near(x, self.cells)
        rest = (x - self.cells[cell]).reshape(len(x), len(self.books), -1)
        codes = [(rest[:, i] @ b.T - (b**2).sum(1) / 2).argmax(1) for i, b in enumerate(self.books)]
        return cell, np.array(codes, np.uint8).T.reshape(len(x), len(self.books))

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Of each query: its product with each code of each part."""
        return np.einsum("qpd,pcd->qpc", q.reshape(len(q), len(self.books), -1), self.books)

    def probed(self, q: np.ndarray, probes: int) -> np.ndarray:
        """Of each query, the cells it asks: those whose centres it has the largest products with."""
        order = np.argsort(-(q @ self.cells.T), axis=1, kind="stable")[:, :probes]
        out = np.zeros((len(q), len(self.cells)), bool)
        np.put_along_axis(out, order, True, 1)
        return out


class VectorIndex:
    def __init__(self, spark: SparkSession, path: str):
        row = spark.read.parquet(f"{path}/coder").first()
        said = json.loads(row["shape"])
        self.spark, self.path, self.rows = spark, path, spark.read.parquet(f"{path}/rows")
        self.coder = Coder(np.frombuffer(row["cells"]).reshape(said["cells"]), np.frombuffer(row["books"]).reshape(said["books"]))

    @classmethod
    def build(cls, rows: DataFrame, path: str, cells: int = 64, parts: int = 16, train_rows: int = 50_000) -> VectorIndex:
        """Indexes rows (id, v) in a folder: vectors of one size, a multiple of parts. A vector that is null or has no length is compared as zeros."""
        spark = rows.sparkSession
        sample = cut(rows.where("v IS NOT NULL").orderBy(F.xxhash64("id")).limit(train_rows).select(F.col("v").cast("array<double>").alias("v")), "sample")
        x = unit_matrix(pa.array([r["v"] for r in sample.collect()], pa.list_(pa.float64())))
        if not len(x) or x.shape[1] % parts:
            raise ValueError(f"there are no vectors, or their size is no multiple of {parts}")
        train = spark.createDataFrame([(v,) for v in x.tolist()], "v array<double>").select(array_to_vector("v").alias("features"))
        model = KMeans(k=max(min(cells, len(x)), 2), seed=3, maxIter=10, initSteps=2).fit(train)
        coder = Coder.fit(x, np.array(model.clusterCenters()), parts)
        made = (json.dumps({"cells": coder.cells.shape, "books": coder.books.shape}), coder.cells.tobytes(), coder.books.tobytes())
        spark.createDataFrame([made], "shape string, cells binary, books binary").write.parquet(f"{path}/coder")
        kind = rows.schema["id"].dataType.simpleString()

        def run(of: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in of:
                x = unit_matrix(batch.column("v"), coder.cells.shape[1])
                cell, codes = coder.encode(x)
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.astype(np.float32).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), vectors], names=["id", "cell", "codes", "v"])

        coded = rows.select("id", F.col("v").cast("array<double>").alias("v")).mapInArrow(run, f"id {kind}, cell int, codes binary, v array<float>")
        coded.repartitionByRange("cell", F.xxhash64("id")).sortWithinPartitions("cell").write.parquet(f"{path}/rows")
        return cls(spark, path)

    def search(self, queries: DataFrame, k: int, probes: int = 16, rescore: int = 200, block: int = 1000) -> DataFrame:
        """(query, id, score, rank): for each query (id, v) about the k nearest rows by cosine, ties by id. Queries are taken in blocks, each in one pass
        over the cells that any of them asks."""
        out, held = None, []
        for row in queries.select("id", F.col("v").cast("array<double>").alias("v")).toLocalIterator():
            held.append(row)
            if len(held) == block:
                out, held = self._union(out, self._found(held, queries, k, probes, rescore)), []
        if held or out is None:
            out = self._union(out, self._found(held, queries, k, probes, rescore))
        return out

    @staticmethod
    def _union(a: DataFrame | None, b: DataFrame) -> DataFrame:
        return b if a is None else a.unionByName(b)

    def _found(self, held: list, queries: DataFrame, k: int, probes: int, rescore: int) -> DataFrame:
        coder, size = self.coder, self.coder.cells.shape[1]
        if not held:
            kinds = (f.schema["id"].dataType.simpleString() for f in (queries, self.rows))
            return self.spark.createDataFrame([], "query {}, id {}, score double, rank int".format(*kinds))
        q = unit_matrix(pa.array([r["v"] for r in held], pa.list_(pa.float64())), size)
        asks, tables, centres = coder.probed(q, probes), coder.tables(q).astype(np.float32), (q @ coder.cells.T).astype(np.float32)
        kind, parts = self.rows.schema["id"].dataType.simpleString(), len(coder.books)
        labels = self.spark.createDataFrame([(i, r["id"], q[i].tolist()) for i, r in enumerate(held)], f"n int, query {queries.schema['id'].dataType.simpleString()}, q array<double>")

        def run(of: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, best = [], [(np.zeros(0, np.float32), np.zeros(0, np.int64), np.zeros(0, np.int32)) for _ in held]
            seen = 0
            for batch in of:
                cell = batch.column("cell").to_numpy()
                codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(len(cell), parts)
                ids.append(batch.column("id"))
                for c in np.unique(cell):
                    at = np.flatnonzero(cell == c)
                    for i in np.flatnonzero(asks[:, c]):
                        score = centres[i, c] + tables[i][np.arange(parts), codes[at]].sum(1)
                        if len(at) > rescore:
                            top = np.argpartition(-score, rescore - 1)[:rescore]
                            score, own = score[top], at[top]
                        else:
                            own = at
                        score, own, of_cell = (np.concatenate(x) for x in zip(best[i], (score, own + seen, np.full(len(own), c, np.int32)), strict=True))
                        if len(score) > 4 * rescore:
                            top = np.argpartition(-score, rescore - 1)[:rescore]
                            score, own, of_cell = score[top], own[top], of_cell[top]
                        best[i] = score, own, of_cell
                seen += len(cell)
            whole = pa.chunked_array(ids) if ids else pa.chunked_array([], type=pa.null())
            for i, (score, own, of_cell) in enumerate(best):
                if len(own):
                    top = np.argsort(-score, kind="stable")[:rescore]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(top), i, np.int32)), whole.take(pa.array(own[top])).combine_chunks(), pa.array(of_cell[top]), pa.array(score[top].astype(float))], names=["n", "id", "cell", "score"])

        cells = np.flatnonzero(asks.any(0)).tolist()
        rows = self.rows.where(F.col("cell").isin(cells))
        near = rows.select("id", "cell", "codes").mapInArrow(run, f"n int, id {kind}, cell int, score double")
        few = cut(top_k(near, ["n"], rescore, ["id"]).select("n", "id", "cell"), "candidates")
        # block * rescore rows at most, whatever the number of vectors
        exact = rows.select("id", "cell", "v").join(F.broadcast(few.join(labels, "n")), ["id", "cell"])
        score = F.aggregate(F.zip_with("v", "q", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        scored = exact.select("query", "id", F.round(score, 6).alias("score"))
        return top_k(scored, ["query"], k, ["id"]).select("query", "id", "score", "rank")

    def share(self, queries: DataFrame, probes: int) -> float:
        """The part of all pairs of rows and queries whose codes a search compares."""
        sizes = dict(self.rows.groupBy("cell").count().collect())
        total = pairs = 0
        for row in queries.select(F.col("v").cast("array<double>").alias("v")).toLocalIterator():
            asked = self.coder.probed(unit_matrix(pa.array([row["v"]], pa.list_(pa.float64())), self.coder.cells.shape[1]), probes)[0]
            pairs += sum(sizes.get(int(c), 0) for c in np.flatnonzero(asked))
            total += sum(sizes.values())
        return pairs / total if total else 0.0


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The part of the exact answer (query, id) that was found."""
    row = exact.select("query", "id").join(found.select("query", "id", F.lit(1).alias("hit")), ["query", "id"], "left").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("r")).first()
    return row["r"]
