"""A kept keyword index of documents with weighted fields: BM25F over posting blocks with maximal impacts.

A segment has a posting block for each term and bucket of documents: their ids, frequencies and lengths by field, and of these the largest frequencies and
least lengths. Buckets hold documents of about the same length that one task read, at most `bucket_rows` of them, so that no term, however common, makes a large row. A
search bounds what a bucket can give a query by the blocks' heads alone, scores the most promising bucket of each query, and then only buckets whose bound
reaches the k-th best score found so far: the answer is exact. Files are parted by a hash of the term; only those of the queries' terms are read.
Segments are added without touching others, and can be merged. Ids are not null, and are added once.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import TOKEN, query_tokens
from docloom.operators import ingest
from docloom.operators.search import _order, top_k
from docloom.operators.search import blocks as packed
from docloom.shared import cut

SMALL = 200_000
QUERY_BLOCK = 256
#: Of one bucket; four times as many are held by a task.
MOST_POSTINGS = 500_000


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SMALL else df


class TextIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        said = json.loads(spark.read.text(f"{path}/fields.json").first()["value"])
        self.fields, self.parts, self.bucket_rows = said["fields"], said["parts"], said["bucket_rows"]

    @classmethod
    def create(cls, spark: SparkSession, path: str, fields: list[str], parts: int = 64, bucket_rows: int = 1024) -> TextIndex:
        said = json.dumps({"fields": fields, "parts": parts, "bucket_rows": bucket_rows})
        spark.createDataFrame([(said,)], "value string").coalesce(1).write.text(f"{path}/fields.json")
        return cls(spark, path)

    def add(self, rows: DataFrame) -> TextIndex:
        """Adds a segment of rows (id, and the fields). Terms are counted and blocks made where the text is; nothing is shuffled."""
        folder = f"{self.path}/segment-{uuid.uuid4().hex}"
        kind, n, most_rows = rows.schema["id"].dataType.simpleString(), len(self.fields), self.bucket_rows

        def make(of: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pattern, open_ = re.compile(TOKEN), {}
            for batch in of:
                for i in range(len(batch)):
                    said = [pattern.findall(batch.column(f"t{f}")[i].as_py() or "") for f in range(n)]
                    size = ((1 + sum(map(len, said))) ** 2).bit_length()
                    bucket = open_.setdefault(size, Bucket(n))
                    bucket.add(batch.column("id")[i].as_py(), said)
                    if len(bucket.ids) >= most_rows or bucket.held >= MOST_POSTINGS:
                        yield open_.pop(size).blocks(batch.schema.field("id").type)
                    if sum(b.held for b in open_.values()) >= 4 * MOST_POSTINGS:
                        fullest = max(open_, key=lambda s: open_[s].held)
                        yield open_.pop(fullest).blocks(batch.schema.field("id").type)
            for bucket in open_.values():
                yield bucket.blocks(batch.schema.field("id").type)

        texts = rows.select("id", *[F.lower(f).alias(f"t{i}") for i, f in enumerate(self.fields)])
        made = texts.mapInArrow(make, f"term string, bucket string, n int, most array<int>, least array<int>, ids array<{kind}>, tf array<int>, lens array<int>")
        # the row of a bucket without a term lists all of its documents
        part = F.when(F.col("term").isNull(), -1).otherwise(F.pmod(F.xxhash64("term"), F.lit(self.parts))).cast("int")
        made.withColumn("part", part).sortWithinPartitions("part", "term").write.partitionBy("part").parquet(f"{folder}/postings")

        def length(f: int) -> Column:
            own = F.aggregate(F.filter("lens", lambda _, j: j % n == f), F.lit(0).cast("bigint"), lambda s, x: s + x)
            return F.coalesce(F.sum(own), F.lit(0))

        total = self._read(folder).where("part = -1").agg(F.coalesce(F.sum("n"), F.lit(0)), *map(length, range(n))).first()
        ingest.append(self.spark, self.path, {"path": folder, "docs": total[0], "lens": list(total)[1:]})
        return self

    def _read(self, folder: str) -> DataFrame:
        return self.spark.read.parquet(f"{folder}/postings")

    def merge(self) -> TextIndex:
        """Makes one segment of all. Searches that run meanwhile read the old ones."""
        version = ingest.current(self.spark, self.path)
        if len(version.folders) > 1:
            folder = f"{self.path}/segment-{uuid.uuid4().hex}"
            self._postings(version).repartition("part", "term").sortWithinPartitions("part", "term").write.partitionBy("part").parquet(f"{folder}/postings")
            whole = {"path": folder, "docs": sum(f["docs"] for f in version.folders), "lens": [sum(x) for x in zip(*[f["lens"] for f in version.folders], strict=True)]}
            if not ingest._publish(self.spark, self.path, ingest.Version(version.number + 1, [whole])):
                raise RuntimeError("a segment was added meanwhile; merge again")
        return self

    def _postings(self, version: ingest.Version) -> DataFrame:
        return reduce(DataFrame.unionByName, [self._read(f["path"]) for f in version.folders])

    def search(self, queries: DataFrame, k: int, weights: list[float] | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """(query, id, score, rank): the k best documents for each query (id, text) by any of its tokens, exactly; ties by id."""
        version = ingest.current(self.spark, self.path)
        weights = weights or [1.0] * len(self.fields)
        docs = sum(f["docs"] for f in version.folders)
        average = [sum(f["lens"][i] for f in version.folders) / docs or 1.0 if docs else 1.0 for i in range(len(self.fields))]

        def impact(tf: Column, lens: Column) -> Column:
            parts = [F.lit(w) * tf[i] / (1 - b + b * lens[i] / a) for i, (w, a) in enumerate(zip(weights, average, strict=True))]
            said = reduce(lambda x, y: x + y, parts)
            return said / (said + k1)

        asked = cut(queries.select(F.col("id").alias("query"), F.explode(query_tokens(F.col("text"))).alias("term")), "asked")
        terms = cut(asked.select("term").distinct(), "terms")
        n_terms = terms.count()
        used = [r["part"] for r in terms.select(F.pmod(F.xxhash64("term"), F.lit(self.parts)).cast("int").alias("part")).distinct().collect()]
        if not version.folders or not n_terms:
            kind = {f: queries.schema["id"].dataType.simpleString() for f in ("query", "id")}
            return self.spark.createDataFrame([], f"query {kind['query']}, id {kind['id']}, score double, rank int")
        blocks = self._postings(version).where(F.col("part").isin(used)).join(_small(terms, n_terms), "term", "left_semi")
        heads = cut(blocks.select("term", "bucket", "n", impact(F.col("most"), F.col("least")).alias("most")), "heads")
        df = heads.groupBy("term").agg(F.sum("n").alias("df"))
        idf = F.log(1 + (docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weighed = asked.join(_small(df.select("term", idf.alias("idf")), n_terms), "term").groupBy("query").agg(F.collect_list(F.struct("term", "idf")).alias("terms"))
        q = cut(packed(weighed.select(F.col("query").alias("id"), "terms"), QUERY_BLOCK).withColumn("block", F.monotonically_increasing_id()), "weighed")
        asks = F.broadcast(q.toDF("q_id", "q_terms", "block"))
        query, id = q.schema["id"].dataType.elementType.simpleString(), blocks.schema["ids"].dataType.elementType.simpleString()

        def bound(of: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in of:
                for r in batch.to_struct_array():
                    owner, code, idf, names = _asked(r)
                    most, n = np.zeros(len(names) + 1), np.zeros(len(names) + 1, np.int64)
                    held = r["held"].values
                    at = _codes(names, held.field("term"))
                    most[at], n[at] = held.field("most").to_numpy(), held.field("n").to_numpy()
                    bounds, longest = np.bincount(owner, idf * most[code], len(r["q_id"])), np.zeros(len(r["q_id"]), np.int64)
                    np.maximum.at(longest, owner, n[code])
                    some = np.flatnonzero(longest)
                    yield pa.RecordBatch.from_arrays([r["q_id"].values.take(pa.array(some)), pa.array([r["bucket"].as_py()] * len(some), pa.string()), pa.array([r["block"].as_py()] * len(some), pa.int64()), pa.array(bounds[some]), pa.array(longest[some])], names=["query", "bucket", "block", "bound", "n"])

        by_bucket = heads.groupBy("bucket").agg(F.collect_list(F.struct("term", F.col("n").cast("bigint").alias("n"), "most")).alias("held"))
        bounds = cut(by_bucket.crossJoin(asks).mapInArrow(bound, f"query {query}, bucket string, block bigint, bound double, n bigint"), "bounds")

        def score(of: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in of:
                for r in batch.to_struct_array():
                    owner, code, idf, names = _asked(r)
                    held = r["held"].values
                    sizes = held.field("ids").value_lengths().to_numpy()
                    flat, where = np.unique(np.asarray(_codes(names, held.field("term"))).repeat(sizes), return_inverse=True)
                    ids = held.field("ids").flatten()
                    own = pc.unique(ids)
                    own = own.take(pa.array(_order(own)))
                    places = pc.index_in(ids, value_set=own).to_numpy()
                    tf, lens = (held.field(c).flatten().to_numpy().reshape(-1, len(weights)) for c in ("tf", "lens"))
                    said = (np.asarray(weights) * tf / (1 - b + b * lens / np.asarray(average))).sum(axis=1)
                    part = np.zeros((len(flat), len(own)))
                    part[where, places] = said / (said + k1)
                    # only the queries that chose this bucket
                    chosen = pc.index_in(r["chosen"].values, value_set=r["q_id"].values).to_numpy()
                    to = np.full(len(r["q_id"]), -1)
                    to[chosen] = np.arange(len(chosen))
                    column = np.full(len(names) + 1, -1)
                    column[flat] = np.arange(len(flat))
                    some = (to[owner] >= 0) & (column[code] >= 0)
                    weight = np.zeros((len(chosen), len(flat)))
                    weight[to[owner[some]], column[code[some]]] = idf[some]
                    scores = np.round(weight @ part, 6)
                    # a document is found by a term, though its idf may be near 0
                    scores[~((weight != 0).astype(np.float32) @ (part != 0).astype(np.float32) > 0)] = -np.inf
                    best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                    found = np.take_along_axis(scores, best, 1).ravel()
                    keep = np.isfinite(found)
                    query = np.repeat(np.arange(len(chosen)), best.shape[1])[keep]
                    yield pa.RecordBatch.from_arrays([r["chosen"].values.take(pa.array(query)), own.take(pa.array(best.ravel()[keep])), pa.array(found[keep])], names=["query", "id", "score"])

        def scored(chosen: DataFrame) -> DataFrame:
            """The documents of these buckets (query, bucket, block): all terms of a bucket meet a block of queries, as a product of matrices."""
            wanted = chosen.groupBy("bucket", "block").agg(F.collect_list("query").alias("chosen"))
            of = blocks.join(wanted.select("bucket").distinct(), "bucket", "left_semi")
            held = of.groupBy("bucket").agg(F.collect_list(F.struct("term", "ids", "tf", "lens")).alias("held"))
            return top_k(held.join(wanted, "bucket").join(asks, "block").mapInArrow(score, f"query {query}, id {id}, score double"), ["query"], k, ["id"]).drop("rank")

        # the first bucket of each query has k documents, if any has: its k-th best score is one that the others must reach
        first = top_k(bounds.select("query", "bucket", "block", ((F.col("n") >= k).cast("int") * 1e6 + F.col("bound")).alias("score")), ["query"], 1, ["bucket"]).select("query", "bucket", "block")
        first = cut(first, "first")
        found = cut(scored(first), "found")
        limit = found.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).select("query", "least")
        rest = bounds.join(limit, "query", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - 1e-5)).select("query", "bucket", "block")
        rest = cut(rest.join(first, ["query", "bucket"], "left_anti"), "rest")
        self.read_share = (rest.count() + first.count()) / max(bounds.count(), 1)
        return top_k(found.unionByName(scored(rest)), ["query"], k, ["id"]).select("query", "id", "score", "rank")


def _asked(r: pa.StructScalar) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Of a block of queries: whose each term is, the term's number, its weight; and the names of the numbers."""
    lists = r["q_terms"].values
    terms = lists.flatten()
    named = terms.field("term").dictionary_encode()
    return np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()), named.indices.to_numpy(), terms.field("idf").to_numpy(), named.dictionary


def _codes(names: pa.Array, terms: pa.Array) -> np.ndarray:
    """The numbers of terms; of those that no query of the block has, that of one more, which none asks for."""
    return pc.fill_null(pc.index_in(terms, value_set=names), len(names)).to_numpy()


class Numbers(dict):
    """Terms, numbered as they come."""

    def __missing__(self, term: str) -> int:
        self[term] = n = len(self)
        return n


class Bucket:
    """Documents of about the same length, as they are read."""

    def __init__(self, fields: int):
        self.fields, self.ids, self.lens, self.codes, self.cells, self.held = fields, [], [], Numbers(), [], 0

    def add(self, id, said: list[list[str]]) -> None:
        for f, words in enumerate(said):
            code, count = np.unique(np.fromiter(map(self.codes.__getitem__, words), np.int64, len(words)), return_counts=True)
            self.cells.append((np.full(len(code), len(self.ids)), code, np.full(len(code), f), count))
            self.held += len(code)
        self.ids.append(id)
        self.lens.append([len(w) for w in said])

    def blocks(self, kind: pa.DataType) -> pa.RecordBatch:
        """A row for each term, and one without a term for all documents."""
        doc, code, field, count = (np.concatenate(x) for x in zip(*self.cells, strict=True))
        key, at = np.unique(code * len(self.ids) + doc, return_inverse=True)
        tf = np.zeros((len(key), self.fields), np.int32)
        tf[at, field] = count
        code, doc = np.divmod(key, len(self.ids))
        size = np.bincount(code, minlength=len(self.codes))
        lens = np.array(self.lens, np.int32)
        # the row without a term comes last
        starts, n = np.cumsum(size) - size, len(self.ids)
        some = len(size) > 0
        most = np.vstack([np.maximum.reduceat(tf, starts) if some else tf[:0], np.zeros((1, self.fields), np.int32)])
        least = np.vstack([np.minimum.reduceat(lens[doc], starts) if some else lens[:0], lens.min(axis=0, keepdims=True)])
        doc, tf, size = np.append(doc, np.arange(n)), np.vstack([tf, np.zeros((n, self.fields), np.int32)]), np.append(size, n)
        edges = np.append(0, np.cumsum(size))
        flat, even = pa.array(edges * self.fields, pa.int32()), pa.array(np.arange(len(size) + 1) * self.fields, pa.int32())
        of = lambda offsets, x: pa.ListArray.from_arrays(offsets, pa.array(x.ravel(), pa.int32()))
        ids = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(self.ids, kind).take(pa.array(doc)))
        columns = [pa.array([*self.codes, None], pa.string()), pa.array([uuid.uuid4().hex] * len(size)), pa.array(size, pa.int32()), of(even, most), of(even, least), ids, of(flat, tf), of(flat, lens[doc])]
        return pa.RecordBatch.from_arrays(columns, names=["term", "bucket", "n", "most", "least", "ids", "tf", "lens"])
