"""Search over chunks: predicates, vector and keyword legs, fusion."""

from __future__ import annotations

import functools
import operator
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import vectors
from docloom.functions.batches import best as first_of
from docloom.functions.text import TOKEN, first_sentences, query_tokens, tokens
from docloom.shared import cut

#: Of the largest matrix of rows and terms.
CELLS = 2_000_000


def where(rows: DataFrame, **conditions) -> DataFrame:
    """rows for which all hold: source=v; tags=[...] (any, in either case); metadata={path: v} and metadata_not={path: v} (a path that is
    not there differs); column_in={column: [...]}; column_like={column: pattern}."""
    tests: list[Column] = []
    for kind, value in conditions.items():
        if kind == "source":
            tests.append(F.col("source") == value)
        elif kind == "tags":
            tests.append(F.arrays_overlap(F.transform("tags", F.lower), F.array(*[F.lit(t.lower()) for t in value])))
        elif kind == "metadata":
            tests += [F.get_json_object("metadata", f"$.{path}") == str(v) for path, v in value.items()]
        elif kind == "metadata_not":
            tests += [~F.get_json_object("metadata", f"$.{path}").eqNullSafe(str(v)) for path, v in value.items()]
        elif kind == "column_in":
            tests += [F.col(c).isin(list(v)) for c, v in value.items()]
        elif kind == "column_like":
            tests += [F.col(c).like(v) for c, v in value.items()]
        else:
            raise ValueError(f"no such condition: {kind}")
    return rows.where(functools.reduce(operator.and_, tests)) if tests else rows


def confident(rows: DataFrame, floor: float, keep_null: bool = True) -> DataFrame:
    """Rows of a confidence of the floor or more; those without one stay, unless keep_null is False and the floor above 0."""
    known = F.col("confidence") >= floor
    return rows.where(F.col("confidence").isNull() | known) if keep_null or floor <= 0 else rows.where(F.coalesce(F.col("confidence"), F.lit(0.0)) >= floor)


def semantic_search(rows: DataFrame, query: list[float], k: int, metric: str = "cosine", keys: tuple[str, ...] = ("doc_id", "seq_num"), embedding: str = "embedding") -> DataFrame:
    """The k rows nearest to the query, exactly; ties by key."""
    scored = rows.withColumn("score", F.round(vectors.score(metric, F.col(embedding), F.array(*[F.lit(float(x)) for x in query])), 6))
    return scored.orderBy(F.desc("score"), *keys).limit(k)


def _named(found: DataFrame, row_key: list[str], query_key: str) -> DataFrame:
    return found.select(F.col("query").alias(query_key), *[F.col(f"id.{c}").alias(c) for c in row_key], "score", "rank")


def semantic_join(
    rows: DataFrame,
    queries: DataFrame,
    k: int,
    row_key: list[str],
    query_key: str,
    row_text: str,
    query_text: str,
    dimensions: int = 64,
    unique: bool = False,
) -> DataFrame:
    """For each query, its k best rows by cosine of hashed vectors (query_key, row_key, score, rank). Vectors are made once for each
    text, and blocks of them are compared with blocks of the queries'. unique: row_key doesn't repeat, so no vector is shuffled."""
    a = vectors.hashed_vectors(rows, row_key, row_text, dimensions, unique).select(F.struct(*row_key).alias("id"), F.col("embedding").alias("v"))
    q = vectors.hashed_vectors(queries, [query_key], query_text, dimensions).select(F.col(query_key).alias("id"), F.col("embedding").alias("v"))
    return _named(nearest(a, q, k, sharing=True), row_key, query_key)


def top_k(scored: DataFrame, by: list[str], k: int, keys: list[str]) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), *keys))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


class Postings:
    """The keyword index of a table of texts: term frequencies, lengths, document frequencies. Made of texts, or kept by write() and
    opened by read(); a kept index is laid out by term, so that a search reads the files of its terms only. unique: keys don't repeat, so
    that a search counts the terms of a text where it is; else texts of equal keys are shuffled, to count as one."""

    def __init__(self, rows: DataFrame | None, keys: list[str], text: str | None, kept: str | None = None, unique: bool = False):
        self.keys, self.rows, self.text, self.kept, self.unique = keys, rows, text, kept, unique

    @property
    def tf(self) -> DataFrame:
        if self.kept:
            return self.rows.sparkSession.read.parquet(f"{self.kept}/terms").select(*self.keys, "term", "tf")
        term = self.rows.select(*self.keys, F.explode(tokens(F.col(self.text))).alias("term"))
        return term.groupBy(*self.keys, "term").agg(F.count("*").alias("tf"))

    @property
    def lengths(self) -> DataFrame:
        if self.kept:
            return self.rows.sparkSession.read.parquet(f"{self.kept}/lengths")
        return self.rows.select(*self.keys, F.coalesce(F.size(tokens(F.col(self.text))), F.lit(0)).alias("len"))

    def write(self, path: str, parts: int = 64) -> Postings:
        """Keeps the index in a folder. Files are parted by a hash of the term."""
        part = F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int")
        self.tf.withColumn("part", part).repartition("part").sortWithinPartitions("term").write.partitionBy("part").parquet(f"{path}/terms")
        self.lengths.write.parquet(f"{path}/lengths")
        self.rows.sparkSession.createDataFrame([(parts,)], "parts int").write.parquet(f"{path}/layout")
        return Postings(self.rows, self.keys, self.text, path)

    @classmethod
    def read(cls, spark: SparkSession, path: str, keys: list[str]) -> Postings:
        return cls(spark.range(0), keys, None, path)

    def _wanted(self, queries: DataFrame, query_key: str, query_text: str) -> tuple[DataFrame, DataFrame]:
        """The queries' terms (query, term), and (keys, len, terms) of each row: its length and its terms that queries have."""
        q = cut(queries.select(F.col(query_key).alias("query"), F.explode(query_tokens(F.col(query_text))).alias("term")), "terms")
        terms = cut(q.select("term").distinct(), "wanted")
        n = terms.count()
        if self.unique and not self.kept and n <= 100_000:
            return q, cut(self._counted(terms), "postings")
        known = terms.select("term", F.lit(True).alias("known"))
        known = F.broadcast(known) if n <= 1_000_000 else known
        if self.kept:
            of = self.rows.sparkSession.read.parquet(f"{self.kept}/layout").first()["parts"]
            parts = [r["part"] for r in terms.select(F.pmod(F.xxhash64("term"), F.lit(of)).cast("int").alias("part")).distinct().collect()]
            tf = self.rows.sparkSession.read.parquet(f"{self.kept}/terms").where(F.col("part").isin(parts)).join(known, "term", "left_semi")
            listed = tf.groupBy(*self.keys).agg(F.collect_list(F.struct("term", "tf")).alias("terms"))
            return q, cut(self.lengths.withColumn("len", F.col("len").cast("bigint")).join(listed, self.keys, "left"), "postings")
        # one pass over the texts: what no query asks for counts for the length only
        term = self.rows.select(*self.keys, F.explode_outer(tokens(F.col(self.text))).alias("t"))
        marked = term.join(known.withColumnRenamed("term", "t"), "t", "left").select(*self.keys, "t", F.when(F.col("known"), F.col("t")).alias("term"))
        tf = marked.groupBy(*self.keys, "term").agg(F.count("t").alias("tf"))
        listed = F.collect_list(F.when(F.col("term").isNotNull(), F.struct("term", "tf")))  # nulls are left out
        return q, cut(tf.groupBy(*self.keys).agg(F.sum("tf").alias("len"), listed.alias("terms")), "postings")

    def _counted(self, terms: DataFrame) -> DataFrame:
        """(keys, len, terms) of each row, where it is: nothing is shuffled. The queries' terms are sent to all tasks."""
        wanted, keys = self.rows.sparkSession.sparkContext.broadcast([r["term"] for r in terms.collect()]), self.keys

        def count(of: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            code, names, token = {t: i for i, t in enumerate(wanted.value)}, pa.array(wanted.value, pa.string()), re.compile(TOKEN)
            for batch in of:
                sizes, edges, term, tf = [], [0], [], []
                for text in batch.column("_text"):
                    found = token.findall(text.as_py() or "")
                    times = Counter(map(code.get, found))
                    times.pop(None, None)
                    sizes.append(len(found))
                    term += times.keys()
                    tf += times.values()
                    edges.append(len(term))
                each = pa.StructArray.from_arrays([names.take(pa.array(term, pa.int32())), pa.array(tf, pa.int64())], names=["term", "tf"])
                lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), each)
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], pa.array(sizes, pa.int64()), lists], names=[*keys, "len", "terms"])

        texts = self.rows.select(*keys, F.lower(self.text).alias("_text"))
        return texts.mapInArrow(count, f"{vectors.kinds(self.rows, keys)}, len bigint, terms array<struct<term: string, tf: bigint>>")

    def top(self, queries: DataFrame, query_key: str, query_text: str, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """(query_key, keys, score, rank): the k best rows of each query by BM25 of any of its tokens. Blocks of rows meet blocks of queries,
        so a term that most rows have makes no pairs of rows and queries."""
        q, rows = self._wanted(queries, query_key, query_text)
        total = rows.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len")).first()
        average = float(total["avg_len"] or 1)
        df = rows.select(F.explode("terms").alias("x")).groupBy(F.col("x.term").alias("term")).agg(F.count("*").alias("df"))
        idf = F.log(1 + (F.lit(total["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        each = F.collect_list(F.struct("term", idf.alias("idf"))).alias("terms")
        asked = q.join(df, "term").groupBy(F.col("query").alias("id")).agg(each)

        def bm25(x: dict, y: dict) -> np.ndarray:
            term, owner, code = _terms_of(y["terms"])
            weight = np.zeros((len(y["id"]), len(term)))
            weight[owner, code] = y["terms"].flatten().field("idf").to_numpy(zero_copy_only=False)
            scores = np.zeros((len(y["id"]), len(x["id"])))
            # so many rows at a time that their matrix stays small
            step = max(1, CELLS // max(1, len(term)))
            for at in range(0, len(x["id"]), step):
                lists = x["terms"].slice(at, step)
                row, column, held = _cells_of(lists, term)
                tf = held.field("tf").to_numpy(zero_copy_only=False)
                size = x["len"].slice(at, step).to_numpy(zero_copy_only=False)[row]
                part = np.zeros((len(lists), len(term)))
                part[row, column] = tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / average))
                scores[:, at : at + step] = weight @ part.T
            return np.where(scores > 0, scores, -np.inf)

        a = blocks(rows.where("size(terms) > 0").select(F.struct(*self.keys).alias("id"), "len", "terms"), 1024)
        found = _best_of_blocks(a, cut(blocks(asked, 256), "queries"), bm25, k)
        return _named(found, self.keys, query_key)

    def search(self, queries: DataFrame, query_key: str, query_text: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """(query_key, keys, score): BM25 of all rows with any of the query's tokens. Only terms that queries have are joined; document
        frequencies come from these postings."""
        q = queries.select(query_key, F.explode(query_tokens(F.col(query_text))).alias("term"))
        wanted = self.tf.join(q.select("term").distinct(), "term", "left_semi")
        df = wanted.groupBy("term").agg(F.count("*").alias("df"))
        total = self.lengths.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
        hits = wanted.join(df, "term").join(self.lengths, self.keys).crossJoin(F.broadcast(total)).join(q, "term")
        idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
        return hits.groupBy(query_key, *self.keys).agg(F.round(F.sum(part), 6).alias("score"))

    def match(self, queries: DataFrame, query_key: str, query_text: str) -> DataFrame:
        """The degraded mode: 1.0 for each text with any of the query's tokens. Blocks of rows meet blocks of queries, so that each text is
        told once for a query, and its tokens are not shuffled."""
        q, rows = self._wanted(queries, query_key, query_text)
        asked = q.groupBy(F.col("query").alias("q_id")).agg(F.collect_list(F.struct("term")).alias("q_terms"))
        a = blocks(rows.where("size(terms) > 0").select(F.struct(*self.keys).alias("id"), "terms"), 1024)
        kinds = asked.schema["q_id"].dataType.simpleString(), a.schema["id"].dataType.elementType.simpleString()

        def meet(of: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in of:
                for r in batch.to_struct_array():
                    term, owner, code = _terms_of(r["q_terms"].values)
                    wanted = np.zeros((len(r["q_id"]), len(term)), np.float32)
                    wanted[owner, code] = 1
                    step = max(1, CELLS // max(1, len(term)))
                    for at in range(0, len(r["id"]), step):
                        lists = r["terms"].values.slice(at, step)
                        row, column, _ = _cells_of(lists, term)
                        part = np.zeros((len(lists), len(term)), np.float32)
                        part[row, column] = 1
                        query, row = np.nonzero(wanted @ part.T)
                        yield pa.RecordBatch.from_arrays([r["q_id"].values.take(pa.array(query)), r["id"].values.take(pa.array(row + at))], names=["query", "id"])

        found = a.crossJoin(F.broadcast(cut(blocks(asked, 256), "queries"))).mapInArrow(meet, f"query {kinds[0]}, id {kinds[1]}")
        return found.select(F.col("query").alias(query_key), *[F.col(f"id.{c}").alias(c) for c in self.keys], F.lit(1.0).alias("score"))


def fuse_rrf(legs: dict[str, DataFrame], by: list[str], keys: list[str], rrf_k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of legs (by, keys, score); adds up 1 / (rrf_k + rank)."""
    if rrf_k < 1:
        raise ValueError("rrf_k must be 1 or more")
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), *keys))
    ranked = [df.select(*by, *keys, F.lit(name).alias("leg"), (1 / (rrf_k + rank)).alias("part")) for name, df in legs.items()]
    return functools.reduce(DataFrame.unionByName, ranked).groupBy(*by, *keys).agg(F.round(F.sum("part"), 9).alias("score"), F.array_join(F.sort_array(F.collect_set("leg")), ",").alias("legs"))


def fuse_weighted(legs: dict[str, DataFrame], by: list[str], keys: list[str], weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted sum of scores brought to 0..1 within each leg; where all are equal they count 1."""
    w = W.partitionBy(*by)
    low, high = F.min("score").over(w), F.max("score").over(w)
    scaled = [df.select(*by, *keys, F.lit(name).alias("leg"), (F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(1.0) * (weights or {}).get(name, 1.0)).alias("part")) for name, df in legs.items()]
    return functools.reduce(DataFrame.unionByName, scaled).groupBy(*by, *keys).agg(F.round(F.sum("part"), 6).alias("score"), F.array_join(F.sort_array(F.collect_set("leg")), ",").alias("legs"))


def hybrid_search(rows: DataFrame, queries: DataFrame, k: int, row_key: list[str], query_key: str, row_text: str, query_text: str, fusion: str = "rrf", candidate_multiplier: int = 3, unique: bool = False, **how) -> DataFrame:
    """The k best rows for each query by both legs, each of which brings candidate_multiplier times k. rows should be cheap to read twice.
    unique: row_key doesn't repeat."""
    n = max(candidate_multiplier * k, k)
    legs = {
        "keyword": Postings(rows, row_key, row_text, unique=unique).top(queries, query_key, query_text, n).drop("rank"),
        "semantic": semantic_join(rows, queries, n, row_key, query_key, row_text, query_text, unique=unique).drop("rank"),
    }
    if fusion not in ("rrf", "weighted"):
        raise ValueError(f"no such fusion: {fusion}")
    fused = (fuse_rrf if fusion == "rrf" else fuse_weighted)(legs, [query_key], row_key, **how)
    return top_k(fused, [query_key], k, row_key)


def fact_search(
    facts: DataFrame,
    chunks: DataFrame,
    queries: DataFrame,
    k: int,
    fact_key: list[str],
    query_key: str,
    query_text: str,
    floor: float = 0.0,
    summary_length: int | None = None,
    unique: bool = False,
) -> DataFrame:
    """The k best facts (doc_id, fact_key, fact, source_chunk_seq, confidence) for each query by hybrid search, without those of a
    confidence below the floor, each with its source chunk (doc_id, seq_num, original_content), if there is one, and its summary."""
    # few: as tables they are known to be small, so that facts and chunks are not shuffled to meet them
    hits = cut(hybrid_search(facts, queries, k, fact_key, query_key, "fact", query_text, unique=unique).drop("legs"), "hits")
    found = cut(confident(hits.join(facts, fact_key), floor), "found")
    source = chunks.select(F.col("doc_id").alias("_doc"), F.col("seq_num").alias("chunk_seq"), F.col("original_content").alias("chunk_text"))
    out = found.join(source, (F.col("doc_id") == F.col("_doc")) & (F.col("source_chunk_seq") == F.col("chunk_seq")), "left").drop("_doc")
    return out.withColumn("summary", first_sentences(F.col("chunk_text"), summary_length)) if summary_length else out


def summarize_hits(hits: DataFrame, by: list[str], text: str, n: int = 3) -> DataFrame:
    """One row per query: the first n sentences of each of its hits, in rank order, and how much shorter that is."""
    from docloom.functions.text import sentences

    short = F.array_join(F.slice(sentences(F.col(text)), 1, n), " ")
    parts = F.sort_array(F.collect_list(F.struct("rank", short.alias("s"), F.length(text).cast("bigint").alias("n"))))
    out = hits.groupBy(*by).agg(parts.alias("p"))
    return out.select(*by, F.array_join(F.transform("p", lambda x: x["s"]), "\n\n").alias("summary"), F.aggregate("p", F.lit(0).cast("bigint"), lambda s, x: s + x["n"]).alias("chars_before"))


def blocks(rows: DataFrame, most: int, units: str = "") -> DataFrame:
    """Up to so many rows in one: a list for each column. units: a column of vectors that becomes the bytes of a matrix of unit vectors."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def pack(of: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            whole = pa.Table.from_batches(waiting).combine_chunks()
            edges = pa.array([0, whole.num_rows], pa.int32())
            columns = [c.chunk(0) if c.num_chunks == 1 else c.combine_chunks() for c in whole.columns]
            return pa.RecordBatch.from_arrays([pa.array([_matrix(c).tobytes()], pa.binary()) if n == units else pa.ListArray.from_arrays(edges, c) for n, c in zip(kinds, columns, strict=True)], names=list(kinds))

        for whole in of:
            while len(whole):
                room = most - sum(len(b) for b in waiting)
                waiting.append(whole.slice(0, room))
                whole = whole.slice(room)
                if sum(len(b) for b in waiting) == most:
                    yield block()
                    waiting.clear()
        if waiting:
            yield block()

    return rows.mapInArrow(pack, ", ".join(f"`{c}` binary" if c == units else f"`{c}` array<{kind}>" for c, kind in kinds.items()))


def _terms_of(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct terms of lists of structs with a term; whose each term is, and which it is."""
    named = lists.flatten().field("term").dictionary_encode()
    return named.dictionary, _owners(lists), named.indices.to_numpy()


def _cells_of(lists: pa.ListArray, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.StructArray]:
    """Row and column of those of the lists' terms that are among these, and what the lists say of them."""
    held = lists.flatten()
    at = pc.index_in(held.field("term"), value_set=terms)
    some = at.is_valid()
    return _owners(lists)[some.to_numpy(zero_copy_only=False)], at.drop_null().to_numpy(), held.filter(some)


def _owners(lists: pa.ListArray) -> np.ndarray:
    return np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())


def _order(ids: pa.Array) -> np.ndarray:
    """Row numbers in the order of ids, which may be of several columns."""
    if not pa.types.is_struct(ids.type):
        return np.asarray(pc.sort_indices(ids))
    parts = ids.flatten()
    names = [str(i) for i in range(len(parts))]
    return np.asarray(pc.sort_indices(pa.Table.from_arrays(parts, names), sort_keys=[(n, "ascending") for n in names]))


def _best_of_blocks(a: DataFrame, q: DataFrame, score: Callable[[dict, dict], np.ndarray], k: int) -> DataFrame:
    """(query, id, score, rank) of the k best rows for each query, ties by id. Blocks of rows (id and more) meet blocks of queries (id and
    more), the queries' being a table; each meeting passes on the k best of each query. score: queries by rows, minus infinity for
    no hit."""
    kind, asked = (x.schema["id"].dataType.elementType.simpleString() for x in (a, q))
    own, theirs = a.columns, [f"q_{c}" for c in q.columns]

    def meet(of: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in of:
            for r in range(len(batch)):
                x = {c: batch.column(c)[r].values for c in own}
                y = {c[2:]: batch.column(c)[r].values for c in theirs}
                scores = np.round(score(x, y), 6) + 0.0
                order = _order(x["id"])
                query, at = _best(scores[:, order], k)
                columns = [y["id"].take(pa.array(query)), x["id"].take(pa.array(order[at])), pa.array(scores[query, order[at]])]
                yield pa.RecordBatch.from_arrays(columns, names=["query", "id", "score"])

    scored = a.crossJoin(q.toDF(*theirs)).mapInArrow(meet, f"query {asked}, id {kind}, score double")
    return top_k(scored, ["query"], k, ["id"])


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k largest of each row, of equals the first; without sorting. Minus infinity is no score."""
    if k < scores.shape[1]:
        least = np.partition(scores, -k, axis=1)[:, -k, None]
        above, same = scores > least, scores == least
        keep = above | (same & (np.cumsum(same, axis=1) <= k - above.sum(axis=1, keepdims=True)))
        return np.nonzero(keep & np.isfinite(scores))
    return np.nonzero(np.isfinite(scores))


def unit_matrix(vectors: pa.Array, size: int | None = None) -> np.ndarray:
    """Unit vectors; zeros for one that is null, has a null in it, has no length or (where a size is named) another size, so that it scores 0."""
    out = _matrix(vectors)
    return out if size is None or out.shape[1] == size else np.array([v if len(v) == size else np.zeros(size) for v in out] or np.zeros((0, size))).reshape(len(vectors), size)


def _matrix(vectors: pa.Array) -> np.ndarray:
    sizes = pc.list_value_length(vectors)
    if vectors.null_count == 0 and len(vectors) and sizes[0].as_py() and pc.all(pc.equal(sizes, sizes[0])).as_py() and vectors.flatten().null_count == 0:
        out = vectors.flatten().to_numpy().astype(float).reshape(len(vectors), -1)
    else:
        parts = [np.zeros(0) if v is None or any(x is None for x in v) else np.array(v, float) for v in vectors.to_pylist()]
        size = max((len(v) for v in parts), default=0)
        out = np.array([v if len(v) == size else np.zeros(size) for v in parts]).reshape(len(parts), size)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def nearest(rows: DataFrame, queries: DataFrame, k: int, row_block: int = 8192, query_block: int = 8192, sharing: bool = False, least: float = -np.inf) -> DataFrame:
    """(query, id, score, rank): for each query (id, v) the k rows (id, v) nearest by cosine: the exact scan, of all rows and queries, for few
    queries and for measuring an index (vector_index) against. Ties by id; ids are not null and do not repeat. sharing: only rows that have a dimension in common with the query.
    least: only scores of so much.

    Signs of random planes do not part vectors that are far from each other: for a recall of 0.9 they leave three quarters of all
    pairs, each found about four times. So blocks of vectors meet blocks of queries. Products of single precision tell which cells may be among the k best of
    those that the task has seen, by more than their largest error; only these are computed in full and ranked."""
    a, few = blocks(rows.select("id", "v"), row_block, "v"), cut(queries.select(F.col("id").alias("q_id"), F.col("v").alias("q_v")), "asked")
    n, size = few.agg(F.count("*"), F.max(F.size("q_v"))).first()
    # blocks of 8 MB at most, and whole, however many parts the queries come in: each block of rows is sent once for each of them
    query_block = max(1, min(query_block, (1 << 20) // max(1, size or 1)))
    parts = max(1, -(-n // query_block))
    q = cut(blocks(few.coalesce(parts), query_block, "q_v").withColumn("q_number", F.monotonically_increasing_id()), "queries")
    kind, asked = a.schema["id"].dataType.elementType.simpleString(), q.schema["q_id"].dataType.elementType.simpleString()

    def meet(of: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}  # of a block of queries, the k best scores so far
        for batch in of:
            for r in range(len(batch)):
                ids, theirs, number = batch.column("id")[r].values, batch.column("q_id")[r].values, batch.column("q_number")[r].as_py()
                x, y = (np.frombuffer(batch.column(c)[r].as_buffer()).reshape(len(i), -1) for c, i in (("v", ids), ("q_v", theirs)))
                order = _order(ids)
                x = x[order]
                if not (finite := np.isfinite(x).all(axis=1)).all():
                    x, order = x[finite], order[finite]
                if x.shape[1] != y.shape[1]:  # vectors of other dimensions have no cosine
                    x, y = np.zeros((len(x), 1)), np.zeros((len(y), 1))
                if len(held) >= 64:
                    held.clear()
                best = held.setdefault(number, np.full((len(y), k), -np.inf))
                single = x.astype(np.float32)
                step = max(1, CELLS // 2 // max(len(x), 1))
                for s in range(0, len(y), step):
                    query, at, score = _nearest(x, single, y[s : s + step], best[s : s + step], k, sharing, least)
                    yield pa.RecordBatch.from_arrays([theirs.take(pa.array(s + query)), ids.take(pa.array(order[at])), pa.array(score)], names=["query", "id", "score"])

    # few blocks of queries, 32 MB at most, are sent to all tasks
    found = a.crossJoin(F.broadcast(q) if parts <= 4 else q).mapInArrow(meet, f"query {asked}, id {kind}, score double")
    return top_k(found, ["query"], k, ["id"])


def _nearest(x: np.ndarray, single: np.ndarray, y: np.ndarray, best: np.ndarray, k: int, sharing: bool, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of those rows x (single: in single precision) that may be among the k nearest of queries y, where `best` are the scores of the k best so far, in order; it
    is brought up to date. Rows are in the order of their ids."""
    near = y.astype(np.float32) @ single.T
    slack = 2e-6 + 2e-7 * x.shape[1]
    floor = np.maximum(best[:, 0], least) - slack
    new = np.flatnonzero(best[:, 0] == -np.inf)
    if len(new) and near.shape[1] > k:
        kth = np.partition(near[new], -k, axis=1)[:, -k]
        # a product that is surely not 0 is of rows that share a dimension
        floor[new] = np.maximum(floor[new], np.where(kth > 2 * slack, kth - 2 * slack, -np.inf) if sharing else kth - 2 * slack)
    may = near >= floor[:, None]
    if sharing and len(open_ := np.flatnonzero(floor == -np.inf)):
        may[open_] &= (y[open_] != 0).astype(np.float32) @ (x != 0).astype(np.float32).T > 0
    query, at = np.divmod(np.flatnonzero(may), max(len(x), 1))
    score = np.empty(len(query))
    step = max(1, CELLS // max(x.shape[1], 1))
    for s in range(0, len(query), step):
        u, v = y[query[s : s + step]], x[at[s : s + step]]
        score[s : s + step] = np.einsum("ij,ij->i", u, v)
        if sharing:
            score[s : s + step][~((u != 0) & (v != 0)).any(axis=1)] = -np.inf
    score = np.round(score, 6) + 0.0
    kept = np.flatnonzero(np.isfinite(score) & (score >= least))
    query, at, score = query[kept], at[kept], score[kept]
    which, place = first_of(query, k, -score, at)
    query, at, score = query[which], at[which], score[which]
    fresh = np.full((len(y), k), -np.inf)
    fresh[query, place] = score
    best[:] = np.sort(np.concatenate((best, fresh), axis=1), axis=1)[:, -k:]
    kept = score >= best[query, 0]
    return query[kept], at[kept], score[kept]


def ann_join(rows: DataFrame, queries: DataFrame, key: str, embedding: str, k: int, row_block: int = 8192, query_block: int = 8192) -> DataFrame:
    """For each query (key, embedding), its k nearest rows: (query, key, score, rank)."""
    a, q = (x.select(F.col(key).alias("id"), F.col(embedding).alias("v")) for x in (rows, queries))
    return nearest(a, q, k, row_block, query_block).withColumnRenamed("id", key)
