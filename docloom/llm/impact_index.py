"""Ranked lexical search over a bit-sliced impact index.

Documents are dealt to blocks of at most `block` documents or `block_words` words, where they lie in the table: building moves nothing. In each block a
term has its documents (numbers within the block) and the slices of their impacts: 20 bitmaps over these documents, one for each bit of
(10^9 tf) div (1000 tf + 8 m). A search keeps the rows of the queries' terms, brings each block's together and works on all queries of a batch at
once: impacts are laid out as bitmaps over the block, multiplied with the term's weight by shifting and adding, and added up over a query's terms by
carry arithmetic on machine words; the k best of a block are found from the most significant slice down. Scores are exact integers.

Nulls: a text that is null has no term and is in no statistic; documents without doc_id are ranked, after others of the same score; items without
item_id, and repeated items, are items of their own. An item without known terms has no row. Very long texts are taken whole (one may be a block of its own).
Empty tables give no rows. Columns other than doc_id, text, item_id are not looked at. Terms are told apart by 64 bits within a block, by text across.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.llm.common import FOLDED_SEPARATORS, Words, batches, table
from docloom.shared import cut

SLICES = 20  # an impact is at most 10^6
ROWS = "block string, term string, n int, docs binary, slices binary"
_ROWS = pa.schema([("block", pa.string()), ("term", pa.string()), ("n", pa.int32()), ("docs", pa.large_binary()), ("slices", pa.large_binary())])
_FOUND = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])
Item = tuple[int, list[tuple[int, int]]]


def bounds(counts: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(counts)))


def spots(counts: np.ndarray) -> np.ndarray:
    """0 .. n - 1 for each n of counts."""
    return np.arange(counts.sum()) - np.repeat(bounds(counts)[:-1], counts)


def pack(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slices of each run of values, one slice after the other, and where each run's bytes begin (and the last end)."""
    n_bytes = (sizes * SLICES + 7) // 8
    base, size = np.repeat(bounds(n_bytes)[:-1] * 8, sizes), np.repeat(sizes, sizes)
    bits, at = np.zeros(int(n_bytes.sum()) * 8, np.uint8), base + spots(sizes)
    for i in range(SLICES):
        bits[at + i * size] = (values >> i) & 1
    return np.packbits(bits), bounds(n_bytes)


def add(total: np.ndarray, more: np.ndarray, shift: int = 0) -> None:
    """total += more << shift, on bit slices: first axis the slice, least significant first."""
    carry = None
    for i in range(shift, len(total)):
        a, b = total[i], more[i - shift] if i - shift < len(more) else None
        if b is None and carry is None:
            return
        if b is None:
            total[i], carry = a ^ carry, a & carry
            if not carry.any():
                return
        elif carry is None:
            total[i], carry = a ^ b, a & b
        else:
            half = a ^ b
            total[i], carry = half ^ carry, (a & b) | (carry & half)


def best(total: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of lanes: bitmaps of the documents that are surely among its k best, and of those that tie for the last places."""
    sure, tied = np.zeros_like(total[0]), np.full_like(total[0], ~np.uint64(0))
    for i in range(len(total) - 1, -1, -1):
        have = tied & total[i]
        n = np.bitwise_count(sure | have).sum(axis=-1, keepdims=True)
        more, few = n > k, n <= k
        sure = np.where(few, sure | have, sure)
        tied = np.where(more, have, tied & ~total[i])
    return sure, tied


class Block:
    """The rows of one block: its documents' ids, and the slices of those terms that queries have."""

    def __init__(self):
        self.ids, self.terms, self.docs, self.slices, self.sizes = None, [], [], [], []

    def add(self, term: str | None, n: int, docs: bytes, slices: bytes) -> None:
        if term is None:
            self.ids = docs, slices
        else:
            self.terms.append(term)
            self.sizes.append(n)
            self.docs.append(docs)
            self.slices.append(slices)

    def lanes(self, weights: np.ndarray) -> np.ndarray:
        """Bit slices of weight times impact: slice, term (and a last one with nothing), word of 64 documents."""
        words, sizes = -(-len(self.ids[0]) // 8 // 64), np.array(self.sizes, np.int64)
        docs = np.frombuffer(b"".join(self.docs), np.uint16).astype(np.int64)
        term, bits = np.repeat(np.arange(len(sizes)), sizes), np.unpackbits(np.frombuffer(b"".join(self.slices), np.uint8))
        at, size = np.repeat(bounds((sizes * SLICES + 7) // 8)[:-1] * 8, sizes) + spots(sizes), np.repeat(sizes, sizes)
        where, shift = term * words + docs // 64, (docs % 64).astype(np.uint64)
        heads = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
        plain = np.zeros((SLICES, (len(sizes) + 1) * words), np.uint64)
        for i in range(SLICES):
            plain[i, where[heads]] = np.bitwise_or.reduceat(bits[at + i * size].astype(np.uint64) << shift, heads)
        plain = plain.reshape(SLICES, len(sizes) + 1, words)
        total = np.zeros((SLICES + max(int(weights.max(initial=0)).bit_length(), 1), *plain.shape[1:]), np.uint64)
        for b in range(int(weights.max(initial=0)).bit_length()):
            add(total, plain * (np.append(weights, 0) >> b & 1).astype(np.uint64)[None, :, None], b)
        return total


def search_block(block: Block, items: list[Item], weights: np.ndarray, names: dict[str, int], k: int, lanes: int = 1 << 15) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The k best documents (numbers in the block) of each item and their scores. items: (number, [(term number, times)]) with most terms first."""
    place = {names[t]: i for i, t in enumerate(block.terms)}
    sliced, none = block.lanes(weights[[names[t] for t in block.terms]]), len(block.terms)
    words, n_docs = sliced.shape[2], len(block.ids[0]) // 8
    here = [(number, [(place[t], q) for t, q in terms if t in place]) for number, terms in items]
    here = sorted((x for x in here if x[1]), key=lambda x: -len(x[1]))
    step = max(1, lanes // words)
    real = np.zeros(words * 64, bool)
    real[:n_docs] = True
    real = np.packbits(real, bitorder="little").view(np.uint64)
    for low in range(0, len(here), step):
        part = here[low : low + step]
        # each number of times is a sum of powers of two, and each of these an addition
        entries = [sorted((b, t) for t, q in terms for b in range(q.bit_length()) if q >> b & 1) for _, terms in part]
        most = max(sum(int(weights[names[block.terms[t]]]) << b for b, t in e) for e in entries) * 1_000_000
        total = np.zeros((most.bit_length(), len(part), words), np.uint64)
        shifts = sorted({b for e in entries for b, _ in e})
        for shift in shifts:
            lists = [[t for b, t in e if b == shift] for e in entries]
            for j in range(max(map(len, lists))):
                rows = np.array([i for i, x in enumerate(lists) if len(x) > j])
                terms = np.array([lists[i][j] for i in rows])
                if len(rows) == len(part):
                    add(total, sliced[:, terms], shift)
                else:
                    some = np.ascontiguousarray(total[:, rows])
                    add(some, sliced[:, terms], shift)
                    total[:, rows] = some
        some = np.bitwise_or.reduce(total, axis=0) & real
        total &= some[None]
        sure, tied = best(total, k)
        tied &= some
        sure &= some
        for i, (number, _) in enumerate(part):
            chosen = np.flatnonzero(np.unpackbits((sure[i] | tied[i]).view(np.uint8), bitorder="little"))
            bits = total[:, i, chosen // 64] >> (chosen % 64).astype(np.uint64) & np.uint64(1)
            yield number, chosen, (bits.astype(np.int64) << np.arange(len(bits))[:, None]).sum(axis=0)


def _blocks(n_docs: int, n_words: int, block: int, block_words: int):
    """Deals documents to blocks and makes their rows."""

    def rows(name: str, ids: list, words: list[tuple[np.ndarray, np.ndarray, list[bytes]]]) -> Iterator[pa.RecordBatch]:
        counts = np.array([len(h) for h, _ in words], np.int64)
        known = np.array([d is not None for d in ids])
        head = pa.RecordBatch.from_arrays(
            [pa.array([name]), pa.array([None], pa.string()), pa.array([len(ids)], pa.int32()), pa.array([np.array([d or 0 for d in ids], "<i8").tobytes()], pa.large_binary()), pa.array([np.packbits(known).tobytes()], pa.large_binary())],
            schema=_ROWS,
        )
        yield head
        hashes = np.concatenate([h for h, _ in words]) if words else np.zeros(0, np.uint64)
        if not len(hashes):
            return
        terms, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        doc = np.repeat(np.arange(len(ids)), counts)
        pairs, tf = np.unique(inverse * len(ids) + doc, return_counts=True)
        doc, sizes = pairs % len(ids), np.bincount(pairs // len(ids), minlength=len(terms))
        # a document's m, in Python's integers where 64 bits could overflow
        m = np.array([25 + 75 * int(n) * n_docs // n_words for n in counts], np.int64)
        value = (1_000_000_000 * tf.astype(np.int64)) // (1000 * tf.astype(np.int64) + 8 * m[doc])
        data, at = pack(value, sizes)
        base = bounds(counts)
        which = np.searchsorted(base, first, side="right") - 1
        text = [words[d][1](int(f - base[d])) for d, f in zip(which.tolist(), first.tolist(), strict=True)]
        docs, n, most = doc.astype(np.uint16), bounds(sizes), 20_000
        for low in range(0, len(terms), most):
            high = min(low + most, len(terms))
            binary = lambda values, offsets, low=low, high=high: pa.LargeBinaryArray.from_buffers(pa.large_binary(), high - low, [None, pa.py_buffer(np.ascontiguousarray(offsets[low : high + 1].astype(np.int64))), pa.py_buffer(values)])
            yield pa.RecordBatch.from_arrays([pa.array([name] * (high - low)), pa.array(text[low:high]), pa.array(sizes[low:high], pa.int32()), binary(docs, 2 * n), binary(data, at)], schema=_ROWS)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number, ids, held, n = TaskContext.get().partitionId(), 0, [], [], 0
        for part in parts:
            for batch in batches(part, "text"):
                words = Words(batch.column("text"), FOLDED_SEPARATORS)
                for i, doc in enumerate(batch.column("doc_id").cast(pa.int64()).to_pylist()):
                    low, high = int(words.first[i]), int(words.first[i + 1])
                    if low == high:
                        continue
                    if ids and (len(ids) >= block or n + high - low > block_words):
                        yield from rows(f"{task}-{number}", ids, held)
                        number, ids, held, n = number + 1, [], [], 0
                    start, end, data = words.start[low:high], words.end[low:high], words.data
                    ids.append(doc)
                    held.append((words.hashes[low:high], lambda j, s=start, e=end, d=data: d[s[j] : e[j]].tobytes().decode().translate(_LOWER)))
                    n += high - low
        if ids:
            yield from rows(f"{task}-{number}", ids, held)

    return run


_LOWER = {c: c + 32 for c in range(65, 91)}


def _sizes(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs = words = 0
    for part in parts:
        for batch in batches(part, "text"):
            counts = Words(batch.column("text"), FOLDED_SEPARATORS, hashed=False).counts
            docs, words = docs + int((counts > 0).sum()), words + int(counts.sum())
    yield pa.RecordBatch.from_arrays([pa.array([docs], pa.int64()), pa.array([words], pa.int64())], names=["docs", "words"])


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """How many documents have a term, and how many terms they have."""
    row = docs.select("text").mapInArrow(_sizes, "docs bigint, words bigint").agg(F.sum("docs"), F.sum("words")).first()
    return row[0] or 0, row[1] or 0


def impact_index(docs: DataFrame, size: tuple[int, int], block: int = 4096, block_words: int = 1_000_000) -> DataFrame:
    """The index of docs (doc_id, text): a row for each block and term, and one without a term that has the block's ids. To be written, by cut() or
    elsewhere. block: 65,536 at most."""
    if not 0 < block <= 1 << 16:
        raise ValueError("a block has 1 to 65,536 documents")
    return docs.select("doc_id", "text").mapInArrow(_blocks(*size, block, block_words), ROWS)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _search(items: list[Item], names: dict[str, int], weights: np.ndarray, k: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held, block, current = [], 0, Block(), None

        def least(rows: list) -> list:
            """The k best of each item, among all that were found."""
            item, doc, none, score = (np.concatenate(c) for c in zip(*rows, strict=True))
            order = np.lexsort((doc, none, -score, item))
            item = item[order]
            rank = np.arange(len(item)) - np.searchsorted(item, item)
            keep = order[rank < k]
            return [tuple(np.concatenate(c)[keep] for c in zip(*rows, strict=True))]

        def done(block: Block) -> None:
            nonlocal found, held
            if block.ids is None or not block.terms:
                return
            ids = np.frombuffer(block.ids[0], "<i8")
            none = ~np.unpackbits(np.frombuffer(block.ids[1], np.uint8), count=len(ids)).astype(bool)
            for number, chosen, scores in search_block(block, items, weights, names, k):
                order = np.lexsort((ids[chosen], none[chosen], -scores))[:k]
                found.append((np.full(len(order), number), ids[chosen[order]], none[chosen[order]], scores[order]))
                held += len(order)
            if held > 4 * k * len(items) + 100_000:
                found = least(found)
                held = len(found[0][0])

        for part in parts:
            for name, term, n, docs, slices in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if name != current:
                    done(block)
                    block, current = Block(), name
                block.add(term, n, docs, slices)
        done(block)
        if found:
            item, doc, none, score = least(found)[0]
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(doc, pa.int64(), mask=none), pa.array(score, pa.int64())], schema=_FOUND)

    return run


def _item_terms(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        words = Words(part.column("text"), FOLDED_SEPARATORS, hashed=False)
        text = [[words.data[s:e].tobytes().decode().translate(_LOWER) for s, e in zip(words.start[a:b], words.end[a:b], strict=True)] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([part.column("item_id"), pa.array(text, pa.list_(pa.string()))], names=["item_id", "terms"])


def ranked(index: DataFrame, n_docs: int, items: DataFrame, k: int = 10, block_items: int = 2000, block_terms: int = 100_000) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item (item_id, text). Items are taken in blocks of at most `block_items` items and
    `block_terms` terms (one item at least), each in a pass over the index, so that what a task holds does not grow with the items."""
    spark = index.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    terms = items.select("item_id", "text").mapInArrow(_item_terms, f"item_id {kind}, terms array<string>")
    out, names, block, number, labels = None, {}, [], 0, []

    def run() -> DataFrame:
        wanted = spark.createDataFrame([(t,) for t in names] or [("",)], "term string")
        rows = cut(index.join(F.broadcast(wanted), "term", "left_semi").unionByName(index.where("term IS NULL")).select("block", "term", "n", "docs", "slices"), "asked")
        df = dict(rows.where("term IS NOT NULL").groupBy("term").agg(F.sum("n")).collect())
        weights = np.array([weight(n_docs, df[t]) if t in df else 0 for t in names], np.int64)
        by_block = rows.repartition("block").sortWithinPartitions("block")
        found = by_block.mapInArrow(_search(block, dict(names), weights, k), "item bigint, doc_id bigint, score bigint")
        rank = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        said = F.broadcast(spark.createDataFrame(labels, f"item bigint, item_id {kind}"))
        return found.where("score > 0").withColumn("rank", rank).where(F.col("rank") <= k).join(said, "item").select("item_id", "rank", "doc_id", "score")

    for row in terms.toLocalIterator():
        own: dict[int, int] = {}
        if block and (len(block) >= block_items or len(names) + len(row["terms"]) > block_terms):
            out = run() if out is None else out.unionByName(run())
            names, block, labels = {}, [], []
        for t in row["terms"]:
            at = names.setdefault(t, len(names))
            own[at] = own.get(at, 0) + 1
        block.append((number, list(own.items())))
        labels.append((number, row["item_id"]))
        number += 1
    last = run() if block else spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    return last if out is None else out.unionByName(last)


def op11_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    size = corpus_size(docs)
    return ranked(cut(impact_index(docs, size), "impacts"), size[0], spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
c AS (SELECT count(*) AS n_docs, sum(len(w)) AS n_words FROM d WHERE len(w) > 0),
m AS (SELECT k, doc_id, CAST(25 + (75 * len(w)::HUGEINT * n_docs) // n_words AS BIGINT) AS m FROM d, c WHERE len(w) > 0),
b AS (
  SELECT row_number() OVER () AS i, item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
q AS (SELECT i, item_id, term, count(*) AS times FROM (SELECT i, item_id, unnest(w) AS term FROM b) GROUP BY ALL),
p AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM p, c GROUP BY term, n_docs),
s AS (
  SELECT i, item_id, doc_id, k, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM q JOIN f USING (term) JOIN p USING (term) JOIN m USING (k) GROUP BY i, item_id, doc_id, k)
SELECT item_id, CAST(row_number() OVER w AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
WINDOW w AS (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) QUALIFY row_number() OVER w <= 10
"""
