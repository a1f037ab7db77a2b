"""N-gram Jaccard join with MinHash banding, and the near-duplicate classes it gives.

1. Each text's set of n-word windows is hashed; equal sets are one node with a weight. The node has a MinHash signature, cut
   into bands; :func:`choose_bands` takes the most rows a band for which a pair at the threshold still shares a band with
   the target probability.
2. Nodes are shuffled by band hash. Within a bucket, signatures (a byte a value) are compared; nodes of which half the signature
   agrees are tied together. The pairs themselves are not emitted, only a spanning star.
3. The ties' components hold all candidate pairs. Each is verified on the full n-gram sets, with all intersections
   as matrix products, so that every link at the threshold is found; what leaves the task is a count of links for each node and
   a star for each class.

Buckets and components of more than ``block`` nodes are dealt out as pairs of blocks, each a task's work; so no bucket is
capped and none is gathered whole. The price: of a component of N nodes each set is sent to N / ``block`` tasks. Texts are read twice; full sets are made for candidates only.

Defined cases: a null or empty text, or one without a word, has no n-gram and is a class of its own; a text of fewer than n words
has one window, all its words; rows that repeat are copies of each other; a null id takes part, and a class's id is
the least of its members' (null if all are); with no documents the result is empty.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import Words, batches, cut, hot_keys, join_hot, shingles, table
from docloom.llm.components import components


def choose_bands(threshold: float = 0.8, recall: float = 0.9999, most: int = 128) -> tuple[int, int]:
    """Bands and rows a band: the most rows for which at most so many hashes give a pair at the threshold this chance to meet."""
    for rows in range(most, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)) if threshold < 1 else 1
        if bands * rows <= most:
            return max(bands, 1), rows
    return most, 1


def ngram_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's n-grams."""
    windows, first = shingles(Words(texts), n)
    for lo, hi in zip(first[:-1], first[1:], strict=True):
        yield np.unique(windows[lo:hi])


def sketch(docs: DataFrame, text: str, id: str, n: int, bands: int, rows: int) -> DataFrame:
    """(id, text_key, node, bands, signature) of each document; node is null where there is no n-gram."""
    rng = np.random.default_rng(5)
    factor = rng.integers(0, 1 << 31, (bands * rows, 1), np.uint32) * np.uint32(2) + np.uint32(1)
    term = rng.integers(0, 1 << 32, (bands * rows, 1), np.uint32)
    weigh = rng.integers(0, 1 << 63, (1, rows), np.uint64) * np.uint64(2) + np.uint64(1)

    def run(of: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in of:
            for batch in batches(whole, "text", 8 << 20):
                node, band, signature = [], [], []
                for own in ngram_sets(batch.column("text"), n):
                    if not len(own):
                        node.append(None), band.append(None), signature.append(None)
                        continue
                    low = (own >> np.uint64(32)).astype(np.uint32)
                    least = np.full((bands * rows, 1), 0xFFFFFFFF, np.uint32)
                    for lo in range(0, len(low), 4096):
                        least = np.minimum(least, (low[lo : lo + 4096] * factor + term).min(1, keepdims=True))
                    least = least[:, 0]
                    node.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                    band.append((((least.reshape(bands, rows).astype(np.uint64) + np.uint64(1)) * weigh).sum(1) * np.uint64(0x9E3779B97F4A7C15) + np.arange(bands, dtype=np.uint64)).view(np.int64))
                    signature.append(((least * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text_key"), pa.array(node, pa.binary()), pa.array(band, pa.list_(pa.int64())), pa.array(signature, pa.binary())], names=["id", "text_key", "node", "bands", "signature"])

    kind = docs.schema[id].dataType.simpleString()
    rows_in = docs.select(F.col(f"`{id}`").alias("id"), F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))).alias("text_key"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows_in.mapInArrow(run, f"id {kind}, text_key binary, node binary, bands array<bigint>, signature binary")


def _dealt(rows: DataFrame, group: str, size: str, block: int, pack: int) -> DataFrame:
    """rows with `task`: small groups share tasks; of a large one, each row goes to its block's pairs with all blocks."""
    blocks = F.ceil(F.col(size) / block).cast("int")
    mine = F.pmod(F.xxhash64("node"), blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.concat_ws(" ", F.hex(group), F.least(mine, j).cast("string"), F.greatest(mine, j).cast("string")))
    shared = F.array(F.pmod(F.xxhash64(group), F.lit(pack)).cast("string"))
    return rows.withColumn("task", F.explode(F.when(F.col(size) <= block, shared).otherwise(pairs)))


def _roots(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of links, the first row of its component."""
    out = np.full(len(linked), -1)
    for i in range(len(linked)):
        if out[i] < 0:
            front = np.array([i])
            while len(front):
                out[front] = i
                front = np.flatnonzero(linked[front].any(0) & (out < 0))
    return out


def _groups(keys: pa.Array) -> Iterator[np.ndarray]:
    """Row numbers of each distinct key."""
    codes = np.asarray(keys.combine_chunks().dictionary_encode().indices if isinstance(keys, pa.ChunkedArray) else keys.dictionary_encode().indices)
    order = np.argsort(codes, kind="stable")
    yield from np.split(order, np.flatnonzero(np.diff(codes[order])) + 1) if len(order) else ()


def _ties(of: pa.Table) -> pa.Table:
    """Spanning stars of the nodes of a bucket (or two blocks of it) of which half the signatures agree."""
    nodes, a, b = of.column("node").to_pylist(), [], []
    signatures = of.column("signature").to_pylist()
    for rows in _groups(of.column("bucket")):
        if len(rows) < 2:
            continue
        rows = sorted(rows, key=nodes.__getitem__)  # so that stars of the same nodes have the same center
        s = np.frombuffer(b"".join(signatures[r] for r in rows), np.uint8).reshape(len(rows), -1)
        like = np.stack([(s == one).sum(1) for one in s]) * 2 >= s.shape[1]
        for i, root in enumerate(_roots(like)):
            if i != root:
                a.append(nodes[rows[root]]), b.append(nodes[rows[i]])
    return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})


def intersections(sets: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """How many elements each two sets share."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    place = np.cumsum(shared) - 1
    keep = shared[code]
    code, owner = place[code[keep]], owner[keep]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    out = np.zeros((len(sets), len(sets)), np.float64)
    for lo in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(code, [lo, lo + width])
        x = np.zeros((len(sets), min(width, int(shared.sum()) - lo)), np.float32)
        x[owner[a:b], code[a:b] - lo] = 1
        out += x @ x.T
    return out


def _verifier(threshold: float):
    def verify(of: pa.Table) -> pa.Table:
        """For each node, its links' weight here and the first node of its class here. Of two blocks, only links between them are
        counted; each block's own links are counted by its task with itself."""
        nodes, weights, out = of.column("node").to_pylist(), np.asarray(of.column("weight")), {"node": [], "links": [], "root": []}
        sets, mine, alone = of.column("grams").to_pylist(), np.asarray(of.column("mine")), of.column("task")[0].as_py().split(" ")
        cross = len(alone) == 3 and alone[1] != alone[2]
        for rows in _groups(of.column("component")):
            found, first = [], {}
            for r in sorted(rows, key=nodes.__getitem__):  # the same node comes twice where rows repeat
                if nodes[r] not in first:
                    first[nodes[r]] = r
                    found.append(r)
            own = [np.frombuffer(sets[r], np.uint64) for r in found]
            size = np.array([len(x) for x in own], np.float64)
            both = intersections(own)
            linked = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9
            roots = _roots(linked)
            np.fill_diagonal(linked, False)
            if cross:
                linked &= mine[found][:, None] != mine[found][None, :]
            out["node"] += [nodes[r] for r in found]
            out["links"] += (linked @ weights[found]).tolist()
            out["root"] += [nodes[found[r]] for r in roots]
        return pa.table({"node": pa.array(out["node"], pa.binary()), "links": pa.array(out["links"], pa.int64()), "root": pa.array(out["root"], pa.binary())})

    return verify


def near_duplicates(docs: DataFrame, text: str = "text", id: str = "doc_id", n: int = 5, threshold: float = 0.8, recall: float = 0.9999, block: int = 1024) -> DataFrame:
    """For each document: id, class_id (the least id among those it is linked with, over any number of links), copy_id (the least id
    with the same n-gram set), n_links (other documents at the threshold or above, copies included)."""
    bands, rows = choose_bands(threshold, recall)
    sketches = cut(sketch(docs, text, id, n, bands, rows), "sketches")
    nodes = sketches.where("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("weight"), F.min("id").alias("least"), F.min(F.struct("text_key", "id")).alias("example"))
    nodes = cut(nodes, "nodes")
    single = cut(sketches.where("node IS NOT NULL").groupBy("node", "bands", "signature").agg(F.lit(1).alias("_")), "signatures")
    banded = single.select("node", F.explode("bands").alias("bucket"))
    met = cut(banded.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    total = met.agg(F.sum("size")).first()[0] or 0
    # only nodes that meet another are joined with their signatures
    members = banded.join(met.hint("merge"), "bucket").join(single.select("node", "signature").hint("merge"), "node")
    ties = _dealt(members, "bucket", "size", block, total // 8000 + 1).groupBy("task").applyInArrow(_ties, "a binary, b binary")
    tied = components(ties)
    sized = cut(tied.groupBy("root").agg(F.count("*").alias("size")), "sizes")
    chosen = join_hot(tied, sized, "root", hot_keys(sized, "root", "size")).join(nodes, "node").select("node", "weight", "size", F.col("root").alias("component"), F.col("example.text_key").alias("text_key"), F.col("example.id").alias("id"))
    chosen = cut(chosen, "candidates")
    count = chosen.count()

    def sets(of: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in of:
            for batch in batches(whole, "text", 8 << 20):
                grams = pa.array([own.tobytes() for own in ngram_sets(batch.column("text"), n)], pa.binary())
                names = ["node", "weight", "size", "component"]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], grams], names=[*names, "grams"])

    key = F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    texts = docs.select(F.col(f"`{id}`").alias("id"), key.alias("text_key"), F.col(f"`{text}`").cast("string").alias("text")).alias("d")
    full = texts.join(chosen.hint("merge").alias("c"), (F.col("d.text_key") == F.col("c.text_key")) & F.col("d.id").eqNullSafe(F.col("c.id"))).select("node", "weight", "size", "component", "text").mapInArrow(sets, "node binary, weight bigint, size bigint, component binary, grams binary")
    full = full.withColumn("mine", F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / block).cast("int")).cast("int"))
    found = cut(_dealt(full, "component", "size", block, count // 500 + 1).groupBy("task").applyInArrow(_verifier(threshold), "node binary, links bigint, root binary"), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(found.where("root != node").select(F.col("root").alias("a"), F.col("node").alias("b")))
    named = nodes.drop("example").join(classes, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = cut(named.join(links, "node", "left"), "named")
    lowest = cut(named.groupBy("root").agg(F.min("least").alias("class_id"), F.count("*").alias("size")), "lowest")
    named = join_hot(named, lowest.drop("size"), "root", hot_keys(lowest, "root", "size")).select("node", "class_id", F.col("least").alias("copy_id"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    named = cut(named, "classes")
    out = sketches.select("id", "node").join(named, "node", "left")
    alone = F.col("node").isNull()
    return out.select(F.col("id").alias(id), F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, F.col("id")).otherwise(F.col("copy_id")).alias("copy_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP6_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i : i + 4], ' ')))) AS g FROM d WHERE len(w) > 0),
sets AS (SELECT g, min(doc_id) AS copy_id, count(*) AS weight, len(g) AS n FROM grams GROUP BY g),
one AS (SELECT copy_id, n, weight, unnest(g) AS x FROM sets),
pairs AS (
  SELECT a.copy_id AS a, b.copy_id AS b, any_value(b.weight) AS weight
  FROM one a JOIN one b ON a.x = b.x AND a.copy_id <> b.copy_id AND a.n * 5 >= b.n * 4 AND b.n * 5 >= a.n * 4
  GROUP BY a.copy_id, b.copy_id, a.n, b.n HAVING count(*) * 5 >= 4 * (a.n + b.n - count(*))),
reach AS (SELECT copy_id AS a, copy_id AS b FROM sets UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
class AS (SELECT a AS copy_id, min(b) AS class_id FROM reach GROUP BY a),
links AS (SELECT a AS copy_id, sum(weight) AS links FROM pairs GROUP BY a)
SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, coalesce(s.copy_id, d.doc_id) AS copy_id,
       CAST(coalesce(l.links, 0) + coalesce(s.weight - 1, 0) AS BIGINT) AS n_links
FROM d LEFT JOIN grams USING (doc_id) LEFT JOIN sets s USING (g) LEFT JOIN class c ON c.copy_id = s.copy_id LEFT JOIN links l ON l.copy_id = s.copy_id
"""
