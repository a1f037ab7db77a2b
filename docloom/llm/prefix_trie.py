"""Prefix trie of conversations, built as a Patricia tree over sorted conversations.

A conversation is its turns in order, each as 20 bytes: the digest of role and text, and the text's length in code points. Conversations are sorted
by these bytes (range partitions, so that neither copies nor a shared first turn meet in one task). A task reads its conversations in order with
the points of the current path as its only state, and makes points where paths branch or end, with the edge to the point above. All sums of a
point are sums over its conversations, told by what each shares with the one before: tokens saved below depth d are the sum of S(shared) - S(d - 1),
where S is the running length of the path. Points on the first and last path of a task go on in its neighbours: there every depth becomes a point,
and these are added up by their digest, after a correction for what two neighbouring tasks share. Unary nodes are expanded last, from the edges.

Nulls: rows without conv_id belong to no conversation; null turns come first, null roles and texts are empty. Turns of the same number are ordered by
digest, repeated rows are turns of their own. An empty table has no nodes. Further columns are not looked at. Of a conversation 20 bytes a turn
meet in one row (100 million turns at most); texts are never moved. Digests are of 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import hash_mod, join_hot, join_small, table
from docloom.shared import cut

STEP = 20
NO_ENDS = hashlib.sha256(b"").hexdigest()
PART = "kind string, depth bigint, node binary, parent binary, n bigint, least bigint, leaves bigint, children bigint, shared bigint, before array<bigint>, ends string, part bigint, place bigint, data binary"
_TYPES = {"kind": pa.string(), "node": pa.binary(), "parent": pa.binary(), "before": pa.list_(pa.int64()), "ends": pa.string(), "data": pa.binary()}
_SCHEMA = pa.schema([(c.split()[0], _TYPES.get(c.split()[0], pa.int64())) for c in PART.split(", ")])


class Rows:
    """Rows of PART, given out in batches."""

    def __init__(self):
        self.rows, self.size = [], 0

    def add(self, **row) -> None:
        self.rows.append(row)
        self.size += 100 + 8 * len(row.get("before", ())) + len(row.get("data", b""))

    def batches(self, most: int = 0) -> Iterator[pa.RecordBatch]:
        if self.rows and self.size > most:
            yield pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in self.rows], f.type) for f in _SCHEMA], schema=_SCHEMA)
            self.rows, self.size = [], 0


class Point:
    """A point of the current path, with sums over the conversations of this task that lie below it."""

    __slots__ = ("chunks", "children", "depth", "ids", "least", "leaves", "n", "node", "shared", "spine")

    def __init__(self, depth: int, node: bytes, spine: bool = False, children: int = 0):
        self.depth, self.node, self.spine, self.children = depth, node, spine, children
        self.n, self.least, self.leaves, self.shared, self.ids, self.chunks = 0, None, 0, 0, [], 0

    def take(self, below: Point) -> None:
        self.n += below.n
        self.leaves += below.leaves
        self.shared += below.shared
        self.least = below.least if self.least is None else min(self.least, below.least)

    def end(self, conv: int) -> None:
        self.n += 1
        self.least = conv if self.least is None else min(self.least, conv)
        self.ids.append(conv)


def shared_turns(a: bytes, b: bytes) -> int:
    """How many turns two paths have in common, by halving."""
    low, high = 0, min(len(a), len(b)) // STEP
    if a[: high * STEP] == b[: high * STEP]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low * STEP : middle * STEP] == b[low * STEP : middle * STEP]:
            low = middle
        else:
            high = middle
    return low


def running(path: bytes) -> np.ndarray:
    """Lengths of the first 0, 1, 2, ... turns."""
    return np.concatenate(([0], np.cumsum(np.frombuffer(path, ">u4")[4::5].astype(np.int64))))


def prefixes(path: bytes, first: int, last: int) -> list[bytes]:
    """Digests of the first `first` to `last` turns."""
    state = hashlib.md5(path[: first * STEP])
    out = [state.digest()]
    for d in range(first, last):
        state.update(path[d * STEP : (d + 1) * STEP])
        out.append(state.digest())
    return out


def _patricia(chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, stack, path, sums = TaskContext.get().partitionId(), Rows(), [], None, None

        def ids(point: Point) -> None:
            out.add(kind="ids", node=point.node, part=part, place=point.chunks, data=",".join(map(str, point.ids)).encode())
            point.ids, point.chunks = [], point.chunks + 1

        def close(point: Point, above: Point | None) -> None:
            point.leaves = point.leaves or int(not point.children)
            ends = None
            if point.ids and not point.spine and not point.chunks:
                ends = hashlib.sha256(",".join(map(str, point.ids)).encode()).hexdigest()
            elif point.ids:
                ids(point)
            before = sums[above.depth : point.depth].tolist() if above else [0]
            out.add(
                kind="spine" if point.spine else "point", depth=point.depth, node=point.node, parent=above.node if above else None, n=point.n, least=point.least,
                leaves=point.leaves, children=point.children, shared=point.shared, before=before, ends=ends,
            )
            if above:
                above.take(point)

        for batch in batches:
            for conv, turns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                size, own = len(turns) // STEP, running(turns)
                if path is None:
                    out.add(kind="border", part=part, place=0, data=turns)
                    stack = [Point(d, node, True, int(d < size)) for d, node in enumerate(prefixes(turns, 0, size))]
                else:
                    same = shared_turns(path, turns)
                    while stack[-1].depth > same:
                        point = stack.pop()
                        if stack[-1].depth < same:
                            stack.append(Point(same, hashlib.md5(path[: same * STEP]).digest(), children=1))
                        close(point, stack[-1])
                    stack[-1].shared += int(own[same])
                    if size > same:
                        stack[-1].children += 1
                        stack.append(Point(size, hashlib.md5(turns).digest()))
                stack[-1].end(conv)
                if len(stack[-1].ids) >= chunk:
                    ids(stack[-1])
                path, sums = turns, own
                yield from out.batches(4 << 20)
        if path is not None:
            out.add(kind="border", part=part, place=1, data=path)
        while stack:
            point = stack.pop()
            point.spine = True
            nodes = prefixes(path, stack[-1].depth + 1, point.depth) if stack else []
            for d in range(point.depth - 1, stack[-1].depth if stack else 0, -1):
                above = Point(d, nodes[d - stack[-1].depth - 1], True, 1)
                close(point, above)
                point = above
                yield from out.batches(4 << 20)
            close(point, stack[-1] if stack else None)
            yield from out.batches(4 << 20)
        yield from out.batches()

    return run


def _corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of neighbouring tasks' paths: what they share is no new child, no leaf if the second goes on, and is saved once more."""
    out = Rows()
    for batch in batches:
        for left, right in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            same = shared_turns(left, right)
            saved, goes_on = int(running(left)[same]), same == len(left) // STEP
            for d, node in enumerate(prefixes(left, 0, same)):
                out.add(kind="spine", depth=d, node=node, n=0, leaves=-int(goes_on), children=-int(d < same), shared=saved)
                yield from out.batches(4 << 20)
    yield from out.batches()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the ids of each node, whose rows come one after the other and in order."""
    node, state, done = None, None, []
    schema = pa.schema([("node", pa.binary()), ("all_ends", pa.string())])
    for batch in batches:
        for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if key != node:
                if node is not None:
                    done.append((node, state.hexdigest()))
                node, state = key, hashlib.sha256(data)
            else:
                state.update(b"," + data)
        if len(done) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
            done = []
    if node is not None:
        done.append((node, state.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)


def paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order, 20 bytes each."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    turn = F.concat(F.md5(said.cast("binary")), F.lpad(F.hex(F.char_length(text).cast("bigint")), 8, "0"))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("bigint"), F.struct("turn", turn.alias("said")).alias("t"))
    return rows.groupBy("conv_id").agg(F.unhex(F.array_join(F.expr("transform(sort_array(collect_list(t)), x -> x.said)"), "")).alias("turns"))


def rebuilt(own: DataFrame, family: int = 100, heads: int = 6) -> DataFrame:
    """Each conversation c with the first h turns of conversation c - c % family in place of its own; h: crc32 of c, mod heads."""
    h = hash_mod("conv_id", heads).cast("int")
    base = own.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), F.expr(f"substring(turns, 1, {STEP * heads})").alias("head"))
    rows = own.select("conv_id", "turns", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base")).join(base, "base", "left")
    start = F.coalesce(F.expr(f"substring(head, 1, {STEP} * h)"), F.lit(b""))
    return rows.select("conv_id", F.concat(start, F.expr(f"substring(turns, {STEP} * h + 1)")).alias("turns"))


def prefix_trie(rows: DataFrame, partitions: int | None = None, chunk: int = 4096) -> DataFrame:
    """The nodes of the trie of (conv_id, turns), one row each: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256. chunk: how many ids of members that end in one node make a row."""
    spark = rows.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.select("conv_id", "turns").repartitionByRange(partitions, "turns", "conv_id").sortWithinPartitions("turns", "conv_id")
    made = cut(ordered.mapInArrow(_patricia(chunk), PART), "trie")
    border = made.where("kind = 'border'").select("part", "place", "data")
    # a number for each task that has conversations
    used = sorted(r["part"] for r in border.where("place = 0").select("part").collect())
    pairs = spark.createDataFrame(list(zip(used, used[1:], strict=False)), "part bigint, after bigint")
    left = border.where("place = 1").join(F.broadcast(pairs), "part").select("after", F.col("data").alias("left"))
    right = border.where("place = 0").select(F.col("part").alias("after"), F.col("data").alias("right"))
    fixes = left.join(right, "after").select("left", "right").mapInArrow(_corrections, PART)
    summed = [F.sum(c).alias(c) for c in ("n", "leaves", "children", "shared")]
    columns = ["node", "depth", "parent", "n", "least", "leaves", "children", "shared", "before", "ends"]
    spine = (
        made.where("kind = 'spine'").select(*columns).unionByName(fixes.select(*columns)).groupBy("node")
        .agg(F.max("depth").alias("depth"), F.max("parent").alias("parent"), F.min("least").alias("least"), *summed, F.max("before").alias("before"), F.max("ends").alias("ends"))
    )
    ids = made.where("kind = 'ids'").select("node", "data", "part", "place").repartition("node").sortWithinPartitions("node", "part", "place")
    ends = cut(ids.select("node", "data").mapInArrow(_digests, "node binary, all_ends string"), "ends")
    points = join_small(made.where("kind = 'point'").select(*columns).unionByName(spine.select(*columns)), ends, ["node"])
    points = cut(points.withColumn("ends", F.coalesce("ends", "all_ends", F.lit(NO_ENDS))).drop("all_ends"), "points")
    total = points.count()
    hot = points.where(F.col("children") > max(total / 10_000, 1000)).select(F.col("node").alias("parent"))
    above = points.select(F.col("node").alias("parent"), F.col("least").alias("above"))
    known = join_hot(points, above, "parent", hot)
    # edges become nodes again: all but the last of an edge have one child, and no end
    nodes = known.select("*", F.posexplode("before").alias("i", "sum"))
    last = F.col("i") == F.size("before") - 1
    return nodes.select(
        F.col("least").alias("conv_id"),
        (F.col("depth") - F.size("before") + 1 + F.col("i")).cast("bigint").alias("depth"),
        F.when(F.col("i") == 0, F.col("above")).otherwise(F.col("least")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(last, F.col("children")).otherwise(F.lit(1)).cast("bigint").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("shared") - (F.col("n") - 1) * F.col("sum")).alias("saved_tokens"),
        F.when(last, F.col("ends")).otherwise(F.lit(NO_ENDS)).alias("ends_sha256"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(cut(paths(table(spark, sf_dir, "conversations")), "paths")))


#: crc32 of the number as text, bit by bit
_CRC = (
    "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),"
    " lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))))"
)
OP13_SQL = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
o AS (
  SELECT conv_id, md5(length(role) || ':' || role || text) AS said, length(text) AS size,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS i FROM t),
c AS (SELECT conv_id, {_CRC} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
  SELECT c.conv_id, 0 AS own, i, said, size FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % 100 AND i <= h
  UNION ALL SELECT c.conv_id, 1, i, said, size FROM c JOIN o ON o.conv_id = c.conv_id AND i > h),
s AS (SELECT conv_id, size, row_number() OVER w AS d, string_agg(said, '') OVER w AS path FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY own, i)),
p AS (
  SELECT conv_id, 0 AS d, '' AS path, 0 AS size FROM c
  UNION ALL SELECT conv_id, d, path, size FROM s),
n AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n, any_value(size) AS size FROM p GROUP BY path, d),
above AS (SELECT left(path, 32 * (d - 1)::INTEGER) AS path, count(*) AS children FROM n WHERE d > 0 GROUP BY 1),
m AS (SELECT n.*, coalesce(children, 0) AS children FROM n LEFT JOIN above USING (path)),
sub AS (
  SELECT a.path, sum((m.n - 1) * m.size) AS saved, sum(CASE WHEN m.children = 0 THEN 1 ELSE 0 END) AS leaves
  FROM m JOIN p a ON a.conv_id = m.conv_id AND a.d <= m.d GROUP BY a.path),
e AS (SELECT path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ends FROM (SELECT * FROM p QUALIFY d = max(d) OVER (PARTITION BY conv_id)) GROUP BY path)
SELECT m.conv_id, CAST(m.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, m.n AS n_convs, m.children AS n_children, CAST(sub.leaves AS BIGINT) AS n_leaves,
       CAST(sub.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ends, '')) AS ends_sha256
FROM m LEFT JOIN m u ON m.d > 0 AND u.path = left(m.path, 32 * (m.d - 1)::INTEGER) JOIN sub ON sub.path = m.path LEFT JOIN e ON e.path = m.path
"""
