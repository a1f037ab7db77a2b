"""Mixing sources to target weights by Pareto order sampling.

Each source has a target in words. Within a source, documents of larger ``importance`` are taken more often: their expected copies
are in proportion to it, but never over ``most``, and the expected words add up to the target. Whole copies are certain. The
remaining part p is an inclusion probability: documents are ranked by the odds of a uniform random number divided by the odds of p
(Pareto order sampling), and the first are taken until their words fill the rest of the target; so the sample's
size, in words, is fixed to within a document, and inclusion is close to p.

The random number is of the document's id (or text, where that is null), so runs agree. No source is sorted as a whole: words are summed over 256 intervals of the rank per
source, then over 256 parts of the interval where the target is reached; only the documents of that part are put in order. All of it is
DataFrame operations; the texts are read once, for their sizes.

Defined cases: null texts have size 0 and are never taken; null is a source like others, last in order; a null id draws by its
text; documents with equal ids, sources and sizes draw the same number, and which of them is taken is arbitrary (the result's rows are
the same); further columns are ignored, or kept by :func:`mix`; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.llm.common import cut, join_small, table

_STEPS = 256


def size_of(text: str) -> Column:
    """Number of words."""
    return F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("bigint")


def importance(size: str = "size") -> Column:
    """1 to 4 for texts of under 32, 256, 2048 and more words."""
    return F.when(F.col(size) < 32, 1).when(F.col(size) < 256, 2).when(F.col(size) < 2048, 3).otherwise(4)


def water_fill(groups: DataFrame, by: list[str], order: list[Column], total: str, weight: str, cap: str, out: str) -> DataFrame:
    """groups with `out`: of `total` (the same for all rows of by), a share in proportion to weight, but cap at most; what
    is over is shared by weight among the others, until no share is over. by may be empty: one group (of few rows)."""
    w = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    up = w.orderBy(F.col(cap) / F.col(weight), *order).rowsBetween(W.unboundedPreceding, W.currentRow)
    # with the rows before this one at their caps, it and the others get this much per weight; it falls from the first that stays open on
    level = (F.col(total) - F.sum(cap).over(up) + F.col(cap)) / (F.sum(weight).over(w) - F.sum(weight).over(up) + F.col(weight))
    rows = groups.withColumn("_lv", level).withColumn("_open", F.col("_lv") * F.col(weight) < F.col(cap))
    rows = rows.withColumn("_lv", F.max(F.when(F.col("_open"), F.col("_lv"))).over(w))
    return rows.withColumn(out, F.least(F.coalesce(F.col("_lv") * F.col(weight), F.col(cap)), F.col(cap)).cast("double")).drop("_lv", "_open")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """sources (source, source_size) with target. Sources in code point order, null last, have the weights in turn."""
    n = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last()))
    turn = F.array(*map(F.lit, weights))[F.pmod(n - 1, F.lit(len(weights)))].cast("double")
    rows = sources.withColumn("w", turn).withColumn("cap", F.col("source_size") * float(most)).withColumn("all", F.sum("source_size").over(W.partitionBy(F.lit(0))) * share)
    # an empty source has no room
    full = water_fill(rows.where("source_size > 0"), [], [F.col("source").asc_nulls_last()], "all", "w", "cap", "target")
    return full.select("source", "source_size", "target").union(rows.where("source_size = 0").select("source", "source_size", F.lit(0.0)))


def uniform(name: Column) -> Column:
    """A number between 0 and 1, from a name."""
    return (F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(16**13)


def sample(docs: DataFrame, targets: DataFrame, id: str = "doc_id", most: int = 2) -> DataFrame:
    """docs (id, source, size, the number drawn as _u, and more columns) with the sources' columns and `copies`. Both tables should be cheap
    to read again."""
    docs = docs.withColumn("_level", importance())
    levels = docs.where("size > 0").groupBy("source", "_level").agg(F.sum("size").alias("words"))
    levels = join_small(levels, targets.select("source", "target"), ["source"])
    levels = levels.withColumn("_weight", (F.col("_level") * F.col("words")).cast("double")).withColumn("_cap", F.col("words") * float(most))
    levels = water_fill(levels, ["source"], [F.col("_level")], "target", "_weight", "_cap", "_expected")
    levels = levels.withColumn("_rate", F.when(F.col("_expected") >= F.col("_cap"), F.lit(float(most))).otherwise(F.col("_expected") / F.col("words")))
    levels = levels.withColumn("_whole", F.floor("_rate")).withColumn("_p", F.col("_rate") - F.col("_whole"))
    rest = levels.groupBy("source").agg(F.max("target").alias("target"), F.sum(F.col("_whole") * F.col("words")).alias("whole")).select("source", (F.col("target") - F.col("whole")).alias("_rest"))
    levels = cut(levels.select("source", "_level", "_whole", "_p"), "levels")
    rows = join_small(docs, levels, ["source", "_level"])
    u = F.col("_u")
    odds = u / (1 - u) / (F.col("_p") / (1 - F.col("_p")))
    drawn = F.when((F.col("size") > 0) & (F.col("_p") > 0), odds)
    # rank as a part of 1: small odds first
    rows = rows.withColumn("_odds", drawn).withColumn("_part", F.col("_odds") / (1 + F.col("_odds")))
    fine = F.col("_part") * _STEPS
    rows = rows.withColumn("_a", F.least(F.floor(fine), F.lit(_STEPS - 1))).withColumn("_b", F.least(F.floor((fine - F.floor(fine)) * _STEPS), F.lit(_STEPS - 1)))
    rows = cut(rows.withColumn("_copies", F.when(F.col("size") > 0, F.coalesce("_whole", F.lit(0))).otherwise(0)).drop("_whole", "_p", "_level"), "ranked")
    ranked = rows.where("_odds IS NOT NULL")
    rest = cut(rest, "rest")

    def reached(sums: DataFrame, goal: DataFrame, step: str) -> DataFrame:
        """The step of each source at which the words pass the goal, and the goal that is left there."""
        before = F.sum("words").over(W.partitionBy("source").orderBy(step)) - F.col("words")
        up = join_small(sums, goal, ["source"]).withColumn("_before", before).where(F.col("_before") < F.col("_rest"))
        return cut(up.groupBy("source").agg(F.max(F.struct(step, (F.col("_rest") - F.col("_before")).alias("left"))).alias("x")).select("source", F.col(f"x.{step}").alias(f"_at{step}"), F.col("x.left").alias("_rest")), "reached")

    first = reached(ranked.groupBy("source", "_a").agg(F.sum("size").alias("words")), rest, "_a")
    here = join_small(ranked, first.select("source", "_at_a"), ["source"], "inner").where("_a = _at_a")
    second = reached(here.groupBy("source", "_b").agg(F.sum("size").alias("words")), first.select("source", "_rest"), "_b")
    edge = cut(first.select("source", "_at_a").join(second, ["source"], "left"), "edge")
    rows = join_small(rows, edge, ["source"])
    place = F.when(F.col("_odds").isNull(), 3).when(F.col("_at_a").isNull() | (F.col("_a") > F.col("_at_a")), 3).when(F.col("_a") < F.col("_at_a"), 1).when(F.col("_b") < F.col("_at_b"), 1).when(F.col("_b") > F.col("_at_b"), 3).otherwise(2)
    rows = cut(rows.withColumn("_place", place), "placed")
    order = W.partitionBy("source").orderBy("_odds", id, "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    # of the documents at the edge, those of which at least half fits
    last = rows.where("_place = 2").withColumn("_take", (F.sum("size").over(order) - F.col("size") / 2 <= F.col("_rest")).cast("int"))
    others = rows.where("_place != 2").withColumn("_take", (F.col("_place") == 1).cast("int"))
    out = others.unionByName(last).withColumn("copies", (F.col("_copies") + F.col("_take")).cast("int"))
    out = out.drop("_odds", "_part", "_a", "_b", "_copies", "_at_a", "_at_b", "_rest", "_place", "_take", "_u")
    return join_small(out, targets, ["source"])


def mixed(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """(id, source, size, copies, source_size, target) of each document."""
    # a document without an id draws by its text
    name = F.coalesce(F.col(f"`{id}`").cast("string"), F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")))
    columns = [F.col(f"`{id}`").alias(id), F.col(f"`{source}`").alias("source"), size_of(text).alias("size"), uniform(name).alias("_u")]
    sized = cut(docs.select(*columns), "sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    return sample(sized, cut(source_targets(sources, weights, share, most), "targets"), id, most)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP4_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) AS name, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS w, source_size * 2.0::DOUBLE AS cap, CAST(sum(source_size) OVER () AS BIGINT) * 1.5::DOUBLE AS total FROM src),
filled AS (
  SELECT *, (total - sum(cap) OVER up + cap) / (sum(w) OVER () - sum(w) OVER up + w) AS level FROM weighed WHERE source_size > 0
  WINDOW up AS (ORDER BY cap / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
targets AS (
  SELECT source, source_size, least(coalesce(max(level) FILTER (level * w < cap) OVER () * w, cap), cap) AS target FROM filled
  UNION ALL SELECT source, source_size, 0.0 FROM src WHERE source_size = 0),
leveled AS (
  SELECT s.*, t.source_size, t.target, CASE WHEN size < 32 THEN 1 WHEN size < 256 THEN 2 WHEN size < 2048 THEN 3 ELSE 4 END AS lv,
         (('0x' || substr(md5(name), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
groups AS (
  SELECT source, lv, target, CAST(sum(size) AS BIGINT) AS words, CAST(lv * sum(size) AS DOUBLE) AS gw, CAST(sum(size) AS DOUBLE) * 2.0 AS gcap FROM leveled WHERE size > 0 GROUP BY source, lv, target),
g2 AS (
  SELECT *, (target - sum(gcap) OVER up + gcap) / (sum(gw) OVER (PARTITION BY source) - sum(gw) OVER up + gw) AS level FROM groups
  WINDOW up AS (PARTITION BY source ORDER BY gcap / gw, lv ROWS UNBOUNDED PRECEDING)),
g3 AS (SELECT *, least(coalesce(max(level) FILTER (level * gw < gcap) OVER (PARTITION BY source) * gw, gcap), gcap) AS expected FROM g2),
rates AS (SELECT *, CASE WHEN expected >= gcap THEN 2.0 ELSE expected / words END AS rate FROM g3),
parts AS (SELECT source, lv, floor(rate) AS whole, rate - floor(rate) AS p, target - sum(floor(rate) * words) OVER (PARTITION BY source) AS rest FROM rates),
ranked AS (
  SELECT l.*, CASE WHEN size > 0 THEN coalesce(whole, 0) ELSE 0 END AS whole, rest,
         CASE WHEN size > 0 AND p > 0 THEN u / (1 - u) / (p / (1 - p)) END AS odds
  FROM leveled l LEFT JOIN parts r ON l.source IS NOT DISTINCT FROM r.source AND l.lv = r.lv),
taken AS (
  SELECT *, CASE WHEN odds IS NULL THEN 0 WHEN sum(size) OVER (PARTITION BY source, odds IS NULL ORDER BY odds, doc_id, size ROWS UNBOUNDED PRECEDING) - size / 2.0 <= rest THEN 1 ELSE 0 END AS more FROM ranked)
SELECT doc_id, size, source_size, target, CAST(size * (whole + more) AS BIGINT) AS taken FROM taken
"""
