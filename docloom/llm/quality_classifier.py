"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on each text. Expectation-maximisation over the counts of vote patterns of all
documents estimates how often each labeller casts each vote for good and for bad texts; the posterior of a pattern is the
label of the texts that have it. A linear scorer over hashed features (byte trigrams, and the texts' statistics in steps) is fit to
these labels by logistic regression, and scores every text.

Patterns are counted by Spark; there are at most 3 to the number of labellers, whatever the corpus. The scorer is fit on a
sample of ``fit_rows`` rows, half of them likely good and half likely bad as far as there are so many, chosen by hash of
the text; everything else sees every row and whole texts.

Defined cases: a null text is an empty one; with fewer than ten documents of either class to learn from, the score is the posterior; rows that repeat
are judged alike; further columns stay as they are, but for those named as the result's, which it replaces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import batches, cut, table
from docloom.llm.quality_rules import text_statistics

GOOD, BAD, NONE = 1, 0, 2
#: Frequent words of the languages of the corpus; texts in sentences hold many of them.
FUNCTION_WORDS = frozenset(
    "the of and to in is that for it was with as on be by this are from at an or der die das und den von zu mit auf für des dem im ein eine nicht "
    "le la les et un une que qui dans pour sur pas est du au par avec de el los del en y se las por con para su al lo".split()
)
LABELLERS = ("function words", "symbols", "capitals", "repeated words", "distinct words", "repeated lines", "word length")


def labels(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The votes of each labeller on each text, and the statistics as shares."""
    s = text_statistics(texts)
    n = len(texts)
    words, chars = np.maximum(s["q_words"], 1), np.maximum(s["q_chars"], 1)
    function = np.zeros(n)
    for i, text in enumerate(texts):
        if text.is_valid and s["q_words"][i]:
            function[i] = sum(map(FUNCTION_WORDS.__contains__, text.as_py().lower().split())) / words[i]
    shares = np.stack([function, s["q_symbols"] / words, s["q_upper"] / np.maximum(s["q_letters"], 1), s["q_repeat_words"] / words, s["q_distinct"] / words, s["q_dup_lines"] / np.maximum(s["q_lines"], 1), chars / words / 20]).T
    few = s["q_words"] < 10
    votes = np.full((n, len(LABELLERS)), NONE, np.int8)

    def vote(k: int, bad: np.ndarray, good: np.ndarray) -> None:
        votes[:, k] = np.where(bad, BAD, np.where(good, GOOD, NONE))

    vote(0, (function < 0.04) & ~few, function > 0.12)
    vote(1, shares[:, 1] > 0.15, shares[:, 1] < 0.05)
    vote(2, (shares[:, 2] > 0.4) & ~few, shares[:, 2] < 0.2)
    vote(3, (shares[:, 3] > 0.5) & ~few, shares[:, 3] < 0.2)
    vote(4, (s["q_distinct"] < 0.2 * np.minimum(words, 100)) & ~few, s["q_distinct"] > 0.4 * np.minimum(words, 100))
    vote(5, shares[:, 5] > 0.4, shares[:, 5] < 0.1)
    vote(6, (chars / words > 14) | (chars / words < 2.2), (chars / words < 10) & (chars / words > 3))
    return votes, shares


def hashed(texts: pa.Array, shares: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The features of each text: shares of its byte trigrams by hash, and a one for the step that each statistic is in."""
    steps = np.searchsorted(np.array([0.01, 0.03, 0.06, 0.12, 0.2, 0.35, 0.5, 0.75, 0.95]), shares)
    for text, own in zip(texts, steps, strict=True):
        raw = np.frombuffer(text.as_py().encode("utf-8", "surrogatepass") if text.is_valid else b"", np.uint8).astype(np.uint32)
        out = np.zeros(size)
        if len(raw) > 2:
            h = (raw[:-2] * np.uint32(0x9E3779B1)) ^ (raw[1:-1] * np.uint32(0x85EBCA77)) ^ (raw[2:] * np.uint32(0xC2B2AE3D))
            out += np.sqrt(np.bincount((h >> np.uint32(15)) % np.uint32(size), minlength=size) / len(h))
        np.add.at(out, (np.arange(len(own)) * 613 + own * 41 + 7) % size, 1.0)
        yield out


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """The posterior of good for each pattern, each labeller's vote rates (labeller, class, vote), and the share of good texts."""
    k = patterns.shape[1]
    onehot = np.stack([patterns == v for v in range(3)], axis=2).astype(float)  # pattern, labeller, vote
    good = (patterns == GOOD).sum(1) + 0.5
    bad = 3.0 * (patterns == BAD).sum(1) + 0.5
    post = good / (good + bad)
    rates, share = np.full((k, 2, 3), 1 / 3), 0.5
    for _ in range(rounds):
        weight = np.stack([counts * (1 - post), counts * post])
        rates = (np.einsum("cp,pkv->kcv", weight, onehot) + 1.0) / (weight.sum(1)[None, :, None] + 3.0)
        share = float((weight[1].sum() + 1) / (counts.sum() + 2))
        log = np.einsum("pkv,kcv->pc", onehot, np.log(rates)) + np.log([1 - share, share])
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -700, 700)))
        if np.abs(new - post).max() < 1e-6:
            post = new
            break
        post = new
    return post, rates, share


def classify(docs: DataFrame, text: str = "text", size: int = 2048, fit_rows: int = 6000, keep: list[str] | None = None) -> DataFrame:
    """The columns of docs (or those named in keep), with quality_label (the posterior of good, from the votes), quality_score (the
    scorer's probability of good) and quality_fitted (false only where docs has no rows: any text is enough to fit a scorer to)."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("quality_label", "quality_score", "quality_fitted")]
    packed = docs.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep) if c != text]).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    half = fit_rows // 2

    def votes(of: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in of:
            for batch in batches(whole, "text", 4 << 20):
                found, _ = labels(batch.column("text"))
                yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array(found @ 3 ** np.arange(len(LABELLERS)), pa.int64())], names=["h", "pattern"])

    voted = cut(packed.select(F.xxhash64("text").alias("h"), "text").mapInArrow(votes, "h bigint, pattern bigint"), "votes")
    counted = voted.groupBy("pattern").count().toPandas()
    codes = counted["pattern"].to_numpy(np.int64)
    patterns = (codes[:, None] // 3 ** np.arange(len(LABELLERS))) % 3
    post, _, share = expectation_maximisation(patterns, counted["count"].to_numpy(float)) if len(codes) else (np.zeros(0), None, 0.5)
    posterior = dict(zip(codes.tolist(), post.tolist(), strict=True))
    shared = docs.sparkSession.sparkContext.broadcast(posterior)
    spark, chosen = docs.sparkSession, []
    for good in (True, False):  # the texts with the least hashes of each side, found in the table of votes, which has no texts
        codes = [c for c, p in posterior.items() if (p > 0.5) == good]
        own = voted.where(F.col("pattern").isin(codes) if codes else F.lit(False)).select(F.xxhash64("h").alias("x"), "h").distinct()
        chosen += [(r["h"],) for r in own.orderBy("x").limit(half).collect()]
    weights, bias = None, 0.0
    if chosen:

        def examples(of: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in of:
                for batch in batches(whole, "text", 1 << 20):
                    texts = batch.column("text")
                    found, shares = labels(texts)
                    codes = (found @ 3 ** np.arange(len(LABELLERS))).tolist()
                    rows = [r.tolist() for r in hashed(texts, shares, size)]
                    yield pa.RecordBatch.from_arrays([pa.array([shared.value[c] for c in codes], pa.float64()), pa.array(rows, pa.list_(pa.float64()))], names=["p", "features"])

        # their texts are found where they lie: fit_rows hashes at most go to all tasks, and only these texts are dealt by hash
        wanted = F.broadcast(spark.createDataFrame(chosen, "h bigint"))
        rows = packed.select("text", F.xxhash64("text").alias("h")).join(wanted, "h", "left_semi").dropDuplicates(["h"]).select("text")
        rows = cut(rows.mapInArrow(examples, "p double, features array<double>"), "examples")
        total = rows.agg(F.sum("p").alias("good"), F.count("*").alias("n")).first()
        some = lambda x: max(x, 1e-9)
        good, bad = F.col("p") * (share / some(total["good"])), (1 - F.col("p")) * ((1 - share) / some(total["n"] - total["good"]))
        both = F.array(F.struct(F.lit(1.0).alias("label"), good.alias("w")), F.struct(F.lit(0.0).alias("label"), bad.alias("w")))
        # each example stands on both sides, so that there are two classes however few the texts are
        label = rows.select(array_to_vector("features").alias("features"), F.explode(both).alias("e")).select("features", "e.label", F.greatest(F.col("e.w") * total["n"], F.lit(1e-9)).alias("w"))
        model = LogisticRegression(weightCol="w", regParam=0.001, maxIter=60, standardization=False).fit(label)
        weights, bias = model.coefficients.toArray(), float(model.intercept)
    linear = docs.sparkSession.sparkContext.broadcast((weights, bias))

    def score(of: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = linear.value
        for whole in of:
            for batch in batches(whole, "text", 4 << 20):
                texts = batch.column("text")
                found, shares = labels(texts)
                label = np.array([shared.value[c] for c in (found @ 3 ** np.arange(len(LABELLERS))).tolist()])
                scores = 1 / (1 + np.exp(-np.clip(np.array([f @ weights for f in hashed(texts, shares, size)]) + bias, -700, 700)))
                yield pa.RecordBatch.from_arrays([batch.column("row"), texts if text in keep else pa.nulls(len(texts), texts.type), pa.array(label, pa.float64()), pa.array(scores, pa.float64())], names=["row", "text", "quality_label", "quality_score"])

    schema = packed.select("row", "text", F.lit(0.0).alias("quality_label"), F.lit(0.0).alias("quality_score")).schema
    columns = [F.col("text" if c == text else f"row.c{i}").alias(c) for i, c in enumerate(keep)]
    fitted = F.lit(weights is not None).alias("quality_fitted")
    return packed.mapInArrow(score, schema).select(*columns, "quality_label", "quality_score", fitted)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = classify(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return scored.select("doc_id", F.col("quality_label").alias("label"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).alias("kept"))
