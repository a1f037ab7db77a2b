"""A corpus pipeline of five of the operators: each stage takes what its predecessor kept.

Rows are told apart by all their columns, not by doc_id: ids may be null or repeat. Rows alike in all columns are one after the second stage; a stage
that meets some keeps each. Null and empty texts are documents like others (the classifier and the mix decide on them); very long texts are taken whole; an
empty table stays empty. Columns other than those of documents are left out of the result, which has `copies` besides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import cut, join_small, table
from docloom.llm.decontaminate import decontaminate
from docloom.llm.mixing import mixed
from docloom.llm.near_duplicates import near_duplicates
from docloom.llm.quality_classifier import classify
from docloom.llm.secrets import redact
from docloom.shared import cuts, drop_cuts

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars after the text."""
    return docs.select("doc_id", "text", "lang", "source", F.char_length("text").cast("bigint").alias("n_chars"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return classify(docs).where("quality_score >= 0.5").select(*COLUMNS)


def _key():
    """A key of each row: ids come first, by number, then rows without one; a digest of all columns tells apart those of the same id."""
    said = lambda c: F.md5(F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).cast("binary"))
    number = F.lpad(F.hex(F.col("doc_id").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat_ws(":", F.coalesce(number, F.lit("none")), F.md5(F.concat(*[said(c) for c in COLUMNS]).cast("binary")))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: the one with the least doc_id (one without an id only where none has one), and of
    those with the same id that of the least digest. Different documents stay, ids may be null or repeat; rows alike in all columns are one."""
    keyed = docs.select(*COLUMNS, _key().alias("key"))
    leaders = near_duplicates(keyed, id="key").where("key = class_id").select("key").distinct()
    return keyed.join(leaders, "key", "left_semi").dropDuplicates(["key"]).select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that are mostly such passages go."""
    return _documents(decontaminate(docs, table(spark, sf_dir, "benchmark"), max_span_words=10, max_coverage=0.5))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked."""
    return _documents(redact(docs))


def numbered(docs: DataFrame) -> DataFrame:
    """docs with a key of each row. Rows alike in all columns are counted and told apart by number; only the keys are shuffled."""
    keyed = docs.select(*COLUMNS, _key().alias("key"))
    again = cut(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "again")
    if again.isEmpty():
        return keyed
    rows = join_small(keyed, again, ["key"])
    alike = rows.where("n > 1").groupBy("key").agg(*[F.first(c).alias(c) for c in [*COLUMNS, "n"]]).withColumn("i", F.explode(F.expr("sequence(1L, n)")))
    return rows.where("n IS NULL").select(*COLUMNS, "key").unionByName(alike.select(*COLUMNS, F.concat_ws(":", "key", "i").alias("key")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights. Each document that is taken, once, and how often (copies)."""
    keyed = numbered(docs)
    taken = mixed(keyed, id="key").where("copies > 0").select("key", "copies")
    return keyed.join(taken, "key").select(*COLUMNS, "copies")


STAGES = [("quality classifier", quality), ("near duplicates", deduplicate), ("benchmark decontamination", benchmark), ("secret scans", secrets), ("mixing", mix)]

#: The classifier is trained, which SQL does not express. Tests hold the operators of the other stages against SQL or brute force; the stages run on
#: a small table, where what each keeps and its columns are looked at, and near duplicates also on a fixture of repeated and missing ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), cuts(spark)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs, f"stage{i}")
            # what the stage wrote on its way is not read again
            drop_cuts(spark, [path for path in cuts(spark) if path not in before][:-1])
    return docs
