"""What the queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.shared import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in ("documents", "pages") else rows


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as (doc_id, content, title, metadata)."""
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"), F.col("source").alias("title"), F.to_json(F.struct("lang", "source")).alias("metadata"))


def digest(c: str | Column) -> Column:
    """Texts are compared by digest."""
    return F.md5((F.col(c) if isinstance(c, str) else c).cast("binary"))
