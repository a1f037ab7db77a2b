"""Tables as documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DOCUMENT = ("doc_id", "content", "title", "metadata")


def table_source(rows: DataFrame, id: str, content: str, title: str | None = None, metadata: tuple[str, ...] = (), where: str | None = None) -> DataFrame:
    """rows (of a table or of spark.read.jdbc) as documents: expressions for id, content and title, columns for the metadata, and a
    condition that reaches the scan."""
    rows = rows.where(where) if where else rows
    extra = F.to_json(F.struct(*metadata)) if metadata else F.lit("{}")
    return rows.select(F.expr(id).cast("string").alias("doc_id"), F.expr(content).cast("string").alias("content"), (F.expr(title) if title else F.lit(None)).cast("string").alias("title"), extra.alias("metadata"))


def together(*sources: DataFrame) -> DataFrame:
    """Documents of several sources, each with its place in the list."""
    out = [s.withColumn("source_index", F.lit(i)) for i, s in enumerate(sources)]
    first = out[0]
    for other in out[1:]:
        first = first.unionByName(other, allowMissingColumns=True)
    return first
