"""Chunk tables: merges whose result is a DataFrame to publish as the new version of the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def merge(existing: DataFrame, incoming: DataFrame, delete_orphans: bool = False) -> DataFrame:
    """The table after an upsert on id (doc_id, seq_num, source, created_at, and more). Source and creation time are written once.
    delete_orphans: of documents that come in, chunks numbered at or beyond the new count go."""
    kept = existing.join(incoming.select("id"), "id", "left_anti")
    if delete_orphans:
        counts = incoming.groupBy("doc_id").agg(F.count("*").alias("_n"))
        kept = kept.join(counts, "doc_id", "left").where(F.col("_n").isNull() | (F.col("seq_num") < F.col("_n"))).drop("_n")
    before = existing.select("id", F.col("source").alias("_source"), F.col("created_at").alias("_created"))
    merged = incoming.join(before, "id", "left").withColumn("source", F.coalesce("_source", "source")).withColumn("created_at", F.coalesce("_created", "created_at")).drop("_source", "_created")
    return kept.select(*existing.columns).unionByName(merged, allowMissingColumns=True)


def append_preflight(existing: DataFrame, incoming: DataFrame, promoted: list[str] = ()) -> None:
    """Raises unless incoming can be appended: a source, the columns, vectors as long as those there."""
    missing = [c for c in ("source", *promoted) if c not in existing.columns]
    if missing:
        raise ValueError(f"the table lacks {missing}")
    if "embedding" in existing.columns:
        size = lambda df: df.select(F.size("embedding").alias("n")).where("n >= 0").first()
        a, b = size(existing), size(incoming)
        if a and b and a["n"] != b["n"]:
            raise ValueError(f"vectors of {b['n']} parts don't go into a table of {a['n']}")


def foreign_sources(existing: DataFrame, source: str, most: int = 10) -> list[str]:
    """Sources in the table other than this one; overwriting it would lose them."""
    return [r[0] for r in existing.where(~F.col("source").eqNullSafe(source)).select("source").distinct().orderBy("source").limit(most).collect()]


def overwrite(existing: DataFrame, incoming: DataFrame, source: str, force: bool = False) -> DataFrame:
    if not force and (others := foreign_sources(existing, source)):
        raise ValueError(f"the table holds rows of {others}")
    return incoming


def compact(rows: DataFrame, key: str = "id", version: str = "created_at") -> DataFrame:
    """The latest row of each key, of a table that only ever got rows added."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(F.desc(version)))).where("_r = 1").drop("_r")


def delete_documents(existing: DataFrame, ids: DataFrame, source: str | None = None) -> DataFrame:
    """The table without these documents and their frames (id#n), of one source if given."""
    base = F.regexp_extract(F.col("doc_id").cast("string"), "^[^#]*", 0)
    rows = existing.withColumn("_base", base)
    mine = rows.where(F.col("source").eqNullSafe(source)) if source is not None else rows
    rest = rows.where(~F.col("source").eqNullSafe(source)) if source is not None else None
    kept = mine.join(ids.select(F.col("doc_id").cast("string").alias("_base")).distinct(), "_base", "left_anti")
    return (kept.unionByName(rest) if rest is not None else kept).select(*existing.columns)


def promote(rows: DataFrame, paths: dict[str, str], metadata: str = "metadata") -> DataFrame:
    """rows with a column for each JSON path (dots become double underscores), of the type given."""
    return rows.withColumns({path.replace(".", "__"): F.get_json_object(metadata, f"$.{path}").cast(kind) for path, kind in paths.items()})


def documents_rollup(chunks: DataFrame) -> DataFrame:
    """A row per document: characters, estimated tokens, chunks, and a hash over its chunks in order."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("seq_num", F.sha2(F.col("original_content").cast("binary"), 256).alias("h")))), lambda x: x["h"])
    chars = F.sum(F.length("original_content").cast("bigint"))
    return chunks.groupBy("doc_id").agg(chars.alias("char_count"), F.greatest(F.lit(1), F.ceil(chars / 4)).cast("bigint").alias("token_count_est"), F.count("*").alias("chunk_count"), F.sha2(F.array_join(parts, ",").cast("binary"), 256).alias("content_hash"))
