"""Session memory: staging of events, sessions that are due, facts and what replaces them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.operators.chunkers import facts


def staged(events: DataFrame, session: str, seq: str, content: str) -> DataFrame:
    """events with event_id, a hash of session, number and content; each id once."""
    id = F.sha1(F.concat(F.col(session).cast("string"), F.lit("\x00"), F.col(seq).cast("string"), F.lit("\x00"), F.col(content)).cast("binary"))
    return events.withColumn("event_id", id).dropDuplicates(["event_id"])


def session_documents(events: DataFrame, session: str, seq: str, role: str, content: str) -> DataFrame:
    """A document for each session: its turns in order, one a line."""
    turn = F.struct(F.col(seq).alias("n"), F.concat(F.lit("["), F.col(role), F.lit("] "), F.col(content)).alias("line"))
    lines = F.transform(F.sort_array(F.collect_list(turn)), lambda x: x["line"])
    return events.groupBy(session).agg(F.array_join(lines, "\n").alias("content"), F.count("*").alias("turns"))


def due_sessions(events: DataFrame, session: str, ts: str, consumed: DataFrame, now: str, min_age: str) -> DataFrame:
    """Sessions that were quiet for min_age before now and have events after what was consumed (session, consumed_at), if anything was."""
    last = events.groupBy(session).agg(F.max(ts).alias("last_ts"), F.count("*").alias("n_events"))
    quiet = last.where(F.col("last_ts") < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {min_age}"))
    return quiet.join(consumed, session, "left").where(F.col("consumed_at").isNull() | (F.col("last_ts") > F.col("consumed_at"))).drop("consumed_at")


def extracted_facts(events: DataFrame, keys: list[str], content: str) -> DataFrame:
    return events.select(*keys, F.posexplode(facts(F.col(content))).alias("fact_seq", "fact"))


def superseded(rows: DataFrame, by: list[str], start: str) -> DataFrame:
    """rows with effective_to, the start of the next row of the same key, and retracted, whether there is one that begins later."""
    later = F.min(F.col(start)).over(W.partitionBy(*by).orderBy(F.unix_micros(F.col(start).cast("timestamp"))).rangeBetween(1, W.unboundedFollowing))
    return rows.withColumn("effective_to", later).withColumn("retracted", F.col("effective_to").isNotNull())


def rebuilt(existing: DataFrame, incoming: DataFrame, document: list[str]) -> DataFrame:
    """The memory after documents came in anew: their old rows go, the new ones stand for them."""
    return existing.join(incoming.select(*document).distinct(), document, "left_anti").unionByName(incoming, allowMissingColumns=True)


def read_consolidated(rows: DataFrame, session: str) -> DataFrame:
    """Rows not retracted; of a session that has consolidated rows, only those."""
    live = rows.where(~F.coalesce(F.col("retracted"), F.lit(False)))
    some = F.max((F.col("tier") == "consolidated").cast("int")).over(W.partitionBy(session))
    return live.withColumn("_some", some).where((F.col("_some") == 0) | (F.col("tier") == "consolidated")).drop("_some")


def pruned_staging(events: DataFrame, session: str, ts: str, consumed: DataFrame, before: str) -> DataFrame:
    """What stays of staged events: all but those before a time whose session was consumed since (session, consumed_at)."""
    rows = events.join(consumed, session, "left")
    gone = (F.col(ts) < F.lit(before).cast("timestamp")) & (F.col(ts) <= F.col("consumed_at"))
    return rows.where(~F.coalesce(gone, F.lit(False))).select(*events.columns)


def numbered(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """rows with seq_num, on from frame to frame: the numbers of a document's frames follow each other."""
    return rows.withColumn("seq_num", F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1)
