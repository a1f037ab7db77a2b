"""Queries over the memory table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import FILLER_WORDS
from docloom.operators import memory_store
from docloom.plans.chunking import _DOC_SENTENCES
from docloom.plans.common import digest, table

_FIRST, _SECOND = "2030-01-01 00:00:00", "2030-01-02 00:00:00"


def salient_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = memory_store.salient_facts(table(spark, sf_dir, "documents"), ["doc_id"], "text")
    return found.select("doc_id", "fact_seq", digest("support_span").alias("span_md5"), "confidence")


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What `events` say of users, by hour: a session is a user and what came in time, or late (every third event)."""
    late = F.col("event_id") % 3 == 0
    session = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.when(late, "-late").otherwise(""))
    return table(spark, sf_dir, "events").select(
        session.alias("doc_id"), F.col("event_id").alias("seq_num"), F.lit("fact").alias("kind"), F.col("props").alias("content"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("subject"), F.col("event_type").alias("predicate"),
        F.col("props").alias("object"), F.date_trunc("hour", "ts").alias("effective_from"), late.alias("late"),
    )


def memory_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two writes of all facts: those in time, then the late ones, which lie between them."""
    rows = _facts(spark, sf_dir)
    once = memory_store.write(None, rows.where("NOT late").drop("late"), "ns", _FIRST)
    twice = memory_store.write(once, rows.where("late").drop("late"), "ns", _SECOND)
    return twice.select("id", "effective_from", "effective_to", "retracted", F.coalesce(F.day("retracted_at"), F.lit(0)).alias("retracted_day"))


def memory_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of conversations: turns are episodes, and that a role speaks after another is a fact."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("doc_id"), "turn", "role", "text")
    kinds = F.array(F.struct(F.lit("episode").alias("kind"), F.lit(0).alias("n")), F.struct(F.lit("fact").alias("kind"), F.lit(1).alias("n")))
    rows = turns.withColumn("k", F.explode(kinds)).select("doc_id", F.col("turn").alias("seq_num"), F.col("k.n").alias("n"), "k.kind", F.col("text").alias("content"), F.col("role").alias("subject"), F.lit("says").alias("predicate"), F.md5(F.col("text").cast("binary")).alias("object"))
    found = memory_store.records(memory_store.write(None, rows, "chat", _FIRST, tier="consolidated", order=("seq_num", "n", "content")))
    return found.select("source_id", digest("text").alias("text_md5"), F.size("chunks").alias("n_chunks"), F.size("relationships").alias("n_relationships"), F.array_join("entities", " ").alias("entities"))


_FILLERS = ", ".join("'" + w.replace("'", "''") + "'" for w in FILLER_WORDS)
QUERIES = {f.__name__: f for f in (salient_facts, memory_writes, memory_records)}
SQL = {
    "salient_facts": f"""WITH s AS (SELECT doc_id, unnest(range(0, len(s))) AS i, unnest(s) AS t FROM (SELECT doc_id, {_DOC_SENTENCES} AS s FROM documents)),
w AS (SELECT doc_id, i, unnest(list_filter(regexp_extract_all(lower(t), '[a-z0-9]+(?:-[a-z0-9]+)*'), lambda x: length(x) >= 2 AND x NOT IN ({_FILLERS}))) AS x FROM s),
c AS (SELECT doc_id, x, count(*) AS c FROM w GROUP BY ALL), p AS (SELECT doc_id, i, 1000 * sum(c)::BIGINT // count(*) AS score FROM w JOIN c USING (doc_id, x) GROUP BY doc_id, i),
b AS (SELECT doc_id, i FROM p QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) <= 10),
n AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM b)
SELECT doc_id, CAST(k AS INT) AS fact_seq, md5(t) AS span_md5, round(1 - k / n::DOUBLE, 3) AS confidence FROM n JOIN s USING (doc_id, i)""",
    "memory_writes": """WITH e AS (SELECT 'u' || user_id || CASE WHEN event_id % 3 = 0 THEN '-late' ELSE '' END AS doc_id, event_id, user_id, event_type, date_trunc('hour', ts) AS f, event_id % 3 = 0 AS late FROM events),
x AS (SELECT 'ns::' || doc_id || '::' || (row_number() OVER (PARTITION BY doc_id ORDER BY event_id) - 1) AS id, f AS effective_from, late,
  min(f) OVER (PARTITION BY user_id, event_type ORDER BY f RANGE BETWEEN INTERVAL 1 MICROSECOND FOLLOWING AND UNBOUNDED FOLLOWING) AS effective_to,
  min(f) FILTER (NOT late) OVER (PARTITION BY user_id, event_type ORDER BY f RANGE BETWEEN INTERVAL 1 MICROSECOND FOLLOWING AND UNBOUNDED FOLLOWING) AS known FROM e)
SELECT id, effective_from, effective_to, effective_to IS NOT NULL AS retracted, CAST(CASE WHEN effective_to IS NULL THEN 0 WHEN known IS NOT NULL AND NOT late THEN 1 ELSE 2 END AS INT) AS retracted_day FROM x""",
    "memory_records": """WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS k FROM conversations),
n AS (SELECT conv_id, unnest([role, md5(text)]) AS name, unnest([2 * k, 2 * k + 1]) AS pos FROM t WHERE role <> '' AND text IS NOT NULL), f AS (SELECT conv_id, name, min(pos) AS pos FROM n GROUP BY ALL), g AS (SELECT conv_id, string_agg(name, ' ' ORDER BY pos) AS entities FROM f GROUP BY conv_id)
SELECT 'memory:chat:' || conv_id AS source_id, md5(string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY k)) AS text_md5, CAST(count(*) AS INT) AS n_chunks, CAST(count(*) FILTER (role <> '' AND text IS NOT NULL) AS INT) AS n_relationships, coalesce(any_value(entities), '') AS entities
FROM t LEFT JOIN g USING (conv_id) GROUP BY conv_id""",
}
