"""Queries over framers and chunkers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import sentences
from docloom.operators import chunkers, framers
from docloom.plans.common import corpus, digest, table


def _chunks(rows: DataFrame, *more: str, id: str = "doc_id") -> DataFrame:
    return rows.select(id, "seq_num", digest("original_content").alias("original_md5"), digest("embedded_content").alias("embedded_md5"), *more)


def frame_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return framers.identity(corpus(spark, sf_dir)).select("doc_id", "framer", "frame_seq", digest("content").alias("content_md5"))


def frame_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of a document that begins in T stands for a heading, as documents hold few."""
    docs = corpus(spark, sf_dir).withColumn("content", F.regexp_replace("content", "(?m)^T", "# T"))
    return framers.heading_boundary(docs).select("frame_id", "framer", "frame_seq", digest(F.coalesce("title", F.lit(""))).alias("title_md5"), digest("text").alias("text_md5"))


def frame_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return framers.regex_boundary(corpus(spark, sf_dir), "^[A-E]").select("frame_id", "framer", "frame_seq", digest("text").alias("text_md5"))


def frame_json_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return framers.json_path(table(spark, sf_dir, "events"), "event_id", "props", "$.k")


def frame_session_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = framers.session_gap(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", "6 hours")
    return rows.groupBy("user_id", "episode").agg(F.count("*").alias("n_events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def frame_session_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = framers.session_episodes(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", "role", max_turns=3, max_words=120)
    return rows.select("conv_id", "episode", "first_turn", "last_turn", digest("text").alias("text_md5"))


def chunk_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(chunkers.by_sentence(corpus(spark, sf_dir)))


def chunk_fixed_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(chunkers.fixed_overlap(corpus(spark, sf_dir)), "start_word", "n_words")


def chunk_neighbor_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(chunkers.neighbor_expand(chunkers.fixed_overlap(corpus(spark, sf_dir), window=100, step=100)))


def chunk_sentence_aware(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(chunkers.sentence_aware(corpus(spark, sf_dir), max_chars=1000))


def chunk_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus(spark, sf_dir).withColumn("content", F.regexp_replace("content", "(?m)^T", "# T"))
    rows = chunkers.hierarchy(framers.heading_boundary(docs))
    return rows.select("frame_id", "section_part", digest("original_content").alias("original_md5"), digest("embedded_content").alias("embedded_md5"))


def chunk_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(chunkers.semantic(corpus(spark, sf_dir)))


def chunk_summary_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(chunkers.summary_embed(chunkers.fixed_overlap(corpus(spark, sf_dir)), 200))


def chunk_hierarchical_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(chunkers.hierarchical_summary(chunkers.fixed_overlap(corpus(spark, sf_dir), window=100, step=100), max_length=10_000), "group_id", "granularity")


def chunk_hierarchical_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(chunkers.hierarchical_summary(chunkers.by_sentence(corpus(spark, sf_dir)), max_length=10**9, max_words=60), "group_id", "granularity")


def chunk_if_oversize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(chunkers.if_oversize(chunkers.fixed_overlap(corpus(spark, sf_dir)), ceiling=500), "parent_seq")


def chunk_consolidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(chunkers.consolidation(corpus(spark, sf_dir)), "kind")


def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("doc_id", F.size(sentences(F.col("content"))).alias("n_sentences"))


_SENTENCES = r"list_filter(list_transform(string_split(regexp_replace({t}, '([.!?])\s+', '\1' || chr(31), 'g'), chr(31)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"
_DOC_SENTENCES = _SENTENCES.format(t="text")
_WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')"


def _windows(window: int, step: int) -> str:
    return f"""w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(0, CAST(greatest(ceil((len(w) - {window}) / {step}::DOUBLE), 0) AS BIGINT) + 1)) AS seq_num FROM w WHERE len(w) > 0),
chunks AS (SELECT doc_id, CAST(seq_num AS INT) AS seq_num, CAST(seq_num * {step} AS INT) AS start_word, w[seq_num * {step} + 1 : seq_num * {step} + {window}] AS part FROM starts),
texts AS (SELECT doc_id, seq_num, start_word, CAST(len(part) AS INT) AS n_words, array_to_string(part, ' ') AS t FROM chunks)"""


_MARKED = r"string_split(regexp_replace({t}, '(^|\n)({p})', '\1' || chr(31) || '\2', 'g'), chr(31))"
_HEADED = r"regexp_replace(text, '(^|\n)T', '\1# T', 'g')"
_TRIM = r"regexp_replace({t}, '^\s+|\s+$', '', 'g')"

QUERIES = {
    f.__name__: f
    for f in (frame_identity, frame_heading, frame_regex, frame_json_path, frame_session_gap, frame_session_episodes, sentence_counts, chunk_sentences, chunk_fixed_overlap, chunk_neighbor_expand, chunk_sentence_aware, chunk_hierarchy, chunk_semantic, chunk_summary_embed, chunk_hierarchical_summary, chunk_hierarchical_words, chunk_if_oversize, chunk_consolidation)
}
SQL = {
    "frame_identity": "SELECT doc_id, 'identity' AS framer, CAST(0 AS INT) AS frame_seq, md5(text) AS content_md5 FROM documents",
    "frame_heading": rf"""
WITH p AS (SELECT doc_id, {_MARKED.format(t=_HEADED, p=r'#+\s')} AS parts FROM documents),
r AS (SELECT doc_id, unnest(range(0, len(parts))) AS piece, len(parts) AS n, unnest(parts) AS part FROM p),
h AS (SELECT doc_id, piece, n, CASE WHEN piece > 0 THEN regexp_extract(part, '^[^\n]*') END AS heading,
      {_TRIM.format(t=r"CASE WHEN piece > 0 THEN regexp_replace(part, '^[^\n]*\n?', '') ELSE part END")} AS body FROM r),
t AS (SELECT *, CASE WHEN heading IS NULL THEN body WHEN body = '' THEN heading ELSE heading || chr(10) || chr(10) || body END AS text FROM h),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY piece) - 1 AS seq, max(piece) OVER (PARTITION BY doc_id) > 0 AS split FROM t WHERE text <> '')
SELECT CASE WHEN split THEN doc_id || '#' || seq ELSE CAST(doc_id AS VARCHAR) END AS frame_id, 'heading_boundary' AS framer, CAST(seq AS INT) AS frame_seq,
       md5(coalesce(regexp_replace(heading, '^#+\s+', ''), '')) AS title_md5, md5(text) AS text_md5 FROM f""",
    "frame_regex": rf"""
WITH p AS (SELECT doc_id, {_MARKED.format(t='text', p='[A-E]')} AS parts FROM documents),
r AS (SELECT doc_id, unnest(range(0, len(parts))) AS piece, unnest(parts) AS part FROM p),
t AS (SELECT doc_id, piece, {_TRIM.format(t='part')} AS text FROM r WHERE piece > 0),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY piece) - 1 AS seq FROM t WHERE text <> '')
SELECT doc_id || '#' || seq AS frame_id, 'regex_boundary' AS framer, CAST(seq AS INT) AS frame_seq, md5(text) AS text_md5 FROM f""",
    "frame_json_path": "SELECT event_id || '#0' AS frame_id, 'json_path' AS framer, CAST(0 AS INT) AS frame_seq, json_extract_string(props, '$.k') AS text FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL",
    "frame_session_gap": """
WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts > lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS o FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
e AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - 1 AS episode FROM g)
SELECT user_id, CAST(episode AS BIGINT) AS episode, count(*) AS n_events, min(ts) AS first_ts, max(ts) AS last_ts FROM e GROUP BY user_id, episode""",
    "frame_session_episodes": r"""
WITH RECURSIVE t AS (
  SELECT conv_id, turn, '[' || role || '] ' || text AS line, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS n,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, '[' || role || '] ' || text) AS rn FROM conversations),
e AS (
  SELECT conv_id, turn, line, rn, 0 AS episode, 1 AS turns, n AS words FROM t WHERE rn = 1
  UNION ALL
  SELECT t.conv_id, t.turn, t.line, t.rn, CASE WHEN e.turns >= 3 OR e.words >= 120 THEN e.episode + 1 ELSE e.episode END,
         CASE WHEN e.turns >= 3 OR e.words >= 120 THEN 1 ELSE e.turns + 1 END, CASE WHEN e.turns >= 3 OR e.words >= 120 THEN t.n ELSE e.words + t.n END
  FROM e JOIN t ON t.conv_id = e.conv_id AND t.rn = e.rn + 1)
SELECT conv_id, CAST(episode AS INT) AS episode, min(turn) AS first_turn, max(turn) AS last_turn, md5(string_agg(line, chr(10) ORDER BY rn)) AS text_md5 FROM e GROUP BY conv_id, episode""",
    "sentence_counts": f"SELECT doc_id, CAST(len({_DOC_SENTENCES}) AS INT) AS n_sentences FROM documents",
    "chunk_sentences": f"""
WITH s AS (SELECT doc_id, {_DOC_SENTENCES} AS s FROM documents)
SELECT doc_id, CAST(unnest(range(0, len(s))) AS INT) AS seq_num, md5(unnest(s)) AS original_md5, md5(unnest(s)) AS embedded_md5 FROM s""",
    "chunk_fixed_overlap": f"WITH {_windows(300, 150)} SELECT doc_id, seq_num, md5(t) AS original_md5, md5(t) AS embedded_md5, start_word, n_words FROM texts",
    "chunk_neighbor_expand": f"""WITH {_windows(100, 100)}
SELECT doc_id, seq_num, md5(t) AS original_md5, md5(string_agg(t, chr(10) || chr(10)) OVER (PARTITION BY doc_id ORDER BY seq_num ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) AS embedded_md5 FROM texts""",
    "chunk_hierarchical_summary": f"""WITH {_windows(100, 100)},
fine AS (SELECT doc_id, CAST(floor(seq_num / 5) AS INT) AS g, seq_num AS pos, t, t AS e, 'fine' AS granularity FROM texts),
joined AS (SELECT doc_id, g, 2147483647 AS pos, string_agg(t, chr(10) || chr(10) ORDER BY pos) AS t, 'coarse' AS granularity FROM fine GROUP BY doc_id, g),
coarse AS (SELECT doc_id, g, pos, t, array_to_string({_SENTENCES.format(t="t")}, ' ') AS e, granularity FROM joined),
u AS (SELECT * FROM fine UNION ALL SELECT doc_id, g, pos, t, e, granularity FROM coarse)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY g, pos) - 1 AS INT) AS seq_num, md5(t) AS original_md5, md5(e) AS embedded_md5, doc_id || '::g' || g AS group_id, granularity FROM u""",
    "chunk_hierarchical_words": f"""
WITH RECURSIVE s AS (SELECT doc_id, {_DOC_SENTENCES} AS s FROM documents),
c AS (SELECT doc_id, unnest(range(0, len(s))) AS pos, unnest(s) AS t FROM s),
n AS (SELECT *, len(list_filter(regexp_split_to_array(t, '\\s+'), lambda w: w <> '')) AS n FROM c),
f AS (
  SELECT doc_id, pos, t, n AS words, 0 AS g FROM n WHERE pos = 0
  UNION ALL
  SELECT n.doc_id, n.pos, n.t, CASE WHEN f.words + n.n > 60 THEN n.n ELSE f.words + n.n END, CASE WHEN f.words + n.n > 60 THEN f.g + 1 ELSE f.g END
  FROM f JOIN n ON n.doc_id = f.doc_id AND n.pos = f.pos + 1),
joined AS (SELECT doc_id, g, 2147483647 AS pos, string_agg(t, chr(10) || chr(10) ORDER BY pos) AS t FROM f GROUP BY doc_id, g),
u AS (SELECT doc_id, g, pos, t, t AS e, 'fine' AS granularity FROM f
  UNION ALL SELECT doc_id, g, pos, t, array_to_string({_SENTENCES.format(t="t")}, ' '), 'coarse' FROM joined)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY g, pos) - 1 AS INT) AS seq_num, md5(t) AS original_md5, md5(e) AS embedded_md5, doc_id || '::g' || g AS group_id, granularity FROM u""",
    "chunk_if_oversize": f"""WITH {_windows(300, 150)},
parts AS (SELECT doc_id, seq_num AS parent_seq, unnest(range(0, CAST(ceil(length(t) / 500.0) AS BIGINT))) AS part, t FROM texts)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY parent_seq, part) - 1 AS INT) AS seq_num, md5(substr(t, part * 500 + 1, 500)) AS original_md5, md5(substr(t, part * 500 + 1, 500)) AS embedded_md5, parent_seq FROM parts""",
    "chunk_consolidation": f"""
WITH s AS (SELECT doc_id, {_DOC_SENTENCES} AS s FROM documents),
x AS (SELECT doc_id, list_concat([array_to_string(s[1:4], ' ')], list_transform(list_filter(s, lambda y: len(list_filter(regexp_split_to_array(y, '\\s+'), lambda w: w <> '')) >= 4), lambda y: y[1:1200])) AS x FROM s),
u AS (SELECT doc_id, unnest(range(0, len(x))) AS i, unnest(x) AS t FROM x)
SELECT doc_id, CAST(i AS INT) AS seq_num, md5(t) AS original_md5, md5(t) AS embedded_md5, CASE WHEN i = 0 THEN 'episode' ELSE 'fact' END AS kind FROM u""",
}
