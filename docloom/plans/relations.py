"""Queries over sources, graphs, tables, memory, increments, streams and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import chunkers, evaluation, graph, html, incremental, ingest, memory, search, tables
from docloom.operators.gazetteer import find_names
from docloom.operators.chunkers import fixed_overlap
from docloom.plans.common import corpus, digest, table
from docloom.plans.chunking import _DOC_SENTENCES, _SENTENCES, _windows
from docloom.plans.searching import _BM25, K, fts_bm25_topk
from docloom.shared import fresh_path
from docloom.sources.tables import table_source
from docloom.streaming import events as streams


def src_table_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_source(table(spark, sf_dir, "orders"), "o_orderkey", "concat_ws(' ', o_orderpriority, o_orderstatus)", "o_orderpriority", ("o_orderstatus", "o_custkey"), "o_totalprice > 100000 AND o_orderstatus = 'F'")


def src_json_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table_source(table(spark, sf_dir, "documents"), "doc_id", "text", None, ("lang", "source", "n_chars"))
    return rows.select("doc_id", digest("content").alias("content_md5"), "metadata")


def src_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", digest(html.text(F.col("html"))).alias("text_md5"))


def src_html_title_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = F.transform(html.links(F.col("html")), lambda u: html.absolute(F.col("url"), u))
    return pages.select("page_id", html.title(F.col("html")).alias("title"), F.size(found).alias("n_links"), F.array_join(found, " ").alias("links"))


def crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers are pages; the one a customer links to has the key a third as large, or half, or that plus one; the crawl begins at the largest keys."""
    pages = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("url"))
    links = pages.select("url", F.explode(F.array(F.floor(F.col("url") / 3), F.floor(F.col("url") / 2), F.col("url") + 1)).alias("to")).where("url != to")
    top = pages.agg(F.max("url").alias("m"))
    seeds = pages.crossJoin(F.broadcast(top)).where("url > m - 20").select("url")
    return graph.crawl(pages, links, seeds, 3)


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts call those of half and a third of their key; suppliers' nations tell the kind."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("src"), F.col("p_retailprice").alias("price"))
    return parts.select("src", F.explode(F.array(F.floor(F.col("src") / 2), F.floor(F.col("src") / 3))).alias("dst"), (F.pmod(F.col("src") * 7, F.lit(10)) / 10.0).alias("confidence"), F.concat(F.lit("e"), F.col("src").cast("string")).alias("evidence"), F.when(F.col("src") % 2 == 0, "calls").otherwise("extends").alias("kind")).where("dst > 0")


def _impact(direction: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        anchors = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("anchor"))
        return graph.impact(_edges(spark, sf_dir), anchors, 4, direction, 0.3)

    return run


def impact_of_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchors = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("anchor"))
    return graph.impact(_edges(spark, sf_dir), anchors, 3, "callees", 0.1, ["calls"])


def resolve_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts are calls by brand and type, suppliers are symbols; nations are files."""
    symbols = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("fqn"), F.concat(F.lit("f"), (F.col("s_suppkey") % 61).cast("string")).alias("name"), F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("stem"))
    calls = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("call_id"), F.concat(F.lit("p"), (F.col("p_partkey") % 400).cast("string")).alias("caller"), F.concat(F.lit("f"), (F.col("p_partkey") % 83).cast("string")).alias("callee"), F.array(F.concat(F.lit("n"), (F.col("p_partkey") % 25).cast("string")), F.concat(F.lit("n"), (F.col("p_partkey") % 7).cast("string"))).alias("imports"))
    return graph.resolve_names(calls, symbols)


def _chunk_table(spark: SparkSession, sf_dir: str, size: int, source: str, day: str) -> DataFrame:
    rows = fixed_overlap(corpus(spark, sf_dir), window=size, step=size)
    return rows.select(F.concat_ws("::", F.col("doc_id").cast("string"), F.col("seq_num").cast("string")).alias("id"), "doc_id", "seq_num", "original_content", F.lit(source).alias("source"), F.lit(day).cast("timestamp").alias("created_at"))


def _merged(spark: SparkSession, sf_dir: str, orphans: bool) -> DataFrame:
    """A table of chunks of 100 words gets French documents anew, in chunks of 200 words."""
    french = table(spark, sf_dir, "documents").where("lang = 'fr'").select("doc_id")
    incoming = _chunk_table(spark, sf_dir, 200, "second", "2024-02-01").join(french, "doc_id", "left_semi")
    out = tables.merge(_chunk_table(spark, sf_dir, 100, "first", "2024-01-01"), incoming, orphans)
    return out.select("id", "seq_num", digest("original_content").alias("content_md5"), "source", "created_at")


def upsert_write_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir, False)


def delete_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir, True)


def compact_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("id"), F.struct("ts", "event_id").alias("created_at"), "event_id", "value")
    return tables.compact(rows).select("id", "event_id", "value")


def delete_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    existing = _chunk_table(spark, sf_dir, 100, "first", "2024-01-01").withColumn("doc_id", F.when(F.col("seq_num") % 2 == 0, F.concat_ws("#", F.col("doc_id").cast("string"), F.col("seq_num").cast("string"))).otherwise(F.col("doc_id").cast("string")))
    gone = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id")
    return tables.delete_documents(existing, gone, "first").select("id", "doc_id")


def foreign_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tables.foreign_sources(table(spark, sf_dir, "documents"), "src1")
    return spark.createDataFrame([(s,) for s in found], "source string")


def promote_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.promote(table(spark, sf_dir, "events"), {"k": "int", "no.such": "string"}, "props").select("event_id", "k", F.col("no__such").isNull().alias("missing"))


def documents_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.documents_rollup(fixed_overlap(corpus(spark, sf_dir), window=100, step=100))


def stage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn is staged twice."""
    turns = table(spark, sf_dir, "conversations")
    return memory.staged(turns.unionByName(turns), "conv_id", "turn", "text").select("event_id", "conv_id", "turn")


def session_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.session_documents(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text").select("conv_id", digest("content").alias("content_md5"), "turns")


def due_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    consumed = events.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("consumed_at"))
    return memory.due_sessions(events, "user_id", "ts", consumed, "2024-01-31 00:00:00", "24 hours")


def extracted_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.extracted_facts(table(spark, sf_dir, "conversations"), ["conv_id", "turn"], "text").select("conv_id", "turn", "fact_seq", digest("fact").alias("fact_md5"))


def superseded_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.date_trunc("hour", "ts").alias("effective_from"))
    return memory.superseded(rows, ["user_id", "event_type"], "effective_from")


def rebuilt_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lit("realtime").alias("tier"))
    anew = turns.where("conv_id % 3 = 0 AND turn < 2").withColumn("tier", F.lit("consolidated"))
    return memory.rebuilt(turns, anew, ["conv_id"])


def read_consolidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 2, "consolidated").otherwise("realtime").alias("tier"), (F.col("turn") % 5 == 4).alias("retracted"))
    return memory.read_consolidated(rows, "conv_id")


def confidence_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 4 != 0, F.round(F.col("value") / 100, 6)).alias("confidence"))
    return search.confident(rows, 0.5).unionByName(search.confident(rows, 0.9, False)).groupBy("event_id", "confidence").agg(F.count("*").alias("n"))


def cursor_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state lacks German documents and has other hashes for Spanish ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    state = docs.where("lang != 'de'").select("doc_id", F.when(F.col("lang") == "es", F.sha1(F.col("h").cast("binary"))).otherwise(F.col("h")).alias("h"))
    return incremental.changed(docs, state, "doc_id", "h").select("doc_id", "lang", "h")


def prune_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return incremental.deleted(orders.where("o_orderstatus != 'P'"), orders, "o_orderkey")


def keyset_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return incremental.after(orders, "o_orderdate", "o_orderkey", (F.lit("1997-01-01").cast("timestamp"), 500)).select("o_orderkey", "o_orderdate")


def high_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.high_water(table(spark, sf_dir, "orders"), "o_orderdate", "o_orderkey")


def watermark_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return incremental.between(rows, "ts", F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-10").cast("timestamp")).select("event_id", "ts")


def _streamed(spark: SparkSession, sf_dir: str, make) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    base = fresh_path(spark, "stream")
    stream = make(streams.read_events(spark, f"{sf_dir}/events*.parquet", schema))
    streams.run_available(stream, f"{base}/out", f"{base}/state")
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir, lambda s: streams.distinct_events(s, "event_id", "ts").select("event_id", "user_id", "event_type"))


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir, lambda s: streams.windowed(s, "ts", ["event_type"], "6 hours", "value"))


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir, lambda s: streams.sessions(s, "ts", "user_id", "2 hours"))


def stream_late_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries of seven and a half days each; every tenth event comes with the one after its own."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    own = F.least(F.floor((F.unix_seconds("ts") - F.unix_seconds(F.lit("2024-01-01").cast("timestamp"))) / 648000), F.lit(3))
    dealt = events.withColumn("delivery", own + (F.col("event_id") % 10 == 0).cast("int"))
    base = fresh_path(spark, "deliveries")
    for n in range(5):
        dealt.where(F.col("delivery") == n).drop("delivery").write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", dealt.rdd.getNumPartitions()).parquet(f"{base}/in").withColumn("ts", F.col("ts").cast("timestamp"))
    revisions = streams.revised_sessions(stream, "ts", "user_id", "2 hours", "31 days")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.STATE_STORE)
    try:
        streams.run_available(revisions, f"{base}/out", f"{base}/state")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return streams.latest_sessions(spark.read.schema(revisions.schema).parquet(f"{base}/out"), "user_id")


def ingest_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of sentences brought up to two states of the corpus: in the second, documents are gone, new, changed and the same."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    path = fresh_path(spark, "table")
    ingest.ingest(docs.where("doc_id % 3 != 0"), path, chunkers.by_sentence, "a", "2024-01-01")
    longer = F.when(F.col("doc_id") % 2 == 0, F.concat("content", F.lit(" More is said."))).otherwise(F.col("content"))
    rows = ingest.ingest(docs.where("doc_id % 3 != 1").withColumn("content", longer), path, chunkers.by_sentence, "b", "2024-02-02")
    return rows.select("id", "doc_id", "seq_num", digest("original_content").alias("original_md5"), "source", F.date_format("created_at", "yyyy-MM-dd").alias("created"))


def bakeoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold: the documents whose text holds the passage."""
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    passages = items.select(F.col("item_id").alias("name_id"), F.col("text").alias("name"))
    gold = find_names(docs, passages, ["doc_id"], "text", borders=False, longest=False).select(F.col("name_id").alias("item_id"), "doc_id").distinct()
    return evaluation.scores(evaluation.gold_ranks(fts_bm25_topk(spark, sf_dir), gold, "item_id", "doc_id"), (1, 3, 5))


def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select(F.col("n_name").alias("combo"), F.round((F.col("n_nationkey") * 7 % 5) / 5.0, 6).alias("mrr"))
    return evaluation.leaderboard(rows)


def eval_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.plan(table(spark, sf_dir, "nation").select(F.col("n_name").alias("workload")), table(spark, sf_dir, "region").select(F.col("r_name").alias("policy")))


_CHUNKS = lambda n: _windows(n, n).replace("w AS", f"w{n} AS").replace("FROM w WHERE", f"FROM w{n} WHERE").replace("starts", f"starts{n}").replace("chunks AS", f"chunks{n} AS").replace("FROM chunks", f"FROM chunks{n}").replace("texts AS", f"texts{n} AS")
_MERGE = f"""WITH {_CHUNKS(100)},{_CHUNKS(200)},
e AS (SELECT doc_id || '::' || seq_num AS id, doc_id, seq_num, t FROM texts100),
i AS (SELECT doc_id || '::' || seq_num AS id, doc_id, seq_num, t FROM texts200 WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'fr')),
n AS (SELECT doc_id, count(*) AS n FROM i GROUP BY doc_id),
k AS (SELECT e.* FROM e LEFT JOIN n USING (doc_id) WHERE id NOT IN (SELECT id FROM i) AND (NOT {{orphans}} OR n IS NULL OR seq_num < n))
SELECT id, seq_num, md5(t) AS content_md5, 'first' AS source, TIMESTAMP '2024-01-01' AS created_at FROM k
UNION ALL SELECT i.id, i.seq_num, md5(i.t), CASE WHEN e.id IS NULL THEN 'second' ELSE 'first' END, CASE WHEN e.id IS NULL THEN TIMESTAMP '2024-02-01' ELSE TIMESTAMP '2024-01-01' END FROM i LEFT JOIN e USING (id)"""
_EDGES = "ed AS (SELECT * FROM (SELECT p_partkey AS src, unnest([p_partkey // 2, p_partkey // 3]) AS dst, (p_partkey * 7 % 10) / 10.0::DOUBLE AS confidence, 'e' || p_partkey AS evidence, CASE WHEN p_partkey % 2 = 0 THEN 'calls' ELSE 'extends' END AS kind FROM part) WHERE dst > 0)"


def _impact_sql(anchors: str, depth: int, near: str, far: str, condition: str) -> str:
    return f"""WITH RECURSIVE {_EDGES}, u AS (SELECT {near} AS pos, {far} AS node, confidence, evidence FROM ed WHERE {condition}),
walk AS (SELECT anchor, node, 1 AS hop, confidence, evidence FROM ({anchors}) JOIN u ON pos = anchor
  UNION SELECT anchor, u.node, hop + 1, u.confidence, u.evidence FROM walk JOIN u ON u.pos = walk.node WHERE hop < {depth})
SELECT anchor, node, CAST(min(hop) AS INT) AS hop, max(confidence) AS confidence, max(struct_pack(c := confidence, e := evidence)).e AS evidence FROM walk GROUP BY anchor, node"""


_REFERENCES = "t"
for _name, _char in html.REFERENCES.items():
    _REFERENCES = f"replace({_REFERENCES}, '{_name}', '{_char.replace(chr(39), chr(39) * 2)}')"
_LINKS = """list_filter(regexp_extract_all(html, '<a href="([^"]*)"', 1), lambda u: u <> '' AND NOT regexp_matches(u, '^(?i:mailto:|javascript:|tel:|#)'))"""

QUERIES = {"impact_callees": _impact("callees"), "impact_callers": _impact("callers")}
QUERIES |= {
    f.__name__: f
    for f in (
        src_table_where, src_json_corpus, src_html_text, src_html_title_links, crawl, impact_of_kind, resolve_names, upsert_write_once, delete_orphans, compact_latest, delete_documents, foreign_sources, promote_metadata, documents_rollup, stage_dedup,
        session_docs, due_sessions, extracted_facts, superseded_facts, rebuilt_sessions, read_consolidated, confidence_floor, cursor_changes, prune_deleted, keyset_after, high_water, watermark_window, stream_dedup, stream_windows, stream_sessions, stream_late_sessions, ingest_twice, bakeoff_scores, leaderboard, eval_plan,
    )
}
_FACT_SENTENCES = r"list_filter(list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '(^|\n)\[[^\]\n]*\][ ]*', '\1', 'g'), '([.!?])\s+', '\1' || chr(31), 'g'), chr(31)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> ''), lambda s: len(list_filter(regexp_split_to_array(s, '\s+'), lambda w: w <> '')) >= 4)"
SQL = {
    "src_table_where": "SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, o_orderpriority || ' ' || o_orderstatus AS content, o_orderpriority AS title, CAST(json_object('o_orderstatus', o_orderstatus, 'o_custkey', o_custkey) AS VARCHAR) AS metadata FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F'",
    "src_json_corpus": "SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(text) AS content_md5, CAST(json_object('lang', lang, 'source', source, 'n_chars', n_chars) AS VARCHAR) AS metadata FROM documents",
    "src_html_text": rf"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>', chr(10), 'g'), '(?s)<!--.*?-->', chr(10), 'g'), '(?s)<[A-Za-z/!][^>]*>', chr(10), 'g') AS h FROM pages),
b AS (SELECT page_id, array_to_string(list_filter(list_transform(string_split(h, chr(10)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> ''), chr(10)) AS t FROM a)
SELECT page_id, md5({_REFERENCES}) AS text_md5 FROM b""",
    "src_html_title_links": rf"""WITH a AS (SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, {_LINKS} AS l, url, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*') AS host, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*:') AS scheme,
  regexp_extract(regexp_replace(url, '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*(/.*/|/)?', 1) AS path FROM pages)
SELECT page_id, title, CAST(len(l) AS INT) AS n_links, array_to_string(list_transform(l, lambda u: CASE WHEN regexp_matches(u, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN u WHEN starts_with(u, '//') THEN scheme || u WHEN starts_with(u, '/') THEN host || u ELSE host || CASE WHEN path = '' THEN '/' ELSE path END || u END), ' ') AS links FROM a""",
    "crawl": """WITH RECURSIVE p AS (SELECT c_custkey AS url FROM customer), l AS (SELECT * FROM (SELECT url, unnest([url // 3, url // 2, url + 1]) AS dest FROM p) WHERE url <> dest),
w AS (SELECT url, 0 AS depth FROM p WHERE url > (SELECT max(url) FROM p) - 20 UNION SELECT l.dest, depth + 1 FROM w JOIN l USING (url) JOIN p ON p.url = l.dest WHERE depth < 3)
SELECT url, CAST(min(depth) AS INT) AS depth FROM w GROUP BY url""",
    "impact_callees": _impact_sql("SELECT s_suppkey AS anchor FROM supplier", 4, "src", "dst", "confidence >= 0.3"),
    "impact_callers": _impact_sql("SELECT s_suppkey AS anchor FROM supplier", 4, "dst", "src", "confidence >= 0.3"),
    "impact_of_kind": _impact_sql("SELECT p_partkey AS anchor FROM part", 3, "src", "dst", "confidence >= 0.1 AND kind = 'calls'"),
    "resolve_names": """WITH s AS (SELECT 's' || s_suppkey AS fqn, 'f' || (s_suppkey % 61) AS name, 'N' || s_nationkey AS stem FROM supplier),
c AS (SELECT p_partkey AS call_id, 'p' || (p_partkey % 400) AS caller, 'f' || (p_partkey % 83) AS callee, ['n' || (p_partkey % 25), 'n' || (p_partkey % 7)] AS imports FROM part),
j AS (SELECT *, count(*) OVER (PARTITION BY call_id) AS n, list_contains(imports, lower(stem)) AS imported FROM c JOIN s ON callee = name),
k AS (SELECT *, sum(imported::INT) OVER (PARTITION BY call_id) AS ni FROM j),
e AS (SELECT call_id, caller AS src, fqn AS dst, CASE WHEN n = 1 THEN 'unique_name' WHEN ni = 1 THEN 'import_resolved' ELSE 'ambiguous_name' END AS resolution FROM k WHERE n = 1 OR ni <> 1 OR imported),
r AS (SELECT *, CASE WHEN resolution = 'ambiguous_name' THEN 0.5::DOUBLE ELSE 0.9::DOUBLE END AS confidence FROM e)
SELECT src, dst, resolution, confidence FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY call_id, confidence DESC) AS rn FROM r) WHERE rn = 1""",
    "upsert_write_once": _MERGE.format(orphans="false"),
    "delete_orphans": _MERGE.format(orphans="true"),
    "compact_latest": "SELECT id, event_id, value FROM (SELECT user_id || ':' || event_type AS id, event_id, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1",
    "delete_documents": f"WITH {_windows(100, 100)} SELECT doc_id || '::' || seq_num AS id, CASE WHEN seq_num % 2 = 0 THEN doc_id || '#' || seq_num ELSE CAST(doc_id AS VARCHAR) END AS doc_id FROM texts WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')",
    "foreign_sources": "SELECT DISTINCT source FROM documents WHERE source <> 'src1' ORDER BY source LIMIT 10",
    "promote_metadata": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, true AS missing FROM events",
    "documents_rollup": f"WITH {_windows(100, 100)} SELECT doc_id, CAST(sum(length(t)) AS BIGINT) AS char_count, CAST(greatest(1, ceil(sum(length(t)) / 4.0)) AS BIGINT) AS token_count_est, count(*) AS chunk_count, sha256(string_agg(sha256(t), ',' ORDER BY seq_num)) AS content_hash FROM texts GROUP BY doc_id",
    "stage_dedup": "SELECT DISTINCT sha1(encode(CAST(conv_id AS VARCHAR)) || '\\x00'::BLOB || encode(CAST(turn AS VARCHAR)) || '\\x00'::BLOB || encode(text)) AS event_id, conv_id, turn FROM conversations",
    "session_docs": "SELECT conv_id, md5(string_agg('[' || role || '] ' || text, chr(10) ORDER BY turn, '[' || role || '] ' || text)) AS content_md5, count(*) AS turns FROM conversations GROUP BY conv_id",
    "due_sessions": "WITH l AS (SELECT user_id, max(ts) AS last_ts, count(*) AS n_events, max(ts) FILTER (event_type = 'purchase') AS c FROM events GROUP BY user_id) SELECT user_id, last_ts, n_events FROM l WHERE last_ts < TIMESTAMP '2024-01-31' - INTERVAL 24 HOUR AND (c IS NULL OR last_ts > c)",
    "extracted_facts": f"WITH s AS (SELECT conv_id, turn, {_FACT_SENTENCES} AS s FROM conversations) SELECT conv_id, turn, CAST(unnest(range(0, len(s))) AS INT) AS fact_seq, md5(substr(unnest(s), 1, 1200)) AS fact_md5 FROM s",
    "superseded_facts": """WITH e AS (SELECT event_id, user_id, event_type, date_trunc('hour', ts) AS effective_from FROM events),
x AS (SELECT *, (SELECT min(f.effective_from) FROM e f WHERE f.user_id = e.user_id AND f.event_type = e.event_type AND f.effective_from > e.effective_from) AS effective_to FROM e)
SELECT *, effective_to IS NOT NULL AS retracted FROM x""",
    "rebuilt_sessions": "SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 AND conv_id IN (SELECT conv_id FROM conversations WHERE turn < 2) THEN 'consolidated' ELSE 'realtime' END AS tier FROM conversations WHERE NOT (conv_id % 3 = 0 AND turn >= 2 AND conv_id IN (SELECT conv_id FROM conversations WHERE turn < 2))",
    "read_consolidated": """WITH r AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN 'consolidated' ELSE 'realtime' END AS tier, turn % 5 = 4 AS retracted FROM conversations),
l AS (SELECT *, max((tier = 'consolidated')::INT) OVER (PARTITION BY conv_id) AS held FROM r WHERE NOT retracted) SELECT conv_id, turn, tier, retracted FROM l WHERE held = 0 OR tier = 'consolidated'""",
    "confidence_floor": """WITH r AS (SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN round(value / 100, 6) END AS confidence FROM events),
u AS (SELECT * FROM r WHERE confidence IS NULL OR confidence >= 0.5 UNION ALL SELECT * FROM r WHERE coalesce(confidence, 0) >= 0.9) SELECT event_id, confidence, count(*) AS n FROM u GROUP BY ALL""",
    "cursor_changes": "SELECT doc_id, lang, sha256(text) AS h FROM documents WHERE lang IN ('de', 'es')",
    "prune_deleted": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'",
    "keyset_after": "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate > TIMESTAMP '1997-01-01' OR o_orderdate = TIMESTAMP '1997-01-01' AND CAST(o_orderkey AS VARCHAR) > '500'",
    "high_water": "SELECT o_orderdate AS ts, CAST(o_orderkey AS VARCHAR) AS id FROM orders ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR) DESC LIMIT 1",
    "watermark_window": "SELECT event_id, ts FROM events WHERE ts > TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-10'",
    "stream_dedup": "SELECT event_id, user_id, event_type FROM events",
    "stream_windows": """WITH w AS (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS "start", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL)
SELECT "start", "start" + INTERVAL 6 HOUR AS "end", event_type, n, total FROM w WHERE "start" + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
    "stream_sessions": """WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS o FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
e AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g),
s AS (SELECT user_id, min(ts) AS "start", max(ts) + INTERVAL 2 HOUR AS "end", count(*) AS n_events FROM e GROUP BY user_id, k)
SELECT * FROM s WHERE "end" <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
    "stream_late_sessions": """WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS o FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
e AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS "start", max(ts) AS "last", count(*) AS n_events FROM e GROUP BY user_id, k""",
    "bakeoff_scores": f"""WITH {_BM25}, g AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
h AS (SELECT g.item_id, min(rank) AS r FROM g LEFT JOIN (SELECT * FROM kw WHERE rank <= {K}) k USING (item_id, doc_id) GROUP BY g.item_id)
SELECT count(*) AS n_queries, {', '.join(f"round(avg(coalesce(r <= {k}, false)::INT::DOUBLE), 6) AS recall_{k}" for k in (1, 3, 5))}, {', '.join(f"round(avg(CASE WHEN r <= {k} THEN 1 / log2(r + 1) ELSE 0.0::DOUBLE END), 6) AS ndcg_{k}" for k in (1, 3, 5))}, round(avg(coalesce(1.0::DOUBLE / r, 0)), 6) AS mrr FROM h""",
    "leaderboard": "WITH r AS (SELECT n_name AS combo, round((n_nationkey * 7 % 5) / 5.0::DOUBLE, 6) AS mrr FROM nation) SELECT *, CAST(row_number() OVER (ORDER BY mrr DESC, combo) AS INT) AS place FROM r",
    "eval_plan": "WITH x AS (SELECT n_name AS workload, r_name AS policy, lower(regexp_replace(n_name, '[^A-Za-z0-9]+', '-', 'g')) || '__' || lower(regexp_replace(r_name, '[^A-Za-z0-9]+', '-', 'g')) AS slug FROM nation, region) SELECT *, substr(sha256(slug), 1, 16) AS config_hash FROM x",
    "ingest_twice": f"""
WITH s AS (SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 THEN text || ' More is said.' ELSE text END AS longer FROM documents),
a AS (SELECT doc_id, CAST(unnest(range(0, len(s))) AS INT) AS seq_num FROM (SELECT doc_id, {_DOC_SENTENCES} AS s FROM s WHERE doc_id % 3 <> 0)),
b AS (SELECT doc_id, CAST(unnest(range(0, len(s))) AS INT) AS seq_num, unnest(s) AS t FROM (SELECT doc_id, {_SENTENCES.format(t='longer')} AS s FROM s WHERE doc_id % 3 <> 1))
SELECT doc_id || ':' || seq_num AS id, b.doc_id, b.seq_num, md5(t) AS original_md5, CASE WHEN a.doc_id IS NULL THEN 'b' ELSE 'a' END AS source,
       CASE WHEN a.doc_id IS NULL THEN '2024-02-02' ELSE '2024-01-01' END AS created
FROM b LEFT JOIN a USING (doc_id, seq_num)""",
}
