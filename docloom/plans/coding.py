"""Queries over source code, comments, phrases and central sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import FILLER_WORDS, sentences
from docloom.operators import code, extractors, summaries
from docloom.plans.chunking import _DOC_SENTENCES
from docloom.plans.common import digest, table
from docloom.plans.searching import _TOKENS, _hashed
from docloom.sources import comments


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python file of each document: a class and a method that calls another for each of its sentences, by the sentence's length."""
    said = sentences(F.col("text"))
    i = lambda x: x.cast("string")
    block = lambda s, k: F.concat(
        F.lit("class C"), i(k), F.when(k > 0, F.concat(F.lit("(C"), i(k - 1), F.lit(")"))).otherwise(""), F.lit(":\n    x = 1\n\n    def m"), i(k), F.lit("(self):\n        return m"), i(F.length(s) % 7), F.lit("(1)\n\n")
    )
    content = F.concat(F.lit("import os\n\n"), F.array_join(F.transform(said, block), ""))
    path = F.concat(F.lit("src/p"), (F.col("doc_id") % 7).cast("string"), F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".py"))
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("source_path"), content.alias("content"))


def code_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.symbols(_files(spark, sf_dir)).select("source_path", "seq_num", "kind", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("fqn", F.lit("")).alias("fqn"), "first_line", "last_line", digest("text").alias("text_md5"))


def code_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes and their bases, as the first lines of classes name them."""
    rows = code.symbols(_files(spark, sf_dir)).where("kind = 'class'")
    return rows.select("source_path", "name", F.explode(code.bases(F.col("text"))).alias("base"))


def code_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = code.symbols(_files(spark, sf_dir)).where("kind = 'function'")
    return rows.select("source_path", "fqn", F.explode(code.callees(F.col("text"), F.col("name"))).alias("callee"))


def comment_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with a comment for each sentence (its digest), and code behind every other one."""
    line = lambda s, i: F.concat(F.lit("# "), digest(s), F.lit("\n"), F.when(i % 2 == 0, "x = '# no'\n").otherwise(""))
    rows = table(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".py")).alias("source_path"), F.array_join(F.transform(sentences(F.col("text")), line), "").alias("content"))
    return comments.comment_documents(rows)


def embedded_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extractors.embedded_phrases(table(spark, sf_dir, "documents"), "doc_id", "text", 5)


def central_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.central_sentences(table(spark, sf_dir, "documents"), content="text").select("doc_id", digest("summary").alias("summary_md5"))


_PATH = "'src/p' || (doc_id % 7) || '/d' || doc_id || '.py'"
_EACH = f"s AS (SELECT doc_id, CAST(unnest(range(0, len(s))) AS INT) AS i, unnest(s) AS t FROM (SELECT doc_id, {_DOC_SENTENCES} AS s FROM documents))"
_FILLERS = ", ".join("'" + w.replace("'", "''") + "'" for w in FILLER_WORDS)
_SCOPE = "'src.p' || (doc_id % 7) || '.d' || doc_id || '.C' || i"

QUERIES = {f.__name__: f for f in (code_symbols, code_inheritance, code_calls, comment_blocks, embedded_phrases, central_sentences)}
SQL = {
    "code_symbols": f"""WITH {_EACH}, a AS (SELECT *, CASE WHEN i > 0 THEN '(C' || (i - 1) || ')' ELSE '' END AS b FROM s), x AS (
SELECT {_PATH} AS source_path, 0 AS seq_num, 'module' AS kind, '' AS name, '' AS fqn, 1 AS first_line, 1 AS last_line, md5('import os') AS text_md5 FROM documents WHERE text IS NOT NULL
UNION ALL SELECT {_PATH}, 2 * i + 1, 'class', 'C' || i, {_SCOPE}, 6 * i + 3, 6 * i + 4, md5('class C' || i || b || ':' || chr(10) || '    x = 1') FROM a
UNION ALL SELECT {_PATH}, 2 * i + 2, 'function', 'm' || i, {_SCOPE} || '.m' || i, 6 * i + 6, 6 * i + 7, md5('    def m' || i || '(self):' || chr(10) || '        return m' || (length(t) % 7) || '(1)') FROM a)
SELECT source_path, CAST(seq_num AS INT) AS seq_num, kind, name, fqn, CAST(first_line AS INT) AS first_line, CAST(last_line AS INT) AS last_line, text_md5 FROM x""",
    "code_inheritance": f"WITH {_EACH} SELECT {_PATH} AS source_path, 'C' || i AS name, 'C' || (i - 1) AS base FROM s WHERE i > 0",
    "code_calls": f"WITH {_EACH} SELECT {_PATH} AS source_path, {_SCOPE} || '.m' || i AS fqn, 'm' || (length(t) % 7) AS callee FROM s",
    "comment_blocks": f"""WITH {_EACH}, b AS (SELECT doc_id, CAST((i + 1) // 2 AS INT) AS b, min(i) AS i, count(*) AS n, string_agg(md5(t), chr(10) ORDER BY i) AS text FROM s GROUP BY ALL),
l AS (SELECT *, CAST(i + 1 + (i + 1) // 2 AS INT) AS first_line FROM b)
SELECT doc_id || '.py#L' || first_line AS doc_id, doc_id || '.py' AS source_path, 'line' AS kind, first_line, CAST(first_line + n - 1 AS INT) AS last_line, text FROM l""",
    "embedded_phrases": f"""WITH {_hashed("va", "doc_id", "documents", "text").removeprefix("WITH ")}, t AS (SELECT doc_id, {_TOKENS} AS t FROM documents),
g AS (SELECT doc_id, unnest(list_concat(list_transform(range(1, len(t) + 1), lambda i: [t[i]]), list_transform(range(1, len(t)), lambda i: [t[i], t[i + 1]]))) AS g FROM t),
d AS (SELECT DISTINCT doc_id, g FROM g WHERE len(list_filter(g, lambda w: w IN ({_FILLERS}))) = 0),
u AS (SELECT doc_id, g, unnest(g) AS w FROM d),
p AS (SELECT doc_id, g, CAST(('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS INT) AS dim, sum(CASE WHEN ('0x' || substr(md5(w), 9, 1))::INT % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS x FROM u GROUP BY ALL),
c AS (SELECT p.doc_id, g, sum(p.x * coalesce(va.x, 0)) AS along, sum(p.x * p.x) AS square FROM p LEFT JOIN va ON p.doc_id = va.doc_id AND p.dim = va.dim WHERE p.doc_id IN (SELECT doc_id FROM va) GROUP BY ALL),
r AS (SELECT doc_id, array_to_string(g, ' ') AS phrase, round(along / sqrt(square), 6) AS score FROM c WHERE square > 0)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, phrase) AS INT) AS rank FROM r) WHERE rank <= 5""",
}
