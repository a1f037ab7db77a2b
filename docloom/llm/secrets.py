"""Secret scans with an incremental blob ledger.

Every version of every text is addressed by the SHA-256 of its bytes. A ledger, a Parquet table in a shared folder, holds for each blob the
rule versions that it was scanned with and what they found. A scan takes each distinct blob once and only with rule versions that the ledger
does not have for it; findings are joined back to all paths (documents) that have the blob. A rule's new version is a new name
in the ledger, so it alone is run again over old blobs.

Partial aggregation keeps one copy of a blob per task before the shuffle, so blobs of very many paths do not gather; the join back moves ids
and digests only, against the blobs that have findings.

Defined cases: a null text is an empty one, with no findings; null paths and rows that repeat each get their blob's findings;
further columns stay as they are, but for names that begin with ``secret_``; an empty table gives an empty result and an empty ledger entry.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from docloom.llm.common import cut, fresh_path, packed, table

_ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([a-z0-9+/_.=-]+)")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{24,}")
#: A private key up to its end, or its first line where there is none.
_PRIVATE_KEY = r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:[A-Za-z0-9+/=:,.\t\n\f\r ]|-[A-Za-z0-9])*-----END [A-Z ]*PRIVATE KEY-----)?"
_PRIVATE = re.compile(_PRIVATE_KEY.encode())
_TOKEN = re.compile(rb"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*")
Spans = list[tuple[int, int]]


def _assignments(text: bytes) -> Spans:
    # bytes.lower() is of ASCII letters only
    return [m.span() for m in _ASSIGN.finditer(text.lower()) if m.end(2) - m.start(2) >= 6]


def _access_keys(text: bytes) -> Spans:
    return [m.span() for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]


def _found(pattern: re.Pattern) -> Callable[[bytes], Spans]:
    return lambda text: [m.span() for m in pattern.finditer(text)]


#: Kinds in order, each with its rule's version. The first three are the base.
RULES: dict[str, tuple[int, Callable[[bytes], Spans]]] = {
    "assign": (1, _assignments),
    "access": (1, _access_keys),
    "hex": (1, _found(_HEX)),
    "private": (2, _found(_PRIVATE)),
    "jwt": (1, _found(_TOKEN)),
}
_FOUND = "array<struct<start:bigint,end:bigint,kind:string>>"
_LEDGER = f"blob binary, rules array<string>, found {_FOUND}"


def blob(text: str = "text") -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary"), 256))


def scan(text: bytes, rules: dict, names: list[str]) -> list[dict]:
    """Findings of the rules named, in code points."""
    spans = [(start, end, kind) for kind, (version, rule) in rules.items() if f"{kind}@{version}" in names for start, end in rule(text)]
    out, at, points = [], 0, 0
    place: dict[int, int] = {}
    for x in sorted({p for start, end, _ in spans for p in (start, end)}):
        points += len(text[at:x].decode("utf-8", "replace"))
        place[x], at = points, x
    for start, end, kind in spans:
        out.append({"start": place[start], "end": place[end], "kind": kind})
    return out


def update_ledger(docs: DataFrame, ledger: str, text: str = "text", rules: dict = RULES) -> DataFrame:
    """Scans blobs and rule versions that the ledger lacks, and adds them to it, if any. Returns the ledger."""
    spark = docs.sparkSession
    wanted = F.array(*[F.lit(f"{kind}@{version}") for kind, (version, _) in rules.items()])
    texts = docs.select(blob(text).alias("blob"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    try:
        known = spark.read.schema(_LEDGER).parquet(ledger)
    except AnalysisException:  # no ledger yet
        todo = texts.groupBy("blob").agg(F.first("text").alias("text")).select("blob", "text", wanted.alias("rules"))
    else:
        # digests first: texts are fetched of what the ledger lacks
        seen = known.groupBy("blob").agg(F.flatten(F.collect_list("rules")).alias("seen"))
        lacking = texts.select("blob").distinct().join(seen, "blob", "left")
        lacking = lacking.select("blob", F.array_except(wanted, F.coalesce("seen", F.array())).alias("rules"))
        lacking = cut(lacking.where(F.size("rules") > 0), "lacking")
        n = lacking.count()
        if not n:
            return known
        chosen = texts.join(F.broadcast(lacking) if n <= 20_000 else lacking, "blob", "left_semi")
        todo = chosen.groupBy("blob").agg(F.first("text").alias("text")).join(lacking, "blob")

    def run(of: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in of:
            found = [scan(x.as_buffer().to_pybytes(), rules, names) for x, names in zip(batch.column("text"), batch.column("rules").to_pylist(), strict=True)]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column("blob"), batch.column("rules"), pa.array(found, kind)], names=["blob", "rules", "found"])

    todo.mapInArrow(run, _LEDGER).write.mode("append").parquet(ledger)
    return spark.read.schema(_LEDGER).parquet(ledger)


def find_secrets(docs: DataFrame, text: str = "text", rules: dict = RULES, ledger: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """The columns of docs (or those named in keep) with secret_blob and secret_spans (by start, then kind in the order of rules)."""
    ledger = ledger or fresh_path(docs.sparkSession, "ledger")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("secret_blob", "secret_spans", "secret_of")]
    known = update_ledger(docs, ledger, text, rules)
    rank = F.coalesce(*[F.when(F.col("x.kind") == kind, F.lit(i)) for i, kind in enumerate(rules)])
    current = F.filter("rules", lambda r: r.isin([f"{kind}@{version}" for kind, (version, _) in rules.items()]))
    kinds = F.transform(current, lambda r: F.substring_index(r, "@", 1))
    found = known.select("blob", kinds.alias("kinds"), F.explode("found").alias("x")).where(F.array_contains("kinds", F.col("x.kind")))
    spans = found.groupBy(F.col("blob").alias("secret_of")).agg(F.array_sort(F.collect_set(F.struct("x.start", rank.alias("rank"), "x.end", "x.kind"))).alias("secret_spans"))
    spans = cut(spans, "findings")
    return docs.select(*[F.col(f"`{c}`") for c in keep], blob(text).alias("secret_blob")).join(spans, F.col("secret_blob") == F.col("secret_of"), "left").select(*[F.col(f"`{c}`") for c in keep], "secret_blob", F.coalesce("secret_spans", F.array()).alias("secret_spans"))


def redact(docs: DataFrame, text: str = "text", mask: str = "[REDACTED]", rules: dict = RULES, ledger: str | None = None) -> DataFrame:
    """docs with each secret in the text replaced (spans that overlap: as one). Columns as before, whatever their names."""
    docs, columns = packed(docs, text)
    text = "text"
    found = find_secrets(docs, text, rules, ledger)
    # spans by start; each piece of text between them begins at the largest end so far
    zero = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))
    body = F.col(f"`{text}`")
    step = lambda a, x: F.struct(
        F.when(x["start"] >= a["at"], F.concat(a["out"], F.substring(body, (a["at"] + 1).cast("int"), (x["start"] - a["at"]).cast("int")), F.lit(mask))).otherwise(a["out"]).alias("out"),
        F.greatest(a["at"], x["end"]).alias("at"),
    )
    clean = F.aggregate("secret_spans", zero, step, lambda a: F.concat(a["out"], F.substring(body, (a["at"] + 1).cast("int"), F.lit(2**31 - 1))))
    return found.select("kept_row", F.when(F.size("secret_spans") > 0, clean).otherwise(body).alias("text")).select(*columns)


def kept_ledger(spark: SparkSession, name: str) -> str | None:
    """The ledger of a table in the folder that the session's setting ``spark.docloom.ledger.dir`` names, which outlives the session; or
    none, for a ledger of this run alone."""
    folder = spark.conf.get("spark.docloom.ledger.dir", "")
    return f"{folder}/{hashlib.sha256(name.encode()).hexdigest()[:16]}" if folder else None


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = kept_ledger(spark, f"{sf_dir}/documents")
    found = find_secrets(table(spark, sf_dir, "documents"), ledger=ledger, keep=["doc_id"])
    said = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    of = lambda *kinds: F.filter("secret_spans", lambda x: x["kind"].isin(*kinds))
    return found.select(
        "doc_id",
        *[F.size(of(kind)).cast("bigint").alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(said(of("assign", "access", "hex")).cast("binary"), 256).alias("base_sha256"),
        said(F.col("secret_spans")).alias("spans"),
    )


def _sql_kind(rank: int, kind: str, pattern: str, condition: str) -> str:
    pattern = pattern.replace("'", "''")
    return f"""SELECT k, {rank} AS rank, '{kind}' AS kind, pos AS "start", pos + length(x) AS "end" FROM (
      SELECT k, m[i] AS x, list_sum(list_transform(p[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0) AS pos
      FROM (SELECT k, m, p, unnest(range(1, len(m) + 1)) AS i FROM (SELECT k, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS p FROM d) WHERE len(m) > 0))
      WHERE {condition}"""


_SQL_ASSIGN = "(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
OP8_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
f AS (
  {_sql_kind(0, "assign", _SQL_ASSIGN, "length(regexp_extract(x, '" + _SQL_ASSIGN.replace("'", "''") + "', 1)) >= 6")}
  UNION ALL {_sql_kind(1, "access", "AKIA[A-Z0-9]+", "length(x) >= 20")}
  UNION ALL {_sql_kind(2, "hex", "[0-9a-f]+", "length(x) >= 24")}
  UNION ALL {_sql_kind(3, "private", _PRIVATE_KEY, "true")}
  UNION ALL {_sql_kind(4, "jwt", "eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]*", "true")}),
g AS (
  SELECT k, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
         string_agg(kind || ':' || "start" || ':' || "end", ',' ORDER BY "start", rank) FILTER (rank < 3) AS base,
         string_agg(kind || ':' || "start" || ':' || "end", ',' ORDER BY "start", rank) AS spans FROM f GROUP BY k)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (k)
"""
