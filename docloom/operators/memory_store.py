"""The memory table: writes that stamp, supersede and end facts; the record of a session; facts from salient sentences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions.batches import best, lists, sized, telling, token_codes
from docloom.functions.text import sentences
from docloom.functions.vectors import kinds
from docloom.shared import cut

#: Columns of the memory table beside a chunk's own.
COLUMNS = {
    "id": "string", "namespace": "string", "doc_id": "string", "seq_num": "int", "kind": "string", "tier": "string", "content": "string", "subject": "string", "predicate": "string",
    "object": "string", "support_span": "string", "confidence": "double", "recorded_at": "timestamp", "effective_from": "timestamp", "effective_to": "timestamp", "retracted": "boolean", "retracted_at": "timestamp",
}
_FACT = ["namespace", "subject", "predicate"]


def salient_facts(rows: DataFrame, keys: list[str], content: str, max_facts: int = 10) -> DataFrame:
    """(keys, fact_seq, support_span, confidence): the sentences of a text whose words, without filler words, are most frequent in it on average, in
    thousandths rounded down; of equals, the earlier. They keep the text's order, and the first is the most confident: 1 - i / n to three places.
    Sentences without such a word are none. Each row is scored where it is read."""

    def choose(of: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized(of, "_said"):
            sizes, said = lists(batch.column("_said"))
            sentence, code, names = token_codes(batch.column("_low").flatten())
            kept = telling(names, 2)[code] if len(code) else np.zeros(0, bool)
            sentence, code = sentence[kept], code[kept]
            text = np.repeat(np.arange(len(batch)), sizes)
            _, own, times = np.unique(text[sentence] * max(len(names), 1) + code, return_inverse=True, return_counts=True)
            n = np.bincount(sentence, minlength=len(said))
            some = np.flatnonzero(n)
            score = 1000 * np.bincount(sentence, times[own], len(said)).astype(np.int64)[some] // n[some]
            chosen = np.sort(some[best(text[some], max_facts, -score, some)[0]])
            row = text[chosen]
            columns = [*[batch.column(c).take(pa.array(row)) for c in names_of], pa.array(np.bincount(row, minlength=len(batch))[row].astype(np.int32))]
            seq = np.arange(len(row)) - np.searchsorted(row, row)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(seq.astype(np.int32)), said.take(pa.array(chosen))], names=[*names_of, "_n", "_seq", "_span"])

    names_of = [f"_key{i}" for i in range(len(keys))]
    said = rows.select(*[F.col(k).alias(c) for k, c in zip(keys, names_of, strict=True)], sentences(F.coalesce(F.col(content), F.lit(""))).alias("_said"))
    said = said.select("*", F.transform("_said", F.lower).alias("_low"))
    told = said.mapInArrow(choose, f"{kinds(said, names_of)}, _n int, _seq int, _span string")
    confidence = F.round(1 - F.col("_seq") / F.col("_n"), 3)
    return told.select(*[F.col(c).alias(k) for k, c in zip(keys, names_of, strict=True)], F.col("_seq").alias("fact_seq"), F.col("_span").alias("support_span"), confidence.alias("confidence"))


def next_start(rows: DataFrame, by: list[str], start: str, span: str = "DAY") -> DataFrame:
    """(by, start, next): each start of a key, once, with the next later one of that key, or null. The starts of a key are dealt out by spans of time,
    so that one key may hold most rows: within a span a window looks ahead; beyond it, the first start of the next span that has any does."""
    starts = rows.select(*by, start).distinct().withColumn("_span", F.date_trunc(span, start))
    within = F.lead(start).over(W.partitionBy(*by, "_span").orderBy(start))
    firsts = starts.groupBy(*by, "_span").agg(F.min(start).alias("_first"))
    firsts = firsts.select(*by, "_span", F.lead("_first").over(W.partitionBy(*by).orderBy("_span")).alias("_beyond"))
    out = starts.withColumn("_within", within).join(firsts, [*by, "_span"])
    return out.select(*by, start, F.coalesce("_within", "_beyond").alias("next"))


def _complete(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.col(c).cast(t).alias(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in COLUMNS.items()])


def write(memory: DataFrame | None, incoming: DataFrame, namespace: str, at: str, tier: str = "provisional", supersede: bool = True, order: tuple[str, ...] = ("seq_num",)) -> DataFrame:
    """The memory table after a write at a time.

    incoming: doc_id, seq_num, content, and what else of COLUMNS there is. Its rows get the namespace, tier and time, kind `episode` and not retracted where
    they say nothing, and numbers that go on over the frames of a document, in the order of `order`; their id is `namespace::doc_id::number`. A row of
    the same id is replaced. Of a document that comes in the tier `consolidated`, all that the namespace had goes first, if `supersede`.

    A fact (kind `fact`, with subject, predicate and effective_from, not null) ends where the next later one of the same namespace, subject and predicate
    begins: it is retracted, and effective_to tells where, whichever came first. So several writes, late ones too, come to what one would; retracted_at is the
    time of the write in which it ended. Only facts whose subject and predicate come in are gone through. Facts that begin at the same time stand side by side.
    Rows without doc_id are left out."""
    rows = incoming.where("doc_id IS NOT NULL")
    number = (F.row_number().over(W.partitionBy("doc_id").orderBy(*order)) - 1).cast("int")
    ends = [c for c in ("retracted", "retracted_at", "effective_to", "kind") if c not in rows.columns]
    for c in ends:
        rows = rows.withColumn(c, F.lit(None).cast(COLUMNS[c]))
    rows = rows.withColumn("_number", number).withColumn("seq_num", F.col("_number"))
    rows = rows.withColumn("kind", F.coalesce("kind", F.lit("episode"))).withColumn("retracted", F.coalesce(F.col("retracted"), F.lit(False)))
    rows = rows.withColumn("namespace", F.lit(namespace)).withColumn("tier", F.lit(tier)).withColumn("recorded_at", F.lit(at).cast("timestamp"))
    rows = rows.withColumn("id", F.concat_ws("::", "namespace", F.col("doc_id").cast("string"), F.col("seq_num").cast("string")))
    new = cut(_complete(rows), "memory_in")
    held = None
    if memory is not None:
        gone = ["namespace", "doc_id"] if tier == "consolidated" and supersede else ["id"]
        held = _complete(memory).join(new.select(*gone).distinct(), gone, "left_anti")
    live = "kind = 'fact' AND subject IS NOT NULL AND predicate IS NOT NULL AND effective_from IS NOT NULL"
    every = new if held is None else held.select(*new.columns).unionByName(new)
    # keys of what comes in, and of what went, as its successors' facts may hold again
    keys = new.where(live).select(*_FACT)
    if memory is not None:
        keys = keys.unionByName(_complete(memory).where(live).join(new.select(*gone).distinct(), gone, "left_semi").select(*_FACT))
    keys = cut(keys.distinct(), "memory_keys")
    is_fact = F.coalesce(F.expr(live), F.lit(False))
    touched = cut(every.where(is_fact).join(keys, _FACT, "left_semi"), "memory_facts")
    later = next_start(touched, _FACT, "effective_from").withColumnRenamed("next", "_next")
    # a key may hold most rows: its starts are joined by time as well
    told = touched.join(later, [*_FACT, "effective_from"])
    # a row that says itself that it is retracted stays so; it has no end then
    own = F.coalesce(F.col("retracted") & F.col("effective_to").isNull(), F.lit(False))
    told = told.withColumn("retracted", own | F.col("_next").isNotNull())
    ended = told.withColumn("effective_to", F.col("_next")).withColumn("retracted_at", F.when(F.col("retracted"), F.coalesce("retracted_at", F.lit(at).cast("timestamp")))).select(*COLUMNS)
    rest = every.where(~is_fact).unionByName(every.where(is_fact).join(keys, _FACT, "left_anti").select(*every.columns))
    return cut(rest.select(*COLUMNS).unionByName(ended), "memory")


def records(memory: DataFrame, tier: str | None = "consolidated", namespace: str | None = None, include_retracted: bool = False) -> DataFrame:
    """A record for each session (namespace, doc_id): source_id `memory:namespace:doc_id`, text (its episodes, with an empty line between them), chunks (its
    episodes), relationships (of facts with subject, predicate and object: src, dst, rel_type, description, weight) and entities, the subjects and objects
    of those, each once where it first stands. All are in the order of seq_num; rows of another tier or namespace, and retracted ones, are left out."""
    rows = memory if include_retracted else memory.where(~F.coalesce(F.col("retracted"), F.lit(False)))
    rows = rows.where(F.col("tier") == tier) if tier is not None else rows
    rows = rows.where(F.col("namespace") == namespace) if namespace is not None else rows
    whole = (F.col("kind") == "fact") & (F.col("subject") != "") & (F.col("predicate") != "") & (F.col("object") != "")
    told = F.struct(F.col("subject").alias("src"), F.col("object").alias("dst"), F.col("predicate").alias("rel_type"), F.when(F.col("support_span") != "", F.col("support_span")).alias("description"), F.col("confidence").alias("weight"))
    # when() without otherwise() is null, which collect_list passes over
    episode = F.when(F.col("kind") == "episode", F.struct("seq_num", "id", F.coalesce("content", F.lit("")).alias("content")))
    fact = F.when(whole, F.struct("seq_num", "id", told.alias("told")))
    out = rows.groupBy("namespace", "doc_id").agg(F.max("recorded_at").alias("recorded_at"), F.sort_array(F.collect_list(episode)).alias("chunks"), F.sort_array(F.collect_list(fact)).alias("facts"))
    relationships = F.transform("facts", lambda f: f["told"])
    entities = F.array_distinct(F.flatten(F.transform(relationships, lambda r: F.array(r["src"], r["dst"]))))
    source = F.concat(F.lit("memory:"), F.coalesce("namespace", F.lit("default")), F.lit(":"), F.col("doc_id").cast("string"))
    return out.select("namespace", "doc_id", source.alias("source_id"), "recorded_at", F.array_join(F.transform("chunks", lambda c: c["content"]), "\n\n").alias("text"), "chunks", relationships.alias("relationships"), entities.alias("entities"))
