"""Chunkers: one document becomes chunks (doc_id, seq_num, original_content, embedded_content and what each adds).

They are expressions over arrays within a row, or windows over rows; a document's text is never gathered from several rows
unless the chunker is about sentences that were told apart before."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions.text import TOKEN, first_sentences, sentences, slices, words
from docloom.functions.vectors import Places
from docloom.operators.fold import fold


def _explode(docs: DataFrame, id: str, chunks: Column) -> DataFrame:
    out = docs.select(F.col(id), F.posexplode(chunks).alias("seq_num", "original_content"))
    return out.withColumn("embedded_content", F.col("original_content"))


def by_sentence(docs: DataFrame, id: str = "doc_id", content: str = "content") -> DataFrame:
    return _explode(docs, id, sentences(F.col(content)))


def fixed_overlap(docs: DataFrame, id: str = "doc_id", content: str = "content", window: int = 300, step: int = 150) -> DataFrame:
    """Windows of words, the last of which reaches the end; words are joined by one blank. Adds start_word and n_words."""
    rows = docs.select(F.col(id), words(F.col(content)).alias("w"))
    n = F.size("w")
    last = F.greatest(F.ceil((n - window) / F.lit(step)), F.lit(0)).cast("int")
    starts = F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda i: i * step)).otherwise(F.array().cast("array<int>"))
    rows = rows.select(id, "w", F.posexplode(starts).alias("seq_num", "start_word"))
    part = F.slice("w", F.col("start_word") + 1, F.lit(window))
    return rows.select(id, "seq_num", F.array_join(part, " ").alias("original_content"), F.array_join(part, " ").alias("embedded_content"), "start_word", F.size(part).alias("n_words"))


def packed(pieces: Column, most: int) -> Column:
    """Pieces (struct of sep and text), in order, put together while they fit in `most` characters."""
    zero = F.struct(F.lit("").alias("buf"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, p: Column) -> Column:
        full = (s["buf"] != "") & (F.length(s["buf"]) + F.length(p["sep"]) + F.length(p["text"]) > most)
        buf = F.when(full | (s["buf"] == ""), p["text"]).otherwise(F.concat(s["buf"], p["sep"], p["text"]))
        return F.struct(buf.alias("buf"), F.when(full, F.concat(s["out"], F.array(s["buf"]))).otherwise(s["out"]).alias("out"))

    return F.aggregate(pieces, zero, step, lambda s: F.when(s["buf"] == "", s["out"]).otherwise(F.concat(s["out"], F.array(s["buf"]))))


def _fitting(text: Column, most: int) -> Column:
    """Paragraphs; of those that are too long, sentences; of these, slices. With what stands before each."""
    piece = lambda sep, text: F.struct(F.lit(sep).alias("sep"), text.alias("text"))
    paragraphs = F.filter(F.transform(F.split(text, "\\n\\s*\\n"), lambda p: F.regexp_replace(p, "^\\s+|\\s+$", "")), lambda p: p != "")
    cut = lambda s: F.when(F.length(s) <= most, F.array(piece(" ", s))).otherwise(F.transform(slices(s, most), lambda x: piece("", x)))
    whole = lambda p: F.when(F.length(p) <= most, F.array(piece("\n\n", p))).otherwise(F.flatten(F.transform(sentences(p), cut)))
    return F.flatten(F.transform(paragraphs, whole))


def sentence_aware(docs: DataFrame, id: str = "doc_id", content: str = "content", max_chars: int = 2000) -> DataFrame:
    """Paragraphs packed up to max_chars; longer ones are split into sentences, those into slices."""
    return _explode(docs, id, packed(_fitting(F.col(content), max_chars), max_chars))


def hierarchy(frames: DataFrame, id: str = "frame_id", title: str = "title", text: str = "text", min_section_chars: int = 100, max_chars: int = 2000, prefix_heading: bool = True) -> DataFrame:
    """Chunks of sections (as the heading framer makes them): sections with a short body are dropped, long bodies split (section_part); the
    heading stands before the embedded text."""
    heading = F.coalesce(F.col(title), F.lit(""))
    body = F.when(heading == "", F.col(text)).otherwise(F.regexp_replace(text, "^[^\\n]*\\n*", ""))
    rows = frames.select(F.col(id), heading.alias("heading"), body.alias("body")).where((F.length("body") >= min_section_chars) | (F.col("heading") == ""))
    parts = F.when(F.length("body") <= max_chars, F.array("body")).otherwise(packed(_fitting(F.col("body"), max_chars), max_chars))
    rows = rows.select(id, "heading", F.posexplode(parts).alias("section_part", "original_content"))
    embedded = F.when((F.col("heading") != "") & F.lit(prefix_heading), F.concat("heading", F.lit("\n\n"), "original_content")).otherwise(F.col("original_content"))
    return rows.withColumn("embedded_content", embedded)


def neighbor_expand(chunks: DataFrame, id: str = "doc_id", window: int = 1) -> DataFrame:
    """Each chunk's embedded text becomes that of its neighbours and itself."""
    near = W.partitionBy(id).orderBy("seq_num").rowsBetween(-window, window)
    return chunks.withColumn("embedded_content", F.array_join(F.collect_list("embedded_content").over(near), "\n\n"))


def summary_embed(chunks: DataFrame, max_length: int = 300) -> DataFrame:
    """The embedded text becomes whole sentences from the front of the original."""
    return chunks.withColumn("embedded_content", first_sentences(F.col("original_content"), max_length)).withColumn("summarizer", F.lit("first_sentences"))


def hierarchical_summary(
    chunks: DataFrame,
    id: str = "doc_id",
    n: int = 5,
    max_length: int = 300,
    max_words: int | None = None,
    heading: str | None = None,
) -> DataFrame:
    """Each n chunks in a row are a group; or as many as have max_words words together (one at least); or those in a row of the same heading
    (a column). A coarse row with the group's summary follows its fine rows, and all are numbered anew."""
    if max_words is not None:
        size = F.size(words(F.col("original_content")))

        def start():
            state = {"group": 0, "words": 0, "some": False}

            def step(row) -> int:
                if state["some"] and state["words"] + row.size > max_words:
                    state.update(group=state["group"] + 1, words=0)
                state.update(words=state["words"] + row.size, some=True)
                return state["group"]

            return step

        rows = fold(chunks.select(F.col(id), "seq_num", "original_content", "embedded_content", size.alias("size")), [id], ["seq_num"], start, "g")
    elif heading:
        w = W.partitionBy(id).orderBy("seq_num")
        new = (F.row_number().over(w) > 1) & ~F.col(heading).eqNullSafe(F.lag(heading).over(w))
        rows = chunks.withColumn("_new", new.cast("int")).withColumn("g", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("int"))
    else:
        rows = chunks.withColumn("g", F.floor(F.col("seq_num") / n).cast("int"))
    fine = rows.select(F.col(id), "g", F.col("seq_num").alias("at"), "original_content", "embedded_content", F.lit("fine").alias("granularity"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "original_content"))), lambda x: x["original_content"]), "\n\n")
    coarse = fine.groupBy(id, "g").agg(joined.alias("original_content"))
    summary = first_sentences(F.col("original_content"), max_length).alias("embedded_content")
    coarse = coarse.select(id, "g", F.lit(2**31 - 1).alias("at"), "original_content", summary, F.lit("coarse").alias("granularity"))
    rows = fine.unionByName(coarse)
    seq = F.row_number().over(W.partitionBy(id).orderBy("g", "at")) - 1
    group = F.concat(F.col(id).cast("string"), F.lit("::g"), F.col("g").cast("string")).alias("group_id")
    return rows.select(F.col(id), seq.alias("seq_num"), group, "granularity", "original_content", "embedded_content")


def if_oversize(chunks: DataFrame, id: str = "doc_id", ceiling: int = 2000) -> DataFrame:
    """Chunks over the ceiling are sliced, and all are numbered anew; `parent_seq` is the number before."""
    over = F.greatest(F.length("original_content"), F.length("embedded_content")) > ceiling
    parts = F.when(over, slices(F.col("original_content"), ceiling)).otherwise(F.array("original_content"))
    rows = chunks.select(F.col(id), F.col("seq_num").alias("parent_seq"), over.alias("over"), F.col("embedded_content").alias("before"), F.posexplode(parts).alias("part", "original_content"))
    seq = F.row_number().over(W.partitionBy(id).orderBy("parent_seq", "part")) - 1
    return rows.select(F.col(id), seq.alias("seq_num"), "parent_seq", "original_content", F.when(F.col("over"), F.col("original_content")).otherwise(F.col("before")).alias("embedded_content"))


def semantic(docs: DataFrame, id: str = "doc_id", content: str = "content", percentile: float = 0.95, min_sentences: int = 3, max_chars: int = 2000, dimensions: int = 64) -> DataFrame:
    """Chunks of sentences that break where the hashed vectors of two in a row are as far apart as the document's percentile, once a
    chunk has min_sentences; or where a sentence would not fit in max_chars. Each text is gone through where it is; nothing is shuffled."""
    kind = docs.schema[id].dataType.simpleString()

    def run(of: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, token = Places(dimensions), re.compile(TOKEN)
        for batch in of:
            made = []
            for said, low in zip(batch.column("s"), batch.column("low"), strict=True):
                gaps = far([token.findall(x) for x in low.as_py()], places)
                made.append(joined(said.as_py(), gaps))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(made, pa.list_(pa.string()))], names=["id", "chunks"])

    def far(words: list[list[str]], places: Places) -> list[bool]:
        """Whether each sentence is as far from the next as the percentile of all such distances, or farther."""
        n, row = len(words), np.repeat(np.arange(len(words)), [len(w) for w in words])
        if n < 2:
            return [False] * n
        at = np.fromiter((places[w] for said in words for w in said), np.int64, len(row))
        both = np.bincount(row * 2 * dimensions + at, minlength=n * 2 * dimensions).reshape(n, 2, dimensions)
        parts = (both[:, 0] - both[:, 1]).astype(float)
        size = (parts * parts).sum(axis=1)
        unit = parts / np.sqrt(np.where(size > 0, size, 1))[:, None]
        # added up in the order of dimensions
        d = 1 - np.cumsum(unit[:-1] * unit[1:], axis=1)[:, -1]
        ordered, place = np.sort(d), (n - 2) * percentile
        below, above = int(np.floor(place)), int(np.ceil(place))
        limit = ordered[below] if ordered[below] == ordered[above] else (above - place) * ordered[below] + (place - below) * ordered[above]
        return [*(d >= limit).tolist(), False]

    def joined(said: list[str], gaps: list[bool]) -> list[str]:
        out, buf, length, gap = [], [], 0, False
        for s, after in zip(said, gaps, strict=True):
            if buf and (gap and len(buf) >= min_sentences or length + 1 + len(s) > max_chars):
                out.append(" ".join(buf))
                buf = []
            length = length + 1 + len(s) if buf else len(s)
            buf.append(s)
            gap = after
        return [*out, " ".join(buf)]

    said = docs.select(F.col(id).alias("id"), sentences(F.col(content)).alias("s")).where(F.size("s") > 0)
    chunks = said.withColumn("low", F.transform("s", lambda s: F.lower(s))).mapInArrow(run, f"id {kind}, chunks array<string>")
    return _explode(chunks.withColumnRenamed("id", id), id, F.col("chunks"))


def facts(text: Column, max_chars: int = 1200) -> Column:
    """Sentences of four words and more, cut to max_chars; a [tag] at the front of a line is dropped."""
    bare = F.regexp_replace(text, "(?m)^\\[[^\\]\\n]*\\][ ]*", "")
    return F.transform(F.filter(sentences(bare), lambda s: F.size(words(s)) >= 4), lambda s: F.substring(s, 1, max_chars))


def consolidation(docs: DataFrame, id: str = "doc_id", content: str = "content", fact_max_chars: int = 1200) -> DataFrame:
    """An episode chunk (the first four sentences) and a chunk for each fact."""
    bare = F.regexp_replace(content, "(?m)^\\[[^\\]\\n]*\\][ ]*", "")
    episode = F.struct(F.lit("episode").alias("kind"), F.array_join(F.slice(sentences(bare), 1, 4), " ").alias("text"))
    rest = F.transform(facts(F.col(content), fact_max_chars), lambda s: F.struct(F.lit("fact").alias("kind"), s.alias("text")))
    rows = docs.select(F.col(id), F.posexplode(F.concat(F.array(episode), rest)).alias("seq_num", "x"))
    return rows.select(id, "seq_num", F.col("x.kind").alias("kind"), F.col("x.text").alias("original_content"), F.col("x.text").alias("embedded_content"))


def code_blocks(source: str) -> list[dict]:
    """Top-level definitions of Python source and what is between them; a source that does not parse is one block."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return [{"kind": "fallback", "name": None, "first_line": 1, "last_line": source.count("\n") + 1, "text": source}]
    lines, out, other = source.split("\n"), [], []
    for node in tree.body:
        first = min([node.lineno, *[d.lineno for d in getattr(node, "decorator_list", [])]])
        text = "\n".join(lines[first - 1 : node.end_lineno])
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            out.append({"kind": "class" if isinstance(node, ast.ClassDef) else "function", "name": node.name, "first_line": first, "last_line": node.end_lineno, "text": text})
        else:
            other.append((first, node.end_lineno, text))
    if other:
        out.insert(0, {"kind": "module_block", "name": None, "first_line": other[0][0], "last_line": other[-1][1], "text": "\n".join(t for _, _, t in other)})
    return out


def code_aware(docs: DataFrame, id: str = "doc_id", content: str = "content") -> DataFrame:
    """A chunk for each top-level definition of Python sources."""
    kind = docs.schema[id].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [{"doc_id": d, "seq_num": i, **b} for d, s in zip(pdf["id"], pdf["s"], strict=True) for i, b in enumerate(code_blocks(s or ""))]
            yield pd.DataFrame(rows, columns=["doc_id", "seq_num", "kind", "name", "first_line", "last_line", "text"])

    return docs.select(F.col(id).alias("id"), F.col(content).alias("s")).mapInPandas(run, f"doc_id {kind}, seq_num int, kind string, name string, first_line int, last_line int, text string")
