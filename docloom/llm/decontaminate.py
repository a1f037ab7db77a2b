"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items' word sequences are put into one automaton. Each text's words are streamed through it: the state and the length
of the longest match that ends at a word tell whether an item's window of ``window`` words (a shorter item: all its words)
ends there, and which items hold it. Only runs of words that items use can hold a window, so the automaton walks those.

Items are dealt out to blocks of about ``max_block_words`` words; one of more words is cut into pieces that overlap by a window less a
word, so that no window is lost. Each block's automaton is made by a task and written to the shared folder; it is some 40 bytes a
word. With one block, documents pass through it in one stage, with no shuffle. With more, there is a stage for each block, which writes
what it found of texts that are hit, by digest; a task holds one automaton at a time, whatever the number of items. What was found is
then joined to the documents.

Defined cases: a null or empty text has no words and is not hit; a null or empty item has no window; repeated items and
documents are each treated as they stand; a null item_id counts as an item named ''; with no items nothing is hit; further
columns of the documents stay as they are (those of the result begin with ``hit_``).
"""

from __future__ import annotations

import pickle
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import FOLDED_SEPARATORS, cut, join_small, packed, table

_FOLD = bytes(32 if c in FOLDED_SEPARATORS else c + 32 if 65 <= c <= 90 else c for c in range(256))
_WORD = re.compile(rb"[^ ]+")
_WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_PIECE = 1 << 20
_SPANS = "array<struct<first:bigint,last:bigint,start:bigint,end:bigint>>"


class Automaton:
    """A suffix automaton of many word sequences. A state stands for word sequences that end at the same places. Most states have one
    way on, which is kept in arrays; the others' further ways are in dictionaries."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window, self.vocabulary = window, {}
        self.word, self.to, self.more = array("i", [0]), array("i", [0]), {}
        self.link, self.length = array("i", [-1]), array("i", [0])
        coded = []
        for item, words in items:
            ids = array("i", [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words])
            if ids:
                coded.append((item, ids))
                last = 0
                for w in ids:
                    last = self._extend(last, w)
        n = len(self.link)
        self.at_window = array("i", [-1]) * n  # the state of the last `window` words
        self.short = array("i", [-1]) * n  # the nearest state on the way to the root that ends a short item
        self.items: dict[int, set[str]] = {}
        self.whole: dict[int, list[tuple[int, str]]] = {}
        order = np.argsort(np.frombuffer(self.length, np.int32), kind="stable")[1:].tolist()
        for v in order:
            up = self.link[v]
            self.at_window[v] = v if self.length[up] < window <= self.length[v] else self.at_window[up]
        for item, ids in coded:
            v = 0
            for i, w in enumerate(ids):
                v = self.step(v, w)
                if i + 1 >= window:
                    self.items.setdefault(self.at_window[v], set()).add(item)
            if len(ids) < window:
                self.whole.setdefault(v, []).append((len(ids), item))
        for v in order:
            self.short[v] = v if v in self.whole else self.short[self.link[v]]
        self.least = min((min(len(ids), window) for _, ids in coded), default=1)

    def step(self, v: int, w: int) -> int | None:
        """The state after v and a word, or None."""
        if self.word[v] == w:
            return self.to[v]
        more = self.more.get(v)
        return more.get(w) if more else None

    def _lead(self, v: int, w: int, to: int) -> None:
        if self.word[v] in (0, w):
            self.word[v], self.to[v] = w, to
        else:
            self.more.setdefault(v, {})[w] = to

    def _new(self, length: int) -> int:
        self.word.append(0), self.to.append(0), self.link.append(0), self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, q: int, w: int) -> int:
        copy = self._new(self.length[p] + 1)
        self.word[copy], self.to[copy], self.link[copy] = self.word[q], self.to[q], self.link[q]
        if q in self.more:
            self.more[copy] = dict(self.more[q])
        self.link[q] = copy
        while p != -1 and self.step(p, w) == q:
            self._lead(p, w, copy)
            p = self.link[p]
        return copy

    def _extend(self, last: int, w: int) -> int:
        q = self.step(last, w)
        if q is not None:  # another item goes this way already
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, w)
        new, p = self._new(self.length[last] + 1), last
        while p != -1 and self.step(p, w) is None:
            self._lead(p, w, new)
            p = self.link[p]
        if p != -1:
            q = self.step(p, w)
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
        return new

    def walk(self, words: list[int], at: int, state: tuple[int, int], spans: list[list[int]], found: set[str]) -> tuple[int, int]:
        """Streams words, the first of which is word number at. Adds to spans (of word numbers, merged) and found."""
        v, long = state
        for i, w in enumerate(words, at + 1):
            while (to := self.step(v, w)) is None and v:
                v = self.link[v]
                long = self.length[v]
            v, long = (to, long + 1) if to is not None else (0, 0)
            hit = 0
            if long >= self.window:
                hit = long
                found |= self.items[self.at_window[v]]
            u = self.short[v]
            while u > 0:
                for size, item in self.whole[u]:
                    if size <= long:
                        hit = max(hit, size)
                        found.add(item)
                u = self.short[self.link[u]]
            if hit:
                lo = i - hit
                while spans and lo <= spans[-1][1]:
                    lo = min(lo, spans.pop()[0])
                spans.append([lo, i])
        return v, long

    def search(self, text: bytes) -> tuple[int, list[list[int]], set[str]]:
        """Number of words, spans of word numbers, items. The text comes in pieces; the state goes on from one to the next."""
        folded, at, lo, state = text.translate(_FOLD), 0, 0, (0, 0)
        spans: list[list[int]] = []
        found: set[str] = set()
        while lo < len(folded):
            hi = len(folded) if len(folded) - lo <= _PIECE else folded.find(b" ", lo + _PIECE)
            hi = len(folded) if hi < 0 else hi
            words = folded[lo:hi].split()
            n = len(words)
            if self.vocabulary:
                ids = list(map(self.vocabulary.get, words, [0] * n))
                known = np.fromiter(map(bool, ids), bool, n)
                edges = np.flatnonzero(np.diff(np.concatenate(([False], known, [False])).view(np.int8)))
                after = (0, 0)
                for a, b in zip(edges[::2], edges[1::2], strict=True):
                    if b - a >= self.least or a == 0 or b == n:
                        end = self.walk(ids[a:b], at + int(a), state if a == 0 else (0, 0), spans, found)
                        after = end if b == n else after
                state = after if n else state
            at, lo = at + n, hi
        return at, spans, found


def _automata(items: DataFrame, item_id: str, text: str, window: int, most: int) -> tuple[DataFrame, int]:
    """(block, automaton) and how many blocks there are."""

    def pieces(of: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in of:
            for name, value in zip(batch.column("name").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = value.encode().translate(_FOLD).split()
                for lo in range(0, max(len(words) - window + 1, min(len(words), 1)), most):
                    part = words[lo : lo + most + window - 1]
                    columns = [pa.array([name]), pa.array([b" ".join(part)]), pa.array([len(part)], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["name", "words", "n"])

    def build(of: pa.Table) -> pa.Table:
        rows = sorted(zip(of.column("name").to_pylist(), of.column("words").to_pylist(), strict=True))
        made = pickle.dumps(Automaton([(name, words.split()) for name, words in rows], window))
        return pa.table({"block": of.column("block").slice(0, 1), "automaton": pa.array([made], pa.binary())})

    named = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("name"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    cuts = cut(named.mapInArrow(pieces, "name string, words binary, n bigint"), "items")
    total = cuts.agg(F.sum("n")).first()[0] or 0
    blocks = 1 if total <= most else -(-2 * total // most)
    dealt = cuts.withColumn("block", F.pmod(F.xxhash64("name", "words"), F.lit(blocks)).cast("int"))
    made = cut(dealt.groupBy("block").applyInArrow(build, "block int, automaton binary"), "automata")
    return made, blocks if total else 0


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    max_block_words: int = 500_000,
    keep: list[str] | None = None,
) -> DataFrame:
    """docs (or its columns named in keep) with hit_spans (word numbers and code points, ends exclusive), hit_items (sorted)
    and hit_n_words; columns of these names are replaced."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("hit_spans", "hit_items", "hit_n_words")]
    rest = [c for c in keep if c != text]
    row = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)])
    packed = docs.select(row.alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    context = docs.sparkSession.sparkContext
    automata, blocks = _automata(items, item_id, item_text, window, max_block_words)
    schema = f"row {packed.schema['row'].dataType.simpleString()}, text string, spans {_SPANS}, items array<string>, n bigint"
    if blocks > 1:
        out = _by_block(packed, automata, blocks, schema, text in keep)
    else:
        made = automata.first()
        shared = context.broadcast(bytes(made["automaton"]) if made else pickle.dumps(Automaton([], window)))
        out = packed.mapInArrow(_searcher(shared, text in keep), schema)
    columns = [F.col("text" if c == text else f"row.c{rest.index(c)}").alias(c) for c in keep]
    return out.select(*columns, F.col("spans").alias("hit_spans"), F.col("items").alias("hit_items"), F.col("n").alias("hit_n_words"))


def _by_block(packed: DataFrame, automata: DataFrame, blocks: int, schema: str, keep_text: bool) -> DataFrame:
    """A stage for each block, then what they found for each row."""
    context = packed.sparkSession.sparkContext
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    found = None
    for block in range(blocks):
        made = automata.where(F.col("block") == block).first()
        if made:
            shared = context.broadcast(bytes(made["automaton"]))
            keyed = packed.select(F.struct(digest.alias("c0")).alias("row"), "text")
            one = schema[schema.index(", text") :]
            hits = keyed.mapInArrow(_searcher(shared, False), "row struct<c0:string>" + one).where("size(items) > 0")
            hits = cut(hits.select("row.c0", "spans", "items").dropDuplicates(["c0"]), "hits")
            shared.destroy()
            found = hits if found is None else found.unionByName(hits)

    def merge(of: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in of:
            spans = [_merged(x) for x in batch.column("spans").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("c0"), pa.array(spans, batch.column("spans").type), batch.column("items")], schema=batch.schema)

    each = found.groupBy("c0").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    merged = cut(each.mapInArrow(merge, each.schema), "hits")
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(_WORDS)).cast("bigint").alias("n")
    rows = packed.select("row", *(["text"] if keep_text else []), words, digest.alias("c0"))
    rows = join_small(rows, merged, ["c0"])
    empty = lambda c: F.coalesce(F.col(c), F.array()).alias(c)
    return rows.select("row", F.col("text") if keep_text else F.lit(None).cast("string").alias("text"), empty("spans"), empty("items"), "n")


def _searcher(shared, keep_text: bool):
    def run(of: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = pickle.loads(shared.value)
        span = pa.list_(pa.struct([(c, pa.int64()) for c in ("first", "last", "start", "end")]))
        for batch in of:
            row, texts = batch.columns
            spans, items, counts = [], [], []
            for text in texts:
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                n, hits, found = automaton.search(data)
                counts.append(n)
                items.append(sorted(found))
                spans.append(_placed(data, hits) if hits else [])
            texts = texts if keep_text else pa.nulls(len(texts), texts.type)
            columns = [row, texts, pa.array(spans, span), pa.array(items, pa.list_(pa.string())), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "text", "spans", "items", "n"])

    return run


def _merged(spans: list[dict[str, int]]) -> list[dict[str, int]]:
    out: list[dict[str, int]] = []
    for x in sorted(spans, key=lambda x: (x["first"], x["last"])):
        if out and x["first"] <= out[-1]["last"]:
            if x["last"] > out[-1]["last"]:
                out[-1] |= {"last": x["last"], "end": x["end"]}
        else:
            out.append(dict(x))
    return out


def _placed(data: bytes, spans: list[list[int]]) -> list[dict[str, int]]:
    """Spans of word numbers with their places in code points."""
    wanted = {i for lo, hi in spans for i in (lo, hi - 1)}
    places = {i: m.span() for i, m in enumerate(_WORD.finditer(data.translate(_FOLD))) if i in wanted}
    points, at, out = 0, 0, []
    for lo, hi in spans:
        a, b = places[lo][0], places[hi - 1][1]
        start = points + len(data[at:a].decode())
        points, at = start + len(data[a:b].decode()), b
        out.append({"first": lo, "last": hi, "start": start, "end": points})
    return out


def _n_hit():
    return F.aggregate("hit_spans", F.lit(0).cast("bigint"), lambda n, x: n + x["last"] - x["first"])


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", max_span_words: int = 13, max_coverage: float = 0.5, **how) -> DataFrame:
    """docs without those of whose words more than max_coverage are hit; hit spans of max_span_words words or more, and those
    that hold the whole of an item of fewer words, are cut out of the others' texts. Columns as before, whatever their names."""
    docs, columns = packed(docs, text)
    text = "text"
    found = find_contamination(docs, items, **how)
    kept = found.where(_n_hit() <= max_coverage * F.col("hit_n_words"))
    long = F.filter("hit_spans", lambda x: x["last"] - x["first"] >= max_span_words)
    short = items.where(F.regexp_count(how.get("item_text", "text"), F.lit(_WORDS)).between(1, max_span_words - 1))
    if not short.isEmpty():
        # in a window longer than these items they are hit as a whole only
        kept = kept.withColumnsRenamed({"hit_spans": "hit_all", "hit_n_words": "hit_all_words"}).drop("hit_items")
        kept = find_contamination(kept, short, **(how | {"window": max_span_words}))
        whole = lambda x: F.exists("hit_spans", lambda y: (y["first"] >= x["first"]) & (y["last"] <= x["last"]))
        long = F.filter("hit_all", lambda x: (x["last"] - x["first"] >= max_span_words) | whole(x))
    begin = F.concat(F.array(F.lit(1).cast("bigint")), F.transform(long, lambda x: x["end"] + 1))
    stop = F.concat(F.transform(long, lambda x: x["start"] + 1), F.array(F.char_length(text).cast("bigint") + 1))
    pieces = F.zip_with(begin, stop, lambda a, b: F.substring(F.col(f"`{text}`"), a.cast("int"), (b - a).cast("int")))
    clean = F.when(F.size(long) > 0, F.array_join(pieces, "")).otherwise(F.col(f"`{text}`"))
    return kept.select("kept_row", clean.alias("text")).select(*columns)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id",
        F.col("hit_n_words").alias("n_words"),
        _n_hit().alias("n_hit"),
        F.size("hit_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"),
    )


OP1_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT DISTINCT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n),
hits AS (
  SELECT k, i, p.n, item_id FROM (SELECT k, i, n, array_to_string(w[i : i + n - 1], ' ') AS win FROM places) p JOIN windows USING (n, win)),
covered AS (SELECT k, count(*) AS n_hit FROM (SELECT DISTINCT k, unnest(range(i, i + n)) AS at FROM hits) GROUP BY k),
named AS (SELECT k, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS name FROM hits) GROUP BY k)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (k) LEFT JOIN named USING (k)
"""
