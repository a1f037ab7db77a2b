"""Impact index, bit planes and prefix trie, against SQL and brute force on small tables."""

import collections
import hashlib
import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docloom.llm import bit_planes, impact_index, prefix_trie
from docloom.llm.common import fresh_path
from docloom.shared import cut

DIR = "/root/testdata/sf0.001"
WORDS = ["the", "The", "a", "of", "cat", "Dog", "straße", "日本", "é", "zebra", "x1", "42"]


def said(frame: pd.DataFrame):
    value = lambda v: None if v is None or v is pd.NA or v != v else int(v) if isinstance(v, float) and v == int(v) else v
    columns = sorted(frame.columns)
    return collections.Counter(tuple(value(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False))


def texts(seed: int, n: int):
    chance = random.Random(seed)
    out = [" ".join(chance.choices(WORDS, [60, 5, 40, 30, 5, 5, 3, 2, 2, 1, 1, 1], k=chance.choice((1, 3, 8, 40, 300)))) for _ in range(n)]
    return [*out, *out[: n // 3], None, "", " .,\x00\n", "!cat,the-cat_Cat\tDOG", "the " * 5000]


@pytest.mark.parametrize("block,block_words,parts,terms", [(4096, 1_000_000, 1, 100_000), (64, 1_000_000, 3, 5), (7, 200, 5, 1)])
def test_impact_search(spark, block, block_words, parts, terms):
    docs = [(i if i % 10 else None, t, "clash") for i, t in enumerate(texts(3, 150))] + [(5, "a cat", ""), (5, "a cat", "")]
    asked = [(1, "the cat"), (1, "the cat"), (None, "zebra zebra zebra the 日本"), (3, None), (4, ""), (5, "unknown words"), (6, "a " * 37 + "of é Dog"), (7, "cat")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, block string").repartition(parts)
    items = spark.createDataFrame(asked, "item_id bigint, text string")
    size = impact_index.corpus_size(frame)
    index = cut(impact_index.impact_index(frame, size, block, block_words))
    found = impact_index.ranked(index, size[0], items, block_terms=terms).toPandas()
    db = duckdb.connect()
    db.register("documents", pd.DataFrame(docs, columns=["doc_id", "text", "block"]).astype({"doc_id": "Int64"}))
    db.register("benchmark", pd.DataFrame(asked, columns=["item_id", "text"]).astype({"item_id": "Int64"}))
    assert said(found) == said(db.execute(impact_index.OP11_SQL).df()) and len(found) > 40


def test_impact_search_without_rows(spark):
    docs, items = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    size = impact_index.corpus_size(docs)
    assert size == (0, 0) and impact_index.ranked(cut(impact_index.impact_index(docs, size)), 0, items).count() == 0
    some = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    index = cut(impact_index.impact_index(some, (1, 1)))
    assert impact_index.ranked(index, 1, items.limit(0)).count() == 0
    with pytest.raises(ValueError):
        impact_index.impact_index(some, (1, 1), block=1 << 17)


def test_carry_arithmetic():
    chance = np.random.default_rng(1)
    a, b = chance.integers(0, 1 << 20, 64), chance.integers(0, 1 << 12, 64)
    slices = lambda v, n: np.array([[np.packbits((v >> i & 1).astype(np.uint8), bitorder="little").view(np.uint64)[0]] for i in range(n)])
    total = slices(a, 30)
    impact_index.add(total, slices(b, 12), 5)
    bits = np.array([np.unpackbits(total[i].view(np.uint8), bitorder="little") for i in range(30)]).astype(np.int64)
    assert ((bits << np.arange(30)[:, None]).sum(axis=0) == a + (b << 5)).all()
    sure, tied = impact_index.best(total, 9)
    chosen = np.unpackbits((sure | tied).view(np.uint8), bitorder="little").astype(bool)
    assert set(np.argsort(-(a + (b << 5)), kind="stable")[:9]) <= set(np.flatnonzero(chosen))


@pytest.mark.parametrize("planes", ["bit", "byte"])
@pytest.mark.parametrize("width,n", [(1, 1), (2, 65536), (2, 65537), (4, 200_003), (4, 0)])
def test_planes(planes, width, n):
    ids = np.random.default_rng(n).integers(0, 1 << 8 * width, n, dtype=np.uint64).astype(np.uint32)
    parts = bit_planes.to_planes(ids, width, planes)
    assert len(parts) == (8 * width if planes == "bit" else width)
    if n:
        assert (bit_planes.from_planes(parts, n, width, planes) == ids).all()


@pytest.mark.parametrize("planes", ["bit", "byte"])
def test_plane_files(spark, planes):
    path, known = public_tokenizers.path("byte_bpe_50k.json"), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own = [(i, t, 1) for i, t in enumerate(texts(8, 60))] + [(None, "no id", 1), (None, None, 1), (7, "seven again", 1), (7, "seven again", 1), (-3, "below zero 🙂 <|endoftext|>", 1), (99, "many words " * 60_000, 1)]
    docs = spark.createDataFrame(own, "doc_id bigint, text string, ids int").repartition(3)
    place = fresh_path(spark, "planes")
    bit_planes.write_planes(docs, place, path, end_id=2, planes=planes)
    back = spark.read.format("idplanes").load(place)
    rows = sorted(back.collect(), key=lambda r: r["start"])
    want = collections.Counter((i, np.array([*known.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t, _ in own)
    assert collections.Counter((r["doc_id"], bytes(r["ids"])) for r in rows) == want
    order = [-(1 << 63) if r["doc_id"] is None else r["doc_id"] for r in rows]
    assert order == sorted(order) and all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:], strict=False)) and rows[0]["start"] == 0
    few = back.where("doc_id >= 20 AND doc_id < 23 AND doc_id IN (1, 20, 22)")
    assert sorted(r["doc_id"] for r in few.collect()) == [20, 22] and back.where("doc_id = 99").count() == 1
    bit_planes.write_planes(docs.limit(0), place, path, end_id=2, planes=planes)  # a save replaces what was there
    assert spark.read.format("idplanes").load(place).count() == 0


def test_pieces_are_encoded_as_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    known, encoder, chance = Tokenizer.from_file(path), bit_planes.Encoder(path, most=50), random.Random(5)
    signs = [" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x0c", "\x00", "\x1c", "\x1f", "\x7f", "\x85", "\xa0", "\u1680", "\u2003", "\u2028", "\u202f", "\u205f", "\u3000", "\u200b", "\ufeff", "'s", "'", "ll", "é", "日本", "x", "Word", "12", "!?", "🙂", "\u0301", "<|endoftext|>", "à"]
    texts = ["".join(chance.choices(signs, k=chance.randint(0, 30))) for _ in range(4000)]
    for low in range(0, len(texts), 500):
        part = texts[low : low + 500]
        ids, counts = encoder(pa.array(part))
        want = [known.encode(t, add_special_tokens=False).ids for t in part]
        assert counts.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])


def test_op12_against_plain_encoding(spark):
    known, at, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, {}
    for doc, text in duckdb.sql(f"SELECT doc_id, text FROM '{DIR}/documents.parquet' ORDER BY doc_id").fetchall():
        ids = [*known.encode(text or "", add_special_tokens=False).ids, 2]
        want[doc] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert {r[0]: tuple(r)[1:] for r in bit_planes.op12_bit_planes(spark, DIR).collect()} == want


def plain_trie(turns):
    """Every node of the trie, by a dictionary of prefixes."""
    own = collections.defaultdict(list)
    for conv, turn, role, text in turns:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    order = lambda t: (t[0], hashlib.md5(f"{len(t[1])}:{t[1]}{t[2]}".encode()).hexdigest())
    own = {c: [t[1:] for t in sorted(v, key=order)] for c, v in own.items()}
    family = lambda c: c - (c - int(c / 100) * 100)
    again = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        again[c] = tuple(own.get(family(c), [])[:h] + v[h:])
    members = collections.defaultdict(list)
    for c, v in again.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    out = collections.Counter()
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        children = lambda n: sum(len(m) == len(n) + 1 and m[: len(n)] == n for m in members)
        ends = ",".join(map(str, sorted(c for c in convs if again[c] == node)))
        saved = sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n)
        out[(min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), children(node), sum(not children(n) for n in below), saved, hashlib.sha256(ends.encode()).hexdigest())] += 1
    return out


def conversations(seed: int, n: int):
    chance = random.Random(seed)
    out = []
    for c in [*range(n), 200, 207, 305, 1_000_000_007, -5, -105]:
        for turn in range(chance.choice((0, 1, 2, 3, 5, 9))):
            out.append((c, chance.choice((turn, turn, turn, 0, None)), chance.choice(("user", "assistant", None)), chance.choice(("hi", "", None, "ho ho", "ü"))))
    return out + [(None, 1, "user", "lost"), (9, 1, "user", "hi"), (9, 1, "user", "hi")] + [(500 + i, t, "user", "same") for i in range(25) for t in range(7)] + [(11, t, "user", "long") for t in range(60)]


@pytest.mark.parametrize("partitions,chunk", [(1, 4096), (3, 4096), (16, 2), (40, 4096)])
def test_prefix_trie(spark, partitions, chunk):
    turns = conversations(partitions, 60)
    frame = spark.createDataFrame([(*t, 0) for t in turns], "conv_id bigint, turn bigint, role string, text string, n int")
    found = prefix_trie.prefix_trie(prefix_trie.rebuilt(cut(prefix_trie.paths(frame))), partitions, chunk)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert collections.Counter(tuple(r) for r in found.select(*columns).collect()) == plain_trie(turns)


def test_prefix_trie_without_rows(spark):
    frame = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert prefix_trie.prefix_trie(prefix_trie.rebuilt(cut(prefix_trie.paths(frame)))).count() == 0
    one = spark.createDataFrame([(7, 1, None, None)], frame.schema)
    rows = prefix_trie.prefix_trie(prefix_trie.rebuilt(cut(prefix_trie.paths(one)))).collect()
    assert sorted((r["conv_id"], r["depth"], r["n_leaves"]) for r in rows) == ([(7, 0, 1)] if zlib.crc32(b"7") % 6 else [(7, 0, 1), (7, 1, 1)])


@pytest.mark.parametrize("name", ["op11", "op13"])
def test_queries_against_sql(spark, name):
    query, sql = {"op11": (impact_index.op11_impact_search, impact_index.OP11_SQL), "op13": (prefix_trie.op13_prefix_trie, prefix_trie.OP13_SQL)}[name]
    db = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    assert said(query(spark, DIR).select(F.col("*")).toPandas()) == said(db.execute(sql).df())
