"""What is shuffled and made by queries over texts: it does not grow with tokens or with pairs of rows and queries."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.functions import batches
from docloom.functions.text import sentences, tokens
from docloom.operators import chunkers, extractors, graph, hints, memory_store, search, summaries, text_index
from docloom.streaming import events as streams


def _shuffled(spark, run) -> tuple[int, object]:
    """Bytes that a job shuffles, and what it returns."""

    def written() -> int:
        gateway = spark.sparkContext._gateway
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = written()
    out = run()
    return written() - before, out


@pytest.fixture(scope="module")
def texts(spark):
    """600 texts of 100 words, about 400 kB."""
    chance = random.Random(7)
    words = [f"w{i:04}" for i in range(900)]
    return spark.createDataFrame([(i, " ".join(chance.choices(words, k=100))) for i in range(600)], "id bigint, text string").repartition(4).cache()


def test_a_segment_is_made_without_a_shuffle_of_terms(spark, tmp_path, texts):
    texts.count()
    index = text_index.TextIndex.create(spark, f"{tmp_path}/ix", ["text"], 4)
    shuffled, _ = _shuffled(spark, lambda: index.add(texts))
    assert shuffled < 20_000
    asked = spark.createDataFrame([(i, f"w{i:04} w{i + 1:04}") for i in range(40)], "id int, text string")
    assert index.search(asked, 3).groupBy("query").count().where("count = 3").count() == 40


def test_texts_are_searched_without_a_shuffle_of_terms(spark, texts):
    asked = spark.createDataFrame([(i, " ".join(f"w{j:04}" for j in range(20 * i, 20 * i + 20))) for i in range(40)] + [(99, None), (98, "nothing")], "q int, text string")
    texts.count()
    own, plain = (search.Postings(texts, ["id"], "text", unique=u) for u in (True, False))
    shuffled, found = _shuffled(spark, lambda: own.match(asked, "q", "text").collect())
    assert shuffled < 20_000
    tokens = {r["id"]: set(r["text"].split()) for r in texts.collect()}
    assert sorted((r["q"], r["id"]) for r in found) == sorted((r["q"], i) for r in asked.collect() if r["text"] for i, said in tokens.items() if said & set(r["text"].split()))
    assert sorted(own.top(asked, "q", "text", 5).collect()) == sorted(plain.top(asked, "q", "text", 5).collect())
    shuffled, _ = _shuffled(spark, lambda: own.top(asked, "q", "text", 5).collect())
    assert shuffled < 120_000


def test_no_row_is_made_of_each_pair_of_neighbours(spark, texts):
    assert "Generate" not in hints.neighbour_counts(texts, "text", 1)._jdf.queryExecution().executedPlan().toString()
    made = spark.createDataFrame([("zebra apple apple mango",), (None,), ("mango zebra",)], "text string").coalesce(1)
    assert {tuple(r) for r in hints.neighbour_counts(made, "text", 2).collect()} == {("apple", "zebra", 2), ("apple", "mango", 2), ("mango", "zebra", 1)}


def test_neighbours_are_dealt_out_in_blocks(spark, texts, monkeypatch):
    texts.count()
    kept = lambda rows: {r["term"]: (r["m"], r["embedding"]) for r in hints.term_vectors(rows, "text").collect()}
    shuffled, vectors = _shuffled(spark, lambda: kept(texts))
    assert len(vectors) == 900 and shuffled < 2_500_000  # more than 200,000 pairs go each way, twice
    monkeypatch.setattr(hints, "PAIRS", 20_000)
    assert hints._parts(texts, 10**6) == 100 and kept(texts.repartition(3)) == vectors
    rows = hints._dealt_pairs(texts.repartition(24), "text", 4, 3, 1).toArrow().to_batches()
    assert sum(len(b) for b in rows) == 24  # so many are added up that pairs are added up more than once
    owners, others, to, own, other, n = hints._counted(iter(rows))
    assert len(owners) == len(others) == 900 and not to.any() and n.sum() == 2 * hints._meetings(texts, "text", 4, 3)
    assert len(set(zip(own.tolist(), other.tolist(), strict=True))) == len(n)


@pytest.mark.parametrize("sharing", [False, True])
def test_the_exact_scan_is_that_of_all_cells(spark, sharing):
    chance = np.random.default_rng(4)
    x = chance.normal(size=(500, 12)) * (chance.random((500, 12)) < 0.3)
    x[50:90], x[200:260], x[-1] = x[50], 0, 1e-9
    y = np.concatenate((x[::9], np.zeros((2, 12)), np.eye(12)))
    rows, queries = (spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id int, v array<double>").repartition(3, "id") for m in (x, y))
    unit = lambda m: m / np.where((size := np.linalg.norm(m, axis=1, keepdims=True)) > 0, size, 1)
    scores = np.round(unit(y) @ unit(x).T, 6)
    if sharing:
        scores[((y[:, None] != 0) & (x[None] != 0)).sum(axis=2) == 0] = -np.inf
    for least in (-np.inf, 0.5):
        want = [(q, int(i)) for q in range(len(y)) for i in np.lexsort((np.arange(len(x)), -scores[q]))[:7] if np.isfinite(scores[q, i]) and scores[q, i] >= least]
        for block in (8192, 16):
            found = search.nearest(rows, queries, 7, block, 20, sharing, least).orderBy("query", "rank").collect()
            assert [(r["query"], r["id"]) for r in found] == want


def test_semantic_chunks_are_made_without_a_shuffle(spark):
    said = "One two three. Four five six. Four five six. Red green blue. Red green. Blue."
    rows = spark.createDataFrame([(1, said), (2, ""), (3, None), (4, "Alone here."), (5, " ".join([said] * 9))], "doc_id bigint, content string").repartition(3).cache()
    rows.count()
    shuffled, found = _shuffled(spark, lambda: chunkers.semantic(rows, min_sentences=1, max_chars=200).collect())
    texts = {}
    for r in sorted(found, key=lambda r: (r["doc_id"], r["seq_num"])):
        texts.setdefault(r["doc_id"], []).append(r["original_content"])
    assert shuffled == 0 and set(texts) == {1, 4, 5} and texts[4] == ["Alone here."]
    assert " ".join(texts[1]) == said and " ".join(texts[5]) == " ".join([said] * 9) and max(map(len, texts[5])) <= 200


def test_tokens_of_batches_are_those_of_the_function(spark):
    said = ["a-b", "-c", "d-", "-e", None, "", "f--g h-i-j", "KKelvin İstanbul straße École", "x" * 40 + "-9", "---", "z"]
    rows = spark.createDataFrame(list(enumerate(said)), "i int, t string").select("i", F.lower("t").alias("t"), tokens(F.col("t")).alias("w")).orderBy("i").collect()
    for texts in (pa.array([r["t"] for r in rows]), pa.array(["no", *[r["t"] for r in rows]]).slice(1)):
        text, code, names = batches.token_codes(texts)
        assert names.to_pylist() == sorted({t for r in rows for t in r["w"] or ()})
        assert [(i, names[c].as_py()) for i, c in zip(text.tolist(), code.tolist(), strict=True)] == [(r["i"], t) for r in rows for t in r["w"] or ()]
    assert [len(x) for x in batches.token_codes(pa.array([None, "", "-"]))] == [0, 0, 0]
    batch = pa.RecordBatch.from_pydict({"t": ["x" * n for n in (5, 50, 5, 5, 0, 3)]})
    assert [len(b) for b in batches.sized(iter([batch.slice(1), batch]), "t", 10)] == [1, 3, 1, 1, 1, 3, 1]


@pytest.mark.parametrize("rare", [False, True])
def test_many_texts_are_walked_at_once(rare):
    chance = np.random.default_rng(5)
    sizes, per = [4, 9, 5], 3
    term = [chance.integers(0, 7, n * per) for n in sizes]
    alone = [summaries.centrality(np.zeros(n, int), np.repeat(np.arange(n), per), t, rare, 0.85, 50) for n, t in zip(sizes, term, strict=True)]
    text = np.repeat(np.arange(3), sizes)
    assert np.array_equal(summaries.centrality(text, np.repeat(np.arange(len(text)), per), np.concatenate(term), rare, 0.85, 50), np.concatenate(alone))


def test_summaries_of_batches(spark, texts):
    rows = texts.select("id", F.regexp_replace("text", "(\\w+ \\w+ \\w+ \\w+)", "$1.").alias("content")).union(spark.createDataFrame([(900, None), (901, "One. Two."), (902, "- . - . - . - . -")], "id bigint, content string"))
    found = {r["id"]: r["summary"] for r in summaries.central_sentences(rows, "id", n=3).collect()}
    said = {r["id"]: r["s"] for r in rows.select("id", sentences(F.coalesce("content", F.lit(""))).alias("s")).collect()}
    assert len(found) == 603 and (found[900], found[901], found[902]) == ("", "One. Two.", "- . - . - .")
    assert all(summary.count(".") == 3 and all(f"{s.strip()}." in said[i] for s in summary.split(".") if s) for i, summary in found.items() if i < 600)


def test_top_terms_are_told_where_the_text_is(spark, texts):
    texts.count()
    made = texts.union(spark.createDataFrame([(900, None), (901, "the of"), (902, "Rare rare-one w0001 zz"), (903, "")], "id bigint, text string")).cache()
    made.count()
    shuffled, found = _shuffled(spark, lambda: extractors.top_terms(made, "id", "text", 3, unique=True).collect())
    assert shuffled == 0
    held = {r["id"]: [w for w in r["text"].lower().split() if w not in ("the", "of") and len(w) > 2] for r in made.where("text IS NOT NULL").collect()}
    times = {i: {w: said.count(w) for w in said} for i, said in held.items() if said}
    rows = lambda found: {i: [(r["term"], r["tf"], r["score"]) for r in sorted(found, key=lambda r: r["rank"]) if r["id"] == i] for i in times}
    assert rows(found) == {i: [(w, n, float(n)) for w, n in sorted(of.items(), key=lambda x: (-x[1], x[0]))[:3]] for i, of in times.items()}
    df = {w: sum(w in of for of in times.values()) for of in times.values() for w in of}
    want = {i: [(w, n, round(n * np.log(604 / df[w]), 6)) for w, n in sorted(of.items(), key=lambda x: (-round(x[1] * np.log(604 / df[x[0]]), 6), x[0]))[:3]] for i, of in times.items()}
    told = made.select(F.col("id").alias("_key"), F.lower("text").alias("_low"))
    for common in (extractors.COMMON, 900, 1):  # all terms are common, some are rare, all are
        shuffled, found = _shuffled(spark, lambda c=common: extractors._top_tf_idf(told, 604, 3, 3, c).withColumnRenamed("_key", "id").collect())
        assert rows(found) == want and (common < 1000 or shuffled < 120_000)
    twice = spark.createDataFrame([(1, "one two"), (1, "two six"), (2, None)], "id int, text string")
    assert [(r["term"], r["tf"]) for r in extractors.top_terms(twice, "id", "text", 2).orderBy("rank").collect()] == [("two", 2), ("one", 1)]


def test_pairs_of_own_terms_are_counted_where_the_text_is(spark, texts):
    few = F.regexp_replace(F.regexp_replace("text", "w\\d(\\d)\\d\\d", "w0$1"), "(\\w+ \\w+ \\w+ \\w+)", "$1.")
    made = texts.select("id", few.alias("text")).union(spark.createDataFrame([(900, None), (901, "Red. Red."), (902, ""), (903, "Red blue. Red-hot blue red? Blue, red the of.")], "id bigint, text string")).cache()
    made.count()
    shuffled, found = _shuffled(spark, lambda: extractors.cooccurrence(made, "id", "text", k=5, min_count=2, n_terms=4).collect())
    plain = extractors.cooccurrence(made, "id", "text", extractors.top_terms(made, "id", "text", 4), 5, 2)
    assert shuffled == 0 and sorted(found) == sorted(plain.collect()) and len(found) > 2000
    assert [tuple(r) for r in found if r["id"] > 600] == [(903, "blue", "red", 3, 1)]


def test_sessions_come_with_the_events_of_their_key(spark, tmp_path):
    chance, held = random.Random(11), []
    for batch in range(3):
        new = [(chance.choice([1, 2, None]), chance.randrange(0, 200_000)) for _ in range(60)]
        held += new
        rows = spark.createDataFrame(new, "who bigint, s bigint").select("who", F.timestamp_seconds(F.col("s") + 100_000).alias("at"))
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        # a state store in memory, with no calls for maps and timers, is enough
        stream = streams.revised_sessions(spark.readStream.schema("who bigint, at timestamp").parquet(f"{tmp_path}/in"), "at", "who", "20 minutes", "90 days")
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
        streams.run_available(stream, f"{tmp_path}/out", f"{tmp_path}/state")
        revisions = spark.read.schema(stream.schema).parquet(f"{tmp_path}/out")
        found = streams.latest_sessions(revisions, "who").select("who", F.unix_seconds("start").alias("a"), F.unix_seconds("last").alias("b"), "n_events").collect()
        want = []
        for who in (1, 2, None):
            times = sorted(t + 100_000 for w, t in held if w == who)
            starts = [i for i, t in enumerate(times) if not i or t >= times[i - 1] + 1200]
            want += [(who, times[i], times[j - 1], j - i) for i, j in zip(starts, [*starts[1:], len(times)], strict=True)]
        assert sorted(map(tuple, found), key=str) == sorted(want, key=str)
    assert revisions.where("n_events = 0").count() and revisions.agg(F.max("revision")).first()[0] == 3


def test_salient_facts_make_no_lists_of_words_in_python(spark, texts):
    few = F.regexp_replace(F.regexp_replace("text", "w\\d(\\d)\\d\\d", "w0$1"), "(\\w+ \\w+ \\w+ \\w+)", "$1.")
    made = texts.select("id", few.alias("text")).union(spark.createDataFrame([(900, None), (901, "a. The of. I"), (902, ""), (None, "One. Two two-one. One")], "id bigint, text string")).withColumn("_n", F.lit("clash"))
    found = memory_store.salient_facts(made, ["id", "_n"], "text", 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "MapInArrow" in plan
    got = {}
    for r in sorted(found.collect(), key=lambda r: r["fact_seq"]):
        got.setdefault(r["id"], []).append((r["fact_seq"], r["support_span"], r["confidence"], r["_n"]))
    want = {}
    for r in made.select("id", sentences(F.col("text")).alias("s"), F.transform(sentences(F.col("text")), tokens).alias("w")).collect():
        words = [[t for t in w if len(t) >= 2 and t not in ("the", "of")] for w in r["w"] or ()]
        score = {i: 1000 * sum(sum(x.count(t) for x in words) for t in w) // len(w) for i, w in enumerate(words) if w}
        top = sorted(sorted(score, key=lambda i: (-score[i], i))[:3])
        if top:
            want[r["id"]] = [(k, r["s"][i], round(1 - k / len(top), 3), "clash") for k, i in enumerate(top)]
    assert got == want and len(want) == 601


def test_large_tables_of_a_walk_do_not_go_by_way_of_the_driver(spark, monkeypatch):
    plans, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df, what: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df, what))
    rows = spark.range(1, 25_001)
    edges = rows.select(F.col("id").alias("src"), F.floor(F.col("id") / 2).alias("dst"), F.lit(0.9).alias("confidence"), F.lit("e").alias("evidence")).where("dst > 0")
    walk = lambda anchors: graph.impact(edges, anchors.select(F.col("id").alias("anchor")), 3)
    many = walk(rows)
    plans.append(many._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 3 and not any("Broadcast" in plan for plan in plans) and many.count() == sum(a.bit_length() > h for a in range(1, 25_001) for h in (1, 2, 3))
    plans.clear()
    assert sorted((r["anchor"], r["node"], r["hop"]) for r in walk(rows.where("id IN (9, 1, 4)")).collect()) == [(4, 1, 2), (4, 2, 1), (9, 1, 3), (9, 2, 2), (9, 4, 1)]
    assert any("Broadcast" in plan for plan in plans)
