"""Small cases of the operators, with edge cases."""

import hashlib
import io
import math
import os
import random
import re
import zipfile
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.functions import text as t
from docloom.operators import chunkers, evaluation, extractors, framers, gazetteer, graph, hints, html, incremental, ingest, memory, search, tables, text_index, vector_index
from docloom.plans import searching
from docloom.sources import comments, files
from docloom.sources.tables import together
from docloom.streaming import events as streams


def docs(spark, *contents):
    return spark.createDataFrame([(i, c) for i, c in enumerate(contents)], "doc_id bigint, content string")


def texts(df, column="original_content", order=("doc_id", "seq_num")):
    return [r[column] for r in df.orderBy(*order).collect()]


def test_fixed_overlap_windows(spark):
    rows = chunkers.fixed_overlap(docs(spark, " ".join(f"w{i}" for i in range(600)), "", None, "one  two"))
    found = rows.where("doc_id = 0").orderBy("seq_num").collect()
    assert [r["start_word"] for r in found] == [0, 150, 300]
    assert found[-1]["n_words"] == 300 and found[-1]["original_content"].endswith("w599")
    assert rows.where("doc_id in (1, 2)").count() == 0
    assert texts(rows.where("doc_id = 3")) == ["one two"]


def test_neighbors(spark):
    base = chunkers.fixed_overlap(docs(spark, " ".join(f"w{i}" for i in range(150))), window=50, step=50)
    middle = chunkers.neighbor_expand(base).where("seq_num = 1").first()
    assert [w for w in ("w0 ", "w50 ", "w100 ") if w in middle["embedded_content"]] == ["w0 ", "w50 ", "w100 "]
    assert middle["original_content"].startswith("w50 ")


def test_sentence_aware_packs_and_splits(spark):
    long = "Word word. " * 30
    rows = chunkers.sentence_aware(docs(spark, f"a b\n\nc d\n\n{long}", "x" * 250), max_chars=100)
    assert all(len(x) <= 100 for x in texts(rows))
    assert texts(rows)[0].startswith("a b\n\nc d")
    assert [len(x) for x in texts(rows.where("doc_id = 1"))] == [100, 100, 50]


def test_heading_frames_and_hierarchy(spark):
    frames = framers.heading_boundary(docs(spark, "before\n# One\nbody one\n## Two\n" + "y" * 30, "no heading"))
    assert [r["frame_id"] for r in frames.orderBy("frame_id").collect()] == ["0#0", "0#1", "0#2", "1"]
    sections = chunkers.hierarchy(frames, min_section_chars=10, max_chars=20)
    two = sections.where("heading = 'Two'").orderBy("section_part").collect()
    assert [len(r["original_content"]) for r in two] == [20, 10]
    assert two[0]["embedded_content"].startswith("Two\n\n")


def test_regex_frames_drop_what_is_before(spark):
    frames = framers.regex_boundary(docs(spark, "x\n--a\n\n--b"), "^--")
    assert texts(frames, "text", ("frame_seq",)) == ["--a", "--b"]


def test_consolidation(spark):
    rows = chunkers.consolidation(docs(spark, "[user] I like green tea a lot. Yes.\n[bot] Noted that for later use."))
    assert [r["kind"] for r in rows.orderBy("seq_num").collect()] == ["episode", "fact", "fact"]


def test_code_blocks():
    blocks = chunkers.code_blocks("import os\n\n@d\ndef f():\n    pass\n\nclass A:\n    x = 1\n")
    assert [(b["kind"], b["name"], b["first_line"]) for b in blocks] == [("module_block", None, 1), ("function", "f", 3), ("class", "A", 7)]
    assert chunkers.code_blocks("def (")[0]["kind"] == "fallback"


def test_semantic_is_whole(spark):
    said = "Cats purr. Cats sleep. Cats eat. Stocks fell today. Stocks rose. Stocks fell."
    assert " ".join(texts(chunkers.semantic(docs(spark, said)))) == said


def test_if_oversize_renumbers(spark):
    rows = chunkers.if_oversize(chunkers.fixed_overlap(docs(spark, "a" * 25 + " b")), ceiling=10)
    assert [len(x) for x in texts(rows)] == [10, 10, 7]


def test_reducer_is_idempotent(spark):
    df = spark.createDataFrame([("The cat sat on the mat , and it slept .",)], "s string").select(t.reduce_filler(F.col("s")).alias("s"))
    once = df.first()["s"]
    assert once == "cat sat mat slept" and df.select(t.reduce_filler(F.col("s"))).first()[0] == once


def test_urls(spark):
    df = spark.createDataFrame([("HTTP://A.Example/x?q=1#f",), ("http://a",)], "u string")
    assert [r[0] for r in df.select(t.normal_url(F.col("u"))).collect()] == ["http://a.example/x?q=1", "http://a/"]


def test_html(spark):
    page = '<title> T </title><script>var t="</p>";</script><!-- c --><p>a &lt; b</p><a href="mailto:x">m</a><a href="/r">r</a><a href="s">s</a>'
    df = spark.createDataFrame([("http://h.org/d/p.html?x=1", page)], "u string, h string")
    row = df.select(html.text(F.col("h")), html.title(F.col("h")), F.transform(html.links(F.col("h")), lambda x: html.absolute(F.col("u"), x))).first()
    assert row[0] == "T\na < b\nm\nr\ns" and row[1] == "T" and row[2] == ["http://h.org/r", "http://h.org/d/s"]


def test_where_rejects_unknown(spark):
    with pytest.raises(ValueError):
        search.where(spark.range(1), nothing=1)


def test_fusion(spark):
    a = spark.createDataFrame([(0, 1, 3.0), (0, 2, 1.0)], "q int, d int, score double")
    b = spark.createDataFrame([(0, 2, 7.0)], "q int, d int, score double")
    rrf = {r["d"]: r["score"] for r in search.fuse_rrf({"a": a, "b": b}, ["q"], ["d"]).collect()}
    assert rrf[2] == pytest.approx(1 / 62 + 1 / 61, abs=1e-9) and rrf[1] == pytest.approx(1 / 61, abs=1e-9)
    weighted = {r["d"]: r["score"] for r in search.fuse_weighted({"a": a, "b": b}, ["q"], ["d"]).collect()}
    assert weighted == {1: 1.0, 2: 1.0}
    with pytest.raises(ValueError):
        search.fuse_rrf({"a": a}, ["q"], ["d"], 0)


def test_metrics(spark):
    df = spark.createDataFrame([(0, 3), (1, None), (2, 1)], "q int, rank int")
    row = evaluation.scores(df).first()
    assert row["recall_3"] == pytest.approx(2 / 3, abs=1e-6) and row["ndcg_3"] == pytest.approx(0.5, abs=1e-6) and row["mrr"] == pytest.approx((1 / 3 + 1) / 3, abs=1e-6)


def test_impact_cycle(spark):
    edges = spark.createDataFrame([("a", "b", 0.9, "x", "calls"), ("b", "a", 0.8, "y", "calls"), ("b", "c", 0.2, "z", "calls")], "src string, dst string, confidence double, evidence string, kind string")
    anchors = spark.createDataFrame([("a",)], "anchor string")
    found = {r["node"]: r["hop"] for r in graph.impact(edges, anchors, 4).collect()}
    assert found == {"b": 1, "a": 2}
    with pytest.raises(ValueError):
        graph.impact(edges, anchors, 11)


def test_overwrite_guards_foreign_rows(spark):
    rows = spark.createDataFrame([("1", "a")], "id string, source string")
    with pytest.raises(ValueError):
        tables.overwrite(rows, rows, "b")
    assert tables.overwrite(rows, rows, "a").count() == 1
    with pytest.raises(ValueError):
        tables.append_preflight(rows, rows, ["missing"])


def test_merge_keeps_source(spark):
    schema = "id string, doc_id string, seq_num int, text string, source string, created_at int"
    old = spark.createDataFrame([("d::0", "d", 0, "x", "s1", 1), ("d::1", "d", 1, "y", "s1", 1), ("e::0", "e", 0, "z", "s1", 1)], schema)
    new = spark.createDataFrame([("d::0", "d", 0, "X", "s2", 2)], schema)
    out = {r["id"]: (r["text"], r["source"], r["created_at"]) for r in tables.merge(old, new, True).collect()}
    assert out == {"d::0": ("X", "s1", 1), "e::0": ("z", "s1", 1)}


def test_cursor(spark):
    state = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None)], "k string, h string")
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None), ("d", "1")], "k string, h string")
    assert sorted(r["k"] for r in incremental.changed(now, state, "k", "h").collect()) == ["b", "d"]
    assert incremental.deleted(now, state, "k").count() == 0 and incremental.deleted(state, now, "k").first()["k"] == "d"


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts.items():
            z.writestr(name.replace("__", "/").replace("_x", ".x"), data)
    return out.getvalue()


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("# hi\x00")
    (tmp_path / "sub" / "b.html").write_text("<p>x</p>")
    (tmp_path / "c.docx").write_bytes(zipped(word__document_xml='<w:d xmlns:w="u"><w:p><w:t>one</w:t><w:t> two</w:t></w:p><w:p><w:t>three</w:t></w:p></w:d>'))
    (tmp_path / "d.docx").write_bytes(b"broken")
    (tmp_path / "e.xlsx").write_bytes(zipped(xl__worksheets__sheet1_xml='<s><row><c><v>1</v></c><c t="inlineStr"><is><t>x</t></is></c></row></s>'))
    rows = {r["title"]: r for r in files.read_files(spark, str(tmp_path), id="stem").collect()}
    # a text with NUL in front is taken for binary
    assert rows["a.md"]["error"] and rows["b.html"]["content"] == "x" and rows["c.docx"]["content"] == "one two\nthree"
    assert rows["d.docx"]["content"] is None and "BadZipFile" in rows["d.docx"]["error"] and rows["e.xlsx"]["content"] == "1\tx"
    assert rows["b.html"]["doc_id"] == "b"


def test_json_corpus(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"documents": [{"id": 1, "content": "x", "tags": ["a"]}, {"id": 2, "content": "y", "title": "t"}]}')
    rows = files.read_json_corpus(spark, str(tmp_path / "c.json")).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["title"], r["metadata"]) for r in rows] == [("1", None, '{"tags":["a"]}'), ("2", "t", "{}")]


def test_comments(spark):
    df = spark.createDataFrame([("a.py", "#!/bin/x\n# first line of it\n# second line\nx = 1\n# noqa\n"), ("b.txt", "# nothing at all here")], "source_path string, content string")
    rows = comments.comment_documents(df).collect()
    assert [(r["doc_id"], r["first_line"], r["last_line"], r["text"]) for r in rows] == [("a.py#L2", 2, 3, "first line of it\nsecond line")]


def test_together(spark):
    a, b = docs(spark, "x"), docs(spark, "y").withColumn("title", F.lit("t"))
    assert sorted((r["source_index"], r["title"]) for r in together(a, b).fillna("").collect()) == [(0, ""), (1, "t")]


def nearest(ids, vectors, queries, k):
    unit = vectors / np.where((n := np.linalg.norm(vectors, axis=1, keepdims=True)) > 0, n, 1)
    score = np.round(unit[queries] @ unit.T, 6)
    return {int(ids[q]): [int(ids[i]) for i in np.lexsort((ids, -s))[:k]] for q, s in zip(queries, score, strict=True)}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_recall_of_ann_on_embeddings(spark):
    found = {}
    for r in searching.ann_index(spark, "/root/testdata/sf0.01").collect():
        found.setdefault(r["query"], {})[r["rank"]] = r["vec_id"]
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").toPandas()
    ids = table["vec_id"].to_numpy()
    expected = nearest(ids, np.array(table["embedding"].tolist(), float), np.flatnonzero(ids % 20 == 0), searching.K)
    hits = [len(set(found[q].values()) & set(best)) / len(best) for q, best in expected.items()]
    assert found.keys() == expected.keys() and sum(hits) / len(hits) >= 0.9


def test_ann_is_exact_over_blocks_and_ties(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(60, 8))
    vectors[10:30], vectors[40] = vectors[10], 0
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id bigint, v array<double>").repartition(3)
    expected = nearest(np.arange(60), vectors, np.arange(0, 60, 5), 7)
    for row_block, query_block in ((8192, 512), (4, 3)):
        found = search.ann_join(rows, rows.where("id % 5 = 0"), "id", "v", 7, row_block, query_block).orderBy("query", "rank").collect()
        by = {}
        for r in found:
            by.setdefault(r["query"], []).append(r["id"])
        assert by == expected
    odd = spark.createDataFrame([(100, None), (101, [1.0, None])], rows.schema)
    assert {r["score"] for r in search.ann_join(odd, rows.limit(2), "id", "v", 2).collect()} == {0.0}
    assert search.ann_join(rows.limit(0), rows, "id", "v", 2).count() == 0


def test_a_kept_index_finds_what_texts_do(spark, tmp_path):
    rows = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 7}" for j in range(1, i % 5 + 2)) + " the" * (i % 3)) for i in range(30)] + [(99, ""), (98, None)], "d int, text string")
    asked = spark.createDataFrame([("a", "the w1"), ("b", "w3 w5 nothing"), ("c", "zz")], "q string, text string")
    fresh = search.Postings(rows, ["d"], "text")
    fresh.write(f"{tmp_path}/index")
    kept = search.Postings.read(spark, f"{tmp_path}/index", ["d"])
    top = lambda x: x.top(asked, "q", "text", 5).orderBy("q", "rank").collect()
    plain = search.top_k(fresh.search(asked, "q", "text"), ["q"], 5, ["d"]).select("q", "d", "score", "rank").orderBy("q", "rank").collect()
    assert top(fresh) == top(kept) == plain and {r["q"] for r in plain} == {"a", "b"}
    assert search.Postings(rows.limit(0), ["d"], "text").top(asked, "q", "text", 5).count() == 0


def test_the_job_publishes_versions_and_its_state_with_them(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = lambda *r: spark.createDataFrame(list(r), "doc_id int, content string")
    run = lambda docs, day, **how: sorted((r["id"], r["original_content"], str(r["created_at"])[:10]) for r in ingest.ingest(docs, path, how.get("chunk", chunkers.by_sentence), "s", day).collect())
    with pytest.raises(ValueError, match="no version"):
        ingest.read(spark, path)
    first = run(rows((1, "A b. C d."), (2, "E."), (3, "F. G."), (4, None)), "2024-01-01")
    assert [x[0] for x in first] == ["1:0", "1:1", "2:0", "3:0", "3:1"]
    asked = []
    assert run(rows((1, "A b. C d."), (2, "E."), (3, "F. G."), (4, None)), "2024-01-02", chunk=lambda df: asked.append(df.count()) or chunkers.by_sentence(df)) == first and asked == [0]
    with pytest.raises(Exception, match="no such"):
        run(rows((1, "Z.")), "2024-01-03", chunk=lambda df: framers.frame("no such", df))
    assert ingest.read(spark, path).count() == 5 and ingest.current(spark, path).number == 2
    last = run(rows((1, "A b."), (2, "E."), (3, ""), (5, "N.")), "2024-01-04")
    assert last == [("1:0", "A b.", "2024-01-01"), ("2:0", "E.", "2024-01-01"), ("5:0", "N.", "2024-01-04")]
    assert run(rows(), "2024-01-05") == [] and len(ingest.versions(spark, path)) == 4


def written(folder):
    return sum(f.stat().st_size for f in folder.rglob("*.parquet"))


def test_a_run_writes_what_changed_and_two_writers_both_land(spark, tmp_path):
    path, text = f"{tmp_path}/t", "Some words of a sentence that is long enough. "
    docs = spark.range(2000).select(F.col("id").cast("int").alias("doc_id"), F.concat(F.lit(text), F.sha2(F.col("id").cast("string"), 512), F.lit(".")).alias("content"))
    first = ingest.ingest(docs, path, chunkers.by_sentence, "s", "2024-01-01")
    assert first.count() == 4000
    whole = written(tmp_path)
    edit = lambda what: docs.withColumn("content", F.when(F.col("doc_id").isin(what), "New text.").otherwise(F.col("content")))
    ingest.ingest(edit([5, 6, 7]), path, chunkers.by_sentence, "s", "2024-01-02")
    assert written(tmp_path) - whole < whole / 10
    # both begin at the same version, and publish one after the other
    a = ingest.prepare(edit([5, 6, 7, 8]), path, chunkers.by_sentence, "a", "2024-01-03")
    b = ingest.prepare(edit([5, 6, 7, 9]), path, chunkers.by_sentence, "b", "2024-01-04")
    number = ingest.current(spark, path).number
    assert not ingest._publish(spark, path, ingest.Version(number, []))  # a number that is taken
    assert ingest.append(spark, path, b).number == number + 1 and ingest.append(spark, path, a).number == number + 2
    rows = {r["id"]: (r["original_content"], r["source"]) for r in ingest.read(spark, path).where("doc_id BETWEEN 4 AND 9").collect()}
    assert sorted(rows) == ["4:0", "4:1", "5:0", "6:0", "7:0", "8:0", "9:0"] and rows["8:0"] == rows["9:0"] == ("New text.", "s")
    for day in range(5, 12):
        found = ingest.ingest(edit([5, 6, 7, 10 + day]).where("doc_id != 3"), path, chunkers.by_sentence, "s", f"2024-01-{day:02}")
    assert found.count() == 2 * 1999 - 4 and len(ingest.current(spark, path).folders) <= 5
    before = sorted(tuple(r) for r in found.select("id", "original_content").collect())
    assert ingest.vacuum(spark, path, 1) > 3 and len(ingest.versions(spark, path)) == 1
    assert sorted(tuple(r) for r in ingest.read(spark, path).select("id", "original_content").collect()) == before
    assert ingest.read(spark, path, "state").count() == 1999


@pytest.mark.parametrize("parts", [1, 16, 64, 128])
def test_a_kept_keyword_index_of_any_parts(spark, tmp_path, parts):
    rows = spark.createDataFrame([(i, " ".join(f"w{(i * 7 + j * j) % 23}" for j in range(3 + i % 9))) for i in range(80)], "doc_id int, t string")
    queries = spark.createDataFrame([(i, f"w{i} w{i + 5} w3") for i in range(12)], "q int, t string")
    own = search.Postings(rows, ["doc_id"], "t")
    own.write(f"{tmp_path}/ix", parts)
    kept = search.Postings.read(spark, f"{tmp_path}/ix", ["doc_id"])
    assert sorted(map(tuple, kept.top(queries, "q", "t", 5).collect())) == sorted(map(tuple, own.top(queries, "q", "t", 5).collect()))


@pytest.mark.parametrize("block", [1, 2_000_000])
def test_names_in_texts(spark, block):
    names = spark.createDataFrame([(1, "New York"), (2, "York"), (3, "New York City"), (4, "é b"), (5, "York"), (6, ""), (7, None), (8, "!")], "name_id bigint, name string")
    rows = spark.createDataFrame([(1, "In New York City, New Yorker and York."), (2, "日é b! é bc"), (3, None), (4, ""), (None, "York")], "doc_id bigint, text string")
    found = lambda **how: sorted(map(tuple, gazetteer.find_names(rows.where("doc_id IS NOT NULL"), names, ["doc_id"], "text", block_chars=block, **how).collect()))
    assert found() == [(1, 2, 7, 11), (1, 2, 33, 37), (1, 3, 3, 16), (1, 5, 7, 11), (1, 5, 33, 37), (2, 8, 4, 5)]
    assert (1, 1, 18, 26) in found(borders=False) and (1, 1, 3, 11) in found(longest=False) and (2, 4, 1, 4) in found(borders=False)
    assert gazetteer.find_names(rows, names.limit(0), ["doc_id"], "text").count() == 0
    assert gazetteer.find_names(rows, names, ["doc_id"], "text").where("doc_id IS NULL").count() == 2


@pytest.mark.parametrize("parts,bucket_rows", [(1, 2), (16, 8), (5, 1024)])
def test_text_index(spark, tmp_path, parts, bucket_rows):
    """BM25F by dictionaries, over one segment and three, before and after they are merged."""
    chance = np.random.default_rng(4)
    said = [(i, " ".join(f"w{w}" for w in chance.zipf(1.4, 3) % 40), " ".join(f"w{w}" for w in chance.zipf(1.3, 5 + i % 60) % 40)) for i in range(120)] + [(200, None, None), (201, "w1", None)]
    rows = spark.createDataFrame(said, "id int, title string, body string")
    asked = [(i, f"w{i} w{i + 3} w2 nothing") for i in range(15)] + [(90, "unheard"), (91, None)]
    queries = spark.createDataFrame(asked, "id int, text string")
    index = text_index.TextIndex.create(spark, f"{tmp_path}/ix", ["title", "body"], parts, bucket_rows)
    assert index.search(queries, 5).count() == 0
    for i in range(3):
        index.add(rows.where(F.col("id") % 3 == i))
    split = [(i, [(x or "").split() for x in r]) for i, *r in said]
    average = [sum(len(x[f]) for _, x in split) / len(split) for f in (0, 1)]
    want = {}
    for q, text in asked:
        scores = {}
        for t in set((text or "").split()):
            df = sum(t in x[0] + x[1] for _, x in split)
            for i, x in split:
                if t in x[0] + x[1]:
                    said_ = sum(w * x[f].count(t) / (0.25 + 0.75 * len(x[f]) / average[f]) for f, w in ((0, 3.0), (1, 1.0)))
                    scores[i] = scores.get(i, 0) + np.log(1 + (len(split) - df + 0.5) / (df + 0.5)) * said_ / (said_ + 1.2)
        best = sorted(scores.items(), key=lambda x: (-round(x[1], 6), x[0]))[:5]
        want |= {(q, n + 1): s for n, (_, s) in enumerate(best)}
    for _ in range(2):
        found = {(r["query"], r["rank"]): r["score"] for r in index.search(queries, 5, [3.0, 1.0]).collect()}
        assert found.keys() == want.keys() and all(abs(found[x] - want[x]) < 2e-6 for x in want) and index.read_share <= 1
        index.merge()
    assert len(ingest.current(spark, f"{tmp_path}/ix").folders) == 1


def test_vector_index(spark, tmp_path):
    """Exact where all cells are asked; hot copies, nulls and zeros, queries in blocks."""
    chance = np.random.default_rng(2)
    centres = chance.normal(size=(8, 16))
    vectors = [(centres[i % 8] + 0.3 * chance.normal(size=16)).tolist() for i in range(600)] + [[1.0] * 16] * 300 + [None, [0.0] * 16]
    rows = spark.createDataFrame(list(enumerate(vectors)), "id int, v array<double>")
    index = vector_index.VectorIndex.build(rows, f"{tmp_path}/ix", cells=8, parts=4, train_rows=400)
    queries = rows.where("id % 20 = 0")
    exact = search.nearest(rows, queries, 10).cache()
    assert index.rows.count() == 902
    whole = vector_index.VectorIndex(spark, f"{tmp_path}/ix").search(queries, 10, probes=8, rescore=902, block=7)
    a, b = (sorted((r["query"], r["rank"], r["score"], r["id"]) for r in x.collect()) for x in (whole, exact))
    assert [x[:2] for x in a] == [x[:2] for x in b] and np.allclose([x[2] for x in a], [x[2] for x in b], atol=2e-6)  # vectors are kept in 32 bits
    assert vector_index.recall(whole, exact) > 0.99
    few = index.search(queries.where("id < 600"), 10, probes=2, rescore=100)
    assert vector_index.recall(few, exact.where("query < 600")) > 0.9 and index.share(queries.where("id < 600"), 2) < 0.6
    assert index.search(queries.limit(0), 10).count() == 0


def test_episodes_open_at_gaps_turns_words_and_tools(spark):
    rows = [("s", 1, "user", "a b", 0.0, None), ("s", 2, "assistant", "c", 10.0, None), ("s", 3, "assistant", "run", 20.0, "grep"), ("s", 4, "assistant", "run", 30.0, "grep"), ("s", 5, "user", "d", 1e5, None), ("s", 6, "user", "e f g", 1e5 + 1, None), ("s", 7, "user", "h", 1e5 + 2, None), ("t", 1, None, None, None, None)]
    events = spark.createDataFrame(rows, "s string, n int, role string, content string, ts double, tool string")
    found = framers.session_episodes(events, "s", "n", "content", "role", max_turns=9, max_words=4, ts="ts", max_gap_seconds=60, tool="tool")
    out = {(r["s"], r["episode"]): (r["first_turn"], r["last_turn"], r["text"]) for r in found.collect()}
    assert out == {("s", 0): (1, 2, "[user] a b\n[assistant] c"), ("s", 1): (3, 4, "[assistant/grep] run\n[assistant/grep] run"), ("s", 2): (5, 6, "[user] d\n[user] e f g"), ("s", 3): (7, 7, "[user] h"), ("t", 0): (1, 1, "[event] ")}


def test_groups_of_summaries_and_titles_of_frames(spark):
    chunks = spark.createDataFrame([(1, i, w, w, h) for i, (w, h) in enumerate([("a b", "x"), ("c d", "x"), ("e", "y"), ("f g h i j", None), ("k", None)])], "doc_id int, seq_num int, original_content string, embedded_content string, heading string")
    group = lambda **how: [r["group_id"] + r["granularity"][0] for r in chunkers.hierarchical_summary(chunks, **how).orderBy("seq_num").collect()]
    assert group(max_words=4) == ["1::g0f", "1::g0f", "1::g0c", "1::g1f", "1::g1c", "1::g2f", "1::g2c", "1::g3f", "1::g3c"]
    assert group(heading="heading") == ["1::g0f", "1::g0f", "1::g0c", "1::g1f", "1::g1c", "1::g2f", "1::g2f", "1::g2c"]
    frames = framers.regex_boundary(docs(spark, "x\n-- One: a\n-- b"), "^-- ", title_pattern="^(\\w+):", body_starts_with_match=False)
    assert [(r["title"], r["text"]) for r in frames.orderBy("frame_seq").collect()] == [("One", "One: a"), (None, "b")]


def test_staging_is_pruned_and_edges_are_upserted(spark):
    events = spark.createDataFrame([("a", 1, "2024-01-01"), ("a", 2, "2024-03-01"), ("b", 1, "2024-01-01")], "s string, n int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    consumed = spark.createDataFrame([("a", "2024-01-02")], "s string, consumed_at string").withColumn("consumed_at", F.col("consumed_at").cast("timestamp"))
    assert sorted((r["s"], r["n"]) for r in memory.pruned_staging(events, "s", "ts", consumed, "2024-02-01").collect()) == [("a", 2), ("b", 1)]
    edge = "project_id string, edge_type string, src_node_id string, dst_node_id string, confidence double, evidence string"
    before = spark.createDataFrame([("p", "calls", "a", "b", 0.5, "old"), ("p", "calls", "a", "c", 0.9, "old")], edge)
    fresh = spark.createDataFrame([("p", "calls", "a", "b", 0.7, "x"), ("p", "calls", "a", "b", 0.9, "y")], edge)
    assert sorted((r["dst_node_id"], r["evidence"]) for r in graph.upsert_edges(before, fresh).collect()) == [("b", "y"), ("c", "old")]


def test_hints_are_the_terms_of_like_neighbours(spark):
    rng = random.Random(5)
    words = [f"w{i}x" for i in range(12)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) for _ in range(30)] + ["the same same of w1x", "", None, "w0x w1x " * 900]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    for piece in (4096, 7):
        count = Counter()
        for t in texts:
            kept = [w for w in re.findall("[a-z0-9]+", t or "") if len(w) >= 3 and w not in ("the",)]
            for i in range(len(kept)):
                for j in range(i + 1, min(i + 3, len(kept))):
                    if kept[i] != kept[j]:
                        count[tuple(sorted((kept[i], kept[j])))] += 1
        found = {(r["a"], r["b"]): r["n"] for r in hints.neighbour_counts(rows, "text", 2, piece=piece).collect()}
        assert found == count
    margin = Counter()
    for (a, b), n in count.items():
        margin[a] += n
        margin[b] += n
    total, vector = sum(margin.values()), {}
    for pair, n in count.items():
        for a, b in (pair, pair[::-1]):
            w = math.floor(1000 * math.log(n * total / (margin[a] * margin[b])))
            for j in range(3 if w > 0 else 0):
                h = hashlib.md5(f"{b}#{j}".encode()).hexdigest()
                vector.setdefault(a, [0] * 16)[int(h[:8], 16) % 16] += w * (1 if int(h[8], 16) % 2 == 0 else -1)
    vector = {t: v for t, v in vector.items() if any(v)}
    kept = hints.term_vectors(rows, "text", 2, 16, 3, 1).cache()
    assert {r["term"]: r["embedding"] for r in kept.collect()} == vector and len(vector) > 5

    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))

    asked = spark.createDataFrame([("w1x",), ("w1x",), ("unheard",), (None,)], "term string")
    want = sorted(((-round(cosine(vector["w1x"], v), 6), t) for t, v in vector.items() if t != "w1x" and cosine(vector["w1x"], v) >= 0), key=lambda x: x)[:3]
    assert [(r["term"], -r["score"], r["hint"]) for r in hints.expansions(kept, asked, 3, 0.0).orderBy("rank").collect()] == [("w1x", *x) for x in want]
    queries = spark.createDataFrame([(1, "W1x, w2x"), (2, "unheard"), (3, None)], "q int, text string")
    out = hints.query_hints(kept, queries, "q", "text", floor=0.0).collect()
    assert {r["q"] for r in out} == {1} and not {r["hint"] for r in out} & {"w1x", "w2x"}
    assert hints.query_hints(hints.term_vectors(rows.limit(0), "text"), queries, "q", "text").count() == 0


def test_walks_take_the_least_hop_round_cycles(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(14), rng.randrange(14), rng.randrange(1, 9) / 10, f"e{i}", "calls") for i in range(40)] + [(0, 0, 0.9, "loop", "calls")]
    rows = spark.createDataFrame(edges, "src int, dst int, confidence double, evidence string, kind string")
    anchors = [0, 0, 5, 99]
    want = {}
    for a in set(anchors):
        front, seen = {a}, {a}
        for hop in range(1, 6):
            reached = set()
            for src, dst, c, e, _ in edges:
                if src in front and c >= 0.3:
                    old = want.get((a, dst))
                    want[a, dst] = (old[0] if old else hop, max(old[1] if old else (0, ""), (c, e)))
                    reached.add(dst)
            front = reached - seen
            seen |= front
    found = graph.impact(rows, spark.createDataFrame([(a,) for a in anchors], "anchor int"), 5, "callees", 0.3)
    assert {(r["anchor"], r["node"]): (r["hop"], (r["confidence"], r["evidence"])) for r in found.collect()} == want and want


def test_rake_scores_each_row_by_itself(spark):
    rows = spark.createDataFrame([(1, "Deep learning of deep nets; learning, deep learning"), (2, None), (3, ""), (4, "of the")], "id int, text string")
    found = [(r["id"], r["rank"], r["phrase"], r["score"]) for r in extractors.rake(rows, "id", "text").orderBy("id", "rank").collect()]
    # deep: 3 times in phrases of 2; learning: 2 times of 2 and once of 1; nets: once of 2
    assert found == [(1, 1, "deep nets", 4.0), (1, 2, "deep learning", 3.666667), (1, 3, "learning", 1.666667)]


def test_late_events_revise_sessions(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.STATE_STORE)
    schema = "who string, at timestamp, n int"

    def deliver(*events):
        rows = spark.createDataFrame([(who, at and f"2024-01-01 {at}", 0) for who, at in events], "who string, at string, n int").withColumn("at", F.col("at").cast("timestamp"))
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = streams.revised_sessions(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "at", "who", "2 hours", "4 hours")
        streams.run_available(stream, f"{tmp_path}/out", f"{tmp_path}/state")
        kept = spark.read.schema(stream.schema).parquet(f"{tmp_path}/out")
        held = [(r["who"], f"{r['start']:%H:%M}", f"{r['last']:%H:%M}", r["n_events"]) for r in streams.latest_sessions(kept, "who").collect()]
        return sorted(held, key=str)

    first = deliver(("a", "03:00:00"), ("a", "00:00:00"), ("a", "00:30:00"), ("b", "01:00:00"), ("b", "01:00:00"), ("a", None), (None, "02:00:00"))
    assert first == [("a", "00:00", "00:30", 2), ("a", "03:00", "03:00", 1), ("b", "01:00", "01:00", 2), (None, "02:00", "02:00", 1)]
    # one that is late joins two sessions, one of another day's hours opens a new one
    second = deliver(("a", "01:45:00"), ("b", "09:00:00"))
    assert [x for x in second if x[0] in ("a", "b")] == [("a", "00:00", "03:00", 4), ("b", "01:00", "01:00", 2), ("b", "09:00", "09:00", 1)]
    # the watermark is at 05:00: what is older is dropped, closed sessions stay as they were
    third = deliver(("a", "04:30:00"), ("b", "07:30:00"))
    assert [x for x in third if x[0] in ("a", "b")] == [("a", "00:00", "03:00", 4), ("b", "01:00", "01:00", 2), ("b", "07:30", "09:00", 2)]
