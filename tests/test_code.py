"""Symbols, comments, phrases, summaries, links and files of more kinds, with edge cases."""

import io
import random
import zipfile
from urllib.parse import urljoin

import numpy as np
import pytest

from docloom.functions.text import sentences, tokens
from docloom.operators import code, extractors, graph, html, summaries
from docloom.sources import comments, files
from pyspark.sql import functions as F

FILES = {
    "src/a/x.py": "import os\nfrom lib import y\n\nclass A(Base):\n    z = 1\n\n    def m(self):\n        # nope(1)\n        return helper(self, 'no(')\n\n    def n(self):\n        return self.n() + 1\n\ndef top():\n    pass\n\nprint('x')\n",
    "src/a/lib.py": "class Base:\n    pass\n\ndef helper(a, b):\n    return top()\n",
    "J.java": "package q;\n\npublic class J extends K implements L {\n    private int a;\n\n    public int go(int x) {\n        if (x > 1) {\n            return other(x);\n        }\n        return 0;\n    }\n}\n",
    "m.go": "package m\n\nfunc (s *T) Run(x int) error {\n\treturn do(x)\n}\n\ntype T struct {\n\ta int\n}\n",
    "k.ts": "export class K extends L {\n  constructor(x) {\n    super(x);\n  }\n  async run(a: string): Promise<void> {\n    if (a) {\n      await go(a);\n    }\n  }\n}\nexport const f = (a) => {\n  return g(a);\n};\nfunction h(b) {\n  return 1;\n}\n",
    "w.js": "class W {\n  go() {\n    return 1;\n  }\n}\n",
    "l.rs": "pub struct P { x: i32 }\n\nimpl P {\n    pub fn new() -> Self {\n        make()\n    }\n}\n\nfn make() -> P {\n    P { x: 1 }\n}\n",
    "c.c": "#include <a.h>\n\nstatic int add(int a, int b)\n{\n    return a + b;\n}\n\nint main(void) {\n    return add(1, 2);\n}\n",
    "d.cpp": "class D : public E {\n  int x;\n};\n\nvoid D::run(int a) {\n  go(a);\n}\n",
    "e.cs": "namespace N\n{\n    public class Q : R, IS\n    {\n        public int Go(int a)\n        {\n            return Do(a);\n        }\n    }\n}\n",
    "f.rb": "module M\n  class V < W\n    def go?(a)\n      doit(a)\n    end\n  end\nend\n",
    "g.txt": "def no(): pass",
    "h.py": None,
    "i.py": "",
}


@pytest.fixture(scope="module")
def sources(spark):
    return spark.createDataFrame(list(FILES.items()), "source_path string, content string").repartition(3)


def test_symbols_of_ten_languages(sources):
    rows = code.symbols(sources.withColumn("kind", F.lit("clash"))).collect()
    found = {}
    for r in rows:
        if r["kind"] != "module":
            found.setdefault(r["source_path"], set()).add((r["scope"], r["name"], r["first_line"], r["last_line"]))
    assert found == {
        "src/a/x.py": {(None, "A", 4, 5), ("A", "m", 7, 9), ("A", "n", 11, 12), (None, "top", 14, 15)},
        "src/a/lib.py": {(None, "Base", 1, 2), (None, "helper", 4, 5)},
        "J.java": {(None, "J", 3, 12), ("J", "go", 6, 11)},
        "m.go": {(None, "Run", 3, 5), (None, "T", 7, 9)},
        "k.ts": {(None, "K", 1, 10), ("K", "constructor", 2, 4), ("K", "run", 5, 9), (None, "f", 11, 13), (None, "h", 14, 16)},
        "w.js": {(None, "W", 1, 5), ("W", "go", 2, 4)},
        "l.rs": {(None, "P", 1, 1), (None, "new", 4, 6), (None, "make", 9, 11)},
        "c.c": {(None, "add", 3, 6), (None, "main", 8, 10)},
        "d.cpp": {(None, "D", 1, 3), (None, "run", 5, 7)},
        "e.cs": {(None, "Q", 3, 9), ("Q", "Go", 5, 8)},
        "f.rb": {(None, "M", 1, 7), ("M", "V", 2, 6), ("V", "go?", 3, 5)},
    }
    # no line is lost or told twice
    for path, content in FILES.items():
        said = [line for r in rows if r["source_path"] == path for line in r["text"].split("\n")]
        if path.rpartition(".")[2] != "txt":
            assert sorted(x for x in said if x.strip()) == sorted(x for x in (content or "").split("\n") if x.strip())


def test_relationships(sources):
    edges = {(r["src"], r["dst"], r["kind"]) for r in code.relationships(sources).collect()}
    assert edges >= {
        ("src.a.x.A.m", "src.a.lib.helper", "calls"),
        ("src.a.x.A.n", "src.a.x.A.n", "calls"),
        ("c.main", "c.add", "calls"),
        ("l.new", "l.make", "calls"),
        ("src.a.x.A", "src.a.lib.Base", "inherits"),
        ("f.M.V", "w.W", "inherits"),
    }
    assert not any(dst.endswith("nope") for _, dst, _ in edges)
    assert code.relationships(sources.limit(0)).count() == 0


def test_comments_of_all_kinds(spark):
    rows = [
        ("a.py", '"""What the module\nis for."""\nx = "# not a comment"  # a trailing remark\n\n\ndef f():\n    """What f does."""\n    y = """no doc"""\n    # one\n    # two\n    return y\n'),
        ("b.java", '/**\n * Says what it is.\n */\nclass B {\n  String s = "// no";  // yes, this\n  // type: tool\n}\n'),
        ("c.sql", "-- one line\n/* and\n   a block */\nSELECT '-- no'\n"),
        ("d.py", None),
    ]
    df = spark.createDataFrame(rows, "source_path string, content string").withColumn("kind", F.lit("clash"))
    found = sorted((r["source_path"], r["first_line"], r["last_line"], r["kind"], r["text"]) for r in comments.comment_documents(df, min_chars=1).collect())
    assert found == [
        ("a.py", 1, 2, "docstring", "What the module\nis for."),
        ("a.py", 3, 3, "line", "a trailing remark"),
        ("a.py", 7, 7, "docstring", "What f does."),
        ("a.py", 9, 10, "line", "one\ntwo"),
        ("b.java", 1, 3, "block", "Says what it is."),
        ("b.java", 5, 5, "line", "yes, this"),
        ("c.sql", 1, 1, "line", "one line"),
        ("c.sql", 2, 3, "block", "and\n   a block"),
    ]
    each = comments.comment_documents(df, min_chars=1, granularity="per_line")
    assert {(r["first_line"], r["text"]) for r in each.where("source_path = 'a.py' and first_line > 8").collect()} == {(9, "one"), (10, "two")}
    whole = comments.comment_documents(df, min_chars=1, granularity="per_file", docstrings=False).where("source_path = 'a.py'").first()
    assert whole["text"] == "a trailing remark\n\none\ntwo" and whole["doc_id"] == "a.py"


def test_links_as_the_standard_library_joins_them(spark):
    page = """<a class=x href='../up.html'>1</a><A HREF="?q=1">2</A><a href=plain>3</a><a data-href="no" id="z">4</a><a href="a/./b/../c?x=../y#f">5</a>
<a href="//other/x">6</a><a href="/root/../r">7</a><a href="mailto:x@y">8</a><a href="#f">9</a><a href="https://h/p">10</a><a href="../../../far/">11</a><a href="..">12</a>"""
    wanted = ["../up.html", "?q=1", "plain", "a/./b/../c?x=../y#f", "//other/x", "/root/../r", "https://h/p", "../../../far/", ".."]
    for base in ("http://h.org/d/e/page?z=1#k", "http://h.org/"):
        df = spark.createDataFrame([(base, page), (base, None)], "u string, h string")
        rows = df.select(html.links(F.col("h")).alias("l"), F.transform(html.links(F.col("h")), lambda x: html.absolute(F.col("u"), x)).alias("a")).collect()
        assert rows[0]["l"] == wanted and rows[0]["a"] == [urljoin(base, x) for x in wanted]
        assert rows[1]["l"] is None
    locs = spark.createDataFrame([("<urlset><url><loc> http://a/1 </loc></url><url><LOC>http://a/2</LOC></url></urlset>",)], "x string").select(html.sitemap(F.col("x"))).first()[0]
    assert locs == ["http://a/1", "http://a/2"]


def test_crawl_on_one_host_and_of_some_pages(spark):
    pages = spark.createDataFrame([(u,) for u in ("http://a/1", "http://a/2", "http://a/3", "http://b/1")], "url string")
    links = spark.createDataFrame([("http://a/1", "http://b/1"), ("http://a/1", "http://A/2"), ("http://a/1", "http://a/3"), ("http://a/1", "http://a/2")], "url string, to string")
    seeds = pages.where("url = 'http://a/1'")
    assert sorted(r["url"] for r in graph.crawl(pages, links, seeds, same_host=True).collect()) == ["http://a/1", "http://a/2", "http://a/3"]
    assert sorted(r["url"] for r in graph.crawl(pages, links, seeds, max_pages=2).collect()) == ["http://a/1", "http://a/2"]


@pytest.mark.parametrize("mode", ["text_rank", "lex_rank"])
def test_central_sentences_by_brute_force(spark, mode):
    rng = np.random.default_rng(3)
    said = [" ".join(rng.choice(["red", "green", "blue", "cat", "dog", "sun"], rng.integers(1, 6))) + "." for _ in range(12)] + ["!?."]
    rows = [(1, " ".join(said)), (2, "One. Two."), (3, ""), (4, None), (5, "... !!! ... ???"), (6, " ".join(["Same words here."] * 5))]
    df = spark.createDataFrame(rows, "doc_id bigint, content string").withColumn("summary", F.lit("clash"))
    found = {r["doc_id"]: r["summary"] for r in summaries.central_sentences(df, mode=mode).collect()}
    lists = df.where("doc_id = 1").select(sentences(F.col("content")).alias("s"), F.transform(sentences(F.col("content")), tokens).alias("w")).first()
    terms = sorted({t for w in lists["w"] for t in w})
    x = np.array([[w.count(t) for t in terms] for w in lists["w"]], dtype=float)
    if mode == "lex_rank":
        x *= 1 + np.log(len(x) / (x > 0).sum(0))
    size = np.linalg.norm(x, axis=1, keepdims=True)
    x = x / np.where(size > 0, size, 1)
    like = x @ x.T
    np.fill_diagonal(like, 0)
    degree = like.sum(1)
    walk = np.where(degree[:, None] > 0, like / np.where(degree > 0, degree, 1)[:, None], 1 / len(x))
    share = np.full(len(x), 1 / len(x))
    for _ in range(50):
        share = 0.15 / len(x) + 0.85 * share @ walk
    best = sorted(np.argsort(-np.round(share, 9), kind="stable")[:3])
    assert found[1] == " ".join(lists["s"][i] for i in best)
    assert (found[2], found[3], found[4], found[6]) == ("One. Two.", "", "", " ".join(["Same words here."] * 3))


def test_embedded_phrases(spark):
    df = spark.createDataFrame([(1, "Graph graph graph engine of the engine"), (2, ""), (3, None), (4, "the of and")], "id bigint, text string").withColumn("rank", F.lit(9))
    rows = extractors.embedded_phrases(df, "id", "text", 10).orderBy("rank").collect()
    assert {r["phrase"] for r in rows} == {"graph", "engine", "graph graph", "graph engine"} and {r["id"] for r in rows} == {1}
    assert rows[0]["phrase"] == "graph engine"


def test_sheets_keep_blank_cells_and_bombs_are_not_read(monkeypatch):
    def zipped(**parts):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, text in parts.items():
                z.writestr(name.replace("__", "/") + ".xml", text)
        return out.getvalue()

    sheet = '<worksheet><sheetData><row><c r="A1"><v>1</v></c><c r="C1"><v>3</v></c></row></sheetData></worksheet>'
    assert files.parse(zipped(xl__worksheets__sheet1=sheet), "xlsx")[0] == "1\t\t3"
    ods = '<d xmlns:t="t"><t:table><t:table-row><t:table-cell><p>a</p></t:table-cell><t:table-cell t:number-columns-repeated="2"/><t:table-cell t:number-columns-repeated="2"><p>b</p></t:table-cell><t:table-cell t:number-columns-repeated="9999"/></t:table-row><t:table-row><t:table-cell/></t:table-row></t:table></d>'
    assert files.parse(zipped(content=ods), "ods")[0] == "a\t\t\tb\tb"
    monkeypatch.setattr(files, "MOST_INFLATED", 100)
    assert files.parse(zipped(content=ods), "ods")[2] == "ValueError: too large when inflated"


def test_resolve_names_counts_candidates_and_lists_no_pairs(spark, monkeypatch):
    rng = random.Random(3)
    symbols = [(f"s{i % 50}", f"n{rng.choice([0, 0, 0, *range(8)])}", rng.choice(["A", "b", "C", None])) for i in range(60)]
    calls = [(rng.randrange(60), f"c{rng.randrange(4)}", f"n{rng.randrange(10)}", rng.choice([None, [], ["a", "A"], ["B", None], ["c", "x"], [None]])) for _ in range(70)]
    pairs = [(i, c, f, None if imports is None or stem is None else True if stem.lower() in [x.lower() for x in imports if x] else None if None in imports else False) for i, c, e, imports in calls for f, n, stem in symbols if n == e]
    want = {}
    for i, c, f, imported in pairs:
        own = [p[3] for p in pairs if p[0] == i]
        m = None if all(x is None for x in own) else sum(x is True for x in own)
        if len(own) == 1 or m is not None and m != 1 or imported:
            how = ("unique_name", 0.9) if len(own) == 1 else ("import_resolved", 0.9) if m == 1 else ("ambiguous_name", 0.5)
            want[c, f] = min(want.get((c, f), (i, -how[1], how)), (i, -how[1], how))
    asked = []
    dealt = graph._dealt
    monkeypatch.setattr(graph, "_dealt", lambda calls, *a: asked.append(calls.count()) or dealt(calls, *a, 2))
    frames = spark.createDataFrame(calls, "call_id int, caller string, callee string, imports array<string>"), spark.createDataFrame(symbols, "fqn string, name string, stem string")
    found = graph.resolve_names(*frames).collect()
    assert {(r["src"], r["dst"]): (r["resolution"], r["confidence"]) for r in found} == {k: v[2] for k, v in want.items()} and len(found) == len(want)
    assert {v[2][0] for v in want.values()} >= {"import_resolved", "ambiguous_name"} and asked[0] <= 4 * 10 * 2 < len(pairs)


def test_symbols_shuffle_no_lines(spark):
    body = "import os\n\n" + "".join(f"class C{i}:\n    x = 1\n\n    def m{i}(self):\n        return m(1)\n\n" for i in range(5000))
    rows = spark.createDataFrame([("a/b.py", body), ("a/c.py", "x = 1\n"), ("a/d.py", " \n"), ("a/e.py", body[:70])], "source_path string, content string").coalesce(1)
    found = code.symbols(rows)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = [tuple(r) for r in found.select("source_path", "seq_num", "kind", "name", "scope", "first_line", "last_line").collect()]
    assert len(got) == 10001 + 1 + 3 and got[10000] == ("a/b.py", 10000, "function", "m4999", "C4999", 6 * 4999 + 6, 6 * 4999 + 7)
    assert got[10001] == ("a/c.py", 0, "module", None, None, 1, 1) and [g[3] for g in got[10002:]] == [None, "C0", "m0"]


def test_embedded_phrases_shuffle_nothing(spark):
    rows = spark.createDataFrame([(1, "red fox red fox the fox"), (2, None), (3, "")], "doc_id int, text string")
    found = extractors.embedded_phrases(rows, "doc_id", "text", 9)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r["phrase"] for r in found.collect()} == {"red", "fox", "red fox", "fox red"}
