"""Crawls against a walk in plain Python, robots rules, and the language of code by its content."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docloom.operators import frontier
from docloom.operators.code_language import LANGUAGES, MARKERS, language_of_content
from docloom.plans.crawling import _FILES

ROBOTS = "# all\r\nUser-agent: *\r\nDisallow: /\r\n\r\nUser-agent: Docloom/2\nuser-agent: b\nDisallow: /a\nAllow: /a/b # open\nDisallow: /*.gif$\nCrawl-delay: 3\nDisallow:\n\nUser-agent: docloom\nDisallow: /x\nAllow: /x\nDisallow: /a.c+\n"


def allowed(spark, body, paths, agent="docloom"):
    rows = spark.createDataFrame([("http://h" + p, body) for p in paths], "url string, body string")
    return [r[0] for r in rows.select(frontier.robots_allow(F.col("url"), frontier.robots_rules(F.col("body"), agent))).collect()]


def test_robots_longest_rule_wins(spark):
    assert allowed(spark, ROBOTS, ["/a", "/a/b", "/a/c", "/z.gif", "/z.gif?q", "/x", "/a.c+", "", "/axc"]) == [False, True, False, False, True, True, False, True, False]
    assert allowed(spark, ROBOTS, ["/z", ""], "other") == [False, False]
    assert allowed(spark, None, ["/z"]) == [True]
    assert allowed(spark, "", ["/z"]) == [True]
    assert allowed(spark, "Disallow: /\n", ["/z"]) == [True]


def test_robots_of_many_lines_take_no_stack(spark):
    body = "User-agent: *\n" + "".join(f"Disallow: /p{i}/\n" for i in range(20000))
    assert allowed(spark, body, ["/p19999/x", "/q"]) == [False, True]


PAGES = {f"http://{h}/{i}": [f"http://{g}/{(i * 3 + k) % 12}#f" for k, g in enumerate("abc")] + ["http://gone/1", "no address"] for h in "abc" for i in range(12)}


def plain_walk(kept, depth, per_site, max_pages, refuse):
    """The same crawl, page by page."""
    found, used, asked, front = {}, {}, 0, {"http://a/0", "http://b/1"}
    for d in range(depth + 1):
        chosen = []
        for url in sorted(front - found.keys()):
            host = "/".join(url.split("/")[:3])
            if refuse(url):
                found[url] = (d, "refused", None)
            elif used.get(host, 0) < per_site:
                used[host] = used.get(host, 0) + 1
                chosen.append(url)
        chosen = chosen[: max_pages - asked] if max_pages is not None else chosen
        asked += len(chosen)
        front = set()
        for url in chosen:
            if url not in PAGES or url.endswith("/7"):
                found[url] = (d, "failed", None)
                continue
            same = url in kept
            links = kept[url] if same else PAGES[url]
            found[url] = (d, "unchanged" if same else "fetched", len(links))
            front |= {u.split("#")[0] for u in links if "://" in u}
        if not chosen or asked == max_pages:
            break
    return found


@pytest.mark.parametrize("depth, per_site, max_pages", [(3, 100, None), (4, 5, None), (4, 6, 11), (0, 1, 1), (2, 100, 2)])
def test_walk_equals_plain_python(spark, depth, per_site, max_pages):
    told = "url string, status int, content_type string, etag string, links array<string>"
    responses = spark.createDataFrame([(u, 404 if u.endswith("/7") else 200, "Text/HTML; charset=x", "e" + u, links) for u, links in PAGES.items()], told)
    robots = spark.createDataFrame([("http://b", "User-agent: *\nDisallow: /1\nAllow: /11\n")], "site string, body string")
    seeds = spark.createDataFrame([("http://a/0#x",), ("http://a/0",), ("http://b/1",), ("http://b/1",), (None,), ("x",)], "url string").union(spark.createDataFrame([("http://b/1",)], "url string"))
    before = {u: links[:1] for u, links in PAGES.items() if u.endswith(("0", "2"))}
    kept = spark.createDataFrame([(u, "e" + u, links) for u, links in before.items()] + [("http://a/3", "old", [])], "url string, etag string, links array<string>")
    got = frontier.walk(responses, robots, seeds, kept, depth=depth, per_site=per_site, max_pages=max_pages).collect()
    refuse = lambda u: u.startswith("http://b/1") and not u.startswith("http://b/11")
    assert {r["url"]: (r["depth"], r["state"], None if r["links"] is None else len(r["links"])) for r in got} == plain_walk(before, depth, per_site, max_pages, refuse)
    assert len({r["url"] for r in got}) == len(got)


def test_walk_within_a_site_binary_pages_and_a_second_crawl(spark):
    told = "url string, status int, content_type string, etag string, links array<string>"
    pages = [("http://a/1", 200, "text/html", "1", ["http://b/1", "http://a/2", "http://a/3"]), ("http://a/2", 200, "image/png", "2", ["http://a/4"]), ("http://a/3", 200, None, None, []), ("http://b/1", 200, "text/html", "3", [])]
    robots, seeds = spark.createDataFrame([], "site string, body string"), spark.createDataFrame([("http://a/1",)], "url string")
    responses = spark.createDataFrame(pages, told)
    once = frontier.walk(responses, robots, seeds, same_site=True)
    assert {r["url"]: r["state"] for r in once.collect()} == {"http://a/1": "fetched", "http://a/2": "failed", "http://a/3": "failed"}
    # an answer that a page is the same has no links; those of the first crawl are followed
    again = frontier.walk(responses.withColumn("links", F.lit(None).cast("array<string>")), robots, seeds, once.where("state = 'fetched'"))
    assert {r["url"]: r["state"] for r in again.collect()} == {"http://a/1": "unchanged", "http://a/2": "failed", "http://a/3": "failed", "http://b/1": "fetched"}
    assert frontier.walk(responses, robots, seeds.where("false")).count() == 0
    with pytest.raises(ValueError):
        frontier.walk(responses, robots, seeds, per_site=0)


def told(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["l"] for r in rows.select("i", language_of_content(F.col("t")).alias("l")).orderBy("i").collect()]


def by_single_patterns(text):
    """Each marker looked for on its own in the whole text."""
    w = dict.fromkeys([*LANGUAGES, "script"], 0)
    for name, weight, pattern in MARKERS:
        w[name] += weight * bool(re.search("(?m)" + pattern, text, re.ASCII))
    typed, script = w.pop("typescript"), w.pop("script")
    w["javascript"], w["typescript"] = (script, 0) if not typed else (0, script + typed)
    (a, best), (b, _) = sorted(((v, k) for k, v in w.items()), reverse=True)[:2]
    return best if a >= 3 and a - b >= 2 else None


def test_language_of_ten_files_and_of_what_is_none(spark):
    assert told(spark, list(_FILES.values())) == [*list(_FILES)[:10], "python", None, None]
    odd = [None, "", "x" * 2001 + "\nfunc a() {\n\tb := 1\n}\n", "#!/bin/sh\nls\n", "\n#! /usr/bin/node\n", "package main\n", "first\nend\n", "package x\nend\n", "fn a() {}\r\nimpl B {\r\n", "y" * 300000 + "\n"]
    assert told(spark, odd) == [None, None, None, None, "javascript", "go", "ruby", None, "rust", None]


def test_one_pass_equals_single_patterns(spark):
    pieces = [line for t in _FILES.values() if "#!" not in t and "@generated" not in t for line in t.split("\n")]
    texts = ["\n".join(pieces[(i * 7 + k * (i % 5 + 1)) % len(pieces)] for k in range(i % 9 + 1)) for i in range(400)]
    texts += [str(Path(p).read_text()) for p in (frontier.__file__, __file__) if "@generated" not in Path(p).read_text()]
    assert told(spark, texts) == [by_single_patterns(t) for t in texts]
