"""Queries over crawls and the language of source code without a path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import frontier, html
from docloom.operators.code_language import LANGUAGES, MARKERS, language_of_content
from docloom.plans.common import table
from docloom.plans.relations import _LINKS
from docloom.shared import cut

DEPTH, PER_SITE = 4, 100
#: Robots texts by the length of a site's name: the texts, and their rules for this crawl, (allow, bytes, pattern), as SQL is told them.
_ROBOTS = (
    ("", ()),
    ("User-agent: *\nDisallow: /fr/\nAllow: /fr/1\n", ((False, 4, "^/fr/"), (True, 5, "^/fr/1"))),
    ("User-agent: other\nDisallow: /\n\nUser-Agent: Docloom/1.0\nUser-agent: third # too\nDisallow: /*/3\nDisallow: /de/\nAllow: /de/*0$\nSitemap: /map\n", ((False, 4, "^/.*/3"), (False, 4, "^/de/"), (True, 7, "^/de/.*0$"))),
    ("User-agent: *\nDisallow: /\n\nUser-agent: docloom\nDisallow:\nDisallow: /en/2\n\nUser-agent: *\nDisallow: /es/\n", ((False, 5, "^/en/2"),)),
)


def crawl_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawl of `pages`. Their links lead out of the table, so each leads, by its place and length, to a page of the table instead. Pages of some sizes
    are missing (404); an earlier crawl has the etags of addresses of even length, and the first two links of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "#.*$", "").alias("url"), "html")
    n = pages.agg(F.count("*").alias("n"))
    out = pages.select("page_id", F.posexplode(html.links(F.col("html"))).alias("j", "link")).crossJoin(F.broadcast(n))
    out = out.select(F.col("page_id").alias("at"), "j", F.pmod(F.col("page_id") * 3 + F.length("link") * 17 + F.col("j") * 31, "n").alias("page_id"))
    out = out.join(pages.select("page_id", F.col("url").alias("to")), "page_id").groupBy("at").agg(F.array_sort(F.collect_list(F.struct("j", "to"))).alias("to"))
    told = pages.select("page_id", "url", F.when(F.length("html") % 11 == 0, 404).otherwise(200).alias("status"), F.lit("text/html; charset=utf-8").alias("content_type"), F.md5(F.col("html").cast("binary")).alias("etag"))
    told = told.join(out, F.col("page_id") == F.col("at"), "left").select("url", "status", "content_type", "etag", F.coalesce("to.to", F.array().cast("array<string>")).alias("links"))
    # a table: the pages are read and their links told once, not at each depth
    responses = cut(told.groupBy("url").agg(F.min(F.struct("status", "content_type", "etag", "links")).alias("r")).select("url", "r.*"), "responses")
    sites = pages.select(frontier.site("url").alias("site")).where("site != ''").distinct()
    text = F.array(*[F.lit(t) for t, _ in _ROBOTS])[F.length("site") % len(_ROBOTS)]
    kept = responses.select("url", F.when(F.length("url") % 2 == 0, F.col("etag")).otherwise("old").alias("etag"), F.slice("links", 1, 2).alias("links"))
    seeds = pages.withColumn("site", frontier.site("url")).groupBy("site").agg(F.min("url").alias("url"))
    found = frontier.walk(responses, sites.select("site", text.alias("body")), seeds, kept, depth=DEPTH, per_site=PER_SITE)
    return found.select("url", "depth", "state", F.coalesce(F.size("links"), F.lit(-1)).alias("n_links"))


def _hops(depth: int) -> str:
    seen, parts = "", []
    for d in range(depth + 1):
        front = "SELECT min(url) AS url FROM r WHERE site <> '' GROUP BY site" if d == 0 else f"SELECT DISTINCT dest AS url FROM k{d - 1} JOIN e USING (url) WHERE dest NOT IN (SELECT url FROM ({seen}))"
        used = f"coalesce((SELECT count(*) FROM ({seen}) AS s WHERE s.ok AND s.site = r.site), 0)" if d else "0"
        parts.append(f"k{d} AS (SELECT * FROM (SELECT r.*, {d} AS depth, row_number() OVER (PARTITION BY site, ok ORDER BY url) + {used} AS k FROM ({front}) JOIN r USING (url) WHERE site <> '') WHERE NOT ok OR k <= {PER_SITE})")
        seen += (" UNION ALL " if d else "") + f"SELECT url, site, ok, state, links, depth FROM k{d}"
    return ", ".join(parts) + f", seen AS ({seen})"


_RULES = ", ".join(f"({i}, {str(allow).lower()}, {n}, '{p}')" for i, (_, rules) in enumerate(_ROBOTS) for allow, n, p in rules)

#: A file of each language, with the places of a text's lines.
_FILES = {
    "python": "from os import path\n\ndef show(self):\n    if path:\n        self.x = '%s'\n",
    "ruby": "require 'set'\n\nclass Show\n  attr_reader :x\n  def show(y)\n    # %s\n  end\nend\n",
    "go": "package main\n\nimport \"fmt\"\n\nfunc show(x string) {\n\ty := x // %s\n\tfmt.Println(y)\n}\n",
    "rust": "use std::fmt;\n\nimpl Show {\n    pub fn show(&self) {\n        let mut x = 1; // %s\n        println!(\"{}\", x);\n    }\n}\n",
    "c": "#include <stdio.h>\n\ntypedef int number;\n\nint show(int x) {\n    /* %s */\n    printf(\"%d\", x);\n}\n",
    "cpp": "#include <vector>\n\ntemplate <typename T>\nclass Show {\npublic:\n    std::vector<T> x; // %s\n};\n",
    "csharp": "using System;\n\nnamespace Shown {\n    public class Show {\n        public string Name { get; set; }\n        // %s\n        public void Run() { Console.WriteLine(Name); }\n    }\n}\n",
    "java": "package shown;\n\nimport java.util.List;\n\npublic class Show {\n    @Override\n    public String toString() {\n        // %s\n        System.out.println(1);\n    }\n}\n",
    "javascript": "const x = require('x');\n\nfunction show(y) {\n  // %s\n  console.log(y === x);\n}\nmodule.exports = show;\n",
    "typescript": "import { x } from 'x';\n\nexport interface Show {\n  name: string;\n}\n// %s\nexport const show = (y: number) => y;\n",
    "shebang": "#!/usr/bin/env python3\n# %s\n",
    "generated": "// @generated\npackage main\n\nfunc show(x string) {\n\ty := x // %s\n}\n",
    "prose": "%s",
}


def code_language_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of `documents`, put as comments into files of ten languages by their length, or left as they are; what language is told of each."""
    lines = F.regexp_replace(F.coalesce("text", F.lit("")), "([.!?]) +", "$1\n// ")
    file = F.array(*[F.lit(t) for t in _FILES.values()])[F.length(lines) % len(_FILES)]
    rows = table(spark, sf_dir, "documents").select("doc_id", F.replace(file, F.lit("%s"), lines).alias("content"))
    return rows.select("doc_id", F.coalesce(language_of_content(F.col("content")), F.lit("")).alias("language"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_WEIGHT = {
    name: " + ".join(f"CASE WHEN regexp_matches(content, {_quoted('(?m)' + p)}) THEN {w} ELSE 0 END" for of, w, p in MARKERS if of == name)
    for name in (*LANGUAGES, "script") if name != "javascript"
}
_PLAIN = [n for n in LANGUAGES if n not in ("javascript", "typescript")]
QUERIES = {f.__name__: f for f in (crawl_frontier, code_language_content)}
SQL = {
    "crawl_frontier": rf"""WITH p AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS url, html, {_LINKS} AS l FROM pages),
x AS (SELECT page_id, unnest(l) AS link, unnest(range(0, len(l))) AS j FROM p), t AS (SELECT x.page_id, j, p.url AS dest FROM x JOIN p ON p.page_id = (x.page_id * 3 + length(link) * 17 + j * 31) % (SELECT count(*) FROM pages)),
o AS (SELECT page_id, list(dest ORDER BY j) AS links FROM t GROUP BY page_id),
u AS (SELECT url, min({{'status': CASE WHEN length(html) % 11 = 0 THEN 404 ELSE 200 END, 'etag': md5(html), 'links': coalesce(links, [])}}) AS a FROM p LEFT JOIN o USING (page_id) GROUP BY url),
v AS (SELECT url, a, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*')) AS site, regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', '') AS path FROM u),
rules AS (SELECT * FROM (VALUES {_RULES}) AS _(kind, allow, n, pattern)),
b AS (SELECT url, arg_max(allow, n * 2 + allow::INT) AS ok FROM v JOIN rules ON length(site) % {len(_ROBOTS)} = kind AND regexp_matches(path, pattern) GROUP BY url),
r AS (SELECT url, site, ok, CASE WHEN NOT ok THEN 'refused' WHEN a.status = 404 THEN 'failed' WHEN length(url) % 2 = 0 THEN 'unchanged' ELSE 'fetched' END AS state, CASE WHEN NOT ok OR a.status = 404 THEN NULL WHEN length(url) % 2 = 0 THEN a.links[1:2] ELSE a.links END AS links
  FROM (SELECT v.*, coalesce(ok, true) AS ok FROM v LEFT JOIN b USING (url))),
e AS (SELECT url, unnest(links) AS dest FROM r), {_hops(DEPTH)}
SELECT url, CAST(depth AS INT) AS depth, state, CAST(coalesce(len(links), -1) AS INT) AS n_links FROM seen""",
    "code_language_content": rf"""WITH l AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '([.!?]) +', '\1' || chr(10) || '// ', 'g') AS lines FROM documents),
f AS (SELECT doc_id, replace([{", ".join(_quoted(t) for t in _FILES.values())}][length(lines) % {len(_FILES)} + 1], '%s', lines) AS content FROM l),
w AS (SELECT doc_id, content, {", ".join(f"{_WEIGHT[n]} AS w_{n}" for n in _PLAIN)}, {_WEIGHT["script"]} AS w_script, {_WEIGHT["typescript"]} AS w_typed FROM f),
s AS (SELECT doc_id, content, list_reverse_sort([{", ".join(f"{{'w': w_{n}, 'name': '{n}'}}" for n in _PLAIN)}, {{'w': CASE WHEN w_typed = 0 THEN w_script ELSE 0 END, 'name': 'javascript'}}, {{'w': CASE WHEN w_typed > 0 THEN w_script + w_typed ELSE 0 END, 'name': 'typescript'}}]) AS r FROM w)
SELECT doc_id, CASE WHEN contains(content, '@generated') OR contains(content, 'sourceMappingURL') OR len(list_filter(regexp_split_to_array(content, '\r|\n'), lambda x: length(x) > 2000)) > 0 THEN ''
  WHEN starts_with(content, '#!') AND contains(string_split(content, chr(10))[1], 'python') THEN 'python' WHEN r[1].w >= 3 AND r[1].w - r[2].w >= 2 THEN r[1].name ELSE '' END AS language FROM s""",
}
