"""A crawl over tables: robots texts, a frontier with a budget for each site, and fetches on condition that a page changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.shared import cut

_SALTS = 16


def site(url: str | Column) -> Column:
    """Scheme and host with its port, in lower case; empty for what is no address."""
    return F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0))


def _target(url: Column) -> Column:
    """What robots rules are matched with: path and query."""
    path = F.regexp_replace(F.regexp_replace(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), "#.*$", "")
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))


def robots_rules(body: Column, agent: str) -> Column:
    """The rules of a robots text for an agent: an array of (n, allow, prefix, pattern). Groups that name the agent count, all of them; if none does,
    those for *. Comments, unknown fields and rules without a path are passed over. n is the rule's length in bytes; prefix what a path must begin with;
    pattern a regular expression where the rule has * or an end, else null. A null text has no rules."""
    lines = F.transform(F.split(F.coalesce(body, F.lit("")), "\r\n|\r|\n"), lambda s: F.regexp_replace(F.regexp_replace(s, "#.*$", ""), "^\\s+|\\s+$", ""))
    field = lambda s: F.lower(F.regexp_extract(s, "^([A-Za-z-]+)\\s*:", 1))
    value = lambda s: F.regexp_extract(s, "^[A-Za-z-]+\\s*:\\s*(.*)$", 1)
    product = lambda s: F.when(value(s) == "*", "*").otherwise(F.lower(F.regexp_extract(value(s), "^[A-Za-z_-]*", 0)))
    coded = lambda s: F.when(field(s) == "user-agent", F.concat(F.lit("u:"), product(s))).otherwise(F.concat(F.substring(field(s), 1, 1), F.lit(":"), value(s)))
    known = F.transform(F.filter(lines, lambda s: field(s).isin("user-agent", "allow", "disallow")), lambda s: F.concat(coded(s), F.lit("\n")))
    # possessive, so that a group of many lines takes no stack
    groups = F.regexp_extract_all(F.array_join(known, ""), F.lit("(?:u:[^\n]*\n)++(?:[ad]:[^\n]*\n)*+"), F.lit(0))
    of = lambda name: F.filter(groups, lambda g: F.array_contains(F.regexp_extract_all(g, F.lit("(?m)^u:(.*)$"), F.lit(1)), name))
    chosen = F.when(F.size(of(agent.lower())) > 0, of(agent.lower())).otherwise(of("*"))
    rules = F.flatten(F.transform(chosen, lambda g: F.regexp_extract_all(g, F.lit("(?m)^([ad]:.+)$"), F.lit(1))))

    def rule(r: Column) -> Column:
        path = F.substring(r, 3, 1 << 30)
        quoted = F.regexp_replace(F.regexp_replace(path, "\\$$", ""), r"([\\.\[\]{}()+?^$|&-])", r"\\$1")
        pattern = F.concat(F.lit("(?s)^"), F.replace(quoted, F.lit("*"), F.lit(".*")), F.when(path.endswith("$"), "\\z").otherwise(""))
        prefix = F.regexp_extract(path, r"(?s)^(.*?)(?:\*|\$$|\z)", 1)
        return F.struct(F.octet_length(path).alias("n"), r.startswith("a:").alias("allow"), prefix.alias("prefix"), F.when(path.rlike(r"\*|\$$"), pattern).alias("pattern"))

    return F.transform(rules, rule)


def robots_allow(url: Column, rules: Column) -> Column:
    """Whether the longest rule that fits the address allows it; of equally long ones, one that allows wins. No rule: allowed. Addresses and rules are
    compared as they are written."""
    at = _target(url)
    fits = F.filter(rules, lambda r: at.startswith(r["prefix"]) & (r["pattern"].isNull() | F.rlike(at, r["pattern"])))
    return F.coalesce(F.array_max(F.transform(fits, lambda r: F.struct(r["n"], r["allow"])))["allow"], F.lit(True))


def _first(rows: DataFrame, by: str, n: int) -> DataFrame:
    """The first n rows by a column, without a task that sees them all: sorted in ranges, whole ranges are kept up to the one where n is reached."""
    ordered = cut(rows.orderBy(by).withColumn("_range", F.spark_partition_id()), "ranges")
    left, whole = n, []
    for r in sorted(ordered.groupBy("_range").count().collect()):
        if r["count"] > left:
            edge = ordered.where(F.col("_range") == r["_range"]).orderBy(by).limit(left)
            return ordered.where(F.col("_range").isin(whole)).unionByName(edge).drop("_range")
        left -= r["count"]
        whole.append(r["_range"])
    return ordered.drop("_range")


def walk(
    responses: DataFrame, robots: DataFrame, seeds: DataFrame, kept: DataFrame | None = None, agent: str = "docloom", depth: int = 2,
    per_site: int = 1000, max_pages: int | None = None, same_site: bool = False,
) -> DataFrame:
    """The pages that a crawl asks for, breadth-first: (url, site, depth, state, etag, links).

    responses (url, status, content_type, etag, links): what is answered, a row for each url; links are whole addresses. robots (site, body): a row for
    each site that has a robots text. seeds (url). kept (url, etag, links): the pages of an earlier crawl, as this function returns them.
    States: `refused` by robots, which costs nothing and leads nowhere; `failed`: no answer, a status that is not 2xx, or no text; `unchanged`: the etag
    is the kept one, so the page is not read again but its kept links are followed; else `fetched`. Fragments are dropped, as are addresses of no site.

    per_site: so many requests of a site in the whole crawl, max_pages: so many of all; of pages of the same depth the first by url are asked
    for. The rest has no row. same_site: only links within a site are followed. A depth is a table, and each page is looked at once, however often it is linked.
    """
    if depth < 0 or per_site < 1 or (max_pages is not None and max_pages < 1):
        raise ValueError("depth must be 0 or more, per_site and max_pages 1 or more")
    rules = robots.select("site", robots_rules(F.col("body"), agent).alias("rules")).where(F.size("rules") > 0)
    rules = cut(rules.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)))), "robots")
    before = kept.select("url", F.col("etag").alias("_etag"), F.col("links").alias("_links")) if kept is not None else None
    plain = lambda url: F.regexp_replace(url, "#.*$", "")
    found, asked = None, 0
    front = seeds.select(plain(F.col("url")).alias("url"))
    for d in range(depth + 1):
        new = front.where("url IS NOT NULL").distinct().withColumn("site", site("url")).where("site != ''")
        new = new if found is None else new.join(found.select("url"), "url", "left_anti")
        # a site may have most of the pages: its rules are dealt out with salts
        judged = new.withColumn("salt", F.pmod(F.xxhash64("url"), F.lit(_SALTS)).cast("int")).join(rules, ["site", "salt"], "left")
        judged = cut(judged.select("url", "site", F.when(F.col("rules").isNull(), True).otherwise(robots_allow(F.col("url"), F.col("rules"))).alias("ok")), "judged")
        # the bound is a constant first, so that each partition passes on no more than that of a site
        ranked = judged.where("ok").withColumn("r", F.row_number().over(W.partitionBy("site").orderBy("url"))).where(F.col("r") <= per_site)
        if found is not None:
            used = found.where("state != 'refused'").groupBy("site").agg(F.count("*").alias("used"))
            ranked = ranked.join(used, "site", "left").where(F.col("r") + F.coalesce("used", F.lit(0)) <= per_site)
        chosen = cut(ranked.select("url", "site"), "asked")
        n = chosen.count()
        if max_pages is not None and asked + n > max_pages:
            n = max_pages - asked
            chosen = _first(chosen, "url", n)
        asked += n
        seen = chosen.join(responses.select("url", "status", "content_type", "etag", "links"), "url", "left")
        seen = seen.join(before, "url", "left") if before is not None else seen.withColumn("_etag", F.lit(None).cast("string")).withColumn("_links", F.col("links"))
        answered = F.col("status").between(200, 299) & F.lower("content_type").rlike(r"^\s*(?:text/|application/(?:xhtml\+xml|xml|json|[\w.+-]+\+(?:xml|json))\s*(?:;|$))")
        state = F.when(~F.coalesce(answered, F.lit(False)), "failed").when(F.col("etag") == F.col("_etag"), "unchanged").otherwise("fetched")
        links = F.when(F.col("state") == "fetched", F.col("links")).when(F.col("state") == "unchanged", F.col("_links"))
        seen = seen.withColumn("state", state).select("url", "site", F.lit(d).alias("depth"), "state", F.when(F.col("state") != "failed", F.col("etag")).alias("etag"), links.alias("links"))
        refused = judged.where("NOT ok").select("url", "site", F.lit(d).alias("depth"), F.lit("refused").alias("state"), F.lit(None).cast("string").alias("etag"), F.lit(None).cast("array<string>").alias("links"))
        step = cut(seen.unionByName(refused), "crawled")
        found = step if found is None else found.unionByName(step)
        if n == 0 or asked == max_pages:
            break
        front = step.select("site", F.explode("links").alias("to")).select("site", plain(F.col("to")).alias("url"))
        front = front.where(F.col("site") == site("url")) if same_site else front
        front = front.select("url")
    return found
