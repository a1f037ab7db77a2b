"""URL filters: rules first, gradient-boosted trees for URLs that no rule fits.

A rule allows or blocks a host, all its subdomains, and paths that begin with the rule's. The longest that fits decides. The trees see lexical
features only: lengths, depth, shares of digits, entropy of characters, numbers of parameters, and statistics of host suffix and first
path segment among the other labelled URLs (never a URL's own label). They are trained on URLs labelled by the rules: ``fit_rows`` of them at most, those with the least hashes. Rules are a
parameter, a list that a person writes; each URL is held against all of them in one expression.

Defined cases: a null URL, or one without ``://``, has an empty host and path and gets the trees' verdict; URLs that repeat are judged
alike; where the rules do not give both labels, the one that they give (or allow) is the verdict; further columns stay as they
are, but for names that begin with ``url_``.
"""

from __future__ import annotations

import string

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import cut, hot_keys, join_hot, packed, table

#: (verdict, host, path)
Rule = tuple[str, str, str]
RULES: list[Rule] = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digits", "host_digits", "hyphens", "parameters", "parameter_length", "fragment", "secure", "entropy", "suffix_share", "suffix_blocked", "segment_blocked")


def host_and_path(url: str) -> tuple[Column, Column]:
    at = F.instr(F.col(f"`{url}`"), "://")
    rest = F.when(at > 0, F.substring(F.col(f"`{url}`"), at + 3, F.lit(2**31 - 1))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.lit(2**31 - 1)), "^[^?#]*", 0)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit("")), F.coalesce(path, F.lit(""))


def with_rules(pages: DataFrame, rules: list[Rule], url: str = "url") -> DataFrame:
    """pages with url_host, url_path, url_rule and url_ruled (the verdict of the longest rule that fits)."""
    host, path = host_and_path(url)
    pages = pages.withColumn("url_host", host).withColumn("url_path", path)
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1])))
    fits = [(F.concat(F.lit("."), "url_host").endswith("." + r[1].lower()) & F.col("url_path").startswith(r[2]), r) for r in ordered]
    return pages.withColumn("url_rule", F.coalesce(F.lit(None).cast("string"), *[F.when(c, r[1] + r[2]) for c, r in fits])).withColumn("url_ruled", F.coalesce(F.lit(None).cast("string"), *[F.when(c, r[0]) for c, r in fits]))


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(part / F.greatest(whole, F.lit(1)), F.lit(0.0))


def lexical(url: str) -> dict[str, Column]:
    u, host, path = F.coalesce(F.col(f"`{url}`"), F.lit("")), F.col("url_host"), F.col("url_path")
    query = F.regexp_extract(u, "[?]([^#]*)", 1)
    chars = F.split(u, "")
    count = lambda c: (F.length(u) - F.length(F.replace(u, c, F.lit("")))).cast("double")
    share = lambda c: count(c) / F.length(u)
    entropy = F.aggregate(F.filter(F.array_distinct(chars), lambda c: c != ""), F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c)))
    number = lambda c: c.cast("double")
    return {
        "length": number(F.length(u)), "host_length": number(F.length(host)), "path_length": number(F.length(path)),
        "depth": number(F.regexp_count(path, F.lit("/[^/]"))), "labels": number(F.regexp_count(host, F.lit("[^.]+"))),
        "digits": _ratio(F.regexp_count(u, F.lit("[0-9]")), F.length(u)), "host_digits": _ratio(F.regexp_count(host, F.lit("[0-9]")), F.length(host)),
        "hyphens": number(F.regexp_count(host, F.lit("-"))), "parameters": number(F.regexp_count(query, F.lit("[^&]+"))), "parameter_length": number(F.length(query)),
        "fragment": number(u.contains("#")), "secure": number(u.startswith("https:")), "entropy": entropy,
    }


def judge(pages: DataFrame, rules: list[Rule] = RULES, url: str = "url", fit_rows: int = 20_000, trees: int = 20, depth: int = 4) -> DataFrame:
    """pages with url_host, url_path, url_rule (null if none fits) and url_verdict (allow or block). Columns of pages whose names begin with url_ (but
    for the url itself) or are those of the model's output are kept aside, and come back unless the result has one of that name."""
    result = ("url_host", "url_path", "url_rule", "url_verdict")
    rows, columns = packed(pages.drop(*[c for c in result if c != url]), url)
    return _judged(rows, rules, "text", fit_rows, trees, depth).select(*columns, *result)


def _judged(pages: DataFrame, rules: list[Rule], url: str, fit_rows: int, trees: int, depth: int) -> DataFrame:
    columns = [F.col(f"`{c}`") for c in pages.columns]
    rows = with_rules(pages, rules, url)
    suffix = F.element_at(F.split("url_host", "[.]"), -1)
    segment = F.regexp_extract("url_path", "^/([^/]*)", 1)
    rows = rows.select(*columns, "url_host", "url_path", "url_rule", "url_ruled", suffix.alias("url_suffix"), segment.alias("url_segment"), *[c.alias(f"url_{k}") for k, c in lexical(url).items()])
    rows = cut(rows, "urls")
    blocked, labelled = F.sum((F.col("url_ruled") == "block").cast("int")), F.count("url_ruled")
    # of other URLs with a label, how many are blocked, with two more of which one is; a URL's own label is left out
    own = F.when(F.col("url_ruled") == "block", 1).otherwise(0)
    rate = (F.col("b") - own + 1) / (F.col("l") - F.when(F.col("url_ruled").isNotNull(), 1).otherwise(0) + 2)
    total = rows.agg(F.count("*").alias("n"), blocked.alias("blocked"), labelled.alias("labelled")).first()
    answer = F.col("url_ruled")
    out = [*columns, "url_host", "url_path", "url_rule"]
    if not total["blocked"] or total["blocked"] == total["labelled"]:
        return rows.select(*out, F.coalesce(answer, F.lit("block" if total["blocked"] else "allow")).alias("url_verdict"))
    for part in ("suffix", "segment"):
        counts = rows.groupBy(f"url_{part}").agg(F.count("*").alias("n"), blocked.alias("b"), labelled.alias("l"))
        counts = cut(counts.select(f"url_{part}", "n", F.coalesce("b", F.lit(0)).alias("b"), "l"), f"{part}es")
        rows = join_hot(rows, counts, f"url_{part}", hot_keys(counts, f"url_{part}", "n"))
        share = [(F.col("n") / total["n"]).alias("url_suffix_share")] if part == "suffix" else []
        rows = rows.select("*", *share, rate.alias(f"url_{part}_blocked")).drop("n", "b", "l")
        rows = cut(rows, "rated")
    rows = VectorAssembler(inputCols=[f"url_{f}" for f in FEATURES], outputCol="url_features").transform(rows)
    fit = rows.where("url_ruled IS NOT NULL").select("url_features", (answer == "block").cast("double").alias("url_label"), F.xxhash64(url).alias("h")).orderBy("h").limit(fit_rows).select("url_features", "url_label")
    model = GBTClassifier(featuresCol="url_features", labelCol="url_label", predictionCol="url_block", maxIter=trees, maxDepth=depth, seed=1).fit(cut(fit, "labelled"))
    return model.transform(rows).select(*out, F.coalesce(answer, F.when(F.col("url_block") > 0.5, "block").otherwise("allow")).alias("url_verdict"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", F.col("url_host").alias("host"), F.col("url_path").alias("path"), F.col("url_rule").alias("rule"), F.col("url_verdict").alias("verdict"))
