"""Code graph: name resolution, and bounded walks over edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.shared import cut


def resolve_names(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges from calls (call_id, caller, callee, imports array) to symbols (fqn, name, stem) of that name. One candidate: unique_name, 0.9. Of several,
    exactly one in an imported file: import_resolved, 0.9; else all of them: ambiguous_name, 0.5. None: no edge."""
    low = lambda s: F.lower(s)
    known = symbols.where("name IS NOT NULL")
    names = known.groupBy(F.col("name").alias("callee")).agg(F.count("*").alias("n"), F.count("stem").alias("n_stems"))
    files = known.where("stem IS NOT NULL").groupBy(F.col("name").alias("callee"), low(F.col("stem")).alias("file")).agg(F.count("*").alias("m"))
    asked = calls.join(names, "callee")
    # a null among the imports leaves open whether a file is one of them
    open_ = F.exists("imports", lambda s: s.isNull())
    each = asked.select("call_id", "caller", "callee", "n", "n_stems", open_.alias("open"), F.posexplode_outer(F.array_distinct(F.filter(F.transform("imports", low), lambda s: s.isNotNull()))).alias("at", "file"), F.col("imports").isNotNull().alias("told"))
    each = each.join(files, ["callee", "file"], "left").withColumn("first", F.coalesce(F.col("at"), F.lit(0)) == 0)
    # candidates are counted, not listed
    w = W.partitionBy("call_id")
    told = F.max((F.col("told") & ~F.col("open") & (F.col("n_stems") > 0)) | F.col("m").isNotNull()).over(w)
    each = each.select("*", F.sum(F.when(F.col("first"), F.col("n"))).over(w).alias("all"), F.coalesce(F.sum("m").over(w), F.lit(0)).alias("imported"), told.alias("sure"))
    how = F.when(F.col("all") == 1, "unique_name").when(F.col("imported") == 1, "import_resolved").otherwise("ambiguous_name")
    each = each.withColumn("resolution", how).where(F.when(F.col("resolution") == "import_resolved", F.col("m") == 1).otherwise(F.col("first") & ((F.col("all") == 1) | F.col("sure"))))
    # calls of one caller with the same candidates make one edge each, that of the first call
    file = F.when(F.col("resolution") == "import_resolved", F.col("file"))
    first = each.groupBy("caller", "callee", file.alias("file"), "resolution").agg(F.min(F.struct("call_id")).alias("call"))
    first = cut(first.withColumn("confidence", F.when(F.col("resolution") == "ambiguous_name", 0.5).otherwise(0.9)), "calls")
    whole, of_file = first.where("file IS NULL"), first.where("file IS NOT NULL")
    sides = known.select(F.col("name").alias("callee"), "fqn", low(F.col("stem")).alias("file"))
    found = _dealt(whole, sides.select("callee", "fqn"), names.select("callee", "n")).select("caller", "fqn", "call", "confidence", "resolution")
    found = found.unionByName(of_file.join(sides, ["callee", "file"]).select("caller", "fqn", "call", "confidence", "resolution"))
    best = F.min(F.struct("call", (-F.col("confidence")).alias("rest"), "confidence", "resolution")).alias("x")
    return found.groupBy(F.col("caller").alias("src"), F.col("fqn").alias("dst")).agg(best).select("src", "dst", "x.resolution", "x.confidence")


def _dealt(calls: DataFrame, symbols: DataFrame, names: DataFrame, block: int = 1024) -> DataFrame:
    """calls joined with symbols by callee. A name of many calls and many symbols is a grid of blocks of about `block` by `block`, not one task."""
    counts = names.join(calls.groupBy("callee").agg(F.count("*").alias("k")), "callee")
    grid = counts.select("callee", F.ceil(F.col("k") / block).cast("int").alias("ks"), F.ceil(F.col("n") / block).cast("int").alias("ns"))
    at = lambda c, of: F.pmod(F.xxhash64(c), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    left = calls.join(grid, "callee").withColumn("kb", at("caller", "ks")).withColumn("nb", every("ns")).drop("ks", "ns")
    right = symbols.join(grid, "callee").withColumn("nb", at("fqn", "ns")).withColumn("kb", every("ks")).drop("ks", "ns")
    return left.join(right, ["callee", "kb", "nb"])


def _side(rows: DataFrame, n: int, most: int = 20_000) -> DataFrame:
    """rows, n of them, as a side of a join: sent to all tasks if they are few. A larger table is shuffled, and never goes by way of the driver,
    however small its files are."""
    return F.broadcast(rows) if n <= most else rows.hint("merge")


def impact(edges: DataFrame, anchors: DataFrame, depth: int = 3, direction: str = "callees", confidence: float = 0.7, kinds: list[str] | None = None) -> DataFrame:
    """(anchor, node, hop, confidence, evidence) of the nodes within so many hops of each anchor: the least hop, and the largest confidence
    of the edges that lead there with its evidence. Each hop joins the nodes that the one before reached first with the edges, so paths that meet
    and cycles are walked once, and the walk ends where nothing new is found. A hop is a table: it is not computed again within the next."""
    if not 1 <= depth <= 10:
        raise ValueError("depth must be from 1 to 10")
    if direction not in ("callees", "callers"):
        raise ValueError(f"no such direction: {direction}")
    near, far = ("src", "dst") if direction == "callees" else ("dst", "src")
    usable = edges.where(F.col("confidence") >= confidence)
    usable = usable.where(F.col("kind").isin(kinds)) if kinds else usable
    usable = usable.select(F.col(near).alias("at"), F.col(far).alias("node"), "confidence", "evidence")
    front = cut(anchors.select("anchor", F.col("anchor").alias("at")).distinct(), "front")
    n = front.count()
    seen, n_seen, found = front, n, None
    for hop in range(1, depth + 1):
        best = F.max(F.struct("confidence", "evidence")).alias("x")
        step = usable.join(_side(front, n), "at").groupBy("anchor", "node").agg(best).withColumn("hop", F.lit(hop))
        step = cut(step, "hop") if hop < depth else step
        found = step if found is None else found.unionByName(step)
        if hop < depth:
            front = cut(step.select("anchor", F.col("node").alias("at")).join(_side(seen, n_seen), ["anchor", "at"], "left_anti"), "front")
            n = front.count()
            if not n:
                break
            seen, n_seen = seen.unionByName(front), n_seen + n
    return found.groupBy("anchor", "node").agg(F.min("hop").alias("hop"), F.max("x").alias("x")).select("anchor", "node", "hop", "x.confidence", "x.evidence")


def enrich(hits: DataFrame, chunks: DataFrame, key: str, order: str) -> DataFrame:
    """hits with the first chunk of each key, if any."""
    first = chunks.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(order))).where("_r = 1").drop("_r")
    return hits.join(first, key, "left")


def crawl(pages: DataFrame, links: DataFrame, seeds: DataFrame, depth: int = 2, same_host: bool = False, max_pages: int | None = None) -> DataFrame:
    """Breadth-first over links (url, to): (url, depth) of the pages that are reached, each at its least depth. same_host: links to other hosts
    are not followed. max_pages: so many pages, those of the least depth and, of equals, the first by url."""
    if same_host:
        links = links.where(_host("url").eqNullSafe(_host("to")))
    front = seeds.select("url").distinct().join(pages.select("url").distinct(), "url", "left_semi").withColumn("depth", F.lit(0))
    found = front
    for d in range(1, depth + 1):
        step = front.join(links, "url").select(F.col("to").alias("url")).distinct().join(pages.select("url").distinct(), "url", "left_semi")
        front = step.join(found, "url", "left_anti").withColumn("depth", F.lit(d))
        found = found.unionByName(front)
    return found.orderBy("depth", "url").limit(max_pages) if max_pages is not None else found


def _host(url: str) -> Column:
    return F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def upsert_edges(existing: DataFrame, incoming: DataFrame, key: tuple[str, ...] = ("project_id", "edge_type", "src_node_id", "dst_node_id")) -> DataFrame:
    """The edges after an upsert: of the same key, the incoming one, and of several of those the one of the largest confidence."""
    best = F.row_number().over(W.partitionBy(*key).orderBy(F.desc("confidence"), F.col("evidence")))
    fresh = incoming.withColumn("_r", best).where("_r = 1").drop("_r")
    return existing.join(fresh.select(*key), list(key), "left_anti").select(*existing.columns).unionByName(fresh, allowMissingColumns=True)
