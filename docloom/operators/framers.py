"""Framers: one document becomes many. Frames carry `framer` and `frame_seq`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.operators.fold import fold

FRAMERS = ("identity", "heading_boundary", "regex_boundary", "json_path", "session_episodes")

#: A character that texts don't hold marks where a frame begins.
_MARK = "\u001f"


def identity(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"framer": F.lit("identity"), "frame_seq": F.lit(0)})


def _pieces(docs: DataFrame, content: str, pattern: str) -> DataFrame:
    """A row for each piece of the content that begins with a match of pattern (multi-line), and `piece` 0 for what is before."""
    marked = F.regexp_replace(F.regexp_replace(F.col(content), _MARK, ""), f"(?m)(?={pattern})", _MARK)
    return docs.select("*", F.posexplode(F.split(marked, _MARK)).alias("piece", "part"))


def heading_boundary(docs: DataFrame, id: str = "doc_id", content: str = "content", pattern: str = "^#+\\s") -> DataFrame:
    """A frame for each heading, of the heading, a blank line and the body; what is before the first is frame 0 unless blank.
    Without a heading the document stays whole, under its own id."""
    rows = _pieces(docs, content, pattern)
    heading = F.when(F.col("piece") > 0, F.regexp_extract("part", "^[^\\n]*", 0))
    body = F.regexp_replace(F.when(F.col("piece") > 0, F.regexp_replace("part", "^[^\\n]*\\n?", "")).otherwise(F.col("part")), "^\\s+|\\s+$", "")
    rows = rows.withColumn("title", F.regexp_replace(heading, "^#+\\s+", "")).withColumn("text", F.when(heading.isNull(), body).when(body == "", heading).otherwise(F.concat(heading, F.lit("\n\n"), body)))
    rows = rows.where("text != ''")
    w = W.partitionBy(id)
    rows = rows.withColumn("frame_seq", F.row_number().over(w.orderBy("piece")) - 1).withColumn("split", F.max("piece").over(w) > 0)
    return rows.select(F.when(F.col("split"), F.concat_ws("#", F.col(id).cast("string"), F.col("frame_seq").cast("string"))).otherwise(F.col(id).cast("string")).alias("frame_id"), F.lit("heading_boundary").alias("framer"), "frame_seq", "title", "text")


def regex_boundary(
    docs: DataFrame,
    split_pattern: str,
    id: str = "doc_id",
    content: str = "content",
    title_pattern: str | None = None,
    body_starts_with_match: bool = True,
) -> DataFrame:
    """A frame from each match to the next, with the match or without; what is before the first is dropped, blank slices too. With a
    title_pattern, its first group in the frame is the title (null where it does not match)."""
    part = F.col("part") if body_starts_with_match else F.regexp_replace("part", f"\\A(?m:{split_pattern})", "")
    rows = _pieces(docs, content, split_pattern).where("piece > 0").withColumn("text", F.regexp_replace(part, "^\\s+|\\s+$", "")).where("text != ''")
    seq = F.row_number().over(W.partitionBy(id).orderBy("piece")) - 1
    rows = rows.select(F.col(id), seq.alias("frame_seq"), "text")
    found = F.trim(F.regexp_extract("text", title_pattern, 1)) if title_pattern else None
    title = [F.when(F.col("text").rlike(title_pattern), found).alias("title")] if title_pattern else []
    frame_id = F.concat_ws("#", F.col(id).cast("string"), F.col("frame_seq").cast("string")).alias("frame_id")
    return rows.select(frame_id, F.lit("regex_boundary").alias("framer"), "frame_seq", *title, "text")


def json_path(rows: DataFrame, id: str, json: str, path: str, body: str = "$") -> DataFrame:
    """A frame for each element at the path (an object's field or, with [*], an array's elements); missing: no frame."""
    found = F.get_json_object(F.col(json), path)
    many = "[*]" in path
    items = F.from_json(found, "array<string>") if many else F.when(found.isNotNull(), F.array(found))
    out = rows.select(F.col(id), F.posexplode(items).alias("frame_seq", "item"))
    text = F.col("item") if body == "$" else F.get_json_object("item", body)
    return out.select(F.concat_ws("#", F.col(id).cast("string"), F.col("frame_seq").cast("string")).alias("frame_id"), F.lit("json_path").alias("framer"), "frame_seq", text.alias("text")).where("text IS NOT NULL")


def session_gap(events: DataFrame, session: str, ts: str, tie: str, max_gap: str) -> DataFrame:
    """events with `episode`, which begins anew after a gap of more than max_gap (an interval such as '6 hours')."""
    w = W.partitionBy(session).orderBy(ts, tie)
    opens = F.coalesce((F.col(ts) > F.lag(ts).over(w) + F.expr(f"INTERVAL {max_gap}")).cast("int"), F.lit(1))
    return events.withColumn("_opens", opens).withColumn("episode", F.sum("_opens").over(w.rowsBetween(W.unboundedPreceding, 0)) - 1).drop("_opens")


def session_episodes(
    events: DataFrame,
    session: str,
    order: str,
    content: str,
    role: str,
    max_turns: int = 40,
    max_words: int = 1200,
    ts: str | None = None,
    max_gap_seconds: float | None = None,
    tool: str | None = None,
) -> DataFrame:
    """Episodes of a session (session, episode, first_turn, last_turn, text of "[role] content" lines). An event opens a new one when the
    turns so far are max_turns or the words so far are max_words; when it comes more than max_gap_seconds after the one before (ts: a
    number of seconds, or a timestamp); or when it is of a tool and the one before is not. Events stream by in order."""
    count = F.size(F.filter(F.split(F.coalesce(content, F.lit("")), "\\s+"), lambda w: w != ""))
    at = F.col(ts).cast("double") if ts and max_gap_seconds is not None else F.lit(0.0)
    used = F.coalesce(F.col(tool), F.lit("")) if tool else F.lit("")
    tag = F.coalesce(F.col(role), F.lit("event"))
    tag = F.when(used == "", tag).otherwise(F.concat(tag, F.lit("/"), used))
    line = F.concat(F.lit("["), tag, F.lit("] "), F.coalesce(F.col(content), F.lit("")))
    rows = events.select(F.col(session), F.col(order).cast("bigint").alias("o"), line.alias("line"), count.alias("n"), F.coalesce(at, F.lit(0.0)).alias("at"), (used != "").alias("tool"))
    gap = float("inf") if max_gap_seconds is None else max_gap_seconds

    def start():
        state = {"episode": -1, "turns": 0, "words": 0, "at": 0.0, "tool": True}

        def step(row) -> int:
            new = state["episode"] < 0 or state["turns"] >= max_turns or state["words"] >= max_words
            if new or row.at - state["at"] > gap or row.tool and not state["tool"]:
                state.update(episode=state["episode"] + 1, turns=0, words=0)
            state.update(turns=state["turns"] + 1, words=state["words"] + row.n, at=row.at, tool=row.tool)
            return state["episode"]

        return step

    lines = fold(rows, [session], ["o", "line"], start, "episode")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", "line"))), lambda y: y["line"]), "\n")
    return lines.groupBy(session, "episode").agg(F.min("o").alias("first_turn"), F.max("o").alias("last_turn"), text.alias("text"))


def frame(kind: str, docs: DataFrame, *args, **how) -> DataFrame:
    """The framer of that name."""
    if kind not in FRAMERS:
        raise ValueError(f"no such framer: {kind}")
    return globals()[kind](docs, *args, **how)
