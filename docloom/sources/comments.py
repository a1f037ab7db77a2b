"""Comments of source files as documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What a comment that is for tools begins with.
PRAGMAS = "^(noqa|type:|pylint|pragma|eslint|ts-|fmt:|isort|NOLINT|nolint|mypy)"
_STYLES = {"python": "#", "ruby": "#", "shell": "#", "sql": "--", "java": "//", "go": "//", "javascript": "//", "typescript": "//", "rust": "//", "c": "//", "cpp": "//", "csharp": "//"}
EXTENSIONS = {"py": "python", "rb": "ruby", "sh": "shell", "sql": "sql", "java": "java", "go": "go", "js": "javascript", "ts": "typescript", "rs": "rust", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "hpp": "cpp", "cs": "csharp"}
_STRING = r"\"[^\"\\\n]*+(?:\\.[^\"\\\n]*+)*+\"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"
_TRIPLE = r'"""(?s:.*?)"""|' + r"'''(?s:.*?)'''"
_BLOCK = r"/\*(?s:.*?)\*/"
#: Characters that no source holds, before and after a comment.
_BEGIN, _END = "\x01", "\x02"


def _marked(text: Column, mark: Column) -> Column:
    """text with marks around what looks like a comment, outside of strings."""

    def around(strings: str, comments: str) -> Column:
        return F.regexp_replace(text, f"({strings})|({comments})", f"$1{_BEGIN}$2{_END}")

    hashed = around(_STRING.replace("\"[", '"(?!"")[', 1).replace("'[", "'(?!'')[", 1), rf"{_TRIPLE}|#[^\n]*")
    return F.when(mark == "#", hashed).when(mark == "--", around(_STRING, rf"--[^\n]*|{_BLOCK}")).otherwise(around(_STRING, rf"//[^\n]*|{_BLOCK}"))


def _said(comment: Column) -> Column:
    """A comment without its marks, nor stars at the front of its lines."""
    block = F.regexp_replace(F.regexp_replace(comment, r"^/\*+!?|\*+/$", ""), r"(?m)^[ \t]*\*+[ \t]?", "")
    bare = F.when(comment.startswith("/*"), block).when(comment.rlike("^(\"\"\"|''')"), F.regexp_replace(comment, "^...|...$", "")).otherwise(F.regexp_replace(comment, "^(?:#+|//[/!]?|--)", ""))
    return F.regexp_replace(bare, r"^\s+|\s+$", "")


def comment_documents(files: DataFrame, path: str = "source_path", content: str = "content", min_chars: int = 20, granularity: str = "block", docstrings: bool = True) -> DataFrame:
    """(doc_id, source_path, kind, first_line, last_line, text) of the comments in files of known extensions. kind: line, block or, in Python and
    where a definition or the file begins with one, docstring. granularity: block (line comments in consecutive lines are one), per_line
    (each line of a comment), per_file (all of a file, blank lines between). Comments for tools and those of fewer than min_chars characters are
    left out, before anything is put together by file. Paths are taken to be unique."""
    if granularity not in ("block", "per_line", "per_file"):
        raise ValueError(f"no such granularity: {granularity}")
    extension = F.lower(F.regexp_extract(path, "\\.([A-Za-z]+)$", 1))
    language = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])[extension]
    mark = F.create_map(*[F.lit(x) for pair in _STYLES.items() for x in pair])[language]
    rows = files.where(mark.isNotNull()).select(F.col(path).alias("source_path"), language.alias("language"), _marked(F.regexp_replace(content, "\r\n?", "\n"), mark).alias("m"))
    # a piece is a comment and the code after it; the first has no comment
    pieces = rows.select("source_path", "language", F.posexplode(F.split("m", _BEGIN)).alias("i", "piece"))
    comment = F.when(F.col("i") > 0, F.substring_index("piece", _END, 1)).otherwise("")
    code = F.when(F.col("i") > 0, F.substring_index("piece", _END, -1)).otherwise(F.col("piece"))
    breaks = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    pieces = pieces.select("source_path", "language", "i", comment.alias("comment"), code.alias("code"))
    file = W.partitionBy("source_path").orderBy("i")
    lines = breaks(F.col("comment")) + breaks(F.col("code"))
    first = F.coalesce(F.sum(lines).over(file.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + 1
    # strings are marked, too, by empty comments: code goes on over them
    ahead = F.lag("code").over(file)
    triple = F.col("comment").rlike("^(\"\"\"|''')")
    begins = (F.col("i") == 1) & (F.trim(F.translate(ahead, "\n\t", "  ")) == "") | ahead.rlike(r":[ \t]*\n\s*$")
    kind = F.when(triple, F.when(begins, "docstring")).when(F.col("comment").startswith("/*"), "block").otherwise("line")
    found = pieces.select("*", first.cast("int").alias("first"), ahead.alias("ahead"), kind.alias("kind"), F.lag(kind).over(file).alias("before"), F.lag("comment").over(file).alias("comment_before"))
    found = found.where((F.col("comment") != "") & F.col("kind").isNotNull() & ~((F.col("first") == 1) & F.col("comment").startswith("#!")))
    found = found if docstrings else found.where("kind != 'docstring'")
    found = found.select("*", _said(F.col("comment")).alias("said"), (F.col("first") + breaks(F.col("comment"))).cast("int").alias("last")).where(~F.col("said").rlike(PRAGMAS))
    # a comment goes on where only one line break and blanks stand before it, after another of whole lines
    goes_on = (F.col("kind") == "line") & F.col("before").eqNullSafe("line") & (F.col("comment_before") != "") & F.col("ahead").rlike(r"^\n[ \t]*$") & (F.col("first") == F.lag("first").over(file) + 1)
    found = found.withColumn("b", F.sum(F.coalesce(1 - goes_on.cast("int"), F.lit(1))).over(file))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "said"))), lambda x: x["said"]), "\n")
    blocks = found.groupBy("source_path", "b").agg(F.min("kind").alias("kind"), F.min("first").alias("first_line"), F.max("last").alias("last_line"), listed.alias("text"))
    if granularity == "per_line":
        blocks = blocks.select("source_path", "kind", "first_line", F.posexplode(F.split("text", "\n")).alias("n", "text"))
        blocks = blocks.select("source_path", "kind", (F.col("first_line") + F.col("n")).alias("first_line"), (F.col("first_line") + F.col("n")).alias("last_line"), F.trim("text").alias("text"))
    blocks = blocks.where(F.length("text") >= min_chars)
    if granularity == "per_file":
        whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first_line", "text"))), lambda x: x["text"]), "\n\n")
        blocks = blocks.groupBy("source_path").agg(F.lit("file").alias("kind"), F.min("first_line").alias("first_line"), F.max("last_line").alias("last_line"), whole.alias("text"))
        return blocks.select(F.col("source_path").alias("doc_id"), "source_path", "kind", "first_line", "last_line", "text")
    return blocks.select(F.concat_ws("#L", "source_path", F.col("first_line").cast("string")).alias("doc_id"), "source_path", "kind", "first_line", "last_line", "text")
