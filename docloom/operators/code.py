"""Source code of ten languages as symbols, calls and base classes.

Definitions are told by a pattern for each language, and where they end by indentation; there is no parser, so code whose indentation
does not follow its nesting is told wrongly. Lines stream by where their file is read; what is held is one file and a stack of its open definitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import node_id, qualified_name
from docloom.operators import graph

#: Extensions of the languages.
EXTENSIONS = {
    "py": "python", "java": "java", "go": "go", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript",
    "rs": "rust", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "hpp": "cpp", "cs": "csharp", "rb": "ruby",
}
_JVM = r"(?:(?:public|protected|private|internal|static|final|abstract|sealed|synchronized|default|native|virtual|override|async|partial|readonly)\s+)"
_TYPED = rf"^\s*{_JVM}+(?:<[^>]*>\s*)?[\w<>\[\],.?\s]*?\b(\w+)\s*\([^;]*$"
_SCRIPT_CLASS = r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:class|interface)\s+(\w+)"
_SCRIPT_FUNCTION = (
    r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function\s*\*?\s*|(?:const|let|var)\s+(?=\w+\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=]+)?=>)"
    r"|(?:(?:public|private|protected|static|async|readonly|get|set)\s+)*(?!(?:if|for|while|switch|catch|return|function|else|do)\b)(?=[\w$]+\s*\([^;]*\{\s*$))(\w+)"
)
_C_FUNCTION = r"^(?!\s|typedef\b|return\b|else\b|if\b|for\b|while\b|switch\b)[A-Za-z_][\w\s*&:<>,]*?[\s*&:](~?\w+)\s*\([^;]*$"
#: What defines a class and a function; the first group is the name.
DEFINITIONS = {
    "python": (r"^\s*class\s+(\w+)", r"^\s*(?:async\s+)?def\s+(\w+)"),
    "java": (rf"^\s*{_JVM}*(?:class|interface|enum|record)\s+(\w+)", _TYPED),
    "csharp": (rf"^\s*{_JVM}*(?:class|interface|enum|struct|record)\s+(\w+)", _TYPED),
    "go": (r"^type\s+(\w+)\s+(?:struct|interface)\b", r"^func\s+(?:\([^)]*\)\s*)?(\w+)"),
    "typescript": (_SCRIPT_CLASS, _SCRIPT_FUNCTION),
    "javascript": (_SCRIPT_CLASS, _SCRIPT_FUNCTION),
    "rust": (r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait)\s+(\w+)", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:(?:async|unsafe|const)\s+)*fn\s+(\w+)"),
    "c": (r"^(?:typedef\s+)?(?:struct|enum|union)\s+(\w+)\s*\{", _C_FUNCTION),
    "cpp": (r"^\s*(?:class|struct|enum)\s+(\w+)[^;]*$", _C_FUNCTION),
    "ruby": (r"^\s*(?:class|module)\s+([A-Z]\w*)", r"^\s*def\s+(?:self\.)?(\w+[?!=]?)"),
}
#: Words before a parenthesis that are no calls.
NO_CALLS = "if for while switch catch return function def class elif and or not in is lambda await new sizeof with fn func match except assert yield".split()


def language(path: str | Column) -> Column:
    """The language of a source file by its extension; null of others."""
    extension = F.lower(F.regexp_extract(path, "\\.([A-Za-z]+)$", 1))
    return F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])[extension]


def _by_language(of) -> Column:
    """The value for a row's language; only that one is computed."""
    out = None
    for name in DEFINITIONS:
        out = (F.when if out is None else out.when)(F.col("language") == name, of(name))
    return out


def _around(indent: list[int], name: list[str], blank: list[bool], bracket: list[bool], closes: list[bool]) -> Iterator[int]:
    """For each line, in order, the line of the innermost definition that it is in; of a line that defines, of the one around it; else -1."""
    stack: list[tuple[int, int]] = []
    for line, (deep, said, empty, inner, end) in enumerate(zip(indent, name, blank, bracket, closes, strict=True)):
        if not empty:
            while stack and deep <= stack[-1][0] and not (inner and deep == stack[-1][0]):
                stack.pop()
        yield stack[-1][1] if stack else -1
        if said:
            stack.append((deep, line))
        elif end and stack and deep == stack[-1][0]:
            stack.pop()


_LINE = ["text", "kind", "name", "indent", "blank", "bracket", "closes"]


def _definitions(of: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of files, each file's in order from line 0, as rows of their definitions. What is held is one file."""

    def rows(file: dict[str, list]) -> list[dict]:
        around, own = list(_around(*[file[c] for c in ("indent", "name", "blank", "bracket", "closes")])), {}
        for line, at in enumerate(around):
            own.setdefault(line if file["name"][line] else at, []).append(line)
        out = []
        for at, lines in sorted(own.items()):
            text = "\n".join(file["text"][i] for i in lines)
            if not text.strip(" \t\n\x0b\f\r"):
                continue
            written, known = [i for i in lines if not file["blank"][i]], at >= 0
            scope = file["name"][around[at]] if known and around[at] >= 0 else None
            out.append({"seq_num": len(out), "kind": file["kind"][at] if known else None, "name": file["name"][at] if known else None, "scope": scope, "first": written[0], "last": written[-1], "text": text})
        return [x | {"source_path": file["path"], "language": file["language"]} for x in out]

    file, found = None, []
    for batch in of:
        column = {c: batch.column(c).to_pylist() for c in _LINE}
        starts = np.flatnonzero(batch.column("line").to_numpy() == 0).tolist()
        end = starts[0] if starts else len(batch)
        for c in _LINE if end else ():  # the file goes on
            file[c] += column[c][:end]
        for lo, hi in zip(starts, [*starts, len(batch)][1:], strict=True):
            found += rows(file) if file else []
            file = {c: column[c][lo:hi] for c in _LINE} | {"path": batch.column("source_path")[lo].as_py(), "language": batch.column("language")[lo].as_py()}
        yield pa.RecordBatch.from_pylist(found, _FOUND)
        found = []
    yield pa.RecordBatch.from_pylist(rows(file) if file else [], _FOUND)


_FOUND = pa.schema([("source_path", pa.string()), ("language", pa.string()), ("seq_num", pa.int32()), ("kind", pa.string()), ("name", pa.string()), ("scope", pa.string()), ("first", pa.int32()), ("last", pa.int32()), ("text", pa.string())])


def symbols(files: DataFrame, path: str = "source_path", content: str = "content") -> DataFrame:
    """(source_path, language, seq_num, kind, name, scope, fqn, first_line, last_line, text) of the source files among files: a row for each
    class or function, with those of its lines that are in no definition within it, and one of kind module for the lines of a file outside of
    all. scope is the name of the definition around. Files of other languages and without text have none; paths are taken to be unique."""
    rows = files.select(F.col(path).alias("source_path"), language(path).alias("language"), F.regexp_replace(content, "\r\n?", "\n").alias("_text"))
    lines = rows.where("language is not null and _text != ''").select("source_path", "language", F.posexplode(F.split("_text", "\n")).alias("line", "text"))
    text = F.col("text")
    kind = _by_language(lambda name: F.when(text.rlike(DEFINITIONS[name][0]), "class").when(text.rlike(DEFINITIONS[name][1]), "function"))
    name = _by_language(lambda name: F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in DEFINITIONS[name]]))
    lines = lines.select(
        "*",
        kind.alias("kind"),
        F.coalesce(name, F.lit("")).alias("name"),
        F.length(F.regexp_extract(F.regexp_replace(text, "\t", "    "), "^ *", 0)).alias("indent"),
        (F.trim(text) == "").alias("blank"),
        text.rlike(r"^\s*(?:[{})\]]|end\b)").alias("bracket"),
        text.rlike(r"^\s*(?:\}|end\b)").alias("closes"),
    )
    # a file's lines follow each other where the file was read: nothing is shuffled or sorted
    found = lines.mapInArrow(_definitions, "source_path string, language string, seq_num int, kind string, name string, scope string, first int, last int, text string")
    named = F.concat_ws(".", "scope", "name")
    return found.select(
        "source_path",
        "language",
        "seq_num",
        F.coalesce("kind", F.lit("module")).alias("kind"),
        "name",
        "scope",
        F.when(F.col("name").isNotNull(), qualified_name(F.col("source_path"), named)).alias("fqn"),
        (F.col("first") + 1).alias("first_line"),
        (F.col("last") + 1).alias("last_line"),
        F.regexp_replace("text", "^\\n+|\\s+$", "").alias("text"),
    )


def _code(text: Column) -> Column:
    """Without strings and comments."""
    bare = F.regexp_replace(text, r"\"[^\"\\\n]*+(?:\\.[^\"\\\n]*+)*+\"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'", "\"\"")
    mark = F.when(F.col("language").isin("python", "ruby"), F.regexp_replace(bare, "(?m)#.*$", ""))
    return mark.otherwise(F.regexp_replace(F.regexp_replace(bare, r"(?s)/\*.*?\*/", ""), "(?m)//.*$", ""))


def callees(text: Column, name: Column) -> Column:
    """Names that are called in a symbol's text, each once; its own, as of its definition, only where it occurs again."""
    called = F.filter(F.regexp_extract_all(_code(text), F.lit(r"\b([A-Za-z_]\w*)\s*\("), F.lit(1)), lambda c: ~c.isin(NO_CALLS))
    again = F.size(F.filter(called, lambda c: c.eqNullSafe(name))) > 1
    return F.filter(F.array_distinct(called), lambda c: ~c.eqNullSafe(name) | again)


def bases(text: Column) -> Column:
    """Names of the classes that the first line of a class names as its bases."""
    first = F.regexp_extract(text, "^[^\\n]*", 0)
    listed = (
        F.when(F.col("language") == "python", F.regexp_extract(first, r"class\s+\w+\s*\(([^)]*)\)", 1))
        .when(F.col("language") == "ruby", F.regexp_extract(first, r"class\s+[\w:]+\s*<\s*([\w:]+)", 1))
        .when(F.col("language").isin("cpp", "csharp"), F.regexp_extract(first, r"\w+\s*(?:<[^>]*>)?\s*:\s*([^{]+)", 1))
        .when(F.col("language").isin("java", "typescript", "javascript"), F.regexp_extract(first, r"\b(?:extends|implements)\s+([^{]+)", 1))
        .otherwise("")
    )
    names = F.transform(F.split(F.regexp_replace(listed, r"<[^>]*>|\b(?:public|private|protected|virtual|implements|extends)\b", ","), ","), lambda p: F.regexp_extract(p, r"(\w+)\s*$", 1))
    return F.array_distinct(F.filter(names, lambda n: n != ""))


def imports(content: Column) -> Column:
    """Words of the lines that import."""
    said = F.regexp_extract_all(content, F.lit(r"(?m)^\s*(?:import|from|use|using|require|require_relative|#include)\b(.*)$"), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(said, lambda s: F.regexp_extract_all(s, F.lit(r"[A-Za-z_]\w*"), F.lit(0)))))


def relationships(files: DataFrame, path: str = "source_path", content: str = "content") -> DataFrame:
    """(src, dst, kind, resolution, confidence, src_node_id, dst_node_id): which symbol calls (calls) or extends (inherits) which, by name, as
    :func:`docloom.operators.graph.resolve_names` tells them apart. Names that no file defines have no edge."""
    found = symbols(files, path, content).where("kind != 'module'")
    known = files.select(F.col(path).alias("source_path"), imports(F.col(content)).alias("imports"))
    stem = F.regexp_extract("source_path", r"([^/\\]*?)(?:\.[^./\\]*)?$", 1)
    targets = found.select("fqn", "name", stem.alias("stem"), "kind")
    uses = found.join(known, "source_path")

    def edges(named: Column, kind: str, rows: DataFrame, to: DataFrame) -> DataFrame:
        calls = rows.select(F.col("fqn").alias("caller"), "imports", F.explode(named).alias("callee"))
        calls = calls.withColumn("call_id", F.concat_ws(">", "caller", "callee"))
        return graph.resolve_names(calls, to.drop("kind")).withColumn("kind", F.lit(kind))

    out = edges(callees(F.col("text"), F.col("name")), "calls", uses, targets)
    out = out.unionByName(edges(bases(F.col("text")), "inherits", uses.where("kind = 'class'"), targets.where("kind = 'class'")))
    return out.select("src", "dst", "kind", "resolution", "confidence", node_id(F.col("src")).alias("src_node_id"), node_id(F.col("dst")).alias("dst_node_id"))
