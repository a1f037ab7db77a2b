"""The language of source code that has no path, by what only that language writes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: (language, weight, pattern). "script" is JavaScript and TypeScript; what is of TypeScript alone tells which. Of patterns that begin at the same
#: place, the one that takes in more stands first.
MARKERS = (
    ("python", 3, r"^[ \t]*(?:async[ \t]+)?def[ \t]+\w+\(.*:[ \t]*$"),
    ("ruby", 1, r"^[ \t]*def[ \t]+[\w.]+[?!]?[ \t]*(?:\([^)\n]*\))?[ \t]*$"),
    ("python", 3, r"^[ \t]*from[ \t]+[\w.]+[ \t]+import[ \t]"),
    ("python", 3, r"^[ \t]*(?:elif|except)\b.*:[ \t]*$"),
    ("python", 2, r"^[ \t]*(?:with|for|while|if|class)[ \t][^{;\n]*:[ \t]*$"),
    ("python", 1, r"\bself\.\w"),
    ("ruby", 3, r"^[ \t]*end[ \t]*$"),
    ("ruby", 3, r"^[ \t]*elsif[ \t]"),
    ("ruby", 3, r"^[ \t]*attr_(?:reader|writer|accessor)[ \t]+:"),
    ("ruby", 2, r"^[ \t]*(?:require|require_relative)[ \t]+[\"']"),
    ("ruby", 2, r"\bdo[ \t]+\|"),
    ("java", 3, r"^[ \t]*package[ \t]+[\w.]+[ \t]*;"),
    ("go", 3, r"^package[ \t]+\w+[ \t]*$"),
    ("go", 3, r"^func[ \t]+(?:\([^)\n]*\)[ \t]*)?\w+\("),
    ("go", 2, r":=[ \t]"),
    ("go", 2, r"^type[ \t]+\w+[ \t]+(?:struct|interface)\b"),
    ("go", 1, r"\bfmt\.[A-Z]"),
    ("rust", 3, r"\bfn[ \t]+\w+[ \t]*[<(]"),
    ("rust", 3, r"^[ \t]*impl\b"),
    ("rust", 2, r"^[ \t]*let[ \t]+mut[ \t]"),
    ("rust", 2, r"^[ \t]*use[ \t]+\w+::"),
    ("rust", 1, r"\b(?:println|vec|format|panic|assert_eq)!"),
    ("rust", 1, r"&(?:mut|self|str)\b"),
    ("cpp", 3, r"^[ \t]*#[ \t]*include[ \t]*<\w+>"),
    ("c", 2, r"^[ \t]*#[ \t]*include[ \t]*[<\"][\w/.]+\.h[>\"]"),
    ("c", 1, r"^[ \t]*(?:static[ \t]+)?(?:int|void|char|double|struct[ \t]+\w+)[ \t*]+\w+\([^;\n]*$"),
    ("c", 1, r"\b(?:printf|malloc|calloc|free|sizeof)[ \t]*\("),
    ("c", 1, r"^[ \t]*typedef\b"),
    ("cpp", 3, r"\bstd::\w"),
    ("cpp", 3, r"^[ \t]*template[ \t]*<"),
    ("cpp", 2, r"^[ \t]*(?:public|private|protected):"),
    ("csharp", 3, r"^[ \t]*using[ \t]+System\b"),
    ("cpp", 2, r"^[ \t]*using[ \t]+namespace\b"),
    ("csharp", 3, r"\bConsole\.[A-Z]"),
    ("csharp", 2, r"\{[ \t]*get;"),
    ("csharp", 1, r"^[ \t]*namespace[ \t]+[\w.]+"),
    ("csharp", 1, r"\b(?:public|private|internal)[ \t]+(?:(?:async|static|override)[ \t]+)*(?:void|int|string|bool|Task)\b"),
    ("java", 1, r"\b(?:public|private|protected)[ \t]+(?:(?:static|final)[ \t]+)*(?:void|int|boolean|long|double|String)\b"),
    ("java", 3, r"\bSystem\.(?:out|err)\b"),
    ("java", 2, r"^[ \t]*import[ \t]+(?:static[ \t]+)?[\w.*]+[ \t]*;"),
    ("java", 2, r"@Override\b"),
    ("script", 3, r"^[ \t]*import[ \t].*[ \t]from[ \t]+[\"']"),
    ("script", 2, r"\bfunction\b[ \t*]*\w*\("),
    ("script", 2, r"\b(?:console\.\w+|require)\("),
    ("script", 2, r"\bmodule\.exports\b"),
    ("script", 2, r"==="),
    ("typescript", 2, r"^[ \t]*(?:export[ \t]+)?(?:type[ \t]+\w+[ \t]*=|interface[ \t]+\w+)"),
    ("script", 1, r"^[ \t]*(?:export|const|let|var)[ \t]"),
    ("script", 1, r"=>"),
    ("typescript", 2, r":[ \t]*(?:string|number|boolean|any|unknown|never)\b"),
)
#: Interpreters in a first line, in the order in which they are looked for.
INTERPRETERS = {"python": "python", "node": "javascript", "ruby": "ruby"}
LANGUAGES = ("c", "cpp", "csharp", "go", "java", "javascript", "python", "ruby", "rust", "typescript")


def _alternatives() -> str:
    """All markers as one pattern, sorted by where they can begin, so that most places of a text are passed by after three looks: at lines' beginnings, with
    or without indentation, at the first letters of words, and at signs."""
    heads = {"^[ \\t]*": "^[ \\t]*", "^": "^", "\\b": "\\b(?=[A-Za-z])", "": ""}
    groups: dict[str, list[str]] = {head: [] for head in heads}
    for _, _, pattern in MARKERS:
        head = next(h for h in heads if pattern.startswith(h))
        groups[head].append(pattern.removeprefix(head))
    return "|".join(f"{heads[head]}(?:{'|'.join(rest)})" for head, rest in groups.items())


def language_of_content(content: Column, least: int = 3, margin: int = 2, longest_line: int = 2000) -> Column:
    """The language that a text is written in, else null: the first line's interpreter, or the language whose markers weigh most, each counted once,
    where that is `least` or more and `margin` more than the next. Null, too, for texts that say they are generated and those with a line of more
    than `longest_line` characters, as minified code has.

    The whole text is gone through once, by one pattern of all markers that takes no text, so that they may overlap. What it finds, each once, is short:
    that is told apart by the single patterns."""
    every = f"(?md)(?=({_alternatives()}))"
    found = F.array_distinct(F.regexp_extract_all(content, F.lit(every), F.lit(1)))
    first = F.regexp_extract(content, r"^\s*(#![^\r\n]*)", 1)

    def begins(pattern: str):
        return lambda s: s.rlike(f"(?md)^(?:{pattern})")

    def pick(x: Column) -> Column:
        def weight(*names: str) -> Column:
            marks = [F.when(F.exists(x, begins(p)), w).otherwise(0) for name, w, p in MARKERS if name in names]
            return sum(marks[1:], marks[0])

        def entry(name: str, of: Column) -> Column:
            return F.struct(of.alias("w"), F.lit(name).alias("name"))

        script, typed = weight("script"), weight("typescript")
        scores = [entry(name, weight(name)) for name in LANGUAGES if name not in ("javascript", "typescript")]
        scores += [entry("javascript", F.when(typed == 0, script).otherwise(0)), entry("typescript", F.when(typed > 0, script + typed).otherwise(0))]
        ranked = F.transform(F.array(F.sort_array(F.array(*scores), asc=False)), lambda r: F.struct(r[0].alias("best"), r[1].alias("next")))[0]
        told = F.transform(F.array(ranked), lambda r: F.when((r["best"]["w"] >= least) & (r["best"]["w"] - r["next"]["w"] >= margin), r["best"]["name"]))
        return told[0]

    # an array of one, so that what is found is computed once
    by_marks = F.transform(F.array(found), pick)[0]
    by_interpreter = F.coalesce(*[F.when(first.contains(word), name) for word, name in INTERPRETERS.items()])
    made = content.contains("@generated") | content.contains("sourceMappingURL") | content.rlike(f"[^\\r\\n]{{{longest_line + 1}}}")
    return F.when(~made, F.coalesce(by_interpreter, by_marks))
