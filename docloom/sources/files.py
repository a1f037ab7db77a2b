"""Files as documents: one row each, parsed by extension on the executors."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import html

MOST_BYTES = 256 << 20
#: Zipped files that grow beyond this are not read.
MOST_INFLATED = 1 << 30
_OFFICE = {"docx": (r"word/document\.xml", "p", "t"), "pptx": (r"ppt/slides/slide\d+\.xml", "p", "t"), "odt": (r"content\.xml", "p", None), "odp": (r"content\.xml", "p", None)}


def _name(tag: str) -> str:
    return tag.rpartition("}")[2]


def office_text(data: bytes, kind: str) -> str:
    """Paragraphs of a zipped XML document, one a line."""
    part, block, run = _OFFICE[kind]
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as files:
        _inflated(files)
        names = sorted((n for n in files.namelist() if re.fullmatch(part, n)), key=lambda n: (len(n), n))
        for name in names:
            for p in ElementTree.fromstring(files.read(name)).iter():
                if _name(p.tag) == block:
                    out.append("".join(p.itertext()) if run is None else "".join(t.text or "" for t in p.iter() if _name(t.tag) == run))
    return "\n".join(out)


def _inflated(files: zipfile.ZipFile) -> None:
    if sum(f.file_size for f in files.infolist()) > MOST_INFLATED:
        raise ValueError("too large when inflated")


def _column(reference: str | None, otherwise: int) -> int:
    """The column of a cell as C7, from 0."""
    letters = re.match("[A-Z]+", reference or "")
    at = 0
    for letter in letters.group() if letters else "":
        at = at * 26 + ord(letter) - ord("A") + 1
    return at - 1 if letters else otherwise


def sheet_text(data: bytes) -> str:
    """Rows of all sheets, cells joined by tabs; cells that are left out are empty."""
    with zipfile.ZipFile(io.BytesIO(data)) as files:
        _inflated(files)
        names = files.namelist()
        strings = ElementTree.fromstring(files.read("xl/sharedStrings.xml")) if "xl/sharedStrings.xml" in names else ()
        shared = ["".join(t.text or "" for t in s.iter() if _name(t.tag) == "t") for s in strings if _name(s.tag) == "si"]
        out = []
        for name in sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: (len(n), n)):
            for row in (r for r in ElementTree.fromstring(files.read(name)).iter() if _name(r.tag) == "row"):
                cells: list[str] = []
                for c in row:
                    cells += [""] * (_column(c.get("r"), len(cells)) - len(cells))
                    value = "".join(v.text or "" for v in c.iter() if _name(v.tag) in ("v", "t"))
                    cells.append(shared[int(value)] if c.get("t") == "s" and value else value)
                out.append("\t".join(cells))
        return "\n".join(out)


def open_sheet_text(data: bytes) -> str:
    """Rows of all tables of an OpenDocument spreadsheet, cells joined by tabs. Repeated cells are written out, but not empty ones at a row's end;
    rows without a value are left out."""
    with zipfile.ZipFile(io.BytesIO(data)) as files:
        _inflated(files)
        root = ElementTree.fromstring(files.read("content.xml"))
    out = []
    for row in (r for r in root.iter() if _name(r.tag) == "table-row"):
        cells: list[str] = []
        waiting = 0
        for cell in (c for c in row if _name(c.tag) in ("table-cell", "covered-table-cell")):
            times = int(next((v for k, v in cell.attrib.items() if _name(k) == "number-columns-repeated"), "1"))
            value = "\n".join("".join(p.itertext()) for p in cell if _name(p.tag) == "p")
            if value:
                cells += [""] * waiting + [value] * times
                waiting = 0
            else:
                waiting += times
        if cells:
            out.append("\t".join(cells))
    return "\n".join(out)


def parse(data: bytes | None, extension: str) -> tuple[str | None, str, str | None]:
    """(text, parser, what went wrong)."""
    data = data or b""
    try:
        if len(data) > MOST_BYTES:
            raise ValueError("too large")
        if extension in _OFFICE:
            return office_text(data, extension), extension, None
        if extension == "xlsx":
            return sheet_text(data), extension, None
        if extension == "ods":
            return open_sheet_text(data), extension, None
        if b"\0" in data[:8192]:
            return None, "binary", "a binary file"
        return data.decode("utf-8", "replace").replace("\0", ""), "html" if extension in ("html", "htm") else "text", None
    except Exception as e:  # one file that can't be read does not end the job
        return None, extension, f"{type(e).__name__}: {e}"


def read_files(spark: SparkSession, path: str, pattern: str = "*", id: str = "path") -> DataFrame:
    """(doc_id, content, title, source_path, parser, error, fingerprint) of all files below path. id: path, stem or sha1 (of the path)."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = [parse(data, name.rpartition(".")[2].lower() if "." in name else "") for name, data in zip(pdf["title"], pdf["content"], strict=True)]
            yield pd.DataFrame({"source_path": pdf["path"], "title": pdf["title"], "raw": [t for t, _, _ in found], "parser": [p for _, p, _ in found], "error": [e for _, _, e in found], "fingerprint": pdf["fingerprint"]})

    title = F.element_at(F.split("path", "/"), -1)
    rows = rows.select("path", title.alias("title"), "content", F.sha2("content", 256).alias("fingerprint"))
    rows = rows.mapInPandas(run, "source_path string, title string, raw string, parser string, error string, fingerprint string")
    key = {"path": F.col("source_path"), "stem": F.regexp_replace("title", "\\.[^.]*$", ""), "sha1": F.sha1(F.col("source_path").cast("binary"))}[id]
    content = F.when(F.col("parser") == "html", html.text(F.col("raw"))).otherwise(F.col("raw"))
    return rows.select(key.alias("doc_id"), content.alias("content"), "title", "source_path", "parser", "error", "fingerprint")


def read_json_corpus(spark: SparkSession, path: str, documents_key: str = "documents", id: str = "id", content: str = "content", title: str = "title") -> DataFrame:
    """Documents of JSON files that hold an array of objects; keys of no other use are metadata."""
    rows = spark.read.option("multiLine", "true").json(path).select(F.explode(documents_key).alias("d")).select("d.*")
    rest = [c for c in rows.columns if c not in (id, content, title)]
    metadata = F.to_json(F.struct(*rest)) if rest else F.lit("{}")
    return rows.select(F.col(id).cast("string").alias("doc_id"), F.col(content).alias("content"), (F.col(title) if title in rows.columns else F.lit(None).cast("string")).alias("title"), metadata.alias("metadata"))
