"""Names of a table, found in texts by an Aho-Corasick automaton: one pass over a text for all names of a block."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.shared import cut


def _hits(names: list[tuple], keys: list[str], borders: bool):
    def run(of: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list] = {}
        for name_id, name in names:
            known.setdefault(name, []).append(name_id)
        automaton = ahocorasick.Automaton()
        for name, ids in known.items():
            automaton.add_word(name, (len(name), ids))
        automaton.make_automaton()
        for batch in of:
            rows, ids, starts, ends = [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                for last, (size, own) in automaton.iter(text or ""):
                    start, end = last + 1 - size, last + 1
                    if borders and (start and text[start - 1].isalnum() and text[start].isalnum() or end < len(text) and text[end].isalnum() and text[end - 1].isalnum()):
                        continue
                    rows += [i] * len(own)
                    ids += own
                    starts += [start] * len(own)
                    ends += [end] * len(own)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(at) for k in keys], pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=[*keys, "name_id", "start", "end"])

    return run


def find_names(rows: DataFrame, names: DataFrame, keys: list[str], text: str, borders: bool = True, longest: bool = True, block_chars: int = 2_000_000) -> DataFrame:
    """(keys, name_id, start, end): where texts have a name of names (name_id bigint, name), in code points, ends exclusive. borders: not within a run of
    letters and digits; longest: of names that begin at one place only the longest, and all that are equal to it. Names are taken in blocks of about
    `block_chars` characters, each a pass over the texts, so that what a task holds does not grow with the names. Null and empty names and texts have
    no hit; keys tell rows apart."""
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{kinds}, name_id bigint, start bigint, end bigint"
    of, found, held, size = rows.select(*keys, F.col(text).alias("text")), [], [], 0
    for row in names.where("name != ''").select("name_id", "name").toLocalIterator():
        if held and size + len(row["name"]) > block_chars:
            found.append(cut(of.mapInArrow(_hits(held, keys, borders), schema), "names"))
            held, size = [], 0
        held.append((row["name_id"], row["name"]))
        size += len(row["name"])
    if held:
        found.append(cut(of.mapInArrow(_hits(held, keys, borders), schema), "names"))
    if not found:
        return rows.sparkSession.createDataFrame([], schema)
    hits = reduce(DataFrame.unionByName, found)
    if not longest:
        return hits
    return hits.withColumn("_most", F.max("end").over(W.partitionBy(*keys, "start"))).where("end = _most").drop("_most")
