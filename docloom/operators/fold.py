"""Rows of a group folded in order, with a running state only."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def fold(rows: DataFrame, by: list[str], order: list[str], start: Callable[[], Callable[[tuple], int]], name: str) -> DataFrame:
    """rows with an integer column: what a function gives for each row of a group, in order. start() makes a new function for each group; it
    is called with the row (a named tuple) and may remember what it needs. Rows stream by; no group is held whole."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, step = None, None
        for pdf in frames:
            out = []
            for row in pdf.itertuples(index=False):
                key = tuple(getattr(row, c) for c in by)
                if step is None or key != group:
                    group, step = key, start()
                out.append(step(row))
            yield pdf.assign(**{name: pd.Series(out, dtype="int32", index=pdf.index)})

    schema = rows.schema.simpleString()[len("struct<") : -1]
    return rows.repartition(*by).sortWithinPartitions(*by, *order).mapInPandas(run, f"{schema}, {name} int")
