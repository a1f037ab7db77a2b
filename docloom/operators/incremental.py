"""Incremental reads: what is new since a state that is kept between runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def changed(current: DataFrame, state: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """Rows that are new or whose fingerprint differs from the state's."""
    before = state.select(F.col(key), F.col(fingerprint).alias("_before"), F.lit(True).alias("_known"))
    return current.join(before, key, "left").where(F.col("_known").isNull() | ~F.col(fingerprint).eqNullSafe(F.col("_before"))).drop("_before", "_known")


def deleted(current: DataFrame, state: DataFrame, key: str) -> DataFrame:
    return state.select(key).join(current.select(key), key, "left_anti")


def next_state(current: DataFrame, state: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """The state after a complete run: keys that are there now, with their fingerprints."""
    return current.select(key, fingerprint)


def after(rows: DataFrame, ts: str, id: str, cursor: tuple) -> DataFrame:
    """Rows whose (ts, id as text) come after the cursor."""
    at, last = cursor
    return rows.where((F.col(ts) > at) | (F.col(ts) == at) & (F.col(id).cast("string") > str(last)))


def high_water(rows: DataFrame, ts: str, id: str) -> DataFrame:
    """The cursor that is next."""
    return rows.agg(F.max(F.struct(F.col(ts), F.col(id).cast("string").alias("id"))).alias("x")).select(F.col(f"x.{ts}").alias("ts"), F.col("x.id").alias("id"))


def between(rows: DataFrame, ts: str, low: Column, high: Column) -> DataFrame:
    """Rows in (low, high]."""
    return rows.where((F.col(ts) > low) & (F.col(ts) <= high))
