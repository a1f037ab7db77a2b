"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. The vector of n letters in a row is the product of their vectors, each rotated
by its place (binding); that of a text is the sum over its n-grams (bundling); that of a language, the sum over its labelled
texts. A text gets the language whose prototype has the largest cosine with it.

Letters are lower-cased; runs of anything else are one blank, which counts as a letter. A text's vector is its n-gram counts
times the matrix of n-gram vectors, taken a slice of n-grams at a time: memory is bound by the slice, not by the alphabet.
Prototypes are sums of integers, so runs agree; the driver has a block of them at a time.

Defined cases: a null text, and one with no letter, is ``und`` with score 0, and teaches nothing; a null language teaches nothing;
with nothing to learn from every text is ``und``; ties go to the language first in code point order; texts that repeat teach each
time; a null id is not held out and its text teaches; further columns stay as they are, but for those named as the result's
(lang_pred, score), which it replaces.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import batches, cut, hash_mod, mix, table

ORDER = 3
_WIDTH = 4096
_ROWS = 512
_POINTS = 0x110000
_BITS = 21
_TIE = 1e-6


@functools.cache
def _letters() -> np.ndarray:
    """The lower-case form of each code point that is a letter, else 0."""
    out = np.zeros(_POINTS, np.uint32)
    for point in range(_POINTS):
        if (c := chr(point)).isalpha():
            out[point] = ord(c.lower()[0])
    return out


class Profiles:
    """N-gram vectors of so many dimensions, from a seed. A letter's vector is drawn by a hash of its code point, so no table of letters is needed and
    no two letters share one."""

    def __init__(self, dimensions: int = 1024, seed: int = 11):
        self.dimensions, self.seed = dimensions, seed

    def letters(self, points: np.ndarray) -> np.ndarray:
        """The vectors of code points; 0 is what stands between words."""
        words = -(-self.dimensions // 64)
        drawn = mix(np.asarray(points, np.uint64)[:, None] * np.uint64(1 << 20) + np.arange(words, dtype=np.uint64)[None, :] + np.uint64(self.seed << 42))
        bits = np.unpackbits(drawn.view(np.uint8), axis=1, bitorder="little")[:, : self.dimensions]
        return (2 * bits.astype(np.int8) - 1).astype(np.int8)

    def grams(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams of all texts (three code points in one number) and the text of each."""
        letters, parts, owners = _letters(), [], []
        for i, text in enumerate(texts):
            if not text.is_valid:
                continue
            code = letters[np.frombuffer(text.as_py().encode("utf-32-le", "surrogatepass"), np.uint32)]
            if not code.any():
                continue
            code = np.concatenate(([0], code, [0])).astype(np.int64)
            code = code[np.concatenate(([True], (code[1:] != 0) | (code[:-1] != 0)))]
            parts.append((code[:-2] << 2 * _BITS) | (code[1:-1] << _BITS) | code[2:])
            owners.append(np.full(len(code) - 2, i, np.int32))
        return (np.concatenate(parts), np.concatenate(owners)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int32))

    def vectors(self, grams: np.ndarray, owners: np.ndarray, n: int) -> np.ndarray:
        """The bundles of n owners."""
        out = np.zeros((n, self.dimensions), np.float32 if len(grams) < 1 << 24 else np.float64)
        places = [(grams >> _BITS * (ORDER - 1 - i)) & ((1 << _BITS) - 1) for i in range(ORDER)]
        used = np.zeros(_POINTS, bool)
        for p in places:
            used[p] = True
        points = np.flatnonzero(used)
        if not len(points):
            return out
        place = np.zeros(_POINTS, np.int64)
        place[points] = np.arange(len(points))
        size, own = len(points), self.letters(points)
        gram = (place[places[0]] * size + place[places[1]]) * size + place[places[2]]
        if size**ORDER <= 1 << 24:
            present = np.zeros(size**ORDER, bool)
            present[gram] = True
            found = np.flatnonzero(present)
            column = np.zeros(size**ORDER, np.int32)
            column[found] = np.arange(len(found))
            column = column[gram]
        else:
            found, column = np.unique(gram, return_inverse=True)
        turned = [np.roll(own, ORDER - 1 - i, axis=1) for i in range(ORDER)]
        for lo in range(0, len(found), _WIDTH):
            some = found[lo : lo + _WIDTH]
            bound = turned[0][some // size**2] * turned[1][some // size % size] * turned[2][some % size]
            inside = slice(None) if len(some) == len(found) else (column >= lo) & (column < lo + len(some))
            counts = np.bincount(owners[inside].astype(np.int64) * len(some) + column[inside] - lo, minlength=n * len(some)).reshape(n, len(some))
            out += counts.astype(out.dtype) @ bound.astype(out.dtype)
        return out


def prototypes(labelled: DataFrame, profiles: Profiles, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, x): the bundle of each language that has letters."""

    def sums(of: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for whole in of:
            for batch in batches(whole, "text", 4 << 20):
                names = batch.column("lang").to_pylist()
                order = sorted(set(names))
                grams, owners = profiles.grams(batch.column("text"))
                index = {x: i for i, x in enumerate(order)}
                of_row = np.array([index[x] for x in names], np.int32)
                for name, vector in zip(order, profiles.vectors(grams, of_row[owners], len(order)).astype(np.float64), strict=True):
                    total[name] = total.get(name, 0) + vector
        size = profiles.dimensions
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(list(total), object), size), pa.string()), pa.array(np.tile(np.arange(size, dtype=np.int32), len(total))), pa.array(np.concatenate(list(total.values())).astype(np.int64))], names=["lang", "at", "x"])

    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    rows = rows.mapInArrow(sums, "lang string, at int, x bigint").groupBy("lang", "at").agg(F.sum("x").alias("x"))
    bundles = rows.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("v")).select("lang", "v.x")
    return cut(bundles.where(F.exists("x", lambda v: v != 0)), "bundles")


def identify(docs: DataFrame, bundles: DataFrame, profiles: Profiles, text: str = "text", block: int = 500) -> DataFrame:
    """docs with lang_pred and score (the cosine; 0 where it is negative). Prototypes are taken in blocks of so many languages, in code point order, one
    after the other: what the driver and a task hold of them does not grow with their number."""
    rest = [c for c in docs.columns if c not in (text, "lang_pred", "score")]
    row = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)])
    rows = docs.select(row.alias("row"), F.col(f"`{text}`").alias("text"), F.lit("und").alias("lang_pred"), F.lit(-2.0).alias("score"))
    held: list = []
    for bundle in bundles.orderBy("lang").toLocalIterator():
        held.append(bundle)
        if len(held) == block:
            rows, held = _compared(rows, held, profiles), []
    if held:
        rows = _compared(rows, held, profiles)
    return rows.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(rest)], "lang_pred", F.greatest("score", F.lit(0.0)).alias("score"))


def _compared(rows: DataFrame, held: list, profiles: Profiles) -> DataFrame:
    """rows, with the language of this block where one is nearer than those before."""
    bundles = np.array([r["x"] for r in held], float)
    bundles = (bundles / np.maximum(np.linalg.norm(bundles, axis=1, keepdims=True), 1e-12)).astype(np.float32)
    shared = rows.sparkSession.sparkContext.broadcast(([r["lang"] for r in held], bundles))

    def predict(of: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, bundles = shared.value
        for whole in of:
            for part in batches(whole, "text", 4 << 20):
                for lo in range(0, len(part), _ROWS):
                    batch = part.slice(lo, _ROWS)
                    n, said, score = len(batch), batch.column("lang_pred").to_pylist(), batch.column("score").to_numpy(zero_copy_only=False).copy()
                    grams, owners = profiles.grams(batch.column("text"))
                    if len(grams):
                        vectors = profiles.vectors(grams, owners, n)
                        cosine = (vectors @ bundles.T / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)).astype(np.float64)
                        # cosines that differ by less than 32-bit products tell are ties, within a block and across
                        best, some = (cosine >= cosine.max(1, keepdims=True) - _TIE).argmax(1), np.zeros(n, bool)
                        some[owners] = True
                        top = cosine[np.arange(n), best].clip(-1, 1)
                        for i in np.flatnonzero(some & (top > score + _TIE)).tolist():
                            said[i], score[i] = names[best[i]], top[i]
                    yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("text"), pa.array(said, pa.string()), pa.array(score)], names=["row", "text", "lang_pred", "score"])

    return rows.mapInArrow(predict, rows.schema)


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, profiles = table(spark, sf_dir, "documents"), Profiles()
    held_out = F.coalesce(hash_mod("doc_id", 3) == 1, F.lit(False))
    learn = docs.where(~held_out)
    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    return identify(rows, prototypes(learn, profiles), profiles)
