"""Query hints: terms that stand where a query's terms stand, by distributional similarity."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.batches import sized, strings, telling, token_codes
from docloom.functions.text import query_tokens
from docloom.functions.vectors import places_of
from docloom.operators.search import nearest, top_k
from docloom.shared import cut

#: So many tokens are counted at once, and so many pairs are dealt to one bucket of terms.
TOKENS, PAIRS = 2_000_000, 8_000_000
#: Pairs of an owner and another term, a row for each bucket and task, or more: the owners' names, how many pairs each has, the other terms' names
#: and buckets, which of them each pair has, and how often.
_DEALT = "p int, owner binary, size binary, other binary, to binary, at binary, n binary"
#: The same, where the other terms have a margin and places instead of names.
_KNOWN = "p int, owner binary, size binary, m binary, places binary, at binary, n binary"


def _packed(data: bytes) -> bytes:
    return len(data).to_bytes(8) + pa.compress(data, codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> bytes:
    return pa.decompress(data[8:], _size(data), codec="zstd", asbytes=True)


def _size(data: bytes) -> int:
    return int.from_bytes(data[:8])


def _narrow(numbers: np.ndarray) -> bytes:
    """Natural numbers in as few bytes each as the largest needs, which is told first."""
    kind = np.min_scalar_type(int(numbers.max()) if len(numbers) else 0)
    return _packed(bytes([kind.itemsize]) + numbers.astype(kind).tobytes())


def _wide(data: bytes) -> np.ndarray:
    data = _unpacked(data)
    return np.frombuffer(data, f"u{data[0]}", offset=1).astype(np.int64)


def _named(names: pa.Array) -> bytes:
    """Names without a line break, as lines."""
    return _packed(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names), pa.scalar("\n", names.type)).cast(pa.large_binary())[0].as_py())


def _names(data: bytes) -> pa.Array:
    text = np.frombuffer(_unpacked(data), np.uint8)
    breaks = np.flatnonzero(text == ord("\n"))
    ends = np.concatenate(([0], breaks - np.arange(len(breaks)), [len(text) - len(breaks)]))
    return pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(text[text != ord("\n")]))


def _sorted(codes: np.ndarray) -> np.ndarray:
    """The order of codes under 2 ** 31, stable, by 16 bits at a time."""
    order = np.argsort((codes & 0xFFFF).astype(np.uint16), kind="stable")
    return order[np.argsort((codes[order] >> 16).astype(np.uint16), kind="stable")]


def _dealt(owner: np.ndarray, other: np.ndarray, n: np.ndarray, owners: pa.Array, buckets: np.ndarray, told: dict[str, Callable[[np.ndarray], bytes]]) -> Iterator[pa.RecordBatch]:
    """Pairs as rows for each owner's bucket. told: columns of the other terms, made for those that a row has."""
    by = _sorted(buckets)
    place = np.empty(len(by), np.int32)
    place[by] = np.arange(len(by))
    owner = place[owner]
    sizes = np.bincount(owner, minlength=len(by))
    order = _sorted(owner)
    del owner
    other, n = other[order], n[order]
    del order
    edges = np.concatenate(([0], np.cumsum(sizes)))
    of, starts = np.unique(buckets[by], return_index=True)
    some, number = np.zeros(int(other.max(initial=0)) + 1, bool), np.zeros(int(other.max(initial=0)) + 1, np.int64)
    for p, lo, hi in zip(of.tolist(), starts, [*starts[1:], len(by)], strict=True):
        e = slice(edges[lo], edges[hi])
        if e.start == e.stop:
            continue
        own = lo + np.flatnonzero(sizes[lo:hi])
        some[other[e]] = True
        held = np.flatnonzero(some)
        some[held] = False
        number[held] = np.arange(len(held))
        row = {"p": p, "owner": _named(owners.take(pa.array(by[own]))), "size": _narrow(sizes[own]), **{k: f(held) for k, f in told.items()}, "at": _narrow(number[other[e]]), "n": _narrow(n[e])}
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.int32() if k == "p" else pa.binary()) for k, v in row.items()], names=list(row))


def _said(rows: DataFrame, text: str, min_chars: int, make: Callable[[Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """make(...) of the texts of each task, about a MB at a time: which text each token is of, which name it has, and the names. Filler words and tokens of
    fewer than `min_chars` characters are left out."""

    def read(of: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
        for batch in sized(of, "_text"):
            own, code, names = token_codes(batch.column("_text"))
            kept = telling(names, min_chars)
            some = kept[code] if len(code) else np.zeros(0, bool)
            yield own[some], (np.cumsum(kept) - 1)[code[some]], names.filter(pa.array(kept))

    return rows.select(F.lower(text).alias("_text")).mapInArrow(lambda of: make(read(of)), schema)


def _meetings(rows: DataFrame, text: str, window: int, min_chars: int) -> int:
    """How often any two different terms stand in a window."""

    def count(of: Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]) -> Iterator[pa.RecordBatch]:
        n = 0
        for own, code, _ in of:
            for o in range(1, min(window, len(code) - 1) + 1):
                n += int(((own[o:] == own[:-o]) & (code[o:] != code[:-o])).sum())
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return _said(rows, text, min_chars, count, "n bigint").agg(F.sum("n")).first()[0] or 0


def _dealt_pairs(rows: DataFrame, text: str, window: int, min_chars: int, parts: int) -> DataFrame:
    """Pairs of terms, counted where the texts are, `TOKENS` tokens at a time, and dealt out by each of the two. What is shuffled is a row for each bucket
    of terms, with numbers for terms, and a term's name once a row."""

    def count(of: Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]) -> Iterator[pa.RecordBatch]:
        waiting, held = [], 0
        for each in of:
            waiting.append(each)
            held += len(each[1])
            if held >= TOKENS:
                yield from pairs(waiting)
                waiting, held = [], 0
        if held:
            yield from pairs(waiting)

    def pairs(waiting: list[tuple[np.ndarray, np.ndarray, pa.Array]]) -> Iterator[pa.RecordBatch]:
        names = pa.concat_arrays([n for _, _, n in waiting]).dictionary_encode()
        at = names.indices.to_numpy().astype(np.int64)
        names = names.dictionary
        keys, start = [], 0
        for own, code, some in waiting:
            code = at[start : start + len(some)][code]
            start += len(some)
            for o in range(1, min(window, len(code) - 1) + 1):
                x, y = code[:-o], code[o:]
                met = (own[:-o] == own[o:]) & (x != y)
                keys.append(np.minimum(x, y)[met] << 32 | np.maximum(x, y)[met])
        waiting.clear()
        key, n = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.int64), return_counts=True)
        del keys
        x, y, n = (key >> 32).astype(np.int32), (key & 0xFFFFFFFF).astype(np.int32), n.astype(np.int32)
        del key
        bucket = np.fromiter((zlib.crc32(w.encode()) % parts for w in strings(names)), np.int64, len(names))
        told = {"other": lambda held: _named(names.take(pa.array(held))), "to": lambda held: _narrow(bucket[held])}
        yield from _dealt(np.concatenate((x, y)), np.concatenate((y, x)), np.concatenate((n, n)), names, bucket, told)

    return _said(rows, text, min_chars, count, _DEALT).repartitionById(parts, F.col("p"))


def _counted(of: Iterator[pa.RecordBatch]) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a bucket added up: names of owners, of other terms, the buckets of these; which owner and other term each pair has, and how often. Pairs
    are added up whenever many wait."""
    owners = others = pa.array([], pa.large_string())
    to, key, n = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    waiting, held = [], 0

    def merge() -> None:
        nonlocal owners, others, to, key, n, held
        own, all_ = (pa.concat_arrays([known, *[_names(r[c]) for r in waiting]]).dictionary_encode() for known, c in ((owners, "owner"), (others, "other")))
        # names that were known before keep their numbers
        at_own, at_all = (x.indices.to_numpy().astype(np.int64)[len(known) :] for x, known in ((own, owners), (all_, others)))
        fresh = np.zeros(len(all_.dictionary), np.int64)
        fresh[: len(to)] = to
        fresh[at_all] = np.concatenate([_wide(r["to"]) for r in waiting])
        keys, times, i, j = [key], [n], 0, 0  # a pair's number is of 64 bits, how often it is seen too
        for r in waiting:
            size, at, k = _wide(r["size"]), _wide(r["at"]), _wide(r["n"])
            last = int(at.max()) + 1
            keys.append(np.repeat(at_own[i : i + len(size)], size) << 32 | at_all[j : j + last][at])
            times.append(k)
            i, j = i + len(size), j + last
        waiting.clear()
        keys, times = np.concatenate(keys), np.concatenate(times)
        order = np.argsort(keys)
        keys = keys[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        owners, others, to, key, n, held = own.dictionary, all_.dictionary, fresh, keys[first], np.add.reduceat(times[order], first), 0

    for batch in of:
        for i in range(len(batch)):
            waiting.append({c: batch.column(c)[i].as_py() for c in ("owner", "size", "other", "to", "at", "n")})
            held += _size(waiting[-1]["at"])
            if held > PAIRS:
                merge()
    if waiting:
        merge()
    return owners, others, to, (key >> 32).astype(np.int32), (key & 0xFFFFFFFF).astype(np.int32), n


def _parts(rows: DataFrame, meetings: int) -> int:
    """How many buckets of terms: as many as keep a bucket's pairs few, whatever the size of the table."""
    return max(2 * rows.sparkSession.sparkContext.defaultParallelism, 2 * meetings // PAIRS)


def neighbour_counts(rows: DataFrame, text: str, window: int = 4, min_chars: int = 3, piece: int = 4096) -> DataFrame:
    """(a, b, n): how often two different terms, a < b, stand at most `window` terms from each other. Filler words and terms of fewer than
    `min_chars` characters are left out before. Pairs are counted where the texts are, many texts at once, and added up by buckets of
    terms. (`piece` has no effect any more: no array of pairs is made.)"""

    def add(of: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owners, others, _, own, other, n = _counted(of)
        names = pa.concat_arrays([owners, others])
        place = np.empty(len(names), np.int64)
        place[pc.sort_indices(names).to_numpy()] = np.arange(len(names))
        first = np.flatnonzero(place[own] < place[len(owners) + other])
        # of equal names none is before the other; a pair's terms differ
        for s in range(0, len(first), 100_000):
            e = first[s : s + 100_000]
            yield pa.RecordBatch.from_arrays([owners.take(pa.array(own[e])).cast(pa.string()), others.take(pa.array(other[e])).cast(pa.string()), pa.array(n[e])], names=["a", "b", "n"])

    return _dealt_pairs(rows, text, window, min_chars, _parts(rows, _meetings(rows, text, window, min_chars))).mapInArrow(add, "a string, b string, n bigint")


def term_vectors(rows: DataFrame, text: str, window: int = 4, dimensions: int = 128, nonzero: int = 4, min_count: int = 5) -> DataFrame:
    """(term, m, embedding): a vector for each term with at least `min_count` neighbours (m). Each term has a sparse random vector, `nonzero` signs
    in dimensions by its hash; a term's embedding is the sum of its neighbours' random vectors, weighed by positive pointwise mutual
    information in thousandths. So no matrix of terms by terms is made, and the sums are of integers: the same for any partitions.
    Terms that no neighbour says anything of, as where all weights are 0, have no row.

    Pairs are dealt out twice: to the bucket of the one term, where their number and that term's margin are known, and with these and its places to the bucket
    of the other, where its vector is summed. No pair is a row, and no table of terms is sent to all tasks."""
    meetings = _meetings(rows, text, window, 3)
    parts, total = _parts(rows, meetings), 2 * meetings

    def know(of: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owners, others, to, own, other, n = _counted(of)
        if not len(n):
            return
        at = np.stack([places_of(owners, dimensions, f"#{j}".encode()) for j in range(nonzero)], axis=1)
        m = np.bincount(own, n, len(owners)).astype(np.int64)
        yield from _dealt(other, own, n, others, to, {"m": lambda held: _narrow(m[held]), "places": lambda held: _narrow(at[held].ravel())})

    def add(of: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named, sizes, at, ns, ms, places, held = [], [], [], [], [], [], 0
        for batch in of:
            for i in range(len(batch)):
                row = {c: batch.column(c)[i].as_py() for c in ("owner", "size", "m", "places", "at", "n")}
                named.append(_names(row["owner"]))
                sizes.append(_wide(row["size"]).astype(np.int32))
                ms.append(_wide(row["m"]))
                places.append(_wide(row["places"]).astype(np.int32))
                at.append((_wide(row["at"]) + held).astype(np.int32))
                ns.append(_wide(row["n"]))
                held += len(ms[-1])
        if not held:
            return
        names = pa.concat_arrays(named).dictionary_encode()
        own = np.repeat(names.indices.to_numpy().astype(np.int32), np.concatenate(sizes))
        names, at, n, mb, place = names.dictionary, np.concatenate(at), np.concatenate(ns), np.concatenate(ms), np.concatenate(places).reshape(-1, nonzero)
        del named, sizes, ns, ms, places
        m = np.bincount(own, n, len(names)).astype(np.int64)
        some = (m[own] >= min_count) & (mb[at] >= min_count)
        own, at, n = own[some], at[some], n[some]
        order = _sorted(own)
        own, at, n = own[order], at[order], n[order]
        for lo in range(0, len(names), 8192):
            hi = min(lo + 8192, len(names))
            e = slice(*np.searchsorted(own, (lo, hi)))
            w = np.floor(1000 * np.log(n[e].astype(float) * total / (m[own[e]].astype(float) * mb[at[e]])))
            here = np.flatnonzero(w > 0)
            w, row, which = w[here], (own[e][here] - lo).astype(np.int64) * dimensions, place[at[e][here]]
            sums = np.zeros((hi - lo) * dimensions)
            for j in range(nonzero):
                sums += np.bincount(row + which[:, j] % dimensions, np.where(which[:, j] < dimensions, w, -w), len(sums))
            sums = sums.reshape(-1, dimensions)
            said = np.flatnonzero(sums.any(axis=1))
            edges = pa.array(np.arange(len(said) + 1) * dimensions, pa.int32())
            lists = pa.ListArray.from_arrays(edges, pa.array(sums[said].ravel()))
            yield pa.RecordBatch.from_arrays([names.take(pa.array(lo + said)).cast(pa.string()), pa.array(m[lo + said]), lists], names=["term", "m", "embedding"])

    known = _dealt_pairs(rows, text, window, 3, parts).mapInArrow(know, _KNOWN).repartitionById(parts, F.col("p"))
    return cut(known.mapInArrow(add, "term string, m bigint, embedding array<double>"), "term_vectors")


def expansions(vectors: DataFrame, asked: DataFrame, k: int = 5, floor: float = 0.2) -> DataFrame:
    """(term, hint, score, rank): for each of the terms asked (term) the k others whose vectors are nearest by cosine, at `floor` or more; of
    equals, the first by name. Unknown and null terms have none."""
    at = vectors.select(F.col("term").alias("id"), F.col("embedding").alias("v"))
    queries = at.join(asked.select(F.col("term").alias("id")).distinct(), "id", "left_semi")
    # one more, as a term is nearest to itself; where others are as near, it may come after them
    found = nearest(at, queries, k + 1, least=floor).where(F.col("query") != F.col("id"))
    return top_k(found.select(F.col("query").alias("term"), F.col("id").alias("hint"), "score"), ["term"], k, ["hint"])


def query_hints(vectors: DataFrame, queries: DataFrame, key: str, text: str, k: int = 10, per_term: int = 5, floor: float = 0.2) -> DataFrame:
    """(key, hint, score, n_terms, rank): for each query the k terms that its own terms call for, without those: the sum of their cosines, and of how
    many terms. A query whose terms are all unknown has no row."""
    term = cut(queries.select(key, F.explode(query_tokens(F.col(text))).alias("term")), "query_terms")
    near = expansions(vectors, term, per_term, floor).drop("rank")
    called = term.join(near, "term").groupBy(key, "hint").agg(F.round(F.sum("score"), 6).alias("score"), F.count("*").alias("n_terms"))
    return top_k(called.join(term.withColumnRenamed("term", "hint"), [key, "hint"], "left_anti"), [key], k, ["hint"])
