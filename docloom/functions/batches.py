"""Tokens and sentences of Arrow batches, without a Python object for each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from docloom.functions.text import FILLER_WORDS

_INSIDE = np.zeros(256, bool)
_INSIDE[[*b"0123456789abcdefghijklmnopqrstuvwxyz"]] = True


def token_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(text, code, names): the tokens of texts in lower case, as functions.text.tokens finds them: which text each is of, and which name it has.
    Names are in order. Null is an empty text."""
    texts = texts.cast(pa.large_string())
    texts = texts.fill_null("") if texts.null_count else texts
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    if offsets[0] == offsets[-1]:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], pa.large_string())
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    inside = _INSIDE[data]
    hyphen = np.flatnonzero(data[1:-1] == ord("-")) + 1
    inside[hyphen[inside[hyphen - 1] & inside[hyphen + 1] & ~border[hyphen] & ~border[hyphen + 1]]] = True
    first = np.flatnonzero(inside & (border[:-1] | np.concatenate(([True], ~inside[:-1]))))
    last = np.flatnonzero(inside & (border[1:] | np.concatenate((~inside[1:], [True]))))
    ends = np.concatenate(([0], np.cumsum(last - first + 1)))
    coded = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(ends), pa.py_buffer(data[inside])).dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    place = np.zeros(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    return np.searchsorted(offsets, first, side="right") - 1, place[coded.indices.to_numpy()], coded.dictionary.take(order)


def telling(names: pa.Array, min_chars: int) -> np.ndarray:
    """Which names have so many characters and are no filler words."""
    return pc.and_(pc.greater_equal(pc.utf8_length(names), min_chars), pc.invert(pc.is_in(names, pa.array(FILLER_WORDS, names.type)))).to_numpy(zero_copy_only=False)


def best(group: np.ndarray, k: int, *by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, place): the k first of each group in the order of `by`, by group, and their places from 0."""
    order = np.lexsort((*reversed(by), group))
    at = group[order]
    place = np.arange(len(at)) - np.searchsorted(at, at)
    return order[place < k], place[place < k]


def lists(of: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many elements each list has, null none, and all elements."""
    return pc.list_value_length(of).fill_null(0).to_numpy().astype(np.int64), of.flatten()


def sized(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of batches with about so many bytes in a column of texts or of lists of texts, one row at least."""
    for batch in batches:
        of = batch.column(column)
        if pa.types.is_list(of.type) or pa.types.is_large_list(of.type):
            n, each = lists(of)
            size = np.concatenate(([0], np.cumsum(pc.binary_length(each).fill_null(0).to_numpy().astype(np.int64))))[np.concatenate(([0], np.cumsum(n)))]
        else:
            size = np.concatenate(([0], np.cumsum(pc.binary_length(of).fill_null(0).to_numpy().astype(np.int64))))
        lo = 0
        while lo < len(batch):
            hi = max(int(np.searchsorted(size, size[lo] + most, side="right")) - 1, lo + 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


def filled(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20, rows: int = 40_000) -> Iterator[pa.RecordBatch]:
    """The rows of batches in as few as have about so many bytes in a column of texts and so many rows at most, where these allow: what is told of each
    distinct token is told less often."""
    waiting, held, size = [], 0, 0
    for batch in sized(batches, column, most):
        n = batch.column(column).nbytes
        if waiting and (size + n > most or held + len(batch) > rows):
            yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            waiting, held, size = [], 0, 0
        waiting.append(batch)
        held, size = held + len(batch), size + n
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]


def strings(names: pa.Array) -> list[str]:
    """As to_pylist, many times faster."""
    return names.to_numpy(zero_copy_only=False).tolist()
