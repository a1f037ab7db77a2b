"""Summaries of the sentences that a text's other sentences resemble most."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.batches import best, lists, sized, token_codes
from docloom.functions.text import sentences
from docloom.functions.vectors import kinds


def centrality(text: np.ndarray, sentence: np.ndarray, term: np.ndarray, weigh_rare: bool, damping: float, rounds: int) -> np.ndarray:
    """The stationary share of each sentence of its text under a walk that goes to sentences of that text by their cosine. `text` names the text of
    each sentence, in order, `sentence` and `term` the sentence and the term of each token. Many texts are walked at once. Similarities are never
    made: a step multiplies by the matrix of sentences and terms and by its transpose, so it takes as much time and memory as there are tokens."""
    n, terms = len(text), int(term.max(initial=0)) + 1
    sizes = np.bincount(text)
    cells, count = np.unique(sentence * terms + term, return_counts=True)
    row = cells // terms
    _, column = np.unique(text[row] * terms + cells % terms, return_inverse=True)
    x = count.astype("float64")
    if weigh_rare:
        x *= 1 + np.log(sizes[text[row]] / np.bincount(column)[column])
    x /= np.sqrt(np.bincount(row, x * x, n))[row]
    alone = np.bincount(row, x * x, n)  # a sentence's likeness to itself

    def like(p: np.ndarray) -> np.ndarray:
        return np.bincount(row, x * np.bincount(column, x * p[row])[column], n) - alone * p

    degree = like(np.ones(n))
    linked = degree > 1e-12
    size = sizes[text]
    share = 1 / size
    for _ in range(rounds):
        go = np.where(linked, share / np.where(linked, degree, 1), 0)
        lost = np.bincount(text, np.where(linked, 0, share))[text] / size  # who resembles none goes anywhere
        share = (1 - damping) / size + damping * (like(go) + lost)
    return share


def central_sentences(docs: DataFrame, id: str = "doc_id", content: str = "content", n: int = 3, mode: str = "text_rank", damping: float = 0.85, rounds: int = 50) -> DataFrame:
    """(id, summary): the n most central sentences of each text, in its order, joined by blanks; of equals, the earlier. text_rank: sentences
    resemble each other by the cosine of their words; lex_rank: by that of words weighed by how few sentences hold them. A text of n sentences
    or fewer is its own summary; one without any, null too, has an empty one. Each text is summarised where it is read."""
    if mode not in ("text_rank", "lex_rank"):
        raise ValueError(f"no such mode: {mode}")

    def run(of: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized(of, "_said"):
            sizes, said = lists(batch.column("_said"))
            text = np.repeat(np.arange(len(batch)), sizes)
            share = np.zeros(len(text))
            long = np.flatnonzero(sizes[text] > n)
            if len(long):
                sentence, term, _ = token_codes(batch.column("_low").flatten().take(pa.array(long)))
                share[long] = np.round(centrality(np.unique(text[long], return_inverse=True)[1], sentence, term, mode == "lex_rank", damping, rounds), 9)
            chosen = np.sort(best(text, n, -share)[0])
            edges = np.concatenate(([0], np.cumsum(np.bincount(text[chosen], minlength=len(batch)))))
            summary = pc.binary_join(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), said.take(pa.array(chosen))), " ")
            yield pa.RecordBatch.from_arrays([batch.column("_id"), summary], names=["_id", "summary"])

    said = docs.select(F.col(id).alias("_id"), sentences(F.coalesce(F.col(content), F.lit(""))).alias("_said"))
    rows = said.select("_id", "_said", F.transform("_said", F.lower).alias("_low"))
    return rows.mapInArrow(run, f"{kinds(rows, ['_id'])}, summary string").withColumnRenamed("_id", id)
