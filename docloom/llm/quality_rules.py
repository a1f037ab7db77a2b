"""Quality rules: text statistics, and robust multivariate outliers among them.

Rows are judged per language and source (a cell). The minimum covariance determinant estimate of the transformed statistics is found by
concentration steps: of all rows of a group the ``core`` share with the least Mahalanobis distances, their mean and covariance, and so on.
There are three starts (medians and quartiles alone, the correlation of hyperbolic tangents, and that of spatial signs); after
two steps the one of the least determinant goes on to a fixed point, or for ``steps`` steps at most.

Estimates are made for each cell, each language and all rows. A cell's estimate leans on its language's, and that on the one of
all rows, with the weight of ``lean`` rows: every row is judged, and nothing changes suddenly with the size of a cell. Each
estimate's covariance is widened first, where the group's median distance is beyond that of a chi-squared variable. A row is
rejected if its distance is beyond the quantile ``certainty``.

Statistics are integers, in units of 2^-12; sums of them and of their products are exact, and order statistics come from counts
over steps of the distance (1/256 of an octave). So results don't depend on partitions or on the order of rows. Each step is two
aggregations over a written table of statistics, with a state of a few numbers per group.

Defined cases: a null or empty text has no words and fails the base rules; null languages and sources are values like others; rows
that repeat count each; further columns stay as they are (those of the result begin with ``q_``); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.llm.common import SPACES, Words, batches, cut, join_small, shingles, table

_COUNTS = ("q_words", "q_chars", "q_symbols", "q_dup_lines", "q_repeat_words", "q_lines", "q_distinct", "q_upper", "q_letters")


def text_statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """Counts of each text of a column."""
    w = Words(texts, SPACES, lower=False)
    n = len(w)

    def per_text(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[w.offsets])

    def per_word(values: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(values, dtype=np.int64)))[w.first])

    points = np.concatenate(([0], np.cumsum((w.data & 0xC0) != 0x80, dtype=np.int64)))
    is_symbol = np.zeros(256, bool)
    is_symbol[list(b"#*$%&|<>")] = True
    owner = np.repeat(np.arange(n), w.counts)
    windows, first = shingles(w)
    sizes = np.where(w.counts >= 5, np.diff(first), 0)
    windows = windows[np.repeat(w.counts >= 5, np.diff(first))]
    of = np.repeat(np.arange(n), sizes)
    at = w.first[:-1][of] + np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    _, inverse, times = np.unique(windows ^ (of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
    again = at[times[inverse] > 1]
    cover = np.zeros(len(w.start) + 6, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + 5, -1)
    # distinct words of each text: a word counts where it comes first among the sorted pairs of text and word
    order = np.lexsort((w.hashes, owner)) if n else np.zeros(0, np.int64)
    h, o = w.hashes[order], owner[order]
    fresh = np.concatenate(([True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])))[: len(h)]
    data = w.data.tobytes()
    lines, dup = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, (lo, hi) in enumerate(zip(w.offsets[:-1], w.offsets[1:], strict=True)):
        full = [x for x in data[lo:hi].split(b"\n") if x.strip()]
        lines[i], dup[i] = len(full), len(full) - len(set(full))
    upper = (w.data >= 65) & (w.data <= 90)
    return {
        "q_words": w.counts, "q_chars": per_word(points[w.end] - points[w.start]), "q_symbols": per_text(is_symbol[w.data]), "q_dup_lines": dup,
        "q_repeat_words": per_word(np.cumsum(cover)[: len(w.start)] > 0), "q_lines": lines, "q_distinct": np.bincount(o[fresh], minlength=n),
        "q_upper": per_text(upper), "q_letters": per_text(upper | (w.data >= 97) & (w.data <= 122) | ((w.data & 0xC0) == 0xC0)),
    }


def with_statistics(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns of docs (or those named in keep) and the counts, which replace columns of their names."""
    keep = [c for c in ([c for c in docs.columns if c != text] if keep is None else keep) if c not in _COUNTS]
    packed = docs.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)]).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(of: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in of:
            for batch in batches(whole, "text", 4 << 20):
                found = text_statistics(batch.column("text"))
                yield pa.RecordBatch.from_arrays([batch.column("row"), *[pa.array(found[c], pa.int64()) for c in _COUNTS]], names=["row", *_COUNTS])

    schema = packed.select("row", *[F.lit(0).cast("bigint").alias(c) for c in _COUNTS]).schema
    return packed.mapInArrow(run, schema).select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(keep)], *_COUNTS)


def _share(part: str, whole: str, more: float) -> Column:
    """Of a share of counts: the arc sine of its root, which spreads about alike for small shares and large ones. more: counted
    besides, so that a text of few words does not stand out by chance."""
    return F.asin(F.sqrt(F.least(F.col(part) / (F.col(whole) + more), F.lit(1.0))))


def vector() -> list[Column]:
    """The transformed statistics: word length, symbols, lines and passages that repeat, richness of words, capitals."""
    return [
        F.log((F.col("q_chars") + 250) / (F.col("q_words") + 50)),
        _share("q_symbols", "q_words", 50),
        _share("q_dup_lines", "q_lines", 10),
        _share("q_repeat_words", "q_words", 50),
        4 * F.log(F.col("q_distinct") + 20) / F.log(F.col("q_words") + 20),
        _share("q_upper", "q_letters", 50),
    ]


def chi_squared(p: float, d: int) -> float:
    """The quantile of a chi-squared variable, after Wilson and Hilferty."""
    return d * (1 - 2 / (9 * d) + NormalDist().inv_cdf(p) * (2 / (9 * d)) ** 0.5) ** 3


def _key(c: str) -> Column:
    return F.when(F.col(f"`{c}`").isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col(f"`{c}`").cast("string")))


UNIT = 1 << 12
_OCTAVE = 256


def _pairs(d: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(d) for j in range(i, d)]


def _state_schema(d: int) -> str:
    """Of each group and start: whether the last step changed it, covariance, the logarithm of its determinant, the center, and the weights
    of products of differences from it."""
    numbers = [f"c{i}" for i in range(d)] + [f"w{i}_{j}" for i, j in _pairs(d)]
    return "q_group string, q_start int, moves boolean, cov array<double>, det double, " + ", ".join(f"{x} double" for x in numbers)


def order_statistic(rows: DataFrame, by: list[str], value: Column, share: float) -> DataFrame:
    """(by, least): of each group, the least integer value that at least this share of its rows do not exceed. The rows of a
    group are counted by value first."""
    counts = rows.groupBy(*by, value.alias("v")).agg(F.count("*").alias("c"))
    group = W.partitionBy(*by)
    upto = F.sum("c").over(group.orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow))
    counts = counts.withColumn("upto", upto).withColumn("all", F.sum("c").over(group))
    return counts.where(F.col("upto") >= F.ceil(F.col("all") * share)).groupBy(*by).agg(F.min("v").alias("least"))


def moments(rows: DataFrame, by: list[str], v: list[Column]) -> DataFrame:
    """(by, n, sums, products) of integer columns; exact. The columns are named first, so that each is computed once a row."""
    d = len(v)
    rows = rows.select(*by, *[x.alias(f"v{i}") for i, x in enumerate(v)])
    sums = [F.sum(f"v{i}").alias(f"s{i}") for i in range(d)]
    products = [F.sum(F.col(f"v{i}") * F.col(f"v{j}")).alias(f"s{i}_{j}") for i, j in _pairs(d)]
    found = rows.groupBy(*by).agg(F.count("*").alias("n"), *sums, *products)
    listed = lambda names: F.array(*names)
    return found.select(*by, "n", listed([f"s{i}" for i in range(d)]).alias("sums"), listed([f"s{i}_{j}" for i, j in _pairs(d)]).alias("products"))


def _spread(n: int, sums: list[int], products: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance."""
    d = len(sums)
    mean, cov = np.array(sums, float) / n, np.zeros((d, d))
    cov[np.triu_indices(d)] = np.array(products, float) / n
    return mean, cov + np.triu(cov, 1).T - np.outer(mean, mean)


def _weights(cov: np.ndarray) -> list[float]:
    inverse = np.linalg.inv(cov)
    return (np.triu(inverse) + np.triu(inverse, 1))[np.triu_indices(len(cov))].tolist()


def _state(group: str, start: int, center: np.ndarray, cov: np.ndarray, was: float = np.inf) -> tuple:
    det = round(float(np.linalg.slogdet(cov)[1]), 9)
    return group, start, abs(det - was) > 1e-6, cov.ravel().tolist(), det, *center.tolist(), *_weights(cov)


def _steps(distance: Column) -> Column:
    return F.floor(F.log2(distance + F.lit(2.0**-20)) * _OCTAVE)


def distance(d: int) -> Column:
    """The squared Mahalanobis distance of x0, x1, ... from c0, c1, ..."""
    away = [F.col(f"x{i}") - F.col(f"c{i}") for i in range(d)]
    terms = [F.col(f"w{i}_{j}") * away[i] * away[j] for i, j in _pairs(d)]
    return sum(terms[1:], terms[0])


def _solved(d: int, make) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    names = [x.split()[0] for x in _state_schema(d).split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame([state for row in pdf.itertuples(index=False) for state in make(row)], columns=names)

    return run


def _starts(rows: DataFrame, groups: int, d: int, floor: float) -> DataFrame:
    """Three states of each group, from medians, quartiles and two robust correlations."""
    each = rows.select("q_group", F.posexplode(F.array(*[f"x{i}" for i in range(d)])).alias("i", "v"))
    counts = each.groupBy("q_group", "i", "v").agg(F.count("*").alias("c"))
    group = W.partitionBy("q_group", "i")
    upto = F.sum("c").over(group.orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow))
    counts = counts.withColumn("upto", upto).withColumn("all", F.sum("c").over(group))
    quartile = [F.min(F.when(F.col("upto") * 4 >= F.col("all") * q, F.col("v"))).alias(f"p{q}") for q in (1, 2, 3)]
    found = counts.groupBy("q_group", "i").agg(*quartile)
    width = F.greatest((F.col("p3") - F.col("p1")) / 1.349, F.lit(floor * UNIT))
    of = lambda c, i: F.max(F.when(F.col("i") == i, c))
    scaled = [of(F.col("p2"), i).alias(f"m{i}") for i in range(d)] + [of(width, i).alias(f"d{i}") for i in range(d)]
    scaled = cut(found.groupBy("q_group").agg(*scaled), "quartiles")
    rows = join_small(rows, scaled, ["q_group"], "inner", rows=groups)
    z = [(F.col(f"x{i}") - F.col(f"m{i}")) / F.col(f"d{i}") for i in range(d)]
    rows = rows.select("q_group", *[x.alias(f"z{i}") for i, x in enumerate(z)])
    z = [F.col(f"z{i}") for i in range(d)]
    rows = rows.withColumn("length", F.greatest(F.sqrt(sum((x * x for x in z[1:]), z[0] * z[0])), F.lit(1e-9)))
    whole = lambda v: F.round(v * UNIT).cast("bigint")
    tangents = moments(rows, ["q_group"], [whole(F.tanh(x)) for x in z])
    signs = moments(rows, ["q_group"], [whole(x / F.col("length")) for x in z])
    signs = signs.select("q_group", F.col("sums").alias("sums2"), F.col("products").alias("products2"))

    def make(row) -> Iterator[tuple]:
        center = np.array([getattr(row, f"m{i}") for i in range(d)], float)
        width = np.array([getattr(row, f"d{i}") for i in range(d)], float)
        yield _state(row.q_group, 0, center, np.diag(width**2))
        for start, sums, products in ((1, row.sums, row.products), (2, row.sums2, row.products2)):
            mean, cov = _spread(row.n, sums, products)
            cov = cov + np.eye(d) * (1e-3 * UNIT**2) + (np.outer(mean, mean) if start == 2 else 0)
            root = np.sqrt(np.diag(cov))
            yield _state(row.q_group, start, center, cov / np.outer(root, root) * np.outer(width, width))

    both = tangents.join(signs, "q_group").join(scaled, "q_group")
    return cut(both.mapInPandas(_solved(d, make), _state_schema(d)), "state")


def concentrate(rows: DataFrame, state: DataFrame, states: int, d: int, core: float, floor: float) -> DataFrame:
    """A step for each of so many groups and starts: the state of the rows with the least distances."""

    def make(row) -> Iterator[tuple]:
        mean, cov = _spread(row.n, row.sums, row.products)
        origin = np.array([getattr(row, f"c{i}") for i in range(d)]).round()
        yield _state(row.q_group, row.q_start, mean + origin, cov + np.eye(d) * (floor * UNIT) ** 2, row.det)

    key, centers = ["q_group", "q_start"], [f"c{i}" for i in range(d)]
    xs = [f"x{i}" for i in range(d)]
    far = join_small(rows, state.drop("moves", "cov", "det"), ["q_group"], "inner", rows=states)
    far = far.select(*key, *xs, *centers, _steps(distance(d)).alias("far"))
    limit = order_statistic(far.select(*key, "far"), key, F.col("far"), core)
    limit = limit if states <= 20_000 else cut(limit, "limits")  # a broadcast table is computed once
    near = join_small(far, limit, key, "inner", rows=states).where("far <= least")
    sums = moments(near, key, [F.col(f"x{i}") - F.round(f"c{i}").cast("bigint") for i in range(d)])
    return cut(sums.join(state.select(*key, *centers, "det"), key).mapInPandas(_solved(d, make), _state_schema(d)), "state")


def estimates(rows: DataFrame, groups: int, d: int, core: float, steps: int, floor: float) -> DataFrame:
    """The state of the least determinant of each group of rows (q_group, x0, x1, ...)."""
    state = _starts(rows, groups, d, floor)
    for _ in range(2):
        state = concentrate(rows, state, 3 * groups, d, core, floor)
    best = F.min_by(F.struct(*state.columns), F.struct("det", "q_start")).alias("x")
    state = cut(state.groupBy("q_group").agg(best).select("x.*"), "state")
    out, moving = state.where(~F.col("moves")), state.where("moves")
    for _ in range(steps):
        left = moving.count()
        if not left:
            break
        state = concentrate(rows, moving, left, d, core, floor)
        out, moving = out.unionByName(state.where(~F.col("moves"))), state.where("moves")
    return out.unionByName(moving)


def outliers(
    rows: DataFrame,
    by: tuple[str, str],
    x: list[Column],
    certainty: float = 0.999999,
    core: float = 0.75,
    lean: float = 50,
    steps: int = 12,
    floor: float = 0.08,
) -> DataFrame:
    """rows with q_distance and q_outlier, which replace columns of these names. floor: standard deviations count as that much more, so that a statistic which is
    the same for nearly all rows does not make outliers of the others by itself."""
    d = len(x)
    ints = [F.round(v * UNIT).cast("bigint").alias(f"q_x{i}") for i, v in enumerate(x)]
    big, small = _key(by[0]), _key(by[1])
    level = [F.concat_ws("\x1f", F.lit("c"), big, small), F.concat_ws("\x1f", F.lit("b"), big), F.lit("a")]
    columns = [F.col(f"`{c}`") for c in rows.columns if c not in ("q_distance", "q_outlier")]
    rows = cut(rows.select(F.struct(*columns).alias("q_row"), *ints, *[c.alias(f"q_{i}") for i, c in enumerate(level)]), "statistics")
    numbers = [F.col(f"q_x{i}").alias(f"x{i}") for i in range(d)]
    grouped = rows.select(F.explode(F.array("q_0", "q_1", "q_2")).alias("q_group"), *numbers)
    sizes = cut(grouped.groupBy("q_group").agg(F.count("*").alias("rows")), "groups")
    groups = sizes.count()
    found = cut(estimates(grouped, groups, d, core, steps, floor), "estimates")
    far = join_small(grouped, found.drop("q_start", "moves", "cov", "det"), ["q_group"], "inner", rows=groups)
    median = order_statistic(far.select("q_group", _steps(distance(d)).alias("far")), ["q_group"], F.col("far"), 0.5)
    # half the rows are within the end of this step
    scale = F.greatest(F.pow(F.lit(2.0), (F.col("least") + 1) / _OCTAVE) / chi_squared(0.5, d), F.lit(1.0))
    wide = F.transform("cov", lambda c: c * F.col("scale"))
    found = found.join(median.select("q_group", scale.alias("scale")), "q_group").join(sizes, "q_group")
    center = F.array(*[f"c{i}" for i in range(d)])
    found = cut(found.select("q_group", "rows", center.alias("center"), wide.alias("cov")), "widened")
    cells = rows.select("q_0", "q_1", "q_2").distinct()
    for i in range(3):
        own = found.select(F.col("q_group").alias(f"q_{i}"), *[F.col(c).alias(f"{c}_{i}") for c in ("rows", "center", "cov")])
        cells = join_small(cells, own, [f"q_{i}"], rows=groups)

    def leaned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for row in pdf.to_dict("records"):
                center, cov = np.array(row["center_2"]), np.array(row["cov_2"])
                for i in (1, 0):
                    own = row[f"rows_{i}"] / (row[f"rows_{i}"] + lean)
                    center = own * np.array(row[f"center_{i}"]) + (1 - own) * center
                    cov = own * np.array(row[f"cov_{i}"]) + (1 - own) * cov
                out.append((row["q_0"], *center.tolist(), *_weights(cov.reshape(d, d))))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])

    schema = ", ".join(["q_0 string", *[x for x in _state_schema(d).split(", ") if x[0] in "cw" and x.endswith("double")]])
    cells = cut(cells.mapInPandas(leaned, schema), "leaned")
    away = join_small(rows.select(F.col("q_row").alias("row"), "q_0", *numbers), cells, ["q_0"], rows=groups)
    away = away.select("row.*", F.sqrt(distance(d)).alias("q_distance"))
    return away.withColumn("q_outlier", F.col("q_distance") > chi_squared(certainty, d) ** 0.5)


def base_failed() -> Column:
    return (F.col("q_words") < 10) | (100 * F.col("q_repeat_words") > 20 * F.col("q_words"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_statistics(table(spark, sf_dir, "documents"), keep=["doc_id", "lang", "source"])
    judged = outliers(rows, ("lang", "source"), vector())
    return judged.select(
        "doc_id",
        F.col("q_words").alias("n_words"),
        F.col("q_chars").alias("word_chars"),
        F.col("q_symbols").alias("n_symbols"),
        F.col("q_dup_lines").alias("n_dup_lines"),
        F.col("q_repeat_words").alias("n_repeat_words"),
        base_failed().alias("base_failed"),
        (~base_failed() & ~F.col("q_outlier")).alias("kept"),
        F.col("q_distance").alias("distance"),
    )
