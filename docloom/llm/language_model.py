"""A hidden Markov language model.

Tokens are words, ASCII letters in lower case, and one end for each text. Each token belongs to a class: the ``own`` most
frequent have one each, all others one of ``shared`` by hash. Latent states emit classes; Baum-Welch counts are made for
each chunk of texts and added up by Spark. A text's likelihood is that of its classes, by the scaled forward recursion over the
whole text, times that of each token within its class: absolute discounting of the training counts, the rest
for the one token that stands for all unseen words.

Tokenised texts are written once, in chunks of about ``chunk`` tokens: each chunk's distinct hashes and the texts as codes into them,
byte by byte and compressed.
Word counts over the whole corpus are a shuffled aggregation; a chunk gets the counts of its own words through a join, so the
vocabulary is never broadcast or collected. Collected are: the frequent words (``own``), sums for each shared class, and model
parameters. Every round sees every training text, and every text from its first token to its last: forward variables are kept at the
borders of blocks of steps only, and each block's are made again on the way back, so memory is bound by the block, not by the text.

Words are told apart by 64-bit hashes. Defined cases: a null or empty text is the end token alone; a null id is not held out and its
text is learned from; rows that repeat count each; with no training text all tokens are unseen and classes equally likely; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import Words, batches, cut, hash_mod, table

#: The end of a text takes the place of a hash.
END = np.uint64(0x8000000000000001)
_CHUNK = "chunk bigint, words binary, codes binary, sizes binary, learn binary, train binary, ids array<{kind}>"
#: Texts side by side, tokens in a block of steps, and steps after which forward and backward variables are scaled.
_ROWS, _BLOCK, _EVERY = 512, 1 << 15, 8


def packed(x: np.ndarray) -> bytes:
    """How many integers, and their first bytes, second bytes and so on, compressed."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T)
    return np.int64(len(x)).tobytes() + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(value: pa.Scalar, kind: type) -> np.ndarray:
    data = memoryview(value.as_buffer())
    n, size = int(np.frombuffer(data[:8], np.int64)[0]), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data[8:], decompressed_size=n * size, codec="zstd"), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


class Chunk:
    """A row of the table of tokenised texts."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        self.batch, self.row = batch, row

    def __getattr__(self, name: str) -> np.ndarray:
        kind = {"words": np.uint64, "codes": np.uint32, "sizes": np.int64, "learn": bool, "train": np.int64}[name]
        out = unpacked(self.batch.column(name)[self.row], kind)
        out = np.cumsum(out, dtype=np.uint64) if name == "words" else out
        setattr(self, name, out)
        return out

    @property
    def first(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes


def _pack(hashes: list[np.ndarray], sizes: list[np.ndarray], learn: list, ids: list, kind: pa.DataType) -> pa.RecordBatch:
    words, codes, times = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
    # frequent words have the small codes, so that the high bytes are nearly all zero; those of a kind are in order
    order = np.argsort(-times, kind="stable")
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    words, codes = words[order], rank[codes]
    sizes, learned = np.concatenate(sizes).astype(np.int64), np.array(learn, bool)
    train = np.bincount(codes[np.repeat(learned, sizes)], minlength=len(words)).astype(np.int64)
    columns = {"words": np.diff(words, prepend=np.uint64(0)), "codes": codes, "sizes": sizes, "learn": learned, "train": train}
    arrays = [pa.array([packed(x)], pa.binary()) for x in columns.values()]
    arrays = [pa.array([0], pa.int64()), *arrays, pa.array([ids], pa.list_(kind))]
    return pa.RecordBatch.from_arrays(arrays, names=["chunk", *columns, "ids"])


def tokenised(docs: DataFrame, text: str, id: str, learn, chunk: int) -> DataFrame:
    """A row for each chunk: its words' hashes (differences), the tokens as codes into them, tokens of each text, whether it is learned
    from, how often each word occurs in texts learned from, and ids."""
    kind = docs.schema[id].dataType.simpleString()

    def run(of: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sizes, learned, ids, size = [], [], [], [], 0
        for whole in of:
            for batch in batches(whole, "text", 1 << 20):
                w = Words(batch.column("text"))
                # the end token follows each text's words
                hashes.append(np.insert(w.hashes, w.first[1:], END))
                sizes.append(w.counts + 1)
                learned += batch.column("learn").to_pylist()
                ids += batch.column("id").to_pylist()
                size += len(hashes[-1])
                if size >= chunk:
                    yield _pack(hashes, sizes, learned, ids, batch.column("id").type)
                    hashes, sizes, learned, ids, size = [], [], [], [], 0
        if ids:
            yield _pack(hashes, sizes, learned, ids, batch.column("id").type)

    text = F.col(f"`{text}`").cast("string").alias("text")
    rows = docs.select(F.col(f"`{id}`").alias("id"), F.coalesce(learn, F.lit(False)).alias("learn"), text)
    chunks = rows.mapInArrow(run, _CHUNK.format(kind=kind))
    return cut(chunks.withColumn("chunk", F.monotonically_increasing_id()), "tokens")


class Model:
    """States, and classes of words."""

    def __init__(self, frequent: np.ndarray, shared: int, states: int, prior: np.ndarray, seed: int = 3):
        self.order = np.argsort(frequent)
        self.frequent, self.shared = frequent[self.order], shared
        self.classes = len(frequent) + shared
        self.prior = prior  # of each class, from the training counts
        rng = np.random.default_rng(seed)
        self.start = np.full(states, 1 / states)
        self.move = np.full((states, states), 0.1 / states) + np.eye(states) * 0.9
        self.emit = prior[None, :] * rng.uniform(0.3, 1.7, (states, self.classes))
        self.move /= self.move.sum(1, keepdims=True)
        self.emit /= self.emit.sum(1, keepdims=True)

    def class_of(self, words: np.ndarray) -> np.ndarray:
        out = len(self.frequent) + ((words >> np.uint64(20)) % np.uint64(self.shared)).astype(np.int64)
        if len(self.frequent):
            at = np.searchsorted(self.frequent, words).clip(max=len(self.frequent) - 1)
            known = self.frequent[at] == words
            out[known] = self.order[at[known]]
        return out

    def update(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
        self.start = (start + 1) / (start.sum() + len(start))
        self.move = (move + 1) / (move.sum(1, keepdims=True) + len(move))
        # each state's emissions lean on the prior, the more the less it was seen
        lean = 200.0
        self.emit = (emit + lean * self.prior) / (emit.sum(1, keepdims=True) + lean)


class Lanes:
    """Texts side by side, longest first. At each step all texts that have as many tokens advance by one; steps are taken in blocks.

    Emissions count relative to the likeliest state's, so that variables need scaling only every few steps."""

    def __init__(self, model: Model, classes: np.ndarray, first: np.ndarray, sizes: np.ndarray):
        self.model, self.classes, self.first, self.sizes = model, classes, first, sizes
        self.best = model.emit.max(0)
        self.emit = np.ascontiguousarray((model.emit / self.best).T)
        k = len(model.start)
        self.one, self.room = np.ones(k), np.empty((3, _BLOCK + _ROWS, k))
        order = np.argsort(-sizes, kind="stable")
        self.groups = [order[lo : lo + _ROWS] for lo in range(0, len(order), _ROWS)]

    def enter(self, texts: np.ndarray) -> list[tuple[int, int]]:
        """Steps of each block of these texts."""
        size = self.sizes[texts]
        self.at, steps = self.first[texts], int(size[0])
        self.n = np.searchsorted(-size, -np.arange(steps), side="left")  # texts with more than t tokens come first
        edge, cuts = np.cumsum(self.n), [0]
        while cuts[-1] < steps:
            done = edge[cuts[-1] - 1] if cuts[-1] else 0
            cuts.append(max(cuts[-1] + 1, int(np.searchsorted(edge, done + _BLOCK, side="right"))))
        return list(zip(cuts, cuts[1:], strict=False))

    def block(self, lo: int, hi: int) -> None:
        """seen: the class of each token of the steps; step j's begin at begin[j] and are width[j]; behind: how far back a text's last is."""
        width = self.n[lo:hi]
        begin = np.cumsum(width) - width
        lane = np.arange(width.sum()) - np.repeat(begin, width)
        self.seen = np.take(self.classes, np.take(self.at, lane) + np.repeat(np.arange(lo, hi), width))
        self.behind = np.repeat(np.concatenate(([0], self.n))[lo:hi], width)
        self.lo, self.begin, self.width = lo, begin.tolist(), width.tolist()

    def emissions(self) -> np.ndarray:
        return np.take(self.emit, self.seen, axis=0, out=self.room[0, : len(self.seen)], mode="clip")

    def forward(self, a: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Forward variables of all tokens of the block and what they were divided by; a: those of the step before it."""
        e, out, scale = self.emissions(), self.room[1, : len(self.seen)], np.ones(len(self.seen))
        for t, (o, n) in enumerate(zip(self.begin, self.width, strict=True), self.lo):
            row = out[o : o + n]
            if a is None:
                row[:] = self.model.start
            else:
                np.matmul(a[:n], self.model.move, out=row)
            row *= e[o : o + n]
            if t % _EVERY == 0:
                s = row @ self.one
                row /= s[:, None]
                scale[o : o + n] = s
            a = row
        return out, scale


def forward(model: Model, classes: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The log10 likelihood of each text's classes, by the scaled forward recursion over the whole text."""
    lanes = Lanes(model, classes, first, sizes)
    best = np.log10(lanes.best)
    out = np.add.reduceat(best[classes], first) if len(sizes) else np.zeros(0)
    for texts in lanes.groups:
        log, a = np.zeros(len(texts)), None
        for lo, hi in lanes.enter(texts):
            lanes.block(lo, hi)
            alpha, scale = lanes.forward(a)
            own = np.flatnonzero(scale != 1)
            log += np.bincount(own - np.repeat(lanes.begin, lanes.width)[own], np.log10(scale[own]), minlength=len(texts))
            # a text that ends here has its likelihood in what its last variables sum up to
            for j, (o, n) in enumerate(zip(lanes.begin, lanes.width, strict=True)):
                rest = lanes.n[lo + j + 1] if lo + j + 1 < len(lanes.n) else 0
                if rest < n:
                    log[rest:n] += np.log10(alpha[o + rest : o + n] @ lanes.one)
            a = alpha[lanes.begin[-1] :].copy()
        out[texts] += log
    return out


def expected_counts(model: Model, classes: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch counts of starts, moves and emissions."""
    k = len(model.start)
    start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros((k, model.classes))
    lanes, back = Lanes(model, classes, first, sizes), np.ascontiguousarray(model.move.T)
    for texts in lanes.groups:
        blocks, before = lanes.enter(texts), [None]
        for lo, hi in blocks[:-1]:
            lanes.block(lo, hi)
            before.append(lanes.forward(before[-1])[0][lanes.begin[-1] :].copy())
        beta = None
        for (lo, hi), a in zip(reversed(blocks), reversed(before), strict=True):
            lanes.block(lo, hi)
            alpha, scale = lanes.forward(a)
            begin, width, size = lanes.begin, lanes.width, len(lanes.seen)
            ahead, betas = lanes.emissions(), lanes.room[2, :size]
            betas[begin[-1] :] = 1
            if beta is not None:
                betas[begin[-1] : begin[-1] + len(beta)] = beta
            for j in range(len(width) - 1, -1, -1):
                o, n = begin[j], width[j]
                row = ahead[o : o + n]
                row *= betas[o : o + n]
                if j:
                    p = begin[j - 1]
                    beta = np.matmul(row, back, out=betas[p : p + n])
                    betas[p + n : o] = 1  # texts that end a step before
                else:
                    beta = row @ back
                if not j or (lo + j) % _EVERY == 0:
                    beta /= (beta @ lanes.one)[:, None]
            betas *= alpha
            z = betas @ lanes.one
            betas /= z[:, None]  # chances of the states
            for j in range(k):
                emit[j] += np.bincount(lanes.seen, betas[:, j], minlength=model.classes)
            ahead /= (z * scale)[:, None]
            n = width[0]
            if a is None:
                start += betas[:n].sum(0)
            else:
                move += a[:n].T @ ahead[:n]
            if size > n:
                last = np.take(alpha, np.arange(n, size) - lanes.behind[n:], axis=0, out=betas[n:], mode="clip")
                move += last.T @ ahead[n:]
    return start, move * model.move, emit


def learn_states(chunks: DataFrame, model: Model, rounds: int) -> None:
    """Baum-Welch, each round over all texts that are learned from; where there are none the model stays as it is."""
    context = chunks.sparkSession.sparkContext
    k, c = len(model.start), model.classes
    for _ in range(rounds):
        shared = context.broadcast(model)

        def count(of: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            model, total = shared.value, np.zeros(k + k * k + k * c)
            for batch in of:
                for row in range(len(batch)):
                    x = Chunk(batch, row)
                    classes = model.class_of(x.words)[x.codes]
                    found = expected_counts(model, classes, x.first[x.learn], x.sizes[x.learn])
                    total += np.concatenate([y.ravel() for y in found])
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["at", "x"])

        counted = chunks.select("words", "codes", "sizes", "learn").mapInArrow(count, "at bigint, x double")
        sums = counted.groupBy("at").agg(F.sum("x").alias("x")).toPandas()
        shared.destroy()
        if sums.empty:
            return
        flat = np.zeros(k + k * k + k * c)
        flat[sums["at"]] = sums["x"]
        model.update(flat[:k], flat[k : k + k * k].reshape(k, k), flat[k + k * k :].reshape(k, c))


def score(
    docs: DataFrame,
    learn,
    text: str = "text",
    id: str = "doc_id",
    own: int = 8192,
    shared: int = 512,
    states: int = 8,
    rounds: int = 5,
    chunk: int = 600_000,
) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of each text; learn: a condition on docs."""
    spark = docs.sparkSession
    kind = docs.schema[id].dataType.simpleString()
    chunks = tokenised(docs, text, id, learn, chunk)

    def words(of: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in of:
            for row in range(len(batch)):
                x, number = Chunk(batch, row), batch.column("chunk")[row].as_py()
                h, n, code = x.words.view(np.int64), x.train, np.arange(len(x.words), dtype=np.int32)
                for lo in range(0, len(h), 1 << 16):
                    part = slice(lo, lo + (1 << 16))
                    arrays = [np.full(len(h[part]), number), code[part], h[part], n[part]]
                    yield pa.RecordBatch.from_arrays([pa.array(y) for y in arrays], names=["chunk", "code", "h", "n"])

    asked = chunks.select("chunk", "words", "train").mapInArrow(words, "chunk bigint, code int, h bigint, n bigint")
    counts = cut(asked.where("n > 0").groupBy("h").agg(F.sum("n").alias("n")), "counts")
    top = counts.orderBy(F.desc("n"), "h").limit(own).toPandas()
    frequent = top["h"].to_numpy(np.int64).view(np.uint64)
    # what each shared class holds: tokens, words, words seen once and twice
    in_class = F.pmod(F.shiftrightunsigned("h", 20), F.lit(shared))
    named = spark.createDataFrame(top[["h"]].assign(own=np.arange(len(top))), "h bigint, own int")
    times = lambda n: F.sum((F.col("n") == n).cast("int"))
    rare = counts.join(F.broadcast(named), "h", "left_anti").groupBy(in_class.alias("c"))
    sums = rare.agg(F.sum("n").alias("t"), F.count("*").alias("v"), times(1).alias("once"), times(2).alias("twice")).toPandas()
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n_train, n_words = int(total["n"] or 0), int(total["v"])
    tail = np.zeros((shared, 4))
    tail[sums["c"].to_numpy(int)] = sums[["t", "v", "once", "twice"]].to_numpy(float)
    prior = np.concatenate((top["n"].to_numpy(float), tail[:, 0])) + 1
    model = Model(frequent, shared, states, prior / prior.sum())
    learn_states(chunks, model, rounds)
    discount = ((tail[:, 2] + 0.5) / (tail[:, 2] + 2 * tail[:, 3] + 1)).clip(0.1, 0.9)
    inner = spark.sparkContext.broadcast((model, tail, discount, n_train, n_words))
    # class and count of each word of each chunk; what is not in counts is not frequent
    tell = F.coalesce("own", len(frequent) + in_class).cast("int")
    known = counts.join(F.broadcast(named), "h", "left")
    answered = asked.select("chunk", "code", "h").join(known, "h", "left")
    answered = answered.select("chunk", "code", tell.alias("class"), F.coalesce("n", F.lit(0)).alias("n"))

    def scored(key: tuple, chunk: pa.Table, known: pa.Table) -> pa.Table:
        model, tail, discount, n_train, n_words = inner.value
        out = {"id": [], "n_tokens": [], "n_known": [], "base_score": [], "score": []}
        classes, seen = np.zeros(known.num_rows, np.int32), np.zeros(known.num_rows)
        classes[known.column("code")], seen[known.column("code")] = known.column("class"), known.column("n")
        for batch in chunk.to_batches():
            for row in range(len(batch)):
                x = Chunk(batch, row)
                base = np.log10((seen + 1) / (n_train + n_words + 1))
                within = np.zeros(len(seen))
                c = classes - len(model.frequent)
                rare = c >= 0
                c = c[rare]
                t, v, d, s = tail[c, 0], tail[c, 1], discount[c], seen[rare]
                within[rare] = np.log10(np.where(t > 0, np.where(s > 0, s - d, d * v) / np.maximum(t, 1), 1.0))
                codes, first = x.codes, x.first
                add = lambda y, codes=codes, first=first: np.add.reduceat(y[codes], first)
                out["id"].append(batch.column("ids").slice(row, 1).flatten())
                out["n_tokens"].append(x.sizes)
                out["n_known"].append(add((seen > 0).astype(np.int64)))
                out["base_score"].append(add(base))
                out["score"].append(forward(model, classes[codes], first, x.sizes) + add(within))
        rest = {c: pa.array(np.concatenate(out[c])) for c in list(out)[1:]}
        return pa.table({"id": pa.chunked_array(out["id"]), **rest})

    texts = chunks.select("chunk", "codes", "sizes", "ids").groupBy("chunk")
    schema = f"id {kind}, n_tokens bigint, n_known bigint, base_score double, score double"
    rows = texts.cogroup(answered.groupBy("chunk")).applyInArrow(scored, schema)
    trained = F.lit(n_train).cast("bigint").alias("train_tokens")
    return rows.select(F.col("id").alias(id), "n_tokens", "n_known", trained, "base_score", "score")


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(hash_mod("doc_id", 7) == 2, F.lit(False))
    out = score(table(spark, sf_dir, "documents"), ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
