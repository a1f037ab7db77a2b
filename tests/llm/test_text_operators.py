"""Operators on texts against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and further columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.llm import decontaminate, langid, language_model, near_duplicates, quality_classifier, quality_rules
from docloom.llm.common import FOLDED_SEPARATORS, SPACES, Words, join_small, shingles

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
BLANK = r"[^\x20\x09-\x0D]+"
FOLDED = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ODD = [None, "", " \n\t", "a", "A a a  b", "Über über", "x" * 5000, "one two three four five six seven eight nine ten eleven", "\U0001f600 smile \U0001f600"]


def table(spark, rows, columns="doc_id bigint, text string"):
    return spark.createDataFrame(rows, columns)


@pytest.mark.parametrize("separators,pattern", [(SPACES, BLANK), (FOLDED_SEPARATORS, FOLDED)])
def test_words_are_those_of_the_pattern(separators, pattern):
    w = Words(pa.array(ODD), separators)
    for i, text in enumerate(ODD):
        expected = re.findall(pattern, (text or "").translate(LOWER))
        found = [w.data[s:e].tobytes().decode().translate(LOWER) for s, e in zip(w.start[w.first[i] : w.first[i + 1]], w.end[w.first[i] : w.first[i + 1]], strict=True)]
        assert found == expected
    assert len(Words(pa.array([], pa.string()))) == 0


def test_hashes_tell_words_apart():
    words = [f"{a}{b}" for a in "abcdef" for b in range(500)] + ["ab", "ba", "a", "aa"]
    w = Words(pa.array([" ".join(words)]))
    assert len(set(w.hashes.tolist())) == len(set(words))
    again = Words(pa.array(["zz " + words[-1].upper(), words[7]]))
    assert again.hashes[1] == w.hashes[-1] and again.hashes[2] == w.hashes[7]


def test_shingles_of_short_and_long_texts():
    hashes, first = shingles(Words(pa.array(["a b c", None, "a b c d e f", "A B C"])))
    assert np.diff(first).tolist() == [1, 0, 2, 1] and hashes[0] == hashes[-1]


def test_join_small_both_ways(spark):
    left = table(spark, [(1, "a"), (2, None), (3, "z")])
    right = table(spark, [("a", 1), (None, 2)], "text string, n int")
    for most in (100, 0):
        assert sorted((r["doc_id"], r["n"] or 0) for r in join_small(left, right, ["text"], max_rows=most).collect()) == [(1, 1), (2, 2), (3, 0)]


def contamination(docs, items, window):
    grams = collections.defaultdict(set)
    for item, text in items:
        w = re.findall(FOLDED, (text or "").translate(LOWER))
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            grams[tuple(w[i : i + n])].add(str(item))
    out = []
    for _, text in docs:
        w, hit, names = re.findall(FOLDED, (text or "").translate(LOWER)), set(), set()
        for g, found in grams.items():
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i : i + len(g)]) == g:
                    hit |= set(range(i, i + len(g)))
                    names |= found
        out.append((len(w), len(hit), sorted(names)))
    return out


@pytest.mark.parametrize("most", [1_000_000, 12, 3])
def test_contamination_is_that_of_brute_force(spark, most, monkeypatch):
    monkeypatch.setattr(decontaminate, "_PIECE", 16)
    rng = random.Random(3)
    words = ["aa", "b", "Cc", "été", "d9"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.randint(1, 9))) for i in range(12)] + [(12, None), (13, ""), (3, "aa b")]
    docs = [(i, text(rng.randint(0, 60))) for i in range(25)] + list(enumerate(ODD)) + [(99, items[0][1] + ", " + items[1][1])]
    rows = [(n, i, t) for n, (i, t) in enumerate(docs)]
    found = decontaminate.find_contamination(table(spark, rows, "n int, doc_id bigint, text string"), table(spark, items, "item_id bigint, text string"), window=4, max_block_words=most).collect()
    found.sort(key=lambda r: r["n"])
    expected = contamination(docs, items, 4)
    for row, (_, text), (n, hit, names) in zip(found, docs, expected, strict=True):
        assert (row["hit_n_words"], sum(x["last"] - x["first"] for x in row["hit_spans"]), list(row["hit_items"])) == (n, hit, names)
        words = re.findall(FOLDED, (text or "").translate(LOWER))
        for x in row["hit_spans"]:
            assert re.findall(FOLDED, text[x["start"] : x["end"]].translate(LOWER)) == words[x["first"] : x["last"]]


def test_decontaminate_cuts_and_drops(spark):
    passage = " ".join(f"p{i}" for i in range(12))
    docs = spark.createDataFrame([(1, "Before. " + passage + " after that comes more text of its own, and so on and on and on.", "x"), (2, passage, "x"), (3, None, None)], "doc_id bigint, text string, hit string")
    items = table(spark, [(1, passage)], "item_id bigint, text string")
    out = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(docs, items, max_span_words=10).collect()}
    assert out == {1: "Before.  after that comes more text of its own, and so on and on and on.", 3: None}
    assert decontaminate.decontaminate(docs, items.limit(0)).count() == 3
    assert decontaminate.decontaminate(docs.limit(0), items).count() == 0


@pytest.mark.parametrize("most,expected", [(10, {1: "Before.  Then more, p0 p1 p2 p3, and so on in other words than those.", 2: "Here  goes the text on and on.", 3: ""}), (13, {1: "Before.  Then more, p0 p1 p2 p3, and so on in other words than those.", 2: "Here l0 l1 l2 l3 l4 l5 l6 l7 l8 l9 goes the text on and on.", 3: ""})])
def test_decontaminate_cuts_short_items(spark, most, expected):
    short, long = "P0 p1, p2 p3 É4", " ".join(f"l{i}" for i in range(20))
    docs = table(spark, [(1, f"Before. {short} Then more, p0 p1 p2 p3, and so on in other words than those."), (2, "Here " + " ".join(f"l{i}" for i in range(10)) + " goes the text on and on."), (3, ""), (4, short)])
    items = table(spark, [(1, short), (2, long), (3, None), (4, "!")], "item_id bigint, text string")
    out = decontaminate.decontaminate(docs, items, max_span_words=most, max_coverage=0.7)
    assert out.columns == docs.columns and {r["doc_id"]: r["text"] for r in out.collect()} == expected


def test_languages(spark):
    rng = random.Random(1)
    text = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(30))
    rows = [(i, text("abcde" if i % 2 else "vwxyz"), "l1" if i % 2 else "l2") for i in range(60)] + [(100, None, "l1"), (101, "123 !", "l2"), (102, "abc", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    profiles = langid.Profiles(256)
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs.drop("lang"), langid.prototypes(docs.where("doc_id < 40"), profiles), profiles).collect()}
    assert all(found[i][0] == ("l1" if i % 2 else "l2") for i in range(40, 60)) and found[100] == ("und", 0.0) and found[101] == ("und", 0.0)
    nothing = langid.identify(docs.drop("lang"), langid.prototypes(docs.limit(0), profiles), profiles)
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"}


def test_languages_are_those_of_brute_force(spark):
    """A vector for each n-gram, added up one at a time."""
    profiles, rng = langid.Profiles(128), random.Random(2)
    letters = [("abcdé", "l1"), ("defgü", "l2"), ("xyz日", "l3")]
    docs = [(i, " ".join("".join(rng.choice(letters[i % 3][0]) for _ in range(4)) for _ in range(8)), letters[i % 3][1]) for i in range(30)]
    docs += [(30, docs[0][1], "l1"), (31, None, "l1"), (None, "abc", "l1"), (33, "12", "l2"), (34, "zz", None)]

    vector = lambda point: profiles.letters(np.array([point]))[0].astype(int)

    def bundle(text):
        code = [ord(c) if c.isalpha() else 0 for c in " " + text.lower() + " "]
        code = [c for c, before in zip(code, [1, *code], strict=False) if c or before]
        out = np.zeros(128)
        for a, b, c in zip(code, code[1:], code[2:], strict=False):
            out += np.roll(vector(a), 2) * np.roll(vector(b), 1) * vector(c)
        return out

    sums = collections.defaultdict(lambda: np.zeros(128))
    for _, text, name in docs:
        if text and name and re.search(r"[^\W\d_]", text):
            sums[name] += bundle(text)
    df = spark.createDataFrame([(*d, "mine") for d in docs], "doc_id bigint, text string, lang string, score string")
    found = langid.identify(df.drop("lang"), langid.prototypes(df, profiles), profiles)
    assert found.columns == ["doc_id", "lang_pred", "score"]
    by = {r["doc_id"]: r for r in found.collect()}
    for i, text, _ in docs:
        if not text or not re.search(r"[^\W\d_]", text):
            assert (by[i]["lang_pred"], by[i]["score"]) == ("und", 0.0)
            continue
        v = bundle(text)
        cosine = {n: float(v @ p / np.linalg.norm(v) / np.linalg.norm(p)) for n, p in sums.items()}
        assert by[i]["lang_pred"] == max(sorted(cosine), key=cosine.get) and by[i]["score"] == pytest.approx(max(0, max(cosine.values())), abs=1e-5)


def test_languages_in_blocks_and_ties(spark):
    rng = random.Random(4)
    words = {f"l{i:02}": ["".join(rng.choice("abcdefghijklmnop日本語éü") for _ in range(5)) for _ in range(6)] for i in range(9)}
    rows = [(" ".join(rng.choices(w, k=20)), name) for name, w in words.items() for _ in range(4)]
    rows += [(t, "l99") for t, name in rows if name == "l03"]  # the same texts under a later name
    df, profiles = spark.createDataFrame(rows, "text string, lang string"), langid.Profiles(256)
    bundles = langid.prototypes(df, profiles)
    whole, blocks = (sorted(map(tuple, langid.identify(df, bundles, profiles, block=b).collect())) for b in (500, 2))
    assert [r[:2] for r in whole] == [r[:2] for r in blocks] and np.allclose([r[2] for r in whole], [r[2] for r in blocks], atol=2e-6) and all(said == min(name, "l03") if name == "l99" else said == name for name, said, _ in whole)


def test_letters_have_vectors_of_their_own():
    points = np.array([ord(c) for c in "abzéя日本語한ع"])
    vectors = langid.Profiles(1024).letters(points).astype(int)
    likeness = vectors @ vectors.T / 1024
    assert np.abs(likeness - np.eye(len(points))).max() < 0.15 and set(np.unique(vectors)) == {-1, 1}


def test_bound_ngrams_of_wide_alphabets_are_those_of_narrow_slices(monkeypatch):
    profiles = langid.Profiles(64)
    grams, owners = profiles.grams(pa.array(["hello world", "你好"]))
    whole = profiles.vectors(grams, owners, 2)
    monkeypatch.setattr(langid, "_WIDTH", 3)
    assert np.array_equal(whole, profiles.vectors(grams, owners, 2))


def jaccard_classes(docs, n, threshold):
    sets = {}
    for i, text in docs:
        w = re.findall(BLANK, (text or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))} if w else set()
    ids, links, root = list(sets), collections.Counter(), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a != b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (find(i), links[i]) for i in ids}


@pytest.mark.parametrize("block", [1024, 7])
def test_near_duplicates_are_those_of_brute_force(spark, block):
    rng = random.Random(5)
    docs = []
    for _ in range(12):
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = "changed"
            docs.append((len(docs), " ".join(copy)))
    docs += [(len(docs) + i, t) for i, t in enumerate([None, "", "same text", "Same  text", "x"])]
    expected = jaccard_classes(docs, 5, 0.8)
    rows = near_duplicates.near_duplicates(spark.createDataFrame([(*d, "n") for d in docs], "doc_id bigint, text string, node string"), block=block).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in rows} == expected


def test_near_duplicates_of_nothing_and_of_repeats(spark):
    docs = table(spark, [(1, "a b c"), (1, "a b c"), (None, "a b c"), (None, None)])
    rows = sorted((r["doc_id"] or 0, r["class_id"] or 0, r["n_links"]) for r in near_duplicates.near_duplicates(docs).collect())
    assert rows == [(0, 0, 0), (0, 1, 2), (1, 1, 2), (1, 1, 2)]
    assert near_duplicates.near_duplicates(docs.limit(0)).count() == 0


def test_bands():
    bands, rows = near_duplicates.choose_bands(0.8, 0.9999, 128)
    assert bands * rows <= 128 and 1 - (1 - 0.8**rows) ** bands >= 0.9999
    assert near_duplicates.choose_bands(0.8, 0.9, 128)[1] > rows


def test_statistics_are_those_of_brute_force():
    rng = random.Random(2)
    docs = ODD + ["\n".join(" ".join(rng.choice(["a", "B#", "c", "d$$"]) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 9))) for _ in range(40)]
    found = quality_rules.text_statistics(pa.array(docs))
    for i, text in enumerate(docs):
        text = text or ""
        w = re.findall(BLANK, text)
        lines = [x for x in text.split("\n") if re.search(BLANK, x)]
        times = collections.Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        again = {k for j in range(len(w) - 4) if times[tuple(w[j : j + 5])] > 1 for k in range(j, j + 5)}
        expected = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), len(set(w)))
        assert tuple(int(found[c][i]) for c in ("q_words", "q_chars", "q_symbols", "q_dup_lines", "q_repeat_words", "q_distinct")) == expected


def outlier_rows(rng):
    rows = [("en", "s", float(a), float(a + b)) for a, b in rng.normal(size=(400, 2))]
    rows += [("en", "s", 0.0, 40.0), ("en", "s", -30.0, 30.0), (None, None, 0.0, 0.0), ("de", "t", 90.0, 0.0)]
    return rows + [("en", f"s{i}", float(a), float(a + b)) for i, (a, b) in enumerate(rng.normal(size=(20, 2)))] + [("en", "s1", 50.0, -50.0)]


def test_outliers(spark):
    rows = outlier_rows(np.random.default_rng(1))
    df = spark.createDataFrame([(*r, "x") for r in rows], "lang string, source string, a double, b double, q_text string")
    judge = lambda df: quality_rules.outliers(df, ("lang", "source"), [F.col("a"), F.col("b")])
    out = judge(df.repartition(1)).collect()
    assert len(out) == len(rows) and {r["q_text"] for r in out} == {"x"}
    # rows of cells of one or two rows are judged by what is known of their language and of all rows
    assert {(r["a"], r["b"]) for r in out if r["q_outlier"]} == {(0.0, 40.0), (-30.0, 30.0), (90.0, 0.0), (50.0, -50.0)}
    key = lambda rows: sorted((str(r["lang"]), str(r["source"]), r["a"], r["b"], r["q_distance"]) for r in rows)
    assert key(out) == key(judge(df.repartition(23)).collect())
    assert judge(df.limit(0)).count() == 0


def test_estimates_have_the_least_determinant(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate((rng.normal(size=(150, 2)) @ [[1, 0.8], [0, 0.4]], rng.normal(size=(45, 2)) * 0.3 + [6, -5]))
    ints = np.round(x * quality_rules.UNIT).astype(int)
    df = spark.createDataFrame([("g", int(a), int(b)) for a, b in ints], "q_group string, x0 bigint, x1 bigint")
    found = quality_rules.estimates(df, 1, 2, 0.75, 20, 0.0).first()
    h, best = int(np.ceil(0.75 * len(x))), np.inf
    for _ in range(200):  # concentration from random pairs of three
        near = rng.choice(len(x), 3, replace=False)
        for _ in range(30):
            mean, cov = ints[near].mean(0), np.cov(ints[near].T, bias=True) + np.eye(2)
            away = ints - mean
            near = np.argsort(np.einsum("ij,jk,ik->i", away, np.linalg.inv(cov), away), kind="stable")[:h]
        best = min(best, np.linalg.slogdet(np.cov(ints[near].T, bias=True))[1])
    assert abs(found["det"] - best) < 0.05 and not found["moves"]
    assert np.abs(np.array([found["c0"], found["c1"]]) / quality_rules.UNIT).max() < 0.4


def test_quantiles_of_chi_squared():
    assert quality_rules.chi_squared(0.95, 6) == pytest.approx(12.59, rel=0.01)


def test_expectation_maximisation_finds_accuracies():
    rng = np.random.default_rng(4)
    truth = rng.random(20000) < 0.8
    rates = [0.9, 0.75, 0.85, 0.6]
    votes = np.stack([np.where(rng.random(20000) < r, truth, ~truth) for r in rates], axis=1).astype(np.int8)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    post, found, share = quality_classifier.expectation_maximisation(patterns, counts.astype(float))
    assert share == pytest.approx(0.8, abs=0.05)
    for k, r in enumerate(rates):
        assert found[k, 1, 1] == pytest.approx(r, abs=0.06)
    assert post[(patterns == 1).all(1)] > 0.95


def test_classifier(spark):
    rng = random.Random(1)
    good = [(i, " ".join(rng.choice("the of and with house tree river walks slowly under bright sky near old bridge".split()) for _ in range(60))) for i in range(60)]
    bad = [(100 + i, " ".join(rng.choice("abc xyz qrs".split()) + "$$$" for _ in range(60))) for i in range(30)]
    docs = spark.createDataFrame([(*d, 1) for d in [*good, *bad, (200, None), (201, "")]], "doc_id bigint, text string, quality_x int")
    out = {r["doc_id"]: r for r in quality_classifier.classify(docs).collect()}
    assert len(out) == 92 and all(out[i]["quality_score"] > 0.5 for i, _ in good) and all(out[i]["quality_score"] < 0.5 for i, _ in bad)
    assert set(out[0].asDict()) == {"doc_id", "text", "quality_x", "quality_label", "quality_score", "quality_fitted"}
    assert quality_classifier.classify(docs.limit(0)).count() == 0
    few = quality_classifier.classify(docs.where("doc_id < 3")).collect()
    assert all(r["quality_fitted"] and 0 <= r["quality_score"] <= 1 for r in few) and len(few) == 3
    clash = quality_classifier.classify(docs.withColumnRenamed("quality_x", "quality_score"))
    assert clash.columns.count("quality_score") == 1 and clash.where("quality_score > 1").count() == 0


def brute_likelihood(model, classes):
    a = model.start * model.emit[:, classes[0]]
    for c in classes[1:]:
        a = (a @ model.move) * model.emit[:, c]
    return math.log10(a.sum())


def test_forward_recursion_is_exact(monkeypatch):
    model = language_model.Model(np.arange(3, dtype=np.uint64), 4, 3, np.full(7, 1 / 7))
    rng = np.random.default_rng(0)
    sizes = np.array([1, 7, 40, 3, 1, 9000])
    classes = rng.integers(0, 7, sizes.sum())
    first = np.cumsum(sizes) - sizes
    found = language_model.forward(model, classes, first, sizes)
    for x, lo, n in zip(found, first, sizes, strict=True):
        if n < 100:  # the plain product of longer texts is too small a number
            assert x == pytest.approx(brute_likelihood(model, classes[lo : lo + n]), rel=1e-9)
    whole = found[-1]
    monkeypatch.setattr(language_model, "_BLOCK", 7)
    monkeypatch.setattr(language_model, "_ROWS", 3)
    assert np.allclose(language_model.forward(model, classes, first, sizes), found, rtol=1e-12)
    log, a = 0.0, model.start
    for c in classes[-9000:]:
        a = (a if log == 0 else a @ model.move) * model.emit[:, c]
        log, a = log + math.log10(a.sum()), a / a.sum()
    assert whole == pytest.approx(log, rel=1e-12)


def brute_counts(model, classes):
    """Expected counts of one text, a token at a time."""
    n, k = len(classes), len(model.start)
    alpha, beta, scale = np.zeros((n, k)), np.ones((n, k)), np.zeros(n)
    for t, c in enumerate(classes):
        alpha[t] = (alpha[t - 1] @ model.move if t else model.start) * model.emit[:, c]
        scale[t] = alpha[t].sum()
        alpha[t] /= scale[t]
    for t in range(n - 2, -1, -1):
        beta[t] = model.move @ (model.emit[:, classes[t + 1]] * beta[t + 1]) / scale[t + 1]
    gamma, move, emit = alpha * beta, np.zeros((k, k)), np.zeros((k, model.classes))
    for t in range(n - 1):
        move += alpha[t][:, None] * model.move * (model.emit[:, classes[t + 1]] * beta[t + 1])[None, :] / scale[t + 1]
    for t, c in enumerate(classes):
        emit[:, c] += gamma[t]
    return gamma[0], move, emit


@pytest.mark.parametrize("rows,block", [(512, 1 << 15), (2, 64), (3, 1)])
def test_baum_welch_is_that_of_brute_force(monkeypatch, rows, block):
    monkeypatch.setattr(language_model, "_ROWS", rows)
    monkeypatch.setattr(language_model, "_BLOCK", block)
    model = language_model.Model(np.arange(3, dtype=np.uint64), 4, 3, np.full(7, 1 / 7), seed=8)
    rng = np.random.default_rng(1)
    sizes = np.array([1, 9000, 3, 700, 1, 4097, 12])
    first = np.cumsum(sizes) - sizes
    classes = rng.integers(0, 7, sizes.sum())
    found = language_model.expected_counts(model, classes, first, sizes)
    each = [brute_counts(model, classes[lo : lo + n]) for lo, n in zip(first, sizes, strict=True)]
    for x, y in zip(found, (sum(parts) for parts in zip(*each, strict=True)), strict=True):
        assert np.allclose(x, y, rtol=1e-9)
    some = [5, 2, 1]
    for x, y in zip(language_model.expected_counts(model, classes, first[some], sizes[some]), (sum(parts) for parts in zip(*[each[i] for i in some], strict=True)), strict=True):
        assert np.allclose(x, y, rtol=1e-9)


def test_packed_integers_come_back():
    for x in (np.zeros(0, np.uint32), np.array([1, 2**31, 7], np.uint32), np.arange(-5, 1000), np.array([True, False, True])):
        assert np.array_equal(language_model.unpacked(pa.scalar(language_model.packed(x), pa.binary()), x.dtype.type), x)


def test_baum_welch_counts_and_progress(monkeypatch):
    model = language_model.Model(np.arange(3, dtype=np.uint64), 4, 3, np.full(7, 1 / 7))
    rng = np.random.default_rng(0)
    sizes = np.array([30, 5, 50])
    classes = np.concatenate([np.resize([0, 1, 2, 3], n) for n in sizes])
    classes[rng.integers(0, len(classes), 5)] = 6
    first = np.cumsum(sizes) - sizes
    before = language_model.forward(model, classes, first, sizes).sum()
    for _ in range(10):
        start, move, emit = language_model.expected_counts(model, classes, first, sizes)
        assert start.sum() == pytest.approx(3) and move.sum() == pytest.approx(sizes.sum() - 3) and emit.sum() == pytest.approx(sizes.sum())
        model.start, model.move, model.emit = start / start.sum(), move / move.sum(1, keepdims=True), (emit + 1e-9) / (emit + 1e-9).sum(1, keepdims=True)
        now = language_model.forward(model, classes, first, sizes).sum()
        assert now >= before - 1e-6
        before = now


def test_language_model_counts(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice(["The", "the", "cat", "Dog", "Été", f"r{rng.randint(0, 40)}"]) for _ in range(rng.randint(0, 30)))) for i in range(60)] + [(100, None), (101, ""), (None, "the cat")]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = collections.Counter()
    tokens = lambda t: re.findall(BLANK, (t or "").translate(LOWER)) + ["\n"]
    for i, t in docs:
        if not held(i):
            counts.update(tokens(t))
    total, kinds = sum(counts.values()), len(counts)
    learn = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) != 2, F.lit(True))
    rows = language_model.score(table(spark, docs), learn, own=4, shared=3, states=2, rounds=2, chunk=100).collect()
    assert len(rows) == len(docs)
    by = {r["doc_id"]: r for r in rows}
    for i, t in docs:
        r, w = by[i], tokens(t)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(x in counts for x in w), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[x] + 1) / (total + kinds + 1)) for x in w)) and r["score"] < 0
    assert language_model.score(table(spark, docs).limit(0), learn).count() == 0
    assert language_model.score(table(spark, docs), F.lit(False)).where("n_known > 0").count() == 0


def fresh_model():
    return language_model.Model(np.zeros(0, np.uint64), 5, 2, np.full(5, 1 / 5))


@pytest.mark.parametrize("chunk", [1, 600_000])
def test_each_round_learns_from_all_texts(spark, chunk):
    texts = ["aa bb aa bb cc", "bb cc", "aa", "cc cc cc aa bb", "bb aa", "cc", "aa cc bb"]
    docs = table(spark, list(enumerate(texts))).coalesce(1)
    model, expected = fresh_model(), fresh_model()
    language_model.learn_states(language_model.tokenised(docs, "text", "doc_id", F.col("doc_id") != 2, chunk), model, 3)
    learned = [np.append(Words(pa.array([t])).hashes, language_model.END) for i, t in enumerate(texts) if i != 2]
    sizes = np.array([len(x) for x in learned])
    for _ in range(3):
        expected.update(*language_model.expected_counts(expected, expected.class_of(np.concatenate(learned)), np.cumsum(sizes) - sizes, sizes))
    for part in ("start", "move", "emit"):
        assert np.allclose(getattr(model, part), getattr(expected, part), rtol=1e-5)


def test_model_stays_where_nothing_is_learned(spark):
    model, before = fresh_model(), fresh_model()
    language_model.learn_states(language_model.tokenised(table(spark, [(1, "a b"), (2, "c")]), "text", "doc_id", F.lit(False), 100), model, 3)
    for part in ("start", "move", "emit"):
        assert np.array_equal(getattr(model, part), getattr(before, part))


def test_digest_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
