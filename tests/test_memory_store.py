"""The memory table against plain Python: several writes, late facts, superseded sessions, records, salient sentences."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docloom.operators import memory_store as store

SCHEMA = "doc_id string, seq_num int, kind string, content string, subject string, predicate string, object string, effective_from timestamp"


def day(n, hour=0):
    return dt.datetime(2030, 1, 1) + dt.timedelta(days=n, hours=hour)


def fact(doc, n, subject, at, predicate="p", object="o"):
    return (doc, n, "fact", f"{subject} {predicate}", subject, predicate, object, at)


def by_id(rows):
    return {r["id"]: r for r in rows.collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_writes_in_any_order_come_to_one(spark, seed):
    r = random.Random(seed)
    rows = [fact(f"d{i % 7}", i, r.choice(["hot", "hot", "a", None]), r.choice([None, day(r.randrange(6), r.randrange(4))]), r.choice(["p", "q"])) for i in range(90)]
    r.shuffle(rows)
    memory = None
    for i in range(3):
        # a document of its own for each write, as rows of the same id are replaced
        part = [(f"{x[0]}-{i}", *x[1:]) for x in rows[i::3]]
        memory = store.write(memory, spark.createDataFrame(part, SCHEMA), "ns", str(day(100 + i)))
    got = memory.collect()
    assert len(got) == 90 and len({x["id"] for x in got}) == 90
    for x in got:
        live = x["subject"] is not None and x["effective_from"] is not None
        later = [y["effective_from"] for y in got if live and y["effective_from"] and (y["subject"], y["predicate"]) == (x["subject"], x["predicate"]) and y["effective_from"] > x["effective_from"]]
        assert x["effective_to"] == (min(later) if later else None)
        assert x["retracted"] == bool(later) and (x["retracted_at"] is not None) == bool(later)


def test_late_fact_shortens_the_one_before_and_is_ended_itself(spark):
    one = store.write(None, spark.createDataFrame([fact("d", 0, "s", day(1)), fact("d", 1, "s", day(9)), fact("d", 2, "t", day(1))], SCHEMA), "ns", str(day(20)))
    two = by_id(store.write(one, spark.createDataFrame([fact("e", 0, "s", day(5))], SCHEMA), "ns", str(day(21))))
    assert {k: (v["effective_to"], v["retracted_at"]) for k, v in two.items()} == {"ns::d::0": (day(5), day(20)), "ns::d::1": (None, None), "ns::d::2": (None, None), "ns::e::0": (day(9), day(21))}
    # facts of another namespace end none
    three = by_id(store.write(store.write(one, spark.createDataFrame([fact("e", 0, "t", day(5))], SCHEMA), "other", str(day(22))), spark.createDataFrame([], SCHEMA), "ns", str(day(23))))
    assert three["ns::d::2"]["effective_to"] is None and len(three) == 4


def test_consolidated_documents_replace_and_what_they_ended_holds_again(spark):
    one = store.write(None, spark.createDataFrame([fact("a", 0, "s", day(1)), fact("b", 0, "s", day(2)), ("b", 1, None, "said", None, None, None, None), (None, 0, None, "x", None, None, None, None)], SCHEMA), "ns", str(day(20)))
    assert by_id(one)["ns::a::0"]["retracted"] and len(by_id(one)) == 3
    two = by_id(store.write(one, spark.createDataFrame([("b", 5, None, "all", None, None, None, None)], SCHEMA), "ns", str(day(21)), tier="consolidated"))
    assert set(two) == {"ns::a::0", "ns::b::0"} and two["ns::b::0"]["kind"] == "episode" and two["ns::b::0"]["tier"] == "consolidated"
    assert (two["ns::a::0"]["retracted"], two["ns::a::0"]["effective_to"], two["ns::a::0"]["retracted_at"]) == (False, None, None)


def test_rows_that_say_they_are_retracted_stay_so(spark):
    rows = spark.createDataFrame([fact("a", 0, "s", day(1))], SCHEMA).withColumn("retracted", F.lit(True))
    one = store.write(None, rows, "ns", str(day(20)))
    two = store.write(one, spark.createDataFrame([fact("b", 0, "s", day(0))], SCHEMA), "ns", str(day(21)))
    assert by_id(two)["ns::a::0"]["retracted"] and by_id(two)["ns::a::0"]["effective_to"] is None
    assert by_id(two)["ns::a::0"]["retracted_at"] == day(20)


def test_records_keep_order_and_name_entities_once(spark):
    rows = [("s", 0, None, "first", None, None, None, None), fact("s", 1, "b", None, "likes", "a"), ("s", 2, "episode", None, None, None, None, None), fact("s", 3, "a", None, "likes", "c"), fact("s", 4, "a", None, "likes", ""), fact("t", 0, "x", None)]
    memory = store.write(None, spark.createDataFrame(rows, SCHEMA), "ns", str(day(20)), tier="consolidated")
    got = {r["source_id"]: r for r in store.records(memory).collect()}
    assert set(got) == {"memory:ns:s", "memory:ns:t"}
    s = got["memory:ns:s"]
    assert s["text"] == "first\n\n" and s["entities"] == ["b", "a", "c"] and [(r["src"], r["dst"]) for r in s["relationships"]] == [("b", "a"), ("a", "c")]
    assert [c["id"] for c in s["chunks"]] == ["ns::s::0", "ns::s::2"] and got["memory:ns:t"]["text"] == "" and got["memory:ns:t"]["chunks"] == []
    assert store.records(memory, tier="provisional").count() == 0 and store.records(memory, namespace="no").count() == 0


def test_next_start_over_spans(spark):
    r = random.Random(7)
    rows = [("hot" if i % 3 else f"k{i % 5}", day(r.randrange(9), r.randrange(3))) for i in range(300)]
    got = store.next_start(spark.createDataFrame(rows, "k string, at timestamp"), ["k"], "at").collect()
    assert len(got) == len(set(rows))
    for x in got:
        assert x["next"] == min((t for k, t in rows if k == x["k"] and t > x["at"]), default=None)


def test_salient_sentences_are_confident_in_order(spark):
    text = "Cats chase mice. Dogs bark. Cats chase cats. The. Mice fear cats! Nothing else matters."
    got = store.salient_facts(spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "a an. the")], "id int, t string"), ["id"], "t", 3).collect()
    count = Counter("cats chase mice dogs bark cats chase cats mice fear cats nothing else matters".split())
    assert count["cats"] == 4
    assert [(r["id"], r["fact_seq"], r["support_span"], r["confidence"]) for r in sorted(got, key=lambda r: r["fact_seq"])] == [(1, 0, "Cats chase mice.", 1.0), (1, 1, "Cats chase cats.", 0.667), (1, 2, "Mice fear cats!", 0.333)]
