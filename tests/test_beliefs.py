import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from recollex.operators import beliefs as B
from recollex.operators import detectors, facts
from recollex.streaming import windows

COLUMNS = [c.strip().split()[0] for c in B.LOG.replace("\n", " ").split(",")]


def log(spark, *events):
    rows = []
    for seq, e in enumerate(events):
        e = {"store_id": 1, "seq": seq, **e}
        rows.append(tuple(e.get(c) for c in COLUMNS))
    return spark.createDataFrame(rows, B.LOG)


def state(spark, *events):
    return {r.belief_id: r for r in B.folded(log(spark, *events)).collect()}


def add(i, **more):
    return {"type": "add", "belief_id": i, "text": i, "confidence": 0.5, **more}


def test_supersede_is_not_destructive_and_idempotent(spark):
    s = state(spark, add("a"), add("b"), {"type": "supersede", "belief_id": "a", "other_id": "b"}, {"type": "supersede", "belief_id": "a", "other_id": "b"})
    assert s["a"].status == "superseded" and s["a"].superseded_by == ["b"] and s["b"].supersedes == ["a"] and s["b"].status == "current"


def test_reinforcement_and_crystallisation(spark):
    events = [add("a")] + [x for i in range(6) for x in (add(f"n{i}"), {"type": "reinforce", "belief_id": "a", "other_id": f"n{i}", "distinct_source": True, "distinct_pramana": False})]
    s = state(spark, *events)
    at_five = 1 - 0.5 * 0.7**5
    assert s["a"].confidence == pytest.approx(1 - 0.5 * 0.7**6) and s["a"].samskara_count == 6
    assert s["a"].deep_confidence == pytest.approx(at_five + 0.06 * (1 - at_five))


def test_disputes(spark):
    s = state(spark, add("a"), add("b"), {"type": "dispute", "belief_id": "a", "other_id": "b"})
    assert {s["a"].status, s["b"].status} == {"disputed"}
    s = state(spark, add("a"), add("b"), {"type": "dispute", "belief_id": "a", "other_id": "b", "ambiguous": True}, {"type": "resolve_dispute", "belief_id": "b", "other_id": "a"})
    assert s["b"].status == "current" and s["a"].status == "superseded" and not s["b"].disputed_with


def test_sublation_coexistence_archive(spark):
    s = state(spark, add("a"), add("b"), add("c"), {"type": "sublate", "belief_id": "a", "other_id": "b"}, {"type": "coexist", "belief_id": "b", "other_id": "c"}, {"type": "status_set", "belief_id": "c", "status": "archived"}, {"type": "supersede", "belief_id": "x", "other_id": "b"})
    assert s["a"].status == "badhita" and s["b"].status == "coexists" and s["c"].status == "archived"


def test_closed_form_is_the_fold(spark):
    random.seed(1)
    flags = [(random.random() < 0.5, random.random() < 0.5) for _ in range(12)]
    events = [add("a"), add("n")] + [{"type": "reinforce", "belief_id": "a", "other_id": "n", "distinct_source": s, "distinct_pramana": p} for s, p in flags]
    folded = state(spark, *events)["a"]
    rows = spark.createDataFrame([("a", 0.5, s, p) for s, p in flags], "belief_id string, confidence double, distinct_source boolean, distinct_pramana boolean")
    closed = B.reinforced_confidence(rows, "belief_id").first()
    assert closed.confidence == pytest.approx(folded.confidence) and closed.samskara_count == folded.samskara_count


def test_stream_gives_the_batch_state(spark, tmp_path):
    events = log(spark, add("a"), add("b"), {"type": "supersede", "belief_id": "a", "other_id": "b"})
    events.where("seq < 2").coalesce(1).write.parquet(str(tmp_path / "in"))
    events.where("seq >= 2").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = windows.read_stream(spark, str(tmp_path / "in"), events.schema, 10)
    found = windows.drained(windows.fold_stream(stream), "folded", "update").collect()
    last = {r.belief_id: r.status for r in found}
    assert last == {r.belief_id: r.status for r in B.folded(events).collect()}


def test_decay(spark):
    row = spark.range(1).select(B.decayed(F.lit(1.0), F.lit(730.0), floor=0.0).alias("two"), B.decayed(F.lit(0.7), F.lit(-1.0)).alias("none"), B.decayed(F.lit(0.1), F.lit(10000.0)).alias("floor")).first()
    assert row.two == pytest.approx(0.25) and row.none == 0.7 and row.floor == pytest.approx(0.1)


@pytest.mark.parametrize(("text", "total"), [
    ("I spent $50 on a saddle. I paid $75 for a helmet. Lights cost $40 and the bike lock was 20 dollars.", 185.0),
    ("A bike is $100 to $500 these days.", 0.0), ("I was thinking about a $300 helmet.", 0.0), ("I returned it, the $80 saddle, and got a refund.", 0.0), ("I paid $1,234.56.", 1234.56),
])
def test_money(text, total):
    assert sum(f["value"] for f in facts.extract(text) if f["unit"] == "USD") == pytest.approx(total)


@pytest.mark.parametrize(("word", "form"), [("bikes", "bike"), ("bicycle", "bike"), ("tennis", "tennis"), ("status", "status"), ("chess", "chess"), ("stories", "writing")])
def test_canonical(word, form):
    assert facts.canonical(word) == form


@pytest.mark.parametrize(("values", "label"), [([1.0, 1, 9, 1.2], "spike"), ([10.0, 10.5, 10.2], "flat"), ([1.0, 2, 3], "rising"), ([3.0, 2, 1], "falling"), ([1.0, 3, 2], None), ([1.0], None)])
def test_trend(spark, values, label):
    assert spark.createDataFrame([([float(v) for v in values],)], "v array<double>").select(facts.trend(F.col("v")).alias("t")).first().t == label


@pytest.mark.parametrize(("stack", "a", "b", "label"), [
    ("stub", "I like coffee very much", "I do not like coffee", "contradicts"), ("stub", "I like coffee", "The weather is fine", "neutral"),
    ("numerical", "My rent is 1500", "My rent is 1700", "contradicts"), ("numerical", "my landlord is Bob", "my landlord is Ann", "contradicts"), ("numerical", "my landlord is Bob", "my landlord is Bob", "neutral"),
    ("sequential", "I drive a red sedan to work", "I now drive a blue sedan to work", "contradicts"), ("sequential", "I drive a red sedan to work", "These days I drive a red sedan to work too", "neutral"),
    ("revision", "I quit drinking coffee", "I am back on drinking coffee", "contradicts"),
])
def test_detectors(spark, stack, a, b, label):
    row = spark.createDataFrame([(a, b)], "a string, b string").transform(lambda r: detectors.judged(r, "a", "b", stack)).first()
    assert row.label == label


def test_full_stack_rewrites_and_vetoes(spark):
    cases = [("I eat raw fish", "I do not eat sushi at all", "contradicts"), ("I want to move as my rent is 1500", "They say my rent is 1700", "neutral")]
    rows = detectors.judged(spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string"), "a", "b").collect()
    assert {r.i: r.label for r in rows} == {i: label for i, (_, _, label) in enumerate(cases)}


def test_ingest_settles_by_means_of_knowledge(spark):
    t = dt.datetime(2024, 1, 1)
    said = {
        1: ["I saw that my rent is 1500", "My doctor told me that my rent is 1700"],  # hearsay does not replace what was seen
        2: ["My doctor told me that my rent is 1500", "I saw that my rent is 1700"],
        3: ["My rent is 1500", "My rent is 1700"],
        4: ["The choir meets on Monday", "the choir meets on monday!"],
    }
    rows = spark.createDataFrame([(s, i, x, "s", f"src{i}", None, t) for s, own in said.items() for i, x in enumerate(own)], "store_id long, seq long, text string, session_id string, source_id string, context string, asserted_at timestamp_ntz")
    log = B.ingested(rows)
    types = {s: [r.type for r in log.where(F.col("store_id") == s).orderBy("seq").collect()] for s in said}
    assert types == {1: ["add", "add", "sublate"], 2: ["add", "add", "sublate"], 3: ["add", "add", "supersede"], 4: ["add", "add", "reinforce"]}
    now = {(r.store_id, r.belief_id) for r in B.current(B.folded(log)).collect()}
    assert (1, "b0") in now and (1, "b1") not in now and (2, "b1") in now and (2, "b0") not in now and (3, "b1") in now


def test_ingest_supersedes(spark):
    t = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(1, 0, "My rent is 1500", "s", "s", None, t), (1, 1, "My rent is 1700", "s", "s", None, t), (2, 0, "My rent is 900", "s", "s", None, t)], "store_id long, seq long, text string, session_id string, source_id string, context string, asserted_at timestamp_ntz")
    found = {(r.store_id, r.text): r.status for r in B.folded(B.ingested(rows)).collect()}
    assert found == {(1, "My rent is 1500"): "superseded", (1, "My rent is 1700"): "current", (2, "My rent is 900"): "current"}
