import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollex.functions import text
from recollex.operators import graph, metrics, retrieval
from recollex.plans import answers, router
from recollex.sources import logs, notes


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("r")).first().r


@pytest.mark.parametrize(("value", "expected"), [
    ("Dr. Smith came. He left.", ["Dr. Smith came.", "He left."]), ("It cost 3.5 dollars. Fine.", ["It cost 3.5 dollars.", "Fine."]),
    ("I went home, and I slept; then woke.", ["I went home", "I slept", "then woke."]), ("Buy:\n1. milk\n2. eggs", ["Buy:", "milk", "eggs"]), ("", []),
])
def test_propositions(spark, value, expected):
    rows = spark.createDataFrame([("s", 0, value)], "session_id string, turn_idx int, text string")
    assert [r.text for r in text.propositions(rows).orderBy("prop_idx").collect()] == expected


@pytest.mark.parametrize(("value", "kind"), [("My doctor told me to rest", "shabda"), ("I saw the parade", "pratyaksa"), ("I heard that it rained", "shabda"), ("She must be at home", "arthapatti"), ("It is probably fine", "anumana"), ("The sky", "unknown")])
def test_pramana(spark, value, kind):
    assert one(spark, value, text.pramana) == kind


@pytest.mark.parametrize(("value", "kind"), [("I've never been to Rome", "atyantabhava"), ("I no longer smoke", "pradhvamsabhava"), ("I haven't finished it yet", "pragabhava"), ("I am not a doctor", "anyonyabhava"), ("I am a doctor", "none"), ("That is not it", "unknown")])
def test_negation(spark, value, kind):
    assert one(spark, value, text.negation_kind) == kind


@pytest.mark.parametrize(("question", "route"), [
    ("How much did I spend in total?", "ganita"), ("How much did I spend per month?", "composition"), ("Have I ever been to Japan?", "absence"), ("What does this remind me of? It reminds me", "analogy"),
    ("When did I first start running?", "narrative"), ("Which doctor did I mention?", "retrieval"), ("What feels most similar to this?", "analogy"), ("How many times did I change my mind per month?", "composition"),
])
def test_routes(spark, question, route):
    assert one(spark, question, router.route) == route


def test_small_columns(spark):
    assert one(spark, "On 2024-05-01 and May 2, 2024, and 05/01/2024", text.dates)[0].isoformat() == "2024-05-01"
    assert one(spark, "for two weeks", text.validity_days) == 14 and one(spark, "the next month", text.validity_days) == 30
    assert one(spark, "I am away until 2024-05-03.", text.valid_until).isoformat() == "2024-05-03" and one(spark, "until soon", text.valid_until) is None
    assert one(spark, "x" * 9000, text.overlapping_chunks)[1][:1] == "x" and len(one(spark, "x" * 9000, text.overlapping_chunks)) == 3
    assert one(spark, "user: hi there\nassistant: no\nhuman: bye", text.user_turns) == "hi there\nbye"
    assert one(spark, "a\n\nb\n\n# h\nc", lambda c: text.packed_chunks(c, 5)) == ["a\n\nb", "# h\nc"]
    assert one(spark, "have been to the kitchen builder", lambda c: router.locus(F.lit("been to the season ticket for the team"))) == "season ticket"


def test_bm25_ranks_exact_match_first(spark):
    docs = spark.createDataFrame([(1, "red bicycle repair"), (2, "blue car"), (3, "bicycle")], "id long, text string")
    found = retrieval.bm25(docs, "id", "bicycle repair").orderBy(F.desc("score")).collect()
    assert [r.id for r in found] == [1, 3]
    assert retrieval.bm25(docs, "id", "the of and").count() == 0


def test_fusion_and_mmr(spark):
    lists = spark.createDataFrame([("a", 1), ("b", 2), ("a", 2), ("b", 1), ("c", 3)], "id string, rank int")
    scores = {r.id: r.score for r in retrieval.fused(lists, "id").collect()}
    assert scores["a"] == scores["b"] > scores["c"]
    v = np.array([[1.0, 0], [1, 0], [0, 1]])
    assert [i for i, _ in retrieval.mmr_order(["a", "b", "c"], np.array([1.0, 0.9, 0.5]), v, ["s", "s", "t"], 3, 0.5, None)] == ["a", "c", "b"]
    assert [i for i, _ in retrieval.mmr_order(["a", "b", "c"], np.array([1.0, 0.9, 0.5]), v, ["s", "s", "t"], 3, 1.0, 1)] == ["a", "c"]


def test_graph(spark):
    rows = spark.createDataFrame([(1, "entity", "x"), (2, "entity", "x"), (3, "speaker", "y")], "node long, channel string, value string")
    pairs = graph.edges(rows).collect()
    assert [(p.a, p.b) for p in pairs] == [(1, 2)] and pairs[0].weight == pytest.approx(0.5)
    assert graph.average_linkage(np.array([[1.0, 0], [0.99, 0.1], [0, 1]]), 0.65) == [0, 0, None]
    every = graph.both_ways(graph.edges(rows))
    near = graph.neighbours(rows, rows.where("node = 1").select("node"))
    assert [tuple(r) for r in near.collect()] == [tuple(r) for r in every.where("src = 1").collect()]
    chain = spark.createDataFrame([(1, "entity", "x"), (2, "entity", "x"), (2, "entity", "y"), (3, "entity", "y"), (2, "topic", "z"), (4, "topic", "z"), (5, "topic", "z")], "node long, channel string, value string")
    ranked = spark.createDataFrame([(0, 1, 0.5)], "query_id long, node long, score double")
    got = {r.node: (round(r.score, 6), r.walked) for r in graph.songline_walk(ranked, chain, hops=2, branch=1).collect()}
    assert got == {1: (0.5, False), 2: (0.025, True), 4: (round(0.05 * (0.5 + 1 / np.log2(5)), 6), True)}  # the new channel leads on from 2
    assert {r.node: r.hops for r in graph.narrative_walk(chain, chain.select("node", F.lit(True).alias("on_theme")).distinct(), ranked.select("node"), 2).collect()} == {1: 0, 2: 1, 3: 2, 4: 2, 5: 2}


def test_absence(spark):
    rows = spark.createDataFrame([("b1", "I visited Japan", 1), ("b2", "I no longer own a bike", 2)], "belief_id string, text string, asserted_at int")
    asked = spark.createDataFrame([(1, "ever", "japan"), (2, "ever", "iceland"), (3, "still", "bike")], "question_id int, scope string, locus string")
    found = {r.question_id: (r.verdict, r.searched_n) for r in answers.absence_verdicts(rows, asked).collect()}
    assert found == {1: ("present", 2), 2: ("absent", 2), 3: ("absent", 2)}


def test_absence_by_scope(spark):
    said = ["I might visit Japan someday", "I returned from Peru again, hoping to rest", "Dario was announced as team lead", "I am the chess captain", "We talked about the boiler", "We ordered the boiler", "I own a kayak", "I no longer own the kayak"]
    rows = spark.createDataFrame([(f"b{i}", x, i) for i, x in enumerate(said)], "belief_id string, text string, asserted_at int")
    asked = [("ever", "japan"), ("ever", "peru"), ("identity", "team lead"), ("identity", "chess captain"), ("yet", "boiler"), ("open", "roof"), ("still", "kayak")]
    found = answers.absence_verdicts(rows, spark.createDataFrame([(i, *a) for i, a in enumerate(asked)], "question_id int, scope string, locus string")).collect()
    got = {asked[r.question_id][1]: (r.verdict, r.evidence_id, r.contrast_ids) for r in found}
    assert got == {
        "japan": ("absent", None, ["b0"]), "peru": ("present", "b1", ["b1"]), "team lead": ("absent", None, ["b2"]), "chess captain": ("present", "b3", ["b3"]),
        "boiler": ("present", "b5", ["b5"]), "roof": ("absent", None, []), "kayak": ("absent", "b7", ["b7", "b6"]),
    }
    assert all(r.searched_n == len(said) for r in found)


def test_answers_in_summaries(spark):
    cases = [("3 red bikes", "she has three red bikes", True), ("three red bikes", "there are 3 red bikes", True), ("3 bikes", "13 bikes", False), ("Lisbon", "she moved to lisbon", True), ("blue old car", "a red bus", False), ("", "x", False), ("12.5 km", "ran 12.5 km", True)]
    rows = spark.createDataFrame([(i, a, s) for i, (a, s, _) in enumerate(cases)], "i int, a string, s string")
    got = {r.i: r.v for r in rows.select("i", metrics.in_summary(F.col("a"), F.col("s")).alias("v")).collect()}
    assert got == {i: c[2] for i, c in enumerate(cases)}


def test_lineage_with_a_cycle(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 12)] + [(5, 2), (3, 9)], "src long, dst long")
    got = {r.belief_id: r.depth for r in graph.lineage(links, spark.createDataFrame([(1,)], "belief_id long")).collect()}
    assert got == {1: 0, 2: 1, 3: 2, 4: 3, 9: 3, 5: 4, 10: 4, 6: 5, 11: 5, 7: 6, 12: 6, 8: 7}


def test_memory_answers(spark):
    rows = spark.sql("""select 1L store_id, id seq, t text, 's' session_id, 's' source_id, cast(null as string) context, timestamp_ntz'2024-01-05 00:00:00' + make_dt_interval(cast(id * 31 as int)) asserted_at
        from values (0L, 'I spent $50 on a bike saddle'), (1L, 'I paid $75 for a bike helmet'), (2L, 'I visited Japan in spring') as v(id, t)""")
    memory = answers.Memory(spark, rows)
    total = memory.recall("How much did I spend on my bike in total?")
    assert total.strategy == "ganita" and total.rows.first()["sum"] == 125.0 and len(total.receipts) == 2
    assert memory.recall("Have I ever been to Iceland?").rows.first().verdict == "absent"
    assert memory.recall("How much did I spend on my bike per month?").strategy == "composition"
    assert memory.recall("Which country did I visit in spring?").rows.first().text.startswith("I visited Japan")


def test_sources(spark, tmp_path):
    (tmp_path / "vault").mkdir()
    (tmp_path / "vault" / "n.md").write_text("---\ndate: 2024-02-03\ntitle: x\n---\n# Head\nBody [[Link]] #tag\n\nmore")
    (tmp_path / "vault" / ".hidden.md").write_text("no")
    rows = notes.read_notes(spark, str(tmp_path / "vault")).collect()
    assert rows[0].asserted_at.isoformat().startswith("2024-02-03") and rows[0].links == ["Link"] and rows[0].tags == ["tag"] and rows[0].session_id == "vault" and len(rows) == 1
    talk = [{"uuid": "u", "chat_messages": [{"sender": "human", "text": "I moved to Lisbon last year. Can you write code?", "created_at": "2024-01-01T10:00:00Z"}, {"sender": "assistant", "text": "I see, that is great to hear from you", "created_at": ""}]}]
    with zipfile.ZipFile(tmp_path / "e.zip", "w") as z:
        z.writestr("conversations.json", json.dumps(talk))
    assert [r.text for r in notes.read_chats(spark, str(tmp_path / "e.zip")).collect()] == ["I moved to Lisbon last year."]
    facts = tmp_path / "facts.json"
    facts.write_text('{"belief_id": "b", "value": 1.5}\nbroken\n')
    assert [r.value for r in logs.read_facts(spark, str(facts)).collect()] == [1.5]
    turns = spark.createDataFrame([("s", 0, "u", "hi")] * 2, "session_id string, turn_idx int, speaker string, content string")
    assert logs.archived(turns).count() == 1


def test_session_seeds_pair_all_of_a_large_session(spark):
    rows = [("large", i) for i in range(450)] + [("small", i) for i in range(448, 452)] + [(None, 1), (None, 2)]
    none = spark.createDataFrame([(3, 4, 0.5)], "a long, b long, weight double")
    got = graph.seeded_sessions(spark.createDataFrame(rows, "session_id string, belief_id long"), none, 0.01).collect()
    want = {(a, b) for b in range(450) for a in range(b)} | {(a, b) for b in range(448, 452) for a in range(448, b)}
    assert len(got) == len(want) and {(r.a, r.b) for r in got} == want
    assert {(r.a, r.b) for r in got if r.weight != 0.01} == {(3, 4)}


def test_learned_relation_predicts_every_adjacent_pair(spark):
    from recollex.plans import catalog

    d = "/root/testdata/sf0.001"
    ids = {r.vec_id for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()}
    got = [(r.a, r.next) for r in catalog.QUERIES["q_learned_relation"](spark, d).collect()]
    assert len(got) == len(set(got)) and set(got) == {(i, i + 1) for i in ids if i + 1 in ids}
