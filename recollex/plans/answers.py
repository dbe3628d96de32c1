"""The query classes over tables of beliefs and facts, and Memory, which routes a question to one of them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recollex.functions import text
from recollex.operators import beliefs as state_ops
from recollex.operators import facts as fact_ops
from recollex.operators import graph as graph_ops
from recollex.operators import filters, retrieval
from recollex.plans import router

FRAME_BONUS, OVERLAP_COST = 0.15, 0.5


# ---- absence ----

def mentions(rows: DataFrame, questions: DataFrame) -> DataFrame:
    """(question_id, scope, locus, belief columns, positive) of rows that mention all stemmed words of a question's locus;
    positive: no negation of any kind. Texts are stemmed once and meet the questions by stem."""
    asked = questions.withColumn("_wanted", text.locus_tokens(F.col("locus"))).where(F.size("_wanted") > 0)
    asked = asked.select("question_id", "scope", "locus", F.size("_wanted").alias("_n"), F.explode("_wanted").alias("_stem"))
    columns = [c for c in rows.columns if c not in ("question_id", "scope", "locus")]
    each = rows.select(F.struct(*columns).alias("_row"), F.explode(text.locus_tokens(F.col("text"))).alias("_stem"))
    hit = each.join(asked, "_stem").groupBy("question_id", "scope", "locus", "_n", "_row").agg(F.count(F.lit(1)).alias("_hits")).where("_hits = _n")
    return hit.select("question_id", "scope", "locus", "_row.*").withColumn("positive", text.negation_kind(F.col("text")) == "none")


def absence_verdicts(rows: DataFrame, questions: DataFrame, most: int = 3) -> DataFrame:
    """question_id, scope, verdict, evidence_id, contrast_ids and searched_n: every belief is searched, and the number says so.

    rows: belief_id, text, asserted_at; questions: question_id, scope, locus. A mention settles a question if it is
    positive and, by scope, actual (ever), not about someone else (identity) or a commitment (yet, open); for still the
    latest mention alone decides. The evidence is the first settling mention for ever and identity, else the latest; of
    an absence it is the latest negated mention, and contrast_ids are the latest `most` mentions.
    """
    n = rows.agg(F.count(F.lit(1)).alias("searched_n"))
    c, scope, when = F.col("text"), F.col("scope"), F.struct("asserted_at", "belief_id")
    fits = F.when(scope == "ever", filters.actual(c)).when(scope == "identity", ~filters.of_someone_else(c, F.col("locus"))).when(scope.isin("yet", "open"), filters.commits(c)).otherwise(F.lit(True))
    found = mentions(rows, questions).withColumn("settles", F.col("positive") & fits)
    settling = F.when(F.col("settles"), when)
    of = found.groupBy("question_id").agg(
        F.min_by("belief_id", settling).alias("first"), F.max_by("belief_id", settling).alias("last"), F.max_by("belief_id", F.when(~F.col("positive"), when)).alias("denied"),
        F.max_by("positive", when).alias("so_now"), F.slice(F.sort_array(F.collect_list(when), asc=False), 1, most).alias("latest"),
    )
    present = F.coalesce(F.when(scope == "still", F.col("so_now")).otherwise(F.col("last").isNotNull()), F.lit(False))
    evidence = F.when(present, F.when(scope.isin("ever", "identity"), F.col("first")).otherwise(F.col("last"))).otherwise(F.col("denied"))
    contrast_ids = F.when(present, F.array(evidence)).otherwise(F.coalesce(F.transform("latest", lambda m: m["belief_id"]), F.array().cast("array<string>")))
    rows = questions.join(of, "question_id", "left").crossJoin(F.broadcast(n))  # n is one row
    return rows.select("question_id", "scope", F.when(present, "present").otherwise("absent").alias("verdict"), evidence.alias("evidence_id"), contrast_ids.alias("contrast_ids"), "searched_n")


def never_did(subjects: DataFrame, events: DataFrame, key: str) -> DataFrame:
    """Subjects without any event: exhaustive absence."""
    return subjects.join(events.select(key).distinct(), key, "left_anti")


def latest(rows: DataFrame, *by: str) -> DataFrame:
    """Each group's latest row by (asserted_at, belief_id), with n, the rows that were searched; combined before the shuffle."""
    columns = [c for c in rows.columns if c not in by]
    last = F.max_by(F.struct(*columns), F.struct("asserted_at", "belief_id"))
    return rows.groupBy(*by).agg(last.alias("last"), F.count(F.lit(1)).alias("n")).select(*by, "last.*", "n")


def contrast(rows: DataFrame, k: int, order: str, *by: str) -> DataFrame:
    """The k latest rows of each group."""
    at = F.row_number().over(W.partitionBy(*by).orderBy(F.desc(order), "belief_id"))
    return rows.withColumn("rank", at).where(F.col("rank") <= k)


# ---- analogy ----

def analogues(sessions: DataFrame, query: DataFrame) -> DataFrame:
    """session, score: cosine, less half the overlap of words, and a bonus for each frame in common.

    sessions and query have session, embedding, words and frames; query is one row.
    """
    q = query.select(F.col("session").alias("q_session"), F.col("embedding").alias("q"), F.col("words").alias("q_words"), F.col("frames").alias("q_frames"))
    both = sessions.crossJoin(F.broadcast(q)).where("session <> q_session")
    overlap = F.size(F.array_intersect("words", "q_words")) / F.greatest(F.lit(1), F.least(F.size("words"), F.size("q_words")))
    frames = F.size(F.array_intersect("frames", "q_frames"))
    score = retrieval.cosine(F.col("embedding"), F.col("q")) - OVERLAP_COST * overlap + FRAME_BONUS * frames
    return both.select("session", score.alias("score"), overlap.alias("overlap"), frames.alias("shared_frames"))


def pooled(vectors: DataFrame, by: str) -> DataFrame:
    """The mean vector of each group, component by component."""
    parts = vectors.select(by, F.posexplode("embedding").alias("i", "x")).groupBy(by, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return parts.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("p")).select(by, F.transform("p", lambda p: p["x"]).alias("embedding"))


# ---- narrative ----

def origins(rows: DataFrame, *by: str) -> DataFrame:
    """The first row of each group in order of time."""
    at = F.row_number().over(W.partitionBy(*by).orderBy("asserted_at", "belief_id"))
    return rows.withColumn("at", at).where("at = 1").drop("at")


def themed(rows: DataFrame, words: list[str]) -> DataFrame:
    return rows.where(F.arrays_overlap(text.entity_words(F.col("text")), F.array(*map(F.lit, words))))


# ---- the whole retrieval pipeline ----

def retrieve(docs: DataFrame, key: str, question: str, vectors: DataFrame, query_vector: DataFrame, attributes: DataFrame, k: int = 20, mmr_k: int = 30, cap: int = 5, pool: int = 2000) -> DataFrame:
    """(id, rank, score) of the k answers: fused candidates, walked over the attribute graph, diversified.

    vectors: key, session_id, embedding; attributes: node (the key), channel, value of the graph. What a walk and the diversification see
    is bounded by the pool.
    """
    fused = retrieval.hybrid(docs, key, question, vectors, query_vector, pool=pool)
    start = fused.select(F.lit(0).cast("long").alias("query_id"), F.col(key).cast("long").alias("node"), "score")
    walked = graph_ops.songline_walk(start, attributes).orderBy(F.desc("score"), "node").limit(pool)
    rows = walked.join(vectors.select(F.col(key).cast("long").alias("node"), "session_id", "embedding"), "node")
    picked = retrieval.mmr(rows.select("query_id", F.col("node").alias("id"), "session_id", "score", "embedding"), mmr_k, cap=cap)
    return picked.where(F.col("rank") <= k).select("id", "rank", F.col("mmr").alias("score"))


# ---- the facade ----

@dataclass
class Recall:
    """What a question gave: the class that answered, the rows, and the text that would be handed on."""

    strategy: str
    rows: DataFrame | None
    summary: str = ""
    receipts: list[str] = field(default_factory=list)


class Memory:
    """Statements, the state they fold to, and answers.

    beliefs: store_id, belief_id, seq, text, session_id, source_id, context, asserted_at. Nothing runs until a question
    asks for it; a question's answer is a bounded result.
    """

    def __init__(self, spark: SparkSession, statements: DataFrame, contradiction: float = 0.75):
        self.spark = spark
        self.log = state_ops.ingested(statements, contradiction)
        self.state = state_ops.folded(self.log)
        self.current = state_ops.current(self.state)
        self.facts = fact_ops.extracted(self.current.select("belief_id", "text", F.col("asserted_at").alias("ts")))

    def plan(self, question: str) -> dict:
        """The route of a question and what its gates found."""
        row = self.spark.createDataFrame([(question,)], "q string").select(
            router.route(F.col("q")).alias("route"), router.aggregation(F.col("q")).alias("op"), router.composition(F.col("q")).alias("composition"), router.absence(F.col("q")).alias("absence"),
            router.narrative(F.col("q")).alias("narrative"), router.is_lookup(F.col("q")).alias("lookup"), router.hints(F.col("q")).alias("hints"),
        ).first()
        return row.asDict(recursive=True)

    def recall(self, question: str, k: int = 20) -> Recall:
        """Answer by the first class that applies; one that finds nothing hands on, and errors surface."""
        plan = self.plan(question)
        hints = self.spark.createDataFrame([(h,) for h in plan["hints"]], "hint string")
        if plan["route"] in ("composition", "ganita"):
            named = fact_ops.by_alias(self.facts, F.broadcast(hints)).dropDuplicates(["belief_id", "raw_text", "value"])
            unit = fact_ops.elected_unit(named)
            chosen = named.join(unit, "unit")
            if plan["composition"]:
                rows = fact_ops.series(chosen, plan["composition"]["granularity"], op=plan["composition"]["op"]).orderBy("period")
                if not rows.isEmpty():
                    return Recall("composition", rows)
            found = fact_ops.aggregated(chosen).first()
            if found and found["count"]:
                op = plan["op"] or "sum"
                return Recall("ganita", fact_ops.aggregated(chosen), f"{op}: {found[op]:g}" if found[op] is not None else "", list(found["contributing"]))
        if plan["absence"]:
            asked = self.spark.createDataFrame([(1, plan["absence"]["scope"], plan["absence"]["locus"])], "question_id int, scope string, locus string")
            return Recall("absence", absence_verdicts(self.current, asked))
        if plan["narrative"]:
            rows = themed(self.state, plan["hints"][-1:]) if plan["hints"] else self.state.limit(0)
            told = origins(rows, "store_id") if plan["narrative"] == "origin" else rows.orderBy("asserted_at", "belief_id").limit(24)
            if not told.isEmpty():
                return Recall("narrative", told)
        scored = retrieval.bm25(self.current, "belief_id", question).orderBy(F.desc("score"), "belief_id").limit(k)
        rows = self.current.join(F.broadcast(scored), "belief_id").orderBy(F.desc("score"), "belief_id")
        return Recall("direct_answer" if plan["lookup"] else "structured", rows)
