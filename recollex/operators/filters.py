"""Predicates and lookups over beliefs, and set operations of retrieval and evaluation, all as columns and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollex.functions import text

CONFIDENCE_FLOOR, LATE_PENALTY, GUARD_WORDS = 0.5, 2.0, 5
# ---- Fixed values: words whose stems settle a question, weaken a mention, or presuppose what they mention ----
COMMITMENT = "decided chose chosen picked settled signed submitted sent confirmed paid hired ordered booked applied registered".split()
IRREALIS = "booked scheduling planning will upcoming whether wondering might hoping someday considering eyeing".split()
PRESUPPOSED = "again back returned".split()
ASSIGNMENT = "was is became announced named promoted appointed made elected".split()


def by_id(beliefs: DataFrame, ids: DataFrame) -> DataFrame:
    """The named beliefs (ids: belief_id)."""
    return beliefs.join(ids, "belief_id", "left_semi")


def by_text(beliefs: DataFrame, *by: str) -> DataFrame:
    """For each text the belief that said it last, by (asserted_at, belief_id)."""
    rest = [c for c in beliefs.columns if c not in (*by, "text")]
    last = F.max_by(F.struct(*rest), F.struct("asserted_at", "belief_id"))
    return beliefs.groupBy(*by, "text").agg(last.alias("_last")).select(*by, "text", "_last.*")


def with_status(beliefs: DataFrame, *statuses: str) -> DataFrame:
    return beliefs.where(F.col("status").isin(*statuses))


def shown(confidence: Column, floor: float = CONFIDENCE_FLOOR) -> Column:
    """Whether a belief is sure enough to be shown unasked."""
    return F.coalesce(confidence >= floor, F.lit(False))


def _stems(words: list[str]) -> Column:
    return F.array_distinct(F.transform(F.array(*map(F.lit, words)), lambda w: text.stemmed(w)))


def _words(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[A-Za-z][\w'-]*"), F.lit(0))


def has_stem(c: Column, words: list[str]) -> Column:
    """Whether a text holds a word of the same stem as one of the list."""
    return F.arrays_overlap(F.transform(_words(F.lower(c)), lambda w: text.stemmed(w)), _stems(words))


def commits(c: Column) -> Column:
    return has_stem(c, COMMITMENT)


def actual(c: Column) -> Column:
    """Not only planned, possible or asked: no irrealis word, or one that presupposes the fact."""
    return ~has_stem(c, IRREALIS) | has_stem(c, PRESUPPOSED)


def of_someone_else(c: Column, role: Column) -> Column:
    """Whether a role is given to a third person: of the five words before it one is a name and one assigns."""
    words = _words(c)
    head = text.stemmed(F.lower(F.element_at(F.split(role, r"\s+"), 1)))
    at = F.filter(F.transform(words, lambda w, i: F.when(text.stemmed(F.lower(w)) == head, i)), lambda i: i.isNotNull())

    def given(i: Column) -> Column:
        start = F.greatest(i - GUARD_WORDS, F.lit(0))
        before = F.slice(words, start + 1, i - start)
        named = F.exists(before, lambda w: w.rlike("^[A-Z]") & (F.lower(w) != "i"))
        return named & F.exists(before, lambda w: F.array_contains(_stems(ASSIGNMENT), text.stemmed(F.lower(w))))

    return F.exists(at, given)


def shares_token(c: Column, question: str) -> Column:
    """The cheap prefilter: a token in common with the question."""
    return F.arrays_overlap(text.bm25_tokens(c), text.bm25_tokens(F.lit(question)))


def late_penalty(at: Column, latest_asked: Column, penalty: float = LATE_PENALTY) -> Column:
    """-penalty for a candidate from after the latest date of the question, else 0; never a filter."""
    return F.when(at > latest_asked, F.lit(-penalty)).otherwise(0.0)


def anchors(retrieved: DataFrame, attributes: DataFrame, entities: DataFrame, most: int = 12) -> DataFrame:
    """(node) a walk starts from: the first `most` retrieved (node, rank) and all that hold one of the entities (value)."""
    first = retrieved.orderBy("rank", "node").limit(most).select("node")
    held = attributes.where("channel = 'entity'").join(entities, "value", "left_semi").select("node")
    return first.unionByName(held).distinct()


def noise(every: DataFrame, scenario: DataFrame, key: str) -> DataFrame:
    """Rows that belong to no scenario."""
    return every.join(scenario.select(key).distinct(), key, "left_anti")


def beliefs_of_chunks(chunks: DataFrame, propositions: DataFrame, beliefs: DataFrame) -> DataFrame:
    """(chunk_id, belief_id, ..) by way of the propositions that came from a chunk (chunk_id, proposition_id)."""
    return chunks.join(propositions.select("chunk_id", "proposition_id"), "chunk_id").join(beliefs, "proposition_id")


def event_count(beliefs: DataFrame, words: list[str]) -> DataFrame:
    """How many beliefs mention one of the words, with their ids: the count to fall back on where no fact was extracted."""
    hit = beliefs.where(has_stem(F.col("text"), words))
    return hit.agg(F.count(F.lit(1)).cast("double").alias("count"), F.sort_array(F.collect_set("belief_id")).alias("contributing"))
