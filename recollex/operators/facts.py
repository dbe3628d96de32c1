"""Numeric facts: extraction from text, aggregates with receipts, per-period series, trends."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recollex.functions import rules, text

# ---- Fixed values: numbers in text; the windows are characters before and after a number ----
CURRENCY = re.compile(r"(?:\$|USD\s*)(?P<amt>\d+(?:,\d{3})*(?:\.\d+)?)|(?P<amt2>\d+(?:,\d{3})*(?:\.\d+)?)\s*(?:dollars?|USD)\b", re.I)
RANGE = re.compile(r"\$\s*\d+(?:,\d{3})*(?:\.\d+)?\s*(?:to|through|-|–|—)\s*\$?\s*\d+(?:,\d{3})*(?:\.\d+)?", re.I)
HYPOTHETICAL = re.compile(
    r"\b(?:thinking about|considering|wanted to|would cost|if I (?:bought|got|spent|had)|might (?:buy|get|spend)|maybe|perhaps|possibly|hoping to|planning to|would (?:be|cost)|could (?:cost|run)|around (?:\$|the))\b", re.I
)
NEGATIVE = re.compile(
    r"\b(?:didn'?t (?:buy|get|spend|pay)|did not (?:buy|get|spend|pay)|couldn'?t afford|could not afford|decided against|returned (?:it|them|for|the|a|my|this|that|those|these)|got a refund|refunded|cancelled|canceled|skipped (?:buying|getting)|chose not to)\b",
    re.I,
)
DURATION = re.compile(r"(?P<num>\d+(?:\.\d+)?)\s*(?P<unit>hours?|hrs?|minutes?|mins?|seconds?|secs?|days?|weeks?|months?|years?)\b", re.I)
PERCENT = re.compile(r"(?P<num>\d+(?:\.\d+)?)\s*%", re.I)
COUNT = re.compile(r"\b(?P<num>\d+|" + "|".join(rules.NUMBER_WORDS) + r")\s+(?P<thing>\w+(?:\s+\w+)?)\b", re.I)
TIME_UNITS = re.compile(r"(?:hours?|hrs?|minutes?|mins?|seconds?|secs?|days?|weeks?|months?|years?)\b", re.I)
UNIT_NAMES = {"hr": "hour", "min": "minute", "sec": "second"}
VETO_WINDOW, CONTEXT_WINDOW = 50, 60

FACT_SCHEMA = "belief_id string, ts timestamp_ntz, entity string, attribute string, value double, unit string, entity_aliases array<string>, raw_text string"


_PLURAL = re.compile(r"(?<=\w{2}[^\Wsiu])s$")
_WORD = re.compile(r"[A-Za-z]{3,}")
_BORDER = re.compile(r"(?<=[.!?])\s+|\n{2,}")


def canonical(word: str) -> str:
    """The name that a word goes by: its alias, else its singular, which drops an s behind anything but s, i and u."""
    low = word.strip().lower()
    return rules.ENTITY_ALIASES.get(low) or (single := _PLURAL.sub("", low)) and rules.ENTITY_ALIASES.get(single, single)


class _Places:
    """The places of a text that one pass finds: which numbers are vetoed, and the sentence around each place."""

    def __init__(self, whole: str):
        self.whole = whole
        # a marker vetoes the numbers that begin in the stretch from which it is wholly within the window
        stretches = [(m.end() - VETO_WINDOW, m.start() + VETO_WINDOW) for p in (HYPOTHETICAL, NEGATIVE) for m in p.finditer(whole)]
        stretches += [(m.start(), m.end() - 1) for m in RANGE.finditer(whole)]
        self.starts, self.reach = [], []
        for a, b in sorted(stretches):
            self.starts.append(a)
            self.reach.append(max(b, self.reach[-1] if self.reach else b))
        borders = [m.span() for m in _BORDER.finditer(whole)]
        self.begins, self.ends = [0, *(b for _, b in borders)], [*(a for a, _ in borders), len(whole)]

    def vetoed(self, at: int, end: int) -> bool:
        i = bisect.bisect_right(self.starts, at)
        inside = i < len(self.starts) and self.starts[i] < end and self.whole.startswith("$", self.starts[i])
        return (i > 0 and self.reach[i - 1] >= at) or inside

    def sentence(self, at: int) -> str:
        i = max(bisect.bisect_right(self.begins, at) - 1, 0)
        return self.whole[self.begins[i] : self.ends[i]]

    def around(self, m: re.Match[str]) -> str:
        return self.whole[max(0, m.start() - CONTEXT_WINDOW) : m.end() + CONTEXT_WINDOW]


def _attribute(context: str, otherwise: str) -> str:
    return next((name for name, patterns in rules.ATTRIBUTES if any(re.search(p, context, re.I) for p in patterns)), otherwise)


def _fact(m: re.Match[str], value: float, unit: str, attribute: str, context: str, entity: str | None = None) -> dict:
    names = [e for e in dict.fromkeys(map(canonical, _WORD.findall(context))) if e not in rules.ENTITY_STOP]
    return {"entity": entity or next(iter(names), "unknown"), "attribute": attribute, "value": value, "unit": unit, "entity_aliases": names, "raw_text": m[0]}


def _money(whole: str, places: _Places) -> Iterator[dict]:
    for m in CURRENCY.finditer(whole):
        if not places.vetoed(m.start(), m.end()):
            context = places.sentence(m.start())
            yield _fact(m, float((m["amt"] or m["amt2"]).replace(",", "")), "USD", _attribute(context, "expense"), context)


def _durations(whole: str, places: _Places) -> Iterator[dict]:
    for m in DURATION.finditer(whole):
        unit = m["unit"].lower().rstrip("s")
        yield _fact(m, float(m["num"]), UNIT_NAMES.get(unit, unit), "duration", places.around(m))


def _percentages(whole: str, places: _Places) -> Iterator[dict]:
    for m in PERCENT.finditer(whole):
        context = places.around(m)
        yield _fact(m, float(m["num"]), "percent", _attribute(context, "value"), context)


def _counts(whole: str, places: _Places) -> Iterator[dict]:
    for m in COUNT.finditer(whole):
        money = re.search(r"\$|usd|dollar", m[0], re.I) or (m.start() and whole[m.start() - 1] in "$.,")
        if not money and not TIME_UNITS.match(m["thing"]):
            value = rules.NUMBER_WORDS.get(m["num"].lower()) or float(m["num"])
            yield _fact(m, float(value), "item", "count", places.sentence(m.start()), canonical(m["thing"]))


def extract(whole: str) -> list[dict]:
    """Facts of a text: money that was spent or earned, durations, percentages and counts.

    A sum within a price range, or with hypothetical or negative words near, is not a fact. Linear in the text.
    """
    places = _Places(whole)
    return [fact for kind in (_money, _durations, _percentages, _counts) for fact in kind(whole, places)]


def extracted(beliefs: DataFrame) -> DataFrame:
    """The facts of beliefs(belief_id, text, ts): places in the text decide, so this runs in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{"belief_id": b, "ts": t, **fact} for b, x, t in zip(batch["belief_id"], batch["text"], batch["ts"], strict=True) if x for fact in extract(x)]
            yield pd.DataFrame(rows, columns=["belief_id", "ts", "entity", "attribute", "value", "unit", "entity_aliases", "raw_text"])

    return beliefs.select(F.col("belief_id").cast("string"), "text", F.col("ts").cast("timestamp_ntz")).mapInPandas(run, FACT_SCHEMA)


def deduplicated(facts: DataFrame) -> DataFrame:
    """One fact of each (entity, attribute, value, unit): that of the least belief_id."""
    w = W.partitionBy("entity", "attribute", F.round("value", 9), "unit").orderBy("belief_id")
    return facts.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def by_alias(facts: DataFrame, hints: DataFrame) -> DataFrame:
    """(hint, fact...) where a hint is the entity or one of its aliases: the aliases are exploded, so the join is by key."""
    names = F.array_distinct(F.concat(F.array("entity"), F.coalesce("entity_aliases", F.array().cast("array<string>"))))
    return facts.withColumn("hint", F.explode(names)).join(hints, "hint")


def nearby(texts: DataFrame, word: str, value: str, within: int = 80) -> Column:
    """Whether two strings stand within so many characters in the column `text`."""
    a, b = F.instr("text", word), F.instr("text", value)
    return (a > 0) & (b > 0) & (F.abs(a - b) <= within)


def elected_unit(facts: DataFrame, *group: str) -> DataFrame:
    """USD if a group holds any, else its commonest unit, the lesser name at ties."""
    counts = facts.groupBy(*group, "unit").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy(*group).orderBy(F.desc(F.col("unit") == "USD"), F.desc("n"), "unit")
    return counts.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*group, "unit")


def aggregated(facts: DataFrame, *group: str) -> DataFrame:
    """All six question aggregates of each group, with the receipts: the beliefs that contribute."""
    value = F.col("value")
    spread = F.when(F.count(value) >= 2, F.max(value) - F.min(value))
    return facts.groupBy(*group).agg(
        F.sum(value).alias("sum"), F.count(F.lit(1)).alias("count"), F.avg(value).alias("average"), F.max(value).alias("max"), F.min(value).alias("min"), spread.alias("difference"),
        F.sort_array(F.collect_set("belief_id")).alias("contributing"),
    )


def series(facts: DataFrame, granularity: str, *group: str, op: str = "sum", least: int = 2) -> DataFrame:
    """Values by month or year; groups with fewer than `least` periods give none, and gaps stay gaps."""
    period = F.date_format("ts", {"month": "yyyy-MM", "year": "yyyy"}[granularity])
    value = {"sum": F.sum("value"), "avg": F.avg("value"), "count": F.count(F.lit(1)).cast("double")}[op]
    rows = facts.where("ts is not null").groupBy(*group, period.alias("period")).agg(value.alias("value"), F.count(F.lit(1)).alias("n"))
    return rows.withColumn("_p", F.count(F.lit(1)).over(W.partitionBy(*group))).where(F.col("_p") >= least).drop("_p")


def trend(values: Column) -> Column:
    """spike, flat, rising, falling or null for a column of values in order of period."""
    n, hi, lo = F.size(values), F.array_max(values), F.array_min(values)
    rest = F.slice(F.sort_array(values), 1, F.greatest(n - 1, F.lit(1)))
    rest_hi, rest_lo = F.array_max(rest), F.array_min(rest)
    steps = F.zip_with(F.slice(values, 1, F.greatest(n - 1, F.lit(1))), F.slice(values, 2, n), lambda a, b: b - a)
    first, last = F.get(values, F.lit(0)), F.element_at(values, -1)
    return (
        F.when(n < 2, None)
        .when((n >= 3) & (rest_hi > 0) & (hi > 2.5 * rest_hi) & (rest_hi - rest_lo <= 0.5 * rest_hi), "spike")
        .when((hi > 0) & (hi - lo <= 0.10 * hi), "flat")
        .when(F.forall(steps, lambda d: d >= 0) & (last > first), "rising")
        .when(F.forall(steps, lambda d: d <= 0) & (last < first), "falling")
    )


def labelled_trends(rows: DataFrame, *group: str) -> DataFrame:
    found = rows.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("period", "value"))).alias("s"))
    return found.withColumn("v", F.transform("s", lambda x: x["value"])).select(*group, F.size("v").alias("periods"), trend(F.col("v")).alias("trend"))


def gaps(rows: DataFrame, *group: str) -> DataFrame:
    """Months that follow each other in a series with months missing between them."""
    w = W.partitionBy(*group).orderBy("period")
    day = F.to_date(F.concat("period", F.lit("-01")))
    found = rows.withColumn("before", F.lag("period").over(w)).withColumn("months", F.months_between(day, F.lag(day).over(w)).cast("int"))
    return found.where("months > 1").select(*group, F.col("before").alias("after_period"), F.col("period").alias("next_period"), (F.col("months") - 1).alias("missing"))


def restricted(facts: DataFrame, ids: DataFrame, over: int = 30) -> DataFrame:
    """Facts of the named beliefs, but only if there are more than `over` facts and some of them are named."""
    named = facts.join(ids, "belief_id", "left_semi")
    size = facts.agg(F.count(F.lit(1)).alias("n")).crossJoin(named.agg(F.count(F.lit(1)).alias("k")))  # one row each
    choose = F.broadcast(size.select(((F.col("n") > over) & (F.col("k") > 0)).alias("_only")))
    marked = facts.join(ids.distinct().withColumn("_in", F.lit(True)), "belief_id", "left").crossJoin(choose)
    return marked.where(~F.col("_only") | F.col("_in").isNotNull()).drop("_in", "_only")


hints = text.question_hints
