"""Frames for dashboards and comparisons of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def histogram(rows: DataFrame, value: str, low: float, high: float, bins: int = 20) -> DataFrame:
    """bin (from 1), its lower edge and its count; the top edge belongs to the last bin, values outside to the ends."""
    width = (high - low) / bins
    at = F.greatest(F.lit(1), F.least(F.lit(bins), F.floor((F.col(value) - low) / width).cast("int") + 1))
    counts = rows.where(F.col(value).isNotNull()).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = rows.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", (F.lit(low) + (F.col("bin") - 1) * width).alias("from"), F.coalesce("n", F.lit(0)).alias("n"))


def timeline(rows: DataFrame, ts: str, *by: str) -> DataFrame:
    """New and all rows so far by day. Days are few, so the running sum is of an aggregate."""
    from pyspark.sql import Window as W

    days = rows.groupBy(*by, F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return days.withColumn("so_far", F.sum("n").over(W.partitionBy(*by).orderBy("day")))


def compared(one: DataFrame, two: DataFrame, key: str, value: str) -> DataFrame:
    """Rows that both runs have, with both values and the gain."""
    a, b = one.select(key, F.col(value).alias("before")), two.select(key, F.col(value).alias("after"))
    return a.join(b, key).withColumn("gain", F.col("after") - F.col("before"))


def successors(links: DataFrame, beliefs: DataFrame) -> DataFrame:
    """Each superseded belief with the texts of those that replaced it, in order of id."""
    named = links.join(beliefs.select(F.col("belief_id").alias("new_id"), F.col("text").alias("new_text")), "new_id")
    return named.groupBy(F.col("old_id").alias("belief_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("new_id", "new_text"))), lambda x: x["new_text"]), " | ").alias("replaced_by"))


def failure_kind(retrieved: Column, answered: Column, in_summary: Column) -> Column:
    """Where a question was lost: not retrieved, retrieved but not in the summary, there but not answered."""
    return F.when(answered, "answered").when(~retrieved, "not_retrieved").when(~in_summary, "lost_in_summary").otherwise("not_answered")


def ablation(spark, base: dict, grid: dict[str, list]) -> list[dict]:
    """The settings of a grid, one change from the base at a time."""
    return [base] + [base | {k: v} for k, values in grid.items() for v in values if base.get(k) != v]
