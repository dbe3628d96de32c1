"""Event logs, fact sidecars and archives: JSON lines in and out, always with a schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recollex.operators.beliefs import LOG
from recollex.operators.facts import FACT_SCHEMA


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """An event log; a malformed record is an error, as losing one would change all that follows."""
    return spark.read.schema(LOG).option("mode", "FAILFAST").json(path)


def append_log(events: DataFrame, path: str) -> None:
    """Append events; committers make a whole batch visible or none of it."""
    events.write.mode("append").json(path)


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """A sidecar of facts; malformed rows are left out."""
    rows = spark.read.schema(FACT_SCHEMA + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    return rows.where("_corrupt_record is null").drop("_corrupt_record")


def append_facts(facts: DataFrame, path: str) -> None:
    facts.write.mode("append").json(path)


def archive_id() -> Column:
    """A turn's id, from its content alone, so that archiving twice changes nothing."""
    parts = F.concat_ws("\u0000", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("session_id", "turn_idx", "speaker", "content")])
    return F.concat(F.lit("rt_"), F.substring(F.sha2(parts, 256), 1, 16))


def archived(turns: DataFrame) -> DataFrame:
    """Turns with their ids, each once."""
    return turns.withColumn("turn_id", archive_id()).dropDuplicates(["turn_id"])


def rebound(links: DataFrame) -> DataFrame:
    """Propositions linked to more than one turn, which an archive forbids."""
    return links.groupBy("proposition_id").agg(F.countDistinct("turn_id").alias("turns")).where("turns > 1")


def provenance(beliefs: DataFrame, links: DataFrame, turns: DataFrame) -> DataFrame:
    """Beliefs with the turn they came from, if any."""
    return beliefs.join(links, "proposition_id", "left").join(turns, "turn_id", "left")


def latest_rows(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key: an upsert."""
    at = F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))
    return rows.withColumn("_at", at).where("_at = 1").drop("_at")


def write_results(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
