"""The corpus pipeline: toxicity, near-duplicates, personal data, mixing, tokens.

Null and empty texts, null ids, ties and repeated rows go through every stage; what each gives for them is in its docstring.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows as Parquet into the shared
folder and reads them again as the next one's docs. All stages but the last return the columns of documents. Those that end
in Python lower the rows that Spark sends to a worker at a time, for the session: whole texts make batches large.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recollex.llm import bpe, mixing, neardup, pii
from recollex.llm import toxicity as toxic
from recollex.llm.common import delete, only, small_batches, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted to the labelled ones among docs, doesn't hold toxic.

    Texts of any length are scored whole. Null and empty ones get the score of a text without words. Repeated rows get the
    same score, so all of them stay or go. Without labels of both classes every document stays.
    """
    net = toxic.fitted(docs, table(spark, sf_dir, "labels"))
    small_batches(spark)
    return toxic.score(docs.select(*COLUMNS), net).where("predicted = 0").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of least doc_id; of rows that share it, the one of least hash.

    So of repeated rows one stays. Rows without a doc_id have no place in that order and all stay, repeated or not. Null and
    empty texts are like nothing else and stay, one row a doc_id.
    """
    found = neardup.near_duplicates(docs)
    kept = found.where("kept and doc_id is not null").select("doc_id").distinct()
    place = F.row_number().over(W.partitionBy("doc_id").orderBy(F.xxhash64(*(v for c in COLUMNS for v in (F.col(c), F.col(c).isNull())))))
    rows = docs.select(*COLUMNS).join(kept, "doc_id", "left_semi").withColumn("place", place).where("place = 1").select(*COLUMNS)
    return rows.unionByName(docs.select(*COLUMNS).where("doc_id is null"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by the name of its kind, and n_chars counted anew (null for a null text).

    Null and empty texts stay as they are; repeated rows are changed alike; texts of any length are read whole.
    """
    small_batches(spark)
    return pii.redact(docs.select(*COLUMNS))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, those that it takes twice as two rows.

    Null sources are a source of their own. Documents without words come as often as the block of words at their place.
    Repeated rows share the copies that the mix takes of them; ties in the shuffled order go by hashes of the whole row.
    """
    return mixing.copies(docs.select(*COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded of each row; null and empty texts have no ids, repeated rows repeated results."""
    small_batches(spark)
    return bpe.encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Of what the stages write, only the table that the last one reads is left for the caller."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with only(spark) as kept:
            before, docs = docs, written(stage(spark, docs, sf_dir), name)
            kept.append(docs)
        delete(before)
    return STAGES[-1][1](spark, docs, sf_dir)


#: A classifier and a likelihood estimate decide in it; tests hold each stage against plain Python on its own input.
ORACLE_SQL: str | None = None
