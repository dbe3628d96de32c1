"""Notes, vaults, chat exports and question sets as tables of statements."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollex.functions import text

#: What counts as a note, and how dates are written in front matter.
SUFFIXES = "*.{md,markdown,txt}"
DATE_FORMATS = ["yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy", "MMMM d, yyyy"]
MOST_PROPOSITIONS, LEAST_CHARS = 10, 30


def frontmatter(content: Column) -> Column:
    """The `key: value` lines between the leading --- lines, as a map."""
    block = F.regexp_extract(content, r"(?s)\A---\s*\n(.*?)\n---\s*\n", 1)
    lines = F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^\s*[\w-]+\s*:"))
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.regexp_extract(x, r"^\s*([\w-]+)\s*:", 1))).alias("key"), F.trim(F.regexp_replace(F.regexp_extract(x, r"^\s*[\w-]+\s*:(.*)$", 1), r"['\"]", "")).alias("value")))
    return F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _v: k != p["key"]), F.create_map(p["key"], p["value"])))


def body(content: Column) -> Column:
    return F.regexp_replace(content, r"(?s)\A---\s*\n.*?\n---\s*\n", "")


def parsed_date(c: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in DATE_FORMATS]).cast("timestamp_ntz")


def wikilinks(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"\[\[([^\]|#]+)"), F.lit(1)))


def tags(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?:^|\s)#([A-Za-z][\w/-]*)"), F.lit(1)))


def read_notes(spark: SparkSession, path: str, most: int = 2000) -> DataFrame:
    """One row for each chunk of each note below a folder: path, session_id, chunk_idx, text, asserted_at, links, tags.

    The date is that of the front matter, else the file's. Hidden files and folders are passed over.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", SUFFIXES).load(path)
    rows = files.where(~F.col("path").rlike(r"/\.[^/]+")).select("path", "modificationTime", F.col("content").cast("string").alias("content"))
    rows = rows.withColumn("meta", frontmatter(F.col("content"))).withColumn("body", body(F.col("content")))
    date = F.coalesce(parsed_date(F.col("meta")["date"]), parsed_date(F.col("meta")["created"]), F.col("modificationTime").cast("timestamp_ntz"))
    session = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    rows = rows.select("path", session.alias("session_id"), date.alias("asserted_at"), wikilinks(F.col("body")).alias("links"), tags(F.col("body")).alias("tags"), F.posexplode(text.packed_chunks(F.col("body"), most)).alias("chunk_idx", "text"))
    return rows.withColumn("context", F.col("path"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One fact a line."""
    return spark.read.text(path).select(F.trim("value").alias("text")).where("text <> ''")


_CHAT = """array<struct<uuid:string,name:string,created_at:string,chat_messages:array<struct<sender:string,text:string,created_at:string>>>>"""


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The JSON members of archives, or a file itself, that hold conversations, one file at a time."""
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            found = []
            if path.lower().endswith(".zip"):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    found = [(f"{path}!{n}", z.read(n).decode("utf-8", "replace")) for n in z.namelist() if n.lower().endswith(".json") and ("conversation" in n.lower() or "messages" in n.lower())]
            else:
                found = [(path, content.decode("utf-8", "replace"))]
            for name, body_ in found:
                data = json.loads(body_)
                for talk in data if isinstance(data, list) else [data]:
                    yield pd.DataFrame({"path": [name], "talk": [json.dumps(talk)]})


def read_chats(spark: SparkSession, path: str) -> DataFrame:
    """Human statements of chat exports (zip, folder or JSON): session_id, turn_idx, prop_idx, text, asserted_at."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{zip,json}").load(path).select("path", "content")
    talks = files.mapInPandas(_members, "path string, talk string").select("path", F.from_json("talk", _CHAT.removeprefix("array<").removesuffix(">")).alias("t"))
    turns = talks.select(F.coalesce("t.uuid", "path").alias("session_id"), F.posexplode("t.chat_messages").alias("turn_idx", "m"))
    human = turns.where(F.lower("m.sender").isin("human", "user") & (F.length("m.text") >= LEAST_CHARS))
    said = F.slice(text.statements(F.col("m.text")), 1, MOST_PROPOSITIONS)
    return human.select("session_id", "turn_idx", F.posexplode(said).alias("prop_idx", "text"), F.coalesce(parsed_date(F.substring("m.created_at", 1, 19))).alias("asserted_at"))


_QUESTION = """question_id string, question string, question_type string, question_date string, answer string, answer_session_ids array<string>, haystack_session_ids array<string>,
haystack_dates array<string>, haystack_sessions array<array<struct<role:string,content:string,has_answer:boolean>>>"""


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """A question set with nested sessions, as one row for each turn of each question's sessions."""
    rows = spark.read.schema(_QUESTION).option("multiLine", "true").json(path)
    each = rows.select("question_id", "question", "question_type", "answer", "answer_session_ids", F.explode(F.arrays_zip("haystack_session_ids", "haystack_dates", "haystack_sessions")).alias("s"))
    turns = each.select("question_id", "question", "question_type", "answer", "answer_session_ids", F.col("s.haystack_session_ids").alias("session_id"), F.col("s.haystack_dates").alias("date"), F.posexplode("s.haystack_sessions").alias("turn_idx", "turn"))
    return turns.select("*", "turn.role", "turn.content", "turn.has_answer").drop("turn")


def read_scenarios(spark: SparkSession, path: str, unseal: bool = False) -> DataFrame:
    """Scenario lines; held-out ones only if they are asked for by name."""
    rows = spark.read.json(path)
    return rows if unseal or "heldout" not in rows.columns else rows.where(~F.coalesce("heldout", F.lit(False)))
