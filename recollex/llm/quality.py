"""Quality rules, line first: lines are judged one by one, failing lines go, and a document that lost too much is rejected.

A line (between newlines) that holds a word fails if it is navigation (separators between nearly all of its words, or
three words at most without closing punctuation), symbols (SYMBOL_PERCENT of its visible characters or more), shouting
(three words or more, all capitals), broken (over half of its words end in doubled exclamation or question marks), stuttering (a
third of its words repeat the one before). Of a line that passes, boilerplate goes: the sentences, of BOILERPLATE_WORDS words at
most, that hold a licence, rights or cookie phrase; a longer sentence only mentions it and stays. They aren't held against
the document, as short clean texts under a licence line are labelled clean; of all other words at least KEEP_PERCENT must
stay, and one at all. Before that, the base rules reject documents of fewer than
MIN_WORDS words and those with over REPEAT_PERCENT of their words in five-word windows that occur twice or more.

All of it is built of Spark's own functions, within each row: nothing is shuffled and no Python runs.

Defined results: a null text is an empty one, has no words and is not kept. A null doc_id stays null. Repeated rows give
repeated rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollex.llm.common import SPACES, WORD, table

MIN_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5
KEEP_PERCENT, SYMBOL_PERCENT = 50, 10
BOILERPLATE_WORDS = 30
#: A sentence ends behind one of these marks, if white space follows, which then begins the next one.
_SENTENCE = r"(?<=[.!?])(?=[\x20\x09-\x0D])"
#: Phrases of sentences that carry no text of their own; then the symbols that are counted.
BOILERPLATE = ("all rights reserved", "licensed under", "creative commons", "spdx-license", "copyright (c)", "©", "cookie policy", "privacy policy", "terms of use", "enable javascript", "click here")
_SYMBOL = "[#*$%&|<>]"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def repeated_words(hashes: Column, n: Column) -> Column:
    """Words in windows of five that occur twice or more, from the words' hashes and their number.

    Windows are hashed from pairs of pairs. Where none repeats, which sets tell, that is all; else windows are sorted by
    hash, those equal to a neighbour are put in order of place, and each adds the words that the next doesn't cover.
    """
    two = F.zip_with(F.slice(hashes, 1, F.greatest(n - 1, F.lit(0))), F.slice(hashes, 2, n), lambda a, b: F.xxhash64(a, b))
    four = F.zip_with(F.slice(two, 1, F.greatest(n - 3, F.lit(0))), F.slice(two, 3, n), lambda a, b: F.xxhash64(a, b))
    return F.zip_with(F.slice(four, 1, F.greatest(n - 4, F.lit(0))), F.slice(hashes, 5, n), lambda a, b: F.xxhash64(a, b))


def _with_repeats(rows: DataFrame) -> DataFrame:
    """rows with n_repeat_words in the place of windows; see repeated_words. Each step is a column, so none runs twice."""
    some = F.size("windows") > F.size(F.array_distinct("windows"))
    none = F.expr("cast(null as struct<h:bigint, i:int>)")
    rows = rows.withColumn("placed", F.when(some, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    around = F.zip_with(F.concat(F.array(none), "placed"), F.concat("placed", F.array(none)), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    rows = rows.withColumn("places", F.sort_array(F.array_distinct(F.flatten(F.filter(around, lambda x: x.isNotNull())))))
    n = F.size("places")
    gaps = F.zip_with(F.slice("places", 1, n - 1), F.slice("places", 2, n), lambda a, b: F.least(b - a, F.lit(WINDOW)))
    total = F.aggregate(gaps, F.lit(WINDOW), lambda s, g: s + g).cast("long")
    return rows.withColumn("n_repeat_words", F.when(F.col("placed").isNotNull(), total).otherwise(F.lit(0).cast("long"))).drop("windows", "placed", "places")


def line_fails(line: Column) -> Column:
    """Whether a line, a struct of line, low, words, seen and symbols, fails a rule other than boilerplate."""
    text, words, seen, symbols = line["line"], line["words"], line["seen"], line["symbols"]
    n = F.size(words)
    separators = F.size(F.filter(words, lambda w: w.isin("|", ">", "»", "·", "•", "/")))
    loud = F.size(F.filter(words, lambda w: w.endswith("!!") | w.endswith("??")))
    closed = text.rlike(r"[.!?:;,…\"'”’»)\]][\x20\x09-\x0D]*$")
    shouting = (n >= 3) & (line["low"] != text) & (F.upper(text) == text)
    stutter = F.size(F.filter(F.zip_with(words, F.slice(words, 2, n), lambda a, b: a == b), lambda same: same))
    return (100 * symbols >= SYMBOL_PERCENT * seen) | (3 * separators >= n) | ((n <= 3) & ~closed) | shouting | (2 * loud > n) | (3 * stutter >= n)


def is_boilerplate(low: Column) -> Column:
    """Whether a text in lower case holds a phrase."""
    found = F.lit(False)
    for phrase in BOILERPLATE:
        found = found | low.contains(phrase)
    return found


def without_boilerplate(line: Column) -> Column:
    """What stays of a line, a struct as in line_fails, without its short sentences that hold a phrase."""
    own = F.filter(F.split(line["line"], _SENTENCE), lambda s: ~(is_boilerplate(F.lower(s)) & (F.size(_words(s)) <= BOILERPLATE_WORDS)))
    return F.when(is_boilerplate(line["low"]), F.array_join(own, "")).otherwise(line["line"])


def clean(docs: DataFrame) -> DataFrame:
    """doc_id, text, the base counts, base_failed, kept_words, judged_words (all but boilerplate), cleaned (the text that stays) and kept."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    rows = rows.withColumn("read", F.transform(lines, lambda x: F.struct(x.alias("line"), F.lower(x).alias("low"), _words(x).alias("words"))))
    counted = lambda x: F.struct(
        x["line"].alias("line"), x["low"].alias("low"), x["words"].alias("words"), F.length(F.array_join(x["words"], "")).alias("seen"),
        (F.length(x["line"]) - F.length(F.regexp_replace(x["line"], _SYMBOL, ""))).alias("symbols"),
    )
    rows = rows.withColumn("read", F.transform("read", counted))
    rows = rows.withColumn("hashes", F.transform(F.flatten(F.transform("read", lambda x: x["words"])), lambda w: F.xxhash64(w)))
    n = F.size("hashes")

    def total(field: str) -> Column:
        return F.aggregate("read", F.lit(0).cast("long"), lambda s, x: s + x[field])

    rows = rows.select(
        "doc_id", "text", "read",
        n.cast("long").alias("n_words"),
        total("seen").alias("word_chars"),
        total("symbols").alias("n_symbols"),
        (F.size("read") - F.size(F.array_distinct(F.transform("read", lambda x: x["line"])))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("hashes"), n).alias("windows"),
    )
    rows = _with_repeats(rows)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    cut = lambda x: F.struct(without_boilerplate(x).alias("line"), is_boilerplate(x["low"]).alias("cut"), F.size(x["words"]).alias("before"))
    stays = F.transform(F.transform(F.filter("read", lambda x: ~line_fails(x)), cut), lambda x: x.withField("n", F.when(x["cut"], F.size(_words(x["line"]))).otherwise(x["before"])))
    rows = rows.withColumn("base_failed", failed).withColumn("stays", stays).drop("read")

    def words(count) -> Column:
        return F.aggregate("stays", F.lit(0).cast("long"), lambda s, x: s + count(x))

    rows = rows.withColumn("kept_words", words(lambda x: x["n"])).withColumn("judged_words", F.col("n_words") - words(lambda x: x["before"] - x["n"]))
    rows = rows.withColumn("cleaned", F.array_join(F.transform(F.filter("stays", lambda x: x["n"] > 0), lambda x: x["line"]), "\n"))
    enough = (100 * F.col("kept_words") >= KEEP_PERCENT * F.col("judged_words")) & (F.col("kept_words") > 0)
    return rows.withColumn("kept", ~F.col("base_failed") & enough).drop("stays")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return clean(table(spark, sf_dir, "documents")).select("doc_id", *counts, "base_failed", "kept")


def sql() -> str:
    """The same in DuckDB's SQL: words and windows as rows, lines as rows."""
    word = r"[^\x20\x09-\x0D]"
    mark = "chr(57344)"  # stands between sentences
    aside = lambda c: "(" + " OR ".join(f"contains(lower({c}), '{p}')" for p in BOILERPLATE) + ")"
    sentences = rf"string_split(regexp_replace(line, '([.!?])([\x20\x09-\x0D])', '\1' || {mark} || '\2', 'g'), {mark})"
    cut = f"list_filter({sentences}, lambda s: NOT ({aside('s')} AND len(regexp_extract_all(s, '{word}+')) <= {BOILERPLATE_WORDS}))"
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
    w AS (SELECT r, doc_id, text, regexp_extract_all(text, '{word}+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{word}')) AS l FROM d),
    g AS (SELECT r, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM w)),
    f AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
    n AS (SELECT r, count(DISTINCT i + k) AS n FROM f, range({WINDOW}) o(k) GROUP BY r),
    x AS (SELECT r, line, regexp_extract_all(line, '{word}+') AS w FROM (SELECT r, unnest(l) AS line FROM w)),
    y AS (SELECT r, len(w) AS n, CASE WHEN {aside('line')} THEN len(regexp_extract_all(array_to_string({cut}, ''), '{word}+')) ELSE len(w) END AS m, (100 * (length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g'))) >= {SYMBOL_PERCENT} * length(array_to_string(w, ''))
            OR 3 * len(list_filter(w, lambda t: list_contains(['|', '>', '»', '·', '•', '/'], t))) >= len(w)
            OR (len(w) <= 3 AND NOT regexp_matches(line, '[.!?:;,…"''”’»)\]][ 	-
]*$'))
            OR (len(w) >= 3 AND upper(line) = line AND lower(line) <> line)
            OR 2 * len(list_filter(w, lambda t: ends_with(t, '!!') OR ends_with(t, '??'))) > len(w)
            OR 3 * len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) >= len(w)) AS fails FROM x),
    z AS (SELECT r, sum(n - m) FILTER (NOT fails) AS gone, sum(m) FILTER (NOT fails) AS kept FROM y GROUP BY r),
    b AS (SELECT w.r, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
            (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN n USING (r))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words) AS base_failed,
           NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words) AND coalesce(kept, 0) > 0 AND 100 * coalesce(kept, 0) >= {KEEP_PERCENT} * (n_words - coalesce(gone, 0)) AS kept FROM b LEFT JOIN z USING (r)
    """
