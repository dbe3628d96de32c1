"""Text to propositions, views, tokens and tags, all as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recollex.functions import rules

#: Stands for a protected full stop while sentences are split.
_DOT = "\u0001"
#: Unicode's space separators, which SQL's trim takes off, and the white space of RE2's patterns.
_SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
_WHITE = r"[\t\n\f\r ]"
_HOLD = rules.as_re2(r"(^|[^\p{L}\p{N}_])(" + "|".join(a.replace(".", r"\.") for a in rules.ABBREVIATIONS) + r")\.")
_CONJUNCTION = rules.as_re2(r",\s+(?:and|but|so|yet|or|nor|for)\s+(?=[a-z])")


def tokens(text: Column, pattern: str = "[a-z0-9]+", least: int = 2, stop: list[str] = rules.BM25_STOP) -> Column:
    """The lower-cased matches of pattern that are long enough and not stop words, in order, repeats kept."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0))
    keep = lambda t: F.length(t) >= least
    return F.filter(found, lambda t: keep(t) & ~t.isin(stop)) if stop else F.filter(found, keep)


def bm25_tokens(text: Column) -> Column:
    return tokens(text)


def prf_tokens(text: Column) -> Column:
    return tokens(text, "[a-z]{2,}", 2, rules.PRF_STOP)


def entity_words(text: Column) -> Column:
    """Canonical words of three letters or more that may name an entity, each once, in order."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]{3,}"), F.lit(0))
    return F.array_distinct(F.filter(F.transform(words, canonical), lambda t: ~t.isin(rules.ENTITY_STOP)))


def question_hints(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]{3,}"), F.lit(0))
    return F.array_distinct(F.transform(F.filter(words, lambda t: ~t.isin(rules.QUESTION_STOP)), canonical))


def words_over(text: Column, least: int) -> Column:
    """Distinct white-space words of more than `least` characters, for the pair detectors."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: F.length(w) > least))


def ngrams(words: Column, n: int) -> Column:
    """Joined runs of n words. words must be a plain column."""
    at = F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1)))
    return F.when(F.size(words) >= n, F.transform(at, lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def _alias(term: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in rules.ENTITY_ALIASES.items() for x in pair]), term)


def canonical(text: Column) -> Column:
    """Lower case, alias, and a plural's s taken off unless the word ends in ss, is or us."""
    t = F.trim(F.lower(text))
    plural = (F.length(t) > 3) & t.rlike("s$") & ~t.rlike("(?:ss|is|us)$")
    single = F.when(plural, F.regexp_replace(t, "s$", "")).otherwise(t)
    return F.coalesce(_alias(t), _alias(single), single)


def stemmed(word: Column, rounds: int = 5) -> Column:
    """Endings ing, ed, er, es and s taken off again and again while three letters or more stay."""
    for _ in range(rounds):
        word = F.regexp_replace(word, r"^(.{3,}?)(?:ing|ed|er|es|s)$", "$1")
    return word


def locus_tokens(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z][\w'-]*"), F.lit(0))
    return F.array_distinct(F.filter(F.transform(words, lambda w: stemmed(w)), lambda t: F.length(t) >= 3))


# ---- propositions ----

def list_items(text: Column) -> Column:
    """The items of a text with two list markers or more at line starts, with the lead before them; else null."""
    marker = r"(?m)^\s*(?:\d+[.)]\s+|[a-zA-Z][.)]\s+|[-*•]\s+)"
    parts = F.filter(F.transform(F.split(text, marker), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return F.when(F.regexp_count(text, F.lit(marker)) >= 2, parts)


def trimmed(text: Column) -> Column:
    return F.trim(text, F.lit(_SPACES))


def sentences(text: Column) -> Column:
    """Split behind . ! or ? before a capital, quote or bracket; abbreviations, decimals and a full stop that begins the text hold."""
    held = F.regexp_replace(text, _HOLD, "$1$2" + _DOT)
    parts = F.split(held, rf"\x03|(?<=[^0-9][.]|[!?]){_WHITE}+(?=[A-Z\"'(\[])")
    return F.filter(F.transform(parts, lambda p: trimmed(F.translate(p, _DOT, "."))), lambda p: p != "")


def clauses(sentence: Column) -> Column:
    """Split at semicolons, then before a comma's conjunction, which goes."""
    cut = F.regexp_replace(F.regexp_replace(sentence, rf"{_WHITE}*;{_WHITE}*", "\u0002"), _CONJUNCTION, "\u0002")
    return F.filter(F.transform(F.split(cut, "\u0002"), lambda p: F.rtrim(F.rtrim(trimmed(p), F.lit(",")), F.lit(_SPACES))), lambda p: p != "")


def propositions(turns: DataFrame, session: str = "session_id", turn: str = "turn_idx", text: str = "text", lists: bool = True) -> DataFrame:
    """session_id, turn_idx, prop_idx, chunk_id and text of every proposition of every turn.

    Without lists, list markers are text like any other.
    """
    whole = trimmed(F.coalesce(F.col(text), F.lit("")))
    pieces = F.coalesce(list_items(whole), F.array(whole)) if lists else F.array(whole)
    flat = F.flatten(F.transform(F.flatten(F.transform(pieces, sentences)), clauses))
    rows = turns.select(F.col(session).cast("string").alias("session_id"), F.col(turn).cast("int").alias("turn_idx"), F.posexplode(flat).alias("prop_idx", "text"))
    return rows.withColumn("chunk_id", F.concat("session_id", F.lit("#t"), "turn_idx", F.lit("#p"), "prop_idx"))


def views(props: DataFrame) -> DataFrame:
    """The seven views of each proposition (chunk_id, view, text): its neighbours are those of its session.

    props may carry entities (array) and ts (string); without them v5 to v7 fall back to the views they extend.
    """
    by = W.partitionBy("session_id").orderBy("turn_idx", "prop_idx")
    before, after = F.lag("text").over(by), F.lead("text").over(by)
    entities = F.col("entities") if "entities" in props.columns else F.lit(None).cast("array<string>")
    ts = F.col("ts") if "ts" in props.columns else F.lit(None).cast("string")
    rows = props.withColumns({"before": before, "after": after, "ents": entities, "at": ts})
    v4 = F.concat_ws(" ", "before", "text", "after")
    every = {
        "v1": F.col("text"),
        "v2": F.concat_ws(" ", "text", "after"),
        "v3": F.concat_ws(" ", "before", "text"),
        "v4": v4,
        "v5": F.when(F.size("ents") > 0, F.concat(F.lit("["), F.array_join("ents", ", "), F.lit("] "), v4)).otherwise(v4),
        "v6": F.when(F.size("ents") > 0, F.concat(F.lit("fact about "), F.element_at("ents", 1), F.lit(": "), "text")).otherwise(F.col("text")),
        "v7": F.when(F.col("at").isNotNull(), F.concat("at", F.lit(": "), "text")).otherwise(F.col("text")),
    }
    pairs = F.array(*[F.struct(F.lit(k).alias("view"), v.alias("text")) for k, v in every.items()])
    return rows.select("chunk_id", F.explode(pairs).alias("p")).select("chunk_id", "p.view", "p.text")


def entities(text: Column) -> Column:
    """Runs of capitalised words, each once; a plain stand-in for a tagger, which may be plugged in as a column."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*"), F.lit(0))
    return F.array_distinct(found)


def dates(text: Column) -> Column:
    """Absolute dates in a text (2024-05-01, 05/01/2024, May 1, 2024 and 1 May 2024), sorted, each day once."""
    month = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
    formats = [(r"\d{4}-\d{2}-\d{2}", "yyyy-MM-dd"), (r"\d{1,2}/\d{1,2}/\d{4}", "M/d/yyyy"), (month + r" \d{1,2}, \d{4}", "MMMM d, yyyy"), (r"\d{1,2} " + month + r" \d{4}", "d MMMM yyyy")]
    found = [_parsed(text, p, f) for p, f in formats]
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(*found))))


def _parsed(text: Column, pattern: str, form: str) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.try_to_timestamp(x, F.lit(form)).cast("date"))


def temporal_signal(text: Column) -> Column:
    return text.rlike(r"(?i)\b(?:before|after|since|until|during|between|when|ago|last|next)\b")


def estimated_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(text, F.lit(""))) / 4)).cast("long")


def overlapping_chunks(text: Column, size: int = 4000, overlap: int = 400) -> Column:
    """Pieces of `size` characters, each beginning `overlap` before the last one's end."""
    step = size - overlap
    n = F.greatest(F.ceil((F.length(text) - overlap) / step), F.lit(1))
    return F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda i: F.substring(text, i * step + 1, F.lit(size)))


def packed_chunks(text: Column, most: int = 2000) -> Column:
    """Sections at # and ## headers, their paragraphs packed greedily up to `most` characters."""
    paragraphs = F.filter(F.transform(F.split(text, r"\n\s*\n|\n(?=#{1,2} )"), F.trim), lambda p: p != "")

    def add(done: Column, p: Column) -> Column:
        last = F.element_at(done, -1)
        fits = (F.size(done) > 0) & ~p.rlike("^#{1,2} ") & (F.length(last) + F.length(p) + 2 <= most)
        return F.when(fits, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat(last, F.lit("\n\n"), p)))).otherwise(F.concat(done, F.array(p)))

    return F.aggregate(paragraphs, F.array().cast("array<string>"), add)


def statements(text: Column, least: int = 12) -> Column:
    """The sentences of a chat message that state something: no code blocks, no short pieces, no questions or commands."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)```.*?```", " ")
    command = r"(?i)^(?:please|write|give|show|tell|explain|make|create|fix|help|can you|could you|would you)\b"
    return F.filter(sentences(plain), lambda s: (F.length(s) >= least) & ~s.rlike(r"\?\s*$") & ~s.rlike(command))


def user_turns(text: Column) -> Column:
    """What stands in the user: or human: sections of a transcript."""
    parts = F.split(text, r"(?im)^(?=(?:user|human|assistant|system)\s*:)")
    own = F.filter(parts, lambda p: p.rlike(r"(?i)^(?:user|human)\s*:"))
    return F.array_join(F.transform(own, lambda p: F.regexp_replace(p, r"(?i)^(?:user|human)\s*:\s*|\s+$", "")), "\n")


def session_text(turns: DataFrame) -> DataFrame:
    """session_id and text: the turns that aren't blank, in order, with blank lines between."""
    rows = turns.where(F.trim("text") != "").groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("turn_idx", "text"))).alias("t"))
    return rows.select("session_id", F.array_join(F.transform("t", lambda t: t["text"]), "\n\n").alias("text"))


# ---- tags ----

def pramana(text: Column) -> Column:
    """The means of knowledge that a statement shows."""
    return rules.label(text, rules.PRAMANA, "unknown")


def plain_words(c: Column) -> Column:
    """Letters and digits in lower case, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def pramana_strength(kind: Column) -> Column:
    found = F.element_at(F.create_map(*[F.lit(x) for pair in rules.PRAMANA_STRENGTH.items() for x in pair]), kind)
    return F.coalesce(found, F.lit(rules.PRAMANA_MISSING))


def negation_kind(text: Column) -> Column:
    """none without a cue, else the first kind that matches, else unknown."""
    low = F.lower(text)
    cue = F.lit(False)
    for c in rules.NEGATION_CUES:
        cue = cue | low.contains(c)
    return F.when(~cue, "none").otherwise(rules.label(text, rules.NEGATION, "unknown"))


def vritti(status: Column, confidence: Column, as_history: Column) -> Column:
    """The mode in which a belief is held when it is brought up, as part of a lineage or by itself."""
    return (
        F.when(status == "archived", "nidra").when(status == "ambiguous", "vikalpa").when(status == "disputed", "viparyaya")
        .when(status.isin("superseded", "badhita"), F.when(as_history, "smrti").otherwise("viparyaya"))
        .when(confidence < 0.5, "vikalpa").otherwise("pramana")
    )


_NUMBER = "(\\d+|a|an|one|two|three|four|five|six|seven|eight|nine|ten)"
_UNIT = "(day|week|month|year)s?"


def validity_days(text: Column) -> Column:
    """Days for which a statement says it holds: `for N units` or `the next N units`; null if it doesn't say."""
    pattern = rf"(?i)\b(?:for\s+)?(?:for\s+{_NUMBER}\s+{_UNIT}|the\s+next\s+{_NUMBER}?\s*{_UNIT})\b"
    number = F.lower(F.concat(F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 3)))
    unit = F.lower(F.concat(F.regexp_extract(text, pattern, 2), F.regexp_extract(text, pattern, 4)))
    words = {"a": 1, "an": 1} | {k: v for k, v in rules.NUMBER_WORDS.items() if v <= 10}
    spelt = F.element_at(F.create_map(*[F.lit(x) for pair in words.items() for x in pair]), number)
    n = F.coalesce(spelt, number.try_cast("int"), F.lit(1))
    days = F.element_at(F.create_map(*[F.lit(x) for pair in {"day": 1, "week": 7, "month": 30, "year": 365}.items() for x in pair]), unit)
    return n * days


def valid_until(text: Column) -> Column:
    """The date behind `until`, `through` or `till`, if it is written out; null otherwise."""
    return F.try_element_at(dates(F.regexp_extract(text, r"(?i)\b(?:until|through|till?)\s+([A-Za-z0-9,\s\-/]+)", 1)), F.lit(1))


def valid_at(at: Column, mode: Column, start: Column, end: Column, half_life_days: Column) -> Column:
    """Whether a belief holds at a time: a dated range up to its end, a duration for three half-lives, else always on."""
    begun = start.isNull() | (start <= at)
    lasts = F.timestamp_add("SECOND", (half_life_days * 3 * 86400).cast("int"), start)
    return F.when(mode == "dated_range", begun & (end.isNull() | (at <= end))).when(mode == "duration", begun & (lasts.isNull() | (at <= lasts))).otherwise(F.lit(True) & begun)


def context_compatible(a: Column, b: Column) -> Column:
    """Contexts agree if either is missing or they are equal."""
    return a.isNull() | b.isNull() | (a == b)
