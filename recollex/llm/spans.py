"""Substring dedup by sliding sentence spans.

A sentence, here, ends at a word that ends in . ! ? , ; or : (a closing quote or bracket may follow), before a line break;
and of every GAP words in a row of which none ends one so, that of least hash does, so that text without punctuation is cut
as well and no sentence is longer than GAP words. Where a text is cut depends on the GAP - 1 words before and behind alone,
so a passage that was copied, with its line breaks, from the middle of a sentence into the middle of another is cut alike
in both but for its ends. Of 51 words, those from the 7th to the 44th surely end sentences alike; the first of them that
does is the 13th at the latest, a run from there has 31 words at most and ends in time. So every passage of over 50 words
holds a run in all its copies. From every sentence on, the shortest run of RUN sentences or more that
holds MIN_WORDS words or more is hashed from its words (A-Z in lower case, white space does not count); the hashes of all documents are counted, and the
places of those that occur twice or more are joined. Of each repeated span the place of least (doc_id, sentence) is the
first; every sentence that any other place covers is removed.

Counting, and finding first places, combine before they shuffle, so that a span which a third of all documents hold is one
row a task; places meet the first ones in a plain join, whose large partitions Spark splits. A bitmap of hashed values, of
bounded size, keeps spans that occur once, and documents that lose nothing, out of the later shuffles.

Defined results: null and empty texts have no sentences; a null text stays null. A null doc_id takes no part: its text
is left as it is. Rows that share a doc_id are one document: places in the same position of such rows count as one place,
and each row loses the sentences that its doc_id loses. Texts with fewer sentences or words have no span.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollex.llm import kernels
from recollex.llm.common import bitmap, delete, may_be_in, small_batches, table, written

RUN, MIN_WORDS, GAP = 3, 25, 7
_ENDS = np.zeros(256, dtype=bool)
_ENDS[[ord(c) for c in ".!?,;:"]] = True
_CLOSES = np.zeros(256, dtype=bool)
_CLOSES[[ord(c) for c in "\"')]"]] = True


def _least(hashes: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Whether a word has the least hash of GAP words in a row without a stop; words of equal hash all do."""
    n = len(hashes) - GAP + 1
    if n < 1:
        return np.zeros(len(hashes), dtype=bool)
    least = hashes[:n].copy()
    for k in range(1, GAP):
        np.minimum(least, hashes[k : k + n], out=least)
    before = np.concatenate([[0], np.cumsum(stops)])
    least[before[GAP:] > before[:n]] = 0
    most = np.zeros(len(hashes), np.uint64)
    for k in range(GAP):
        np.maximum(most[k : k + n], least, out=most[k : k + n])
    return most == hashes


def sentences(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends in bytes, first word of each sentence and the end, first sentence of each text and the end, hashes of words)."""
    starts, ends, first = kernels.word_bounds(raw, off)
    n = len(starts)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(1, np.int64), np.zeros(len(off), np.int64), np.zeros(0, np.uint64)
    hashes = kernels.span_hashes(raw, starts, ends, lower=True)
    last = raw[ends - 1]
    stops = _ENDS[last] | (_CLOSES[last] & _ENDS[raw[np.maximum(ends - 2, starts)]])
    lines = np.concatenate([[0], np.cumsum(raw == 10)])
    stops[:-1] |= lines[starts[1:]] > lines[ends[:-1]]
    borders = first[1:]
    stops[borders[borders > 0] - 1] = True
    stops |= _least(hashes, stops)
    words = np.concatenate([[0], np.flatnonzero(stops[:-1]) + 1])
    bounds = np.concatenate([words, [n]])
    return starts[words], ends[bounds[1:] - 1], bounds, np.searchsorted(words, first), hashes


def _sentence_hashes(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each sentence from those of its words, whatever the white space between them."""
    n = np.diff(bounds)
    place = np.arange(len(words)) - np.repeat(bounds[:-1], n)
    scaled = kernels.mix(words + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return kernels.mix(np.add.reduceat(scaled, bounds[:-1]) + n.astype(np.uint64)) if len(n) else words


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for at, end, raw, off in kernels.slices(batch.column(1)):
            _, _, bounds, first, words = sentences(raw, off)
            n = len(bounds) - 1
            until = np.maximum(np.arange(n) + RUN, np.searchsorted(bounds, bounds[:-1] + MIN_WORDS))
            text = np.repeat(np.arange(end - at), np.diff(first))
            place = np.flatnonzero(until <= first[text + 1])
            text, until = text[place], until[place]
            grams = kernels.range_hashes(_sentence_hashes(words, bounds), place, until)
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(ids[at:end][text], pa.int64()), *(pa.array((x - first[text]).astype(np.int32)) for x in (place, until))], ["span", "doc", "place", "until"])


def _removed(docs_at: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n_sentences, n_removed, words_removed, removed (ranges in bytes of UTF-8) and cleaned."""
    for batch in batches:
        column = batch.column("text")
        places = batch.column("places")
        for at, end, raw, off in kernels.slices(column):
            starts, ends, bounds, first, _ = sentences(raw, off)
            rows = []
            for r in range(end - at):
                text = raw[off[r] : off[r + 1]].tobytes()
                lo, hi = int(first[r]), int(first[r + 1])
                gone = np.zeros(hi - lo, dtype=bool)
                for p in places[at + r].as_py() or ():
                    gone[p["place"] : p["until"]] = True
                null = not column[at + r].is_valid
                if not gone.any():
                    rows.append((hi - lo, 0, 0, "", None if null else text.decode()))
                    continue
                out, to, ranges = [], 0, []
                for s in np.flatnonzero(gone) + lo:
                    a = int(starts[s] - off[r])
                    b = int((starts[s + 1] if s + 1 < hi else off[r + 1]) - off[r])  # the space behind goes too
                    out.append(text[to:a])
                    to = b
                    ranges.append((a, int(ends[s] - off[r])))
                out.append(text[to:])
                words = int((bounds[lo + 1 : hi + 1] - bounds[lo:hi])[gone].sum())
                rows.append((hi - lo, int(gone.sum()), words, ",".join(f"{a}:{b}" for a, b in ranges), b"".join(out).decode()))
            n, removed, words, ranges, cleaned = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([*(c.slice(at, end - at) for c in batch.columns[:docs_at]), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(words, pa.int64()), pa.array(ranges, pa.string()), pa.array(cleaned, pa.string())], [*batch.schema.names[:docs_at], "n_sentences", "n_removed", "words_removed", "removed", "cleaned"])


def repeated_places(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc, places) of the non-first places of repeated spans; and the ids of these documents."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    spans = written(rows.mapInArrow(lambda it: kernels.tidy(_spans(it)), "span long, doc long, place int, until int"), "spans")
    counted = written(spans.groupBy("span").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("span"), "repeated")
    found = written(may_be_in(spans, "span", bitmap(counted, "span")), "places")
    delete(spans, counted)
    at = F.struct("doc", "place")
    firsts = found.groupBy("span").agg(F.min(at).alias("first"), F.max(at).alias("last")).where("first < last").select("span", "first")
    firsts = written(firsts, "firsts")  # so that both sides of the join come from shuffles of their own, which Spark can split
    later = found.join(firsts, "span").where((F.col("doc") != F.col("first.doc")) | (F.col("place") != F.col("first.place")))
    later = written(later.groupBy("doc").agg(F.sort_array(F.collect_set(F.struct("place", "until"))).alias("places")), "later")
    delete(found, firsts)
    return later, later.select("doc")


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, n_removed, words_removed, removed and cleaned (the text that stays) of each row.

    Its texts go to Python when the caller computes it, so the session keeps the smaller number of rows in a batch.
    """
    small_batches(docs.sparkSession)
    later, named = repeated_places(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bits = bitmap(named, "doc")
    schema = "doc_id long, n_sentences long, n_removed long, words_removed long, removed string, cleaned string"
    touched = may_be_in(rows, "doc_id", bits).join(later.withColumnRenamed("doc", "doc_id"), "doc_id", "left")
    free = may_be_in(rows, "doc_id", bits, holds=False).withColumn("places", F.lit(None).cast("array<struct<place:int,until:int>>"))
    columns = ["doc_id", "text", "places"]

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return kernels.tidy(_removed(1, batches))

    return touched.select(columns).mapInArrow(removed, schema).unionByName(free.select(columns).mapInArrow(removed, schema))


def digest(c: Column) -> Column:
    return F.sha2(F.coalesce(c, F.lit("")).cast("binary"), 256)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_sentences", "n_removed", "words_removed", "removed", digest(F.col("cleaned")).alias("cleaned_sha256"))
