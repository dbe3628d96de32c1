"""MinHash near-dedup by SetSketch registers: exponentially spaced truncated minima.

Every text's shingle set gives REGISTERS registers. Register i is floor(1 - log_b x), cut to one byte, of the least
x = -ln(1 - h_i) / a over the set's elements, h_i being a hash in [0, 1). The greater of two sets' registers is the
register of their union, and equal registers are likelier the more two sets overlap. Bands of ROWS registers make
buckets; within a bucket the documents are held against its leader, pairs whose Jaccard similarity, estimated from all
registers together by maximum likelihood, is clearly too low are left, and the rest is confirmed on the full sets.
What buckets still hold in separate components is then compared member by member, so no partner is dropped.

At a similarity of 0.8 a register agrees with probability 0.8156 (b = 1.2), so a pair shares no bucket with
probability (1 - 0.8156^6)^40 < 1e-6; the likelihood estimate has a deviation of about 0.025 there and MARGIN is 0.13.

Defined results: texts without words (null, empty) have no shingles and link with nothing. Equal sets are one group
whose least doc_id stands for it. Rows that share a doc_id are one document: it is linked if any of its texts is. A null
doc_id takes no part: its row comes back with a null component and is kept. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollex.llm import kernels
from recollex.llm.common import bitmap, delete, may_be_in, table, written
from recollex.llm.components import components

SHINGLE_WORDS = 5
PERCENT = 80
REGISTERS, ROWS = 240, 6
B, A = 1.2, 20.0
MARGIN = 0.13

_rng = np.random.default_rng(20240607)
_MUL = (_rng.integers(0, 1 << 31, REGISTERS, dtype=np.uint64) * 2 + 1).astype(np.uint32)
_ADD = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint64).astype(np.uint32)


def sketch(hashes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Registers (sets x REGISTERS, one byte each) of consecutive non-empty runs of element hashes that begin at firsts."""
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.empty((len(firsts), REGISTERS), dtype=np.uint32)
    for i in range(REGISTERS):
        z = low * _MUL[i] + _ADD[i]
        z ^= z >> np.uint32(16)
        z *= np.uint32(0x85EBCA6B)
        least[:, i] = np.minimum.reduceat(z, firsts)
    x = -np.log1p(-(least + 0.5) / 2.0**32) / A
    return np.clip(np.floor(1 - np.log(x) / np.log(B)), 0, 255).astype(np.uint8)


def shingle_hashes(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashes with repeats, offsets by row) for runs of rows: k-word shingles, or one of all words if fewer."""
    for at, end, raw, off in kernels.slices(texts):
        starts, ends, first = kernels.word_bounds(raw, off)
        words = kernels.span_hashes(raw, starts, ends, lower=True)
        grams = kernels.gram_hashes(words, k)
        n = np.diff(first)
        full = np.maximum(n - k + 1, 0)
        sizes = np.where(n > 0, np.maximum(full, 1), 0)
        to = np.concatenate([[0], np.cumsum(sizes)])
        out = np.empty(to[-1], dtype=np.uint64)
        if full.any():
            rows = np.repeat(np.arange(len(n)), full)
            place = np.arange(len(rows)) - np.repeat(np.cumsum(full) - full, full)
            out[to[rows] + place] = grams[first[rows] + place]
        for r in np.flatnonzero((n > 0) & (full == 0)):
            out[to[r]] = kernels.gram_hashes(words[first[r] : first[r + 1]], int(n[r]))[0]
        yield at, out, to


def _sketched(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for at, h, to in shingle_hashes(batch.column(1), k):
            n = len(to) - 1
            held = np.flatnonzero(np.diff(to))
            size, key1, key2 = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            for r in held:
                own = np.unique(h[to[r] : to[r + 1]])
                size[r], key1[r], key2[r] = len(own), own.sum(), np.bitwise_xor.reduce(kernels.mix(own))
            registers: list[bytes | None] = [None] * n
            if len(held):
                for r, x in zip(held, sketch(h, to[:-1][held]), strict=True):
                    registers[r] = x.tobytes()
            yield pa.RecordBatch.from_arrays(
                [ids.slice(at, n), pa.array(size), pa.array(key1.view(np.int64)), pa.array(key2.view(np.int64)), pa.array(registers, pa.binary())],
                ["doc_id", "n_shingles", "key1", "key2", "registers"],
            )


def sketches(docs: DataFrame, k: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, n_shingles, key1 and key2 (128 bits that equal sets share) and registers of each row's shingle set."""
    schema = "doc_id long, n_shingles long, key1 long, key2 long, registers binary"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lambda it: kernels.tidy(_sketched(k, it)), schema)


def _sets(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for at, h, to in shingle_hashes(batch.column(1), k):
            own = [np.unique(h[to[r] : to[r + 1]]) for r in range(len(to) - 1)]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)
            values = pa.array(np.concatenate(own).view(np.int64) if own else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([ids.slice(at, len(own)), pa.ListArray.from_arrays(pa.array(ends), values)], ["doc", "shingles"])


def _codes(registers: np.ndarray) -> np.ndarray:
    """Each band's ROWS registers as one number."""
    out = np.zeros((len(registers), REGISTERS // ROWS), np.int64)
    for i in range(ROWS):
        out = (out << 8) | registers[:, i::ROWS]
    return out


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        registers = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, REGISTERS)
        bands = REGISTERS // ROWS
        value = _codes(registers) | (np.arange(bands, dtype=np.int64) << (8 * ROWS))
        yield pa.RecordBatch.from_arrays([pa.array(value.reshape(-1)), pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), bands))], ["bucket", "doc"])


def _ahead(x: np.ndarray) -> np.ndarray:
    """The chance that one set's register exceeds the other's, x being u - vJ."""
    return -np.log1p(-x * (B - 1) / B) / np.log(B)


def _log_likelihood(n1: np.ndarray, n2: np.ndarray, ahead: np.ndarray, behind: np.ndarray, j: np.ndarray | float) -> np.ndarray:
    """Of a similarity j, given the sizes and how many registers of the first set are greater and smaller."""
    u, v = n1 / (n1 + n2), n2 / (n1 + n2)
    p, q = _ahead(np.maximum(u - v * j, 1e-12)), _ahead(np.maximum(v - u * j, 1e-12))
    return ahead * np.log(np.maximum(p, 1e-12)) + behind * np.log(np.maximum(q, 1e-12)) + (REGISTERS - ahead - behind) * np.log(np.maximum(1 - p - q, 1e-12))


def estimate(n1: np.ndarray, n2: np.ndarray, ahead: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """The Jaccard similarity of greatest likelihood, which has a single peak: by golden sections."""
    lo, hi = np.zeros(len(n1)), np.minimum(n1, n2) / np.maximum(n1, n2)
    golden = (5**0.5 - 1) / 2
    for _ in range(24):
        a, b = hi - golden * (hi - lo), lo + golden * (hi - lo)
        right = _log_likelihood(n1, n2, ahead, behind, b) > _log_likelihood(n1, n2, ahead, behind, a)
        lo, hi = np.where(right, a, lo), np.where(right, hi, b)
    return (lo + hi) / 2


def may_reach(n1: np.ndarray, n2: np.ndarray, ahead: np.ndarray, behind: np.ndarray, percent: int) -> np.ndarray:
    """Whether the similarity of greatest likelihood is percent less MARGIN or more: the likelihood still rises there."""
    j, step = percent / 100 - MARGIN, 1e-4
    rises = _log_likelihood(n1, n2, ahead, behind, j + step) > _log_likelihood(n1, n2, ahead, behind, j - step)
    return rises & (np.minimum(n1, n2) >= j * np.maximum(n1, n2))


def _estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        r1, r2 = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, REGISTERS) for c in ("r1", "r2"))
        n1, n2 = (batch.column(c).to_numpy().astype(float) for c in ("n1", "n2"))
        j = estimate(n1, n2, (r1 > r2).sum(1), (r1 < r2).sum(1))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(j)], ["a", "b", "estimate"])


def _likely(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) those whose similarity may reach percent, by size and by the likelihood of all registers."""
    one = held.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("n1"), F.col("registers").alias("r1"))
    two = held.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("n2"), F.col("registers").alias("r2"))
    fits = 100 * F.least("n1", "n2") >= percent * F.greatest("n1", "n2")
    rows = pairs.join(one, "a").join(two, "b").where(fits).select("a", "b", "n1", "n2", "r1", "r2")
    return rows.mapInArrow(_estimated, "a long, b long, estimate double").where(F.col("estimate") >= percent / 100 - MARGIN)


def jaccard_reaches(x: Column, y: Column, percent: int) -> Column:
    both = F.size(F.array_intersect(x, y))
    return 100 * both >= percent * (F.size(x) + F.size(y) - both)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) those whose full sets are similar enough, as edges (u, v)."""
    one = sets.select(F.col("doc").alias("a"), F.col("shingles").alias("s1"))
    two = sets.select(F.col("doc").alias("b"), F.col("shingles").alias("s2"))
    return pairs.select("a", "b").join(one, "a").join(two, "b").where(jaccard_reaches(F.col("s1"), F.col("s2"), percent)).select(F.col("a").alias("u"), F.col("b").alias("v")).distinct()


def _candidates(run: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents of one run (bucket, i, j, side, doc, component, n_shingles, registers): the ids, and the places of pairs of
    different components whose first common band is this one and which may be similar enough.

    Sides are those of _dealt: members of the largest component (0), and others of one block (1) or of a second one (2).
    """
    side, doc, comp, n = (run.column(c).to_numpy() for c in ("side", "doc", "component", "n_shingles"))
    bucket, i = (run.column(c)[0].as_py() for c in ("bucket", "i"))
    r = np.frombuffer(b"".join(run.column("registers").to_pylist()), np.uint8).reshape(len(doc), REGISTERS)
    band = bucket >> (8 * ROWS)
    codes = _codes(r)[:, :band]
    firsts, seconds = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    open_: list[tuple[np.ndarray, ...]] = []

    def judge() -> None:
        if open_:
            first, second, ahead, behind = (np.concatenate(x) for x in zip(*open_, strict=True))
            likely = may_reach(n[first].astype(float), n[second].astype(float), ahead, behind, percent)
            firsts.append(first[likely])
            seconds.append(second[likely])
            open_.clear()

    pairs, ones, against = 0, np.flatnonzero(side == 1), np.flatnonzero(side != 1)
    for place, a in enumerate(ones):
        later = np.concatenate([against, ones[place + 1 :]]) if i == 0 else against
        later = later[(comp[later] != comp[a]) & (100 * np.minimum(n[later], n[a]) >= percent * np.maximum(n[later], n[a]))]
        if band:
            later = later[(codes[later] != codes[a]).all(1)]
        if len(later):
            open_.append((np.full(len(later), a), later, (r[a] > r[later]).sum(1), (r[a] < r[later]).sum(1)))
            pairs += len(later)
            if pairs >= 1 << 15:
                judge()
                pairs = 0
    judge()
    return doc, np.concatenate(firsts), np.concatenate(seconds)


def _with_candidates(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for run in kernels.sorted_runs(batches, 3):
        doc, a, b = _candidates(run, percent)
        found = np.unique(doc[np.concatenate([a, b])])
        if len(found):
            yield pa.RecordBatch.from_arrays([*(pa.array(np.full(len(found), run.column(c)[0].as_py(), np.int64)) for c in ("bucket", "i", "j")), pa.array(found)], ["bucket", "i", "j", "doc"])


def _links_of_run(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Confirmed links; a pair whose components a link of this run has already joined needs no look."""
    for run in kernels.sorted_runs(batches, 3):
        doc, a, b = _candidates(run, percent)
        if not len(a):
            continue
        whole = run.column("shingles").combine_chunks()
        ends, values = whole.offsets.to_numpy(), whole.values.to_numpy()
        sets = [values[ends[x] : ends[x + 1]] for x in range(len(doc))]
        root = {c: c for c in run.column("component").to_pylist()}
        comp = run.column("component").to_pylist()

        def find(c: int, root: dict[int, int] = root) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        u, v = [], []
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            cx, cy = find(comp[x]), find(comp[y])
            if cx == cy:
                continue
            both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                root[max(cx, cy)] = min(cx, cy)
                u.append(doc[x])
                v.append(doc[y])
        if u:
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


#: Members of a bucket that are dealt as one block, on average, and the shingles of one block.
BLOCK, BLOCK_SHINGLES = 2048, 4_000_000


def _dealt(named: DataFrame) -> DataFrame:
    """The members (bucket, doc, component, n_shingles) of buckets that hold several components, dealt into runs (bucket, i, j).

    Members of a bucket's largest component need not meet each other. They are blocks i, the others are blocks j, and a
    run holds one of each: its side 1 is held against its side 0 and, if i = 0, against itself. Runs of i < 0 hold two
    different blocks of the others, sides 1 and 2. A bucket of up to BLOCK members on either side is one run, to which
    each member goes once; beyond that a member goes to as many runs as the other side has blocks.
    """
    per = named.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
    of = per.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.max(F.struct("n", "s", "component")).alias("top")).where(F.col("n") > F.col("top.n"))

    def blocks(n: Column, s: Column) -> Column:
        return F.greatest(F.ceil(n / BLOCK), F.ceil(s / BLOCK_SHINGLES)).cast("long")

    rest = blocks(F.col("n") - F.col("top.n"), F.col("s") - F.col("top.s"))
    of = of.select("bucket", F.col("top.component").alias("most"), blocks(F.col("top.n"), F.col("top.s")).alias("bi"), rest.alias("bj"))
    rows = named.join(of, "bucket")
    own = lambda n: F.pmod(F.xxhash64("doc"), n)
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    run = lambda i, j, side: F.struct(i.cast("long").alias("i"), j.cast("long").alias("j"), F.lit(side).alias("side"))
    one = F.transform(upto(F.col("bj")), lambda j: run(own(F.col("bi")), j, 0))
    two = F.concat(
        F.transform(upto(F.col("bi")), lambda i: run(i, own(F.col("bj")), 1)),
        F.transform(
            F.filter(upto(F.col("bj")), lambda j: j != own(F.col("bj"))),
            lambda j: F.when(j > own(F.col("bj")), run(-1 - own(F.col("bj")), j, 1)).otherwise(run(-1 - j, own(F.col("bj")), 2)),
        ),
    )
    rows = rows.withColumn("run", F.explode(F.when(F.col("component") == F.col("most"), one).otherwise(two)))
    return rows.select("bucket", "run.i", "run.j", "run.side", "doc", "component", "n_shingles")


def _remaining_links(docs: DataFrame, members: DataFrame, comps: DataFrame, held: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (u, v) between components that some bucket still holds apart: see _dealt.

    Members meet first by registers alone; the full sets are brought only for documents that may have a partner, and only
    confirmed links leave the tasks.
    """
    registers = held.select(F.col("doc_id").alias("doc"), "registers")
    named = members.join(comps.select(F.col("node").alias("doc"), "component"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    apart = written(_dealt(named.join(held.select(F.col("doc_id").alias("doc"), "n_shingles"), "doc")), "apart")

    def together(rows: DataFrame, *more: str) -> DataFrame:
        rows = rows.select("bucket", "i", "j", "side", "doc", "component", "n_shingles", "registers", *more)
        return rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "doc")

    likely = together(apart.join(registers, "doc")).mapInArrow(lambda it: kernels.tidy(_with_candidates(percent, it)), "bucket long, i long, j long, doc long")
    likely = written(likely, "likely")
    lacking = likely.select("doc").distinct().join(sets, "doc", "left_anti")
    more = _full_sets(docs, lacking, k)
    full = sets.unionByName(more).join(likely.select("doc").distinct(), "doc", "left_semi")
    rows = apart.join(likely, ["bucket", "i", "j", "doc"], "left_semi").join(registers, "doc")
    keys = ["doc", "n_shingles"]
    rows = rows.join(full.withColumn("n_shingles", F.size("shingles").cast("long")), keys)
    found = written(together(rows, "shingles").mapInArrow(lambda it: kernels.tidy(_links_of_run(percent, it)), "u long, v long"), "edges")
    delete(apart, likely, more)
    return found


def _full_sets(docs: DataFrame, named: DataFrame, k: int) -> DataFrame:
    """(doc, shingles): the full sets of the named documents, made anew from their texts; few other texts are shuffled."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"))
    named = written(named, "named")
    texts = may_be_in(texts, "doc", bitmap(named, "doc")).join(named.distinct(), "doc").select("doc", "text")
    found = written(texts.mapInArrow(lambda it: kernels.tidy(_sets(k, it)), "doc long, shingles array<bigint>"), "sets")
    delete(named)
    return found


def near_duplicates(docs: DataFrame, k: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs (doc_id, text)."""
    all_sets = written(sketches(docs, k), "sketches")
    groups = all_sets.where("n_shingles > 0 and doc_id is not null").groupBy("key1", "key2")
    groups = groups.agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.max("n_shingles").alias("n_shingles"), F.max("registers").alias("registers"))
    groups = written(groups, "representatives")
    held = groups.select("doc_id", "n_shingles", "registers")

    buckets = held.select("doc_id", "registers").mapInArrow(_buckets, "bucket long, doc long")
    leads = buckets.groupBy("bucket").agg(F.min("doc").alias("lead"))
    led = written(buckets.join(leads, "bucket").where("doc > lead"), "buckets")
    members = led.select("bucket", "doc").unionByName(led.select("bucket", F.col("lead").alias("doc")).distinct())
    star = led.select(F.col("lead").alias("a"), F.col("doc").alias("b")).distinct()
    star = written(_likely(star, held, percent), "pairs")
    sets = _full_sets(docs, star.select(F.explode(F.array("a", "b")).alias("doc")).distinct(), k)
    edges = written(_confirmed(star, sets, percent), "edges")
    comps = components(edges)
    rest = _remaining_links(docs, members, comps, held, sets, k, percent)
    if not rest.isEmpty():
        delete(comps)
        comps = components(edges.unionByName(rest))
    delete(led, star, sets, edges, rest)

    copies = groups.where("copies > 1").select("key1", "key2", F.col("doc_id").alias("rep"))
    rows = all_sets.select("doc_id", "n_shingles", "key1", "key2").join(copies, ["key1", "key2"], "left")
    linked = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id"))
    rows = rows.withColumn("node", linked).join(comps, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=4)


#: All pairs that share a shingle, counted; for small tables.
SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 2, 2)), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM g),
l AS (SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS u, doc_id AS v FROM g UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u),
c AS (SELECT u AS doc_id, min(v) AS component_id FROM r GROUP BY u)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM g JOIN c USING (doc_id)
"""
