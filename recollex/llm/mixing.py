"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents, in an order shuffled by hash, form a stream of words that is cut into blocks of BLOCK words.
The mix is a sequence of slots of one block each, as many as the targets of all sources hold. Slot k has the golden-ratio
point (k * GOLDEN mod 2^31) / 2^31, which the cumulative targets map to a source. The slots of a source are ranked, and
rank r takes block r of its stream, on a second pass block r less the blocks of a pass; beyond PASSES passes a slot takes
nothing. So the points alone decide how many words a source gives, what they are and where they stand in the mix. As the
points of any range are within a few of their share, each source gives its target but for a few blocks, and
less than one at the end of a pass, and no word is taken more than twice.

Offsets and ranks come from sums over (source, hash range) and (source, run of slots), so that no task holds a source.

Defined results: null and empty texts have no words and take up nothing. A null source is a source of its own, after
all others; a null doc_id is a document like others. Rows that share a doc_id are documents of their own. An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recollex.llm.common import WORD, delete, table, written

WEIGHTS, SHARE_PERCENT, PASSES = (5, 2, 1), 150, 2
BLOCK = 32
GOLDEN, RING = 1327217885, 1 << 31
#: Slots of one run, whose ranks are counted by one task at a time, and bins of the points.
RUN, BINS = 1 << 16, 1 << 12


def sized(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, source, own (the source, so written that null comes last), size, order (the place in the shuffle) and `more` columns."""
    size = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)).cast("long")
    doc_id, source = F.col("doc_id").cast("long"), F.col("source").cast("string")
    own = F.when(source.isNull(), "1").otherwise(F.concat(F.lit("0"), source))
    return docs.select(doc_id.alias("doc_id"), source.alias("source"), own.alias("own"), size.alias("size"), F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")).alias("order"), *more)


def targets(sizes: DataFrame) -> DataFrame:
    """own, source_size, weight and target of each source: weights share SHARE_PERCENT of all words, up to PASSES times a source's.

    With the sources in order of cap to weight, the first whose cap isn't below the share that is left to it and those
    after it fixes the share; that is where sharing the excess again and again ends.
    """
    of = sizes.groupBy("own").agg(F.sum("size").alias("source_size"))
    at = (F.row_number().over(W.orderBy("own")) - 1) % len(WEIGHTS)
    of = of.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), at + 1)).withColumn("cap", PASSES * F.col("source_size"))
    by_need = W.orderBy(F.col("cap") / F.col("weight"), "own")
    before = by_need.rowsBetween(W.unboundedPreceding, -1)
    left = SHARE_PERCENT * F.sum("source_size").over(W.partitionBy()) / F.lit(100.0) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    share = left / F.sum("weight").over(by_need.rowsBetween(0, W.unboundedFollowing))
    of = of.withColumn("share", share)
    fixed = F.min(F.when(F.col("cap") / F.col("weight") >= F.col("share"), F.struct(F.col("cap") / F.col("weight"), F.col("own"), F.col("share").alias("share")))).over(W.partitionBy())
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("weight") * fixed["share"], F.col("cap").cast("double")))
    return of.select("own", "source_size", "weight", target.alias("target"))


def offsets(sizes: DataFrame, *ties: str) -> DataFrame:
    """sizes with part and row, which name a row, and at, the words of its source before it."""
    sizes = sizes.withColumn("part", F.substring("order", 1, 3))
    parts = sizes.groupBy("own", "part").agg(F.sum("size").alias("words"))
    parts = parts.select("own", "part", (F.sum("words").over(W.partitionBy("own").orderBy("part")) - F.col("words")).alias("base"))
    inside = W.partitionBy("own", "part").orderBy("order", "doc_id", "size", *ties)
    rows = sizes.withColumn("row", F.row_number().over(inside)).withColumn("at", F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    return rows.join(parts, ["own", "part"]).withColumn("at", F.col("at") + F.col("base")).drop("base")


def plan(of: DataFrame, block: int = BLOCK) -> DataFrame:
    """For each source: words it is to give, blocks in a pass, and the points from lo to less than hi that are its own."""
    of = of.withColumn("words", F.floor("target").cast("long")).withColumn("blocks", F.ceil(F.col("source_size") / block))
    upto = F.sum("words").over(W.orderBy("own").rowsBetween(W.unboundedPreceding, 0))
    edge = F.floor(upto / F.sum("words").over(W.partitionBy()) * RING).cast("long")
    return of.withColumn("hi", edge).withColumn("lo", F.coalesce(F.lag("hi").over(W.orderBy("own")), F.lit(0)))


def schedule(of: DataFrame, block: int = BLOCK) -> DataFrame:
    """own, slot, rank, block and words of every slot of the mix that takes a block; of: own, source_size and target."""
    spark = of.sparkSession
    of = written(plan(of, block), "plan")
    n = -(-(of.agg(F.sum("words")).first()[0] or 0) // block)
    width = RING // BINS
    edges = of.where("lo < hi").select("own", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))).alias("bin"))
    slots = spark.range(n).select(F.col("id").alias("slot"), ((F.col("id") % RING) * GOLDEN % RING).alias("point"))
    slots = slots.withColumn("bin", F.floor(F.col("point") / width)).join(edges, "bin").where("point >= lo and point < hi")
    slots = slots.select("own", "slot", F.floor(F.col("slot") / RUN).alias("run"))
    runs = slots.groupBy("own", "run").agg(F.count(F.lit(1)).alias("n"))
    runs = written(runs.select("own", "run", (F.sum("n").over(W.partitionBy("own").orderBy("run")) - F.col("n")).alias("base")), "runs")
    place = F.row_number().over(W.partitionBy("own", "run").orderBy("slot")) - 1
    ranked = slots.withColumn("place", place).join(runs, ["own", "run"]).select("own", "slot", (F.col("place") + F.col("base")).alias("rank"))
    taken = ranked.join(of.select("own", "blocks", "source_size"), "own").where(F.col("rank") < PASSES * F.col("blocks"))
    taken = taken.withColumn("block", F.col("rank") % F.col("blocks"))
    return taken.select("own", "slot", "rank", "block", F.least(F.lit(block), F.col("source_size") - F.col("block") * block).cast("long").alias("words"))


def pieces(rows: DataFrame, slots: DataFrame, *columns: str, block: int = BLOCK) -> DataFrame:
    """The mix itself: slot, `columns` of the document, start (its first word of the piece) and words, for each piece of a
    document that a slot takes. rows: own, at, size and the columns."""
    first, last = F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block)
    cut = rows.where("size > 0").select("own", "at", "size", *columns, F.explode(F.sequence(first, last)).alias("block"))
    begin = F.greatest(F.col("at"), F.col("block") * block)
    end = F.least(F.col("at") + F.col("size"), F.col("block") * block + F.col("words"))
    return cut.join(slots.select("own", "slot", "block", "words"), ["own", "block"]).select("slot", *columns, (begin - F.col("at")).alias("start"), (end - begin).alias("words"))


def mix(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (the words of each row that the mix takes) and first_slot, where they begin."""
    sizes = written(sized(docs), "sizes")
    of = written(targets(sizes), "targets")
    rows = written(offsets(sizes), "offsets")
    delete(sizes)
    key = ["own", "part", "row"]
    keyed = rows.select("own", "at", "size", F.struct(*key).alias("key"))
    taken = pieces(keyed, schedule(of, block), "key", block=block).groupBy("key").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    rows = rows.join(taken.select("key.*", "taken", "first_slot"), key, "left").join(of, "own")
    return rows.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot")


def copies(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """docs as the mix takes them, in whole texts: each as often as slots take the middle one of its words.

    A row is named by two hashes of all its columns, so null and repeated ids don't matter; equal rows share their copies.
    A row without words comes as often as the block at its place; rows of a source without any words come once.
    """
    columns = [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]
    values = [v for c in columns for v in (c, c.isNull())]
    key = ["mixed_one", "mixed_two"]
    named = docs.select(F.struct(*columns).alias("mixed_row"), *(F.xxhash64(F.lit(name), *values).alias(name) for name in key), "text", "source", "doc_id")
    sizes = written(sized(named, *key), "sizes")
    of = written(targets(sizes), "targets")
    rows = written(offsets(sizes, *key), "offsets")
    delete(sizes)
    blocks = plan(of, block).select("own", "blocks")
    middle = F.least(F.floor((F.col("at") + F.floor(F.col("size") / 2)) / block), F.col("blocks") - 1)
    times = schedule(of, block).groupBy("own", "block").agg(F.count(F.lit(1)).alias("times"))
    rows = rows.join(blocks, "own").withColumn("block", middle).join(times, ["own", "block"], "left")
    times = F.when(F.col("blocks") == 0, 1).otherwise(F.coalesce("times", F.lit(0)))
    times = rows.groupBy(*key).agg(F.sum(times).alias("mixed_times"), F.count(F.lit(1)).alias("mixed_rows")).where("mixed_times > 0")
    found = named.select("mixed_row", *key).join(times, key).withColumn("mixed_place", F.row_number().over(W.partitionBy(*key).orderBy(*key)))
    share = F.floor(F.col("mixed_times") / F.col("mixed_rows")) + (F.col("mixed_place") <= F.col("mixed_times") % F.col("mixed_rows")).cast("long")
    return found.select("mixed_row", F.explode(F.array_repeat(F.lit(1), share.cast("int")))).select("mixed_row.*")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


#: The same rows: points, ranks and blocks as rows, joined by range.
SQL = f"""
WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS own, md5(coalesce(doc_id::VARCHAR, '')) AS o,
             len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT own, sum(size)::BIGINT AS source_size, 2 * sum(size)::BIGINT AS cap FROM d GROUP BY own),
w AS (SELECT *, [{', '.join(map(str, WEIGHTS))}][1 + (row_number() OVER (ORDER BY own) - 1) % {len(WEIGHTS)}] AS weight FROM s),
l AS (SELECT *, cap / weight AS need, ({SHARE_PERCENT} * sum(source_size) OVER () / 100.0 - coalesce(sum(cap) OVER (ORDER BY cap / weight, own ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY cap / weight, own ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM w),
f AS (SELECT arg_min(share, (need, own)) AS share FROM l WHERE need >= share),
t AS (SELECT own, source_size, least(cap::DOUBLE, coalesce(weight * f.share, cap::DOUBLE)) AS target FROM l LEFT JOIN f ON true),
e AS (SELECT own, source_size, ceil(source_size / {BLOCK})::BIGINT AS blocks, floor((sum(floor(target)::BIGINT) OVER (ORDER BY own))::DOUBLE / (sum(floor(target)::BIGINT) OVER ())::DOUBLE * {RING})::BIGINT AS hi FROM t),
g AS (SELECT *, coalesce(lag(hi) OVER (ORDER BY own), 0) AS lo FROM e),
k AS (SELECT own, blocks, source_size, slot, row_number() OVER (PARTITION BY own ORDER BY slot) - 1 AS rank
      FROM (SELECT i AS slot, (i % {RING}) * {GOLDEN} % {RING} AS point FROM range(coalesce((SELECT ceil(sum(floor(target)::BIGINT) / {BLOCK}) FROM t), 0)::BIGINT) r(i)) JOIN g ON point >= lo AND point < hi),
b AS (SELECT own, slot, (rank % blocks) * {BLOCK} AS a, least((rank % blocks + 1) * {BLOCK}, source_size) AS z FROM k WHERE rank < 2 * blocks),
p AS (SELECT d.*, source_size, target, row_number() OVER () AS id,
             (sum(size) OVER (PARTITION BY own ORDER BY o, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size)::BIGINT AS pos FROM d JOIN t USING (own)),
c AS (SELECT id, sum(least(pos + size, z) - greatest(pos, a))::BIGINT AS taken, min(slot) AS first_slot FROM p JOIN b USING (own) WHERE size > 0 AND a < pos + size AND z > pos GROUP BY id)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, first_slot FROM p LEFT JOIN c USING (id)
"""
