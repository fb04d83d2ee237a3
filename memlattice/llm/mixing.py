"""Mixing sources to target weights: a golden-ratio schedule of slots over cumulative weights, joined to token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import NOT_BLANK, Scratch, broadcast_if_small

#: 2^32 divided by the golden ratio, rounded to an odd integer: multiples modulo 2^32 form the low-discrepancy points.
GOLDEN = 2654435769
#: Points and intervals meet in bins of this width.
_BIN_STEP = 1 << 20
_BIN = (1 << 32) - _BIN_STEP
#: About as many rows make one part of a source in the two-step prefix sums; more, once there are many parts.
PART_ROWS = 256


def golden_point(j: Column) -> Column:
    """j * GOLDEN modulo 2^32, by halves of j, so that no product leaves 64 bits."""
    low, high = j.bitwiseAND(F.lit(0xFFFF)), F.shiftright(j, 16).bitwiseAND(F.lit(0xFFFF))
    return (low * F.lit(GOLDEN) + (high * F.lit(GOLDEN)).bitwiseAND(F.lit(0xFFFF)) * F.lit(0x10000)).bitwiseAND(F.lit(2**32 - 1))


def ranked_sources(sized: DataFrame) -> DataFrame:
    """(source, source_size, rank, weight): sources by code point, null last, weigh 1, 2, 3, repeating."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    return ranked.withColumn("weight", (F.col("rank") % 3 + 1).cast("long"))


def with_targets(ranked: DataFrame, cap: int = 3) -> DataFrame:
    """ranked with target: shares of the whole size by weight, none above cap times its source's size.

    Each round holds the sources above their cap at it and reshares the rest by weight, until none is above; only
    sums reach the driver.
    """
    most = F.col("source_size") * cap
    total, weights = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    held, above = F.lit(False), 0
    left, weight = total, weights
    while True:
        share = F.col("weight") * F.lit(float(left)) / F.lit(float(weight or 1))
        now = held | (share > most)
        sums = ranked.filter(now).agg(F.coalesce(F.sum(most), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0)), F.count(F.lit(1))).first()
        if sums[2] == above:
            return ranked.withColumn("target", F.when(held, most.cast("double")).otherwise(share))
        held, above = now, sums[2]
        left, weight = total - sums[0], weights - sums[1]


def mix_sources(docs: DataFrame, block: int = 4096, cap: int = 3) -> DataFrame:
    """What the mix takes of each document: doc_id, source, size, source_size, target, taken, first_slot.

    Slot j of the schedule lies at the point j * GOLDEN modulo 2^32 and goes to the source whose cumulative share of
    the targets holds that point.  A source's slots are ranked; its documents, shuffled by the md5 of their id, make
    one stream cut into blocks of equal size (the last one shorter), and slot rank r plays block r modulo their
    number, so that a source is repeated once its blocks are used up.  A source's last slot takes only what its target
    still lacks.  Slots beyond a source's need are empty.  first_slot is where a document first plays, null if never.

    Null sources are one source; null or empty texts have size 0 and take nothing; repeated rows are rows of their own,
    ordered by a hash of id and text.  Equal rows are interchangeable.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    size = F.coalesce(F.regexp_count("text", F.lit(NOT_BLANK)), F.lit(0)).cast("long")
    spin = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    sized = scratch.save(docs.select("doc_id", "source", size.alias("size"), spin.alias("spin"), F.xxhash64("text").alias("tie")), "sized")
    goal = scratch.save(with_targets(scratch.save(ranked_sources(sized), "ranked"), cap), "targets")
    goal = goal.withColumns({"want": F.round("target").cast("long")}).withColumn("n_blocks", F.ceil(F.col("source_size") / block).cast("long"))
    # passes over whole blocks, then whole blocks, then a part of one
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("want") / F.col("source_size"))).otherwise(0).cast("long")
    goal = goal.withColumn("passes", passes).withColumn("rest", F.col("want") - F.col("passes") * F.coalesce("source_size", F.lit(0)))
    goal = goal.withColumn("need", F.col("passes") * F.col("n_blocks") + F.ceil(F.col("rest") / block).cast("long"))

    # two-step prefix sums: parts by the leading hex digits of the shuffle key
    rows = sized.count()
    digits = 0
    while rows / 16**digits > max(PART_ROWS, 8 * 16**digits):
        digits += 1
    parted = sized.withColumn("part", F.substring("spin", 1, digits) if digits else F.lit(""))
    sums = parted.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    before = sums.withColumn("before", F.sum("part_size").over(W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1))) if digits else sums.withColumn("before", F.lit(0).cast("long"))
    before = before.select(F.col("source").alias("b_source"), F.col("part").alias("b_part"), F.coalesce("before", F.lit(0)).alias("before"))
    inside = W.partitionBy("source", "part").orderBy("spin", "doc_id", "tie", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = parted.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(before, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("part") == F.col("b_part"))).withColumn("start", F.col("before") + F.col("inside"))
    small_goal = broadcast_if_small(goal)
    placed = placed.drop("b_source", "b_part", "before", "inside", "part").join(small_goal.select(F.col("source").alias("g_source"), "rank", "source_size", "target"), F.col("source").eqNullSafe(F.col("g_source"))).drop("g_source")
    placed = scratch.save(placed.withColumn("row", F.struct("doc_id", "spin", "tie", "start")), "placed")

    n_slots = goal.agg(F.sum("need")).first()[0] or 0
    pieces = placed.filter("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))))
    pieces = pieces.select("row", "rank", "block", F.greatest("start", F.col("block") * block).alias("lo"), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block).alias("hi"))
    plays = slots(spark, goal, n_slots, block, scratch)
    held = pieces.join(plays, ["rank", "block"])
    # a source's last slot ends within its block
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("hi"), F.col("cut")) - F.col("lo"))
    took = held.withColumn("took", F.col("full") * (F.col("hi") - F.col("lo")) + part).filter("took > 0")
    took = took.groupBy("row").agg(F.sum("took").alias("taken"), F.min("slot").alias("first_slot"))
    out = placed.join(took.withColumnRenamed("row", "t_row"), F.col("row").eqNullSafe(F.col("t_row")), "left")
    return out.select("doc_id", "source", "size", F.col("source_size").cast("long").alias("source_size"), "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot")


def slots(spark: SparkSession, goal: DataFrame, n_slots: int, block: int, scratch: Scratch) -> DataFrame:
    """How often each block plays: (rank, block, full, cut, slot).  full counts whole plays; cut is where the last, partial one ends."""
    share = W.orderBy("rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.partitionBy()
    edges = goal.filter("need > 0").withColumn("upto", F.sum("need").over(share)).withColumn("all", F.sum("need").over(whole))
    scale = F.lit(float(2**32))
    edges = edges.select("rank", "need", "n_blocks", "passes", "rest", F.floor((F.col("upto") - F.col("need")) * scale / F.col("all")).alias("lo"), F.floor(F.col("upto") * scale / F.col("all")).alias("hi"))
    edges = scratch.save(edges, "edges")
    bins = edges.filter("hi > lo").withColumn("bin", F.explode(F.sequence(F.col("lo").bitwiseAND(_BIN), (F.col("hi") - 1).bitwiseAND(_BIN), F.lit(_BIN_STEP))))
    # an interval of width w is hit within 2.62 / w points of such a sequence, so three times the need is enough; more, should it not be
    step, n_points = 4096, 3 * n_slots + 64 * max(1, goal.count())
    while True:
        points = spark.range(n_points).withColumn("point", golden_point(F.col("id")))
        dealt = points.join(bins, (F.col("point").bitwiseAND(_BIN) == F.col("bin")) & (F.col("point") >= F.col("lo")) & (F.col("point") < F.col("hi")))
        # ranks of a source's slots in two steps, as one source may hold most of them
        dealt = scratch.save(dealt.select("id", "rank").withColumn("run", F.floor(F.col("id") / step)), f"slots-{n_points}")
        got = dealt.groupBy("rank").agg(F.count(F.lit(1)).alias("got"))
        if edges.filter("hi > lo").join(got, "rank", "left").filter("got is null or got < need").isEmpty():
            break
        n_points *= 2
    runs = dealt.groupBy("rank", "run").count().withColumn("before", F.coalesce(F.sum("count").over(W.partitionBy("rank").orderBy("run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("count")
    nth = dealt.withColumn("inside", F.row_number().over(W.partitionBy("rank", "run").orderBy("id")) - 1).join(runs, ["rank", "run"]).select("rank", "id", (F.col("before") + F.col("inside")).alias("nth"))
    nth = nth.join(edges.select("rank", "need", "n_blocks", "passes", "rest"), "rank").filter("nth < need")
    last = (F.col("nth") == F.col("need") - 1) & (F.col("rest") > 0)
    at = F.pmod(F.col("nth"), F.col("n_blocks"))
    return nth.select("rank", at.alias("block"), "id", last.alias("last"), "rest").groupBy("rank", "block").agg(
        F.sum(F.when(F.col("last"), 0).otherwise(1)).alias("full"), F.coalesce(F.max(F.when(F.col("last"), F.col("rest"))), F.lit(0)).alias("cut"), F.min("id").alias("slot")
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS spin FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight FROM sources
), ordered AS (
  SELECT *, sum(source_size) OVER ()::BIGINT AS total,
         coalesce(sum(3 * source_size) OVER (ORDER BY 3.0 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS full_before,
         sum(weight) OVER (ORDER BY 3.0 * source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS weight_left
  FROM ranked
), level AS (
  SELECT total - full_before AS rest, weight_left FROM ordered
  WHERE weight * (total - full_before)::DOUBLE / weight_left::DOUBLE <= 3 * source_size ORDER BY 3.0 * source_size / weight, source LIMIT 1
), goal AS (
  SELECT r.source, r.source_size, least(r.weight * l.rest::DOUBLE / l.weight_left::DOUBLE, (3 * r.source_size)::DOUBLE) AS target FROM ranked r, level l
), placed AS (
  SELECT s.doc_id, s.size, g.source_size, g.target, round(g.target)::BIGINT AS want,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.spin, s.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
       (CASE WHEN size = 0 THEN 0 ELSE (want // source_size) * size + greatest(0, least(start + size, want % source_size) - start) END)::BIGINT AS taken
FROM placed
"""
