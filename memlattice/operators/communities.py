"""Communities by modularity: local moves in rounds, contraction to a weighted graph, and what each community is like."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import Rounds, small

#: Rounds of moves within a level, and levels, at most; a round counts if it raises modularity by this much.
MOVES, LEVELS, GAIN = 12, 10, 1e-5


def modularity(ways: DataFrame, labels: DataFrame) -> float:
    """Newman's modularity of saved labels (node, c) on ways (src, dst, w), which has both directions; loops count once, with 2w.

    Labels of at most LABELS nodes travel, so that the ways are not shuffled to them.
    """
    at = lambda x: small(labels).select(F.col("node").alias(x), F.col("c").alias(f"c_{x}"))
    inside = ways.join(at("src"), "src").join(at("dst"), "dst").groupBy("c_src").agg(F.sum("w").alias("k"), F.sum(F.when(F.col("c_src") == F.col("c_dst"), F.col("w")).otherwise(0.0)).alias("inside"))
    row = inside.agg(F.sum("k").alias("m"), F.sum("inside").alias("inside"), F.sum(F.col("k") * F.col("k")).alias("squares")).first()
    return 0.0 if not row["m"] else row["inside"] / row["m"] - row["squares"] / row["m"] ** 2


def _moves(rounds: Rounds, ways: DataFrame) -> tuple[DataFrame, float]:
    """Labels (node, c) after rounds in which nodes join the neighbouring community that gains most, and their modularity.

    Half of the nodes, another half in each round, may move at once, so that two nodes don't swap places for ever.
    The labels with the best modularity seen are returned.
    """
    degree = rounds.save(ways.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k")))
    m2 = degree.agg(F.sum("k")).first()[0]
    labels = best = rounds.save(degree.select("node", F.col("node").alias("c")))
    top = modularity(ways, labels)
    idle = 0
    for k in range(MOVES):
        known = labels.join(degree, "node")
        total = known.groupBy("c").agg(F.sum("k").alias("total"))
        link = ways.filter("src <> dst").join(small(labels).select(F.col("node").alias("dst"), F.col("c").alias("near")), "dst").groupBy(F.col("src").alias("node"), F.col("near")).agg(F.sum("w").alias("w"))
        own = known.select("node", F.col("c").alias("near"), F.lit(0.0).alias("w"))  # also where no neighbour is in it
        choices = link.union(own.select("node", "near", "w")).groupBy("node", "near").agg(F.sum("w").alias("w")).join(known, "node").join(total.withColumnRenamed("c", "near"), "near")
        rest = F.col("total") - F.when(F.col("near") == F.col("c"), F.col("k")).otherwise(0.0)
        gain = F.col("w") - F.col("k") * rest / F.lit(m2)
        # ties go to the community a node is in, then to the least
        pick = F.max(F.struct(F.round(gain, 9).alias("gain"), (F.col("near") == F.col("c")).alias("stays"), F.col("near"))).alias("pick")
        moved = choices.groupBy("node", "c").agg(pick)
        turn = F.pmod(F.xxhash64("node", F.lit(k // 2)), F.lit(2)) == k % 2
        labels = rounds.save(moved.select("node", F.when(turn, F.col("pick.near")).otherwise(F.col("c")).alias("c")))
        q = modularity(ways, labels)
        idle = 0 if q > top + GAIN else idle + 1
        if q > top:
            top, best = q, labels
        if idle == 3:
            break
    return best, top


def louvain(edges: DataFrame) -> DataFrame:
    """(item_id, community) of the nodes of undirected edges (src, dst), by levels of modularity; communities are named by
    their least node.

    A level moves nodes between communities and then makes each community a node of a smaller weighted graph; levels
    end when one raises modularity no more.  Parallel edges count once, loops not at all; null ends are left out; no
    edges give no rows.  Moves are sums for each node and neighbouring community, added up before they are shuffled.
    """
    rounds = Rounds(edges.sparkSession)
    tidy = edges.filter("src is not null and dst is not null and src <> dst")
    ways = rounds.save(tidy.select("src", "dst").union(tidy.select("dst", "src")).distinct().withColumn("w", F.lit(1.0)))
    names = rounds.save(ways.select(F.col("src").alias("item_id"), F.col("src").alias("node")).distinct())
    top = -1.0
    for _ in range(LEVELS):
        if ways.isEmpty():
            break
        labels, q = _moves(rounds, ways)
        if q <= top + GAIN:
            break
        top = q
        names = rounds.save(names.join(labels, "node").select("item_id", F.col("c").alias("node")))
        at = lambda x: small(labels).select(F.col("node").alias(x), F.col("c").alias(f"c_{x}"))  # noqa: B023, E731
        ways = rounds.save(ways.join(at("src"), "src").join(at("dst"), "dst").groupBy(F.col("c_src").alias("src"), F.col("c_dst").alias("dst")).agg(F.sum("w").alias("w")))
    least = names.groupBy("node").agg(F.min("item_id").alias("community"))
    return rounds.save(names.join(least, "node").select("item_id", "community"))


def community_metrics(edges: DataFrame, labels: DataFrame, least: int = 3) -> DataFrame:
    """(community, n, n_edges, density, strength) of communities of `least` nodes or more: edges inside over all that could be
    there, and size times density."""
    ways = edges.filter("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    at = lambda x: small(labels).select(F.col("item_id").alias(x), F.col("community").alias(f"c_{x}"))
    inside = ways.join(at("src"), "src").join(at("dst"), "dst").filter("c_src = c_dst").groupBy(F.col("c_src").alias("community")).agg(F.count(F.lit(1)).alias("n_edges"))
    sized = labels.groupBy("community").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).join(inside, "community", "left")
    density = 2 * F.coalesce("n_edges", F.lit(0)) / (F.col("n") * (F.col("n") - 1))
    return sized.select("community", "n", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), density.alias("density"), (F.col("n") * density).alias("strength"))
