"""Property-graph operators over nodes(item_id, memory_type, ...) and edges(src, dst, edge_type, ...)."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memlattice.sources.tables import ROWS, spread


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge in either direction: (src, dst, edge_type)."""
    return edges.select("src", "dst", "edge_type").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "edge_type"))


def node_by_id(nodes: DataFrame, item_id: str) -> DataFrame:
    return nodes.filter(F.col("item_id") == item_id)


def incident_edges(edges: DataFrame, node: str) -> DataFrame:
    """Edges from or to a node; a self-loop once."""
    return edges.filter((F.col("src") == node) | (F.col("dst") == node))


def neighbours(nodes: DataFrame, edges: DataFrame, node: str, edge_type: str | None = None, direction: str = "both") -> DataFrame:
    """Distinct neighbour nodes of a node, by direction (in, out, both) and type."""
    kept = edges if edge_type is None else edges.filter(F.col("edge_type") == edge_type)
    out = kept.filter(F.col("src") == node).select(F.col("dst").alias("item_id"))
    into = kept.filter(F.col("dst") == node).select(F.col("src").alias("item_id"))
    ids = {"out": out, "in": into, "both": out.union(into)}[direction].distinct()
    return nodes.join(ids, "item_id", "left_semi")


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.agg(F.count(F.lit(1)).alias("node_count")).join(edges.agg(F.count(F.lit(1)).alias("edge_count")), F.lit(True))


def upsert_latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key by order: a full replacement of earlier ones."""
    last = F.max(F.struct(*order, F.struct(*[c for c in rows.columns if c not in keys]).alias("row"))).alias("m")
    return rows.groupBy(*keys).agg(last).select(*keys, "m.row.*")


def upsert_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """New edges replace old ones of the same (src, dst, edge_type); null validity keeps the old value.  One shuffle, no join."""
    key = ["src", "dst", "edge_type"]
    rows = old.select(*key, "valid_from", "valid_to", F.lit(0).alias("k")).unionByName(new.select(*key, "valid_from", "valid_to", F.lit(1).alias("k")))
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("k", c))).alias(c)
    return rows.groupBy(*key).agg(latest("valid_from"), latest("valid_to"))


#: Labels, or rows of a mapping, that may travel to every task.
LABELS = 1_000_000


def dealt(df: DataFrame, rows: int | None, *keys: str) -> DataFrame:
    """df dealt by keys to tasks by a number of rows, see spread, which a join by those keys then keeps; as it is where that is None."""
    return df if rows is None else spread(df, rows, *keys)


def insert_edges(edges: DataFrame, nodes: DataFrame, rows: int | None = None) -> DataFrame:
    """The edges, `rows` at most, whose two ends exist."""
    ids = dealt(nodes.select("item_id"), rows, "item_id")
    return edges.join(ids, edges.src == ids.item_id, "left_semi").join(ids.withColumnRenamed("item_id", "other"), F.col("dst") == F.col("other"), "left_semi")


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes and edges without the nodes gone(item_id) and without their edges."""
    ids = gone.select(F.col("item_id").alias("gone_id"))
    left = nodes.join(ids, F.col("item_id") == F.col("gone_id"), "left_anti")
    kept = edges.join(ids, F.col("src") == F.col("gone_id"), "left_anti").join(ids, F.col("dst") == F.col("gone_id"), "left_anti")
    return left, kept


def merge_nodes(edges: DataFrame, mapping: DataFrame, rows: int | None = None) -> DataFrame:
    """Edges, `rows` at most, rewired by mapping(old_id, new_id): self-loops that arise go, and so do repetitions.

    A mapping of at most LABELS rows travels to the tasks.
    """
    m = mapping.select("old_id", "new_id")
    m = F.broadcast(m) if m.limit(LABELS + 1).count() <= LABELS else dealt(m, rows, "old_id")
    moved = edges.join(m.select(F.col("old_id").alias("src"), F.col("new_id").alias("src_new")), "src", "left").join(m.select(F.col("old_id").alias("dst"), F.col("new_id").alias("dst_new")), "dst", "left")
    src, dst = F.coalesce("src_new", "src"), F.coalesce("dst_new", "dst")
    touched = F.col("src_new").isNotNull() | F.col("dst_new").isNotNull()
    kept = moved.select(src.alias("src"), dst.alias("dst"), "edge_type", touched.alias("touched")).filter(~(F.col("touched") & (F.col("src") == F.col("dst")))).drop("touched")
    return dealt(kept, rows, "src", "dst", "edge_type").distinct()


def edge_type_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """In- plus out-degree of every node, 0 included; a self-loop counts twice."""
    ends = edges.select(F.col("src").alias("item_id")).union(edges.select("dst"))
    n = ends.groupBy("item_id").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("item_id").join(n, "item_id", "left").select("item_id", F.coalesce("degree", F.lit(0).cast("long")).alias("degree"))


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("item_id")).union(edges.select("dst")).distinct()
    return nodes.join(ends, "item_id", "left_anti")


def two_hop(edges: DataFrame, first: str, second: str) -> DataFrame:
    """(a, b, c) with a -first-> b -second-> c and a <> c; parallel edges multiply."""
    one = edges.filter(F.col("edge_type") == first).select(F.col("src").alias("a"), F.col("dst").alias("b"))
    two = edges.filter(F.col("edge_type") == second).select(F.col("src").alias("b"), F.col("dst").alias("c"))
    return one.join(two, "b").filter("a <> c").select("a", "b", "c")


def infer_transitive(edges: DataFrame, kind: str, confidence: Column | None = None) -> DataFrame:
    """a -> c where a -> b -> c and no a -> c, with the greatest min(0.7, c1 * c2) of its middles."""
    e = edges.filter(F.col("edge_type") == kind)
    conf = F.coalesce(confidence, F.lit(1.0)) if confidence is not None else F.lit(1.0)
    one = e.select(F.col("src").alias("a"), F.col("dst").alias("b"), conf.alias("c1"))
    two = e.select(F.col("src").alias("b"), F.col("dst").alias("c"), conf.alias("c2"))
    found = one.join(two, "b").filter("a <> c").groupBy("a", "c").agg(F.max(F.least(F.lit(0.7), F.col("c1") * F.col("c2"))).alias("confidence"))
    return found.join(e.select(F.col("src").alias("a"), F.col("dst").alias("c")), ["a", "c"], "left_anti")


def missing_reverse(edges: DataFrame, kind: str) -> DataFrame:
    """(src, dst) that a symmetric relation lacks."""
    e = edges.filter(F.col("edge_type") == kind).select("src", "dst").distinct()
    swapped = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return swapped.join(e, ["src", "dst"], "left_anti")


def inherit(nodes: DataFrame, edges: DataFrame, by: str, lacking: str, from_type: str, to_type: str) -> DataFrame:
    """(src, dst): to_type -lacking-> from_type edges to add where from_type -by-> to_type stands without them."""
    of = lambda t, k: nodes.filter(F.col("memory_type") == t).select(F.col("item_id").alias(k))
    found = edges.filter(F.col("edge_type") == by).select("src", "dst").distinct().join(of(from_type, "src"), "src", "left_semi").join(of(to_type, "dst"), "dst", "left_semi")
    new = found.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return new.join(edges.filter(F.col("edge_type") == lacking).select("src", "dst"), ["src", "dst"], "left_anti")


def health(nodes: DataFrame, edges: DataFrame, decisions_type: str, provenance: list[str]) -> DataFrame:
    """One row: counts, orphan ratio, share of decisions with a provenance edge, and whether both are healthy."""
    n = nodes.agg(F.count(F.lit(1)).alias("node_count"), F.count_if(F.col("memory_type") == decisions_type).alias("decision_count"))
    e = edges.agg(F.count(F.lit(1)).alias("edge_count"))
    o = orphans(nodes, edges).agg(F.count(F.lit(1)).alias("orphan_count"))
    proven = edges.filter(F.col("edge_type").isin(provenance)).select(F.col("src").alias("item_id")).distinct()
    p = nodes.filter(F.col("memory_type") == decisions_type).join(proven, "item_id", "left_semi").agg(F.count(F.lit(1)).alias("proven"))
    one = n.join(e, F.lit(True)).join(o, F.lit(True)).join(p, F.lit(True))
    ratio = F.when(F.col("node_count") > 0, F.col("orphan_count") / F.col("node_count")).otherwise(0.0)
    coverage = F.when(F.col("decision_count") > 0, F.col("proven") / F.col("decision_count")).otherwise(1.0)
    return one.select("node_count", "edge_count", "orphan_count", F.round(ratio, 6).alias("orphan_ratio"), F.round(coverage, 6).alias("provenance_coverage"), ((ratio < 0.2) & (coverage > 0.5)).alias("healthy"))


# ---- iterative algorithms: each round is written to the shared folder, only counts reach the driver ------------------


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only where the session names none and runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="memlattice-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


class Rounds:
    """Tables of an iteration."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, f"{shared_root(spark)}/graph-{uuid.uuid4().hex}", 0

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.parquet(f"{self.folder}/{self.n}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{self.n}")

    def drop(self, first: int, last: int) -> None:
        """Delete tables, by the number of their save, that no later read needs."""
        for n in range(first, last + 1):
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def tasks(spark: SparkSession, rows: int) -> Iterator[None]:
    """Tables saved inside are shuffled to a task for each million of rows, to the session's number at least; the setting is put back."""
    name = "spark.sql.shuffle.partitions"
    was = spark.conf.get(name)
    spark.conf.set(name, str(max(int(was), -(-rows // ROWS))))
    try:
        yield
    finally:
        spark.conf.set(name, was)


def small(saved: DataFrame) -> DataFrame:
    """A saved table, to travel to every task if it has at most LABELS rows."""
    return F.broadcast(saved) if saved.count() <= LABELS else saved


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(item_id, component): the least item_id that is weakly connected with each node, by contraction.

    In a round each node that has edges follows its least neighbour, if that is less than itself, to the end of such steps, by
    doubling; the edges are then those between the nodes that they came to.  The larger end of each edge is gone after a round, so the
    edges that are left get fewer; the least node of a component never moves.  The rounds' steps, composed, are the labels.
    A table of few steps travels after a count: no task gets all the rows of one label.
    """
    spark = nodes.sparkSession
    rounds = Rounds(spark)
    pair = lambda a, b: (F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"))
    left = rounds.save(edges.filter("src <> dst").select(*pair("src", "dst")))
    steps = []
    while rows := left.count():
        held = rounds.n
        with tasks(spark, 2 * rows):
            # only the larger end can follow the smaller one, so that the steps of a round make trees
            near = rounds.save(left.groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("to"), F.lit(True).alias("on")))
            while not near.filter("on").isEmpty():
                further = near.select(F.col("node").alias("to"), F.col("to").alias("further"))
                near = rounds.save(near.join(small(further), "to", "left").select("node", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("on")))
            near = near.select("node", "to")
            steps.append(near)
            moves = small(near)
            at = lambda x: moves.select(F.col("node").alias(x), F.col("to").alias(f"{x}_to"))  # noqa: B023, E731
            moved = left.join(at("dst"), "dst").join(at("src"), "src", "left").select(F.coalesce("src_to", "src").alias("a"), F.col("dst_to").alias("b"))
            left = rounds.save(moved.filter("a <> b").select(*pair("a", "b")).distinct())
        rounds.drop(held, rounds.n - 2)  # all but the steps and the edges left
    labels = rounds.save(nodes.select("item_id", F.col("item_id").alias("component")).distinct())
    with tasks(spark, labels.count()):
        for step in steps:
            moves = small(step).withColumnRenamed("node", "component")
            labels = rounds.save(labels.join(moves, "component", "left").select("item_id", F.coalesce("to", "component").alias("component")))
    return labels


def reach(edges: DataFrame, start: str, max_depth: int, kinds: list[str] | None = None, directed: bool = True) -> DataFrame:
    """(item_id, depth): nodes reached from start with the fewest hops, up to max_depth, start itself at 0."""
    rounds = Rounds(edges.sparkSession)
    kept = edges if kinds is None else edges.filter(F.col("edge_type").isin(kinds))
    # repeated edges go with each hop's distinct, so that only those at the frontier are ever gathered
    ways = kept.select("src", "dst") if directed else both_ways(kept).select("src", "dst")
    seen = edges.sparkSession.createDataFrame([(start, 0)], ["item_id", "depth"]).select(F.col("item_id").cast(edges.schema["src"].dataType).alias("item_id"), F.col("depth").cast("int"))
    frontier = seen
    for depth in range(1, max_depth + 1):
        new = ways.join(frontier.select(F.col("item_id").alias("src")), "src").select(F.col("dst").alias("item_id")).distinct()
        frontier = rounds.save(new.join(seen, "item_id", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen


def shortest_path(edges: DataFrame, start: str, end: str, max_depth: int | None = None) -> DataFrame:
    """(length, path) of the undirected shortest path, the least by its nodes among equals; no row if there is none, or none
    of max_depth hops at most."""
    rounds = Rounds(edges.sparkSession)
    ways = rounds.save(both_ways(edges).select("src", "dst").distinct())
    kind = edges.schema["src"].dataType
    seen = edges.sparkSession.createDataFrame([(start,)], ["item_id"]).select(F.col("item_id").cast(kind).alias("item_id"))
    frontier = seen.select("item_id", F.array("item_id").alias("path"))
    hops = 0
    while frontier.filter(F.col("item_id") == end).isEmpty():
        if frontier.isEmpty() or hops == max_depth:
            return frontier.limit(0).select(F.lit(0).alias("length"), F.lit("").alias("path"))
        hops += 1
        new = ways.join(frontier.withColumnRenamed("item_id", "src"), "src").groupBy(F.col("dst").alias("item_id")).agg(F.min("path").alias("path"))
        frontier = rounds.save(new.join(seen, "item_id", "left_anti").select("item_id", F.concat("path", F.array("item_id")).alias("path")))
        seen = seen.union(frontier.select("item_id"))
    return frontier.filter(F.col("item_id") == end).select((F.size("path") - 1).alias("length"), F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


def simple_paths(edges: DataFrame, start: str, end: str, cutoff: int = 5) -> DataFrame:
    """(length, path): all undirected simple paths up to cutoff hops.

    Paths meet in the middle: half of the hops from either end, so a cutoff of 5 joins paths of 3 and 2.  Edges are
    written once; a hop reads those that touch the ends of its paths, which travel where they are few, and makes them
    distinct.  Each hop's paths are written, as every length uses them.
    """
    rounds = Rounds(edges.sparkSession)
    held = rounds.save(edges.select("src", "dst"))
    kind = edges.schema["src"].dataType
    spark = edges.sparkSession

    def grow(seed: str, hops: int, other: str) -> list[DataFrame]:
        level = spark.createDataFrame([(seed,)], ["at"]).select(F.col("at").cast(kind).alias("at"))
        levels = [level.select("at", F.array("at").alias("path"))]
        for _ in range(hops):
            last = levels[-1].filter(F.col("at") != other)
            ends = last.select("at").distinct()
            near = F.broadcast(ends) if ends.limit(LABELS + 1).count() <= LABELS else ends
            touched = held.join(near, F.col("src") == F.col("at"), "left_semi").union(held.select("dst", "src").join(near, F.col("dst") == F.col("at"), "left_semi"))
            ways = touched.distinct()
            grown = last.join(ways, last["at"] == ways["src"]).filter(~F.array_contains("path", F.col("dst")))
            levels.append(rounds.save(grown.select(F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path"))))
        return levels

    ahead, back = grow(start, (cutoff + 1) // 2, end), grow(end, cutoff // 2, start)
    found = None
    for length in range(1, cutoff + 1):
        i = (length + 1) // 2
        left = ahead[i]
        right = back[length - i].select("at", F.col("path").alias("rest"))
        met = left.join(right, "at").filter(F.size(F.array_intersect("path", "rest")) == 1)
        met = met.select(F.lit(length).alias("length"), F.concat("path", F.slice(F.reverse("rest"), 2, length)).alias("path"))
        found = met if found is None else found.union(met)
    return found.select("length", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


def transitive_closure(edges: DataFrame, kind: str) -> DataFrame:
    """(src, dst) reachable by `kind` without a direct edge, src <> dst.

    To the fixpoint: each round joins the pairs it found last with all pairs, on either side, so that lengths double.
    """
    rounds = Rounds(edges.sparkSession)
    e = rounds.save(edges.filter(F.col("edge_type") == kind).select("src", "dst").distinct())
    all_pairs, new = e, e
    while not new.isEmpty():
        join = lambda a, b: a.select("src", F.col("dst").alias("mid")).join(b.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst")
        step = join(new, all_pairs).union(join(all_pairs, new)).distinct()
        new = rounds.save(step.join(all_pairs, ["src", "dst"], "left_anti"))
        all_pairs = all_pairs.union(new)
    return all_pairs.filter("src <> dst").join(e, ["src", "dst"], "left_anti")


def paths_from(edges: DataFrame, start: str, max_depth: int) -> DataFrame:
    """(path, depth): all directed paths from start of max_depth edges at most that meet no node twice, start itself first."""
    rounds = Rounds(edges.sparkSession)
    kind = edges.schema["src"].dataType
    level = edges.sparkSession.createDataFrame([(start,)], ["at"]).select(F.col("at").cast(kind).alias("at")).select("at", F.array("at").alias("nodes"))
    levels = [level]
    for _ in range(max_depth):
        last = levels[-1]
        grown = last.join(edges.select("src", "dst"), F.col("at") == F.col("src")).filter(~F.array_contains("nodes", F.col("dst")))
        level = rounds.save(grown.select(F.col("dst").alias("at"), F.concat("nodes", F.array("dst")).alias("nodes")))
        if level.isEmpty():
            break
        levels.append(level)
    out = levels[0]
    for level in levels[1:]:
        out = out.union(level)
    return out.select(F.array_join(F.transform("nodes", lambda x: x.cast("string")), ">").alias("path"), (F.size("nodes") - 1).alias("depth"))


#: Edges beyond a path's first that may travel to every task: 32 MB of numbers beside the names of at most LABELS nodes.
ADJACENCY = 8_000_000
#: Rows of a source and a node, at most, that a batch of sources holds where the adjacency is joined, and buckets of sources.
REACHED, BUCKETS = 1_000_000_000, 1 << 20
#: Sources of a task; cells of a source and a node, and edges met, that a task holds at once.
SOURCES, CELLS, ARCS = 20_000, 4_000_000, 8_000_000


def _betweenness_by_joins(pairs: DataFrame, nodes: DataFrame, count: int) -> DataFrame:
    """(item_id, part): Brandes' sums by a join a level, for a batch of sources at a time.

    A row for each source of the batch and node it reaches; a batch's levels are deleted once its sums are written.  The
    first batch would fit if every source reached every node; the rows it reaches tell how many sources the next one takes.
    """
    kept = Rounds(pairs.sparkSession)
    ways, out = kept.save(pairs), None
    first, width = 0, max(1, BUCKETS * REACHED // max(1, count * count))
    while first < BUCKETS:
        rounds = Rounds(pairs.sparkSession)
        bucket = F.pmod(F.xxhash64("item_id"), F.lit(BUCKETS))
        sources = nodes.filter((bucket >= first) & (bucket < first + width))
        levels = [rounds.save(sources.select(F.col("item_id").alias("s"), F.col("item_id").alias("v"), F.lit(1.0).alias("paths")).distinct())]
        seen = levels[0].select("s", "v")
        while True:
            step = levels[-1].join(ways, F.col("v") == F.col("src")).groupBy("s", F.col("dst").alias("v")).agg(F.sum("paths").alias("paths"))
            new = rounds.save(step.join(seen, ["s", "v"], "left_anti"))
            if new.isEmpty():
                break
            levels.append(new)
            seen = seen.union(new.select("s", "v"))
        reached = sum(x.count() for x in levels)
        lean = levels[-1].withColumn("lean", F.lit(0.0))
        total = lean.select("v", "lean").limit(0)
        for k in range(len(levels) - 1, 0, -1):
            total = total.union(lean.select("v", "lean"))
            share = lean.join(ways, F.col("v") == F.col("dst")).groupBy("s", F.col("src").alias("v")).agg(F.sum((1 + F.col("lean")) / F.col("paths")).alias("share"))
            lean = rounds.save(levels[k - 1].join(share, ["s", "v"], "left").select("s", "v", "paths", (F.coalesce("share", F.lit(0.0)) * F.col("paths")).alias("lean")))
        sums = kept.save(total.groupBy(F.col("v").alias("item_id")).agg(F.sum("lean").alias("part")))
        out = sums if out is None else out.union(sums)
        rounds.drop(1, rounds.n)
        first += width
        width = max(1, min(16 * width, width * REACHED // max(1, reached)))
    return out.groupBy("item_id").agg(F.sum("part").alias("part"))


def betweenness(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(item_id, betweenness) of a directed graph, normalised: Brandes' method over partitions of the source nodes.

    No path passes a node that no edge enters: the edges from those nodes stay with them as sources.  Where at most
    ADJACENCY others are left they travel to every task, as arrays; more are joined, level by level, for batches of
    sources.  Repeated edges and nodes count once; edges of a null end lie on no path.
    """
    rounds = Rounds(edges.sparkSession)
    pairs = rounds.save(edges.select("src", "dst").dropna().distinct())
    inner = pairs.select("dst").distinct()
    small = inner.limit(LABELS + 1).count() <= LABELS
    n = nodes.count()
    scale = 1.0 / max(1, (n - 1) * (n - 2))
    parts = _betweenness_in_tasks(rounds, pairs, nodes, n, pd.Index(inner.toArrow()["dst"].to_pandas())) if small else None
    if parts is None:
        parts = _betweenness_by_joins(pairs, nodes, n)
    return nodes.select("item_id").join(parts, "item_id", "left").select("item_id", (F.coalesce("part", F.lit(0.0)) * scale).alias("betweenness"))


def _betweenness_in_tasks(rounds: Rounds, pairs: DataFrame, nodes: DataFrame, count: int, names: pd.Index) -> DataFrame | None:
    """(item_id, part) where at most ADJACENCY edges leave the nodes `names`, which edges enter; else None."""
    spark, size = rounds.spark, len(names)
    named = spark.sparkContext.broadcast(names)
    kind = pairs.schema["src"].dataType.simpleString()

    def number(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"src": frame["src"], "at": named.value.get_indexer(frame["src"]), "to": named.value.get_indexer(frame["dst"])})

    numbered = rounds.save(pairs.mapInPandas(number, f"src {kind}, at int, to int"))
    core = numbered.filter("at >= 0").select("at", "to")
    if core.count() > ADJACENCY:
        return None
    # as Arrow, 8 bytes an edge: rows would be Python objects in the driver, some 500 bytes each
    ends = core.toArrow()
    at, to = ends["at"].to_numpy(), ends["to"].to_numpy()
    starts = np.concatenate(([0], np.cumsum(np.bincount(at, minlength=size)))).astype(np.int64)
    shared = spark.sparkContext.broadcast((starts, to[np.argsort(at, kind="stable")]))
    width = max(1, CELLS // max(1, size))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, (starts, heads) = named.value, shared.value
        depth, paths, lean = np.full(width * size, -1, dtype=np.int32), np.zeros(width * size), np.zeros(width * size)
        total = np.zeros(size)

        def walk(seeds: list[tuple[np.ndarray, bool]]) -> None:
            """Adds the sums of some sources: a cell is a source's place and a node."""
            cells = np.concatenate([s + k * size for k, (s, _) in enumerate(seeds)])
            own = np.array([s[0] + k * size for k, (s, inside) in enumerate(seeds) if inside], dtype=np.int64)
            depth[cells], paths[cells] = 0, 1.0
            levels, arcs, held = [cells], [], 0
            while True:
                at = levels[-1]
                v = at % size
                n = starts[v + 1] - starts[v]
                held += n.sum()
                if held > ARCS and len(seeds) > 1:
                    touched = np.concatenate(levels)
                    depth[touched], paths[touched] = -1, 0.0
                    walk(seeds[: len(seeds) // 2])
                    walk(seeds[len(seeds) // 2 :])
                    return
                to = heads[np.arange(n.sum()) + np.repeat(starts[v] - np.cumsum(n) + n, n)] + np.repeat(at - v, n)
                new = np.unique(to[depth[to] < 0])
                if not len(new):
                    break
                depth[new] = len(levels)
                on = depth[to] == len(levels)
                before, to = np.repeat(at, n)[on], to[on]
                np.add.at(paths, to, paths[before])
                arcs.append((before, to))
                levels.append(new)
            for before, to in reversed(arcs):
                np.add.at(lean, before, paths[before] / paths[to] * (1 + lean[to]))
            lean[own] = 0.0
            touched = np.concatenate(levels)
            np.add.at(total, touched % size, lean[touched])
            depth[touched], paths[touched], lean[touched] = -1, 0.0, 0.0

        for frame in frames:
            found = zip(names.get_indexer(frame["item_id"]), frame["heads"], strict=True)
            seeds = [(np.array([at]), True) if at >= 0 else (np.asarray(out, dtype=np.int64), False) for at, out in found if at >= 0 or out is not None]
            for k in range(0, len(seeds), width):
                walk(seeds[k : k + width])
        on = np.nonzero(total)[0]
        yield pd.DataFrame({"item_id": names[on], "part": total[on]})

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // SOURCES))
    outer = numbered.filter("at < 0").repartition(tasks, "src").groupBy("src").agg(F.collect_list("to").alias("heads"))
    sources = nodes.select("item_id").repartition(tasks, "item_id").distinct().join(outer, F.col("item_id") == F.col("src"), "left").select("item_id", "heads")
    return sources.mapInPandas(run, f"item_id {kind}, part double").groupBy("item_id").agg(F.sum("part").alias("part"))


#: Whether a query's shuffle files go when it ends, instead of when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of tables saved inside are deleted as soon as a table is written; the setting is put back."""
    was = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if was is None else spark.conf.set(_CLEANUP, was)


def label_communities(nodes: DataFrame, edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(item_id, community) by synchronous label propagation with the smaller label on ties; a fixed number of rounds.

    Every node that exists sends its label to its neighbours, (to, sent, label, w), w rows of it being w votes.  Those who
    sent to a node are its neighbours, so it answers them with its next label: a round is one shuffle of the messages,
    the last one without their senders, and no join of the edges.  A node's neighbours meet in one task, sorted.  A
    round's table is deleted once the next is written.
    """
    steps = Rounds(nodes.sparkSession)
    if rounds < 1:
        return nodes.select("item_id", F.col("item_id").alias("community"))
    known = nodes.groupBy("item_id").agg(F.count(F.lit(1)).alias("w"))
    with shuffles_freed(nodes.sparkSession):
        held = steps.save(edges.select("src", "dst", "edge_type"))
        with tasks(nodes.sparkSession, 2 * held.count()):
            n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            ways = both_ways(held).select("src", "dst").dropna().repartition(n, "src").distinct()
            sent = steps.save(ways.join(known, F.col("src") == F.col("item_id")).select(F.col("dst").alias("to"), F.col("src").alias("sent"), "w"))
            steps.drop(1, 1)
            label = F.col("sent")
            for k in range(1, rounds):
                votes = sent.repartition(n, "to").withColumn("n", F.sum("w").over(W.partitionBy("to", label)))
                best = votes.withColumn("best", F.min(F.struct((-F.col("n")).alias("n"), label.alias("label"))).over(W.partitionBy("to")))
                answers = best.drop("w").join(known, F.col("to") == F.col("item_id"))
                sent = steps.save(answers.select(F.col("sent").alias("to"), F.col("to").alias("sent"), F.col("best.label").alias("label"), "w"))
                steps.drop(k + 1, k + 1)
                label = F.col("label")
            votes = sent.select("to", label.alias("label"), "w").repartition(n, "to").groupBy("to", "label").agg(F.sum("w").alias("n"))
            best = votes.groupBy("to").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("b")).select(F.col("to"), F.col("b.label").alias("next"))
            # a node that got no votes has no neighbour that exists, so it never gets any
            labels = steps.save(nodes.select("item_id").join(best, F.col("item_id") == F.col("to"), "left").select("item_id", F.coalesce("next", "item_id").alias("community")))
            steps.drop(rounds + 1, rounds + 1)
    return labels


def random_walk(edges: DataFrame, starts: DataFrame, length: int = 5, seed: int = 0) -> DataFrame:
    """(start, step, item_id): a walk from each start, each step choosing the edge with the least hash of (seed, walk, step)."""
    rounds = Rounds(edges.sparkSession)
    ways = rounds.save(edges.select("src", "dst").distinct())
    at = starts.select(F.col("item_id").alias("start"), F.lit(0).alias("step"), "item_id")
    out = at
    for k in range(1, length + 1):
        pick = F.min(F.struct(F.xxhash64(F.lit(seed), "start", F.lit(k), "dst").alias("h"), "dst")).alias("m")
        at = rounds.save(at.join(ways, F.col("item_id") == F.col("src")).groupBy("start").agg(pick).select("start", F.lit(k).alias("step"), F.col("m.dst").alias("item_id")))
        out = out.union(at)
    return out


def top_by(df: DataFrame, partition: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*partition).orderBy(*order))).filter(F.col("_n") <= k).drop("_n")
