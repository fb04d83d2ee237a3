"""The tables of a data folder, and the memory-graph tables derived from them.

nodes(item_id, memory_type, name, weight), edges(src, dst, edge_type, valid_from, valid_to), links (a cyclic user graph),
versions(item_id, kind, version, content, value, tx_start, tx_end), items(item_id, content, memory_type, workspace, source),
decisions, opinions, tags(item_id, tag), retrievals(user_id, day, item).  PRELUDE has the same definitions in SQL.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .literals import LITERALS

#: The instant that ages are measured from; the events end the day before.
AS_OF = "2024-01-31 00:00:00"


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def days_before(ts: Column) -> Column:
    """Age in days at AS_OF, as a double."""
    return (F.lit(1706659200.0) - F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)) / F.lit(86400.0)


#: Rows that a task of a shuffle gets, about: their number asks for the tasks, as a task's memory grows with its rows.
ROWS = 1_000_000


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df dealt by keys to a task for each ROWS of its `rows`, to the session's number of tasks at least."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-rows // ROWS)), *keys)


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        df = LITERALS[name].frame(self.spark) if name in LITERALS else self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        self.__dict__[name] = df
        return df

    @cached_property
    def nodes(self) -> DataFrame:
        def kind(df: DataFrame, prefix: str, key: str, name: str, memory_type: str, weight: Column) -> DataFrame:
            return df.select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("item_id"), F.lit(memory_type).alias("memory_type"), F.col(name).alias("name"), weight.cast("double").alias("weight"))

        parts = [
            kind(self.region, "r:", "r_regionkey", "r_name", "region", F.lit(0.0)),
            kind(self.nation, "n:", "n_nationkey", "n_name", "nation", F.lit(0.0)),
            kind(self.customer, "c:", "c_custkey", "c_name", "customer", F.col("c_acctbal")),
            kind(self.supplier, "s:", "s_suppkey", "s_name", "supplier", F.col("s_acctbal")),
            kind(self.part, "p:", "p_partkey", "p_name", "part", F.col("p_retailprice")),
            kind(self.orders, "o:", "o_orderkey", "o_orderpriority", "order", F.col("o_totalprice")),
        ]
        out = parts[0]
        for more in parts[1:]:
            out = out.unionByName(more)
        return out

    @cached_property
    def edges(self) -> DataFrame:
        def edge(df: DataFrame, a: str, b: str, kind: str, start: Column | None = None, end: Column | None = None) -> DataFrame:
            none = F.lit(None).cast("timestamp_ntz")
            side = lambda x: F.concat(F.lit(f"{x[0]}:"), F.col(x[2:]).cast("string"))
            return df.select(side(a).alias("src"), side(b).alias("dst"), F.lit(kind).alias("edge_type"), (none if start is None else start).alias("valid_from"), (none if end is None else end).alias("valid_to"))

        # counted by the files' footers
        items = self.lineitem.count()
        pairs = lambda a, b: spread(self.lineitem.select(a, b), items, a, b).distinct()
        shipped = self.lineitem.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("shipped"))
        placed = self.orders.join(shipped, self.orders.o_orderkey == shipped.l_orderkey, "left")
        ntz = lambda c: F.col(c).cast("timestamp_ntz")
        parts = [
            edge(self.nation, "n.n_nationkey", "r.n_regionkey", "LOCATED_IN"),
            edge(self.customer, "c.c_custkey", "n.c_nationkey", "LOCATED_IN"),
            edge(self.supplier, "s.s_suppkey", "n.s_nationkey", "LOCATED_IN"),
            edge(placed, "o.o_orderkey", "c.o_custkey", "PLACED_BY", ntz("o_orderdate"), ntz("shipped")),
            edge(pairs("l_orderkey", "l_partkey"), "o.l_orderkey", "p.l_partkey", "CONTAINS"),
            edge(pairs("l_partkey", "l_suppkey"), "p.l_partkey", "s.l_suppkey", "SUPPLIED_BY"),
        ]
        out = parts[0]
        for more in parts[1:]:
            out = out.unionByName(more)
        return out

    @cached_property
    def edge_rows(self) -> int:
        """As many rows as the edges have at most, by the files' footers."""
        return 2 * self.lineitem.count() + sum(x.count() for x in (self.nation, self.customer, self.supplier, self.orders))

    @cached_property
    def links(self) -> DataFrame:
        """Users of consecutive events; the kind is that of the first event."""
        e = self.events
        after = e.select((F.col("event_id") - 1).alias("event_id"), F.col("user_id").alias("dst"))
        return e.join(after, "event_id").filter("user_id <> dst").select(F.col("user_id").alias("src"), "dst", F.col("event_type").alias("edge_type")).distinct()

    @cached_property
    def versions(self) -> DataFrame:
        w = W.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
        return self.events.select(
            F.col("user_id").alias("item_id"), F.col("event_type").alias("kind"), F.row_number().over(w).alias("version"), F.col("props").alias("content"), "value", F.col("ts").alias("tx_start"), F.lead("ts").over(w).alias("tx_end")
        )

    @cached_property
    def items(self) -> DataFrame:
        kinds = F.array(*[F.lit(x) for x in ("semantic", "episodic", "procedural", "zettel")])
        return self.documents.select(F.col("doc_id").alias("item_id"), F.col("text").alias("content"), F.element_at(kinds, (F.col("doc_id") % 4 + 1).cast("int")).alias("memory_type"), F.col("lang").alias("workspace"), "source")

    @cached_property
    def decisions(self) -> DataFrame:
        status = F.when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") == "F", "superseded").otherwise("pending")
        return self.orders.select(
            F.col("o_orderkey").alias("decision_id"), F.col("o_custkey").alias("owner"), F.col("o_orderpriority").alias("domain"), status.alias("status"),
            F.least(F.lit(1.0), F.col("o_totalprice") / 500000.0).alias("confidence"), (F.col("o_orderkey") % 4).cast("int").alias("supporting"), (F.col("o_orderkey") % 3).cast("int").alias("contradicting"), F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"),
        )

    @cached_property
    def tags(self) -> DataFrame:
        """Words of part names as tags of parts."""
        return self.part.select(F.col("p_partkey").alias("item_id"), F.explode(F.filter(F.split(F.lower("p_name"), r"\s+"), lambda x: x != "")).alias("tag")).distinct()

    @cached_property
    def pairs(self) -> DataFrame:
        """Pairs of memories: told ones, and parts with the next part."""
        p = self.part
        q = p.select((F.col("p_partkey") - 1).alias("p_partkey"), *[F.col(c).alias(f"q_{c[2:]}") for c in ("p_name", "p_type", "p_brand", "p_size", "p_retailprice")])
        at = lambda c: F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col(c))
        made = p.join(q, "p_partkey").select(
            (F.col("p_partkey") + 1000).alias("pair_id"), F.col("p_name").alias("a"), F.col("q_name").alias("b"), at("p_size").alias("ta"), at("q_size").alias("tb"), F.col("p_type").alias("type_a"), F.col("q_type").alias("type_b"),
            F.split("p_name", " ").alias("tags_a"), F.split("q_name", " ").alias("tags_b"), F.col("p_brand").alias("cat_a"), F.col("q_brand").alias("cat_b"), (F.col("p_retailprice") / 3000).alias("conf_a"), (F.col("q_retailprice") / 3000).alias("conf_b"),
            F.array("p_brand").alias("near_a"), F.array("q_brand").alias("near_b"),
        )
        return self.told_pairs.unionByName(made)

    @cached_property
    def notes(self) -> DataFrame:
        """Texts for extractors: told ones, whose words the others never hold, then documents and turns of conversations."""
        docs = self.documents.select((F.col("doc_id") + 1000).alias("note_id"), F.col("text").alias("content"))
        turns = self.conversations.select((F.col("conv_id") * 1000 + F.col("turn") + 1_000_000_000).alias("note_id"), F.col("text").alias("content"))
        return self.told_notes.union(docs).union(turns)

    @cached_property
    def linked_pages(self) -> DataFrame:
        """Told pages, with metadata and linked data, and the given ones."""
        told = self.told_pages.select("page_id", F.concat(F.lit("https://a.example/"), F.col("page_id").cast("string")).alias("url"), "html")
        return told.union(self.pages.select((F.col("page_id") + 1000).alias("page_id"), "url", "html"))

    @cached_property
    def retrievals(self) -> DataFrame:
        return self.events.select("user_id", F.date_trunc("day", "ts").alias("day"), "event_type", "value", "ts", "event_id")


PRELUDE = {
    "nodes": ("", """
SELECT 'r:'||r_regionkey AS item_id, 'region' AS memory_type, r_name AS name, 0.0::DOUBLE AS weight FROM region
UNION ALL SELECT 'n:'||n_nationkey, 'nation', n_name, 0.0 FROM nation
UNION ALL SELECT 'c:'||c_custkey, 'customer', c_name, c_acctbal FROM customer
UNION ALL SELECT 's:'||s_suppkey, 'supplier', s_name, s_acctbal FROM supplier
UNION ALL SELECT 'p:'||p_partkey, 'part', p_name, p_retailprice FROM part
UNION ALL SELECT 'o:'||o_orderkey, 'order', o_orderpriority, o_totalprice FROM orders"""),
    "edges": ("", """
SELECT 'n:'||n_nationkey AS src, 'r:'||n_regionkey AS dst, 'LOCATED_IN' AS edge_type, NULL::TIMESTAMP AS valid_from, NULL::TIMESTAMP AS valid_to FROM nation
UNION ALL SELECT 'c:'||c_custkey, 'n:'||c_nationkey, 'LOCATED_IN', NULL, NULL FROM customer
UNION ALL SELECT 's:'||s_suppkey, 'n:'||s_nationkey, 'LOCATED_IN', NULL, NULL FROM supplier
UNION ALL SELECT 'o:'||o_orderkey, 'c:'||o_custkey, 'PLACED_BY', o_orderdate, shipped FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS shipped FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
UNION ALL SELECT DISTINCT 'o:'||l_orderkey, 'p:'||l_partkey, 'CONTAINS', NULL::TIMESTAMP, NULL::TIMESTAMP FROM lineitem
UNION ALL SELECT DISTINCT 'p:'||l_partkey, 's:'||l_suppkey, 'SUPPLIED_BY', NULL::TIMESTAMP, NULL::TIMESTAMP FROM lineitem"""),
    "links": ("", "SELECT DISTINCT a.user_id AS src, b.user_id AS dst, a.event_type AS edge_type FROM events a JOIN events b ON b.event_id = a.event_id + 1 WHERE a.user_id <> b.user_id"),
    "versions": ("", """
SELECT user_id AS item_id, event_type AS kind, (row_number() OVER w)::INTEGER AS version, props AS content, value, ts AS tx_start, lead(ts) OVER w AS tx_end
FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)"""),
    "items": ("", "SELECT doc_id AS item_id, text AS content, ['semantic','episodic','procedural','zettel'][(doc_id % 4 + 1)::INT] AS memory_type, lang AS workspace, source FROM documents"),
    "decisions": ("", """
SELECT o_orderkey AS decision_id, o_custkey AS owner, o_orderpriority AS domain,
       CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'superseded' ELSE 'pending' END AS status,
       least(1.0::DOUBLE, o_totalprice / 500000.0::DOUBLE) AS confidence, (o_orderkey % 4)::INT AS supporting, (o_orderkey % 3)::INT AS contradicting, o_orderdate AS created_at FROM orders"""),
    "tags": ("", r"SELECT DISTINCT p_partkey AS item_id, unnest(list_filter(regexp_split_to_array(lower(p_name), '\s+'), lambda x: x <> '')) AS tag FROM part"),
    "pairs": ("told_pairs", """
SELECT * FROM told_pairs UNION ALL SELECT p.p_partkey + 1000, p.p_name, q.p_name, TIMESTAMP '2024-01-01' + p.p_size * INTERVAL 1 HOUR, TIMESTAMP '2024-01-01' + q.p_size * INTERVAL 1 HOUR, p.p_type, q.p_type,
  string_split(p.p_name, ' '), string_split(q.p_name, ' '), p.p_brand, q.p_brand, p.p_retailprice / 3000, q.p_retailprice / 3000, [p.p_brand], [q.p_brand] FROM part p JOIN part q ON q.p_partkey = p.p_partkey + 1"""),
    "notes": ("told_notes", "SELECT * FROM told_notes UNION ALL SELECT doc_id + 1000, text FROM documents UNION ALL SELECT conv_id * 1000 + turn + 1000000000, text FROM conversations"),
    "linked_pages": ("told_pages", "SELECT page_id, 'https://a.example/' || page_id AS url, html FROM told_pages UNION ALL SELECT page_id + 1000, url, html FROM pages"),
    "retrievals": ("", "SELECT user_id, date_trunc('day', ts) AS day, event_type, value, ts, event_id FROM events"),
}

PRELUDE |= {name: ("", table.sql) for name, table in LITERALS.items()}
