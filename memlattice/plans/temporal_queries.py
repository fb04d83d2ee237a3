"""Queries over versions, intervals and event sequences."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memlattice.operators import store as so
from memlattice.operators import temporal as tp
from memlattice.operators.timeindex import VersionIndex
from memlattice.sources.tables import Tables

from .registry import query

T = "2024-01-15 00:00:00"


def at(x: str = T):
    return F.lit(x).cast("timestamp_ntz")


@query("temporal_version_at", f"SELECT item_id, kind, arg_max(version, version) AS version, arg_max(content, version) AS content FROM versions WHERE tx_start <= TIMESTAMP '{T}' AND (tx_end IS NULL OR TIMESTAMP '{T}' < tx_end) GROUP BY 1, 2", "versions")
def temporal_version_at(t: Tables) -> DataFrame:
    return tp.version_at(t.versions, at(), ["item_id", "kind"]).select("item_id", "kind", "version", "content")


@query("temporal_all_items_at", f"SELECT DISTINCT item_id FROM versions WHERE tx_start <= TIMESTAMP '{T}' AND (tx_end IS NULL OR TIMESTAMP '{T}' < tx_end)", "versions")
def temporal_all_items_at(t: Tables) -> DataFrame:
    return t.versions.filter(tp.valid_at(F.col("tx_start"), F.col("tx_end"), at())).select("item_id").distinct()


@query("temporal_edges_at", "SELECT src, dst FROM edges WHERE edge_type = 'PLACED_BY' AND valid_from <= TIMESTAMP '1996-01-01' AND (valid_to IS NULL OR TIMESTAMP '1996-01-01' < valid_to)", "edges")
def temporal_edges_at(t: Tables) -> DataFrame:
    held = tp.valid_at(F.col("valid_from"), F.col("valid_to"), at("1996-01-01"))
    return t.edges.filter("edge_type = 'PLACED_BY'").filter(held).select("src", "dst")


@query("temporal_relationship_history", "SELECT src, valid_from, valid_to FROM edges WHERE dst = 'c:7' AND edge_type = 'PLACED_BY' ORDER BY valid_from DESC", "edges")
def temporal_relationship_history(t: Tables) -> DataFrame:
    return t.edges.filter("dst = 'c:7' and edge_type = 'PLACED_BY'").select("src", "valid_from", "valid_to").orderBy(F.desc("valid_from"))


@query("temporal_version_numbering", "SELECT event_id, (row_number() OVER w)::INTEGER AS version, CASE WHEN row_number() OVER w > 1 THEN row_number() OVER w - 1 END::INTEGER AS previous_version, lead(ts) OVER w AS tx_end FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)")
def temporal_version_numbering(t: Tables) -> DataFrame:
    return tp.number_versions(t.events, ["user_id", "event_type"], ["ts", "event_id"], "ts").select("event_id", "version", "previous_version", "tx_end")


@query("temporal_version_history", "SELECT kind, version, content FROM versions WHERE item_id = 7 AND tx_start >= TIMESTAMP '2024-01-10' ORDER BY kind, version DESC", "versions")
def temporal_version_history(t: Tables) -> DataFrame:
    return t.versions.filter(F.col("item_id") == 7).filter(F.col("tx_start") >= at("2024-01-10")).select("kind", "version", "content").orderBy("kind", F.desc("version"))


@query("temporal_changes", """
SELECT item_id, kind, version, concat_ws(',', CASE WHEN content IS DISTINCT FROM c THEN 'content' END, CASE WHEN value IS DISTINCT FROM v THEN 'value' END) AS changed
FROM (SELECT *, lag(content) OVER w AS c, lag(value) OVER w AS v FROM versions WINDOW w AS (PARTITION BY item_id, kind ORDER BY version)) WHERE version > 1 AND (content IS DISTINCT FROM c OR value IS DISTINCT FROM v)""", "versions")
def temporal_changes(t: Tables) -> DataFrame:
    return tp.changes(t.versions, ["item_id", "kind"], ["content", "value"]).select("item_id", "kind", "version", F.array_join("changed", ",").alias("changed"))


@query("temporal_audit", """
SELECT item_id, kind, version, CASE WHEN lag(version) OVER w IS NULL THEN 'created' WHEN lead(version) OVER w IS NULL AND tx_end IS NOT NULL THEN 'deleted' ELSE 'updated' END AS action FROM versions WINDOW w AS (PARTITION BY item_id, kind ORDER BY version)""", "versions")
def temporal_audit(t: Tables) -> DataFrame:
    return tp.audit(t.versions, ["item_id", "kind"]).select("item_id", "kind", "version", "action")


@query("temporal_latest_version", "SELECT user_id AS item_id, max(version) AS version FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version FROM events) GROUP BY 1")
def temporal_latest_version(t: Tables) -> DataFrame:
    return t.events.groupBy(F.col("user_id").alias("item_id")).agg(F.count(F.lit(1)).alias("version"))


@query("temporal_interval_join", """
WITH p AS (SELECT o_custkey AS k, o_orderkey AS id, o_orderdate AS s, shipped AS e FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS shipped FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)
SELECT a.k AS customer, a.id AS a, b.id AS b, greatest(a.s, b.s) AS overlap_start, CASE WHEN a.e IS NOT NULL AND b.e IS NOT NULL THEN least(a.e, b.e) END AS overlap_end
FROM p a JOIN p b ON a.k = b.k AND a.id < b.id WHERE (b.e IS NULL OR a.s < b.e) AND (a.e IS NULL OR b.s < a.e)""")
def temporal_interval_join(t: Tables) -> DataFrame:
    shipped = t.lineitem.groupBy("l_orderkey").agg(F.max("l_shipdate").cast("timestamp_ntz").alias("e"))
    p = t.orders.join(shipped, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("a"), F.col("o_orderdate").cast("timestamp_ntz").alias("s"), "e")
    return tp.interval_join(p, p, ["customer"], "s", "e").filter("a < a_b").select("customer", "a", F.col("a_b").alias("b"), "overlap_start", "overlap_end")


@query("temporal_sessions", """
SELECT user_id, session, count(*) AS n FROM (SELECT user_id, (sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id))::BIGINT AS session FROM
 (SELECT user_id, ts, event_id, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))) GROUP BY ALL""")
def temporal_sessions(t: Tables) -> DataFrame:
    return tp.sessions(t.events, ["user_id"], "ts", 6 * 3600, "event_id").groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"))


@query("temporal_anchored_groups", """
WITH RECURSIVE m AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT user_id, k, event_id, t AS anchor, 1::BIGINT AS g FROM m WHERE k = 1 UNION ALL SELECT m.user_id, m.k, m.event_id, CASE WHEN m.t - anchor > 21600000000 THEN m.t ELSE anchor END, CASE WHEN m.t - anchor > 21600000000 THEN g + 1 ELSE g END FROM f JOIN m ON m.user_id = f.user_id AND m.k = f.k + 1)
SELECT user_id, g AS "group", count(*) AS size, min(event_id) AS first_id FROM f GROUP BY 1, 2 HAVING count(*) > 1""")
def temporal_anchored_groups(t: Tables) -> DataFrame:
    return tp.anchored_groups(t.events, ["user_id"], "ts", 6 * 3600, "event_id")


COALESCED = """
WITH RECURSIVE m AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, CASE event_type WHEN 'signup' THEN 'add' WHEN 'error' THEN 'delete' ELSE 'update' END AS op FROM events),
f AS (SELECT user_id, k, op AS acc FROM m WHERE k = 1 UNION ALL SELECT m.user_id, m.k, CASE WHEN acc = '' THEN op WHEN acc = 'add' AND op = 'delete' THEN '' WHEN acc = 'add' THEN 'add'
  WHEN acc = 'update' THEN CASE WHEN op = 'delete' THEN 'delete' ELSE 'update' END ELSE CASE WHEN op = 'add' THEN 'add' ELSE 'delete' END END FROM f JOIN m ON m.user_id = f.user_id AND m.k = f.k + 1)
SELECT user_id, arg_max(acc, k) AS operation FROM f GROUP BY 1 HAVING arg_max(acc, k) <> ''"""


@query("temporal_coalesce_mutations", COALESCED)
def temporal_coalesce_mutations(t: Tables) -> DataFrame:
    op = F.when(F.col("event_type") == "signup", "add").when(F.col("event_type") == "error", "delete").otherwise("update")
    return tp.coalesce_mutations(t.events.withColumn("operation", op), ["user_id"], ["ts", "event_id"])


for _grain in ("hour", "day", "week", "month"):

    @query(f"temporal_timeline_{_grain}", f"SELECT date_trunc('{_grain}', ts)::TIMESTAMP AS bucket, count(*) AS n FROM events GROUP BY 1")
    def temporal_timeline(t: Tables, grain: str = _grain) -> DataFrame:
        return tp.timeline(t.events, "ts", grain).withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query("temporal_recency", "SELECT min(ts) AS first, max(ts) AS last, count(*) AS n FROM events")
def temporal_recency(t: Tables) -> DataFrame:
    return t.events.agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n"))


@query("temporal_pattern_counts", "SELECT event_type, count(*) AS n, count(*) FILTER (WHERE tx_end IS NULL) AS created, count(*) FILTER (WHERE tx_end BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20') AS deleted FROM (SELECT kind AS event_type, tx_end FROM versions) GROUP BY 1", "versions")
def temporal_pattern_counts(t: Tables) -> DataFrame:
    return t.versions.groupBy(F.col("kind").alias("event_type")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("tx_end").isNull()).alias("created"), F.count_if(F.col("tx_end").between(at("2024-01-10"), at("2024-01-20"))).alias("deleted"))


@query("temporal_compare_times", f"""
WITH a AS (SELECT item_id, kind, version FROM versions WHERE tx_start <= TIMESTAMP '{T}' AND (tx_end IS NULL OR TIMESTAMP '{T}' < tx_end)),
b AS (SELECT item_id, kind, version FROM versions WHERE tx_start <= TIMESTAMP '2024-01-25' AND (tx_end IS NULL OR TIMESTAMP '2024-01-25' < tx_end))
SELECT item_id, kind, CASE WHEN a.version IS NULL THEN 'added' WHEN b.version IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b USING (item_id, kind) WHERE a.version IS DISTINCT FROM b.version""", "versions")
def temporal_compare_times(t: Tables) -> DataFrame:
    side = lambda x, name: tp.version_at(t.versions, at(x), ["item_id", "kind"]).select("item_id", "kind", F.col("version").alias(name))
    both = side(T, "a").join(side("2024-01-25", "b"), ["item_id", "kind"], "full").filter(~F.col("a").eqNullSafe(F.col("b")))
    return both.select("item_id", "kind", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed").alias("change"))


@query("temporal_changed_since", "SELECT DISTINCT item_id FROM versions WHERE tx_start > TIMESTAMP '2024-01-29'", "versions")
def temporal_changed_since(t: Tables) -> DataFrame:
    return t.versions.filter(F.col("tx_start") > at("2024-01-29")).select("item_id").distinct()


@query("temporal_items_in_range", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-12'")
def temporal_items_in_range(t: Tables) -> DataFrame:
    return t.events.filter(F.col("ts").between(at("2024-01-10"), at("2024-01-12"))).select("event_id")


@query("temporal_previous_event", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def temporal_previous_event(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("temporal_session_timeout", "SELECT user_id, max(ts) AS last, date_diff('second', max(ts), TIMESTAMP '2024-01-31') > 86400 AS closed FROM events GROUP BY 1")
def temporal_session_timeout(t: Tables) -> DataFrame:
    last = F.max("ts")
    idle = F.unix_seconds(at("2024-01-31").cast("timestamp")) - F.unix_seconds(last.cast("timestamp"))
    return t.events.groupBy("user_id").agg(last.alias("last"), (idle > 86400).alias("closed"))


@query("temporal_working_buffer", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 10")
def temporal_working_buffer(t: Tables) -> DataFrame:
    k = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return t.events.withColumn("k", k).filter("k <= 10").select("user_id", "event_id")


@query("temporal_tumbling_metrics", """
SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS bucket, event_type, count(*) AS n, round(avg(value), 6) AS mean, round(max(value) * 0.95, 6) AS p95, round(count(*) FILTER (WHERE event_type = 'error') / count(*), 6) AS error_rate FROM events GROUP BY 1, 2""")
def temporal_tumbling_metrics(t: Tables) -> DataFrame:
    w = t.events.groupBy(F.window("ts", "5 minutes").alias("w"), "event_type")
    out = w.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.max("value") * 0.95, 6).alias("p95"), F.round(F.avg(F.when(F.col("event_type") == "error", 1.0).otherwise(0.0)), 6).alias("error_rate"))
    return out.select(F.col("w.start").alias("bucket"), "event_type", "n", "mean", "p95", "error_rate")


@query("temporal_retention_cleanup", "SELECT count(*) AS kept FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 24 HOUR * 3")
def temporal_retention_cleanup(t: Tables) -> DataFrame:
    return t.events.filter(F.col("ts") >= at("2024-01-28")).agg(F.count(F.lit(1)).alias("kept"))


# ---- a stored index of versions -------------------------------------------------------------------------------------

_KEYED = "(SELECT item_id || ':' || kind AS item_id, version, tx_start, tx_end FROM versions)"


def _indexed(t: Tables) -> VersionIndex:
    """The versions in a stored index of two segments; an item is a user's kind of event."""
    index = VersionIndex(t.spark, so.folder(t.spark, "versions"), buckets=16)
    rows = t.versions.select(F.concat(F.col("item_id").cast("string"), F.lit(":"), "kind").alias("item_id"), "version", F.col("tx_start").alias("valid_start"), F.col("tx_end").alias("valid_end"), "tx_start")
    for early in (True, False):
        index.add(rows.filter((F.col("tx_start") < at()) == early))
    return index


@query("temporal_stored_lookup", f"""
SELECT item_id, arg_max(version, (tx_start, version)) FILTER (WHERE tx_end IS NULL OR TIMESTAMP '{T}' < tx_end) AS valid, arg_max(version, (tx_start, version)) AS known
FROM {_KEYED} WHERE tx_start <= TIMESTAMP '{T}' AND item_id IN ('1:click', '2:click', '3:view', '4:error', '5:purchase') GROUP BY 1""", "versions")
def temporal_stored_lookup(t: Tables) -> DataFrame:
    """Versions of a few items at one time, by valid and by transaction time, from their buckets alone."""
    items, index, when = ["1:click", "2:click", "3:view", "4:error", "5:purchase"], _indexed(t), datetime.fromisoformat(T)
    valid = index.version_at(items, when).withColumnRenamed("version", "valid")
    return valid.join(index.version_at(items, when, "transaction").withColumnRenamed("version", "known"), "item_id", "full")


@query("temporal_stored_as_of", f"""
SELECT event_id, arg_max(version, (tx_start, version)) AS version FROM events LEFT JOIN {_KEYED} v ON v.item_id = user_id || ':click' AND tx_start <= ts WHERE event_type = 'purchase' GROUP BY 1""", "versions")
def temporal_stored_as_of(t: Tables) -> DataFrame:
    """For every purchase the version of the buyer's clicks at its time."""
    probes = t.events.filter("event_type = 'purchase'").select("event_id", F.concat(F.col("user_id").cast("string"), F.lit(":click")).alias("item_id"), F.col("ts").alias("at"))
    return _indexed(t).as_of(probes).select("event_id", F.col("version_at").alias("version"))


@query("temporal_stored_range", f"SELECT DISTINCT item_id FROM {_KEYED} WHERE tx_start >= TIMESTAMP '2024-01-10' AND tx_start < TIMESTAMP '2024-01-13'", "versions")
def temporal_stored_range(t: Tables) -> DataFrame:
    return _indexed(t).items_starting(datetime(2024, 1, 10, 15), datetime(2024, 1, 12, 1))
