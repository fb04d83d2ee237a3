"""Streams with keyed state over the events: the job queue, debounced bursts and co-retrieved pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlattice.operators import graph as g
from memlattice.sources.tables import Tables
from memlattice.streaming import metrics as st
from memlattice.streaming import stateful as sf

from .registry import query

HOUR = 3_600_000
#: What a user's events tell a queue.
_KIND = {"signup": "enqueue", "purchase": "ack", "error": "fail"}
_UNTIL = "(SELECT (epoch_us(max(ts)) // 1000) - 86400000 FROM events)"
_QUEUE = f"""
WITH RECURSIVE m AS (
  SELECT user_id, (epoch_us(ts) // 1000) AS at_ms, event_type AS kind, row_number() OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000), event_id) AS i FROM events WHERE event_type IN ('signup', 'purchase', 'error') AND (epoch_us(ts) // 1000) <= {_UNTIL.replace("FROM events", "FROM events WHERE event_type IN ('signup', 'purchase', 'error')")}
), bound AS (
  SELECT (epoch_us(max(ts)) // 1000) - 86400000 AS w FROM events WHERE event_type IN ('signup', 'purchase', 'error')
), walk AS (
  SELECT DISTINCT user_id, 0::BIGINT AS i, 0::BIGINT AS job, 0 AS attempt, NULL::BIGINT AS deadline, NULL::VARCHAR AS state, NULL::VARCHAR AS reason, NULL::BIGINT AS at_ms FROM m
  UNION ALL
  SELECT s.user_id, CASE WHEN s.timer THEN s.i ELSE s.i + 1 END,
    CASE WHEN NOT s.timer AND s.kind = 'signup' AND s.deadline IS NULL THEN s.job + 1 ELSE s.job END,
    CASE WHEN (s.timer OR s.kind = 'error') AND s.deadline IS NOT NULL AND s.attempt < 3 THEN s.attempt + 1 WHEN NOT s.timer AND s.kind = 'signup' AND s.deadline IS NULL THEN 1 ELSE s.attempt END,
    CASE WHEN (s.timer OR s.kind = 'error') AND s.deadline IS NOT NULL THEN CASE WHEN s.attempt < 3 THEN s.happens + {6 * HOUR} END
         WHEN s.kind = 'signup' AND s.deadline IS NULL THEN s.happens + {6 * HOUR} WHEN s.kind = 'purchase' THEN NULL ELSE s.deadline END,
    CASE WHEN (s.timer OR s.kind = 'error') AND s.deadline IS NOT NULL THEN CASE WHEN s.attempt < 3 THEN 'delivered' ELSE 'dead' END
         WHEN s.kind = 'signup' AND s.deadline IS NULL THEN 'delivered' WHEN s.kind = 'purchase' AND s.deadline IS NOT NULL THEN 'done' END,
    CASE WHEN s.timer THEN 'timeout' WHEN s.kind = 'error' THEN 'error' WHEN s.kind = 'signup' THEN 'enqueued' ELSE 'acknowledged' END, s.happens
  FROM (SELECT k.*, m.kind, coalesce(k.deadline <= bound.w AND (m.at_ms IS NULL OR k.deadline <= m.at_ms), false) AS timer,
               CASE WHEN coalesce(k.deadline <= bound.w AND (m.at_ms IS NULL OR k.deadline <= m.at_ms), false) THEN k.deadline ELSE m.at_ms END AS happens
        FROM (SELECT user_id, i, job, attempt, deadline FROM walk) k CROSS JOIN bound LEFT JOIN m ON m.user_id = k.user_id AND m.i = k.i + 1) s
  WHERE s.happens IS NOT NULL
)
"""


def _messages(t: Tables, kinds: dict[str, str] | None = None) -> DataFrame:
    events = st.read_events(t.spark, f"{t.sf_dir}/events.parquet")
    kind = F.col("event_type") if kinds is None else F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in kinds.items()])
    return events.select(F.col("user_id").alias("key"), F.col("ts").alias("at"), F.col("event_id").alias("id"), kind.alias("kind"))


def _transitions(t: Tables) -> DataFrame:
    stream = sf.job_queue(_messages(t, _KIND), attempts=3, visible_ms=6 * HOUR)
    with sf.keyed_state(t.spark):
        return st.latest_table(stream, st.new_folder(g.shared_root(t.spark)), ["key", "job", "attempt", "state"], "append")


@query("stream_job_queue", _QUEUE + "SELECT user_id, job, attempt, state, reason, at_ms FROM walk WHERE state IS NOT NULL")
def stream_job_queue(t: Tables) -> DataFrame:
    """A queue that users' events drive: sign-ups enqueue, purchases acknowledge, errors fail, six hours time out."""
    return _transitions(t).withColumnsRenamed({"key": "user_id", "at": "at_ms"})


@query("stream_dead_letters", _QUEUE + "SELECT user_id, count(*) AS n_dead, count(*) FILTER (WHERE reason = 'timeout') AS n_timeout, max(at_ms) AS last_ms FROM walk WHERE state = 'dead' GROUP BY user_id")
def stream_dead_letters(t: Tables) -> DataFrame:
    """Users' jobs that three attempts could not finish."""
    dead = _transitions(t).filter("state = 'dead'").groupBy(F.col("key").alias("user_id"))
    return dead.agg(F.count(F.lit(1)).alias("n_dead"), F.count_if(F.col("reason") == "timeout").alias("n_timeout"), F.max("at").alias("last_ms"))


@query("stream_debounced_work", f"""
WITH e AS (SELECT user_id, (epoch_us(ts) // 1000) AS at_ms FROM events WHERE (epoch_us(ts) // 1000) <= {_UNTIL}
), marked AS (SELECT user_id, at_ms, coalesce(at_ms - lag(at_ms) OVER w >= {2 * HOUR}, true) AS opens FROM e WINDOW w AS (PARTITION BY user_id ORDER BY at_ms)
), bursts AS (SELECT user_id, at_ms, sum(opens::INT) OVER (PARTITION BY user_id ORDER BY at_ms ROWS UNBOUNDED PRECEDING) AS k FROM marked
), spans AS (SELECT user_id, k, min(at_ms) AS first_ms, max(at_ms) AS last_ms, count(*) AS n FROM bursts GROUP BY user_id, k
), ahead AS (SELECT *, lead(first_ms) OVER (PARTITION BY user_id ORDER BY k) AS following FROM spans)
SELECT user_id, 'flush' AS action, first_ms, last_ms, n, last_ms + {2 * HOUR} AS at_ms FROM ahead WHERE last_ms + {2 * HOUR} <= {_UNTIL}
UNION ALL SELECT user_id, 'full cycle', last_ms, last_ms, 0, last_ms + {12 * HOUR} FROM ahead WHERE last_ms + {12 * HOUR} <= {_UNTIL} AND (following IS NULL OR following >= last_ms + {12 * HOUR})""")
def stream_debounced_work(t: Tables) -> DataFrame:
    """Bursts of a user's events, two hours apart, and full cycles after twelve idle hours."""
    stream = sf.debounced(_messages(t), wait_ms=2 * HOUR, idle_ms=12 * HOUR)
    with sf.keyed_state(t.spark):
        out = st.latest_table(stream, st.new_folder(g.shared_root(t.spark)), ["key", "action", "at"], "append")
    return out.withColumnsRenamed({"key": "user_id", "first": "first_ms", "last": "last_ms", "at": "at_ms"})


@query("stream_co_retrieved_pairs", """
SELECT s.user_id, s.event_id AS search_id, e.event_id AS get_id, (epoch_us(e.ts) // 1000) - (epoch_us(s.ts) // 1000) AS gap_ms FROM events s JOIN events e ON s.user_id = e.user_id AND s.event_type = 'view' AND e.event_type = 'click' AND e.ts >= s.ts AND e.ts <= s.ts + INTERVAL 6 HOUR""")
def stream_co_retrieved_pairs(t: Tables) -> DataFrame:
    """Views and the clicks that follow them within six hours, by a join of two streams."""
    side = lambda kind: st.read_events(t.spark, f"{t.sf_dir}/events.parquet").filter(F.col("event_type") == kind).select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("id"))
    stream = sf.co_retrieved(side("view"), side("click"), "6 hours")
    rows = st.latest_table(stream, st.new_folder(g.shared_root(t.spark)), ["search_id", "get_id"], "append")
    return rows.select("user_id", "search_id", "get_id", (F.unix_millis("got_at") - F.unix_millis("searched_at")).alias("gap_ms"))
