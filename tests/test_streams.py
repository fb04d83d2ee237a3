"""Streams with keyed state: against plain machines, over restarts and other cuts into batches."""

import random
import sys
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from memlattice.streaming import metrics as st
from memlattice.streaming import stateful as sf

MESSAGES = "key string, at timestamp, id long, kind string"
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
MINUTE = 60_000


def ms(t):
    return (t - EPOCH) // timedelta(milliseconds=1)


def messages(rng, n=400):
    kinds = ["enqueue"] * 3 + ["ack", "fail", "other", None]
    rows = [(rng.choice(["a", "b", "c", None]), T0 + timedelta(seconds=rng.randint(0, 40_000)), k, rng.choice(kinds)) for k in range(n)]
    rows += [("a", None, 9000, "enqueue"), ("only", T0, 9001, "enqueue"), ("acks", T0, 9002, "ack")]
    return sorted(rows, key=lambda r: (r[1] or T0, r[2]))


def machine(rows, attempts, visible, until):
    """The queue of each key, message by message."""
    out = []
    for key in {r[0] for r in rows}:
        now = [ms(r[1]) for r in rows if r[0] == key and r[1] and r[3]]
        due = sorted((ms(r[1]), r[2], r[3]) for r in rows if r[0] == key and r[1] and r[3] and ms(r[1]) <= until)
        job = attempt = 0
        deadline = None

        def again(reason, at):
            nonlocal attempt, deadline
            if attempt < attempts:
                attempt, deadline = attempt + 1, at + visible
                out.append((key, job, attempt, "delivered", reason, at))
            else:
                deadline = None
                out.append((key, job, attempt, "dead", reason, at))

        for at, _, kind in [*due, (until, None, None)] if now else []:
            while deadline is not None and deadline <= at:
                again("timeout", deadline)
            if kind == "enqueue" and deadline is None:
                job, attempt, deadline = job + 1, 1, at + visible
                out.append((key, job, 1, "delivered", "enqueued", at))
            elif kind == "ack" and deadline is not None:
                deadline = None
                out.append((key, job, attempt, "done", "acknowledged", at))
            elif kind == "fail" and deadline is not None:
                again("error", at)
    return sorted(out, key=str)


def bursts(rows, wait, idle, until):
    out = []
    for key in {r[0] for r in rows}:
        at = sorted(ms(r[1]) for r in rows if r[0] == key and r[1] and ms(r[1]) <= until)
        groups = []
        for t in at:
            if groups and t - groups[-1][-1] < wait:
                groups[-1].append(t)
            else:
                groups.append([t])
        for k, g in enumerate(groups):
            if g[-1] + wait <= until:
                out.append((key, "flush", g[0], g[-1], len(g), g[-1] + wait))
            if g[-1] + idle <= until and (k + 1 == len(groups) or groups[k + 1][0] >= g[-1] + idle):
                out.append((key, "full cycle", g[-1], g[-1], 0, g[-1] + idle))
    return sorted(out, key=str)


def run(spark, folder, parts, make, keys):
    """Every part is a file that comes before another start of the stream, which goes on from its checkpoint."""
    rows = None
    for k, part in enumerate(parts):
        spark.createDataFrame(part, MESSAGES).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = make(spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"))
        with sf.keyed_state(spark):
            rows = st.latest_table(stream, f"{folder}/out", keys, "append").select(stream.columns).collect()
        assert k == 0 or len({tuple(r) for r in rows}) == len(rows)
    return sorted((tuple(r) for r in rows), key=str)


@pytest.mark.parametrize("cuts", [1, 3])
def test_queue_is_the_machine_whatever_the_batches(spark, tmp_path, cuts):
    rng = random.Random(cuts)
    rows = messages(rng)
    # within a part in any order, and late by less than the allowed hour across parts
    late = sorted(rows, key=lambda r: ((r[1] or T0) + timedelta(seconds=rng.randint(0, 3000)), r[2]))
    parts = [late[k * len(late) // cuts : (k + 1) * len(late) // cuts] for k in range(cuts)]
    for p in parts:
        rng.shuffle(p)
    until = max(ms(r[1]) for r in rows if r[1] and r[3]) - 60 * MINUTE
    got = run(spark, str(tmp_path), parts, lambda m: sf.job_queue(m, attempts=2, visible_ms=10 * MINUTE, late="1 hour"), ["key", "job", "attempt", "state"])
    assert got == machine(rows, 2, 10 * MINUTE, until)
    assert {r[3] for r in got} == {"delivered", "done", "dead"} and {r[4] for r in got if r[3] == "dead"} == {"error", "timeout"}


@pytest.mark.parametrize("cuts", [1, 3])
def test_bursts_are_flushed_once_and_idle_keys_get_a_cycle(spark, tmp_path, cuts):
    rows = messages(random.Random(7), 150)
    parts = [rows[k * len(rows) // cuts : (k + 1) * len(rows) // cuts] for k in range(cuts)]
    until = max(ms(r[1]) for r in rows if r[1])
    got = run(spark, str(tmp_path), parts, lambda m: sf.debounced(m, wait_ms=5 * MINUTE, idle_ms=20 * MINUTE, late="0 seconds"), ["key", "action", "at"])
    assert got == bursts(rows, 5 * MINUTE, 20 * MINUTE, until)
    assert {r[1] for r in got} == {"flush", "full cycle"}
    with pytest.raises(ValueError):
        sf.debounced(spark.createDataFrame([], MESSAGES), wait_ms=5, idle_ms=5)


@pytest.mark.parametrize("slots", [1, 1024])
def test_keys_that_share_a_slot_keep_their_own_states(spark, tmp_path, monkeypatch, slots):
    monkeypatch.setattr(sf, "SLOTS", slots)
    monkeypatch.setattr(sys.modules[__name__], "MESSAGES", MESSAGES.replace("key string", "key long"))
    keys = {"a": 2**60 + 1, "b": 2**60 + 2, "c": 7, "only": 8, "acks": 9}  # beside a null key, longs are no doubles
    rows = [(keys.get(k), *r) for k, *r in messages(random.Random(11), 200)]
    parts = [rows[:70], rows[70:140], rows[140:]]
    until = max(ms(r[1]) for r in rows if r[1])
    got = run(spark, f"{tmp_path}/bursts", parts, lambda m: sf.debounced(m, wait_ms=5 * MINUTE, idle_ms=20 * MINUTE, late="0 seconds"), ["key", "action", "at"])
    assert got == bursts(rows, 5 * MINUTE, 20 * MINUTE, until) and len({r[0] for r in got}) == 6
    until = max(ms(r[1]) for r in rows if r[1] and r[3])
    got = run(spark, f"{tmp_path}/queue", parts, lambda m: sf.job_queue(m, attempts=2, visible_ms=10 * MINUTE, late="0 seconds"), ["key", "job", "attempt", "state"])
    assert got == machine(rows, 2, 10 * MINUTE, until)


def test_many_keys_take_few_timers(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sf, "SLOTS", 2, raising=False)
    rows = [(f"k{k}", T0 + timedelta(minutes=k % 7 + 300 * j), 2 * k + j, None) for k in range(60) for j in range(2)]
    spark.createDataFrame(rows, MESSAGES).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(MESSAGES).parquet(f"{tmp_path}/in")
    with sf.keyed_state(spark):
        q = sf.debounced(stream, wait_ms=5 * MINUTE, idle_ms=20 * MINUTE, late="0 seconds").writeStream.format("memory").queryName("few_timers").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted((tuple(r) for r in spark.table("few_timers").collect()), key=str) == bursts(rows, 5 * MINUTE, 20 * MINUTE, max(ms(r[1]) for r in rows))
    set_timers = [int(dict(o.customMetrics)["numRegisteredTimers"]) for p in q.recentProgress for o in p.stateOperators]
    assert 2 <= sum(set_timers) <= 2 * len(set_timers)


def test_no_messages_give_no_rows(spark, tmp_path):
    assert run(spark, str(tmp_path), [[]], lambda m: sf.job_queue(m), ["key", "job", "attempt", "state"]) == []


def test_co_retrieved_pairs(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.choice(["u", "v", None]), T0 + timedelta(minutes=rng.randint(0, 2000)), k, rng.choice(["search", "get"])) for k in range(300)]
    rows.sort(key=lambda r: r[1])
    folder = str(tmp_path)
    for part in (rows[:150], rows[150:]):
        spark.createDataFrame(part, MESSAGES).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(MESSAGES).parquet(f"{folder}/in")
        side = lambda kind: stream.filter(F.col("kind") == kind).select(F.col("key").alias("user_id"), "at", "id")  # noqa: B023, E731
        got = st.latest_table(sf.co_retrieved(side("search"), side("get"), "30 minutes"), f"{folder}/out", ["search_id", "get_id"], "append").collect()
    want = {(a[2], b[2]) for a in rows for b in rows if a[3] == "search" and b[3] == "get" and a[0] == b[0] is not None and timedelta() <= b[1] - a[1] <= timedelta(minutes=30)}
    assert {(r.search_id, r.get_id) for r in got} == want and len(got) == len(want) > 10
