"""The stored index of versions, overlap pairs and labels by vectors, against loops over the same rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from memlattice.operators import relations as rl
from memlattice.operators import simjoin as sj
from memlattice.operators.timeindex import VersionIndex

START = dt.datetime(2024, 1, 28)
SCHEMA = "item_id string, version int, valid_start timestamp_ntz, valid_end timestamp_ntz, tx_start timestamp_ntz, bucket string"


def hours(n):
    return START + dt.timedelta(hours=n)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Overlapping versions of one hot item and some others over two months, with null ends, repeated rows and null keys."""
    rng = random.Random(3)
    rows = []
    for k in range(600):
        item = "hot" if k % 3 == 0 else f"i{rng.randint(0, 20)}"
        s = rng.randint(0, 300)
        rows.append((item, k, hours(s), rng.choice([None, hours(s), hours(s + rng.randint(1, 60))]), hours(s + rng.randint(0, 3)), "x"))
    rows += rows[:5] + [(None, 1, START, None, START, "x"), ("i1", 9999, None, None, None, "x")]
    index = VersionIndex(spark, str(tmp_path_factory.mktemp("versions")), buckets=4)
    df = spark.createDataFrame(rows, SCHEMA)
    index.add(df.filter("version < 300"))
    index.add(df.filter("version >= 300"))
    index.add(df.limit(0))
    return index, rows


def best(rows, item, at, valid):
    start = 2 if valid else 4
    held = [(r[start], r[1]) for r in rows if r[0] == item and r[start] and r[start] <= at and (not valid or r[3] is None or at < r[3])]
    return max(held)[1] if held else None


@pytest.mark.parametrize("time_type", ["valid", "transaction"])
def test_stored_versions_at_a_time(stored, time_type):
    index, rows = stored
    for n in (-1, 0, 50, 299, 900):
        got = {r.item_id: r.version for r in index.version_at(["hot", "i1", "i2", "nobody"], hours(n), time_type).collect()}
        want = {i: best(rows, i, hours(n), time_type == "valid") for i in ("hot", "i1", "i2", "nobody")}
        assert got == {k: v for k, v in want.items() if v is not None}


def test_stored_versions_in_days(stored):
    index, rows = stored
    for low, high in ((0, 0), (70, 110), (-900, -800), (-24, 2000)):
        days = (hours(low).date(), hours(high).date())
        want = {r[0] for r in rows if r[0] and r[2] and days[0] <= r[2].date() <= days[1]}
        assert {r.item_id for r in index.items_starting(hours(low), hours(high)).collect()} == want


@pytest.mark.parametrize("period", [3600, 86_400, 10**9])
def test_stored_versions_as_of_each_probe(spark, stored, period):
    index, rows = stored
    rng = random.Random(5)
    probes = [(k, rng.choice(["hot", "i1", "i7", "nobody"]), hours(rng.randint(-5, 400))) for k in range(120)]
    probes += [probes[0], (500, None, START), (501, "hot", None), (502, "hot", max(r[4] for r in rows if r[0] == "hot"))]
    df = spark.createDataFrame(probes, "version int, item_id string, at timestamp_ntz")
    got = sorted((r.version, r.version_at) for r in index.as_of(df, period).collect())
    want = sorted((k, best(rows, i, at, False) if i and at else None) for k, i, at in probes)
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert index.as_of(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        index.as_of(df.withColumn("version_at", F.lit(1)))


def test_stored_versions_prune_files(stored):
    index, _ = stored
    point = index.versions_of(["hot"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in point or "PartitionFilters: [bucket" in point
    assert "EqualTo(item_id,hot)" in point or "In(item_id, [hot])" in point
    days = index.items_starting(hours(0), hours(1))._jdf.queryExecution().toString()
    assert "month" in days.split("PartitionFilters: [")[1].split("PushedFilters")[0] and "GreaterThanOrEqual(valid_start" in days


@pytest.mark.parametrize("above", [0.0, 0.5, 0.8])
def test_overlap_pairs_are_all_pairs_above(spark, above):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(25)]
    rows = [(k, rng.choice(["x", None]), rng.sample(words, rng.randint(0, 7)) + ["the"] * rng.randint(0, 2)) for k in range(120)]
    rows += [(900, "x", None), (901, "x", [None]), (902, "x", ["solo"]), (903, "x", ["solo", "solo"]), (904, "y", ["solo"])]
    got = {(r.g, r.a, r.b): r.overlap for r in sj.overlap_pairs(spark.createDataFrame(rows, "id long, g string, t array<string>"), "id", "t", above, ["g"]).collect()}
    sets = [(k, g, {x for x in t or [] if x}) for k, g, t in rows]
    want = {}
    for i, (a, g, s) in enumerate(sets):
        for b, h, t in sets[i + 1 :]:
            if g == h and s and t and len(s & t) / min(len(s), len(t)) > above:
                want[g, a, b] = len(s & t) / min(len(s), len(t))
    assert got == pytest.approx(want) and ("x", 902, 903) in got


def test_labels_take_the_nearest_type(spark):
    types = spark.createDataFrame([("works at", [1.0, 0.0]), ("also at", [2.0, 0.0]), ("near", [0.0, 1.0]), ("long", [1.0, 0.0, 0.0]), ("zero", [0.0, 0.0])], "canonical string, embedding array<double>")
    aliases = spark.createDataFrame([("is in", "located_in")], "alias string, canonical string")
    vectors = {"employed by": [3.0, 0.1], "far off": [-1.0, -1.0], "half": [1.0, 1.0], "none": None, "empty": [], "nil": [0.0, 0.0]}

    def embed(text):
        out = F.lit(None).cast("array<double>")
        for k, v in vectors.items():
            out = F.when(text == k, F.lit(None).cast("array<double>") if v is None else F.array(*map(F.lit, v)).cast("array<double>")).otherwise(out)
        return out

    labels = ["Is  In", "employed-by", "Employed By", "far off", "half", "none", "empty", "nil", "", None]
    rows = spark.createDataFrame([(x, k) for k, x in enumerate(labels)], "predicate string, n int")
    got = [(r.canonical, round(r.match, 3)) for r in rl.normalise_by_vectors(rows, aliases, types, embed).orderBy("n").collect()]
    assert got == [("located_in", 1.0), ("also at", 0.999), ("also at", 0.999), *[("related_to", 0.0)] * 7]
    assert rl.normalise_by_vectors(rows, aliases, types, embed, 0.7).filter("n = 4").first().canonical == "also at"
    assert rl.normalise_by_vectors(rows, aliases, types.limit(0), embed).filter("match = 0").count() == 9


def test_candidates_by_their_most_frequent_kind(spark):
    seen = spark.createDataFrame([("a", "x", 0.9), ("a", "x", None), ("a", "y", 0.6), ("b", None, None), (None, "x", 1.0), ("c", "p", 0.5), ("c", "q", 0.7)], "name string, kind string, confidence double")
    got = {r.name: (r.kind, r.n, r.confidence, r.consistency) for r in rl.candidates(seen).collect()}
    assert got == {"a": ("x", 3, 0.75, pytest.approx(2 / 3)), "b": (None, 1, None, 1.0), "c": ("q", 2, 0.6, 0.5)}
    assert rl.candidates(seen.limit(0)).count() == 0
