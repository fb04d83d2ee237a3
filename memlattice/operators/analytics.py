"""Aggregates over memories: word shares, drift, bias, concentration, information measures, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memlattice.functions import text as tx


def word_counts(df: DataFrame, keys: list[str], text: str, least: int = 0) -> DataFrame:
    w = F.filter(tx.words(F.col(text)), lambda x: F.length(x) > least) if least else tx.words(F.col(text))
    return df.select(*keys, F.explode(w).alias("word")).groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("n"))


def top_words(counts: DataFrame, keys: list[str], k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("n"), "word"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= k)


def jensen_shannon(p: DataFrame, q: DataFrame, key: str) -> DataFrame:
    """One row, js and kl: of two tables (key, n); 1e-10 is added to each share before they are normalised again."""
    both = p.select(key, F.col("n").alias("a")).join(q.select(key, F.col("n").alias("b")), key, "full").na.fill(0, ["a", "b"])
    sums = both.agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"), F.count(F.lit(1)).alias("k"))
    x = both.join(F.broadcast(sums), F.lit(True))
    eps = F.lit(1e-10)
    share = lambda n, s: (F.col(n) / F.col(s) + eps) / (1 + eps * F.col("k"))
    x = x.select(share("a", "sa").alias("p"), share("b", "sb").alias("q")).withColumn("m", (F.col("p") + F.col("q")) / 2)
    kl = lambda u, v: F.sum(F.col(u) * F.log(F.col(u) / F.col(v)))
    return x.agg(F.round((kl("p", "m") + kl("q", "m")) / 2, 6).alias("js"), F.round(kl("p", "q"), 6).alias("kl"))


def gini(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Gini coefficient of a value in each group: sum((2i - n - 1) x_i) / (n sum x), from ranks of distinct values.

    Equal values are aggregated first, so only the distinct values of a group are ordered in one place.
    """
    c = df.groupBy(*keys, F.col(value).alias("x")).agg(F.count(F.lit(1)).alias("c"))
    w = W.partitionBy(*keys).orderBy("x")
    before = F.coalesce(F.sum("c").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    n = F.sum("c").over(W.partitionBy(*keys))
    ranked = c.withColumns({"before": before, "n": n})
    # ranks before+1 .. before+c of an x: the sum of (2i - n - 1)
    part = F.col("x") * F.col("c") * (2 * F.col("before") + F.col("c") - F.col("n"))
    out = ranked.groupBy(*keys).agg(F.sum(part).alias("u"), F.first("n").alias("n"), F.sum(F.col("x") * F.col("c")).alias("s"))
    return out.select(*keys, F.round(F.when(F.col("s") != 0, F.col("u") / (F.col("n") * F.col("s"))).otherwise(0.0), 6).alias("gini"))


def distribution(df: DataFrame, attribute: str) -> DataFrame:
    """(attribute, n, share, entropy, max_min_ratio): how an attribute is distributed and how uneven that is."""
    n = df.groupBy(attribute).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("total"), F.max("n").alias("most"), F.min("n").alias("least"))
    x = n.join(F.broadcast(total), F.lit(True)).withColumn("p", F.col("n") / F.col("total"))
    e = x.agg(F.sum(-F.col("p") * F.log("p")).alias("entropy"))
    return x.join(F.broadcast(e), F.lit(True)).select(attribute, "n", F.round("p", 6).alias("share"), F.round("entropy", 6).alias("entropy"), F.round(F.col("most") / F.col("least"), 6).alias("max_min_ratio"))


def precision_recall(found: DataFrame, truth: DataFrame, key: list[str], label: str) -> DataFrame:
    """One row: correct, wrong_type, spurious, missing, precision, recall, f1 of labelled keys."""
    f, t = found.select(*key, F.col(label).alias("found")), truth.select(*key, F.col(label).alias("true"))
    both = f.join(t, key, "full")
    n = both.agg(
        F.count_if(F.col("found") == F.col("true")).alias("correct"), F.count_if(F.col("found") != F.col("true")).alias("wrong_type"),
        F.count_if(F.col("true").isNull()).alias("spurious"), F.count_if(F.col("found").isNull()).alias("missing"),
    )
    given, real = F.col("correct") + F.col("wrong_type") + F.col("spurious"), F.col("correct") + F.col("wrong_type") + F.col("missing")
    p, r = F.when(given > 0, F.col("correct") / given).otherwise(0.0), F.when(real > 0, F.col("correct") / real).otherwise(0.0)
    return n.select("*", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 6).alias("f1"))


def topic_divergence(rows: DataFrame, topics: int, seed: int = 7) -> DataFrame:
    """(a, b, divergence): Jensen-Shannon divergence of the mean topic mixes of each two values, by online LDA of rows (value, text).

    Values are an attribute's, so their pairs are few; the mixes are summed before they are paired.
    """
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer
    from pyspark.ml.functions import vector_to_array

    words = rows.withColumn("words", F.filter(F.split(F.lower("text"), r"\s+"), lambda x: x != ""))
    counted = CountVectorizer(inputCol="words", outputCol="features").fit(words).transform(words)
    mixed = LDA(k=topics, seed=seed, optimizer="online", maxIter=5).fit(counted).transform(counted)
    p = mixed.select("value", F.posexplode(vector_to_array("topicDistribution")).alias("topic", "p")).groupBy("value", "topic").agg(F.avg("p").alias("p"))
    pairs = p.select(F.col("value").alias("a"), "topic", F.col("p").alias("pa")).join(p.select(F.col("value").alias("b"), "topic", F.col("p").alias("pb")), "topic").filter("a < b")
    middle = (F.col("pa") + F.col("pb")) / 2
    part = 0.5 * (F.col("pa") * F.log(F.col("pa") / middle) + F.col("pb") * F.log(F.col("pb") / middle))
    return pairs.groupBy("a", "b").agg(F.round(F.sum(part), 6).alias("divergence"))


#: Items that a quantile sketch keeps about: exact up to that many values, then within about 0.1 % of the rank.
SKETCH = 4096


def stage_sketches(events: DataFrame, at: str, stage: str, value: str, error: Column, width: str = "5 minutes") -> DataFrame:
    """(bucket, stage, n, total, most, errors, sketch): of each stretch of time and stage, with a quantile sketch of its values.

    What later reports need of the rows, to be stored in their place.  Null values count as rows without one; null
    times are in no bucket; a bucket without any value has no sketch.
    """
    bucket = F.window(at, width)["start"].alias("bucket")
    known = F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(SKETCH))
    return events.groupBy(bucket, F.col(stage).alias("stage")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.max(value).alias("most"), F.count_if(error).alias("errors"), F.count(value).alias("n_values"), known.alias("sketch")
    )


def exact_quantiles(events: DataFrame, keys: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """(keys..., quantiles...): the least value whose share of values up to it is large enough, of any number of rows.

    Equal values are counted before they are ordered, so only a group's distinct values meet.  Null values don't count;
    groups of nothing else have no row.
    """
    c = events.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("x")).agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(W.partitionBy(*keys).orderBy("x").rowsBetween(W.unboundedPreceding, 0))
    ranked = c.withColumns({"upto": upto, "n": F.sum("c").over(W.partitionBy(*keys))})
    return ranked.groupBy(*keys).agg(*[F.min(F.when(F.col("upto") >= F.ceil(F.col("n") * F.lit(float(q))), F.col("x"))).alias(name) for name, q in quantiles.items()])


def roll_up(sketches: DataFrame, width: str, quantiles: dict[str, float]) -> DataFrame:
    """(bucket, stage, n, mean, most, error_rate, quantiles...) of wider stretches, from stored sketches alone, which merge.

    A quantile is the least value whose share of values up to it is large enough.  Merging is a partial aggregate, so a
    stage with most of the rows sends one sketch from each task.
    """
    bucket = F.window("bucket", width)["start"].alias("bucket")
    merged = sketches.groupBy(bucket, "stage").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("most").alias("most"), F.sum("errors").alias("errors"), F.sum("n_values").alias("n_values"), F.kll_merge_agg_double("sketch", F.lit(SKETCH)).alias("sketch")
    )
    some = lambda q: F.when(F.col("n_values") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))))
    return merged.select("bucket", "stage", "n", (F.col("total") / F.col("n_values")).alias("mean"), "most", (F.col("errors") / F.col("n")).alias("error_rate"), *[some(q).alias(c) for c, q in quantiles.items()])
