"""Phrases of a dictionary in texts: n-grams joined by equality, longer ones first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a stretch of a text, whose n-grams are made at once.
STRETCH = 65_536
#: Characters of a dictionary, or of its phrases' first words, with 32 more for each, that may travel to every task.
TRAVELS = 64_000_000


def phrases(dictionary: DataFrame, most: int = 4) -> DataFrame:
    """(phrase, kind) of (phrase, kind): lower case, single spaces, 1 to `most` words; of a phrase's kinds the smallest."""
    words = F.filter(F.split(F.lower("phrase"), r"\s+"), lambda x: x != "")
    tidy = dictionary.select(words.alias("w"), "kind").filter(F.size("w").between(1, most))
    return tidy.select(F.array_join("w", " ").alias("phrase"), "kind").groupBy("phrase").agg(F.min("kind").alias("kind"))


def _runs(most: int) -> Column:
    """array<struct<n, span>>: the runs of 1 to `longest` words that start at each row's first one; w1, w2 and so on are its words."""

    def of(n: int) -> Column:
        whole = F.col(f"z.w{n}").isNotNull() & (F.col("longest") >= n)
        return F.when(whole, F.struct(F.lit(n).alias("n"), F.concat_ws(" ", *[F.col(f"z.w{k}") for k in range(1, n + 1)]).alias("span")))

    return F.array(*[of(n) for n in range(1, most + 1)])


def _travels(df: DataFrame, column: str) -> bool:
    return df.agg(F.coalesce(F.sum(F.length(column) + 32), F.lit(0))).first()[0] <= TRAVELS


def dictionary_matches(items: DataFrame, dictionary: DataFrame, most: int = 4) -> DataFrame:
    """(item_id, span, kind, place, times) of items (item_id, content) by dictionary (phrase, kind).

    A phrase is found where a text holds its words in a row, in any case; it counts once, as the first place (a word's
    number from 0) spells it, with how often it stands there.  A single word that is part of a longer phrase found in the
    same text is no match of its own.  Words lie between white space, with their punctuation.

    A text of any length is read by stretches, once; only words that begin a phrase start runs of words, as long as those
    phrases, where the phrases' first words can travel to the tasks.  A dictionary of any size is joined by equality, and
    travels too where its measured size allows.  Null contents hold nothing; rows of one item_id are one text's stretches:
    give repeated rows ids of their own.  Other columns are not read.
    """
    known = phrases(dictionary, most)
    heads = known.groupBy(F.substring_index("phrase", " ", 1).alias("head")).agg(F.max(F.size(F.split("phrase", " "))).alias("longest"))
    words = F.array_remove(F.split(F.col("content"), r"\s+"), "")
    texts = items.select("item_id", words.alias("w")).filter("size(w) > 0")
    starts = F.explode(F.sequence(F.lit(0), F.size("w") - 1, F.lit(STRETCH))).alias("start")
    stretches = texts.select("item_id", "w", starts).select("item_id", "start", F.slice("w", F.col("start") + 1, F.lit(STRETCH + most - 1)).alias("w"))
    # each word with those that follow it, so that a row is short
    beside = F.arrays_zip(*[F.slice("w", n, F.size("w")).alias(f"w{n}") for n in range(1, most + 1)])
    places = stretches.select("item_id", "start", F.posexplode(beside).alias("i", "z")).filter(F.col("i") < STRETCH)
    places = places.select("item_id", (F.col("start") + F.col("i")).alias("place"), "z", F.lower("z.w1").alias("head"))
    begun = places.join(F.broadcast(heads), "head") if _travels(heads, "head") else places.withColumn("longest", F.lit(most))
    spans = begun.select("item_id", "place", F.explode(_runs(most)).alias("g")).filter("g is not null")
    spans = spans.select("item_id", "place", F.col("g.n").alias("n"), F.col("g.span").alias("span"), F.lower("g.span").alias("phrase"))
    met = spans.join(F.broadcast(known) if _travels(known, "phrase") else known, "phrase")
    # a longer phrase also marks its words as covered
    keys = F.when(F.col("n") > 1, F.concat(F.array("phrase"), F.split("phrase", " "))).otherwise(F.array("phrase"))
    marked = met.select("item_id", "phrase", "kind", "place", "span", F.explode(keys).alias("key"))
    own = F.col("key") == F.col("phrase")
    first = F.min(F.when(own, F.struct("place", "span"))).alias("first")
    found = marked.groupBy("item_id", "key").agg(first, F.min(F.when(own, F.col("kind"))).alias("kind"), F.count_if(own).alias("times"), F.bool_or(~own).alias("covered"))
    out = found.filter("times > 0 and not covered")
    return out.select("item_id", F.col("first.span").alias("span"), "kind", F.col("first.place").alias("place"), "times")
