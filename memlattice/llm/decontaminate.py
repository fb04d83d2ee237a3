"""Benchmark decontamination by a positional inverted index of the training tokens that benchmark items use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, broadcast_if_small, text_key

#: What separates words: every ASCII character but digits and a-z, once A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same in text that is not lower-cased yet.
_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_KEY = ["doc_id", "text_hash"]


def _tokens(text: Column) -> Column:
    return F.split(ascii_lower(text), SEPARATORS)


def _n_words(text: Column) -> Column:
    """Words of a text, 0 if it is null.  Splitting is several times cheaper than matching every word by a regular expression."""
    framed = F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" "))  # so that the first and last part are empty
    return (F.size(F.split(framed, _ANY_CASE)) - 2).cast("long")


def benchmark_terms(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, n, k, term): the words of each item at their offsets.  Items without words have no row."""
    items = benchmark.select("item_id", F.filter(_tokens(F.col("text")), lambda x: x != "").alias("words"), F.xxhash64("item_id", "text").alias("item"))
    return items.dropDuplicates(["item"]).select("item", "item_id", F.size("words").alias("n"), F.posexplode("words").alias("k", "term"))


def postings(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The index: (term_id, doc_id, text_hash, pos) of every place of a vocabulary (term, term_id) word in docs."""
    words = docs.select(*text_key(), F.posexplode(_tokens(F.col("text"))).alias("pos", "term"))
    return words.join(broadcast_if_small(vocabulary), "term").select("term_id", *_KEY, "pos")


def offset_candidates(index: DataFrame, seeds: DataFrame, agreeing: int) -> DataFrame:
    """Intersects offset-adjusted lists: (doc, item, start) with seeds (term_id, item, k, least) at `least` offsets of an item or more."""
    shifted = index.join(broadcast_if_small(seeds), "term_id").select(*_KEY, "item", "least", (F.col("pos") - F.col("k")).alias("start"), "k")
    found = shifted.groupBy(*_KEY, "item", "start").agg(F.count(F.lit(1)).alias("n_seeds"), F.first("least").alias("least"))
    return found.filter(F.col("n_seeds") >= F.col("least")).drop("n_seeds", "least")


def exact_matches(docs: DataFrame, benchmark: DataFrame, window: int = 13, scratch: Scratch | None = None) -> DataFrame:
    """Runs of matching words: (doc_id, text_hash, item, item_id, first, last), where a window of the item occurs in the document.

    Each window gives its two rarest words (by postings) as seeds; a place where both stand at their offsets is a
    candidate, and then all words of the item are looked up in the index around it.  Runs of `window` words, or of
    the whole of a shorter item, are matches.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "decontaminate")
    terms = scratch.save(benchmark_terms(benchmark), "terms")
    vocabulary = scratch.save(terms.select("term").distinct().withColumn("term_id", F.xxhash64("term")), "vocabulary")
    index = scratch.save(postings(docs, vocabulary), "index")
    rarity = scratch.save(index.groupBy("term_id").agg(F.count(F.lit(1)).alias("places")), "rarity")
    terms = terms.withColumn("term_id", F.xxhash64("term")).drop("term")

    # the windows that a word at offset k belongs to start at k - window + 1 .. k, within the item
    starts = F.sequence(F.greatest(F.lit(0), F.col("k") - window + 1), F.least(F.col("k"), F.greatest(F.lit(0), F.col("n") - window)))
    in_window = terms.join(rarity, "term_id").withColumn("at", F.explode(starts))
    by_rarity = W.partitionBy("item", "at").orderBy("places", "k")
    ranked = in_window.withColumn("nth", F.row_number().over(by_rarity)).withColumn("present", F.count(F.lit(1)).over(W.partitionBy("item", "at")))
    whole = F.col("present") == F.least(F.lit(window), F.col("n"))  # a window with a word that no document has can't occur
    seeds = ranked.filter(whole & (F.col("nth") <= 2)).groupBy("item", "k", "term_id").agg(F.least(F.lit(2), F.first("n")).alias("least"))
    seeds = scratch.save(seeds, "seeds")
    found = scratch.save(offset_candidates(index, seeds, 2), "candidates")

    near = broadcast_if_small(scratch.save(found.select(*_KEY).distinct(), "documents"))
    local = index.join(near, (index["doc_id"].eqNullSafe(near["doc_id"])) & (index["text_hash"] == near["text_hash"]), "left_semi")
    wanted = found.join(broadcast_if_small(terms), "item").withColumn("pos", F.col("start") + F.col("k"))
    wanted = wanted.select(F.col("doc_id").alias("w_doc"), F.col("text_hash").alias("w_text"), F.col("pos").alias("w_pos"), F.col("term_id").alias("w_term"), "item", "item_id", "n", "start", "k")
    same = (F.col("text_hash") == F.col("w_text")) & (F.col("pos") == F.col("w_pos")) & (F.col("term_id") == F.col("w_term")) & F.col("doc_id").eqNullSafe(F.col("w_doc"))
    hits = local.join(wanted, same).select(*_KEY, "item", "item_id", "n", "start", "k").distinct()
    place = ["doc_id", "text_hash", "item", "start"]
    runs = hits.withColumn("run", F.col("k") - F.row_number().over(W.partitionBy(*place).orderBy("k")))
    runs = runs.groupBy(*place, "run").agg(F.first("item_id").alias("item_id"), F.first("n").alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi"))
    long_enough = F.col("hi") - F.col("lo") + 1 >= F.least(F.lit(window), F.col("n"))
    return runs.filter(long_enough).select(*_KEY, "item", "item_id", (F.col("start") + F.col("lo")).alias("first"), (F.col("start") + F.col("hi")).alias("last"))


def proximity_matches(docs: DataFrame, benchmark: DataFrame, within: int = 20, least: int = 8, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, text_hash, item, item_id, block, n_terms): half-overlapping stretches of 2 * within words that hold enough distinct words of an item.

    Looser than exact_matches: word order is free.  Only the rarer half of an item's distinct words counts (by postings,
    then by the word; at least three), so that function words alone never match; `least` of them, or all if they are
    fewer, are enough.  Words that no document has make an item's half unreachable only if they are needed.  With the
    scratch of exact_matches its index is read again.
    """
    spark = docs.sparkSession
    fresh = scratch is None
    scratch = scratch or Scratch(spark, "proximity")
    if fresh:
        terms = scratch.save(benchmark_terms(benchmark), "terms")
        vocabulary = scratch.save(terms.select("term").distinct().withColumn("term_id", F.xxhash64("term")), "vocabulary")
        index = scratch.save(postings(docs, vocabulary), "index")
        rarity = scratch.save(index.groupBy("term_id").agg(F.count(F.lit(1)).alias("places")), "rarity")
    else:
        terms, index, rarity = (scratch.read(x) for x in ("terms", "index", "rarity"))
    distinct = terms.select("item", "item_id", "term", F.xxhash64("term").alias("term_id")).distinct().join(rarity, "term_id")
    by_item = W.partitionBy("item")
    ranked = distinct.withColumn("nth", F.row_number().over(by_item.orderBy("places", "term"))).withColumn("half", F.ceil(F.count(F.lit(1)).over(by_item) / 2))
    rare = ranked.filter("nth <= half and half >= 3").withColumn("enough", F.least(F.lit(least), F.col("half")))
    rare = scratch.save(rare.select("term_id", "item", "item_id", "enough"), "rare")
    block = F.floor(F.col("pos") / within)
    placed = index.join(broadcast_if_small(rare), "term_id").withColumn("block", F.explode(F.array(block, block - 1)))
    # a word counts once a stretch: distinct in the map-side sum, then counted
    words = placed.groupBy(*_KEY, "item", "item_id", "block", "term_id").agg(F.max("enough").alias("enough"))
    near = words.groupBy(*_KEY, "item", "item_id", "block").agg(F.count(F.lit(1)).alias("n_terms"), F.max("enough").alias("enough"))
    return near.filter(F.col("n_terms") >= F.col("enough")).drop("enough")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, keyed: bool = False, near: bool = False) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, n_items, items (sorted item_ids as text), contaminated.

    Words are lower-cased by A-Z only.  n_hit counts the words inside any occurrence of a window; a document is
    contaminated if a twentieth of its words or more are hit.  Null and empty texts have no words; null items none
    either; items with a null item_id hit words but are not listed.  Rows that repeat doc_id and text get equal
    results; other columns are ignored.  keyed adds text_hash, which tells rows of one doc_id apart; near adds n_near,
    the items whose rarer words stand close together in the document, in any order.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    matches = scratch.save(exact_matches(docs, benchmark, window, scratch), "matches")
    hit = matches.select(*_KEY, F.explode(F.sequence("first", "last")).alias("pos")).distinct().groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n_hit"))
    items = matches.select(*_KEY, F.col("item_id").cast("string").alias("item_id")).distinct().groupBy(*_KEY).agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_hash"] == b["text_hash"])
    found = hit.join(items, same(hit, items)).select(hit["doc_id"].alias("f_doc"), hit["text_hash"].alias("f_text"), "n_hit", "items")
    found = broadcast_if_small(scratch.save(found, "found"), 100_000)
    words = docs.select(*text_key(), _n_words(F.col("text")).alias("n_words"))
    out = words.join(found, words["doc_id"].eqNullSafe(F.col("f_doc")) & (words["text_hash"] == F.col("f_text")), "left")
    if near:
        close = proximity_matches(docs, benchmark, scratch=scratch).select(*_KEY, "item").distinct().groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n_near"))
        close = broadcast_if_small(scratch.save(close.select(F.col("doc_id").alias("c_doc"), F.col("text_hash").alias("c_text"), "n_near"), "close"))
        out = out.join(close, words["doc_id"].eqNullSafe(F.col("c_doc")) & (words["text_hash"] == F.col("c_text")), "left")
    scratch.keep_only("found", "close")
    n_hit, listed = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<string>"))
    more = [F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near")] if near else []
    return out.select("doc_id", *(["text_hash"] if keyed else []), "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"), listed.alias("items"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), *more)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = (spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in ("documents", "benchmark"))
    out = contamination(docs.select("doc_id", "text"), bench, near=True)
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated", "n_near")


OP1_SQL = r"""
WITH bench AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark WHERE text IS NOT NULL
), docs AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words FROM documents
), long_windows AS (
  SELECT DISTINCT item_id, 13 AS n, array_to_string(words[s:s+12], ' ') AS phrase FROM (SELECT item_id, words, unnest(range(1, len(words) - 11)) AS s FROM bench WHERE len(words) >= 13)
), short_windows AS (
  SELECT DISTINCT item_id, len(words) AS n, array_to_string(words, ' ') AS phrase FROM bench WHERE len(words) BETWEEN 1 AND 12
), windows AS (
  SELECT * FROM long_windows UNION ALL SELECT * FROM short_windows
), sizes AS (SELECT DISTINCT n FROM windows), grams AS (
  SELECT doc_id, n, s, array_to_string(words[s:s+n-1], ' ') AS phrase FROM (SELECT d.doc_id, d.words, z.n, unnest(range(1, len(d.words) - z.n + 2)) AS s FROM docs d, sizes z WHERE len(d.words) >= z.n)
), found AS (
  SELECT g.doc_id, g.s, g.n, w.item_id FROM grams g JOIN windows w ON g.n = w.n AND g.phrase = w.phrase
), hit AS (
  SELECT doc_id, count(DISTINCT pos)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS pos FROM found) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id
), terms AS (
  SELECT DISTINCT item_id, unnest(words) AS term FROM bench
), places AS (
  SELECT doc_id, unnest(range(0, len(parts))) AS pos, unnest(parts) AS term FROM (SELECT doc_id, regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS parts FROM documents WHERE text IS NOT NULL)
), used AS (
  SELECT * FROM places WHERE term IN (SELECT term FROM terms)
), rarity AS (SELECT term, count(*) AS places FROM used GROUP BY term), ranked AS (
  SELECT item_id, term, row_number() OVER (PARTITION BY item_id ORDER BY places, term) AS nth, ceil(count(*) OVER (PARTITION BY item_id) / 2) AS half FROM terms JOIN rarity USING (term)
), stretches AS (
  SELECT u.doc_id, r.item_id, any_value(half) AS half, block, count(DISTINCT r.term) AS n FROM (SELECT *, unnest([pos // 20, pos // 20 - 1]) AS block FROM used) u JOIN ranked r ON u.term = r.term AND nth <= half AND half >= 3 GROUP BY u.doc_id, r.item_id, block
), near AS (SELECT doc_id, count(DISTINCT item_id)::BIGINT AS n_near FROM stretches WHERE n >= least(8, half) GROUP BY doc_id)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(i.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(i.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.words) AS contaminated, coalesce(n.n_near, 0)::BIGINT AS n_near
FROM docs d LEFT JOIN hit h USING (doc_id) LEFT JOIN items i USING (doc_id) LEFT JOIN near n USING (doc_id)
"""
