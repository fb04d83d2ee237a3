"""Queries of the scalar and text layer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memlattice.functions import text as tx
from memlattice.operators import dictionary as dc
from memlattice.operators import search as s
from memlattice.operators import store as so
from memlattice.operators.textindex import TextIndex
from memlattice.sources.tables import Tables

from .registry import query

ASK = "the thin and of er"
WORDS = r"list_filter(regexp_split_to_array(lower({0}), '\s+'), lambda x: x <> '')"
TOKENS = f"list_distinct({WORDS})"
CONTENT, ASKED = TOKENS.format("content"), TOKENS.format(f"'{ASK}'")


def joined(c: Column) -> Column:
    """An array as a sorted string, for comparison."""
    return F.array_join(F.sort_array(c), ",")


@query("text_token_digest", f"SELECT item_id, len(t) AS n, md5(array_to_string(list_sort(t), ',')) AS digest FROM (SELECT item_id, {CONTENT} AS t FROM items)", "items")
def text_token_digest(t: Tables) -> DataFrame:
    c = tx.tokens(F.col("content"))
    return t.items.select("item_id", F.size(c).cast("long").alias("n"), F.md5(joined(c).cast("binary")).alias("digest"))


@query("text_jaccard", f"SELECT item_id, round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))), 6) AS score FROM (SELECT item_id, {ASKED} AS a, {CONTENT} AS b FROM items) WHERE len(b) > 0", "items")
def text_jaccard(t: Tables) -> DataFrame:
    c = tx.tokens(F.col("content"))
    return t.items.filter(F.size(c) > 0).select("item_id", F.round(tx.jaccard(tx.tokens(F.lit(ASK)), c), 6).alias("score"))


@query("text_overlap", f"SELECT item_id, round(len(list_intersect(a, b)) / least(len(a), len(b)), 6) AS score FROM (SELECT item_id, {ASKED} AS a, {CONTENT} AS b FROM items) WHERE len(b) > 0", "items")
def text_overlap(t: Tables) -> DataFrame:
    c = tx.tokens(F.col("content"))
    return t.items.filter(F.size(c) > 0).select("item_id", F.round(tx.overlap(tx.tokens(F.lit(ASK)), c), 6).alias("score"))


@query("text_length_ratio", "SELECT p_partkey, round(1 - abs(length(p_name) - length(p_type)) / greatest(length(p_name), length(p_type)), 6) AS score FROM part")
def text_length_ratio(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.round(tx.length_ratio(F.col("p_name"), F.col("p_type")), 6).alias("score"))


@query("text_positional_similarity", """
SELECT p_partkey, round(1 - (abs(length(p_name) - length(p_type)) + (SELECT count(*) FROM range(1, least(length(p_name), length(p_type)) + 1) r(i) WHERE substr(p_name, i, 1) <> substr(p_type, i, 1))) / greatest(length(p_name), length(p_type)), 6) AS score FROM part""")
def text_positional_similarity(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.round(tx.positional_similarity(F.col("p_name"), F.col("p_type")), 6).alias("score"))


@query("text_content_hash", "SELECT item_id, sha256(content) AS digest FROM items", "items")
def text_content_hash(t: Tables) -> DataFrame:
    return t.items.select("item_id", tx.content_hash(F.col("content")).alias("digest"))


@query("text_clean", r"SELECT item_id, md5(trim(regexp_replace(content, '\s+', ' ', 'g'))) AS digest FROM items", "items")
def text_clean(t: Tables) -> DataFrame:
    return t.items.select("item_id", F.md5(tx.clean(F.col("content")).cast("binary")).alias("digest"))


@query("text_decompose", """
SELECT p_partkey, array_to_string(list_slice(list_concat([q], list_filter(list_transform(regexp_split_to_array(q, '(?i)\\s+and\\s+|\\s+or\\s+|[,;]'), lambda x: trim(x)), lambda x: length(x) >= 3)), 1, 4), '~') AS parts
FROM (SELECT p_partkey, p_name || ' and ' || p_brand || ', ' || p_type AS q FROM part)""".replace("\\\\", "\\"))
def text_decompose(t: Tables) -> DataFrame:
    q = F.concat("p_name", F.lit(" and "), "p_brand", F.lit(", "), "p_type")
    return t.part.select("p_partkey", F.array_join(tx.decompose(q), "~").alias("parts"))


@query("text_slug", r"SELECT p_partkey, regexp_replace(trim(regexp_replace(lower(p_name), '[^a-z0-9\s]', '', 'g')), '\s+', '_', 'g') AS slug FROM part")
def text_slug(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", tx.slug(F.col("p_name")).alias("slug"))


@query("text_predicate_key", "SELECT DISTINCT regexp_replace(regexp_replace(lower(trim(p_type)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS key FROM part")
def text_predicate_key(t: Tables) -> DataFrame:
    return t.part.select(tx.predicate_key(F.col("p_type")).alias("key")).distinct()


@query("text_relation_type", "SELECT DISTINCT o_orderpriority AS label, CASE WHEN x = '' THEN 'UNKNOWN' WHEN NOT regexp_matches(x, '^[A-Z]') THEN 'REL_' || x ELSE x END AS relation_type FROM (SELECT o_orderpriority, substr(regexp_replace(regexp_replace(upper(o_orderpriority), '[^A-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 50) AS x FROM orders)")
def text_relation_type(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderpriority").alias("label"), tx.relation_type(F.col("o_orderpriority")).alias("relation_type")).distinct()


@query("text_first_sentence", r"SELECT item_id, md5(CASE WHEN x <> '' THEN trim(x) ELSE substr(content, 1, 100) END) AS digest FROM (SELECT item_id, content, regexp_extract(content, '^([^.!?]*[.!?])', 1) AS x FROM items)", "items")
def text_first_sentence(t: Tables) -> DataFrame:
    return t.items.select("item_id", F.md5(tx.first_sentence(F.col("content")).cast("binary")).alias("digest"))


@query("text_urls", """SELECT page_id, len(list_distinct(regexp_extract_all(html, 'https?://[^\\s"''<>)]+')))::BIGINT AS n FROM pages""".replace("\\\\", "\\"))
def text_urls(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.size(tx.urls(F.col("html"))).cast("long").alias("n"))


@query("text_character_chunks", "SELECT item_id, n, md5(array_to_string(list_transform(range(0, n), lambda i: substr(content, i * 400 + 1, 500)), '~')) AS digest FROM (SELECT item_id, content, greatest(1, ceil((length(content) - 100) / 400.0))::BIGINT AS n FROM items)", "items")
def text_character_chunks(t: Tables) -> DataFrame:
    c = tx.character_chunks(F.col("content"), 500, 100)
    return t.items.select("item_id", F.size(c).cast("long").alias("n"), F.md5(F.array_join(c, "~").cast("binary")).alias("digest"))


POS, NEG = (", ".join(f"'{x}'" for x in xs) for xs in (tx.POSITIVE, tx.NEGATIVE))


@query("text_sentiment", rf"""
SELECT turn_id, score, CASE WHEN score >= 0.05 THEN 'positive' WHEN score <= -0.05 THEN 'negative' ELSE 'neutral' END AS label FROM (
SELECT turn_id, CASE WHEN p + n > 0 THEN round((p - n) / (p + n), 6) ELSE 0.0 END::DOUBLE AS score FROM (
 SELECT turn_id, len(list_filter(w, lambda x: x IN ({POS}))) AS p, len(list_filter(w, lambda x: x IN ({NEG}))) AS n
 FROM (SELECT turn_id, list_transform(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: trim(x, '.,!?;:''()[]{{}}-')) AS w FROM (SELECT conv_id * 1000 + turn AS turn_id, text FROM conversations UNION ALL SELECT -note_id, content FROM notes))))""", "notes")
def text_sentiment(t: Tables) -> DataFrame:
    rows = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"), "text").union(t.notes.select(-F.col("note_id"), "content"))
    scored = rows.select("turn_id", F.round(tx.sentiment(F.col("text")), 6).alias("score"))
    return scored.withColumn("label", F.when(F.col("score") >= 0.05, "positive").when(F.col("score") <= -0.05, "negative").otherwise("neutral"))


@query("text_topics", r"""
WITH w AS (SELECT conv_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: length(x) > 2)) AS w FROM conversations),
n AS (SELECT conv_id, w, count(*) AS n FROM w GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, w) AS k FROM n)
SELECT conv_id, w AS topic, k::INTEGER AS k, round(n / sum(n) OVER (PARTITION BY conv_id), 6) AS share FROM r WHERE k <= 5""")
def text_topics(t: Tables) -> DataFrame:

    w = t.conversations.select("conv_id", F.explode(F.filter(tx.clean_words(F.col("text")), lambda x: F.length(x) > 2)).alias("topic"))
    n = w.groupBy("conv_id", "topic").agg(F.count(F.lit(1)).alias("n"))
    k = n.withColumn("k", F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("n"), "topic"))).filter("k <= 5")
    return k.select("conv_id", "topic", "k", F.round(F.col("n") / F.sum("n").over(W.partitionBy("conv_id")), 6).alias("share"))


@query("text_claim_support", rf"""
SELECT item_id, CASE WHEN len(k) = 0 THEN 0.0 ELSE round(len(list_filter(k, lambda x: contains(lower(content), x))) / len(k), 6) END AS support
FROM items, (SELECT list_filter(list_distinct({WORDS.format("'erona thin ofthe andes'")}), lambda x: length(x) > 2) AS k)""", "items")
def text_claim_support(t: Tables) -> DataFrame:
    return t.items.select("item_id", F.round(tx.claim_support(F.lit("erona thin ofthe andes"), F.col("content")), 6).alias("support"))


@query("text_ngram_dictionary", r"""
SELECT item_id, array_to_string(list_filter(['of the', 'and the', 'thin', 'was'], lambda p: contains(' ' || array_to_string(list_filter(regexp_split_to_array(lower(content), '[^a-z]+'), lambda x: x <> ''), ' ') || ' ', ' ' || p || ' ')), ',') AS found FROM items""", "items")
def text_ngram_dictionary(t: Tables) -> DataFrame:
    found = F.filter(F.array(*[F.lit(x) for x in ("of the", "and the", "thin", "was")]), lambda p: F.array_contains(tx.ngram_matches(F.col("content"), ["of the", "and the", "thin", "was"]), p))
    return t.items.select("item_id", F.array_join(found, ",").alias("found"))


@query("text_dictionary_matches", r"""
WITH k AS (SELECT unnest([1, 2, 3, 4]) AS n), b AS (SELECT list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM benchmark),
d AS (SELECT array_to_string(list_slice(w, 1, n), ' ') AS phrase, min('k' || n) AS kind FROM b, k WHERE len(w) >= n GROUP BY 1),
t AS (SELECT item_id, list_filter(regexp_split_to_array(content, '\s+'), lambda x: x <> '') AS w FROM items),
g AS (SELECT item_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: {'i': i, 's': array_to_string(list_slice(w, i, i + n - 1), ' ')})) AS g FROM t, k),
h AS (SELECT item_id, phrase, kind, n, arg_min(g.s, g.i) AS span, min(g.i) - 1 AS place, count(*) AS times FROM g JOIN d ON lower(g.s) = phrase GROUP BY 1, 2, 3, 4)
SELECT item_id, span, kind, place::INTEGER AS place, times FROM h WHERE n > 1 OR (item_id, phrase) NOT IN (SELECT item_id, unnest(string_split(phrase, ' ')) FROM h WHERE n > 1)""", "items")
def text_dictionary_matches(t: Tables) -> DataFrame:
    """Documents by a dictionary of the first one to four words of each benchmark item."""
    w = t.benchmark.select(F.filter(F.split(F.lower("text"), r"\s+"), lambda x: x != "").alias("w"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("n")).filter("size(w) >= n")
    names = w.select(F.array_join(F.slice("w", F.lit(1), F.col("n")), " ").alias("phrase"), F.concat(F.lit("k"), F.col("n").cast("string")).alias("kind"))
    return dc.dictionary_matches(t.items, names)


@query("search_keyword", f"SELECT item_id, score FROM (SELECT item_id, round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))), 6) AS score FROM (SELECT item_id, {ASKED} AS a, {CONTENT} AS b FROM items)) WHERE score > 0.1 ORDER BY score DESC, item_id LIMIT 10", "items")
def search_keyword(t: Tables) -> DataFrame:
    return s.keyword_search(t.items, ASK)


@query("search_contains", f"SELECT item_id, memory_type FROM items WHERE contains(lower(content), '{ASK}') OR len(list_intersect({ASKED}, {CONTENT})) >= 2 ORDER BY item_id LIMIT 10", "items")
def search_contains(t: Tables) -> DataFrame:
    return s.contains_search(t.items, ASK).select("item_id", "memory_type")


@query("search_full_text", f"SELECT item_id FROM items WHERE len(list_intersect({TOKENS.format(repr('the of and'))}, {CONTENT})) = 3", "items")
def search_full_text(t: Tables) -> DataFrame:
    return s.full_text(t.items, "the of and").select("item_id")


@query("search_multi_field", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'steel') OR contains(lower(p_type), 'steel') OR contains(lower(p_name), 'red') OR contains(lower(p_type), 'red')")
def search_multi_field(t: Tables) -> DataFrame:
    return t.part.filter(s.matches_any([F.col("p_name"), F.col("p_type")], ["steel", "red"])).select("p_partkey")


VEC = "list_inner_product(embedding::DOUBLE[], q) / (sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_inner_product(q, q)))"
VECTORS = f"SELECT vec_id, round({VEC}, 6) AS score FROM embeddings, (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"


@query("search_vector_top_k", f"SELECT * FROM ({VECTORS}) ORDER BY score DESC, vec_id LIMIT 10")
def search_vector_top_k(t: Tables) -> DataFrame:
    return s.vector_top_k(t.embeddings, asked(t), 10)


def asked(t: Tables) -> DataFrame:
    return t.embeddings.filter("vec_id = 0").select(F.col("embedding").alias("q"))


@query("search_vector_threshold", f"SELECT * FROM ({VECTORS}) WHERE score >= 0.1 ORDER BY score DESC, vec_id LIMIT 50")
def search_vector_threshold(t: Tables) -> DataFrame:
    return s.vector_top_k(t.embeddings, asked(t), 50, 0.1)


TEXT_LIST = f"SELECT item_id, round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))), 6) AS score FROM (SELECT item_id, {ASKED} AS a, {CONTENT} AS b FROM items) WHERE len(b) > 0 ORDER BY score DESC, item_id LIMIT 20"


@query("search_hybrid_rrf", f"""
WITH v AS (SELECT vec_id AS item_id, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM (SELECT * FROM ({VECTORS}) ORDER BY score DESC, vec_id LIMIT 20)),
x AS (SELECT item_id, row_number() OVER (ORDER BY score DESC, item_id) AS rank FROM ({TEXT_LIST}))
SELECT item_id, round(sum(1 / (60 + rank)), 6) AS score FROM (SELECT * FROM v UNION ALL SELECT * FROM x) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""", "items")
def search_hybrid_rrf(t: Tables) -> DataFrame:
    v = s.ranked(s.vector_top_k(t.embeddings, asked(t), 20).withColumnRenamed("vec_id", "item_id"), 20)
    x = s.ranked(s.keyword_search(t.items, ASK, 20, -1), 20)
    return s.rrf(v.select("item_id", "rank").union(x.select("item_id", "rank")), 10)


_BM25 = r"""
WITH d AS (SELECT item_id, list_filter(regexp_split_to_array(lower(content), '\s+'), lambda x: x <> '') AS w FROM items),
s AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d), q AS (SELECT unnest(['and', 'thin', 'was']) AS q),
df AS (SELECT q, count(*) AS df FROM d, q WHERE list_contains(w, q) GROUP BY 1),
p AS (SELECT item_id, q.q, ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / mean)) AS p FROM (SELECT item_id, w, q, len(list_filter(w, lambda x: x = q))::DOUBLE AS tf FROM d, q) q JOIN df ON df.q = q.q, s WHERE tf > 0),
r AS (SELECT item_id, sum(p) AS raw FROM p GROUP BY 1)
SELECT item_id, round(raw / (SELECT max(raw) FROM r), 6) AS score FROM r"""


@query("search_bm25", _BM25, "items")
def search_bm25(t: Tables) -> DataFrame:
    return s.bm25(t.items, "was thin and")


def _indexed(t: Tables) -> TextIndex:
    """The documents in a stored index of two segments."""
    index = TextIndex(t.spark, so.folder(t.spark, "text-index"), buckets=16)
    for part in (0, 1):
        index.add(t.items.filter(F.col("item_id") % 2 == part))
    return index


@query("search_bm25_indexed", _BM25, "items")
def search_bm25_indexed(t: Tables) -> DataFrame:
    """BM25 from the postings of a stored index alone."""
    return _indexed(t).bm25("was thin and")


@query("search_all_words_indexed", r"SELECT item_id FROM (SELECT item_id, regexp_split_to_array(lower(content), '\s+') AS w FROM items) WHERE list_contains(w, 'and') AND list_contains(w, 'the')", "items")
def search_all_words_indexed(t: Tables) -> DataFrame:
    return _indexed(t).holding_all("the And")


@query("search_fallback_chain", f"""
WITH a AS (SELECT item_id, row_number() OVER (ORDER BY item_id) AS rank, 0 AS priority FROM (SELECT item_id FROM items WHERE len(list_intersect({TOKENS.format(repr('the of and'))}, {CONTENT})) = 3 ORDER BY item_id LIMIT 5)),
b AS (SELECT item_id, row_number() OVER (ORDER BY score DESC, item_id) AS rank, 1 AS priority FROM ({TEXT_LIST})),
m AS (SELECT item_id, min((priority, rank)) AS b FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1)
SELECT item_id, b[1]::INTEGER AS priority, b[2]::INTEGER AS rank FROM m ORDER BY 2, 3, 1 LIMIT 10""", "items")
def search_fallback_chain(t: Tables) -> DataFrame:
    first = s.full_text(t.items, "the of and").select("item_id", (-F.col("item_id")).cast("double").alias("score"))
    return s.fallback(s.ranked(first, 5), s.ranked(s.keyword_search(t.items, ASK, 20, -1), 20), k=10)


@query("search_decomposed", f"""
WITH q AS (SELECT unnest(['the of and thin er', 'the of', 'thin er']) AS q, unnest([0, 1, 2]) AS i),
s AS (SELECT i, item_id, round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))), 6) AS score FROM (SELECT i, item_id, {TOKENS.format("q")} AS a, {CONTENT} AS b FROM items, q) WHERE len(b) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, item_id) AS rank FROM s WHERE score > 0.02)
SELECT item_id, round(sum(1 / (60 + rank)), 6) AS score FROM r WHERE rank <= 20 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""", "items")
def search_decomposed(t: Tables) -> DataFrame:
    parts = [s.ranked(s.keyword_search(t.items, q, 20, 0.02), 20).select("item_id", "rank") for q in ("the of and thin er", "the of", "thin er")]
    return s.rrf(parts[0].union(parts[1]).union(parts[2]), 10)


@query("search_entity_similar", f"SELECT * FROM ({VECTORS}) WHERE vec_id <> 0 ORDER BY score DESC, vec_id LIMIT 5")
def search_entity_similar(t: Tables) -> DataFrame:
    return s.vector_top_k(t.embeddings.filter("vec_id <> 0"), asked(t), 5)


@query("search_vector_graph_expansion", f"""
WITH hits AS (SELECT * FROM ({VECTORS}) ORDER BY score DESC, vec_id LIMIT 10)
SELECT DISTINCT l.dst AS item_id FROM hits JOIN links l ON l.src = hits.vec_id UNION SELECT vec_id FROM hits""", "links")
def search_vector_graph_expansion(t: Tables) -> DataFrame:
    hits = s.vector_top_k(t.embeddings, asked(t), 10).select(F.col("vec_id").alias("src"))
    return t.links.join(hits, "src", "left_semi").select(F.col("dst").alias("item_id")).union(hits).distinct()


@query("search_history_page", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 20 OFFSET 40")
def search_history_page(t: Tables) -> DataFrame:
    return t.events.select("event_id", "ts").orderBy(F.desc("ts"), F.desc("event_id")).offset(40).limit(20)


@query("search_recent", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 25")
def search_recent(t: Tables) -> DataFrame:
    return t.events.select("event_id", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(25)


def _walk_sql(worth: str, start: int) -> str:
    return f"""
WITH RECURSIVE q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = {start}), v AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS size FROM embeddings),
pairs AS (SELECT a.vec_id AS src, b.vec_id AS dst, round(list_inner_product(a.e, b.e) / (a.size * b.size), 6) AS c, round({worth}, 6) AS s FROM v a JOIN v b ON a.vec_id <> b.vec_id, q),
n AS (SELECT src, dst, s FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY c DESC, dst) AS k FROM pairs) WHERE k <= 10
  UNION SELECT p.src, p.dst, p.s FROM pairs p JOIN (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS k FROM (SELECT DISTINCT src, dst FROM links)) l ON l.src = p.src AND l.dst = p.dst WHERE k <= 10),
w AS (SELECT 0 AS place, {start}::BIGINT AS vec_id, [{start}::BIGINT] AS seen UNION ALL
  SELECT w.place + 1, x.dst, list_append(w.seen, x.dst) FROM w, LATERAL (SELECT dst FROM n WHERE n.src = w.vec_id AND NOT list_contains(w.seen, n.dst) ORDER BY s DESC, dst LIMIT 1) x WHERE w.place < 7)
SELECT place, vec_id FROM w"""


def _query_vector(t: Tables, key: int) -> list[float]:
    return [float(x) for x in t.embeddings.filter(F.col("vec_id") == key).first()["embedding"]]


@query("search_query_traversal", _walk_sql("list_inner_product(b.e, q) / (b.size * sqrt(list_inner_product(q, q)))", 4), "links")
def search_query_traversal(t: Tables) -> DataFrame:
    return s.traverse(t.embeddings, t.links, _query_vector(t, 4))


@query("search_triangulation", _walk_sql("-sqrt(list_sum(list_transform(range(1, len(q) + 1), lambda i: pow((a.e[i] + b.e[i] + q[i]) / 3 - q[i], 2))))", 6), "links")
def search_triangulation(t: Tables) -> DataFrame:
    return s.traverse(t.embeddings, t.links, _query_vector(t, 6), by_centroid=True)
