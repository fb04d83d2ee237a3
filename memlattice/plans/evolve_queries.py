"""Queries of evolvers, streams of work, time travel, plugins and stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memlattice.functions import plugins as pl
from memlattice.functions import scores as sc
from memlattice.functions import text as tx
from memlattice.operators import graph as g
from memlattice.operators import simjoin as sj
from memlattice.operators import store as so
from memlattice.operators import temporal as tp
from memlattice.sources.tables import Tables, as_of, days_before
from memlattice.streaming import metrics as st

from .registry import fixture, query

# ---- evolvers -------------------------------------------------------------------------------------------------------
_COS = "list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"


@query("belief_interference", f"""
WITH p AS (SELECT a.vec_id AS x, b.vec_id AS y, {_COS} AS c FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE {_COS} > 0.3),
ends AS (SELECT x AS vec_id, c FROM p UNION ALL SELECT y, c FROM p)
SELECT vec_id, count(c) AS n, round(coalesce(exp(sum(ln(1 - 0.05 * c))), 1.0), 6) AS factor FROM (SELECT vec_id FROM embeddings) LEFT JOIN ends USING (vec_id) GROUP BY 1""")
def belief_interference(t: Tables) -> DataFrame:
    """Memories that are alike within a kind weaken each other: a product over the near ones, whatever their order."""
    return sj.interference(t.embeddings, "label").select("vec_id", "n", F.round("factor", 6).alias("factor"))


@query("evolve_semantic_decay", "SELECT c_custkey, c_acctbal / 10000 < 0.2 AS archived FROM customer")
def evolve_semantic_decay(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", (F.col("c_acctbal") / 10000 < 0.2).alias("archived"))


@query("evolve_episodic_to_zettel", "SELECT 'note:' || event_id AS note_id, event_type || ' ' || props AS content FROM events WHERE ts >= TIMESTAMP '2024-01-29'")
def evolve_episodic_to_zettel(t: Tables) -> DataFrame:
    """Notes of the last days' events."""
    return t.events.filter(days_before(F.col("ts")) <= 2).select(F.concat(F.lit("note:"), F.col("event_id").cast("string")).alias("note_id"), F.concat_ws(" ", "event_type", "props").alias("content"))


@query("evolve_working_to_episodic", """
WITH c AS (SELECT conv_id, count(*) AS n, avg(length(coalesce(text, ''))) AS size FROM conversations GROUP BY 1), k AS (SELECT *, greatest(2, floor(4 * (1 - 0.3 * least(1.5, size / 100) / 2)))::INTEGER AS needed FROM c)
SELECT conv_id, needed, n >= needed AS promoted FROM k""")
def evolve_working_to_episodic(t: Tables) -> DataFrame:
    """Buffers are promoted at a threshold that long contents lower."""
    size = F.avg(F.length(F.coalesce("text", F.lit(""))))
    c = t.conversations.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), size.alias("size"))
    needed = F.greatest(F.lit(2), F.floor(4 * (1 - 0.3 * F.least(F.lit(1.5), F.col("size") / 100.0) / 2)).cast("int"))
    return c.select("conv_id", needed.alias("needed"), (F.col("n") >= needed).alias("promoted"))


@query("evolve_working_to_procedural", """
WITH s AS (SELECT p_type, unnest(list_filter(string_split(lower(p_name), ' '), lambda x: x <> '')) AS skill FROM part), n AS (SELECT p_type, skill, count(*) AS n FROM s GROUP BY 1, 2 HAVING count(*) >= 5)
SELECT p_type, array_to_string(list_sort(list(skill)), ',') AS skills, CASE WHEN list_contains(list(skill), 'widget') THEN 'refine' ELSE 'create' END AS action FROM n GROUP BY 1""")
def evolve_working_to_procedural(t: Tables) -> DataFrame:
    """Skills seen five times: a known procedure is refined, others are created."""
    n = t.part.select("p_type", F.explode(tx.words(F.col("p_name"))).alias("skill")).groupBy("p_type", "skill").agg(F.count(F.lit(1)).alias("n")).filter("n >= 5")
    made = n.groupBy("p_type").agg(F.array_sort(F.collect_set("skill")).alias("s"))
    return made.select("p_type", F.array_join("s", ",").alias("skills"), F.when(F.array_contains("s", "widget"), "refine").otherwise("create").alias("action"))


_ASPECTS = {"career": ["work", "job", "company"], "location": ["live", "city", "located"], "skills": ["skill", "can"], "interests": ["interest", "hobby"]}


@query("evolve_observations", """
WITH f AS (SELECT p_brand AS entity, p_partkey, p_name FROM part), k AS (SELECT entity, list(DISTINCT p_name ORDER BY p_name)[1:5] AS facts, count(*) AS n, list_sort(list(DISTINCT lower(p_name))) AS all_ FROM f GROUP BY 1 HAVING count(*) >= 2)
SELECT entity, 'obs_' || substr(sha256(entity), 1, 12) AS obs_id, 'Summary of ' || entity || ': ' || array_to_string(facts, '; ') AS content, n FROM k""")
def evolve_observations(t: Tables) -> DataFrame:
    """A summary of each entity with two facts or more: its first five distinct facts, under an id of its own."""
    nth = F.row_number().over(W.partitionBy("entity").orderBy("p_name"))
    facts = t.part.select(F.col("p_brand").alias("entity"), "p_name").distinct().withColumn("nth", nth).filter("nth <= 5").groupBy("entity").agg(F.array_sort(F.collect_list("p_name")).alias("facts"))
    n = t.part.groupBy(F.col("p_brand").alias("entity")).agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    content = F.concat(F.lit("Summary of "), "entity", F.lit(": "), F.array_join("facts", "; "))
    return n.join(facts, "entity").select("entity", F.concat(F.lit("obs_"), F.substring(F.sha2("entity", 256), 1, 12)).alias("obs_id"), content.alias("content"), "n")


@query("evolve_cycle", """
SELECT user_id, round(greatest(0, least(1, (1 - (1 - 0.5) * pow(0.9, count(*) FILTER (WHERE event_type = 'click'))) * pow(0.85, count(*) FILTER (WHERE event_type = 'error'))))::DOUBLE, 6) AS confidence, max(ts) < TIMESTAMP '2024-01-20' AS archived FROM events GROUP BY 1""")
def evolve_cycle(t: Tables) -> DataFrame:
    """Registered evolvers in order: reinforcement, contradiction, archiving."""
    registry = pl.Registry()
    registry.register("evolver", "1-reinforce", lambda df: df.withColumn("confidence", sc.reinforced(F.lit(0.5), F.col("clicks"))))
    registry.register("evolver", "2-contradict", lambda df: df.withColumn("confidence", sc.contradicted(F.col("confidence"), F.col("errors"))))
    registry.register("evolver", "3-archive", lambda df: df.withColumn("archived", F.col("last") < F.lit("2024-01-20").cast("timestamp_ntz")))
    rows = t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("clicks"), F.count_if(F.col("event_type") == "error").alias("errors"), F.max("ts").alias("last"))
    for name in registry.names("evolver"):
        rows = rows.transform(registry.get("evolver", name))
    return rows.select("user_id", F.round("confidence", 6).alias("confidence"), "archived")


# ---- streams of work ------------------------------------------------------------------------------------------------
@query("stream_action_batches", "SELECT user_id, list_sort(list(DISTINCT event_type))[1] AS action, count(DISTINCT event_type) AS n FROM events GROUP BY 1")
def stream_action_batches(t: Tables) -> DataFrame:
    """Actions of micro-batches, once each: a batch that is repeated overwrites its own file."""
    stream = st.read_events(t.spark, f"{t.sf_dir}/events.parquet").select("user_id", "event_type")
    rows = st.latest_table(stream, st.new_folder(g.shared_root(t.spark)), ["user_id", "event_type"], "append")
    return rows.groupBy("user_id").agg(F.min("event_type").alias("action"), F.count(F.lit(1)).alias("n"))


@query("stream_stage_bus", "SELECT event_type, count(*) AS n, round(sum(value * 2 + 1), 4) AS total FROM events WHERE value > 10 GROUP BY 1")
def stream_stage_bus(t: Tables) -> DataFrame:
    """Chained stages over a stream, each reading what the one before has written, exactly once."""
    folder = st.new_folder(g.shared_root(t.spark))
    one = st.read_events(t.spark, f"{t.sf_dir}/events.parquet").filter("value > 10").select("event_id", "event_type", "value")
    two_in = _through(one, f"{folder}/one")
    two = t.spark.readStream.schema(two_in.schema).parquet(f"{folder}/one/out").withColumn("value", F.col("value") * 2)
    three = _through(two, f"{folder}/two").withColumn("value", F.col("value") + 1)
    return three.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def _through(stream: DataFrame, folder: str) -> DataFrame:
    stream.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).format("parquet").start(f"{folder}/out").awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


@query("stream_stage_consumer", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_stage_consumer(t: Tables) -> DataFrame:
    """A consumer that polls what is available and goes on from its checkpoint: the second poll finds nothing new."""
    folder = st.new_folder(g.shared_root(t.spark))
    stream = lambda: st.read_events(t.spark, f"{t.sf_dir}/events.parquet").select("event_id", "event_type")
    _through(stream(), folder)
    return _through(stream(), folder).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("stream_co_retrieval", """
SELECT a.event_type AS a, b.event_type AS b, count(*) AS n FROM (SELECT DISTINCT user_id, date_trunc('day', ts) AS d, event_type FROM events) a JOIN (SELECT DISTINCT user_id, date_trunc('day', ts) AS d, event_type FROM events) b ON a.user_id = b.user_id AND a.d = b.d AND a.event_type < b.event_type GROUP BY 1, 2""")
def stream_co_retrieval(t: Tables) -> DataFrame:
    """Kinds that are retrieved together on a day: pairs within a set of at most five kinds."""
    sets = t.events.groupBy("user_id", F.date_trunc("day", "ts").alias("d")).agg(F.array_sort(F.collect_set("event_type")).alias("k"))
    a = sets.select("k", F.explode("k").alias("a")).select("a", F.explode("k").alias("b")).filter("a < b")
    return a.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


@query("stream_two_tier_extraction", """
SELECT lower(p_name || ' ' || p_brand) AS name, min(p_type) AS kind FROM part WHERE lower(p_name || ' ' || p_brand) NOT IN (SELECT lower(p_name || ' ' || p_brand) FROM part WHERE p_size < 10) GROUP BY 1""")
def stream_two_tier_extraction(t: Tables) -> DataFrame:
    """What the second tier found and the first had not."""
    name = F.lower(F.concat_ws(" ", "p_name", "p_brand")).alias("name")
    ruler = t.part.filter("p_size < 10").select(name).distinct()
    return t.part.select(name, "p_type").join(ruler, "name", "left_anti").groupBy("name").agg(F.min("p_type").alias("kind"))


@query("infer_run", """
WITH two AS (SELECT DISTINCT a.src, b.dst FROM edges a JOIN edges b ON a.dst = b.src AND a.edge_type = 'LOCATED_IN' AND b.edge_type = 'LOCATED_IN'), back AS (SELECT DISTINCT dst AS src, src AS dst FROM links WHERE edge_type = 'click')
SELECT 'transitivity' AS rule, count(*) AS n FROM two WHERE (src, dst) NOT IN (SELECT src, dst FROM edges WHERE edge_type = 'LOCATED_IN') UNION ALL SELECT 'symmetry', count(*) FROM back WHERE (src, dst) NOT IN (SELECT src, dst FROM links WHERE edge_type = 'click')""", "edges links")
def infer_run(t: Tables) -> DataFrame:
    """How many edges each rule would add: a dry run of all of them."""
    n = lambda df, rule: df.agg(F.lit(rule).alias("rule"), F.count(F.lit(1)).alias("n"))
    return n(g.infer_transitive(t.edges, "LOCATED_IN"), "transitivity").union(n(g.missing_reverse(t.links, "click"), "symmetry"))


# ---- time travel ----------------------------------------------------------------------------------------------------
_AT = "SELECT item_id, kind, version, content, value, tx_start FROM versions WHERE tx_start <= {0} AND (tx_end IS NULL OR {0} < tx_end)"
_THEN, _NOW = "TIMESTAMP '2024-01-10'", "TIMESTAMP '2024-01-31'"


def _at(t: Tables, when) -> DataFrame:
    return tp.version_at(t.versions, when, ["item_id", "kind"])


@query("temporal_rollback_preview", f"SELECT n.item_id, n.kind, n.version AS now, o.version AS back, n.content <> o.content AS content_changes FROM ({_AT.format(_NOW)}) n JOIN ({_AT.format(_THEN)}) o USING (item_id, kind) WHERE n.version <> o.version", "versions")
def temporal_rollback_preview(t: Tables) -> DataFrame:
    """What going back to a time would change."""
    now = _at(t, as_of()).select("item_id", "kind", F.col("version").alias("now"), F.col("content").alias("c1"))
    then = _at(t, F.lit("2024-01-10").cast("timestamp_ntz")).select("item_id", "kind", F.col("version").alias("back"), F.col("content").alias("c2"))
    return now.join(then, ["item_id", "kind"]).filter("now <> back").select("item_id", "kind", "now", "back", (F.col("c1") != F.col("c2")).alias("content_changes"))


@query("temporal_context_view", f"SELECT kind, count(*) AS n, round(avg(value), 6) AS mean FROM ({_AT.format(_THEN)}) GROUP BY 1", "versions")
def temporal_context_view(t: Tables) -> DataFrame:
    """A session's view as of a time: every read goes through it."""
    view = _at(t, F.lit("2024-01-10").cast("timestamp_ntz"))
    view.createOrReplaceTempView("as_of_versions")
    return t.spark.sql("SELECT kind, count(*) AS n, round(avg(value), 6) AS mean FROM as_of_versions GROUP BY kind")


@query("temporal_index_lookup", f"SELECT item_id, version FROM ({_AT.format(_THEN)}) WHERE kind = 'click' AND item_id IN (1, 2, 3)", "versions")
def temporal_index_lookup(t: Tables) -> DataFrame:
    return _at(t, F.lit("2024-01-10").cast("timestamp_ntz")).filter("kind = 'click' and item_id in (1, 2, 3)").select("item_id", "version")


@query("temporal_batch_lookup", f"SELECT u.user_id, v.version FROM (SELECT DISTINCT user_id FROM events WHERE event_type = 'click') u LEFT JOIN (SELECT * FROM ({_AT.format(_THEN)}) WHERE kind = 'view') v ON v.item_id = u.user_id", "versions")
def temporal_batch_lookup(t: Tables) -> DataFrame:
    """The version of each of many items at a time, null where there is none."""
    ids = t.events.filter("event_type = 'click'").select("user_id").distinct()
    then = _at(t, F.lit("2024-01-10").cast("timestamp_ntz")).filter("kind = 'view'").select(F.col("item_id").alias("user_id"), "version")
    return ids.join(then, "user_id", "left")


@query("temporal_search", f"SELECT v.item_id, v.kind, v.version FROM versions v WHERE tx_start BETWEEN {_THEN} AND TIMESTAMP '2024-01-15' AND item_id IN (SELECT DISTINCT item_id FROM versions WHERE contains(content, '7'))", "versions")
def temporal_search(t: Tables) -> DataFrame:
    """Hits of a search, and their versions in a range."""
    hits = t.versions.filter(F.col("content").contains("7")).select("item_id").distinct()
    at = F.col("tx_start").between(F.lit("2024-01-10").cast("timestamp_ntz"), F.lit("2024-01-15").cast("timestamp_ntz"))
    return t.versions.filter(at).join(hits, "item_id", "left_semi").select("item_id", "kind", "version")


@query("temporal_version_diff", "SELECT a.item_id, a.kind, a.content <> b.content AS content_changed, (epoch_us(b.tx_start) // 1000000 - epoch_us(a.tx_start) // 1000000)::BIGINT AS seconds FROM versions a JOIN versions b USING (item_id, kind) WHERE a.version = 1 AND b.version = 3", "versions")
def temporal_version_diff(t: Tables) -> DataFrame:
    """Two versions by their numbers."""
    of = lambda n, x: t.versions.filter(F.col("version") == n).select("item_id", "kind", F.col("content").alias(f"c{x}"), F.col("tx_start").alias(f"t{x}"))
    secs = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    return of(1, "a").join(of(3, "b"), ["item_id", "kind"]).select("item_id", "kind", (F.col("ca") != F.col("cb")).alias("content_changed"), (secs("tb") - secs("ta")).alias("seconds"))


@query("temporal_batch_relationships", "SELECT src, count(*) AS n FROM edges WHERE src IN (SELECT 'o:' || o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') AND edge_type = 'PLACED_BY' AND valid_from <= TIMESTAMP '1996-06-01' AND (valid_to IS NULL OR TIMESTAMP '1996-06-01' < valid_to) GROUP BY 1", "edges")
def temporal_batch_relationships(t: Tables) -> DataFrame:
    """Relationships of many items that hold at a time."""
    ids = t.orders.filter("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("src"))
    then = F.lit("1996-06-01").cast("timestamp_ntz")
    held = t.edges.filter(F.col("edge_type") == "PLACED_BY").filter(tp.valid_at(F.col("valid_from"), F.col("valid_to"), then))
    return held.join(ids, "src", "left_semi").groupBy("src").agg(F.count(F.lit(1)).alias("n"))


@fixture("temporal_join_strategy", "SELECT * FROM (VALUES (50::BIGINT, 'nested loop'), (500, 'hash'), (5000, 'sort merge')) v(n, strategy)")
def temporal_join_strategy(t: Tables) -> DataFrame:
    """The label that the size of a join would get; the plan itself is left to the optimiser."""
    n = F.col("n")
    return t.spark.createDataFrame([(50,), (500,), (5000,)], "n long").select("n", F.when(n < 100, "nested loop").when(n < 1000, "hash").otherwise("sort merge").alias("strategy"))


# ---- plugins and stages ---------------------------------------------------------------------------------------------
def _registry() -> pl.Registry:
    r = pl.Registry()
    r.register("extractor", "words", lambda df: df.select("note_id", F.explode(tx.words(F.col("content"))).alias("word")))
    r.register("enricher", "size", lambda df: df.withColumn("size", F.length("content")))
    r.register("enricher", "summary", lambda df: df.withColumn("summary", tx.first_sentence(F.col("content"))))
    r.register("evolver", "archive", lambda df: df.withColumn("archived", F.col("size") < 30))
    r.register("grounder", "ids", lambda df: df.withColumn("ground", F.concat(F.lit("G"), F.col("note_id").cast("string"))))
    r.register("embedder", "digest", lambda df: df.withColumn("vector", F.array(F.length("content").cast("double"))))
    r.register("metric", "size", lambda df: df.withColumn("score", 1 / (1 + F.abs(F.length("content") - 50))))
    return r


@fixture("plugin_registry", "SELECT * FROM (VALUES ('embedder', 'digest'), ('enricher', 'size'), ('enricher', 'summary'), ('evolver', 'archive'), ('extractor', 'words'), ('grounder', 'ids'), ('metric', 'size')) v(kind, name)")
def plugin_registry(t: Tables) -> DataFrame:
    r = _registry()
    return t.spark.createDataFrame([(k, n) for k in pl.KINDS for n in r.names(k)], "kind string, name string")


@query("plugin_extractor", r"SELECT note_id, word, count(*) AS n FROM (SELECT note_id, unnest(list_filter(regexp_split_to_array(lower(content), '\s+'), lambda x: x <> '')) AS word FROM notes) GROUP BY 1, 2", "notes")
def plugin_extractor(t: Tables) -> DataFrame:
    return t.notes.transform(_registry().get("extractor", "words")).groupBy("note_id", "word").agg(F.count(F.lit(1)).alias("n"))


@query("plugin_enrich_evolve", "SELECT note_id, length(content)::INTEGER AS size, length(content) < 30 AS archived, 'G' || note_id AS ground FROM notes WHERE content IS NOT NULL", "notes")
def plugin_enrich_evolve(t: Tables) -> DataFrame:
    """Enricher, evolver and grounder plugins one after the other."""
    r = _registry()
    out = t.notes.filter("content is not null")
    for kind, name in (("enricher", "size"), ("evolver", "archive"), ("grounder", "ids")):
        out = out.transform(r.get(kind, name))
    return out.select("note_id", "size", "archived", "ground")


@query("plugin_embed_metric", "SELECT note_id, length(content)::DOUBLE AS dim, round(1 / (1 + abs(length(content) - 50)), 6)::DOUBLE AS score FROM notes WHERE content IS NOT NULL", "notes")
def plugin_embed_metric(t: Tables) -> DataFrame:
    r = _registry()
    out = t.notes.filter("content is not null").transform(r.get("embedder", "digest")).transform(r.get("metric", "size"))
    return out.select("note_id", F.col("vector")[0].alias("dim"), F.round("score", 6).alias("score"))


@fixture("plugin_validation", "SELECT * FROM (VALUES ('words', 'ok'), ('nameless', 'no name'), ('7up', 'no name'), ('lost', 'unknown kind'), ('still', 'not callable')) v(name, problem)")
def plugin_validation(t: Tables) -> DataFrame:
    tried = [("words", "extractor", "words", len), ("nameless", "extractor", "", len), ("7up", "extractor", "7up", len), ("lost", "nothing", "lost", len), ("still", "metric", "still", 5)]
    return t.spark.createDataFrame([(label, pl.problem(kind, name, f) or "ok") for label, kind, name, f in tried], "name string, problem string")


@fixture("plugin_compatibility", "SELECT * FROM (VALUES ('1.2.0', '>=1.0,<2', TRUE), ('2.0', '>=1.0,<2', FALSE), ('0.9', '>=1.0', FALSE), ('x', '>=1.0', TRUE), ('1.0', '', TRUE)) v(version, wanted, ok)")
def plugin_compatibility(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(v, w, pl.compatible(v, w)) for v, w in (("1.2.0", ">=1.0,<2"), ("2.0", ">=1.0,<2"), ("0.9", ">=1.0"), ("x", ">=1.0"), ("1.0", ""))], "version string, wanted string, ok boolean")


@fixture("plugin_manager", "SELECT * FROM (VALUES ('words', 'loaded'), ('old', 'incompatible'), ('broken', 'failed')) v(name, state)")
def plugin_manager(t: Tables) -> DataFrame:
    """What becomes of plugins on offer: loaded, refused for their version, or failed while loading."""

    def broken() -> None:
        raise RuntimeError("no")

    offers = {"words": ("extractor", "1.1", lambda: len), "old": ("metric", "0.1", lambda: len), "broken": ("metric", "1.0", broken)}
    return t.spark.createDataFrame(sorted(pl.load(pl.Registry(), offers, ">=1.0").items()), "name string, state string")


@fixture("plugin_executor", "SELECT * FROM (VALUES ('fine', '3'), ('wrong', 'ValueError'), ('slow', 'timeout')) v(name, outcome)")
def plugin_executor(t: Tables) -> DataFrame:
    """Plugins under a time limit: a result, the name of what went wrong, or timeout."""
    import time

    def wrong() -> None:
        raise ValueError

    jobs = {"fine": lambda: 3, "wrong": wrong, "slow": lambda: time.sleep(0.5)}
    return t.spark.createDataFrame([(k, pl.guarded(f, 0.2)) for k, f in jobs.items()], "name string, outcome string")


def _stages() -> list:
    return [
        ("classify", lambda df: df.withColumn("kind", F.when(F.col("content").contains("?"), "question").otherwise("note"))), ("clean", lambda df: df.withColumn("content", tx.clean(F.col("content")))),
        ("size", lambda df: df.withColumn("size", F.length("content"))), ("store", lambda df: df.withColumn("stored", F.lit(True))),
    ]


@query("stage_pipeline_run", r"SELECT note_id, CASE WHEN contains(content, '?') THEN 'question' ELSE 'note' END AS kind, length(trim(regexp_replace(content, '\s+', ' ', 'g')))::INTEGER AS size, TRUE AS stored FROM notes WHERE content IS NOT NULL", "notes")
def stage_pipeline_run(t: Tables) -> DataFrame:
    return pl.Pipeline(_stages()).run(t.notes.filter("content is not null")).select("note_id", "kind", "size", "stored")


@fixture("stage_breakpoint_resume", "SELECT 'until clean' AS step, 'content,kind,note_id' AS columns UNION ALL SELECT 'resumed', 'content,kind,note_id,size,stored' UNION ALL SELECT 'undone', 'content,kind,note_id,size'")
def stage_breakpoint_resume(t: Tables) -> DataFrame:
    """The columns after a run to a stage, its resumption, and the undoing of the last stage."""
    p = pl.Pipeline(_stages())
    steps = [("until clean", p.run(t.told_notes, "clean")), ("resumed", p.resume()), ("undone", p.undo())]
    return t.spark.createDataFrame([(k, ",".join(sorted(df.columns))) for k, df in steps], "step string, columns string")


@fixture("stage_retry", "SELECT * FROM (VALUES ('twice', 'done', 3), ('always', 'skipped', 3), ('never', 'done', 1)) v(stage, outcome, tries)")
def stage_retry(t: Tables) -> DataFrame:
    """A stage is tried three times, longer apart each time; then it is skipped or the run ends."""

    def failing(n: int):
        left = [n]

        def f(df: DataFrame) -> DataFrame:
            left[0] -= 1
            if left[0] >= 0:
                raise RuntimeError("not yet")
            return df

        return f

    out = []
    for name, n in (("twice", 2), ("always", 9), ("never", 0)):
        _, outcome, tries = pl.retried(failing(n), t.told_notes, wait=0.01)
        out.append((name, outcome, tries))
    return t.spark.createDataFrame(out, "stage string, outcome string, tries int")


@fixture("stage_order", "SELECT * FROM (VALUES (0, 'classify'), (1, 'simplify'), (2, 'extract'), (3, 'link'), (4, 'store')) v(place, stage)")
def stage_order(t: Tables) -> DataFrame:
    order = pl.order_stages({"store": ["link"], "link": ["extract"], "extract": ["simplify", "classify"], "simplify": ["classify"], "classify": []})
    return t.spark.createDataFrame(list(enumerate(order)), "place int, stage string")


@query("stage_llm_extract", "SELECT p_partkey, CASE WHEN n = 0 THEN 'ruler_only' ELSE 'llm_enriched' END AS status, least(n, 2)::BIGINT AS kept FROM (SELECT p_partkey, len(list_filter(string_split(p_name, ' '), lambda x: length(x) > 4)) AS n FROM part)")
def stage_llm_extract(t: Tables) -> DataFrame:
    """Entities that a model has found already, as an input table: capped, with a status."""
    found = t.part.select("p_partkey", F.explode(F.filter(F.split("p_name", " "), lambda x: F.length(x) > 4)).alias("entity"))
    n = found.groupBy("p_partkey").agg(F.count(F.lit(1)).alias("n"))
    rows = t.part.select("p_partkey").join(n, "p_partkey", "left")
    return rows.select("p_partkey", F.when(F.col("n").isNull(), "ruler_only").otherwise("llm_enriched").alias("status"), F.least(F.coalesce("n", F.lit(0)), F.lit(2)).cast("long").alias("kept"))


@query("stage_ontology_constrain", """
SELECT p_partkey, CASE WHEN p_size >= 25 THEN 'accepted' WHEN p_size >= 10 THEN 'provisional' ELSE 'rejected' END AS state FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS k FROM part) WHERE k <= 20""")
def stage_ontology_constrain(t: Tables) -> DataFrame:
    """Entities by confidence: accepted, provisional or rejected; twenty of each text at most."""
    k = F.row_number().over(W.partitionBy("p_brand").orderBy(F.desc("p_size"), "p_partkey"))
    state = F.when(F.col("p_size") >= 25, "accepted").when(F.col("p_size") >= 10, "provisional").otherwise("rejected")
    return t.part.withColumn("k", k).filter("k <= 20").select("p_partkey", state.alias("state"))


@query("stage_store", "SELECT 'memories' AS part, (SELECT count(*) FROM part) AS n UNION ALL SELECT 'entities', (SELECT count(DISTINCT p_brand) FROM part) UNION ALL SELECT 'relations', (SELECT count(DISTINCT (p_brand, p_type)) FROM part)")
def stage_store(t: Tables) -> DataFrame:
    """Memories, entities and relations in one transaction, as a reader then sees them."""
    root = so.folder(t.spark, "stage-store")
    tx_ = so.Transaction(t.spark, root)
    parts = {"memories": t.part.select(F.col("p_name").alias("x")), "entities": t.part.select(F.col("p_brand").alias("x")).distinct(), "relations": t.part.select(F.concat_ws("|", "p_brand", "p_type").alias("x")).distinct()}
    for name, df in parts.items():
        tx_.write(df, name)
    tx_.commit()
    rows = [so.Transaction.read(t.spark, root, name, "x string").agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n")) for name in parts]
    return rows[0].union(rows[1]).union(rows[2])


@query("stage_link", "SELECT a.p_partkey AS src, min(b.p_partkey) AS dst FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND b.p_partkey < a.p_partkey GROUP BY 1")
def stage_link(t: Tables) -> DataFrame:
    """New items linked to the first one that has the same entities: the least of each key, not all pairs."""
    first = t.part.groupBy("p_brand", "p_type").agg(F.min("p_partkey").alias("dst"))
    return t.part.join(first, ["p_brand", "p_type"]).filter("p_partkey <> dst").select(F.col("p_partkey").alias("src"), "dst")


@query("stage_enrich", r"SELECT note_id, length(content)::INTEGER AS size, coalesce(nullif(trim(regexp_extract(content, '^([^.!?]*[.!?])', 1)), ''), substr(content, 1, 100)) AS summary FROM notes WHERE content IS NOT NULL", "notes")
def stage_enrich(t: Tables) -> DataFrame:
    """All registered enrichers."""
    r, out = _registry(), t.notes.filter("content is not null")
    for name in r.names("enricher"):
        out = out.transform(r.get("enricher", name))
    return out.select("note_id", "size", "summary")


@fixture("stage_ground", "SELECT name, CASE lower(trim(name)) WHEN 'rome' THEN 'Q220' WHEN 'ada' THEN 'Q7259' END AS qid FROM vocabulary", "vocabulary")
def stage_ground(t: Tables) -> DataFrame:
    """Ids of public knowledge by alias; the alias table may be of any size."""
    aliases = t.spark.createDataFrame([("rome", "Q220"), ("ada", "Q7259")], "surface string, qid string")
    return t.vocabulary.join(aliases, F.lower(F.trim("name")) == F.col("surface"), "left").select("name", "qid")


@query("stage_evolve", "SELECT event_id, round(exp(-(epoch(TIMESTAMP '2024-01-31') - epoch(ts)) / 86400 / 30), 6) AS retention FROM events WHERE (epoch(TIMESTAMP '2024-01-31') - epoch(ts)) / 86400 <= 20")
def stage_evolve(t: Tables) -> DataFrame:
    """Decay of what is recent enough; the rest is archived."""
    age = days_before(F.col("ts"))
    return t.events.filter(age <= 20).select("event_id", F.round(sc.retention(age), 6).alias("retention"))


@query("filter_prune_by_age", "SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '2024-01-31' - INTERVAL 10000 DAY OR o_orderdate < TIMESTAMP '1996-01-01'")
def filter_prune_by_age(t: Tables) -> DataFrame:
    """What a pruning by age would take: a dry run."""
    age = days_before(F.col("o_orderdate").cast("timestamp_ntz"))
    return t.orders.filter((age > 10000) | (F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz"))).select("o_orderkey")


@fixture("set_schema_drift_event", "SELECT * FROM (VALUES ('p1', 'confidence_reduced', 0.45::DOUBLE), ('p2', 'flagged', 0.9::DOUBLE)) v(proc_id, event, confidence)")
def set_schema_drift_event(t: Tables) -> DataFrame:
    """Procedures whose tools have changed: a breaking change halves the confidence, another only flags it."""
    from memlattice.operators import dedup as dd

    users = t.snapshots.select("proc_id", "tool").distinct()
    changes = dd.schema_diff(t.snapshots.select("tool", "property", "type", "required"), t.current_tools).groupBy("tool").agg(F.max("breaking").alias("breaking"))
    hit = users.join(changes, "tool").groupBy("proc_id").agg(F.max("breaking").alias("b"))
    return hit.select("proc_id", F.when(F.col("b"), "confidence_reduced").otherwise("flagged").alias("event"), F.when(F.col("b"), F.lit(0.9) * 0.5).otherwise(F.lit(0.9)).alias("confidence"))
