"""Queries of stores, sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlattice.operators import graph as g
from memlattice.operators import store as so
from memlattice.sources import corpus
from memlattice.sources.tables import Tables
from memlattice.streaming import metrics as st

from .registry import fixture, query


def _pairs(c: str):
    return F.array_join(F.array_sort(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")


@fixture("write_set_properties", """
WITH e AS (SELECT rec_id, seen, unnest(map_entries(props)) AS e FROM records), last AS (SELECT rec_id, e.key AS k, arg_max(e.value, seen) AS v FROM e GROUP BY 1, 2)
SELECT r.rec_id, coalesce(string_agg(k || '=' || v, ',' ORDER BY k || '=' || v), '') AS props FROM (SELECT DISTINCT rec_id FROM records) r LEFT JOIN last USING (rec_id) GROUP BY 1""", "records")
def write_set_properties(t: Tables) -> DataFrame:
    return so.set_properties(t.records, "rec_id", "props", "seen").select("rec_id", _pairs("props").alias("props"))


@query("write_merge_node_properties", """
WITH n AS (SELECT DISTINCT 'n:' || n_nationkey AS id, n_regionkey, unnest([('name', n_name), ('key' || (n_nationkey % 3), n_nationkey::VARCHAR), ('all', 'x' || n_nationkey)]) AS e FROM nation),
m AS (SELECT CASE WHEN n_regionkey = 0 THEN 'n:0' ELSE id END AS target, n_regionkey = 0 AND id <> 'n:0' AS moved, id, e[1] AS k, e[2] AS v FROM n)
SELECT target AS item_id, string_agg(k || '=' || v, ',' ORDER BY k || '=' || v) AS props FROM (SELECT target, k, arg_min(v, (moved, id)) AS v FROM m GROUP BY 1, 2) GROUP BY 1""")
def write_merge_node_properties(t: Tables) -> DataFrame:
    key = F.col("n_nationkey").cast("string")
    nodes = t.nation.select(F.concat(F.lit("n:"), key).alias("item_id"), "n_regionkey", F.create_map(F.lit("name"), "n_name", F.concat(F.lit("key"), (F.col("n_nationkey") % 3).cast("string")), key, F.lit("all"), F.concat(F.lit("x"), key)).alias("props"))
    mapping = nodes.filter("n_regionkey = 0 and item_id <> 'n:0'").select(F.col("item_id").alias("old_id"), F.lit("n:0").alias("new_id"))
    return so.merge_properties(nodes.select("item_id", "props"), mapping, "item_id", "props").select("item_id", _pairs("props").alias("props"))


@query("write_bulk_nodes", "SELECT item_id, arg_max(name, part) AS name FROM (SELECT item_id, name, 0 AS part FROM nodes UNION ALL SELECT item_id, upper(name), 1 FROM nodes WHERE memory_type = 'supplier' UNION ALL SELECT 'x:' || item_id, name, 1 FROM nodes WHERE memory_type = 'nation') GROUP BY 1", "nodes")
def write_bulk_nodes(t: Tables) -> DataFrame:
    old = t.nodes.select("item_id", "name", F.lit(0).alias("part"))
    new = t.nodes.filter("memory_type = 'supplier'").select("item_id", F.upper("name"), F.lit(1)).union(t.nodes.filter("memory_type = 'nation'").select(F.concat(F.lit("x:"), "item_id"), "name", F.lit(1)))
    return g.upsert_latest(old.union(new), ["item_id"], [F.col("part").alias("k")]).select("item_id", "name")


@query("write_server_nodes", "SELECT memory_type, 'w1' AS workspace_id, count(*) AS n FROM nodes GROUP BY 1", "nodes")
def write_server_nodes(t: Tables) -> DataFrame:
    """Nodes stamped with their workspace, written by label and read back."""
    path = so.folder(t.spark, "server-nodes")
    so.stamp(t.nodes, {"workspace_id": "w1", "user_id": None}).write.partitionBy("memory_type").parquet(path)
    return t.spark.read.parquet(path).groupBy(F.col("memory_type").cast("string").alias("memory_type"), "workspace_id").agg(F.count(F.lit(1)).alias("n"))


@fixture("write_scope_context", "SELECT claim_id, 't1' AS tenant_id, 'w1' AS workspace_id, 'u1' AS user_id, 'team' AS team_id FROM claims", "claims")
def write_scope_context(t: Tables) -> DataFrame:
    return so.stamp(t.claims.select("claim_id"), {"tenant_id": "t1", "workspace_id": "w1", "user_id": "u1", "team_id": "team"})


@query("write_transaction", "SELECT memory_type, count(*) AS n FROM nodes WHERE memory_type IN ('region', 'nation') GROUP BY 1", "nodes")
def write_transaction(t: Tables) -> DataFrame:
    """Two transactions are committed, one is rolled back and one is left open: readers see the two."""
    root = so.folder(t.spark, "transactions")
    for kind, end in (("region", "commit"), ("supplier", "rollback"), ("nation", "commit"), ("customer", "")):
        tx = so.Transaction(t.spark, root)
        tx.write(t.nodes.filter(F.col("memory_type") == kind), "nodes")
        if end:
            getattr(tx, end)()
    return so.Transaction.read(t.spark, root, "nodes", "item_id string, memory_type string, name string, weight double").groupBy("memory_type").agg(F.count(F.lit(1)).alias("n"))


@query("sink_serialise_restore", "SELECT edge_type, count(*) AS n FROM edges WHERE dst IN (SELECT item_id FROM nodes WHERE memory_type <> 'supplier') AND src IN (SELECT item_id FROM nodes WHERE memory_type <> 'supplier') GROUP BY 1", "nodes edges")
def sink_serialise_restore(t: Tables) -> DataFrame:
    """The graph to JSON and back: edges whose ends are not among the restored nodes are left out."""
    path = so.folder(t.spark, "graph")
    so.dump_graph(t.nodes.filter("memory_type <> 'supplier'"), t.edges.select("src", "dst", "edge_type"), path)
    _, edges = so.load_graph(t.spark, path, "item_id string, memory_type string, name string, weight double", "src string, dst string, edge_type string")
    return edges.groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"))


@query("filter_json_store", "SELECT p_partkey FROM part WHERE p_brand IN ('Brand#5', 'Brand#12', 'Brand#23') AND list_has_any(string_split(p_name, ' '), ['cold', 'small', 'bolt', 'widget']) AND p_type = 'ECONOMY'")
def filter_json_store(t: Tables) -> DataFrame:
    rows = t.part.withColumn("tags", F.split("p_name", " "))
    return rows.filter(so.matches({"p_brand": {"$in": ["Brand#5", "Brand#12", "Brand#23"]}, "tags[]": {"$in": ["cold", "small", "bolt", "widget"]}, "p_type": "ECONOMY"})).select("p_partkey")


@query("search_json_store", "SELECT item_id FROM items WHERE memory_type IN ('semantic', 'zettel') AND contains(lower(content), 'der') ORDER BY length(content) DESC, item_id LIMIT 10 OFFSET 5", "items")
def search_json_store(t: Tables) -> DataFrame:
    kept = t.items.filter(so.matches({"memory_type": {"$in": ["semantic", "zettel"]}}) & F.lower("content").contains("der"))
    return so.page(kept.select("item_id", F.length("content").alias("n")), [F.desc("n"), F.col("item_id")], 5, 10).select("item_id")


@query("scan_json_model", "SELECT item_id, name FROM nodes WHERE memory_type = 'nation' AND name LIKE '%A%'", "nodes")
def scan_json_model(t: Tables) -> DataFrame:
    """Models of one kind in JSON files, read back with filters."""
    path = so.folder(t.spark, "models")
    t.nodes.write.json(path)
    return t.spark.read.schema("item_id string, memory_type string, name string").json(path).filter(so.matches({"memory_type": "nation"}) & F.col("name").contains("A")).select("item_id", "name")


_RECORDS = "SELECT item_id::VARCHAR AS content, memory_type FROM nodes WHERE memory_type IN ('region', 'nation')"


@query("scan_corpus_roundtrip", _RECORDS, "nodes")
def scan_corpus_roundtrip(t: Tables) -> DataFrame:
    """A corpus written as JSON lines and read back."""
    path = so.folder(t.spark, "corpus")
    rows = t.nodes.filter("memory_type in ('region', 'nation')").select(F.col("item_id").alias("content"), "memory_type")
    corpus.write_corpus(rows, path, "test")
    return corpus.read_corpus(t.spark, f"{path}/records").select("content", "memory_type")


@query("sink_corpus_header", f"SELECT 'header' AS _type, 1 AS _version, 'test' AS _source, count(*) AS item_count FROM ({_RECORDS})", "nodes")
def sink_corpus_header(t: Tables) -> DataFrame:
    rows = t.nodes.filter("memory_type in ('region', 'nation')").select(F.col("item_id").alias("content"), "memory_type")
    return corpus.write_corpus(rows, so.folder(t.spark, "corpus"), "test").select("_type", "_version", "_source", "item_count")


@query("sink_corpus_export", """
SELECT p_partkey AS item_id, p_name AS content, 'semantic' AS memory_type, array_to_string(list_sort(list_distinct([p_brand, p_type])), ',') AS entities FROM part WHERE p_size > 5""")
def sink_corpus_export(t: Tables) -> DataFrame:
    items = t.part.select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("content"), F.when(F.col("p_size") > 5, "semantic").otherwise("Version").alias("memory_type"))
    edge = lambda c: t.part.select(F.col("p_partkey").alias("src"), F.col(c).alias("dst"), F.lit("CONTAINS_ENTITY").alias("edge_type"))
    names = t.part.select(F.explode(F.array("p_brand", "p_type")).alias("entity_id")).distinct().withColumn("name", F.col("entity_id"))
    return so.export_corpus(items, edge("p_brand").union(edge("p_type")), names).withColumn("entities", F.array_join("entities", ","))


@fixture("scan_dataset_samples", "SELECT * FROM (VALUES (1::BIGINT, 'Rome', 'country', 'Italy'), (3, 'Ada', 'wrote', 'code'), (3, 'Ada', 'employer', 'Babbage')) v(sample_id, head, relation, tail)")
def scan_dataset_samples(t: Tables) -> DataFrame:
    """Samples with a text as corpus records, a row for each relation; blank texts give nothing."""
    kept = t.samples.filter(F.trim("context") != "")
    return kept.select("sample_id", F.explode(corpus.triplets(F.col("triplets"))).alias("x")).select("sample_id", "x.head", "x.relation", "x.tail")


@fixture("scan_knowledge_snapshot", "SELECT * FROM (VALUES ('Q1', 'universe'), ('Q1', 'cosmos'), ('Q1', 'space'), ('Q2', 'earth'), ('Q2', 'world'), ('Q2', 'space'), ('Q10', 'spaceflight'), ('Q10', 'space'), ('Q3', 'moon')) v(qid, surface)")
def scan_knowledge_snapshot(t: Tables) -> DataFrame:
    return so.knowledge(t.knowledge)[1]


@fixture("seq_alias_dictionary", "SELECT * FROM (VALUES ('universe', 'Q1'), ('cosmos', 'Q1'), ('space', 'Q1'), ('earth', 'Q2'), ('world', 'Q2'), ('spaceflight', 'Q10'), ('moon', 'Q3')) v(surface, qid)")
def seq_alias_dictionary(t: Tables) -> DataFrame:
    return so.best_alias(*so.knowledge(t.knowledge))


@fixture("join_alias_candidates", "SELECT * FROM (VALUES ('space', 'location', 'Q2'), ('moon', 'location', 'Q3'), ('space', 'event', 'Q10'), ('cosmos', 'event', 'Q1')) v(surface, entity_type, qid)")
def join_alias_candidates(t: Tables) -> DataFrame:
    """Of an alias's entities the one of the asked type with most confidence; a single confident one whatever its type."""
    entities, aliases = so.knowledge(t.knowledge)
    asked = t.spark.createDataFrame([("Space", "location"), ("moon", "location"), ("SPACE", "event"), ("cosmos", "event"), ("world", "event"), ("nobody", "event")], "name string, wanted string")
    rows = asked.join(aliases, F.lower("name") == F.col("surface")).join(entities, "qid")
    of = rows.groupBy("surface", "wanted").agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("c"), F.min("qid").alias("only"), F.min_by("qid", F.when(F.col("entity_type") == F.col("wanted"), F.struct(-F.col("confidence"), F.col("qid")))).alias("typed"))
    chosen = F.when((F.col("n") == 1) & (F.col("c") > 0.8), F.col("only")).otherwise(F.col("typed"))
    return of.select("surface", F.col("wanted").alias("entity_type"), chosen.alias("qid")).filter("qid is not null")


@fixture("scan_python_index", """SELECT * FROM (VALUES ('DEFINES', 'code::demo::a.py::Base'), ('DEFINES', 'code::demo::a.py::Child'), ('DEFINES', 'code::demo::a.py::run'), ('DEFINES', 'code::demo::b.py::helper'), ('DEFINES', 'code::demo::tests/test_b.py::test_helper'),
 ('INHERITS', 'Base'), ('IMPORTS', 'os'), ('IMPORTS', 'b.helper'), ('CALLS', 'h'), ('CALLS', 'os.getcwd'), ('CALLS', 'len'), ('CALLS', 'helper')) v(kind, dst)""")
def scan_python_index(t: Tables) -> DataFrame:
    return corpus.index_python(t.sources_py, "demo").select("kind", "dst").distinct()


@fixture("join_import_resolution", """SELECT * FROM (VALUES ('code::demo::a.py::Child', 'h', 'b.helper'), ('code::demo::a.py::Child', 'os.getcwd', 'os.getcwd'), ('code::demo::a.py::run', 'h', 'b.helper'), ('code::demo::a.py::run', 'os.getcwd', 'os.getcwd'),
 ('code::demo::b.py::helper', 'len', 'len'), ('code::demo::tests/test_b.py::test_helper', 'helper', 'b.helper')) v(src, dst, target)""")
def join_import_resolution(t: Tables) -> DataFrame:
    return so.resolve_calls(corpus.index_python(t.sources_py, "demo"))


@fixture("scan_script_index", "SELECT * FROM (VALUES ('IMPORTS', 'a.ts', './b'), ('CLASS', 'a.ts', 'A'), ('INHERITS', 'a.ts', 'Base'), ('FUNCTION', 'a.ts', 'go'), ('FUNCTION', 'b.js', 'double')) v(kind, path, name)")
def scan_script_index(t: Tables) -> DataFrame:
    return so.index_scripts(t.sources_ts)


@query("sink_markdown", "SELECT item_id, md5('---'||chr(10)||'id: '||item_id||chr(10)||'type: '||memory_type||chr(10)||'---'||chr(10)||chr(10)||coalesce(content, '')||chr(10)) AS digest FROM items", "items")
def sink_markdown(t: Tables) -> DataFrame:
    """Items as Markdown texts, written by id and read back."""
    path = so.folder(t.spark, "markdown")
    so.markdown(t.items).write.parquet(path)
    return t.spark.read.parquet(path).select("item_id", F.md5(F.col("value").cast("binary")).alias("digest"))


@query("write_vector_upsert", """
SELECT vec_id, label, n FROM (SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN -1 ELSE label END AS label, len(embedding)::INTEGER AS n FROM embeddings)""")
def write_vector_upsert(t: Tables) -> DataFrame:
    """New vectors replace those of the same id; metadata that is null is dropped, not stored."""
    old = t.embeddings.select("vec_id", "embedding", "label", F.lit(0).alias("k"))
    new = t.embeddings.filter("vec_id % 3 = 0").select("vec_id", "embedding", F.lit(-1).alias("label"), F.lit(1))
    return g.upsert_latest(old.union(new), ["vec_id"], [F.col("k").alias("order")]).select("vec_id", "label", F.size("embedding").alias("n"))


@query("sink_archive", "SELECT conv_id, sha256(string_agg(coalesce(text, ''), chr(10) ORDER BY turn)) AS digest, sum(octet_length(encode(coalesce(text, ''))))::BIGINT + count(*) - 1 AS size FROM conversations GROUP BY 1")
def sink_archive(t: Tables) -> DataFrame:
    """Conversations as blobs in an archive, keyed by their digest, and read back."""
    path = so.folder(t.spark, "archive")
    whole = t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), "\n").alias("blob"))
    whole.select("conv_id", F.sha2("blob", 256).alias("digest"), F.col("blob").cast("binary").alias("blob")).write.parquet(path)
    back = t.spark.read.parquet(path)
    return back.select("conv_id", F.sha2("blob", 256).alias("digest"), F.octet_length("blob").cast("long").alias("size"))


@query("stream_event_sink", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_event_sink(t: Tables) -> DataFrame:
    """Events to a sink of files by workspace, exactly once."""
    path = st.new_folder(g.shared_root(t.spark))
    stream = st.read_events(t.spark, f"{t.sf_dir}/events.parquet").select("event_id", "event_type")
    stream.writeStream.partitionBy("event_type").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).format("parquet").start(f"{path}/out").awaitTermination()
    return t.spark.read.schema("event_id long, event_type string").parquet(f"{path}/out").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("stream_events_after", "SELECT event_id FROM events WHERE event_id > 500 AND event_type = 'click'")
def stream_events_after(t: Tables) -> DataFrame:
    """Events after an id, as they come."""
    stream = st.read_events(t.spark, f"{t.sf_dir}/events.parquet").filter("event_id > 500 and event_type = 'click'").select("event_id")
    return st.latest_table(stream, st.new_folder(g.shared_root(t.spark)), ["event_id"], "append")
