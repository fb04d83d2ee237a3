"""Corpora of JSON lines made from the documents: read by byte ranges, imported by a stream that resumes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlattice.operators import store as so
from memlattice.sources import jsonl
from memlattice.sources.tables import Tables

from .registry import query

#: Bytes of a range here: small, so that lines cross ranges also in small data.
_WIDTH = 1 << 18
_KINDS = ("semantic", "episodic", "procedural", "zettel")


def _corpus(t: Tables, docs: DataFrame, path: str) -> str:
    """Documents as corpus records in several files with a header each; every seventh id is cut in its middle, every eleventh blank."""
    kind = F.element_at(F.array(*[F.lit(x) for x in _KINDS]), (F.col("doc_id") % 4 + 1).cast("int"))
    struct = lambda **x: F.struct(*[c.alias(k) for k, c in x.items()])
    entities = F.array(struct(name=F.col("source"), type=F.lit("source")), struct(name=F.col("lang"), type=F.lit("language")))
    relations = F.array(struct(source=F.col("source"), relation=F.lit("written_in"), target=F.col("lang")))
    record = F.to_json(struct(content=F.col("text"), memory_type=kind, entities=entities, relations=relations, metadata=struct(domain=F.col("source"), doc=F.col("doc_id").cast("string"))))
    value = F.when(F.col("doc_id") % 7 == 0, F.substring(record, 1, 30)).when(F.col("doc_id") % 11 == 0, F.lit("")).otherwise(record)
    head = t.spark.range(1).select(F.lit('{"_type": "header", "_version": "1.0", "_source": "documents"}').alias("value"))
    docs.select(value.alias("value")).union(head).write.mode("append").text(path)
    return path


_KEPT = "FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND coalesce(text, '') <> ''"


@query("scan_corpus_ranges", f"SELECT doc_id::VARCHAR AS doc, ['semantic','episodic','procedural','zettel'][(doc_id % 4 + 1)::INT] AS memory_type, md5(text) AS digest {_KEPT}")
def scan_corpus_ranges(t: Tables) -> DataFrame:
    """Every record of the corpus, whichever ranges its bytes lie in."""
    rows = jsonl.read_records(t.spark, _corpus(t, t.documents, so.folder(t.spark, "corpus")), width=_WIDTH)
    return rows.select(F.col("metadata")["doc"].alias("doc"), "memory_type", F.md5(F.col("content").cast("binary")).alias("digest"))


def _imported(t: Tables, domain: str | None = None) -> jsonl.CorpusImport:
    """An import in two runs, the second of what came after the first."""
    path = so.folder(t.spark, "corpus")
    job = jsonl.CorpusImport(t.spark, path, so.folder(t.spark, "import"), domain=domain, width=_WIDTH)
    for part in (0, 1):
        _corpus(t, t.documents.filter(F.col("doc_id") % 2 == part), path)
        job.run()
    return job


@query("write_corpus_import", f"SELECT doc_id::VARCHAR AS doc, md5(text) AS digest {_KEPT} AND contains(source, 'src1')")
def write_corpus_import(t: Tables) -> DataFrame:
    return _imported(t, "src1").items().select(F.col("metadata")["doc"].alias("doc"), F.md5(F.col("content").cast("binary")).alias("digest"))


@query("write_corpus_import_stats", """
SELECT count(*) FILTER (WHERE doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND coalesce(text, '') <> '' AND contains(source, 'src1')) AS imported,
       count(*) FILTER (WHERE doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND NOT (coalesce(text, '') <> '' AND contains(source, 'src1'))) AS skipped,
       count(*) FILTER (WHERE doc_id % 7 = 0) AS errors, count(*) FILTER (WHERE doc_id % 7 <> 0 AND doc_id % 11 = 0) + 2 AS passed_over FROM documents""")
def write_corpus_import_stats(t: Tables) -> DataFrame:
    return _imported(t, "src1").stats()


@query("write_seed_pack", f"""
SELECT 'entity' AS part, source AS name, 'source' AS kind, count(*) AS n {_KEPT} GROUP BY source UNION ALL SELECT 'entity', lang, 'language', count(*) {_KEPT} GROUP BY lang
UNION ALL SELECT 'relation', source, lang, count(*) {_KEPT} GROUP BY source, lang""")
def write_seed_pack(t: Tables) -> DataFrame:
    """What installing a pack brings beside its items: entities and relations, once each."""
    job = _imported(t)
    return job.entities().select(F.lit("entity").alias("part"), "name", F.col("type").alias("kind"), "n").union(job.relations().select(F.lit("relation"), "source", "target", "n"))
