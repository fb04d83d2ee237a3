"""JSON-lines corpora as a data source of its own: byte ranges for batches, byte offsets for streams, checkpointed imports."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Bytes of a range that one task reads, and of one read from a file.
RANGE, CHUNK = 1 << 26, 1 << 22
SCHEMA = "file string, start long, k long, offset long, value string"
_NAMES = ["file", "start", "k", "offset", "value"]
FORMAT = "jsonl_corpus"
ENTITY, RELATION = "struct<name:string,type:string>", "struct<source:string,relation:string,target:string>"
RECORD = f"content string, memory_type string, entities array<{ENTITY}>, relations array<{RELATION}>, metadata map<string,string>"


class Range(InputPartition):
    """Bytes of a file: the lines that begin in them."""

    def __init__(self, file: str, start: int, end: int):
        self.file, self.start, self.end = file, start, end


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else f"file:{path}")


def _files(path: str) -> dict[str, int]:
    """The sizes of a file, or of all files below a folder whose names don't begin with a dot or underscore."""
    system, name = _open(path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path)
    info = system.get_file_info(name)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(name, recursive=True)) if info.type == fs.FileType.Directory else []
    prefix = path[: len(path) - len(name)] if path.endswith(name) else ""
    return {prefix + x.path: x.size for x in sorted(found, key=lambda x: x.path) if x.type == fs.FileType.File and not x.base_name.startswith((".", "_"))}


def _split(file: str, start: int, end: int, width: int) -> list[Range]:
    return [Range(file, a, min(a + width, end)) for a in range(start, end, width)]


def _read(part: Range) -> Iterator[pa.RecordBatch]:
    """The lines that begin in a range, in chunks; the last one is read to its end, however far that is."""
    system, name = _open(part.file)
    with system.open_input_file(name) as f:
        at, k, rest = part.start, 0, b""
        if at:  # the line that runs into the range belongs to the range before
            f.seek(at - 1)
            at -= 1
            while chunk := f.read(CHUNK):
                cut = chunk.find(b"\n")
                if cut >= 0:
                    at, rest = at + cut + 1, chunk[cut + 1 :]
                    break
                at += len(chunk)
            else:
                return
        while at < part.end:
            chunk = f.read(CHUNK)
            block = rest + chunk
            lines = block.split(b"\n")
            rest = lines.pop() if chunk else b""
            if not chunk and lines and not lines[-1]:
                lines.pop()  # nothing follows the last line end
            values, offsets = [], []
            for line in lines:
                if at >= part.end:
                    break
                offsets.append(at)
                values.append(line.removesuffix(b"\r").decode("utf-8", "replace"))
                at += len(line) + 1
            if values:
                n = len(values)
                yield pa.RecordBatch.from_arrays([pa.array([part.file] * n, pa.string()), pa.array([part.start] * n, pa.int64()), pa.array(range(k, k + n), pa.int64()), pa.array(offsets, pa.int64()), pa.array(values, pa.string())], names=_NAMES)
                k += n
            if not chunk:
                return


class _Batch(DataSourceReader):
    def __init__(self, path: str, width: int):
        self.path, self.width = path, width

    def partitions(self) -> Sequence[InputPartition]:
        return [r for file, size in _files(self.path).items() for r in _split(file, 0, size, self.width)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _read(partition) if partition.end > partition.start else iter(())


class _Stream(DataSourceStreamReader):
    """Offsets are the bytes of each file up to its last whole line; a line that is still being written waits."""

    def __init__(self, path: str, width: int):
        self.path, self.width = path, width

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {file: self._whole(file, size) for file, size in _files(self.path).items()}

    def _whole(self, file: str, size: int) -> int:
        system, name = _open(file)
        with system.open_input_file(name) as f:
            while size:
                start = max(0, size - CHUNK)
                f.seek(start)
                cut = f.read(size - start).rfind(b"\n")
                if cut >= 0:
                    return start + cut + 1
                size = start
        return 0

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return [r for file, size in end.items() for r in _split(file, start.get(file, 0), size, self.width)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _read(partition) if partition.end > partition.start else iter(())


class CorpusLines(DataSource):
    """spark.read.format("jsonl_corpus").load(path): the lines of a file or folder, (file, start, k, offset, value).

    offset is a line's first byte, start that of the range that gives it, k its place there.  Option `range` sets the
    bytes of a range.  Blank lines are lines; a last line without line end is one, but a stream waits for its end.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options["path"], int(self.options.get("range", RANGE)))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options["path"], int(self.options.get("range", RANGE)))


def read_lines(spark: SparkSession, path: str, width: int = RANGE) -> DataFrame:
    spark.dataSource.register(CorpusLines)
    return spark.read.format(FORMAT).option("range", width).load(path)


def number_lines(lines: DataFrame) -> DataFrame:
    """(file, offset, line, value): each file's lines from 1, by the sums of what the ranges before hold.

    Only one number for each range is put in order, so no task gets a file's lines together.
    """
    held = lines.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1))
    ranges = held.select("file", "start", F.coalesce(before, F.lit(0)).alias("before"))
    return lines.join(ranges, ["file", "start"]).select("file", "offset", (F.col("before") + F.col("k") + 1).alias("line"), "value")


def parse(lines: DataFrame, domain: str | None = None) -> DataFrame:
    """lines with their record r and a state: header, blank, error, skipped (no content, or outside the domain) or imported."""
    # an object of a corpus record; text that isn't JSON, or JSON that isn't an object, is an error
    rows = lines.withColumn("r", F.from_json("value", RECORD))
    broken = F.get_json_object("value", "$").isNull() | ~F.ltrim("value").startswith("{")
    header = F.coalesce(F.get_json_object("value", "$._type") == "header", F.lit(False))
    outside = F.lit(False) if domain is None else ~F.coalesce(F.col("r.metadata")["domain"].contains(domain), F.lit(False))
    empty = F.coalesce(F.col("r.content"), F.lit("")) == ""
    state = F.when(F.trim("value") == "", "blank").when(broken, "error").when(header, "header").when(empty | outside, "skipped").otherwise("imported")
    return rows.withColumn("state", state)


def read_records(spark: SparkSession, path: str, domain: str | None = None, after: int = 0, width: int = RANGE) -> DataFrame:
    """(file, line, content, memory_type, entities, relations, metadata) of records behind line `after` of each file.

    Headers, blank, malformed and empty records give nothing, and with a domain those without that substring in
    metadata.domain; no files give no rows.
    """
    rows = parse(number_lines(read_lines(spark, path, width)), domain)
    return rows.filter((F.col("line") > after) & (F.col("state") == "imported")).select("file", "line", "r.*")


class CorpusImport:
    """A checkpointed import of a growing corpus: items, entities and relations as tables, and what became of each line.

    Each run reads, by byte offset, the whole lines that came since the last one, also after a failure: a batch that is
    repeated overwrites its own files.  In mode "direct" the records' entities and relations are written too, in mode
    "full" the items alone, for a pipeline to extract from.
    """

    def __init__(self, spark: SparkSession, path: str, folder: str, mode: str = "direct", domain: str | None = None, width: int = RANGE):
        if mode not in ("full", "direct"):
            raise ValueError(f"mode must be 'full' or 'direct', got {mode!r}")
        self.spark, self.path, self.folder, self.mode, self.domain, self.width = spark, path, folder, mode, domain, width

    def run(self) -> None:
        self.spark.dataSource.register(CorpusLines)
        lines = self.spark.readStream.format(FORMAT).option("range", self.width).load(self.path)
        lines.writeStream.option("checkpointLocation", f"{self.folder}/state").trigger(availableNow=True).foreachBatch(self._write).start().awaitTermination()

    def _write(self, batch: DataFrame, k: int) -> None:
        out = lambda df, table: df.write.mode("overwrite").parquet(f"{self.folder}/{table}/{k}")
        out(parse(batch, self.domain).select("file", "offset", "state", F.when(F.col("state") == "imported", F.col("r")).alias("r")), "lines")

    def lines(self) -> DataFrame:
        return self.spark.read.option("recursiveFileLookup", True).schema(f"file string, offset long, state string, r struct<{RECORD.replace(' string', ':string').replace(' array', ':array').replace(' map', ':map')}>").parquet(f"{self.folder}/lines")

    def items(self) -> DataFrame:
        """(item_id, content, memory_type, metadata): item_id is the file and offset of a record's line."""
        item = F.concat_ws("@", F.element_at(F.split("file", "/"), -1), F.col("offset").cast("string")).alias("item_id")
        return self.lines().filter("state = 'imported'").select(item, "r.content", "r.memory_type", "r.metadata")

    def entities(self) -> DataFrame:
        """(name, type, n): the records' entities, once each, with how many records name them; none in mode "full"."""
        rows = self.lines().filter(F.lit(self.mode == "direct")).select(F.explode(F.array_distinct("r.entities")).alias("e")).filter("e.name is not null")
        return rows.groupBy("e.name", "e.type").agg(F.count(F.lit(1)).alias("n"))

    def relations(self) -> DataFrame:
        """(source, relation, target, n): the records' relations whose ends are given, once each; none in mode "full"."""
        rows = self.lines().filter(F.lit(self.mode == "direct")).select(F.explode(F.array_distinct("r.relations")).alias("x")).filter("x.source is not null and x.target is not null")
        return rows.groupBy("x.source", "x.relation", "x.target").agg(F.count(F.lit(1)).alias("n"))

    def stats(self) -> DataFrame:
        """One row: imported, skipped, errors, and the bytes read of all files up to the last lines."""
        n = lambda s: F.count_if(F.col("state") == s).alias({"error": "errors"}.get(s, s))
        return self.lines().agg(n("imported"), n("skipped"), n("error"), F.count_if(F.col("state").isin("blank", "header")).alias("passed_over"))
