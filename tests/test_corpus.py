"""The JSON-lines source: ranges of any size, numbered lines, streams over growing files, and imports that resume."""

import json
import random

import pytest

from memlattice.sources import jsonl

HEADER = '{"_type": "header", "_version": "1.0"}'


def record(k, domain="tech", **more):
    return json.dumps({"content": f"item {k} é", "memory_type": "semantic", "metadata": {"domain": domain}, "entities": [{"name": f"e{k % 3}", "type": "t"}], "relations": [{"source": f"e{k % 3}", "relation": "r", "target": "x"}], **more}, ensure_ascii=False)


@pytest.mark.parametrize("width", [1, 7, 100, 1 << 20])
def test_every_line_is_in_one_range(spark, tmp_path, monkeypatch, width):
    rng = random.Random(width)
    files = {"a.jsonl": ["x" * rng.randint(0, 30) for _ in range(60)], "b.jsonl": ["é" * 200, "", "last"], "empty.jsonl": []}
    for name, lines in files.items():
        (tmp_path / name).write_bytes("\n".join(lines).encode() + (b"\n" if name == "a.jsonl" else b""))
    (tmp_path / "_hidden").write_text("no\n")
    rows = jsonl.number_lines(jsonl.read_lines(spark, str(tmp_path), width)).collect()
    got = sorted((r.file.split("/")[-1], r.line, r.value) for r in rows)
    assert got == sorted((n, k, v) for n, lines in files.items() for k, v in enumerate(lines, 1))
    raw = {n: (tmp_path / n).read_bytes() for n in files}
    assert all(raw[r.file.split("/")[-1]][r.offset :].startswith(r.value.encode()) for r in rows)


def test_lines_longer_than_a_chunk_and_carriage_returns(tmp_path, monkeypatch):
    monkeypatch.setattr(jsonl, "CHUNK", 5)
    lines = ["a" * 23, "", "bc", "d" * 11]
    path = tmp_path / "long.jsonl"
    path.write_bytes("\r\n".join(lines).encode())
    for width in (3, 8, 50):
        read = [v for r in jsonl._split(str(path), 0, path.stat().st_size, width) for b in jsonl._read(r) for v in b.column("value").to_pylist()]
        assert read == lines


def test_no_files(spark, tmp_path):
    assert jsonl.read_lines(spark, str(tmp_path / "none")).count() == 0
    assert jsonl.read_records(spark, str(tmp_path / "none")).count() == 0


def test_records_after_a_line_and_of_a_domain(spark, tmp_path):
    lines = [HEADER, record(1), "{broken", "[1]", "", record(2, "biotech"), record(3, "law"), '{"content": ""}', record(4), "null", '{"content": "no metadata"}']
    (tmp_path / "c.jsonl").write_text("\n".join(lines) + "\n")
    read = lambda **x: [(r.line, r.content) for r in jsonl.read_records(spark, str(tmp_path), width=64, **x).orderBy("line").collect()]
    assert read() == [(2, "item 1 é"), (6, "item 2 é"), (7, "item 3 é"), (9, "item 4 é"), (11, "no metadata")]
    assert read(domain="tech", after=2) == [(6, "item 2 é"), (9, "item 4 é")]
    states = {r.state for r in jsonl.parse(jsonl.read_lines(spark, str(tmp_path))).collect()}
    assert states == {"header", "error", "blank", "skipped", "imported"}


def test_import_resumes_and_waits_for_whole_lines(spark, tmp_path):
    path, out = tmp_path / "grow.jsonl", str(tmp_path / "out")
    job = jsonl.CorpusImport(spark, str(path), out, domain="tech", width=50)
    path.write_text(HEADER + "\n" + record(1) + "\n{bro")
    job.run()
    assert [r.content for r in job.items().collect()] == ["item 1 é"]
    assert tuple(job.stats().first()) == (1, 0, 0, 1)
    with path.open("a") as f:
        f.write("ken\n" + record(2) + "\n" + record(3, "law") + "\n" + record(4))
    job.run()
    job.run()  # nothing new
    assert sorted(r.content for r in job.items().collect()) == ["item 1 é", "item 2 é"]
    assert tuple(job.stats().first()) == (2, 1, 1, 1)
    with path.open("a") as f:
        f.write("\n")
    jsonl.CorpusImport(spark, str(path), out, domain="tech", width=50).run()  # another process goes on
    assert tuple(job.stats().first()) == (3, 1, 1, 1)
    ids = [r.item_id for r in job.items().collect()]
    assert len(set(ids)) == 3
    assert sorted(map(tuple, job.entities().collect())) == [("e1", "t", 2), ("e2", "t", 1)]
    assert sorted(map(tuple, job.relations().collect())) == [("e1", "r", "x", 2), ("e2", "r", "x", 1)]
    full = jsonl.CorpusImport(spark, str(path), str(tmp_path / "full"), mode="full")
    full.run()
    assert full.items().count() == 4 and full.entities().count() == 0 == full.relations().count()
    with pytest.raises(ValueError):
        jsonl.CorpusImport(spark, str(path), out, mode="half")
