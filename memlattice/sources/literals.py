"""Small tables given as literal rows, for operators whose words the data folder's invented texts never hold.

Each is a DataFrame in Spark and a SELECT over VALUES in SQL, so that a query and its SQL read the same rows.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

_KINDS = {"string": "VARCHAR", "long": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "array<string>": "VARCHAR[]", "array<double>": "DOUBLE[]", "map<string,string>": "MAP(VARCHAR, VARCHAR)"}


def _sql_value(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).upper()
    if isinstance(x, str):
        return "'" + x.replace("'", "''").replace("\n", "'||chr(10)||'") + "'"
    if isinstance(x, list):
        return "[" + ", ".join(map(_sql_value, x)) + "]"
    if isinstance(x, dict):
        return "MAP {" + ", ".join(f"{_sql_value(k)}: {_sql_value(v)}" for k, v in x.items()) + "}"
    return repr(x)


@dataclass(frozen=True)
class Literal:
    """schema as `name kind, ...`; timestamps are given as text."""

    schema: str
    rows: tuple[tuple, ...]

    @property
    def columns(self) -> list[tuple[str, str]]:
        return [tuple(x.split(" ")) for x in self.schema.split(", ")]

    def frame(self, spark: SparkSession) -> DataFrame:
        at = [k for k, (_, kind) in enumerate(self.columns) if kind == "timestamp_ntz"]
        rows = [tuple(dt.datetime.fromisoformat(x) if k in at and x else x for k, x in enumerate(row)) for row in self.rows]
        return spark.createDataFrame(rows, self.schema)

    @property
    def sql(self) -> str:
        names = ", ".join(n for n, _ in self.columns)
        casts = ", ".join(f"CAST({n} AS {_KINDS[k]}) AS {n}" for n, k in self.columns)
        return f"SELECT {casts} FROM (VALUES {', '.join('(' + ', '.join(map(_sql_value, r)) + ')' for r in self.rows)}) v({names})"


_T = "2024-01-10 09:00:00"

LITERALS: dict[str, Literal] = {
    # pairs of memories that reach the branches of the similarity metrics
    "told_pairs": Literal(
        "pair_id long, a string, b string, ta timestamp_ntz, tb timestamp_ntz, type_a string, type_b string, tags_a array<string>, tags_b array<string>, cat_a string, cat_b string, conf_a double, conf_b double, near_a array<string>, near_b array<string>",
        (
            (1, "Step 1 install the database module", "Step 2 configure the database module", _T, "2024-01-10 09:00:30", "procedural", "procedural", ["db", "setup"], ["db"], "ops", "ops", 0.9, 0.8, ["x", "y"], ["y", "z"]),
            (2, "issue: database queries are running slowly", "solution: added indexes on the columns", _T, "2024-01-10 09:20:00", "episodic", "semantic", ["db"], ["db"], "ops", "dev", 1.0, 0.5, ["x"], ["x"]),
            (3, "The first login attempt failed with an error", "Login was successfully implemented after research", _T, "2024-01-10 15:00:00", "episodic", "episodic", [], ["auth"], None, "dev", 0.4, 0.6, [], ["x"]),
            (4, "Initial attempt to learn the oauth token flow failed", "We learn the jwt session api and solved it", _T, "2024-01-12 09:00:00", "semantic", "zettel", ["auth", "api"], ["api", "auth"], "dev", "dev", None, 0.7, ["q"], ["r"]),
            (5, "Alice met Bob in Paris on monday morning", "Alice causes trouble for Bob every monday evening", _T, "2024-03-01 09:00:00", "episodic", "episodic", ["people"], ["people"], "", "", 0.2, 0.2, ["bob", "alice"], ["alice"]),
            (6, "Rain leads to flooding before winter", "Storms are similar to rain and result in damage during winter", _T, _T, "semantic", "semantic", ["weather"], ["weather", "rain"], "nature", "nature", 0.5, None, ["m", "n"], ["m", "n"]),
            (7, "", "something", None, _T, "working", "working", [], [], None, None, None, None, [], []),
            (8, "then finally complete the deployment of the service", "next begin the deployment of the endpoint service", _T, "2024-01-17 08:59:59", "procedural", "procedural", [], [], "ops", "", 0.1, 0.9, ["a"], []),
            (9, "the parser fix works", "the parser fix was repaired", _T, "2024-01-10 10:00:00", "semantic", "semantic", ["x"], ["y"], "a", "b", 0.3, 0.6, ["a"], ["b"]),
            (10, "cannot open the file", "the task was completed", _T, "2024-01-10 09:59:00", "semantic", "semantic", ["x"], ["x"], "a", "a", 0.3, 0.6, ["a"], ["b"]),
            (11, "bug in the cache index", "patch for the cache index", _T, "2024-01-11 08:00:00", "semantic", "semantic", ["x"], ["x"], "a", "a", 0.3, 0.6, ["a"], ["b"]),
            (12, "system architecture and requirements", "feature requirements of the system", _T, "2024-01-13 08:00:00", "semantic", "semantic", ["x"], ["x"], "a", "a", 0.3, 0.6, ["a"], ["b"]),
        ),
    ),
    # questions for the router
    "asked": Literal(
        "ask_id long, query string",
        (
            (1, "Who created the compiler?"), (2, "why did the build fail"), (3, "What is related to the parser?"), (4, "list all open tasks"), (5, "find notes about rain"), (6, "is the cat a mammal"),
            (7, "the reason for the delay"), (8, "Explain the decision"), (9, "plain words"), (10, "When was it written"), (11, "Count the edges"), (12, "how many nodes exist"), (13, "look for something like it"), (14, ""),
        ),
    ),
    # assertions for the challenger
    "claims": Literal(
        "claim_id long, content string, memory_type string, source string, flag string",
        (
            (1, "Paris is the capital of France", "semantic", None, None), (2, "I think Paris is the best", "semantic", None, None), (3, "maybe it rains", "semantic", None, None), (4, "Is this the end?", "semantic", None, None),
            (5, "The box has 5 sides", "semantic", None, None), (6, "The box has 5 sides", "episodic", None, None), (7, "hello there my friend", "semantic", None, None), (8, "can you open the door please", "semantic", None, None),
            (9, "short text", "semantic", "user_input", None), (10, "some longer words without any pattern", "semantic", "user_input", None), (11, "some longer words without any pattern", "semantic", "library", None), (12, "I think so", "semantic", None, "force_challenge"),
            (13, "Paris is the capital of France", "semantic", None, "skip_challenge"), (14, "Paris is the capital of France", None, None, "trusted_source"), (15, "It equals seven", None, None, None), (16, "She was born in 1960", "semantic", None, None),
            (17, "Water consists of hydrogen and oxygen", "semantic", None, None), (18, "They never sleep", "semantic", None, None), (19, "It is the rule today", "semantic", None, None), (20, "I'm going to the market", "semantic", None, None),
        ),
    ),
    # pairs of facts for the conflict detectors
    "facts": Literal(
        "fact_id long, existing string, fresh string, similarity double, seen_at timestamp_ntz",
        (
            (1, "The sky is blue", "The sky is not blue", 0.95, _T), (2, "The server can't start", "The server can start", 0.9, _T), (3, "Bridge length is 300 metres across the river", "Bridge length is 350 metres across the river", 0.8, _T),
            (4, "Paris is capital of France republic", "Paris is capital of Spain kingdom", 0.7, None), (5, "Ada was born in London town", "Ada was born in London town", 0.99, _T), (6, "It never rains", "It always rains here", 0.76, _T),
            (7, "The report has 3 pages", "Totally other words 4", 0.1, _T), (8, "The ceo of Acme is Jo", "The ceo of Acme Corp is Jo", 0.85, _T), (9, "Prices are low", "Prices are currently high as of May", 0.6, _T), (10, "The claim is false", "The claim is true", 0.97, _T),
            (11, "Nothing works", "Everything works", 0.8, _T), (12, "Cats purr", "Dogs bark now", 0.2, None),
        ),
    ),
    # texts for extractors
    "told_notes": Literal(
        "note_id long, content string",
        (
            (1, "I prefer tabs over spaces in every file. I decided to go with rust for the parser! Therefore the parser will be fast."), (2, "We should always write tests first. This is a very short rule"), (3, "Plain text without any of it."), (4, None), (5, ""),
            (6, "Thought: the cache is cold\nAction: warm the cache up\nObservation: hits went up\nConclusion: keep it warm"), (7, "thinking: one\nthinking: one\nresult: done"), (8, "decision: only one step here that is a little longer than thirty characters"),
            (9, "We used docker and are using kubernetes; skills: python, sql,  graph design"), (10, "John Smith met Mary Ann Jones at Google in New York. Python helped."), (11, "[[Alpha Note|shown]] links [[Beta]] and ((Deep Work)) with #focus #Focus ((Deep Work)) [[Beta]]"),
            (12, "I believe that the moon is made of rock and dust. my favorite editor is a modal one. my favorite editor is a modal one."), (13, "# Title\n\nIntro words here.\n\n## Part\n\nBody of the part with `code # not header` in it.\n\n```\n# comment\ncode\n```\n\nTail."),
            (14, "She wrote the parser and tested it. The house, which is old, was sold. Bob, the builder, left."), (15, "Good great love, bad. Terrible!"),
        ),
    ),
    "models_used": Literal(
        "call_id long, stage string, model string, prompt long, completion long, kind string, reason string",
        (
            (1, "extract", "gpt-4o", 1000, 500, "spent", None), (2, "extract", "gpt-4o-mini-2024-07-18", 2000, 100, "spent", None), (3, "extract", "gpt-4o", 300, 0, "avoided", "cache"), (4, "enrich", "llama-3.1-8b-instant", 10000, 2000, "spent", None),
            (5, "enrich", "unknown-model", 100, 100, "spent", None), (6, "enrich", "gemini-2.0-flash-exp", 500, 500, "avoided", "cache"), (7, "ground", "claude-3-5-haiku", 0, 0, "avoided", "rule"), (8, "ground", None, 10, 20, "spent", None),
        ),
    ),
    # cases around the merging of properties
    "records": Literal(
        "rec_id string, props map<string,string>, seen timestamp_ntz",
        (
            ("a", {"name": "alpha", "size": "1", "tag": "x"}, "2024-01-01 00:00:00"), ("a", {"size": "2", "colour": "red"}, "2024-01-02 00:00:00"), ("a", {"colour": "blue", "tag": "y"}, "2024-01-03 00:00:00"), ("b", {"name": "beta"}, "2024-01-01 00:00:00"), ("c", {}, "2024-01-01 00:00:00"), ("c", {"k": "v"}, "2024-01-05 00:00:00"),
        ),
    ),
    "stamps": Literal("note_id long, stamp string", ((1, "2023-12-01T00:00:00"), (2, "2024-01-30"), (3, "not a date"), (4, None), (5, "2024-01-01 12:30:00"), (6, "2023-02-30"), (7, "2023-11-11T11:11:11"))),
    "vocabulary": Literal("name string, kind string", (("Acme  Inc.", "Company"), ("acme inc.", "organization"), ("ACME Inc.", "business"), ("Ada", "human"), ("Rome", "City"), ("Rome", "place"), ("Zeal", None), ("Thing", "gadget"), (" Ada ", "person"), ("Cats", "concept"), ("cat", "idea"))),
    "samples": Literal("sample_id long, title string, context string, triplets string", ((1, "Rome", "Rome is in Italy.", "<triplet> Rome <subj> Italy <obj> country"), (2, "None", "No triplets here", ""), (3, "Two", "Ada wrote code for Babbage", "<triplet> Ada <subj> code <obj> wrote <triplet> Ada <subj> Babbage <obj> employer"), (4, "Blank", " ", "<triplet> a <subj> b <obj> c"))),
    "knowledge": Literal(
        "value string, line long",
        (
            ('{"qid": "Q1", "label": "Universe", "entity_type": "concept", "confidence": 0.9, "aliases": ["cosmos", "Space", "universe"]}', 0), ('{"qid": "Q2", "label": "Earth", "entity_type": "location", "confidence": 0.8, "aliases": ["world", "space"]}', 1),
            ('{"qid": "Q10", "label": "Spaceflight", "entity_type": "event", "confidence": 0.9, "aliases": ["SPACE"]}', 2), ("{nothing", 3), ('{"qid": "Q3", "label": "Moon", "entity_type": "location", "confidence": 0.95, "aliases": []}', 4),
        ),
    ),
    "sources_py": Literal(
        "path string, source string",
        (
            ("a.py", "import os\nfrom b import helper as h\n\nclass Base:\n    pass\n\nclass Child(Base):\n    def run(self):\n        return h(os.getcwd())\n"), ("b.py", "def helper(x):\n    return len(x)\n"), ("broken.py", "def ("), ("tests/test_b.py", "from b import helper\n\ndef test_helper():\n    assert helper('a')\n"),
        ),
    ),
    "sources_ts": Literal("path string, source string", (("a.ts", "import { x } from './b'\nexport class A extends Base implements I {\n  run() { return go(x) }\n}\nexport function go(y: number) { return y }\n"), ("b.js", "const x = 1\nexport const double = (n) => n * 2\n"), ("c.ts", ""))),
    "snapshots": Literal("proc_id string, tool string, property string, type string, required boolean", (("p1", "search", "query", "string", True), ("p1", "search", "limit", "integer", False), ("p2", "send", "to", "string", True), ("p3", "noop", "x", "string", False))),
    "current_tools": Literal("tool string, property string, type string, required boolean", (("search", "query", "string", True), ("search", "limit", "string", False), ("send", "to", "string", True), ("send", "cc", "string", False), ("noop", "x", "string", False))),
    "plans_made": Literal("plan_id long, steps array<string>, feedback array<string>", ((1, ["a", "b", "c"], ["good", "very BAD"]), (2, ["a", "b", "a"], []), (3, [], ["good"]), (4, [f"s{k}" for k in range(14)], ["good one", "ok"]), (5, ["x"], ["bad"]))),
    "folded": Literal("doc string, id long", (('{"a": 1, "b": {"c": "x", "d": {"e": true}}}', 1), ('{"b": {}, "z": null}', 2), ('{"k": [1, 2], "m": {"n": 0.5}}', 3))),
    "told_pages": Literal("page_id long, html string", (
        (1, '<html><head><title>Plain &amp; simple</title><meta name="description" content="About it"><link rel="canonical" href="https://a.example/c"></head></html>'),
        (2, '<html><head><meta property="og:title" content="OG title"><meta property="og:description" content="OG text"><meta name="twitter:title" content="T"><meta name="author" content="Ada"><script type="application/ld+json">{"@type": "Person", "name": "Ada", "author": {"@type": "Organization", "name": "Acme"}, "publisher": {"name": "Pub"}}</script></head></html>'),
        (3, '<html><head><meta name="twitter:title" content="Tweeted"><meta property="article:published_time" content="2024-01-01"><script type="application/ld+json">{"@type": "Thing", "author": "Bob"}</script></head></html>'),
        (4, "no markup at all"), (5, None),
    )),
    "entity_rows": Literal("item_id long, entity string, entity_type string, props map<string,string>", ((1, "Ada", "person", {"born": "1815"}), (2, "Acme", "org", {}), (3, "Blob", "alien", {"x": "y"}), (4, "Rome", "location", {"country": "IT", "size": "big"}), (5, "Eve", "person", {"born": "soon"}))),
    "relation_rows": Literal("item_id long, relation string", ((1, "works_for"), (2, "eats"), (4, "located_in"))),
    "judged": Literal("session_id long, query string, score int, redundant boolean, latency_ms double", ((1, "a", 3, False, 10.5), (1, "b", 2, True, 20.25), (2, "c", 0, False, 5.0), (3, "d", 1, False, 7.75))),
}
