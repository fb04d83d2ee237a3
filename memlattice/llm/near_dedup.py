"""Near-duplicate documents by a chosen-path similarity join over minwise tokens, confirmed on full shingle sets."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Scratch, binaries, broadcast_if_small, hash_batch, hash_words, mix, shingle_hashes
from .components import components

#: Minwise tokens of a document; paths choose among them.
TOKENS = 64
#: Bins of the one-permutation sketch that nodes are compared by: one byte each, 0 for an empty bin.
BINS = 512
#: In the second round a node with more pairs than this for each document is confirmed as a whole instead.
DENSE = 4
_SEEDS = mix(np.arange(1, TOKENS + 1, dtype=np.uint64)) | np.uint64(1)
#: Nodes of more documents branch further.
NODE = 2048
#: Levels of branching below the first; larger nodes left then are compared block by block, each block with each.
DEPTH = 5
#: Levels that documents of large nodes branch on at once, before nodes are counted again.
STRIDE = 3
#: How far below the threshold a sketch may lie: four standard deviations of it at 0.8, so 3 in 100,000 pairs there are lost.
SLACK = 0.07
#: Times that a large node's documents are linked to one of them, and the documents that stand for a node in choosing it.
STARS, SAMPLE = 2, 256
#: Best partners that a document names in a node in the first round; the second round takes the rest.
PARTNERS = 4


def trees_for(threshold: float, recall: float, depth: int = 2) -> int:
    """Trees needed to find a pair at the threshold with this probability, when it is separated from others `depth` levels down.

    Levels choose 1 / threshold tokens in the mean, so a pair at the threshold keeps one child in the mean.
    """
    alive = 1.0
    for _ in range(depth):
        alive = 1 - math.exp(-alive)
    return math.ceil(math.log(1 - recall) / math.log(1 - alive))


def _chosen(node: np.ndarray, level: int, threshold: float) -> np.ndarray:
    """nodes x TOKENS: which tokens these nodes branch by, each with probability 1 / (threshold * TOKENS), from the node alone."""
    coin = mix(node[:, None] ^ mix(np.arange(TOKENS, dtype=np.uint64) + np.uint64(1000 * (level + 1)))[None, :])
    return coin < np.uint64(2**64 / (threshold * TOKENS))


def _children(node: np.ndarray, token: np.ndarray, value: np.ndarray) -> np.ndarray:
    return mix(node ^ mix(value + (token.astype(np.uint64) << np.uint64(40))))


def _minwise(shingles: np.ndarray) -> np.ndarray:
    out = np.full(TOKENS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        out = np.minimum(out, (shingles[at : at + 4096, None] * _SEEDS[None, :]).min(axis=0))
    return (out >> np.uint64(32)).astype(np.uint32)


def _binned(shingles: np.ndarray) -> np.ndarray:
    """The least shingle of each bin as a byte from 1 to 255; sorted shingles hold the bins in order."""
    bins = (shingles >> np.uint64(55)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    out = np.zeros(BINS, np.uint8)
    out[bins[first]] = shingles[first] % np.uint64(255) + np.uint64(1)
    return out


_SKETCH = "doc_id long, n_shingles long, h1 long, h2 long, tokens binary, sketch binary"


def _sketcher(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = binaries(batch.column("text")), batch.column("doc_id")
            n, h1, h2, tokens, sketch = [], [], [], [], []
            for at, end, words, bounds in hash_batch(texts):
                for k in range(end - at):
                    s = shingle_hashes(words[bounds[k] : bounds[k + 1]], width)
                    n.append(len(s))
                    h1.append(int(s.sum(dtype=np.uint64)) if len(s) else 0)
                    h2.append(int(np.bitwise_xor.reduce(mix(s))) if len(s) else 0)
                    tokens.append(_minwise(s).tobytes() if len(s) else b"")
                    sketch.append(_binned(s).tobytes() if len(s) else b"")
            signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(n, pa.int64()), signed(h1), signed(h2), pa.array(tokens, pa.binary()), pa.array(sketch, pa.binary())], names=["doc_id", "n_shingles", "h1", "h2", "tokens", "sketch"])

    return run


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _first_level(trees: int, threshold: float, first: int = 0, levels: int = 1) -> Callable:
    """Rows of documents to rows of their nodes, `levels` down, of so many trees from the first on."""
    roots = mix(np.arange(first, first + trees, dtype=np.uint64) + np.uint64(77))
    tree, token = np.nonzero(_chosen(roots, 0, threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                values = _matrix(batch.column("tokens"), np.uint32).astype(np.uint64)
                nodes = _children(roots[tree][None, :], token[None, :], values[:, token]).ravel()
                yield _branched(batch, np.repeat(np.arange(batch.num_rows), len(token)), nodes, values, 1, levels - 1, threshold)

    return run


#: Documents that branch at once.
_ROWS = 2048


def _branched(batch: pa.RecordBatch, row: np.ndarray, node: np.ndarray, values: np.ndarray, level: int, levels: int, threshold: float) -> pa.RecordBatch:
    for k in range(level, level + levels):
        of, token = np.nonzero(_chosen(node, k, threshold))
        row = row[of]
        node = _children(node[of], token, values[row, token])
    return pa.RecordBatch.from_arrays([pa.array(batch.column("rep").to_numpy()[row]), pa.array(node.view(np.int64))], names=["rep", "node"])


def _next_level(level: int, threshold: float, levels: int = 1) -> Callable:
    """Rows of nodes with their documents' tokens to rows of the nodes `levels` further down."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 8 * _ROWS):
                batch = whole.slice(at, 8 * _ROWS)
                values = _matrix(batch.column("tokens"), np.uint32).astype(np.uint64)
                yield _branched(batch, np.arange(batch.num_rows), batch.column("node").to_numpy().view(np.uint64), values, level, levels, threshold)

    return run


def _split(nodes: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """Nodes of 2 to NODE documents as (node, reps), and rows (node, rep) of larger ones.

    The names of large nodes are fewer by NODE than the rows; once their rows are set aside, no node fills a task.
    """
    rows = scratch.save(nodes, f"{name}-rows")
    names = scratch.save(rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > NODE).select("node"), f"{name}-names")
    crowded = broadcast_if_small(names)
    large = scratch.save(rows.join(crowded, "node", "left_semi"), f"{name}-large")
    packed = rows.join(crowded, "node", "left_anti").groupBy("node").agg(F.collect_list("rep").alias("reps")).filter(F.size("reps") > 1)
    small = scratch.save(packed, f"{name}-small")
    scratch.drop(f"{name}-rows", f"{name}-names")
    return small, large


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """rows (node, rep) with the label of the component that each document is known to be in: itself, if none."""
    if labels is None:
        return rows.select("node", "rep", F.col("rep").alias("label"))
    return rows.select("node", "rep").join(broadcast_if_small(labels), "rep", "left").select("node", "rep", F.coalesce("label", "rep").alias("label"))


def _census(rows: DataFrame) -> DataFrame:
    """(node, outside, top): nodes with several labels, their commonest one, and how many documents have another."""
    sizes = rows.groupBy("node", "label").agg(F.count(F.lit(1)).alias("k"))
    nodes = sizes.groupBy("node").agg(F.sum("k").alias("n"), F.max(F.struct("k", "label")).alias("most"))
    return nodes.select("node", (F.col("n") - F.col("most.k")).alias("outside"), F.col("most.label").alias("top")).filter("outside > 0")


def _common_sketch(rows: pa.Table) -> pa.Table:
    """What most of a node's sketches hold in each bin."""
    sketch = _matrix(rows.column("sketch").combine_chunks(), np.uint8)
    common = np.array([np.bincount(column).argmax() for column in sketch.T], np.uint8)
    return pa.table({"node": rows.column("node").slice(0, 1), "common": pa.array([common.tobytes()], pa.binary())})


def _agreement(name_a: str, name_b: str, keep: tuple[str, ...]) -> Callable:
    """Rows with two sketches to the columns to keep and the estimated similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (_matrix(batch.column(k), np.uint8) for k in (name_a, name_b))
                same, either = ((a == b) & (a > 0)).sum(axis=1), ((a > 0) | (b > 0)).sum(axis=1)
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(same / np.maximum(1, either))], names=[*keep, "similarity"])

    return run


def _star_pairs(large: DataFrame, labels: DataFrame | None, sketches: DataFrame, least: float, scratch: Scratch, name: str) -> DataFrame:
    """Pairs a < b of a large node's documents with the one that is nearest to what most of its sketches hold.

    Documents of the node's commonest label take no part, once there are labels.  In a crowd of near copies that one is
    the original, or near all others; linked to it, they need no comparison with each other.
    """
    rows = _labelled(large, labels)
    if labels is not None:
        rows = rows.join(broadcast_if_small(scratch.save(_census(rows), f"{name}-census")), "node").filter("label <> top")
    rows = scratch.save(rows.select("node", "rep").join(sketches, "rep"), f"{name}-members")
    nth = F.row_number().over(W.partitionBy("node").orderBy(F.xxhash64("rep"), "rep"))
    common = rows.withColumn("nth", nth).filter(F.col("nth") <= SAMPLE).groupBy("node").applyInArrow(_common_sketch, "node long, common binary")
    common = broadcast_if_small(scratch.save(common, f"{name}-common"), BROADCAST_ROWS // 16)
    nearness = rows.join(common, "node").mapInArrow(_agreement("sketch", "common", ("node", "rep")), "node long, rep long, similarity double")
    centre = nearness.groupBy("node").agg(F.max(F.struct("similarity", (-F.col("rep")).alias("least"))).alias("best")).select("node", (-F.col("best.least")).alias("centre"))
    centre = scratch.save(centre, f"{name}-centres")
    of_centre = sketches.select(F.col("rep").alias("centre"), F.col("sketch").alias("of_centre"))
    known = scratch.save(of_centre.join(broadcast_if_small(centre.select("centre").distinct()), "centre", "left_semi"), f"{name}-centre-sketches")
    pairs = rows.join(broadcast_if_small(centre), "node").filter("rep <> centre").select("centre", "rep", "sketch").dropDuplicates(["centre", "rep"])
    pairs = pairs.join(broadcast_if_small(known, BROADCAST_ROWS // 16), "centre").mapInArrow(_agreement("sketch", "of_centre", ("centre", "rep")), "centre long, rep long, similarity double")
    return scratch.save(pairs.filter(F.col("similarity") >= least).select(F.least("centre", "rep").alias("a"), F.greatest("centre", "rep").alias("b")).distinct(), f"{name}-pairs")


def _similar(sketch: np.ndarray) -> np.ndarray:
    """Estimated similarity of all rows with all, in strips."""
    full = sketch > 0
    size = full.sum(axis=1)
    out = np.empty((len(sketch), len(sketch)), np.float32)
    strip = max(1, (1 << 22) // sketch.size)
    for at in range(0, len(sketch), strip):
        same = ((sketch[at : at + strip, None, :] == sketch[None, :, :]) & full[at : at + strip, None, :]).sum(axis=2)
        both = (full[at : at + strip].astype(np.float32) @ full.T.astype(np.float32))
        out[at : at + strip] = same / np.maximum(1, size[at : at + strip, None] + size[None, :] - both)
    return out


def _comparer(least: float, partners: int | None) -> Callable:
    """Sorted members of small nodes to pairs a < b whose sketches reach `least` and whose labels differ.

    With partners, a document names that many best ones at most and `more` says that it had others.
    Without, all pairs are named but for those which the round with PARTNERS names (none in nodes that only this round
    has, for which partners is 0); if they are more than DENSE for each document, the documents are named instead, as
    (node, document, more).
    """

    def compare(name: int, node: list[tuple]) -> Iterator[tuple[int, int, bool]]:
        label = np.array([x[2] for x in node])
        if (label == label[0]).all():
            return
        rep = np.array([x[0] for x in node])
        sketch = np.frombuffer(b"".join(x[1] for x in node), np.uint8).reshape(len(node), -1)
        near = _similar(sketch)
        np.fill_diagonal(near, -1)
        near[near < least] = -1
        best = np.zeros(near.shape, bool)
        k = min(PARTNERS, len(node) - 1)
        order = np.argsort(-near, axis=1, kind="stable")[:, :k]
        np.put_along_axis(best, order, True, axis=1)
        best &= near >= 0
        if not partners:
            if partners == 0:
                best[:] = False
            chosen = (near >= 0) & ~(best | best.T) & (label[:, None] != label[None, :])
            more = np.zeros(len(node), bool)
        else:
            chosen, more = (best | best.T) & (label[:, None] != label[None, :]), (near >= 0).sum(axis=1) > k
        a, b = np.nonzero(np.triu(chosen, 1))
        if not partners and len(a) > DENSE * len(node):
            yield from ((name, rep[x], True) for x in np.union1d(a, b))
            return
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            if rep[x] != rep[y]:
                yield min(rep[x], rep[y]), max(rep[x], rep[y]), more[x] | more[y]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        held_node = None
        out: list[tuple] = []

        def flush(force: bool) -> Iterator[pa.RecordBatch]:
            if out and (force or len(out) > 50_000):
                a, b, more = zip(*out, strict=True)
                out.clear()
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([bool(x) for x in more])], names=["a", "b", "more"])

        for batch in batches:
            rows = zip(batch.column("node").to_pylist(), batch.column("rep").to_pylist(), batch.column("sketch").to_pylist(), batch.column("label").to_pylist(), strict=True)
            for node, *member in rows:
                if node != held_node and held:
                    out.extend(compare(held_node, held) if len(held) > 1 else ())
                    held = []
                    yield from flush(False)
                held_node = node
                held.append(tuple(member))
        if len(held) > 1:
            out.extend(compare(held_node, held))
        yield from flush(True)

    return run


def _compare(members: DataFrame, sketches: DataFrame, least: float, partners: int | None, parts: int) -> DataFrame:
    rows = members.join(sketches, "rep").select("node", "rep", "sketch", "label")
    rows = rows.repartition(parts, "node").sortWithinPartitions("node", "rep")
    pairs = rows.mapInArrow(_comparer(least, partners), "a long, b long, more boolean")
    return pairs.groupBy("a", "b").agg(F.max("more").alias("more"))


def _block_pairs(large: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, rep, label) for all pairs of blocks of the large nodes(node, rep), but for those of one label alone.

    A label with more than half a NODE of a node's members has blocks of its own; the other labels are dealt whole.
    Every two members whose labels differ meet in a block or in a pair of blocks.
    """
    half = max(1, NODE // 2)
    rows = scratch.save(_labelled(large.distinct(), labels), "large-labelled")
    sizes = rows.groupBy("node", "label").agg(F.count(F.lit(1)).alias("k"))
    nodes = sizes.groupBy("node").agg(F.count(F.lit(1)).alias("n_labels"), F.sum(F.when(F.col("k") <= half, F.col("k"))).alias("n_few")).filter("n_labels > 1")
    alone = F.col("k") > half
    sizes, nodes = (broadcast_if_small(scratch.save(x, f"large-{k}")) for k, x in (("sizes", sizes), ("nodes", nodes)))
    dealt = rows.join(sizes, ["node", "label"]).join(nodes, "node").select(
        "node",
        "rep",
        "label",
        F.when(alone, F.col("label")).alias("whole"),
        F.when(alone, F.pmod(F.xxhash64("rep"), F.ceil(F.col("k") / half))).otherwise(F.pmod(F.xxhash64("label"), F.ceil(F.col("n_few") / half))).alias("part"),
    )
    dealt = scratch.save(dealt.withColumn("block", F.xxhash64("node", "whole", "part")), "large-blocks")
    blocks = scratch.save(dealt.select("node", "block", "whole").distinct(), "large-names")
    side = lambda x: blocks.select("node", F.col("block").alias(f"b{x}"), F.col("whole").alias(f"w{x}"))
    pairs = side(1).join(side(2), "node").filter("b1 <= b2 and (w1 is null or w2 is null or w1 <> w2)")
    named = pairs.select("node", F.xxhash64("node", "b1", "b2").alias("pair"), F.explode(F.array_distinct(F.array("b1", "b2"))).alias("block"))
    return scratch.save(dealt.join(named, ["node", "block"]).select(F.col("pair").alias("node"), "rep", "label"), "large-pairs")


def _confirmer(width: int, threshold: float) -> Callable:
    top, bottom = round(threshold * 100), 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(binaries(batch.column("text_a")), binaries(batch.column("text_b")), strict=True):
                a, b = (shingle_hashes(hash_words(x), width) for x in (left, right))
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(bottom * both >= top * (len(a) + len(b) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _whole_nodes(width: int, threshold: float) -> Callable:
    """Sorted members of dense nodes, with texts and labels, to confirmed links: enough of them to join what is linked."""
    top = round(threshold * 100)

    def links(reps: list[int], labels: list[int], texts: list[bytes]) -> Iterator[tuple[int, int]]:
        sets = [shingle_hashes(hash_words(x), width) for x in texts]
        near = _similar(np.array([_binned(s) for s in sets])) >= threshold - SLACK
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                x = up
            return x

        for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(near, 1))), strict=True):
            x, y = root(labels[i]), root(labels[j])
            if x != y:
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * both >= top * (len(sets[i]) + len(sets[j]) - both):
                    parent[max(x, y)] = min(x, y)
                    yield reps[i], reps[j]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        held: list[tuple] = []
        held_node = None
        for batch in batches:
            for node, *member in zip(batch.column("node").to_pylist(), batch.column("rep").to_pylist(), batch.column("label").to_pylist(), binaries(batch.column("text")), strict=True):
                if node != held_node and held:
                    found.extend(links(*map(list, zip(*held, strict=True))))
                    held = []
                held_node = node
                held.append(member)
        if held:
            found.extend(links(*map(list, zip(*held, strict=True))))
        pairs = np.array(found, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(pairs.min(axis=1)) if len(pairs) else pa.array([], pa.int64()), pa.array(pairs.max(axis=1)) if len(pairs) else pa.array([], pa.int64())], names=["a", "b"])

    return run


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, frames)


def _as_labels(found: DataFrame) -> DataFrame:
    return found.select(F.col("id").alias("rep"), F.col("component").alias("label"))


def _texts(ids: DataFrame, docs: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(doc_id, text) of ids(doc_id); the texts are shuffled only if there are too many ids to broadcast."""
    named = broadcast_if_small(scratch.save(ids.distinct(), f"{name}-ids"))
    return scratch.save(docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(named, "doc_id", "left_semi"), f"{name}-texts")


def _confirm(pairs: DataFrame, docs: DataFrame, width: int, threshold: float, scratch: Scratch, name: str) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    texts = _texts(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")), docs, scratch, name)
    side = lambda k: texts.select(F.col("doc_id").alias(k), F.col("text").alias(f"text_{k}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    out = scratch.save(both.mapInArrow(_confirmer(width, threshold), "a long, b long"), name)
    scratch.drop(f"{name}-texts")
    return out


def near_duplicates(docs: DataFrame, width: int = 5, threshold: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept.

    Documents are linked where the Jaccard similarity of their distinct shingles of `width` words (A-Z lower-cased) is
    the threshold or more.  component_id is the smallest doc_id that is reachable, kept that of the document itself.

    Documents with equal sets become one vertex.  In each of a number of independent trees, a document follows random
    choices among its minwise tokens; those in the same node share them.  Nodes of up to NODE documents are compared
    exhaustively by sketches.  The documents of nodes that are larger after two levels are first linked to a centre of
    the node, which makes one component of most crowds; nodes that still have over NODE documents outside their largest
    component branch on in more trees, as many as the recall takes at DEPTH further levels.  Pairs whose sketches come
    near the threshold are confirmed on full sets.

    A first round confirms each document's best partners in a node; a second one the other pairs across the components
    then known, in the same nodes and, block by block, in the whole of the large ones.  Its work there is the number of
    a node's documents times that of those outside its largest component.  Nodes that are dense with such pairs are
    confirmed as wholes, and name no more links than join their documents.

    Texts without words, and null ones, have 0 shingles and no links; fewer words than `width` make one shingle.  A
    row with null doc_id can't be named: it has no links, a null component, and is kept.  Rows that repeat a doc_id
    are one vertex, linked where any of them is.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketched = scratch.save(docs.select("doc_id", "text").mapInArrow(_sketcher(width), _SKETCH), "sketched")
    same = ["h1", "h2", "n_shingles"]
    filled = sketched.filter("n_shingles > 0 and doc_id is not null")
    reps = filled.groupBy(*same).agg(F.min(F.struct("doc_id", "tokens", "sketch")).alias("m"), F.count(F.lit(1)).alias("copies"))
    vertices = scratch.save(reps.select(*same, F.col("m.doc_id").alias("rep"), "m.tokens", "m.sketch", "copies"), "vertices")
    reps = vertices.select(*same, "rep", "copies")
    sketches = vertices.select("rep", "sketch")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    # either phase may miss half of what the recall allows
    each = 1 - (1 - recall) / 2

    least = threshold - SLACK
    labels, stars, left = None, [], []

    def sort_out(large: DataFrame, name: str) -> DataFrame:
        """Rows of the large nodes that must branch on; those with few documents outside one component are left as they are."""
        rows = _labelled(large, labels)
        census = scratch.save(_census(rows), f"{name}-census")
        few, many = (broadcast_if_small(census.filter(x).select("node")) for x in (F.col("outside") <= NODE, F.col("outside") > NODE))
        left.append(large.join(few, "node", "left_semi"))
        return scratch.save(large.join(many, "node", "left_semi"), f"{name}-many")

    def branch(docs: DataFrame, trees: int, first: int, depth: int, name: str, stride: int) -> tuple[list[DataFrame], DataFrame]:
        """Nodes of up to NODE documents, and those still larger `depth` levels below the first; counted every `stride` levels."""
        level = min(stride - 1, depth)
        part, large = _split(docs.select("rep", "tokens").mapInArrow(_first_level(trees, threshold, first, level + 1), "rep long, node long"), scratch, f"{name}-{level}")
        small = [part]
        while level < depth and not large.isEmpty():
            if stride > 1:
                large = sort_out(large, f"{name}-{level}")
            more = min(stride, depth - level)
            rows = large.join(docs.select("rep", "tokens"), "rep").select("rep", "node", "tokens")
            part, large = _split(rows.mapInArrow(_next_level(level + 1, threshold, more), "rep long, node long"), scratch, f"{name}-{level + more}")
            small.append(part)
            level += more
        return small, large

    trees = trees_for(threshold, each)
    small, large = branch(vertices, trees, 0, min(1, DEPTH), "level", 1)
    # a pair that two levels don't separate in any tree is in a large node there with both its documents
    if not large.isEmpty():
        for k in range(STARS):
            pairs = _star_pairs(large, labels, sketches, least, scratch, f"star-{k}")
            if not pairs.isEmpty():
                stars.append(_confirm(pairs, docs, width, threshold, scratch, f"links-star-{k}"))
                labels = scratch.save(_as_labels(components(_union(stars), scratch, f"cc-star-{k}")), f"labels-star-{k}")
            large = sort_out(large, f"sift-{k}")
            if large.isEmpty():
                break
        else:
            hot = scratch.save(vertices.join(large.select("rep").distinct(), "rep", "left_semi"), "hot")
            more, large = branch(hot, trees_for(threshold, each, DEPTH + 1), trees, DEPTH, "hot-level", STRIDE)
            small += more
            left.append(large)
    nodes = _union(small).select("node", F.explode("reps").alias("rep"), F.size("reps").alias("n"))
    crowded = scratch.save(_union(left), "crowded") if left else None
    deep = crowded is not None and not crowded.isEmpty()

    first = scratch.save(_compare(_labelled(nodes, labels), sketches, least, PARTNERS, parts), "pairs-1")
    links = _union([*stars, _confirm(first, docs, width, threshold, scratch, "links-1")])
    found = scratch.save(components(links, scratch, "cc-1"), "found-1")
    if deep or not first.filter("more").isEmpty():
        labels = _as_labels(found)
        second = _compare(_labelled(nodes.filter(F.col("n") > PARTNERS + 1), labels), sketches, least, None, parts)
        if deep:
            whole = _compare(_block_pairs(crowded, labels, scratch), sketches, least, 0, parts)
            second = second.union(whole).groupBy("a", "b").agg(F.max("more").alias("more"))
        second = scratch.save(second, "pairs-2")
        if not second.isEmpty():
            pairs = second.filter(~F.col("more")).join(first, ["a", "b"], "left_anti")
            links = links.union(_confirm(pairs, docs, width, threshold, scratch, "links-2"))
            dense = second.filter("more").select(F.col("a").alias("node"), F.col("b").alias("rep"))
            if not dense.isEmpty():
                texts = _texts(dense.select(F.col("rep").alias("doc_id")), docs, scratch, "dense").withColumnRenamed("doc_id", "rep")
                rows = dense.join(texts.join(labels, "rep", "left"), "rep").select("node", "rep", F.coalesce("label", "rep").alias("label"), "text")
                whole = rows.repartition(parts, "node").sortWithinPartitions("node", "rep").mapInArrow(_whole_nodes(width, threshold), "a long, b long")
                links = links.union(scratch.save(whole, "links-dense"))
            found = scratch.save(components(links, scratch, "cc-2"), "found-2")

    # a document alone in its class and component is its own; only the others are looked up, by the class they are in
    named = reps.join(found.withColumnRenamed("id", "rep"), "rep", "left").select(*same, "rep", "copies", F.coalesce("component", "rep").alias("component_id"))
    named = broadcast_if_small(scratch.save(named.filter("copies > 1 or component_id <> rep").select(*same, "component_id"), "named"))
    scratch.keep_only("sketched", "named")
    out = sketched.select("doc_id", *same).join(named, same, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4)


OP5_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS words FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
      ELSE list_transform(range(1, len(words) - 2), lambda k: array_to_string(words[k:k+3], ' ')) END) AS s FROM docs)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT x.a, x.b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS both FROM shingles p JOIN shingles q ON p.s = q.s AND p.doc_id <> q.doc_id GROUP BY 1, 2) x
  JOIN sizes m ON m.doc_id = x.a JOIN sizes n ON n.doc_id = x.b WHERE 100 * x.both >= 80 * (m.n + n.n - x.both)
), reach AS (
  SELECT a AS doc_id, a AS seen FROM links
  UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.seen
), least AS (SELECT doc_id, min(seen) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, coalesce(least(l.component_id, d.doc_id), d.doc_id) AS component_id, coalesce(least(l.component_id, d.doc_id), d.doc_id) = d.doc_id AS kept
FROM docs d LEFT JOIN sizes z USING (doc_id) LEFT JOIN least l USING (doc_id)
"""
