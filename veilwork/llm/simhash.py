"""SimHash fingerprints of word shingles, linked through BK-trees, and the components of their links.

Fingerprints that differ in at most RADIUS of 64 bits agree on at least KEEP of RADIUS + KEEP equal blocks. Each distinct
fingerprint goes into one bucket for each choice of KEEP blocks, so any two that link meet in a bucket. A bucket is cut
into shards of about SHARD fingerprints; a shard's BK-tree (children keyed by their distance to the parent) goes to the
bucket's queries, shard by shard, and a query follows only edges within the radius of its own distance. A shard task gives
one edge for each fingerprint and component that it joins, not all pairs; edges become components in rounds of taking the
smallest neighbour, on tables in the shared folder. Equal fingerprints are one before any of this, whatever their number.

Defined results: null text counts as empty; a text without words has fingerprint zero and links as any other; the smallest
doc_id names the component, null ids never do unless all ids of a component are null (then it is null); repeated rows are
kept; other columns are not read by `components` and stay in `keep_first`; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.llm.common import cut, forget, lowered, map_arrow, stash, table, utf8

RADIUS, KEEP, SHARD = 4, 2, 2048
SEED = 42
_STEP = 1 << 15


def fingerprint(text: bytes, width: int = 4) -> int:
    """The fingerprint of lower-case UTF-8 text, as a signed number of 64 bits."""
    words = text.split()
    if not words:
        return 0
    k = min(width, len(words))
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    begins = (ends - lengths)[: len(words) - k + 1].tolist()
    stops = ends[k - 1 :].tolist()
    digest, n, ones = xxhash.xxh64_digest, len(begins), np.zeros(64, np.int64)
    for low in range(0, n, _STEP):
        part = b"".join([digest(joined[a:b], SEED) for a, b in zip(begins[low : low + _STEP], stops[low : low + _STEP])])
        bits = np.unpackbits(np.frombuffer(part, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def _prints(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        text = lowered(data).tobytes()
        found = [fingerprint(text[offsets[i] : offsets[i + 1]], width) for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "print"])


def prints(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id and fingerprint (signed) of every document."""
    return map_arrow(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"), lambda b: _prints(b, width), "doc_id long, print long")


class BKTree:
    """Nodes in the order of insertion; children of a node by their distance to it."""

    def __init__(self, values: np.ndarray) -> None:
        """values: distinct, uint64. Built level by level: the first of a group is its node, the others go down by distance."""
        self.values = values
        self.children: list[tuple[int, ...]] = [()] * len(values)  # distance, node, distance, node, ...
        waiting = [np.arange(len(values))] if len(values) else []
        while waiting:
            group = waiting.pop()
            if len(group) == 1:
                continue
            rest = group[1:]
            away = np.bitwise_count(values[rest] ^ values[group[0]])
            order = np.argsort(away, kind="stable")
            rest, away = rest[order], away[order]
            cuts = np.flatnonzero(np.diff(away)) + 1
            edges: list[int] = []
            for part, d in zip(np.split(rest, cuts), away[np.concatenate([[0], cuts])].tolist()):
                edges += (d, int(part[0]))
                waiting.append(part)
            self.children[group[0]] = tuple(edges)

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """For each node that some queries reach: the node, and which of the queries are within the radius of it."""
        going = [(0, np.arange(len(queries)))] if len(self.values) and len(queries) else []
        while going:
            node, own = going.pop()
            away = np.bitwise_count(queries[own] ^ self.values[node]).astype(np.int16)
            near = own[away <= radius]
            if len(near):
                yield node, near
            edges = self.children[node]
            for k in range(0, len(edges), 2):
                follow = own[np.abs(away - edges[k]) <= radius]
                if len(follow):
                    going.append((edges[k + 1], follow))


def _root(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def shard_edges(tree: np.ndarray, queries: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Edges that join what links between the fingerprints of a shard and the queries: from each fingerprint to the
    smallest (as a signed number) of its component here, so a component of n gives n - 1 edges, not all pairs."""
    values = np.concatenate([tree, queries])
    parent = list(range(len(values)))
    for node, near in BKTree(tree).within(queries, radius):
        a = _root(parent, node)
        for q in near.tolist():
            b = _root(parent, len(tree) + q)
            if a != b:
                parent[b] = a
    signed, least, roots = values.view(np.int64).tolist(), {}, [_root(parent, i) for i in range(len(values))]
    for i, r in enumerate(roots):
        least[r] = min(signed[i], least.get(r, signed[i]))
    return list({(signed[i], least[r]) for i, r in enumerate(roots) if signed[i] != least[r]})


def _distance(a: int, b: int) -> int:
    return ((a ^ b) & 0xFFFFFFFFFFFFFFFF).bit_count()


def small_edges(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """The same for a few fingerprints (signed), which are put into one tree one after another."""
    children: list[dict[int, int]] = [{} for _ in values]
    parent = list(range(len(values)))
    for i in range(1, len(values)):
        at, going = 0, [0]
        while (free := _distance(values[at], values[i])) in children[at]:
            at = children[at][free]
        while going:
            node = going.pop()
            away = _distance(values[node], values[i])
            if away <= radius:
                a, b = _root(parent, node), _root(parent, i)
                parent[max(a, b)] = min(a, b)
            going += [c for d, c in children[node].items() if abs(d - away) <= radius]
        children[at][free] = i
    least: dict[int, int] = {}
    roots = [_root(parent, i) for i in range(len(values))]
    for v, r in zip(values, roots, strict=True):
        least[r] = min(v, least.get(r, v))
    return [(v, least[r]) for v, r in zip(values, roots, strict=True) if v != least[r]]


_FEW = 24


def _edges(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Edges of the shards in a partition that is sorted by shard. A shard's rows are bounded, so it is held whole."""
    found: list[tuple[int, int]] = []
    key, tree, queries = None, [], []

    def ended() -> None:
        if key is None or not queries:
            return
        if key[1] == key[2] and len(queries) <= _FEW:
            found.extend(small_edges(queries, radius))
        else:
            whole = np.array(queries, np.int64).view(np.uint64)
            found.extend(shard_edges(whole if key[1] == key[2] else np.array(tree, np.int64).view(np.uint64), whole, radius))

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], ["a", "b"])
        found.clear()
        return batch

    for batch in batches:
        for *own, value, in_tree in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own != key:
                ended()
                key, tree, queries = own, [], []
            (tree if in_tree else queries).append(value)
        if len(found) > 10_000:
            yield out()
    ended()
    yield out()


def bucket_keys(value: Column, n_blocks: int, keep: int) -> Column:
    """A key for each choice of `keep` of the blocks: a hash of the choice and of the bits there. Keys that collide only
    make a bucket larger."""
    border = [64 * i // n_blocks for i in range(n_blocks + 1)]
    masks = [sum(((1 << (border[i + 1] - border[i])) - 1) << border[i] for i in chosen) for chosen in itertools.combinations(range(n_blocks), keep)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.array(*[F.xxhash64(F.lit(k), value.bitwiseAND(F.lit(m))) for k, m in enumerate(signed)])


def links(distinct: DataFrame, shard: int = SHARD, radius: int = RADIUS, keep: int = KEEP) -> DataFrame:
    """Edges (a, b), a > b, that connect the distinct fingerprints in column `print` as their links do. Any `keep` does:
    more of it makes more, smaller buckets."""
    keyed = distinct.select("print", F.explode(bucket_keys(F.col("print"), radius + keep, keep)).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    dealt = keyed.join(sizes, "key").withColumn("parts", F.ceil(F.col("n") / shard).cast("int")).withColumn("part", F.pmod(F.xxhash64("print"), F.col("parts")).cast("int"))
    # one part: a tree that its own fingerprints query; more: part i's tree for the queries of each part j >= i
    places = F.when(F.col("parts") == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(False).alias("in_tree")))).otherwise(
        F.concat(
            F.transform(F.sequence(F.lit(0), F.col("part")), lambda i: F.struct(i.alias("i"), F.col("part").alias("j"), F.lit(False).alias("in_tree"))),
            F.transform(F.filter(F.sequence(F.col("part"), F.col("parts") - 1), lambda j: j > F.col("part")), lambda j: F.struct(F.col("part").alias("i"), j.alias("j"), F.lit(True).alias("in_tree"))),
        )
    )
    shards = dealt.select("key", "print", F.explode(places).alias("p")).select("key", "p.i", "p.j", "print", "p.in_tree")
    placed = shards.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return map_arrow(placed, lambda batches: _edges(batches, radius), "a long, b long").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node reachable from each node of the edges (a, b).

    Each round gives a node, and its label, the smallest label next to it, then takes the label's label. What a round makes
    goes to the shared folder, in place of what the last one made, and is joined from there: one side of each join has each
    key once, so a node of very many edges is split.
    """
    both = stash(edges.union(edges.select("b", "a")).toDF("a", "b"), "edges")
    labels = stash(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("m"))
        seen = labels.join(near, "node", "left").select("node", "root", F.least("root", "m").alias("m"))
        offers = seen.select("node", "m").union(seen.filter("m < root").select(F.col("root").alias("node"), "m"))
        hooked = stash(offers.groupBy("node").agg(F.min("m").alias("up")), "hooked")
        jump = hooked.select(F.col("node").alias("up"), F.col("up").alias("above"))
        after = stash(hooked.join(jump, "up", "left").join(labels, "node").select("node", F.coalesce("above", "up").alias("root"), F.col("root").alias("old")), "labels")
        changed = after.filter("root != old").limit(1).count()
        for old in (labels, hooked):
            forget(old)
        labels = after.select("node", "root")
        if not changed:
            forget(both)
            return labels


def named(rows: DataFrame, firsts: DataFrame, roots: DataFrame) -> DataFrame:
    """rows, which have doc_id and print, with component_id: the smallest id of the prints that share a root.

    Names and prints are read from the shared folder, each key once on one side of its join, so a component or a print of
    very many rows is split.
    """
    rooted = stash(firsts.select("print", "first").join(roots.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print")), "rooted")
    names = stash(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "names")
    own = stash(rooted.join(names, "root").select("print", "component_id"), "named")
    return rows.select("doc_id", "print").join(own, "print").select("doc_id", "print", "component_id")


def components(docs: DataFrame, width: int = 4, radius: int = RADIUS, keep: int = KEEP) -> DataFrame:
    """doc_id, print, component_id of every document."""
    rows = stash(prints(docs, width), "prints")
    firsts = stash(rows.groupBy("print").agg(F.min("doc_id").alias("first")), "firsts")
    return named(rows, firsts, connected(links(firsts.select("print"), radius=radius, keep=keep)))


def keep_first(docs: DataFrame, width: int = 4, radius: int = RADIUS, keep: int = KEEP) -> DataFrame:
    """The rows of docs, with their columns, whose id names their component. Rows that repeat an id stay or go together,
    unless their texts are of different components; rows without an id stay."""
    found = components(docs, width, radius, keep).filter("doc_id is not null")
    gone = found.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("kept")).filter("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
