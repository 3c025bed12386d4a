"""SimHash near-duplicates through vantage-point trees.

Equal fingerprints are one point.  A small tree over a sample of the points cuts the
Hamming space into shards; a point goes to every shard whose region comes within half the
radius of it, which the triangle bound of each vantage point decides.  Two points within
the radius have a point halfway between them, so some shard holds both: nothing is lost,
whatever the sample.  In a shard the same cuts go on until blocks are small enough to
compare.  Components of the links are found by repeated star contraction of narrow tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from edgeframe.llm.common import map_rows
from edgeframe.session import written

SEED = 42           # of XXH64
SAMPLE = 20_000     # points the tree of shards is built from, at most
SHARD = 20_000      # points a shard should have
BLOCK = 192         # points that are compared pair by pair
DENSE = 4_096       # points that no cut divides: from here on by shared neighbours
BITS = np.arange(64, dtype=np.uint64)


# --- fingerprints

def fingerprint(text: str | None, width: int = 3) -> int:
    """A bit is 1 if it is set in over half of the hashes of all shingles of ``width``
    words; 0 without words."""
    parts = text.encode().lower().split() if text else []   # bytes: A-Z and ASCII blanks only
    if not parts:
        return 0
    whole = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts])
    n = max(1, len(parts) - width + 1)
    begin = [0, *(ends[:n - 1].tolist())]
    end = (ends[min(width, len(parts)) - 1:] - 1).tolist()
    of = xxhash.xxh64_intdigest
    return majority(np.fromiter((of(whole[a:b], SEED) for a, b in zip(begin, end)), np.uint64, n))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of ``hashes`` have."""
    n = len(hashes)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 8192):
        bits = np.unpackbits(hashes[at:at + 8192].view(np.uint8), bitorder="little")
        ones += bits.reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.bitwise_or.reduce(np.where(2 * ones > n, np.uint64(1) << BITS, np.uint64(0))))


def fingerprints(docs: DataFrame, *, text: str = "text", id: str = "doc_id",
                 width: int = 3) -> DataFrame:
    """id and fp (64 bits in a long) of every whole text; 0 for texts without words."""
    kept = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("t"))

    def make():
        def of(ids: list, texts: list) -> dict:
            fps = np.array([fingerprint(t, width) for t in texts], np.uint64)
            return {"id": ids, "fp": fps.view(np.int64)}
        return of

    return map_rows(kept, make, f"id {docs.schema[id].dataType.simpleString()}, fp bigint")


# --- vantage-point trees over arrays of fingerprints

def apart(points: np.ndarray, other) -> np.ndarray:
    return np.bitwise_count(points ^ np.uint64(other))


def cut(points: np.ndarray, reach: int, tries: int = 6):
    """A vantage point and a distance that divide ``points`` best, with both sides: a
    point is near if its distance is at most ``mu + reach``, far if it is over
    ``mu - reach``.  None if either side keeps over 9 in 10 points."""
    best = None
    step = max(1, len(points) // tries)
    for v in points[::step][:tries]:
        d = apart(points, v)
        counts = np.bincount(d, minlength=66)
        upto = np.cumsum(counts)
        near = upto[np.minimum(np.arange(65) + reach, 65)]
        far = len(points) - np.concatenate([np.zeros(reach, int), upto])[:65][:65] \
            if reach else len(points) - upto[:65]
        worst = np.maximum(near, far)
        mu = int(np.argmin(worst))
        if best is None or worst[mu] < best[0]:
            best = (int(worst[mu]), int(v), mu)
    if best is None or best[0] > 0.9 * len(points):
        return None
    d = apart(points, best[1])
    return best[1], best[2], d <= best[2] + reach, d > best[2] - reach


def build(sample: np.ndarray, leaf: int, reach: int = 1) -> list[tuple]:
    """Nodes (vantage point, mu, near node, far node); a shard is (-1 - its number)."""
    nodes: list = []
    shards = [0]

    def grow(points: np.ndarray) -> int:
        made = cut(points, reach) if len(points) > leaf else None
        if made is None:
            shards[0] += 1
            return -shards[0]
        at = len(nodes)
        nodes.append(None)
        v, mu, near, far = made
        nodes[at] = (v, mu, grow(points[near]), grow(points[far]))
        return at

    grow(sample)
    return nodes


def route(nodes: list[tuple], points: np.ndarray, reach: int = 1) -> Iterator[tuple]:
    """(shard, positions of the points that touch it)."""
    if not nodes:
        yield 0, np.arange(len(points))
        return
    todo = [(0, np.arange(len(points)))]
    while todo:
        at, who = todo.pop()
        if at < 0:
            yield -1 - at, who
        elif len(who):
            v, mu, near, far = nodes[at]
            d = apart(points[who], v)
            todo.append((near, who[d <= mu + reach]))
            todo.append((far, who[d > mu - reach]))


def links(points: np.ndarray, radius: int = 2) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (a, b) of arrays of different points within ``radius`` that connect whatever
    all pairs within it connect.  ``points`` are different from each other."""
    reach = (radius + 1) // 2
    todo = [points]
    while todo:
        p = todo.pop()
        if len(p) < 2:
            continue
        made = cut(p, reach) if len(p) > BLOCK else None
        if made is not None:
            todo += [p[made[2]], p[made[3]]]
        elif len(p) < DENSE:
            for at in range(0, len(p), 1024):
                d = np.bitwise_count(p[at:at + 1024, None] ^ p[None, :])
                a, b = np.nonzero(d <= radius)
                later = a + at < b
                yield p[a[later] + at], p[b[later]]
        else:
            yield from by_neighbours(p, radius)


def by_neighbours(p: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For points that lie too close for cuts: two of them are within 2 exactly if they
    share a value that differs from each in one bit or none.  Cost grows with the number
    of points, not of pairs.  Values are handled in parts, so memory stays small."""
    if radius != 2:
        raise ValueError("dense blocks are solved for radius 2")
    parts = max(1, len(p) // 20_000)
    masks = [np.uint64(0), *(np.uint64(1) << BITS)]
    mix = np.uint64(0x9E3779B97F4A7C15)
    for part in range(parts):
        keys, who = [], []
        for m in masks:
            k = p ^ m
            mine = ((k * mix) >> np.uint64(40)) % np.uint64(parts) == np.uint64(part)
            keys.append(k[mine])
            who.append(p[mine])
        k, w = np.concatenate(keys), np.concatenate(who)
        order = np.argsort(k, kind="stable")
        k, w = k[order], w[order]
        same = k[1:] == k[:-1]
        yield w[:-1][same], w[1:][same]


def forest(points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a shard thinned out to a star per component: (point, least point)."""
    order = np.sort(points)
    parent = np.arange(len(order))

    def roots(x: np.ndarray) -> np.ndarray:
        while True:
            up = parent[x]
            if (up == x).all():
                return x
            x = parent[up]

    for a, b in links(points, radius):
        a, b = np.searchsorted(order, a), np.searchsorted(order, b)
        while True:
            a, b = roots(a), roots(b)
            differ = a != b
            if not differ.any():
                break
            a, b = a[differ], b[differ]
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
    top = roots(np.arange(len(order)))
    linked = top != np.arange(len(order))
    return order[linked], order[top[linked]]


# --- on tables

def shard_links(points: DataFrame, radius: int = 2, shard: int = SHARD) -> DataFrame:
    """Links (a, b) between different values of ``points.fp`` that connect what all pairs
    within ``radius`` connect.  ``points`` is a stored table of different values.

    A shard with over twice ``shard`` points, by count, is dealt out in blocks: every pair
    of its blocks is a task of its own, so no task grows with a crowded region.
    """
    spark, reach = points.sparkSession, (radius + 1) // 2
    n = points.count()
    shard = min(shard, max(BLOCK, n // (2 * spread(points))))
    share = min(1.0, 0.8 * SAMPLE / max(n, 1))
    chosen = points.select("fp").where(
        F.abs(F.xxhash64("fp", F.lit(1)) % 1_000_000) < int(share * 1_000_000)).limit(SAMPLE)
    sample = np.array(sorted(r[0] for r in chosen.collect()), np.int64).view(np.uint64)
    np.random.default_rng(SEED).shuffle(sample)
    nodes = build(sample, max(2, int(shard * len(sample) / max(n, 1))), reach)

    def to_shards(batches):
        for batch in batches:
            p = batch.column(0).to_numpy()
            for leaf, who in route(nodes, p.view(np.uint64), reach):
                if len(who):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(who), leaf, np.int32)), pa.array(p[who])],
                        ["leaf", "fp"])

    routed = points.select("fp").mapInArrow(to_shards, "leaf int, fp bigint")
    sizes = routed.groupBy("leaf").count().where(F.col("count") > 2 * shard)
    blocks = {r["leaf"]: -(-r["count"] // shard) for r in sizes.collect()}   # ≤ shards of the tree
    of_leaf = F.coalesce(F.element_at(F.create_map(
        *[F.lit(x) for pair in blocks.items() for x in pair]), F.col("leaf")), F.lit(1)) \
        if blocks else F.lit(1)
    mine = F.pmod(F.xxhash64("fp", F.lit(2)), F.col("of"))
    others = F.transform(F.sequence(F.lit(0), F.col("of") - 1), lambda k: F.struct(
        F.least(k, F.col("mine")).alias("i"), F.greatest(k, F.col("mine")).alias("j")))
    cells = (routed.withColumn("of", of_leaf.cast("long")).withColumn("mine", mine)
             .withColumn("pair", F.explode(others))
             .select("leaf", F.col("pair.i").alias("i"), F.col("pair.j").alias("j"), "fp"))

    def solve(key: tuple, table: pa.Table) -> pa.Table:
        p = table.column("fp").to_numpy().view(np.uint64)
        a, b = forest(p, radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return cells.groupBy("leaf", "i", "j").applyInArrow(solve, "a bigint, b bigint")


def spread(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of every component of ``edges`` (a, b), by alternating
    stars: every node hands its larger, then its smaller neighbours to its least one, until
    all hang on their root.  Each round is stored, so a lost executor costs one round."""
    edges = written(edges.where("a <> b").select(
        F.greatest("a", "b").alias("node"), F.least("a", "b").alias("to")).distinct(), "links")
    before = None
    while True:
        both = edges.union(edges.select(F.col("to").alias("node"), F.col("node").alias("to")))
        large = star(both, F.col("to") > F.col("node"))
        edges = written(large, "large")
        edges = written(star(edges, F.lit(True)), "small")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("node", "to").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select("node", F.col("to").alias("root"))
        before = now


def star(edges: DataFrame, moved: Column) -> DataFrame:
    """Edges (larger, smaller) after each node links its ``moved`` neighbours, and itself,
    to the least of its neighbours and itself."""
    least = written(edges.groupBy("node").agg(F.min("to").alias("least"))
                    .withColumn("least", F.least("least", "node")), "least")
    out = edges.where(moved).join(least, "node").select(F.col("to").alias("node"),
                                                        F.col("least").alias("to"))
    own = least.select("node", F.col("least").alias("to"))
    return out.union(own).where(F.col("node") > F.col("to")).distinct()


def tree_roots(points: DataFrame, radius: int = 2) -> DataFrame:
    """Stored (node, root) of the values of ``points.fp`` (stored, different) with a link
    within ``radius``."""
    return written(components(shard_links(points, radius)), "roots")


def near_duplicates(docs: DataFrame, *, text: str = "text", id: str = "doc_id",
                    width: int = 3, radius: int = 2) -> DataFrame:
    """One row per document: id, fp, component_id (the least id that links reach).

    Null, empty and blank texts have fingerprint 0 and are linked like any other.  Copies
    are one point with a count, so a group of any size adds no links.  Rows with a null id
    take part, but name no component unless no other id is there (then null).  Repeated
    rows are rows like others; an empty table gives none; other columns have no effect.
    """
    prints = written(fingerprints(docs, text=text, id=id, width=width), "fingerprints")
    points = written(prints.groupBy("fp").agg(F.min("id").alias("least_id")), "points")
    roots = tree_roots(points, radius)
    rooted = points.join(roots, points["fp"] == roots["node"], "left").select(
        "fp", "least_id", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "rooted")
    names = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = written(rooted.join(names, "root").select("fp", "component_id"), "components")
    return prints.join(named, "fp").select("id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, *, text: str = "text", id: str = "doc_id",
                         width: int = 3, radius: int = 2) -> DataFrame:
    """``docs`` with one document of every component, the one with the least id; rows with
    a null id stay.  ``id`` tells documents apart: of rows that share it, all stay or go."""
    found = near_duplicates(docs, text=text, id=id, width=width, radius=radius)
    gone = found.where(F.col("id") != F.col("component_id")).select(
        F.col("id").alias("__gone")).distinct()
    return docs.join(gone, docs[id] == gone["__gone"], "left_anti")


def op1(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
