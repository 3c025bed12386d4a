"""Near copies: documents whose sets of five-word shingles have Jaccard similarity 0.8.

Fingerprints within two bits of each other are found by the vantage-point trees of
``simhash``; a component of them is a bucket of points to look at.  Fingerprints do not bound
similarity, though: at 0.8 most differ in so many bits that no cut of the Hamming space
divides anything.  So MinHash bands name further buckets, and every pair of a bucket is decided
by its whole shingle sets.  Equal sets are one point.

Most points of a crowded bucket are near copies of any one of them.  So every point is
first compared with one center, the point that comes first in a hash order in the buckets
they share, and, if that fails, with a second one.  Buckets whose points are connected by
then are done.  In the others the points of the largest component are dealt to blocks of
bounded bytes and met by the rest, block by block; points of one component are not compared
again.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from edgeframe.llm.common import free_name, map_rows
from edgeframe.llm.simhash import components, majority, tree_roots
from edgeframe.session import written

SEED = 42               # of XXH64 and of the MinHash functions
BANDS, ROWS = 32, 4     # a pair at 0.8 agrees in no band with probability 4.7e-8
BLOCK = 16 << 20        # bytes of shingle sets in a block; a task compares two
STARS = 2               # centers that a point is compared with first
STAR = 1_024            # points compared with a center in one group
G = np.random.default_rng(SEED)
XOR, TIMES, MIX = (G.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) for _ in range(3))
TIMES, MIX = TIMES | np.uint64(1), MIX | np.uint64(1)


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted different hashes of all shingles of ``width`` words (the whole text if it has
    fewer); a text without words has the hash of the empty string."""
    parts = text.encode().lower().split() if text else []   # bytes: A-Z and ASCII blanks only
    n = max(1, len(parts) - width + 1)
    whole = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts], dtype=np.int64)
    begin = [0, *ends[:n - 1].tolist()]
    end = (ends[min(width, len(parts)) - 1:] - 1).tolist() if parts else [0]
    of = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((of(whole[a:b], SEED) for a, b in zip(begin, end)), np.uint64, n))


def bands(hashes: np.ndarray) -> np.ndarray:
    """One value per band: equal if the least values of its MinHash functions are."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        h = (hashes[None, at:at + 2048] ^ XOR[:, None]) * TIMES[:, None]
        np.minimum(least, h.min(axis=1), out=least)
    least ^= least >> np.uint64(31)
    return (least * MIX).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64)


def agree(mine: np.ndarray, flat: np.ndarray, size: np.ndarray, least: float) -> np.ndarray:
    """Which of the sets that lie one behind the other in ``flat`` are similar to ``mine``."""
    at = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
    both = np.add.reduceat((mine[at] == flat).astype(np.int64),
                           np.concatenate([[0], np.cumsum(size)[:-1]]))
    return both >= least * (len(mine) + size - both) - 1e-9


def similar(sets: list[np.ndarray], least: float, comp: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of ``sets`` with Jaccard similarity of at least ``least`` that connect whatever
    all such pairs connect: a set is compared with those that are not in its component yet."""
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    size, comp = size[order], comp[order].copy()
    flat = np.concatenate([sets[k] for k in order])
    start = np.concatenate([[0], np.cumsum(size)])
    out = []
    for i in range(len(sets) - 1):
        # partners that are not smaller: at most size / least
        to = int(np.searchsorted(size, size[i] / least * (1 + 1e-9), "right"))
        js = np.arange(i + 1, to)
        js = js[comp[js] != comp[i]]
        if not len(js):
            continue
        mine = flat[start[i]:start[i + 1]]
        if len(js) == to - i - 1:
            part = flat[start[i + 1]:start[to]]
        else:
            part = np.concatenate([flat[start[j]:start[j + 1]] for j in js])
        for j in js[agree(mine, part, size[js], least)]:
            if comp[j] != comp[i]:
                comp[comp == comp[j]] = comp[i]
                out.append((int(order[i]), int(order[j])))
    return out


def _sketches(docs: DataFrame, text: str, id: str, width: int, sets: bool) -> DataFrame:
    """id, key of the shingle set, its fingerprint, and its bands, or with ``sets`` the set
    itself."""
    kept = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("t"))

    def make():
        def of(ids: list, texts: list) -> dict:
            found = [shingles(t, width) for t in texts]
            out = {"id": ids, "key": [xxhash.xxh128_hexdigest(s.tobytes()) for s in found]}
            v = found if sets else [bands(s) for s in found]
            fps = np.array([majority(s) for s in found] if not sets else [0] * len(found), np.uint64)
            out["fp"] = fps.view(np.int64)
            return out | {"v": [x.view(np.int64) for x in v]}
        return of

    return map_rows(kept, make, f"id {docs.schema[id].dataType.simpleString()}, key string, "
                                "fp bigint, v array<bigint>")


def _sets_of(table: pa.Table) -> list[np.ndarray]:
    return [x for c in table.column("v").chunks for x in np.split(
        c.flatten().to_numpy().view(np.uint64), np.cumsum(c.value_lengths().to_numpy())[:-1])
        if len(c)]


def star_links(members: DataFrame, sets: DataFrame, turn: int, least: float) -> DataFrame:
    """Stored pairs (a, b, linked): every point ``a`` of ``members`` (bucket, key) and the
    first center of its buckets in the hash order of this turn.  A set moves once, a center's
    once per group of ``STAR`` points."""
    order = F.struct(F.xxhash64("key", F.lit(turn)).alias("order"), "key")
    centers = members.groupBy("bucket").agg(F.min(order).alias("center"))
    pairs = written(members.join(centers, "bucket").groupBy("key").agg(
        F.min("center")["key"].alias("center")).where("key <> center"), "pairs")
    crowds = written(pairs.groupBy("center").agg(
        F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("groups")), "centers")
    one = sets.select(F.col("key").alias("center"), "v").join(crowds, "center").select(
        "center", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"),
        F.lit(None).cast("string").alias("key"), "v")
    many = pairs.join(crowds, "center").select("key", "center", F.pmod(
        F.xxhash64("key", F.lit(-1)), F.col("groups")).cast("int").alias("part")) \
        .join(sets.select("key", "v"), "key").select("center", "part", "key", "v")

    def solve(table: pa.Table) -> pa.Table:
        keys, found = table.column("key").to_pylist(), _sets_of(table)
        at = keys.index(None)
        mine = found.pop(at)
        keys.pop(at)
        ok = agree(mine, np.concatenate(found), np.array([len(x) for x in found]), least) \
            if found else np.empty(0, bool)
        center = table.column("center")[0].as_py()
        return pa.table({"a": pa.array(keys, pa.string()),
                         "b": pa.array([center] * len(keys), pa.string()), "linked": pa.array(ok)})

    return written(one.union(many).groupBy("center", "part").applyInArrow(
        solve, "a string, b string, linked boolean"), "stars")


def rest_links(members: DataFrame, sets: DataFrame, least: float, block: int) -> DataFrame:
    """Links (a, b) between components in the buckets of ``members`` (bucket, key, root,
    bytes) that hold more than one."""
    parts = members.groupBy("bucket", "root").agg(F.sum("bytes").alias("bytes"))
    mixed = parts.groupBy("bucket").agg(
        F.max(F.struct("bytes", "root")).alias("largest"), F.sum("bytes").alias("all"),
        F.count(F.lit(1)).alias("n")).where("n > 1").select(
            "bucket", F.col("largest.root").alias("main"),
            F.ceil(F.col("largest.bytes") / block).cast("int").alias("mains"),
            F.ceil((F.col("all") - F.col("largest.bytes")) / block).cast("int").alias("others"))
    dealt = members.join(written(mixed, "mixed"), "bucket")
    in_main = F.col("root") == F.col("main")

    def cells(n: Column, cell: Callable[[Column], Column]) -> Column:
        return F.transform(F.sequence(F.lit(0), n - 1), cell)

    def named(kind: str, i: Column, j: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))

    mine = F.pmod(F.xxhash64("key", F.lit(2)),
                  F.when(in_main, F.col("mains")).otherwise(F.col("others"))).cast("int")
    among = F.filter(cells(F.col("others"), lambda k: named(
        "others", F.least(k, F.col("mine")), F.greatest(k, F.col("mine")))),
        lambda c: c["i"] < c["j"])
    of = F.when(in_main, cells(F.col("others"), lambda k: named("main", F.col("mine"), k))).otherwise(
        F.concat(cells(F.col("mains"), lambda k: named("main", k, F.col("mine"))), among))
    spread = dealt.withColumn("mine", mine).select(
        "bucket", "key", "root", F.explode(of).alias("cell")).join(sets, "key").select(
        "bucket", "cell.kind", "cell.i", "cell.j", "key", "root", "v")

    def solve(table: pa.Table) -> pa.Table:
        keys = table.column("key").to_pylist()
        _, comp = np.unique(np.array(table.column("root").to_pylist()), return_inverse=True)
        pairs = similar(_sets_of(table), least, comp) if len(keys) > 1 else []
        return pa.table({"a": pa.array([keys[a] for a, _ in pairs], pa.string()),
                         "b": pa.array([keys[b] for _, b in pairs], pa.string())})

    return spread.groupBy("bucket", "kind", "i", "j").applyInArrow(solve, "a string, b string")


def roots_of(links: DataFrame) -> DataFrame:
    return written(components(links).select(F.col("node").alias("key"), "root"), "roots")


def connected(docs: DataFrame, points: DataFrame, *, text: str, id: str, width: int,
              least: float, block: int = BLOCK) -> DataFrame:
    """Stored (key, root) of the ``points`` (stored: key, least_id, fp, v) that have links."""
    fps = written(points.select("fp").distinct(), "fingerprints")
    met = tree_roots(fps).select("node", "root")
    by_tree = points.join(met, points["fp"] == met["node"], "left").select(
        "key", F.xxhash64(F.lit("tree"), F.coalesce("root", "fp")).alias("bucket"))
    rows = points.select("key", F.explode("v").alias("bucket")).union(by_tree)
    # A bucket with the points of another bucket adds nothing.
    buckets = (rows.groupBy("bucket").agg(
        F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"),
        F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("mark"))
        .where("n > 1").groupBy("n", "lo", "hi", "mark").agg(F.min("bucket").alias("bucket")))
    members = written(rows.join(buckets.select("bucket"), "bucket"), "members")
    ids = points.join(members.select("key").distinct(), "key", "left_semi").select(
        F.col("least_id").alias("__id")).distinct()
    texts = docs.select(F.col(f"`{id}`").alias(id), F.col(f"`{text}`").alias(text))
    again = texts.join(ids, texts[id].eqNullSafe(ids["__id"]), "left_semi")
    sets = written(_sketches(again, text, id, width, True).groupBy("key").agg(
        F.first("v").alias("v")), "sets")
    links, left = None, members
    for turn in range(STARS):
        found = star_links(left, sets, turn, least)
        met = found.where("linked").select("a", "b")
        links = met if links is None else links.union(met)
        left = left.join(met.select(F.col("a").alias("key")), "key", "left_anti")
    roots = roots_of(links)
    size = sets.select("key", (8 * F.size("v")).cast("bigint").alias("bytes"))
    known = written(members.join(size, "key").join(roots, "key", "left").select(
        "bucket", "key", F.coalesce("root", "key").alias("root"), "bytes"), "members")
    more = written(rest_links(known, sets, least, block), "links")
    return roots_of(roots.select(F.col("key").alias("a"), F.col("root").alias("b")).union(more))


def near_copies(docs: DataFrame, *, text: str = "text", id: str = "doc_id", width: int = 5,
                least: float = 0.8) -> DataFrame:
    """One row per document: id, key of its shingle set, component_id (the least id that
    links reach).

    Two texts are linked if their sets of ``width``-word shingles have Jaccard similarity of
    at least ``least``.  Null, empty and blank texts have one set in common.  Rows with a
    null id take part, but name no component unless no other id is there (then null).
    Repeated rows are rows like others; an empty table gives none; very long texts take
    part whole, in a block of their own if need be; other columns have no effect.  ``BANDS``
    and ``ROWS`` are made for 0.8 and more; a lower ``least`` raises.
    """
    if least < 0.8:
        raise ValueError("the bands find pairs of similarity 0.8 and more")
    found = written(_sketches(docs, text, id, width, False), "sketches")
    points = written(found.groupBy("key").agg(
        F.min("id").alias("least_id"), F.first("fp").alias("fp"), F.first("v").alias("v")), "points")
    roots = connected(docs, points, text=text, id=id, width=width, least=least)
    rooted = written(points.join(roots, "key", "left").select(
        "key", "least_id", F.coalesce("root", "key").alias("root")), "rooted")
    names = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = written(rooted.join(names, "root").select("key", "component_id"), "components")
    return found.select("id", "key").join(named, "key").select("id", "key", "component_id")


def drop_near_copies(docs: DataFrame, *, text: str = "text", id: str = "doc_id",
                     width: int = 5, least: float = 0.8) -> DataFrame:
    """``docs`` with one document of every component, the one with the least id; rows with
    a null id stay.  ``id`` tells documents apart: of rows that share it, all stay or go."""
    found = near_copies(docs, text=text, id=id, width=width, least=least)
    name = free_name(docs, "__gone")
    gone = found.where(F.col("id") != F.col("component_id")).select(
        F.col("id").alias(name)).distinct()
    return docs.join(gone, F.col(f"`{id}`") == F.col(name), "left_anti")
