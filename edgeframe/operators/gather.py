"""Gather: attach vertex values to edges through an index column.

A gather is an equi-join on a unique vertex id that gives one row per edge.  Small vertex tables are
broadcast by Spark itself, which knows their size.  For larger ones the edges are
shuffled by the index; an index value that owns a large share of the edges would then
land in one task, so such values are looked up first and spread over salts.

Wide vertex values that are summed by another column afterwards do not have to move with every
edge: with ``near`` the edges of an index value move as a list, with one copy of the vertex, to
the block of rows they belong to.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeframe.session import (PARTITION_BYTES, broadcast_limit, estimated_bytes, leaf_bytes,
                               shuffle_partitions)

HOT_SHARE = 0.001           # least share of the edges that makes an index value hot
SMALL_EDGES = 1 << 30       # edge tables up to this many bytes need no spreading
SAMPLE = 0.001              # share of the edges in which hot values are looked for
SMALL_LISTS = 64 << 20      # edge tables up to this many bytes fit in one list of edges

Skew = str | Mapping[str, Mapping[object, float]]


@dataclass(frozen=True)
class Gather:
    """One selector: ``columns`` (output name → vertex column) of ``table`` at ``idx``."""

    table: DataFrame
    idx: str
    columns: Mapping[str, str | Column] | Sequence[str]
    id: str = "id"

    def outputs(self) -> dict[str, Column]:
        cols = self.columns if isinstance(self.columns, Mapping) else {c: c for c in self.columns}
        return {n: F.col(c) if isinstance(c, str) else c for n, c in cols.items()}


def broadcastable(df: DataFrame) -> bool:
    """Whether Spark's size estimate lets it broadcast ``df``."""
    return estimated_bytes(df) <= broadcast_limit(df.sparkSession)


def hot_keys(df: DataFrame, key: str, *, share: float = HOT_SHARE,
             fraction: float | None = None) -> dict:
    """Values of ``key`` that own more than ``share`` of the rows, with their share.

    Fewer than ``1/share`` values, largest first.  They are looked for in a sample of the
    key column, counted before its shuffle.  The sample only decides which values get
    spread; every row is joined either way, and a value it misses is left to adaptive
    execution.
    """
    sample = df.select(key).where(F.col(key).isNotNull()).sample(
        SAMPLE if fraction is None else fraction, 0)
    counts = (sample.rollup(key).agg(F.count(F.lit(1)).alias("n"))
              .orderBy(F.desc("n")).limit(int(1 / share) + 1).collect())
    total = next((r["n"] for r in counts if r[key] is None), 0)
    return {r[key]: r["n"] / total for r in counts
            if r[key] is not None and r["n"] > total * share}


def hot_values(edges: DataFrame, indices: Iterable[str]) -> dict[str, dict]:
    """Per index column, the values worth spreading over tasks, with their share."""
    if leaf_bytes(edges) <= SMALL_EDGES:
        return {}
    # A value with less than half a partition's share needs no spreading.
    share = max(HOT_SHARE, 0.5 / shuffle_partitions(edges.sparkSession))
    return {idx: hot_keys(edges, idx, share=share) for idx in dict.fromkeys(indices)}


def salted_join(left: DataFrame, right: DataFrame, key: str, hot: Mapping[object, float],
                partitions: int, how: str = "inner") -> DataFrame:
    """``left ⋈ right`` on ``key``; the rows of a hot key are spread over several tasks.

    A key gets twice its share of the shuffle's partitions, so the copies of the matching
    rows of ``right`` are fewer than 2·partitions in all, plus two per hot key.  The salt
    comes from the number of the input task, which a task that is run again keeps.
    """
    is_hot = F.col(key).isin(list(hot))
    tasks = {k: max(2, math.ceil(2 * share * partitions)) for k, share in hot.items()}
    salts = F.create_map(*[F.lit(x) for pair in tasks.items() for x in pair])[F.col(key)]
    spread = F.when(is_hot, F.pmod(F.spark_partition_id(), salts)).otherwise(F.lit(0))
    copies = F.when(is_hot, F.sequence(F.lit(0), salts - 1)).otherwise(F.array(F.lit(0)))
    return (left.withColumn("_salt", spread)
            .join(right.withColumn("_salt", F.explode(copies)), [key, "_salt"], how)
            .drop("_salt"))


def _found(c: str, idx: str) -> Column:
    """A gathered column; an edge without a vertex fails the query that reads it."""
    message = F.concat(F.lit(f"{idx} names no vertex: "),
                       F.coalesce(F.col(idx).cast("string"), F.lit("null")))
    return F.when(F.col("_gather_id").isNotNull(), F.col(c)).otherwise(
        F.raise_error(message)).alias(c)


def _unique(side: DataFrame, idx: str) -> DataFrame:
    """``side``, failing the query that reads it if several rows hold one id."""
    added = [c for c in side.columns if c != "_gather_id"]
    once = side.groupBy("_gather_id").agg(F.count(F.lit(1)).alias("_n"),
                                          *[F.first(c).alias(c) for c in added])
    message = F.concat(F.lit(f"{idx} names several vertices: "),
                       F.col("_gather_id").cast("string"))
    return once.select("_gather_id", *[
        F.when((F.col("_n") == 1) | F.col("_gather_id").isNull(), F.col(c)).otherwise(
            F.raise_error(message)).alias(c) for c in added])


def _attach(edges: DataFrame, side: DataFrame, idx: str, hot: Mapping,
            on_missing: str) -> DataFrame:
    added = [c for c in side.columns if c != "_gather_id"]
    if on_missing == "raise":
        if hot:
            side = side.withColumnRenamed("_gather_id", "_key").withColumn(
                "_gather_id", F.col("_key"))
            joined = salted_join(edges.withColumn("_key", F.col(idx)), side, "_key", hot,
                                 shuffle_partitions(edges.sparkSession), "left")
        else:
            joined = edges.join(side, edges[idx] == side["_gather_id"], "left")
        return joined.select(*edges.columns, *[_found(c, idx) for c in added])
    if hot:
        keyed = edges.withColumn("_gather_id", F.col(idx))
        return salted_join(keyed, side, "_gather_id", hot, shuffle_partitions(
            edges.sparkSession)).select(*edges.columns, *added)
    return (edges.join(side, edges[idx] == side["_gather_id"], "inner")
            .select(*edges.columns, *added))


def gather(edges: DataFrame, vertices: DataFrame, idx: str,
           columns: Mapping[str, str | Column] | Sequence[str], *, id: str = "id",
           skew: Skew = "auto", on_missing: str = "raise",
           unique: str = "assume", near: str | None = None) -> DataFrame:
    """Each edge with ``columns`` of the vertex that ``idx`` names.

    Columns may be expressions over the vertex table, evaluated before the join.  An edge
    whose index is null or names no vertex fails the query that reads a gathered column of
    it, at the cost of no further shuffle; with ``on_missing="drop"`` it is left out.
    Vertex ids must be unique; with ``unique="check"``, which aggregates the vertex side,
    a table with a repeated id fails the query too.

    ``near`` names a column by which wide ``columns`` are summed next.  The edges of one value
    of it come out of one task, so the sum moves a row per value; a vertex moves once for each
    block of values that has edges to it, never more often than it has edges.
    """
    one = Gather(vertices, idx, columns, id)
    if near is None or edges.columns == [idx]:
        return gather_many(edges, [one], skew=skew, on_missing=on_missing, unique=unique)
    return _gather_near(edges, one, near, skew, on_missing, unique)


def _gather_near(edges: DataFrame, one: Gather, near: str, skew: Skew, on_missing: str,
                 unique: str) -> DataFrame:
    """``gather`` by lists: the edges of an index value and a block of ``near``, and a salt if
    the value is hot, are one row until the vertex is there and the row is in its block."""
    clash = set(one.outputs()) & set(edges.columns)
    if clash:
        raise ValueError(f"gathered columns {sorted(clash)} already exist")
    spark, size = edges.sparkSession, leaf_bytes(edges)
    blocks = max(spark.sparkContext.defaultParallelism, -(-size // PARTITION_BYTES))
    if not isinstance(skew, str):
        hot = skew.get(one.idx, {})
    else:
        hot = hot_keys(edges, one.idx, share=max(HOT_SHARE, 0.5 / blocks)) \
            if skew == "auto" and size > SMALL_LISTS else {}
    placed = {"_block": F.pmod(F.xxhash64(near), F.lit(blocks).cast("bigint")).cast("int")}
    if hot:
        salts = F.create_map(*[F.lit(x) for k, share in hot.items() for x in (
            k, max(2, math.ceil(2 * share * blocks)))])[F.col(one.idx)]
        placed["_salt"] = F.when(
            salts.isNotNull(), F.pmod(F.spark_partition_id(), salts)).otherwise(F.lit(0))
    rest = [c for c in edges.columns if c != one.idx]
    keys = [one.idx, *placed]
    # Moved before they are collected: lists of one map task would seldom hold two edges.
    lists = (edges.withColumns(placed).repartition(*keys)
             .groupBy(*keys).agg(F.collect_list(F.struct(*rest)).alias("_edges")))
    met = gather_many(lists, [one], skew="off", on_missing=on_missing, unique=unique)
    return (met.repartitionById(blocks, F.col("_block"))
            .select(one.idx, *one.outputs(), F.explode("_edges").alias("_edge"))
            .select(*[F.col(c) if c == one.idx else F.col(f"_edge.`{c}`") for c in edges.columns],
                    *one.outputs()))


def gather_many(edges: DataFrame, gathers: Sequence[Gather], *, skew: Skew = "auto",
                on_missing: str = "raise", unique: str = "assume") -> DataFrame:
    """Several gathers; those of one table through one index share a single join.

    ``on_missing`` and ``unique`` are those of ``gather``.

    ``skew="off"`` leaves out the search for hot index values, for indices that cannot
    have any (a triangle has three faces); adaptive execution still splits what it finds.
    A mapping from ``hot_values`` is used as it is, which saves the search when the same
    edges are gathered again and again.
    """
    if isinstance(skew, str) and skew not in ("auto", "off"):
        raise ValueError(f"skew must be 'auto', 'off' or a mapping, got {skew!r}")
    if on_missing not in ("raise", "drop"):
        raise ValueError("on_missing is 'raise' or 'drop'")
    if unique not in ("assume", "check"):
        raise ValueError("unique is 'assume' or 'check'")
    grouped: dict[tuple[int, str, str], tuple[DataFrame, dict[str, Column]]] = {}
    taken = set(edges.columns)
    for g in gathers:
        _, outputs = grouped.setdefault((id(g.table), g.idx, g.id), (g.table, {}))
        for name, col in g.outputs().items():
            if name in taken:
                raise ValueError(f"gathered column {name!r} already exists")
            taken.add(name)
            outputs[name] = col
    sides = [(idx, table.select(F.col(id_).alias("_gather_id"),
                                *[c.alias(n) for n, c in outputs.items()]))
             for (_, idx, id_), (table, outputs) in grouped.items()]
    if unique == "check":
        sides = [(idx, _unique(side, idx)) for idx, side in sides]
    hot: dict[int, Mapping] = {}
    if skew == "auto" and leaf_bytes(edges) > SMALL_EDGES:
        shuffled = {k: idx for k, (idx, side) in enumerate(sides) if not broadcastable(side)}
        found = hot_values(edges, shuffled.values())
        hot = {k: found.get(idx, {}) for k, idx in shuffled.items()}
    elif not isinstance(skew, str):
        hot = {k: skew.get(idx, {}) for k, (idx, _) in enumerate(sides)}
    for k, (idx, side) in enumerate(sides):
        edges = _attach(edges, side, idx, hot.get(k, {}), on_missing)
    return edges


def check_index(edges: DataFrame, idx: str, n: int | None = None, *,
                vertices: DataFrame | None = None, id: str = "id") -> DataFrame:
    """One row: edges whose ``idx`` is null, negative, or names no vertex.

    Give the domain size ``n`` (a filter) or the vertex table.  With a table the edges
    are counted per index value first, so a dangling value shared by many edges is one
    row in the join.
    """
    if (n is None) == (vertices is None):
        raise ValueError("give either n or vertices")
    i = F.col(idx)
    if n is not None:
        return edges.agg(
            F.count_if(i.isNull()).alias("null_ids"),
            F.count_if(i < 0).alias("negative_ids"),
            F.count_if((i < 0) | (i >= n)).alias("dangling_ids"))
    per_value = edges.groupBy(i.alias("_idx")).agg(F.count(F.lit(1)).alias("_edges"))
    known = vertices.select(F.col(id).alias("_known"))
    found = per_value.join(known, per_value["_idx"] == known["_known"], "left")

    def edges_where(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col("_edges"))), F.lit(0)).cast("bigint")

    return found.agg(
        edges_where(F.col("_idx").isNull()).alias("null_ids"),
        edges_where(F.col("_idx") < 0).alias("negative_ids"),
        edges_where(F.col("_idx").isNotNull() & F.col("_known").isNull()).alias("dangling_ids"))


def duplicate_ids(vertices: DataFrame, id: str = "id") -> DataFrame:
    """Vertex ids held by more than one row, with their count; empty for a valid table."""
    return vertices.groupBy(id).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)
