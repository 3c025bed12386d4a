"""Edges stored where they are used: a placement that stays from job to job.

Edges that many jobs read are cut into parts once and stored as a table bucketed by part.
What moves in a job afterwards are vertices and sums, never edges: a *halo* table per index
column lists which part needs which vertex, so a gather joins the vertices with the halo
(bucketed by the vertex), sends the values found to the parts, and joins them there.  A row
sum of such edges adds up within the parts and then moves one row per part and key.

With one column in ``by`` the edges of a row lie in one part.  With two, parts are the blocks
of a grid: a vertex goes to as many parts as the grid has rows or columns, √parts, on either
side, whatever the number of its edges.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edgeframe.operators.gather import SAMPLE, Gather, _found, hot_keys
from edgeframe.session import leaf_bytes, shuffle_partitions

PART_BYTES = 32 << 20       # parts are hashed to buckets, some of which get several
PART = "_part"
META = "parts int, indices array<string>, schema string"


@dataclass(frozen=True)
class EdgeLayout:
    """Stored edges (with their part in ``_part``) and the halo ``(_halo_id, _part)`` of each
    index column."""

    edges: DataFrame
    halos: Mapping[str, DataFrame]
    parts: int


def _block(column: str, columns: Sequence[str], blocks: int, hot: Mapping) -> Column:
    """The block of a value; a hot value gets several, by the other columns of its edges."""
    salts = {k: max(2, min(blocks, int(2 * share * blocks) + 1)) for k, share in hot.items()}
    if blocks == 1 or not salts:
        return F.pmod(F.xxhash64(column), F.lit(blocks).cast("bigint"))
    wide = F.create_map(*[F.lit(x) for pair in salts.items() for x in pair])[F.col(column)]
    salt = F.pmod(F.xxhash64(*columns), F.coalesce(wide, F.lit(1)).cast("bigint"))
    return F.pmod(F.xxhash64(F.xxhash64(column) + salt), F.lit(blocks).cast("bigint"))


def placed_edges(edges: DataFrame, by: Sequence[str], parts: int, *,
                 sample: float = SAMPLE) -> DataFrame:
    """``edges`` with their part: a function of their columns alone, so a task that is run
    again, and a job that adds edges with the same hot values, puts an edge where it was.

    A value that owns more of the edges than half a block's share gets blocks by its share,
    filled by a hash of all columns; equal edges stay together.
    """
    if PART in edges.columns:
        raise ValueError(f"edges have a column {PART} already")
    if len(by) not in (1, 2):
        raise ValueError("edges are placed by one or two columns")
    blocks = max(1, int(parts ** (1 / len(by)) + 1e-9))
    part = F.lit(0).cast("bigint")
    for c in by:
        share = max(0.5 / blocks, 1e-4)
        hot = hot_keys(edges, c, share=share, fraction=sample) if blocks > 1 else {}
        part = part * blocks + _block(c, edges.columns, blocks, hot)
    return edges.withColumn(PART, part)


def _store(df: DataFrame, path: str, parts: int, key: str) -> None:
    name = f"edgeframe_{uuid.uuid4().hex}"
    spark = df.sparkSession
    (df.repartition(parts, key).write.bucketBy(parts, key).sortBy(key)
     .option("path", path).format("parquet").saveAsTable(name))
    spark.sql(f"DROP TABLE {name}")         # an external table: its files stay


def _opened(spark: SparkSession, path: str, schema: T.StructType, parts: int,
            key: str) -> DataFrame:
    """A stored table under a name of this session, which is what tells Spark its buckets."""
    name = f"edgeframe_{uuid.uuid4().hex}"
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    spark.sql(f"CREATE TABLE {name} ({ddl}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) "
              f"INTO {parts} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def store_edges(edges: DataFrame, path: str, *, by: Sequence[str] | str,
                indices: Sequence[str] = (), parts: int | None = None,
                sample: float = SAMPLE) -> EdgeLayout:
    """Store ``edges`` under the new folder ``path``, placed by one or two columns, with halos
    for ``by`` and ``indices``.

    ``parts`` defaults to one per ``PART_BYTES`` of input, at least the shuffle partitions of
    the session.  The row that ``open_edges`` needs is written last, so a layout whose job
    failed cannot be opened.  A null index is in no halo.
    """
    spark = edges.sparkSession
    by = [by] if isinstance(by, str) else list(by)
    named = list(dict.fromkeys([*by, *indices]))
    parts = parts or max(shuffle_partitions(spark), -(-leaf_bytes(edges) // PART_BYTES))
    placed = placed_edges(edges, by, parts, sample=sample)
    _store(placed, f"{path}/edges", parts, PART)
    stored = spark.read.schema(placed.schema).parquet(f"{path}/edges")
    for k, c in enumerate(named):
        pairs = stored.select(F.col(c).alias("_halo_id"), PART).where(F.col(c).isNotNull())
        # The edges of a part lie together, so most repeats go before the shuffle.
        _store(pairs.distinct(), f"{path}/halo{k}", parts, "_halo_id")
    spark.createDataFrame([(parts, named, placed.schema.json())], META).coalesce(
        1).write.parquet(f"{path}/layout")
    return open_edges(spark, path)


def open_edges(spark: SparkSession, path: str) -> EdgeLayout:
    """A layout that this or an earlier application has stored."""
    meta = spark.read.schema(META).parquet(f"{path}/layout").first()
    parts, schema = meta["parts"], T.StructType.fromJson(json.loads(meta["schema"]))
    edges = _opened(spark, f"{path}/edges", schema, parts, PART)
    halos = {}
    for k, c in enumerate(meta["indices"]):
        halo = T.StructType([T.StructField("_halo_id", schema[c].dataType), schema[PART]])
        halos[c] = _opened(spark, f"{path}/halo{k}", halo, parts, "_halo_id")
    return EdgeLayout(edges, halos, parts)


def gather_stored(layout: EdgeLayout, gathers: Sequence[Gather],
                  edges: DataFrame | None = None, *, on_missing: str = "raise") -> DataFrame:
    """``gather_many`` of stored edges, without moving them.

    ``edges`` may be a projection or filter of ``layout.edges`` that keeps ``_part`` and the
    index columns.  Vertices move to their halo rows, and halo rows with their values to the
    parts.  Edges whose index is null or names no vertex fail or drop as in ``gather_many``.
    """
    if on_missing not in ("raise", "drop"):
        raise ValueError("on_missing is 'raise' or 'drop'")
    edges = layout.edges if edges is None else edges
    for g in gathers:
        if g.idx not in layout.halos:
            raise ValueError(f"the layout has no halo for {g.idx!r}")
        outputs = g.outputs()
        clash = set(outputs) & set(edges.columns)
        if clash:
            raise ValueError(f"gathered columns {sorted(clash)} already exist")
        side = g.table.select(F.col(g.id).alias("_gather_id"),
                              *[c.alias(n) for n, c in outputs.items()])
        halo = layout.halos[g.idx]
        sent = (halo.join(side, halo["_halo_id"] == side["_gather_id"])
                .select(F.col(PART).alias("_to"), "_gather_id", *outputs)
                .repartition(layout.parts, "_to"))
        met = edges.join(sent, (edges[PART] == sent["_to"]) & (edges[g.idx] == sent["_gather_id"]),
                         "left" if on_missing == "raise" else "inner")
        edges = met.select(*edges.columns, *(
            [_found(c, g.idx) for c in outputs] if on_missing == "raise" else outputs))
    return edges
