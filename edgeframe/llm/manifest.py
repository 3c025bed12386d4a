"""Merkle manifest of a dataset by time-forward processing.

Nodes are labelled in an order in which children come before parents: by the last leaf
below a node, then by its level.  A sweep in that order sends the digest of every node to
its parent through a priority queue keyed by the receiver's label; when a label is reached,
everything sent to it is at the head of the queue.  The reversed sweep sends every node's
proof suffix (the runs from it up to the root) to its children in the same way.

The queue is external: Spark's sorted shuffle brings leaves, and the suffixes that come
from above, to a block of ``RUN ** HEIGHT`` leaves in the order of labels, and inside a
block the queue holds at most ``RUN`` messages a level.  The roots of blocks are the leaves of the
next round, 4,096 times fewer, so no group of documents is ever in one task.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from edgeframe.operators.offsets import global_position
from edgeframe.session import written

RUN = 16                # children of a node
HEIGHT = 3              # levels that one round climbs
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LEVELS = "array<struct<slot:int,run:string>>"
ROWS = 4_096            # rows of an Arrow batch of results
_LEVELS = pa.list_(pa.struct([("slot", pa.int32()), ("run", pa.string())]))
UP = pa.schema([("grp", pa.string()), ("at", pa.int64()), ("size", pa.int64()),
                ("digest", pa.binary())])
DOWN = pa.schema([("grp", pa.string()), ("at", pa.int64()), ("levels", _LEVELS),
                  ("subroot", pa.string())])


def _ddl(schema: pa.Schema) -> str:
    types = {pa.string(): "string", pa.int64(): "bigint", pa.binary(): "binary", _LEVELS: LEVELS,
             pa.int32(): "int"}
    return ", ".join(f"{f.name} {types[f.type]}" for f in schema)



def digest(children: Iterable[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def field(value: Column) -> Column:
    """``-`` for a null, else the number of UTF-8 bytes, a colon, and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    """Digest of a row, as binary."""
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256))


# ---- one block ---------------------------------------------------------------------


def height(size: int, tall: int) -> int:
    """Levels that a round of ``tall`` levels climbs from ``size`` nodes: fewer if one node
    is left before."""
    h = 0
    while size > 1 and h < tall:
        size, h = -(-size // RUN), h + 1
    return h


def sweep_up(leaves: Sequence[str], levels: int) -> list[tuple[int, int, list[str], str]]:
    """(level, index, children, digest) of the inner nodes over ``leaves``, in the order of
    their labels; the last is the root."""
    queue: list[tuple[int, int, int, int, str]] = []
    out = []

    def send(level: int, index: int, value: str) -> None:
        to = index // RUN
        last = min((to + 1) * RUN ** (level + 1), len(leaves)) - 1
        heapq.heappush(queue, (last, level + 1, to, index, value))

    for at, value in enumerate(leaves):
        if levels:
            send(0, at, value)
        while queue and queue[0][0] == at:
            label, children = queue[0][:3], []
            while queue and queue[0][:3] == label:
                children.append(heapq.heappop(queue)[4])
            _, level, index = label
            made = digest(children)
            out.append((level, index, children, made))
            if level < levels:
                send(level, index, made)
    return out


def sweep_down(nodes: list[tuple[int, int, list[str], str]],
               above: tuple) -> Iterator[tuple[int, tuple]]:
    """(leaf index, proof) in descending order, from the nodes of ``sweep_up`` and the
    proof of their root.  A proof is (slot, children of the run, proof of the parent), or
    empty at the very top."""
    if not nodes:
        yield 0, above
        return
    # Labels in reverse: the receiver that comes first in the reversed sweep is at the head.
    queue: list[tuple[int, tuple]] = [(0, above)]
    place = {(level, index): len(nodes) - 1 - k for k, (level, index, _, _) in enumerate(nodes)}
    for level, index, children, _ in reversed(nodes):
        _, proof = heapq.heappop(queue)
        for slot in range(len(children) - 1, -1, -1):
            down = (slot, children, proof)
            child = index * RUN + slot
            if level == 1:
                yield child, down
            else:
                heapq.heappush(queue, (place[level - 1, child], down))


def levels_of(proof: tuple) -> list[dict]:
    """A proof as rows (slot, digests of the whole run), from the leaf upwards."""
    out = []
    while proof:
        slot, run, proof = proof
        out.append({"slot": slot, "run": "".join(run)})
    return out


def proof_of(levels: Sequence[dict]) -> tuple:
    proof: tuple = ()
    for r in reversed(levels):
        proof = (r["slot"], [r["run"][k:k + 64] for k in range(0, len(r["run"]), 64)], proof)
    return proof


def siblings(proof: tuple) -> Iterator[str]:
    """The siblings of a leaf, level by level, from left to right."""
    while proof:
        slot, run, proof = proof
        yield from run[:slot]
        yield from run[slot + 1:]


def folded(value: str, proof: tuple) -> str:
    """The root that a leaf and its proof give."""
    while proof:
        slot, run, proof = proof
        value = digest([*run[:slot], value, *run[slot + 1:]])
    return value


# ---- rounds of blocks --------------------------------------------------------------


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows sorted by grp, block, at: the rows of one block at a time."""
    rows: list[dict] = []
    for batch in batches:
        for r in batch.to_pylist():
            if rows and (r["grp"] != rows[0]["grp"] or r["block"] != rows[0]["block"]):
                yield rows
                rows = []
            rows.append(r)
    if rows:
        yield rows


def _sorted(nodes: DataFrame, tall: int) -> DataFrame:
    """Nodes by group and block; a block begins with the suffix of its root, if there is one."""
    is_node = F.col("levels").isNull()
    block = F.call_function("div", F.col("at"), F.lit(RUN ** tall).cast("bigint"))
    return nodes.withColumn("block", F.when(is_node, block).otherwise(F.col("at"))).repartition(
        "grp", "block").sortWithinPartitions("grp", "block", is_node, "at")


def _met(nodes: DataFrame, suffixes: DataFrame, tall: int) -> DataFrame:
    """Nodes behind the suffix of their block's root."""
    return _sorted(suffixes.unionByName(nodes, allowMissingColumns=True), tall)


def _up(batches: Iterable[pa.RecordBatch], tall: int) -> Iterator[pa.RecordBatch]:
    """The root of every block, a node of the next round."""
    out: dict[str, list] = {n: [] for n in UP.names}
    for rows in _blocks(batches):
        n = rows[0]["size"]
        leaves = [r["digest"].hex() for r in rows]
        nodes = sweep_up(leaves, height(n, tall))
        _add(out, rows[0]["grp"], rows[0]["block"], -(-n // RUN ** tall),
             bytes.fromhex(nodes[-1][3] if nodes else leaves[0]))
        if len(out["at"]) >= ROWS:
            yield _taken(out, UP)
    yield _taken(out, UP)


def _down(batches: Iterable[pa.RecordBatch], tall: int) -> Iterator[pa.RecordBatch]:
    """The suffix of every node, from that of the root of its block."""
    out: dict[str, list] = {n: [] for n in DOWN.names}
    for above, *rows in _blocks(batches):
        nodes = sweep_up([r["digest"].hex() for r in rows], height(rows[0]["size"], tall))
        for k, proof in sweep_down(nodes, proof_of(above["levels"])):
            _add(out, rows[k]["grp"], rows[k]["at"], levels_of(proof), above["subroot"])
            if len(out["at"]) >= ROWS // 16:
                yield _taken(out, DOWN)
    yield _taken(out, DOWN)


def _add(out: dict[str, list], *values: object) -> None:
    for column, value in zip(out.values(), values):
        column.append(value)


def _taken(out: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    """The rows gathered so far, which ``out`` then has no more."""
    made = pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)
    for column in out.values():
        column.clear()
    return made


def climb(nodes: DataFrame, tall: int) -> list[DataFrame]:
    """Rounds over stored ``nodes`` (grp, at, size of the group, digest): the nodes, the
    roots of their blocks, and so on; in the last round every group has one node."""
    rounds = [nodes]
    most = nodes.agg(F.max("size")).first()[0] or 0
    while most > 1:
        below = rounds[-1].select("grp", "at", "size", "digest",
                                  F.lit(None).cast(LEVELS).alias("levels"))
        rounds.append(written(_sorted(below, tall).mapInArrow(
            lambda batches: _up(batches, tall), _ddl(UP)), "nodes"))
        most = -(-most // RUN ** tall)
    return rounds


def descend(rounds: list[DataFrame], suffixes: DataFrame, tall: int) -> DataFrame:
    """Suffixes (grp, at, levels, subroot) of the roots above ``rounds`` handed down, round
    by round, to the nodes of the first one."""
    for nodes in reversed(rounds):
        suffixes = written(_met(nodes, suffixes, tall).mapInArrow(
            lambda batches: _down(batches, tall), _ddl(DOWN)), "suffixes")
    return suffixes


def manifest(docs: DataFrame, *, id: str = "doc_id", group: str = "source",
             fields: Sequence[str] = FIELDS, changed: dict[str, Column] | None = None,
             with_proof: bool = False, tall: int = HEIGHT) -> DataFrame:
    """One row per document: id, leaf, subroot of its group, root, proof_sha256 (digest of
    all siblings up to the root), folded_root, verified; with ``with_proof`` also the proof,
    an array of (slot, digests of the whole run) from the leaf upwards.

    ``folded_root`` comes from the leaf of the row as it is now and the stored siblings.
    ``changed`` replaces columns for that leaf only, which shows whether a change is found.

    Leaves ascend by ``id`` within a group, nulls first, ties by their digest; equal rows
    have equal digests, so their order is free in value.  Groups ascend by UTF-8 bytes, null
    first.  Any field may be null, empty or long: a field is hashed with its length.  A
    group of one row is its own subroot, a single group's subroot is the root, and the proof
    of a single row is the digest of nothing.  An empty table gives no rows; other columns
    have no effect.
    """
    columns = [F.col(f"`{f}`") for f in fields]
    now = [(changed or {}).get(f, c) for f, c in zip(fields, columns)]
    same = functools.reduce(lambda a, b: a & b, (x.eqNullSafe(c) for x, c in zip(now, columns)))
    rows = written(docs.select(
        F.col(f"`{group}`").cast("string").alias("grp"), F.col(f"`{id}`").alias("id"),
        leaf(columns).alias("digest"), F.when(~same, leaf(now)).alias("now")), "digests")
    placed = global_position(rows, ["grp", "id", "digest"], name="leaves")
    groups = written(placed.groupBy("grp").agg(
        F.min("pos").alias("first"), F.count(F.lit(1)).alias("size")), "groups")
    leaves = written(placed.alias("p").join(
        groups.alias("g"), F.col("p.grp").eqNullSafe(F.col("g.grp"))).select(
            "p.grp", (F.col("pos") - F.col("first")).alias("at"), "size", "digest", "id", "now"),
        "nodes")
    rounds = climb(leaves, tall)
    # The subroots are the leaves of one more group, above all.
    top = written(global_position(rounds[-1].select("grp", "digest"), ["grp"], "at",
                                  name="subroots"), "subroots")
    one = F.lit(None).cast("string").alias("grp")
    above = climb(written(top.select(one, "at", F.lit(top.count()).cast("bigint").alias("size"),
                                     "digest"), "nodes"), tall)
    found = above[-1].first()
    root = found["digest"].hex() if found else ""
    start = docs.sparkSession.createDataFrame(
        [(None, 0, [], None)], f"grp string, at bigint, levels {LEVELS}, subroot string")
    of_top = descend(above[:-1], start, tall)
    by_group = written(of_top.select("at", "levels").join(top, "at").select(
        "grp", F.lit(0).cast("bigint").alias("at"), "levels",
        F.lower(F.hex("digest")).alias("subroot")), "suffixes")
    suffixes = descend(rounds[1:-1], by_group, tall)
    id_type = docs.schema[id].dataType

    def prove(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        schema = pa.schema([("id", to_arrow_type(id_type)), ("leaf", pa.string()),
                            ("subroot", pa.string()), ("proof_sha256", pa.string()),
                            ("folded_root", pa.string()), ("proof", _LEVELS)])
        out: dict[str, list] = {n: [] for n in schema.names}
        for first, *rows in _blocks(batches):
            values = [r["digest"].hex() for r in rows]
            nodes = sweep_up(values, height(rows[0]["size"], tall))
            for k, proof in sweep_down(nodes, proof_of(first["levels"])):
                r = rows[k]
                _add(out, r["id"], values[k], first["subroot"], digest(siblings(proof)),
                     folded(r["now"].hex() if r["now"] else values[k], proof),
                     levels_of(proof) if with_proof else None)
            if len(out["id"]) >= ROWS:
                yield _taken(out, schema)
        yield _taken(out, schema)

    proved = _met(leaves, suffixes, tall).mapInArrow(
        prove, f"id {id_type.simpleString()}, leaf string, subroot string, proof_sha256 string, "
               f"folded_root string, proof {LEVELS}")
    return proved.select("id", "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256",
                         "folded_root", (F.col("folded_root") == root).alias("verified"),
                         *["proof"] * with_proof)


def op13(docs: DataFrame) -> DataFrame:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    text = F.when(hit, F.translate("text", upper, lower)).otherwise(F.col("text"))
    return manifest(docs, changed={"text": text}).withColumnRenamed("id", "doc_id")


def _fields(text: str) -> str:
    values = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(" + " || ".join(
        f"coalesce(CAST(strlen({v}) AS VARCHAR) || ':' || {v}, '-')" for v in values) + ")"


_CRC = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT],
    list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0],
    lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))))"""
_CHANGED = f"""CASE WHEN doc_id IS NOT NULL AND {_CRC} % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz') ELSE text END"""

SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, {_fields("text")} AS leaf, {_fields("changed")} AS now
  FROM (SELECT *, {_CHANGED} AS changed FROM documents)),
l AS (SELECT *, row_number() OVER (ORDER BY source NULLS FIRST, doc_id NULLS FIRST, leaf) AS k,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p,
    count(*) OVER (PARTITION BY source) AS n FROM d),
nodes(source, lvl, p, n, h) AS (
  SELECT source, 0, p, n, leaf FROM l UNION ALL
  SELECT source, lvl + 1, p // 16, (any_value(n) + 15) // 16, sha256(string_agg(h, '' ORDER BY p))
  FROM nodes WHERE n > 1 GROUP BY source, lvl, p // 16),
subs AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS p,
    count(*) OVER () AS n FROM nodes WHERE n = 1),
top(lvl, p, n, h) AS (
  SELECT 0, p, n, subroot FROM subs UNION ALL
  SELECT lvl + 1, p // 16, (any_value(n) + 15) // 16, sha256(string_agg(h, '' ORDER BY p))
  FROM top WHERE n > 1 GROUP BY lvl, p // 16),
walk(k, source, lvl, p, n, proof, f) AS (
  SELECT k, source, 0, p, n, '', now FROM l UNION ALL
  SELECT w.k, any_value(w.source), any_value(w.lvl) + 1, any_value(w.p) // 16,
    (any_value(w.n) + 15) // 16,
    any_value(w.proof) || coalesce(string_agg(x.h, '' ORDER BY x.p) FILTER (x.p <> w.p), ''),
    sha256(string_agg(CASE WHEN x.p = w.p THEN w.f ELSE x.h END, '' ORDER BY x.p))
  FROM walk w JOIN nodes x ON x.source IS NOT DISTINCT FROM w.source AND x.lvl = w.lvl
    AND x.p // 16 = w.p // 16 WHERE w.n > 1 GROUP BY w.k),
walk2(k, lvl, p, n, proof, f) AS (
  SELECT k, 0, s.p, s.n, proof, f FROM walk w JOIN subs s ON s.source IS NOT DISTINCT FROM w.source
  WHERE w.n = 1 UNION ALL
  SELECT w.k, any_value(w.lvl) + 1, any_value(w.p) // 16, (any_value(w.n) + 15) // 16,
    any_value(w.proof) || coalesce(string_agg(x.h, '' ORDER BY x.p) FILTER (x.p <> w.p), ''),
    sha256(string_agg(CASE WHEN x.p = w.p THEN w.f ELSE x.h END, '' ORDER BY x.p))
  FROM walk2 w JOIN top x ON x.lvl = w.lvl AND x.p // 16 = w.p // 16 WHERE w.n > 1 GROUP BY w.k)
SELECT l.doc_id, l.leaf, s.subroot, r.h AS root, sha256(w.proof) AS proof_sha256,
  w.f AS folded_root, w.f = r.h AS verified
FROM l JOIN subs s ON s.source IS NOT DISTINCT FROM l.source
JOIN walk2 w ON w.k = l.k AND w.n = 1 CROSS JOIN (SELECT h FROM top WHERE n = 1) r
"""
