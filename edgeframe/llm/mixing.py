"""Mixing sources to target weights by weighted sampling with exponential keys.

Every document gets the key ``u ** (1 / quality)`` with a repeatable uniform ``u``; sorted
by it from the top, a source's documents are a weighted sample without replacement of any
length.  A source takes complete epochs while they fit its budget of words, and the rest
from the top of that order up to the budget.

The order is never made in one task.  Keys fall into ranges of equal width; sums per source
and range, added up over a bounded number of ranges, say which ranges are taken whole and
which one holds the edge of the budget.  In that range the edge is looked for among the
different keys, and rows that share the key at the edge (repeated or null ids) are divided
by a hash of the row: only rows of one key and one hash range are sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from edgeframe.llm.common import as_scan, free_name, let, with_row_id, words
from edgeframe.session import written

RANGES = 1 << 14
WEIGHTS = (3, 1, 2)


def quality(tokens: Column) -> Column:
    """Share of different words, moved into 1/2 to 1: texts that repeat themselves weigh less."""
    n = F.size(tokens)
    return F.when(n == 0, F.lit(1.0)).otherwise(
        F.lit(0.5) + F.size(F.array_distinct(tokens)) / n * F.lit(0.5))


def uniform(key: Column, seed: int) -> Column:
    """In (0, 1), from the first 52 bits of an MD5 digest."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) \
        / F.lit(float(1 << 52))


def sized(docs: DataFrame, *, text: str, id: str, source: str, seed: int) -> DataFrame:
    """One narrow row per document: row, id, source, words, key, key range (0 is the top)."""
    row = free_name(docs, "__row")
    measured = let(words(F.col(f"`{text}`")), lambda w: F.struct(
        F.size(w).cast("long").alias("size"), quality(w).alias("q")))
    rows = with_row_id(docs, row).select(
        F.col(row).alias("row"), F.col(f"`{id}`").alias("id"),
        F.col(f"`{source}`").alias("source"), measured.alias("m"),
        uniform(F.col(f"`{id}`"), seed).alias("u"))
    rows = rows.select("row", "id", "source", F.col("m.size").alias("size"),
                       F.exp(F.log("u") / F.col("m.q")).alias("key"))
    return rows.withColumn("range", F.least(
        F.floor((F.lit(1.0) - F.col("key")) * RANGES), F.lit(RANGES - 1)).cast("int"))


def targets(rows: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """One row per source: its words and its target.

    Sources in the order of their code points, nulls last, take ``weights`` in turn and
    divide ``share`` of all words.  A target stops at ``most`` times its source's words and
    the excess goes to the others by weight.  The stopped sources are those with the least
    words per weight, so one pass over sources in that order finds them.
    """
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").cast("binary").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    ws = F.array(*[F.lit(float(w)) for w in weights])
    caps = per_source.withColumn("w", F.get(ws, turn)) \
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
    every = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("w"),
                           F.col("source").cast("binary").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = caps.select(
        "source", "source_size", "w", "cap",
        ((F.sum("source_size").over(every) * F.lit(float(share))
          - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
         / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
        .alias("level"))
    # The level rises while sources are stopped and falls from the first that is not.
    return level.select("source", "source_size", F.least(
        "cap", F.max("level").over(every) * F.col("w")).alias("target"))


def divided(rows: DataFrame, group: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of each source by groups in ascending order: those of groups that lie wholly
    inside or outside the rest of the budget, with ``more``, and those of the one group per
    source that holds its edge, with ``before`` moved to where the group begins."""
    words = rows.groupBy("source", *group).agg(
        F.sum("size").alias("words"), F.max("before").alias("before"), F.max("rest").alias("rest"))
    upto = F.col("before") + F.sum("words").over(
        Window.partitionBy("source").orderBy(*group).rowsBetween(Window.unboundedPreceding, 0))
    begins = F.col("upto") - F.col("words")
    # Sums only grow, so a source has one such group.
    held = words.withColumn("upto", upto).where(
        (begins <= F.col("rest")) & (F.col("upto") > F.col("rest"))).select(
        F.col("source").alias("_source"), begins.alias("_begins"),
        F.struct(*group).alias("_group"))
    met = rows.join(held, F.col("source").eqNullSafe(F.col("_source"))) \
        .withColumn("_mine", F.struct(*group))
    same = F.col("_mine").eqNullSafe(F.col("_group"))
    kept = [c for c in rows.columns if c != "before"]
    # Structs compare like the window sorts: field by field, nulls first.
    return (met.where(~same).select(*kept, "before",
                                    (F.col("_mine") < F.col("_group")).alias("more")),
            met.where(same).select(*kept, F.col("_begins").alias("before")))


def mix(docs: DataFrame, *, text: str = "text", id: str = "doc_id", source: str = "source",
        weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0,
        seed: int = 7) -> DataFrame:
    """One row per document: row, id, size, source_size, target, epochs, copies.

    ``copies`` is the number of complete epochs, and one more for documents in the
    fractional selection: those whose middle, in the order of keys, lies below what the
    budget still holds.  So a source misses its target by half a document at most.  Ties
    of keys are ordered by id, then by a hash of the row.  Null and empty texts have 0 words and are taken
    in epochs only; an empty table gives no rows.  Null sources are one source; a null id
    has a key like any other.
    """
    rows = written(sized(docs, text=text, id=id, source=source, seed=seed), "sized")
    same = F.col("r.source").eqNullSafe(F.col("b.source"))
    per_range = rows.groupBy("source", "range").agg(F.sum("size").alias("words"))
    goal = targets(rows, weights, share, most)
    upto = Window.partitionBy("source").orderBy("range")
    epochs = F.coalesce(F.floor(F.col("target") / F.nullif("source_size", F.lit(0))), F.lit(0)) \
        .cast("long")
    whole = (per_range.alias("r")
             .withColumn("upto", F.sum("words").over(upto))
             .join(goal.alias("b"), same)
             .select("r.source", "range", "source_size", "target", epochs.alias("epochs"),
                     (F.col("target") - epochs * F.col("source_size")).alias("rest"),
                     "upto", (F.col("upto") - F.col("words")).alias("before")))
    whole = written(whole, "ranges")
    placed = (rows.alias("r").join(
        whole.alias("b"), same & (F.col("r.range") == F.col("b.range")))
        .select("row", "id", "size", "key", F.col("r.source").alias("source"), "source_size",
                "target", "epochs", "rest", "upto", "before"))
    edge = (F.col("before") < F.col("rest")) & (F.col("upto") > F.col("rest"))
    others = placed.where(~edge).withColumn("more", F.col("upto") <= F.col("rest"))
    # Positions and numbers of files are the same when the rows are stored once more.
    number = F.regexp_extract(F.col("row")["file"], r"part-(\d+)", 1)
    at_edge = written(placed.where(edge).drop("upto").withColumns({
        "far": -F.col("key"), "tie": F.xxhash64(F.col("row")["at"], number)}), "edge").withColumn(
        "part", F.pmod("tie", F.lit(RANGES)))
    by_key, at_key = divided(at_edge, ["far", "id"])
    by_hash, at_hash = divided(at_key, ["part"])
    inside = Window.partitionBy("source").orderBy("tie", "row")
    sums = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    last = at_hash.withColumn(
        "more", F.col("before") + sums - F.col("size") / 2 < F.col("rest"))
    return others.unionByName(by_key, True).unionByName(by_hash, True) \
        .unionByName(last, True).select(
        "row", "id", "size", "source_size", "target", "epochs",
        (F.col("epochs") + (F.col("more") & (F.col("size") > 0)).cast("long")).alias("copies"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; same columns."""
    docs = as_scan(docs)
    row, n = free_name(docs, "__row"), free_name(docs, "__copies")
    taken = mix(docs, **how).where(F.col("copies") > 0).select(
        F.col("row").alias(row), F.col("copies").cast("int").alias(n))
    return (with_row_id(docs, row).join(taken, row)
            .withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n))))
            .select([F.col(f"`{c}`") for c in docs.columns]))


def op9(docs: DataFrame) -> DataFrame:
    return mix(docs).select(F.col("id").alias("doc_id"), "size", "source_size", "target",
                            (F.col("copies") * F.col("size")).alias("taken"))


def sql(rows: str = "documents", weights: Sequence[float] = WEIGHTS, share: float = 1.5,
        most: float = 2.0, seed: int = 7) -> str:
    """CTEs up to ``mix_rows``: each row of ``rows`` with size, source_size, target, copies."""
    turn = " ".join(f"WHEN {k} THEN {float(w)}::DOUBLE" for k, w in enumerate(weights))
    return f"""
w AS (SELECT *, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0b\\x0c\\r]+'),
                            lambda x: x <> '') AS ws FROM {rows}),
m AS (SELECT * EXCLUDE (ws), len(ws)::BIGINT AS size,
      exp(ln((('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT
              + 0.5::DOUBLE) / {float(1 << 52)}::DOUBLE)
          / CASE WHEN len(ws) = 0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE
            + len(list_distinct(ws))::DOUBLE / len(ws)::DOUBLE * 0.5::DOUBLE END) AS key
      FROM w),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM m GROUP BY source),
c AS (SELECT *, CASE (row_number() OVER (ORDER BY source::BLOB NULLS LAST) - 1)
                     % {len(weights)} {turn} END AS wt,
      source_size * {float(most)}::DOUBLE AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () * {float(share)}::DOUBLE
                 - coalesce(sum(cap) OVER b, 0::DOUBLE))
                / (sum(wt) OVER () - coalesce(sum(wt) OVER b, 0::DOUBLE)) AS level
      FROM c WINDOW b AS (ORDER BY cap / wt, source::BLOB NULLS LAST
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap, max(level) OVER () * wt) AS target FROM l),
j AS (SELECT m.*, source_size, target,
      coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS epochs,
      sum(size) OVER (PARTITION BY m.source ORDER BY key DESC, doc_id
                      ROWS UNBOUNDED PRECEDING) AS upto
      FROM m JOIN t ON m.source IS NOT DISTINCT FROM t.source),
mix_rows AS (SELECT * EXCLUDE (key, upto, epochs), epochs + CASE WHEN size > 0
      AND upto - size / 2.0::DOUBLE < target - epochs * source_size
      THEN 1 ELSE 0 END AS copies FROM j)"""


SQL = f"""WITH {sql()}
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken FROM mix_rows"""
