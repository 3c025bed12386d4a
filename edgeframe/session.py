"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

PARTITION_BYTES = 128 << 20
UNKNOWN = (1 << 63) - 1     # Spark's size of a table it has no figures for

_own_roots: dict[str, str] = {}
_scopes: list[list[str]] = []


def make_session(master: str, app: str = "edgeframe", **conf: str) -> SparkSession:
    """A session with the settings the operators are written for."""
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Split skewed joins even where a sum by the same key then needs its own shuffle.
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        # Hash instead of sort where a shuffled vertex partition is measured to be small.
        .config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64MB")
        # Join stored edges where their part lies: part and index are the join's keys, the
        # part alone is what the tables are placed by.
        .config("spark.sql.requireAllClusterKeysForCoPartition", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        # Recording the caller of every column operation makes building a plan slow.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def size_shuffles(spark: SparkSession, input_bytes: int) -> int:
    """Start shuffles with a partition per ``PARTITION_BYTES``; adaptive execution merges
    small ones but never splits a partition that holds many keys."""
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")),
            -(-input_bytes // PARTITION_BYTES))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(n))
    return n


@contextmanager
def sized_shuffles(spark: SparkSession, input_bytes: int) -> Iterator[int]:
    """``size_shuffles`` for what runs inside the block; the setting is as before behind it."""
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    before = spark.conf.get(key, None)
    try:
        yield size_shuffles(spark, input_bytes)
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def estimated_bytes(df: DataFrame) -> int:
    """Spark's own size estimate of the optimized plan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def leaf_bytes(df: DataFrame) -> int:
    """Bytes of the tables that ``df`` is made of.  Spark's estimate of a join is the product
    of its sides; gathers and sums give no more rows than they read, so the sum is nearer.
    A leaf that Spark knows nothing about (it says 2^63 - 1) counts as nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    return sum(n for n in sizes if n < UNKNOWN)


def broadcast_limit(spark: SparkSession) -> int:
    """Bytes up to which Spark broadcasts a table, -1 for never."""
    return spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()


def is_scan(df: DataFrame) -> bool:
    """Is ``df`` a scan of parquet files with at most projections and filters on top, so
    that file and position tell its rows apart?"""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return "parquet" in plan.simpleString(100).lower() and "Relation" in plan.simpleString(100)


def shuffle_partitions(spark: SparkSession) -> int:
    """Partitions a shuffle starts with."""
    first = spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None)
    return int(first or spark.conf.get("spark.sql.shuffle.partitions"))


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Only a local session, whose executors are this machine, falls back to a temporary
    folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_roots:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        _own_roots[app] = tempfile.mkdtemp(prefix="edgeframe-")
    return _own_roots[app]


def written_path(spark: SparkSession, name: str) -> str:
    app = spark.sparkContext.applicationId
    path = f"{shared_root(spark)}/edgeframe/{app}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


@contextmanager
def stored_tables(spark: SparkSession) -> Iterator[list[str]]:
    """Owns the intermediate tables stored inside the block and deletes them at its end,
    so results that read them are to be written before."""
    _scopes.append([])
    try:
        yield _scopes[-1]
    finally:
        for path in _scopes.pop():
            discard(spark, path)


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` stored as a parquet table in the shared folder and read back.

    Cuts the lineage, survives the loss of executors, fixes the outcome of anything
    that depends on partition order, and gives later plans real sizes and pruning.
    """
    spark = df.sparkSession
    path = path or written_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table this application has stored and no plan reads any more."""
    if f"/edgeframe/{spark.sparkContext.applicationId}/" not in path:
        raise ValueError(f"{path} is not an intermediate table of this application")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
