"""Snapshots of several tables as base tables, deltas and one commit file per step.

A step is there when its commit file is: the tables of a step are written under names of
their own attempt first, and the file that lists them is moved into place last, so a crash
in between leaves nothing that ``restore`` sees.  A table of a later step is a delta, the
rows that are new or changed and the ids that are gone, until so many deltas have gathered that
it is written whole again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

DELTAS = 8      # deltas of a table before it is written whole


@dataclass(frozen=True)
class Snapshots:
    """Snapshots under ``path``; ``ids`` names the id column of every table."""

    spark: SparkSession
    path: str
    ids: Mapping[str, str]
    deltas: int = DELTAS

    def steps(self) -> list[int]:
        """Committed steps, in order."""
        files, folder = self._files()
        if not files.exists(folder):
            return []
        names = (f.getPath().getName() for f in files.listStatus(folder))
        return sorted(int(n[5:-5]) for n in names if n.startswith("step-") and n.endswith(".json"))

    def commit(self, step: int, state: Mapping[str, DataFrame]) -> None:
        """Save all tables of a step; a step is committed once, behind all others."""
        if set(state) != set(self.ids):
            raise ValueError(f"a step holds the tables {sorted(self.ids)}")
        known = self.steps()
        if known and step <= known[-1]:
            raise ValueError(f"step {step} is not behind step {known[-1]}")
        last = self._manifest(known[-1]) if known else {}
        made = {}
        for name, df in state.items():
            parts = last.get(name, [])
            at = f"{name}/{step}-{uuid.uuid4().hex}"
            schema = df.schema.json()
            if not parts or len(parts) > self.deltas or parts[0]["schema"] != schema:
                df.write.parquet(f"{self.path}/{at}")
                parts = []
            else:
                self._delta(name, self._table(name, parts), df).write.parquet(f"{self.path}/{at}")
            made[name] = [*parts, {"at": at, "schema": schema}]
        self._write(step, made)

    def restore(self, step: int) -> dict[str, DataFrame]:
        """All tables as committed at ``step``."""
        if step not in self.steps():
            raise ValueError(f"step {step} was not committed")
        return {n: self._table(n, parts) for n, parts in self._manifest(step).items()}

    # ---- tables ------------------------------------------------------------------

    def _delta(self, name: str, before: DataFrame, now: DataFrame) -> DataFrame:
        """Rows of ``now`` that are not in ``before``, and ids that are gone (``_gone``)."""
        id = self.ids[name]
        rest = [c for c in now.columns if c != id]
        old = before.select(F.col(id).alias("_old_id"), F.struct(*rest).alias("_old"))
        new = now.select(F.col(id).alias("_new_id"), F.struct(*rest).alias("_new"))
        met = new.join(old, F.col("_new_id") == F.col("_old_id"), "full_outer")
        gone = F.col("_new_id").isNull()
        changed = met.where(gone | F.col("_old_id").isNull() | ~F.col("_new").eqNullSafe(F.col("_old")))
        return changed.select(F.coalesce("_new_id", "_old_id").alias(id),
                              *[F.col(f"_new.{c}").alias(c) for c in rest], gone.alias("_gone"))

    def _table(self, name: str, parts: list[dict]) -> DataFrame:
        """A base with its deltas: of each id the row of the last part that has it."""
        from pyspark.sql.types import StructType

        id = self.ids[name]
        schema = StructType.fromJson(json.loads(parts[0]["schema"]))
        base, *later = [self.spark.read.parquet(f"{self.path}/{p['at']}") for p in parts]
        base = base.select(schema.names)
        if not later:
            return base
        rest = [c for c in schema.names if c != id]
        versions = base.withColumns({"_gone": F.lit(False), "_part": F.lit(0)})
        for k, delta in enumerate(later, 1):
            versions = versions.unionByName(delta.withColumn("_part", F.lit(k)))
        last = versions.groupBy(id).agg(F.max_by(F.struct(*rest, "_gone"), "_part").alias("_last"))
        return last.where(~F.col("_last._gone")).select(
            *[F.col(id) if c == id else F.col(f"_last.{c}").alias(c) for c in schema.names])

    # ---- commit files --------------------------------------------------------------

    def _files(self):
        jvm = self.spark._jvm.org.apache.hadoop.fs
        folder = jvm.Path(f"{self.path}/_commits")
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()), folder

    def _write(self, step: int, made: dict) -> None:
        files, folder = self._files()
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        own = path(folder, f".{uuid.uuid4().hex}")
        out = files.create(own)
        out.write(bytearray(json.dumps(made).encode()))
        out.close()
        if not files.rename(own, path(folder, f"step-{step:012d}.json")):
            raise RuntimeError(f"step {step} was committed by another run")

    def _manifest(self, step: int) -> dict:
        _, folder = self._files()
        lines = self.spark.read.text(f"{folder.toString()}/step-{step:012d}.json", wholetext=True)
        return json.loads(lines.first()[0])
