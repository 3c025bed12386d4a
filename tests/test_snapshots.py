"""Snapshots with commit files: any step comes back, a broken one is not there."""

import pytest

from edgeframe.sources import Snapshots


def state(spark, k):
    rows = [(i, i * (k if i % 3 == 0 else 1), None if i % 4 == k % 4 else "x")
            for i in range(20) if i % 6 != k]
    return {"a": spark.createDataFrame(rows, "id bigint, v bigint, s string"),
            "b": spark.createDataFrame([(k,), (7,)], "key bigint").selectExpr("key", "key * 2 AS w")}


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("deltas", [0, 2, 8])
def test_every_step_comes_back(spark, tmp_path, deltas):
    log = Snapshots(spark, str(tmp_path / "log"), {"a": "id", "b": "key"}, deltas)
    assert log.steps() == []
    for k in (1, 2, 3, 5, 8):
        log.commit(k, state(spark, k))
    again = Snapshots(spark, str(tmp_path / "log"), {"a": "id", "b": "key"}, deltas)
    assert again.steps() == [1, 2, 3, 5, 8]
    for k in again.steps():
        for name, df in again.restore(k).items():
            assert df.columns == state(spark, k)[name].columns
            assert rows(df) == rows(state(spark, k)[name])


def test_a_crash_between_two_tables_is_not_seen(spark, tmp_path):
    log = Snapshots(spark, str(tmp_path / "log"), {"a": "id", "b": "key"})
    log.commit(1, state(spark, 1))
    broken = state(spark, 2)
    broken["b"] = broken["b"].selectExpr("key", "CAST(raise_error('lost') AS bigint) AS w")
    with pytest.raises(Exception, match="lost"):
        log.commit(2, broken)
    assert log.steps() == [1]
    with pytest.raises(ValueError, match="not committed"):
        log.restore(2)
    log.commit(2, state(spark, 2))
    assert rows(log.restore(2)["a"]) == rows(state(spark, 2)["a"])
    assert rows(log.restore(1)["a"]) == rows(state(spark, 1)["a"])


def test_a_delta_holds_what_changed(spark, tmp_path):
    log = Snapshots(spark, str(tmp_path / "log"), {"a": "id"})
    first = spark.range(1000).selectExpr("id", "id * 2 AS v")
    log.commit(0, {"a": first})
    log.commit(1, {"a": first.selectExpr("id", "IF(id = 7, 0, v) AS v").where("id <> 9")})
    part = log._manifest(1)["a"][-1]["at"]
    assert rows(spark.read.parquet(f"{tmp_path}/log/{part}")) == [(7, 0, False), (9, None, True)]
    assert log.restore(1)["a"].count() == 999


def test_steps_are_committed_in_order(spark, tmp_path):
    log = Snapshots(spark, str(tmp_path / "log"), {"a": "id", "b": "key"})
    log.commit(3, state(spark, 3))
    with pytest.raises(ValueError, match="not behind"):
        log.commit(3, state(spark, 3))
    with pytest.raises(ValueError, match="holds the tables"):
        log.commit(4, {"a": state(spark, 4)["a"]})
