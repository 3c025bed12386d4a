import random

import pytest

from edgeframe.sources import read_offsets, read_rows, store_rows

g = random.Random(6)
# A third of the edges belongs to row 40; some edges are equal.
EDGES = sorted((40 if g.random() < 0.33 else g.randrange(100), g.randrange(30))
               for _ in range(4000))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("rows") / "s")
    mixed = EDGES[:]
    g.shuffle(mixed)
    store_rows(spark.createDataFrame(mixed, "r bigint, c bigint"), path, "r", ["c"], files=12)
    return path


@pytest.mark.parametrize("start,stop", [(0, 100), (0, 3), (39, 41), (40, 41), (97, 200), (7, 7)])
def test_slices(spark, stored, start, stop):
    got = read_rows(spark, stored, start, stop, "pos").collect()
    want = [(r, c, i) for i, (r, c) in enumerate(EDGES) if start <= r < stop]
    assert sorted((r.r, r.c, r.pos) for r in got) == want
    assert sorted((r.r, r.c) for r in read_rows(spark, stored, start, stop).collect()) == [
        w[:2] for w in want]
    ends = {}
    for r, _, i in want:
        ends[r] = (ends.get(r, (i,))[0], i + 1)
    assert {r.row: (r.start, r.end) for r in read_offsets(spark, stored, start, stop).collect()} \
        == ends


def test_only_files_of_the_slice(spark, stored):
    every = len(read_rows(spark, stored, 0, 100).inputFiles())
    few = read_rows(spark, stored, 2, 4)
    assert every >= 8 and len(few.inputFiles()) <= 2
    assert "PushedFilters: [IsNotNull(r), GreaterThanOrEqual(r,2), LessThan(r,4)]" in \
        few._jdf.queryExecution().executedPlan().toString()
    assert len(read_rows(spark, stored, 40, 41).inputFiles()) >= 4     # the hot row is spread


def test_odd_edges(spark, tmp_path):
    rows = [(None, 1), (2, None), (2, None), (0, 5)]
    store_rows(spark.createDataFrame(rows, "r int, c int"), str(tmp_path / "a"), "r")
    got = read_rows(spark, str(tmp_path / "a"), -5, 9, "pos").collect()
    assert sorted((r.r, r.c or 0, r.pos) for r in got) == [(0, 5, 1), (2, 0, 2), (2, 0, 3)]
    with pytest.raises(ValueError, match="already"):
        read_rows(spark, str(tmp_path / "a"), 0, 9, "c")
    store_rows(spark.createDataFrame([], "r int, c int"), str(tmp_path / "b"), "r")
    empty = read_rows(spark, str(tmp_path / "b"), 0, 9, "pos")
    assert empty.columns == ["r", "c", "pos"] and empty.count() == 0
    assert read_offsets(spark, str(tmp_path / "b"), 0, 9).count() == 0
