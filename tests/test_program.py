import pytest
from pyspark.sql import functions as F

from edgeframe import V, random_coo
from edgeframe.plans import EdgeProgram


class System(EdgeProgram):
    def __init__(self, edges, x, rows):
        super().__init__(edges, keep=["edge_id"])
        self.x_table, self.rows = x, rows

    def forward(self):
        x = self.vertices(self.x_table, "a", "b")
        r1, r2 = self.selector("col_1")(x), self.selector("col_2")(x)
        pair = self.edge("pair_0", "pair_1")
        six = self.edge(*[f"six_{i}" for i in range(6)])
        self.output("y1", r1 + r2 + pair)
        self.output("y2", r1 + r2 + six)
        self.output("s1", self.reducer("row", self.rows)(r1 + r2 + pair))
        self.output("s2", self.reducer("row", self.rows)(r1[0]))
        self.output("t", self.total(self.selector("col_1")(x.map(lambda v: 2 * v))[1]))


@pytest.fixture(scope="module")
def inputs(spark):
    x = spark.range(11).select("id", (F.col("id") * 0.5).alias("a"), (10.0 - F.col("id")).alias("b"))
    return random_coo(spark, 11, 11, 20).cache(), x


def test_program_matches_a_loop(inputs):
    edges, x = inputs
    result = System(edges, x, 11).run()
    at = {r["id"]: (r["a"], r["b"]) for r in x.collect()}
    y1, y2, s1, total = {}, {}, {r: [0.0, 0.0, 0.0] for r in range(11)}, 0.0
    for e in edges.collect():
        u, w = at[e["col_1"]], at[e["col_2"]]
        r = [u[k] + w[k] for k in range(2)]
        y1[e["edge_id"]] = [r[k] + e[f"pair_{k}"] for k in range(2)]
        y2[e["edge_id"]] = [r[k % 2] + e[f"six_{k}"] for k in range(6)]
        for k in range(2):
            s1[e["row"]][k] += y1[e["edge_id"]][k]
        s1[e["row"]][2] += u[0]
        total += 2 * u[1]
    for r in result.maps.collect():
        assert [r["y1_0"], r["y1_1"]] == y1[r["edge_id"]]
        assert [r[f"y2_{k}"] for k in range(6)] == y2[r["edge_id"]]
    for r in result.rows["row"].collect():
        assert [r["s1_0"], r["s1_1"], r["s2"]] == pytest.approx(s1[r["id"]])
    assert result.totals.first()["t"] == pytest.approx(total)


def test_persisted_edges_give_the_same(inputs):
    edges, x = inputs
    a, b = System(edges, x, 11).run(), System(edges, x, 11).run(persist=True)
    assert sorted(map(tuple, a.maps.collect())) == sorted(map(tuple, b.maps.collect()))
    b.unpersist()


def test_gathers_share_joins_and_sums_share_a_shuffle(inputs):
    edges, x = inputs
    result = System(edges, x, 11).run()
    plan = result.rows["row"]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 2   # the mapped value comes with the first selector
    physical = result.rows["row"]._jdf.queryExecution().executedPlan().toString()
    assert physical.count("Exchange hashpartitioning") <= 1


def test_mistakes_show_before_any_job(inputs):
    edges, x = inputs

    class Bad(EdgeProgram):
        def forward(self):
            self.edge("pair_0").cosine()

    class Twice(EdgeProgram):
        def forward(self):
            self.output("y", self.edge("pair_0"))
            self.output("y", self.edge("pair_1"))

    class NoColumn(EdgeProgram):
        def forward(self):
            self.selector("col_9")

    class Wrong(EdgeProgram):
        def forward(self):
            self.output("y", F.lit(1))

    for kind, error in ((Bad, ValueError), (Twice, ValueError), (NoColumn, ValueError),
                        (Wrong, TypeError), (EdgeProgram, NotImplementedError)):
        with pytest.raises(error):
            kind(edges).run()
    with pytest.raises(TypeError):
        EdgeProgram(edges).selector("col_1")(V.of("pair_0"))
