"""Declared nodes: every shape, tick by tick, against one evaluation over the net rows."""

import random

import pytest
from pyspark.sql import functions as F

from quiltrel.operators import algebra as A
from quiltrel.operators.relation import Rel
from quiltrel.sources.ingest import ingest, ingest_delta
from quiltrel.streaming import nodes as N

#: name -> nodes as (name, node, inputs); the last one is the shape's result
D_ = N.DeltaNode
SHAPES = {
    "select": [("se", D_("select", predicate="x > 0"), "a")],
    "project": [("pr", D_("project", columns=["k"]), "a")],
    "map": [("ma", D_("map_rows", cells={"k": "k", "y": "x * 2"}), "a")],
    "union": [("um", D_("map_rows", cells={"k": "k", "x": "z"}), "b"), ("un", D_("union"), "a", "um")],
    "join": [("jo", D_("join", on=["k"]), "a", "b")],
    "join-project": [("jp", D_("project", columns=["z"]), "jo")],
    "distinct": [("di", D_("distinct"), "pr")],
    "distinct-join": [("dj", D_("join", on=["k"]), "di", "b")],
    "anti": [("an", D_("anti_join", on=["k"]), "a", "b")],
    "anti-project": [("ap", D_("project", columns=["k"]), "an")],
    "sum": [("su", D_("aggregate", by=["k"], algebra="sum-long", value="x", into="s"), "a")],
    "sum-of-join": [("sj", D_("aggregate", by=["z"], algebra="sum-long", value="x", into="s"), "jo")],
    "max": [("mx", D_("aggregate", by=["k"], algebra="max", value="x", into="m"), "a")],
    "count-select": [("co", D_("aggregate", by=["k"], algebra="count", value="1", into="n"), "a"), ("cs", D_("select", predicate="n > 1"), "co")],
}


def positive(row):
    return row["x"] > 0


N.register_predicate("positive", positive)


def test_registered_predicate(spark):
    rel = Rel.of(spark.createDataFrame([(1, 2), (1, -2)], "k long, x long"))
    assert shown(D_("select", predicate="positive").run(rel), True) == [(1, 2, 1)]
    assert D_("select", predicate="positive").descriptor != D_("select", predicate="x > 0").descriptor


@pytest.fixture(autouse=True, scope="module")
def interpreted(spark):
    """A few rows a table: compiling each plan would take most of the time."""
    own = {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "2"}
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shown(rel, why):
    return sorted(map(tuple, (rel if why else rel.without("Why")).annotated().collect()), key=str)


@pytest.fixture(scope="module")
def stream():
    """Ticks of (table, row, signed count) and the net rows: arrivals, partial and full retractions, returns."""
    rng, net, ticks = random.Random(3), {"a": {}, "b": {}}, []
    for _ in range(2):
        tick = {"a": [], "b": []}
        for t, held in net.items():
            moves = {}
            for row, n in list(held.items()):
                if rng.random() < 0.4:
                    moves[row] = -rng.randint(1, n)
            for _ in range(4):
                row = (rng.randint(0, 3), rng.choice([-2, 0, 1, 3]))
                moves[row] = moves.get(row, 0) + rng.randint(1, 3)
            for row, n in moves.items():
                if n:
                    tick[t].append((*row, n))
                    held[row] = held.get(row, 0) + n
                    if not held[row]:
                        del held[row]
        ticks.append(tick)
    return ticks, net


def test_ticks_equal_one_evaluation(spark, tmp_path, stream):
    ticks, net = stream
    plan = N.Plan().add("a", D_("source", schema=["k", "x"])).add("b", D_("source", schema=["k", "z"]))
    for nodes in SHAPES.values():
        for name, node, *inputs in nodes:
            plan.add(name, node, *inputs)
    assert set(plan.anew()) == {"di", "an", "ap", "mx"}
    view = N.Maintained(spark, str(tmp_path), plan)
    types = {"a": "k long, x long, occ long", "b": "k long, z long, occ long"}
    for i, tick in enumerate(ticks):
        step = view.advance({t: spark.createDataFrame(tick[t], types[t]) for t in tick}, i)
        assert step.rebuilt
    whole = {t: ingest_delta(t, spark.createDataFrame([(*row, n) for row, n in held.items()], types[t])) for t, held in net.items()}
    want = plan.evaluate(whole)
    for shape, nodes in SHAPES.items():
        out = nodes[-1][0]
        assert shown(view.integral(out), True) == shown(want[out], True), shape
    again = view.advance({}, len(ticks) - 1)
    assert not again.rebuilt and again.step == step.step


def test_snapshots_are_made_now_and_then(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(N, "COMPACT", 2)
    plan = N.Plan().add("a", N.DeltaNode("source", schema=["k"])).add("out", N.DeltaNode("project", columns=["k"]), "a")
    view = N.Maintained(spark, str(tmp_path), plan)
    for i in range(3):
        view.advance({"a": spark.createDataFrame([(i, 1)], "k long, occ long")}, i)
    assert view.files.names("out/snap") == ["000000001"]
    assert [r[0] for r in shown(view.integral("out"), False)] == list(range(3))


def test_streaming_feed(spark, tmp_path):
    for i in range(2):
        spark.createDataFrame([(j, 1) for j in range(i, i + 2)], "k long, occ long").coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
    plan = N.Plan().add("a", N.DeltaNode("source", schema=["k"])).add("out", N.DeltaNode("distinct"), "a")
    feed = spark.readStream.schema("k long, occ long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "feed"))
    view = N.Maintained(spark, str(tmp_path / "state"), plan)
    view.run(feed, "a", str(tmp_path / "checkpoint"))
    assert view.last() == 1 and [r[:2] for r in shown(view.integral("out"), False)] == [(k, 1) for k in range(3)]
    view.run(feed, "a", str(tmp_path / "checkpoint"))
    assert view.last() == 1


def test_refused(spark, tmp_path):
    for bad in (lambda: N.DeltaNode("sort", by=["k"]), lambda: N.DeltaNode("project", columns=[]), lambda: N.DeltaNode("join"), lambda: N.register_predicate("l", lambda r: True), lambda: N.register_group("m", A.MIN)):
        with pytest.raises(N.NodeRefused):
            bad()
    assert N.binary_operators() == {"union", "join", "anti_join"} and N.required_params("join") == ("on",)
    plan = N.Plan().add("a", N.DeltaNode("source", schema=["k"]))
    view = N.Maintained(spark, str(tmp_path), plan)
    with pytest.raises(N.TickRefused):
        view.advance({"a": spark.createDataFrame([(1, 1)], "k long, occ long")}, 1)
    with pytest.raises(Exception, match="retracted"):
        view.advance({"a": spark.createDataFrame([(1, 1)], "k long, occ long")}, 0)
        view.advance({"a": spark.createDataFrame([(1, -2)], "k long, occ long")}, 1)
    assert N.DeltaNode("join", on=["b", "a"]).descriptor == N.DeltaNode("join", on=["a", "b"]).descriptor


def test_ingest_delta_checks_counts(spark):
    good = ingest_delta("s", spark.createDataFrame([(1, 2)], "k long, occ long"), spark.createDataFrame([(2,)], "k long"))
    assert [r[:2] for r in shown(good, True)] == [(1, 2), (2, -1)]
    own = ingest(spark.createDataFrame([(1,)], "k long"), "s")
    assert own.df.first()["__w"] == good.df.where("k = 1").first()["__w"]
    with pytest.raises(Exception, match="occ"):
        ingest_delta("s", spark.createDataFrame([(1, 0)], "k long, occ long")).df.collect()
    assert isinstance(own, Rel) and own.df.select(F.col("k")).count() == 1
