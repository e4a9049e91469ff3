"""Plans maintained in counts: every shape, tick by tick, against one evaluation over the net rows."""

import random

import duckdb
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from test_nodes import D_, SHAPES, interpreted, shown  # noqa: F401

from quiltrel import catalogue
from quiltrel.functions import semiring as S
from quiltrel.operators.relation import Rel
from quiltrel.streaming import nodes as N

TYPES = {"a": "k long, x long, occ long", "b": "k long, z long, occ long"}


def feeds(spark, tick):
    return {t: spark.createDataFrame(rows, TYPES[t]) for t, rows in tick.items()}


def test_ticks_in_counts_equal_one_evaluation(spark, tmp_path):
    """Null keys, full and partial retractions, ticks in which one source or none has a feed."""
    rng, net = random.Random(5), {"a": {}, "b": {}}
    plan = N.Plan().add("a", D_("source", schema=["k", "x"])).add("b", D_("source", schema=["k", "z"]))
    for nodes in SHAPES.values():
        for name, node, *inputs in nodes:
            plan.add(name, node, *inputs)
    assert set(plan.anew(S.Z)) == {"mx"}
    view = N.Maintained(spark, str(tmp_path), plan, S.Z)
    for i, which in enumerate(("ab", "b", "", "ab")):
        tick = {}
        for t in which:
            moves = {row: -rng.randint(1, n) for row, n in net[t].items() if rng.random() < 0.6}
            for _ in range(4):
                row = (rng.choice([None, 0, 1, 2, 3]), rng.choice([-2, 0, 1, 3]))
                moves[row] = moves.get(row, 0) + rng.randint(1, 2)
            tick[t] = [(*row, n) for row, n in moves.items()]
            for row, n in moves.items():
                net[t][row] = net[t].get(row, 0) + n
            net[t] = {row: n for row, n in net[t].items() if n}
        view.advance(feeds(spark, tick), i)
        if i == 2:
            continue
        whole = {}
        for t, df in feeds(spark, {t: [(*row, n) for row, n in held.items()] for t, held in net.items()}).items():
            whole[t] = Rel.of(df.drop("occ"), unique=True)
            whole[t] = Rel(df.withColumnRenamed("occ", "__n"), whole[t].schema, S.Z)
        want = plan.evaluate(whole)
        for name in plan.nodes:
            got = view.integral(name)
            assert "__w" not in got.df.columns
            assert sorted(map(tuple, got.annotated().collect()), key=str) == sorted(map(tuple, want[name].annotated().collect()), key=str), (i, name)


def test_more_retracted_than_there_was(spark, tmp_path):
    plan = N.Plan().add("a", N.DeltaNode("source", schema=["k"])).add("out", N.DeltaNode("project", columns=["k"]), "a")
    feed = lambda *rows: {"a": spark.createDataFrame(list(rows), "k long, occ long")}
    with pytest.raises(N.TickRefused, match="retracted"):
        N.Maintained(spark, str(tmp_path / "0"), plan, S.Z).advance(feed((1, -1)), 0)
    view = N.Maintained(spark, str(tmp_path / "1"), plan, S.Z)
    view.advance(feed((1, 2), (None, 1)), 0)
    with pytest.raises(N.TickRefused, match="retracted"):
        view.advance(feed((1, -3)), 1)
    with pytest.raises(N.TickRefused, match="retracted"):
        view.advance(feed((2, -1)), 1)
    view.advance(feed((1, -2), (None, -1), (3, 1)), 1)
    assert list(map(tuple, view.integral("out").annotated().collect())) == [(3, 1)]


def test_counts_and_provenance_have_states_of_their_own(spark, tmp_path):
    plan = N.Plan().add("a", N.DeltaNode("source", schema=["k"]))
    for semiring in (S.Z, S.ZxWhy):
        N.Maintained(spark, str(tmp_path), plan, semiring).advance({"a": spark.createDataFrame([(1, 2)], "k long, occ long")}, 0)
    assert shown(N.Maintained(spark, str(tmp_path), plan).integral("a"), False) == [(1, 2)]
    with pytest.raises(N.NodeRefused):
        N.Maintained(spark, str(tmp_path), plan, S.Why)


def test_a_sum_of_many_supports_is_not_quadratic(spark):
    """array_distinct compared every pair of supports."""
    df = spark.range(40_000).select(F.lit(1).alias("k"), F.lit(1).cast("long").alias("__n"), F.array(F.array(F.sha2(F.col("id").cast("string"), 256))).alias("__w"))
    rows = df.union(df.where("__n = 1")).groupBy("k").agg(S.add("Why", "__w"))
    plan = rows._jdf.queryExecution().analyzed().toString()
    assert "array_distinct" not in plan
    assert rows.select(F.size("__w"), F.size(F.array_distinct(F.transform("__w", lambda s: s[0])))).first()[:] == (40_000, 40_000)


#: queries whose results are counts: their ticks make no refs
COUNTED = ("stream_distinct_ticks", "stream_orders_ticks", "stream_subtractive_ticks", "stream_bilinear_ticks", "stream_anti_join_ticks", "stream_linear_ticks")


@pytest.mark.parametrize("name", COUNTED)
def test_query_keeps_no_refs(spark, tmp_path, monkeypatch, name):
    d = "/root/testdata/sf0.001"
    monkeypatch.setattr(catalogue, "fresh_folder", lambda spark, label: str(tmp_path))
    df = catalogue.QUERIES[name](spark, d)
    con = duckdb.connect()
    for t in ("orders", "customer"):
        con.execute(f"create view {t} as select * from read_parquet('{d}/{t}.parquet')")
    want = con.execute(catalogue.ORACLES[name])
    cols = [c[0] for c in want.description]
    assert sorted(tuple(map(str, r)) for r in df.select(*cols).collect()) == sorted(tuple(map(str, r)) for r in want.fetchall())
    stored = list(tmp_path.rglob("*.parquet"))
    assert stored and not any("__w" in pq.read_schema(p).names for p in stored)
