import pytest
from pyspark.sql import functions as F

from quiltrel.functions import semiring as S
from quiltrel.operators import algebra as A
from quiltrel.operators.relation import OperatorRefused, Rel
from quiltrel.streaming import delta as D


def rows(rel):
    return sorted(map(tuple, rel.annotated().collect()), key=str)


@pytest.fixture(scope="module")
def ab(spark):
    a = spark.createDataFrame([(1, 10), (1, 10), (None, 5), (2, -3)], "k long, x long")
    b = spark.createDataFrame([(None, 7), (1, 8)], "k long, y long")
    return Rel.of(a), Rel.of(b)


def test_join_and_anti_join_match_nulls(ab):
    a, b = ab
    assert rows(a.join(b, ["k"])) == [(1, 10, 8, 2), (None, 5, 7, 1)]
    assert rows(a.anti_join(b, ["k"])) == [(2, -3, 1)]


def test_null_value_quarantines_the_group(ab):
    a, _ = ab
    out = a.map_rows({"g": F.lit(1), "x": F.when(F.col("x") > 0, F.col("x"))}).aggregate(["g"], A.SUM, F.col("x"), "s")
    assert rows(out) == []
    assert out.quarantine().count() == 3


def test_refusals(ab):
    a, b = ab
    for bad in (lambda: a.union(b), lambda: a.project(["z"]), lambda: a.join(a, ["k"]), lambda: a.aggregate([], A.SUM, F.col("x"), "s")):
        with pytest.raises(OperatorRefused):
            bad()


def test_antichain_and_deletion(spark):
    df = spark.createDataFrame([(1, "p"), (1, "q")], "k long, ref string")
    r = Rel.of(df, S.ZxWhy, refs=F.col("ref"))
    p = r.project(["k"])
    assert rows(p) == [(1, 2, "p;q")]
    assert rows(p.join(p, ["k"])) == [(1, 4, "p;q")]
    left = D.without_dead(p, spark.createDataFrame([("p",)], "ref string"))
    assert rows(left) == [(1, 2, "q")]


def test_diff_then_apply_is_identity(ab, spark):
    a, _ = ab
    b = Rel.of(spark.createDataFrame([(1, 10), (9, 9)], "k long, x long"))
    assert rows(D.apply(b, D.diff(a, b))) == rows(a)


def test_over_retraction_is_refused(ab):
    a, _ = ab
    with pytest.raises(Exception, match="retracted"):
        D.apply(a, D.negate(a.union(a))).df.collect()


def test_late_merging_gives_the_same_relations(ab, spark):
    a, b = ab
    c = Rel.of(spark.createDataFrame([(1, 10), (4, 4)], "k long, x long"))
    late = a.union(c).select(F.col("x") > 0).join(b, ["k"]).project(["k", "y"])
    soon = a.consolidated().union(c.consolidated()).consolidated().select(F.col("x") > 0).join(b.consolidated(), ["k"]).consolidated().project(["k", "y"])
    assert rows(late) == rows(soon) == [(1, 8, 3), (None, 7, 1)]
    assert sorted(late.to_bag().collect(), key=str) == sorted(soon.consolidated().to_bag().collect(), key=str)


def test_plans_hold_no_needless_exchange(spark):
    d = "/root/testdata/sf0.001"
    import __spark_entry__ as entry

    def exchanges(name):
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            return entry.queries()[name](spark, d)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

    assert [exchanges(n) for n in ("select_gt", "project_one", "agg_two_keys")] == [0, 0, 1]
    assert exchanges("revenue_by_segment") <= 5


def test_a_hot_row_is_repeated_in_chunks(spark):
    r = Rel.of(spark.createDataFrame([(1, 25_003), (2, 1)], "k long, m long").select("k"), counts=F.when(F.col("k") == 1, 25_003).otherwise(1))
    assert dict(r.to_bag().groupBy("k").count().collect()) == {1: 25_003, 2: 1}


def test_addresses_tell_relations_apart(ab, spark):
    a, _ = ab
    same = Rel.of(a.to_bag().repartition(3))
    assert a.address() == same.address() != a.union(a).address()
    big = Rel.of(spark.range(3000).withColumnRenamed("id", "k"))
    other = Rel.of(spark.range(3000).select(F.when(F.col("id") == 77, 3000).otherwise(F.col("id")).alias("k")))
    assert big.address() == Rel.of(spark.range(3000).select((2999 - F.col("id")).alias("k"))).address() != other.address()
    assert Rel.of(spark.range(0).withColumnRenamed("id", "k")).address()


def test_ordered_fold_keeps_canonical_order(spark):
    df = spark.createDataFrame([(g, f"{i:03d}") for g in "ab" for i in range(150)], "g string, t string").repartition(7)
    out = Rel.of(df.union(df.where("t = '005'"))).aggregate(["g"], A.CONCAT, F.col("t"), "s")
    want = "".join(f"{i:03d}" * (2 if i == 5 else 1) for i in range(150))
    assert rows(out) == [("a", want, 1), ("b", want, 1)]


def _no_five(a, b):
    if 5 in (a, b):
        raise ValueError("five")
    return a + b


def test_failing_fold_quarantines_its_group(spark):
    bad = A.Monoid("no-five", _no_five, 0, (0, 1), kind="long")
    r = Rel.of(spark.createDataFrame([("a", 1), ("a", 5), ("b", 2)], "g string, x long"))
    out = r.aggregate(["g"], bad, F.col("x"), "s")
    assert rows(out) == [("b", 2, 1)]
    assert [(q.reason, q.n) for q in out.quarantine().collect()] == [("ValueError", 1)] * 2
    own = r.aggregate(["g"], A.SUM_LONG, lambda row: 10 // (row["x"] - 5), "s")
    assert rows(own) == [("a", -3, 1), ("b", -4, 1)] and [q.reason for q in own.quarantine().collect()] == ["ZeroDivisionError"]


def test_distinct_and_aggregate_take_counts_only(spark):
    b = Rel.of(spark.range(3).withColumnRenamed("id", "k"), S.B)
    assert rows(b.distinct()) == [(0, True), (1, True), (2, True)]
    assert S.named("Z*(Why*B)").name == "Z*(Why*B)" and S.why_slots(S.ZxWhy) == ("__w",) and not S.is_delta(S.B)
    with pytest.raises(S.SemiringRefused):
        S.named("Z*Q")
    with pytest.raises(Exception, match="linear"):
        D.linear_delta("distinct", b)
