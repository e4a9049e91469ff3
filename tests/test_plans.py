"""Store, builds, captures, comparison, laws and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from quiltrel import cli, laws
from quiltrel.functions import semiring as S
from quiltrel.operators.relation import Rel
from quiltrel.plans import compare
from quiltrel.plans.builds import BuildRefused, IntegrityRefused, Layer, Store, transform
from quiltrel.plans.captures import CaptureConflict, NovelRefused, Oracles, OverrunRefused, ReservationConflict, SpendRefused
from quiltrel.plans.oracles import LLM, Budget, BudgetRefused, Clock, CredentialRefused, Fetch, OracleRefused, RequestRefused, UnitRefused, utc_clock
from quiltrel.sources.ingest import citations, ingest


@transform(kind="test", layer=Layer.SERVE)
def small(rel: Rel) -> Rel:
    return rel.select(F.col("k") < 2)


@transform(kind="test")
def broken(rel: Rel) -> Rel:
    raise KeyError("no")


@transform(kind="test", layer=Layer.SERVE)
def too_wide(rel: Rel) -> Rel:
    return rel.distinct()


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def test_bytes_and_values(store):
    ref = store.put_bytes(b"abc")
    assert store.get_bytes(ref) == b"abc" and store.put_bytes(b"abc") == ref and store.has(ref) and not store.has("sha256:" + "0" * 64)
    with pytest.raises(FileExistsError):
        store.put_bytes(b"abc", exclusive=True)
    value = store.put_value({"a": [1, None]})
    assert store.get_value(value) == {"a": [1, None]} and set(store.iter_refs()) == {ref, value} and store.gc().startswith("refused")
    store.files.delete(store._at(ref, ".bytes"))
    store.files.put(store._at(ref, ".bytes"), b"abd")
    with pytest.raises(IntegrityRefused):
        store.get_bytes(ref)


def test_raw_files(store, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw/x").write_bytes(b"abc")
    assert store.put_files(str(tmp_path / "raw")).first().ref == store.put_bytes(b"abc")


@pytest.mark.parametrize("name", ["Z", "B", "Why", "Z*Why", "Z*(Why*B)"])
def test_relations_of_any_structure(spark, store, name):
    rel = Rel.of(spark.createDataFrame([(1, "e"), (1, "e"), (None, "f")], "k long, t string"), S.named(name))
    ref = store.put(rel)
    back = store.get(ref)
    assert back.semiring.name == name and back.address() == ref and back.annotated().count() == 2 and store.put(rel) == ref


def test_builds(spark, store):
    ref = store.put(Rel.of(spark.createDataFrame([(1,), (2,)], "k long")))
    one, two = store.build(small, [ref]), store.build(small, [ref])
    assert one.rebuilt and not two.rebuilt and one.output_ref == two.output_ref and store.build(small, [ref], memo=False).rebuilt
    assert [r.k for r in store.export(two).collect()] == [1]
    dead = store.build(broken, [ref])
    assert (dead.output_ref, dead.reason) == (None, "KeyError") and store.build(broken, [ref]).rebuilt
    for bad in (lambda: store.build(too_wide, [ref]), lambda: store.export(dead), lambda: store.build(lambda r: r, [ref])):
        with pytest.raises(BuildRefused):
            bad()


def test_lineage_from_the_store(spark, store):
    rel = ingest(spark.createDataFrame([(1, "a"), (1, "b")], "k long, t string"), "s", store)
    ingest(spark.createDataFrame([(1, "a")], "k long, t string"), "s", store)
    assert store.rows().count() == 2
    got = citations(rel.project(["k"]).consolidated(), store.rows(), ["k"]).first().citations
    assert [[c.kind for c in s] for s in got] == [["source-row"]] * 2 and [s[0].ref for s in got] == sorted(s[0].ref for s in got)
    lone = citations(rel.project(["k"]).consolidated(), store.rows().limit(0), ["k"], spark.createDataFrame([(got[0][0].ref, "v")], "ref string, row string")).first().citations
    assert sorted(s[0].kind for s in lone) == ["unresolved", "value"]


def test_captures(spark, tmp_path):
    folder, model = str(tmp_path / "store"), LLM(model="m", max_tokens=5, output_price=2)
    request, calls = {"messages": ["hi"]}, []

    def call(r):
        calls.append(r)
        return {"text": "yes"}, 7

    open_ = lambda ceilings, replay=False, unit="unit": Oracles(spark, folder, Budget(ceilings, unit), replay=replay)
    with pytest.raises(NovelRefused):
        open_({}, True).invoke(model, request, call)
    for ceilings in ({}, {"llm": 10}, {"total": 10}, {"llm": 9, "total": 99}):
        with pytest.raises(SpendRefused):
            open_(ceilings).invoke(model, request, call)
    with pytest.raises(UnitRefused):
        open_({"llm": 10, "total": 10}, unit="cent").invoke(model, request, call)
    enough = open_({"llm": 10, "total": 10})
    ref = enough.invoke(model, request, call)
    assert enough.read(ref) == {"text": "yes"} and open_({}, True).invoke(model, request) == ref and len(calls) == 1
    with pytest.raises(SpendRefused):  # 7 of 10 are spent, 10 more may be asked
        enough.invoke(model, {"messages": ["again"]}, call)
    more = open_({"llm": 40, "total": 40})
    with pytest.raises(ZeroDivisionError):
        more.invoke(model, {"messages": ["fails"]}, lambda r: 1 // 0)
    with pytest.raises(ReservationConflict):
        more.invoke(model, {"messages": ["fails"]}, call)
    with pytest.raises(OverrunRefused):
        more.invoke(model, {"messages": ["dear"]}, lambda r: ("x", 11))
    with pytest.raises(SpendRefused):  # both unsettled ones count in full: 7 + 10 + 10
        open_({"llm": 36, "total": 36}).invoke(model, {"messages": ["new"]}, call)
    asked = spark.createDataFrame([(model.address(), "sha256:" + "0" * 64)], "oracle string, input_key string")
    assert more.known(asked).count() == 0 and issubclass(CaptureConflict, RuntimeError)


def test_descriptors():
    assert Fetch(price=1).address() != Fetch(price=2).address() and Clock().worst({"label": "x"}) == 0
    assert LLM(model="m", max_tokens=3, input_price=1, output_price=2).worst({"messages": []}) == len(b'{"messages":[]}') + 6
    assert utc_clock()({"label": "x"})[0]["now"].endswith("Z")
    for bad, why in (
        (lambda: Fetch(headers=(("Authorization", "x"),)), CredentialRefused), (lambda: Fetch(method="POST"), OracleRefused), (lambda: Fetch().check({"uri": "http://u:p@h/"}), CredentialRefused),
        (lambda: Fetch().check({"uri": "ftp://h"}), RequestRefused), (lambda: LLM(model=""), OracleRefused), (lambda: Budget({"llm": 1.5}), BudgetRefused), (lambda: Clock(reproducible="often"), OracleRefused),
    ):
        with pytest.raises(why):
            bad()


def test_compare(spark):
    a = spark.createDataFrame([(1, "abc"), (2, "abc"), (3, "x"), (5, None)], "item long, output string")
    b = spark.createDataFrame([(1, "abc"), (2, "abd"), (4, "x"), (5, "")], "item long, output string")
    assert sorted(map(tuple, compare.compare(a, b).collect())) == [(2, 2, "differs"), (3, None, "missing"), (4, None, "extra"), (5, None, "differs")]
    m = spark.createDataFrame([("a", 10, ["x", "y"]), ("b", 20, ["x"]), ("c", 20, ["y"]), ("d", 30, [])], "candidate string, loc long, operators array<string>")
    assert tuple(compare.select_vertical(m).first()) == ("d", 0, 0) and compare.select_vertical(m.where("candidate <> 'd'")).first().candidate == "b"
    assert compare.select_vertical(m.limit(0)).count() == 0


@laws.law("range counts")
def _counts(spark) -> int:
    assert spark.range(5).count() == 5
    return 1


@laws.law("always wrong", "2")
def _wrong(spark) -> int:
    raise AssertionError("never")


def test_laws(spark, tmp_path):
    found = laws.discovered(__name__)
    assert [x.name for x in found] == ["always wrong", "range counts"]
    status = lambda e: {r.law: r.status for r in laws.report(spark, found, e).collect()}
    none = spark.createDataFrame([], laws.EVIDENCE)
    assert set(status(none).values()) == {"pending"}
    seen = laws.run(spark, found, str(tmp_path / "evidence"))
    assert status(seen) == {"always wrong": "failing", "range counts": "fresh"}
    assert set(status(seen.withColumn("descriptor", F.lit("other"))).values()) == {"stale"}
    assert status(seen.union(seen.withColumn("verdict", F.lit("holds"))))["always wrong"] == "conflicting"


def pipeline(spark, oracles):
    return oracles.read(oracles.invoke(Clock(), {"label": "t"}, lambda r: ({"now": "then"}, 0)))["now"]


def test_command_line(spark, tmp_path, capsys):
    run = lambda *more: cli.main(["run", f"{__name__}:pipeline", "--store", str(tmp_path / "store"), *more], spark)
    assert run() == 1 and "NovelRefused" in capsys.readouterr().err
    assert run("--spend") == 1 and "SpendRefused" in capsys.readouterr().err
    budget = tmp_path / "budget.json"
    budget.write_text(json.dumps({"unit": "unit", "ceilings": {"clock": 1, "total": 1}}))
    assert run("--spend", "--budget", str(budget), "--budget-override", "clock=0") == 1
    capsys.readouterr()
    assert run("--spend", "--budget", str(budget)) == 0 and capsys.readouterr().out == "then\n"
    assert run() == 0
    capsys.readouterr()
    assert cli.budget_of(str(budget), "clock=5,llm=9").ceilings == {"clock": 1, "total": 1}
    assert cli.main(["laws", "report", __name__, "--root", str(tmp_path / "e"), "--json"], spark) == 2
    assert {r["status"] for r in json.loads(capsys.readouterr().out)} == {"pending"}
    assert cli.main(["laws", "report", __name__, "--root", str(tmp_path / "e"), "--milestone", "1", "--run"], spark) == 0
