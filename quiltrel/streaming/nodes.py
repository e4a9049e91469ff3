"""Declared views over changing sources: a graph of nodes that advances tick by tick.

A node is an operator with parameters, all given as data: column lists, SQL text, or names of
registered functions and algebras. Which nodes follow their inputs' changes and which are computed
anew is derived from the graph:

* source, select, project, map_rows, union: the change of the output is the output of the change;
* join: bilinear; aggregate over a registered group with an aggregate of its own: by subtraction;
* distinct, anti_join, aggregates over other monoids, and all nodes above an anti_join: computed
  anew from the inputs' integrals, and differenced.

A plan whose sinks read counts only is maintained in counts (semiring Z): no refs are made, looked up or
gathered. Then distinct and anti_join follow changes too, as no support of theirs names what is absent;
rows of a join's or an anti_join's other side are taken unmerged; and a node none of whose inputs
changed is not touched.

Under the root every tick leaves each node's change, the ledger of dead refs and, last, a manifest: a
tick that has one is not done again, so a re-delivered micro-batch changes nothing, and a tick that
died half-way is done from the start. An integral is the last snapshot and the changes since; nodes
that follow changes write a snapshot only every COMPACT ticks, or where several nodes read theirs.
"""

from __future__ import annotations

import hashlib
import inspect
import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiltrel.files import Files
from quiltrel.functions import semiring as S
from quiltrel.functions.values import address, canonical
from quiltrel.operators.algebra import COUNT, MAX, MIN, SUM_GROUP, SUM_LONG, AbelianGroup, Monoid
from quiltrel.operators.relation import Rel, guard
from quiltrel.sources.ingest import ingest_delta, net_delta
from quiltrel.streaming import delta as D

COMPACT = 8


class NodeRefused(ValueError):
    pass


class TickRefused(RuntimeError):
    pass


_FUNCTIONS: dict[tuple[str, str], tuple[Callable, str, str]] = {}  # (sort, name) -> function, code address, schema
_ALGEBRAS: dict[str, Monoid] = {}


def _register_function(sort: str, name: str, fn: Callable, schema: str) -> None:
    if not inspect.isfunction(fn) or fn.__name__ == "<lambda>":
        raise NodeRefused("only named functions have an identity")
    code = "sha256:" + hashlib.sha256((inspect.getsource(fn) + schema).encode()).hexdigest()
    known = _FUNCTIONS.get((sort, name))
    if known and known[1] != code:
        raise NodeRefused(f"{name} is registered otherwise")
    _FUNCTIONS[sort, name] = (fn, code, schema)


def register_predicate(name: str, fn: Callable[[dict], Any]) -> None:
    _register_function("predicate", name, fn, "")


def register_map(name: str, fn: Callable[[dict], dict], schema: str) -> None:
    _register_function("map", name, fn, schema)


def register_monoid(name: str, monoid: Monoid) -> None:
    if not isinstance(monoid, Monoid):
        raise NodeRefused(f"{name} is no monoid")
    if name in _ALGEBRAS and _ALGEBRAS[name] is not monoid:
        raise NodeRefused(f"{name} is registered otherwise")
    _ALGEBRAS[name] = monoid


def register_group(name: str, group: AbelianGroup) -> None:
    if not isinstance(group, AbelianGroup):
        raise NodeRefused(f"{name} is no group")
    register_monoid(name, group)


for _name, _algebra in {"sum": SUM_GROUP, "sum-long": SUM_LONG, "count": COUNT, "min": MIN, "max": MAX}.items():
    register_monoid(_name, _algebra)

#: operator -> (number of inputs, parameters)
SIGNATURES = {
    "source": (0, ("schema",)), "select": (1, ("predicate",)), "project": (1, ("columns",)), "map_rows": (1, ("cells",)), "union": (2, ()),
    "join": (2, ("on",)), "distinct": (1, ()), "anti_join": (2, ("on",)), "aggregate": (1, ("by", "algebra", "value", "into")),
}
_ANEW = {"distinct", "anti_join"}


def binary_operators() -> frozenset[str]:
    return frozenset(op for op, (n, _) in SIGNATURES.items() if n == 2)


def required_params(op: str) -> tuple[str, ...]:
    if op not in SIGNATURES:
        raise NodeRefused(f"{op} is no operator")
    return SIGNATURES[op][1]


@dataclass(frozen=True, init=False)
class DeltaNode:
    """An operator with its parameters. descriptor: address of both and of any registered code."""

    op: str
    params: tuple[tuple[str, Any], ...]
    descriptor: str

    def __init__(self, op: str, **params: Any):
        if set(params) != set(required_params(op)):
            raise NodeRefused(f"{op} takes {required_params(op)}, not {tuple(sorted(params))}")
        shaped, code = {}, []
        for name, value in params.items():
            if name in ("schema", "columns", "on", "by"):
                cols = (value,) if isinstance(value, str) else tuple(value)
                if not cols or len(set(cols)) != len(cols) or not all(isinstance(c, str) for c in cols):
                    raise NodeRefused(f"{name}: distinct column names, at least one")
                value = tuple(sorted(cols))
            elif name == "cells":
                value = value if isinstance(value, str) else tuple(sorted(dict(value).items()))
            elif not isinstance(value, str) or not value:
                raise NodeRefused(f"{name} is a text")
            if name == "cells" and isinstance(value, str):
                if ("map", value) not in _FUNCTIONS:
                    raise NodeRefused(f"no map is registered as {value}")
                code.append(_FUNCTIONS["map", value][1])
            if name == "predicate" and ("predicate", value) in _FUNCTIONS:
                code.append(_FUNCTIONS["predicate", value][1])
            if name == "algebra" and value not in _ALGEBRAS:
                raise NodeRefused(f"no algebra is registered as {value}")
            shaped[name] = value
        if op == "aggregate" and shaped["into"] in shaped["by"]:
            raise NodeRefused("into is a new name")
        object.__setattr__(self, "op", op)
        object.__setattr__(self, "params", tuple(sorted(shaped.items())))
        plain = {k: [list(x) if isinstance(x, tuple) else x for x in v] if isinstance(v, tuple) else v for k, v in shaped.items()}
        object.__setattr__(self, "descriptor", address({"code": code, "op": op, "params": plain, "tag": "node/1"}))

    def __getitem__(self, name: str) -> Any:
        return dict(self.params)[name]

    @property
    def subtractive(self) -> bool:
        return self.op == "aggregate" and isinstance(_ALGEBRAS[self["algebra"]], AbelianGroup) and _ALGEBRAS[self["algebra"]].spark is not None

    def run(self, *inputs: Rel) -> Rel:
        """The operator over whole relations."""
        p = dict(self.params)
        if self.op == "select":
            known = _FUNCTIONS.get(("predicate", p["predicate"]))
            return inputs[0].select(known[0] if known else F.expr(p["predicate"]))
        if self.op == "map_rows":
            if isinstance(p["cells"], str):
                fn, _, schema = _FUNCTIONS["map", p["cells"]]
                return inputs[0].map_rows(fn, schema)
            return inputs[0].map_rows({k: F.expr(v) for k, v in p["cells"]})
        if self.op == "aggregate":
            return inputs[0].aggregate(p["by"], _ALGEBRAS[p["algebra"]], self.value(), p["into"])
        return getattr(inputs[0], self.op)(*inputs[1:], *(p[k] for k in required_params(self.op)))

    def value(self) -> Column:
        return F.expr(self["value"])


@dataclass(frozen=True)
class Advanced:
    tick: int
    rebuilt: bool
    step: str  # address of the manifest
    anew: tuple[str, ...]  # nodes that were computed anew
    quarantined: DataFrame | None = None


class Plan:
    """Nodes by name; each is added after its inputs, so the order of adding is topological."""

    def __init__(self) -> None:
        self.nodes: dict[str, tuple[DeltaNode, tuple[str, ...]]] = {}

    def add(self, name: str, node: DeltaNode, *inputs: str) -> Plan:
        if name in self.nodes or not name.replace("_", "").isalnum():
            raise NodeRefused(f"{name!r} is taken or no name")
        if len(inputs) != SIGNATURES[node.op][0] or any(i not in self.nodes for i in inputs):
            raise NodeRefused(f"{node.op} takes {SIGNATURES[node.op][0]} inputs that are there already, not {inputs}")
        self.nodes[name] = (node, inputs)
        return self

    def anew(self, semiring: S.Semiring = S.ZxWhy) -> tuple[str, ...]:
        """Nodes computed anew at each tick."""
        if semiring == S.Z:
            return tuple(n for n, (x, _) in self.nodes.items() if x.op == "aggregate" and not x.subtractive)
        tainted, out = set(), []
        for name, (node, inputs) in self.nodes.items():
            if node.op == "anti_join" or tainted & set(inputs):
                tainted.add(name)
            if name in tainted or node.op in _ANEW or (node.op == "aggregate" and not node.subtractive):
                out.append(name)
        return tuple(out)

    def address(self) -> str:
        return address({"nodes": [[n, x.descriptor, list(i)] for n, (x, i) in self.nodes.items()], "tag": "plan/1"})

    def evaluate(self, sources: Mapping[str, Rel]) -> dict[str, Rel]:
        """All nodes over whole sources, at once."""
        out: dict[str, Rel] = {}
        for name, (node, inputs) in self.nodes.items():
            out[name] = sources[name] if node.op == "source" else node.run(*(out[i] for i in inputs))
        return out


class Maintained:
    """A plan under a root that holds its state. semiring: Z where no sink reads provenance."""

    def __init__(self, spark: SparkSession, root: str, plan: Plan, semiring: S.Semiring = S.ZxWhy):
        if semiring not in (S.Z, S.ZxWhy):
            raise NodeRefused(f"a plan is maintained in Z or Z*Why, not in {semiring.name}")
        self.spark, self.plan, self.why = spark, plan, semiring == S.ZxWhy
        self.files = Files(spark, f"{root.rstrip('/')}/{plan.address()[7:23]}{'' if self.why else '-Z'}")
        self.fresh = set(plan.anew(semiring))
        self._types: dict[tuple[str, str], T.StructType] = {}

    # -- state
    def last(self) -> int:
        """The latest tick that is complete, -1 at first."""
        return max((int(x[:-5]) for x in self.files.names("ticks") if x.endswith(".json")), default=-1)

    def _manifest(self, tick: int) -> dict:
        return json.loads(self.files.get(f"ticks/{tick:09d}.json"))

    def _put(self, df: DataFrame, name: str, kind: str, tick: int) -> DataFrame:
        uri = self.files.uri(f"{name}/{kind}/{tick:09d}")
        df.write.mode("overwrite").option("compression", "zstd").parquet(uri)
        self._types[name, kind] = df.schema
        return self.spark.read.schema(df.schema).parquet(uri)

    def _read(self, name: str, kind: str, tick: int) -> DataFrame:
        uri = self.files.uri(f"{name}/{kind}/{tick:09d}")
        if (name, kind) not in self._types:
            self._types[name, kind] = self.spark.read.parquet(uri).schema
        return self.spark.read.schema(self._types[name, kind]).parquet(uri)

    def dead(self, tick: int | None = None) -> DataFrame:
        tick = self.last() if tick is None else tick
        return self._read("_ledger", "dead", tick) if tick >= 0 and self.why else self.spark.createDataFrame([], "ref string")

    def change(self, name: str, tick: int) -> Rel:
        return _rel(self._read(name, "delta", tick))

    def integral(self, name: str, tick: int | None = None) -> Rel | None:
        """A node's relation after a tick."""
        tick = self.last() if tick is None else tick
        if tick < 0:
            return None
        snap = self._manifest(tick)["snapshots"].get(name, -1)
        return self._sum(name, snap, tick, self.dead(tick) if self.why else None)

    def _rows(self, name: str, snap: int, tick: int) -> Rel:
        """A node's relation after a tick as its last snapshot and the changes since, equal rows not merged."""
        parts = [self._read(name, "delta", t) for t in range(snap + 1, tick + 1)]
        rows = self._read(name, "snap", snap) if snap >= 0 else parts.pop(0)
        for p in parts:
            rows = rows.unionByName(p)
        return replace(_rel(rows), merged=not parts, signed=snap < tick)

    def _sum(self, name: str, snap: int, tick: int, dead: DataFrame | None) -> Rel:
        if snap == tick:
            return replace(_rel(self._read(name, "snap", tick)), signed=False)
        if dead is None and tick == 0:
            first = self._rows(name, snap, tick)
            return replace(first, df=first.df.where(guard(F.col("__n") < 0, D.OVER)), signed=False)
        parts = [self._read(name, "delta", t) for t in range(snap + 1, tick + 1)]
        rest = parts[0]
        for p in parts[1:]:
            rest = rest.unionByName(p)
        base = self._read(name, "snap", snap) if snap >= 0 else rest.limit(0)
        return D.apply(_rel(base), replace(_rel(rest), merged=False), dead)

    # -- one tick
    def advance(self, feeds: Mapping[str, DataFrame], tick: int) -> Advanced:
        """feeds: for each source its rows with a signed count `occ`; a source without one stays."""
        path = f"ticks/{tick:09d}.json"
        if self.files.has(path):
            return Advanced(tick, False, address(self._manifest(tick)), tuple(self._manifest(tick)["anew"]))
        before = self.last()
        if tick != before + 1:
            raise TickRefused(f"tick {tick} after {before}")
        snaps = dict(self._manifest(before)["snapshots"]) if before >= 0 else {}
        then = dict(snaps)  # the snapshots of the tick before
        old = {n: self.integral(n, before) for n in self.plan.nodes} if before >= 0 and self.why else {}
        changes: dict[str, Rel] = {}
        new: dict[str, Rel] = {}
        bad: DataFrame | None = None
        for name, (node, _) in self.plan.nodes.items():
            if node.op == "source":
                changes[name] = self._stored(name, self._source_change(name, node, feeds.get(name)), tick)
        dead = self._ledger(changes, old, tick) if self.why else self._covered(changes, then, tick)
        idle = set() if self.why else {n for n in changes if feeds.get(n) is None}
        for name, (node, inputs) in self.plan.nodes.items():
            if node.op != "source" and not node.subtractive and idle.issuperset(inputs):
                idle.add(name)
                changes[name] = self._stored(name, _rel(self._read(name, "delta", before).limit(0)), tick)
                new[name] = self._sum(name, snaps.get(name, -1), tick, dead)
                continue
            if name in self.fresh:
                out = node.run(*(new[i] for i in inputs)).consolidated()
                bad = _both(bad, out.quarantined)
                new[name] = replace(_rel(self._put(out.df, name, "snap", tick)), signed=False)
                was = old.get(name) if self.why or before < 0 else self._sum(name, then.get(name, -1), before, None)
                changes[name] = self._stored(name, D.diff(new[name], was) if was else new[name], tick)
                snaps[name] = tick
                continue
            if not self.why and node.op in ("join", "anti_join", "distinct"):
                changes[name] = self._stored(name, self._followed(node, inputs, changes, idle, then, snaps, tick), tick)
            elif node.op == "join":
                (a, b), empty = inputs, lambda r: replace(r, df=r.df.limit(0))
                b_old = old[b] if old else empty(new[b])
                moved = D.join_delta(new[a], changes[a], b_old, changes[b], node["on"])
                changes[name] = self._stored(name, moved, tick)
            elif node.op == "aggregate":
                changes[name] = self._subtracted(name, node, changes[inputs[0]], old.get(name), dead, tick)
            elif node.op != "source":
                moved = node.run(*(changes[i] for i in inputs))
                bad = _both(bad, moved.quarantined)
                changes[name] = self._stored(name, moved, tick)
            new[name] = self._sum(name, snaps.get(name, -1), tick, dead)
            if tick - snaps.get(name, -1) >= COMPACT or self._readers(name) > 1:
                new[name] = replace(_rel(self._put(new[name].consolidated().df, name, "snap", tick)), signed=False)
                snaps[name] = tick
        record = {"anew": sorted(self.fresh), "plan": self.plan.address(), "snapshots": snaps, "tick": tick}
        if not self.files.put(path, canonical(record)) and self.files.get(path) != canonical(record):
            raise TickRefused(f"tick {tick} is recorded otherwise")
        return Advanced(tick, True, address(record), tuple(sorted(self.fresh)), bad)

    def _readers(self, name: str) -> int:
        """Nodes that read the node's integral rather than its change."""
        return sum(name in inputs for n, (node, inputs) in self.plan.nodes.items() if n in self.fresh or node.op == "join" or node.op in _ANEW)

    def _followed(self, node: DeltaNode, inputs: tuple[str, ...], changes: dict[str, Rel], idle: set[str], then: dict[str, int], snaps: dict[str, int], tick: int) -> Rel:
        """The change of a join, an anti_join or a distinct over counts, from the changes of its inputs and
        the rows of the side that each of them meets."""
        was = lambda n: self._rows(n, then.get(n, -1), tick - 1) if tick else None
        moved = [None if i in idle else changes[i] for i in inputs]
        if node.op == "distinct":
            return D.presence_delta(was(inputs[0]), moved[0], changes[inputs[0]].schema)
        now = [self._rows(i, snaps.get(i, -1), tick) for i in inputs]
        a_old, b_old = map(was, inputs)
        if node.op == "anti_join":
            return D.anti_join_delta(a_old, moved[0], b_old, moved[1], now[1], node["on"])
        parts = [] if moved[0] is None or b_old is None else [moved[0].join(b_old, node["on"])]
        parts += [] if moved[1] is None else [now[0].join(moved[1], node["on"])]
        return parts[0] if len(parts) == 1 else parts[0].union(parts[1])

    def _covered(self, changes: dict[str, Rel], then: dict[str, int], tick: int) -> None:
        """Refuses the tick if a source gives up more of a row than it holds. Only rows that go are looked up."""
        for name, change in changes.items():
            gone = change.df.where("__n < 0")
            if gone.isEmpty():
                continue
            if tick:
                held, keys = self._rows(name, then.get(name, -1), tick - 1).df, gone.withColumnsRenamed({c: f"__g_{c}" for c in change.schema})
                same = [F.col(c).eqNullSafe(F.col(f"__g_{c}")) for c in change.schema]
                gone = gone.unionByName(held.join(keys.drop("__n"), same, "left_semi"))
            if gone.groupBy(*change.schema).agg(F.sum("__n").alias("__n")).where("__n < 0").count():
                raise TickRefused(f"{name}: {D.OVER}")

    def _stored(self, name: str, change: Rel, tick: int) -> Rel:
        return _rel(self._put(change.consolidated().df, name, "delta", tick))

    def _source_change(self, name: str, node: DeltaNode, feed: DataFrame | None) -> Rel:
        if feed is None:
            if self.last() < 0:
                raise TickRefused(f"the first tick needs a feed of {name}: it brings the columns' types")
            return _rel(self._read(name, "delta", self.last()).limit(0))
        if set(feed.columns) != {*node["schema"], "occ"}:
            raise TickRefused(f"{name}: {node['schema']} and occ are asked for, not {feed.columns}")
        if not self.why:
            return net_delta(feed)
        net = feed.groupBy(*node["schema"]).agg(F.sum("occ").cast("long").alias("occ"))
        come, go = net.where("occ > 0"), net.where("occ < 0").withColumn("occ", -F.col("occ"))
        return ingest_delta(name, come, go)

    def _ledger(self, changes: dict[str, Rel], old: dict[str, Rel], tick: int) -> DataFrame:
        """Refs whose source rows are gone: those of before, without the refs of this tick that stand in a
        source after it, with those that do not. Only refs of this tick are looked up."""
        refs = lambda df: df.select(F.explode(F.flatten("__w")).alias("ref"))
        touched = there = None
        for name, change in changes.items():
            now = change.df if not old else D.apply(old[name], change).df
            own, have = refs(change.df), refs(now)
            touched, there = (own, have) if touched is None else (touched.union(own), there.union(have))
        touched = touched.distinct()
        alive = touched.join(there, "ref", "left_semi")
        dead = self.dead(tick - 1).union(touched).distinct().join(alive, "ref", "left_anti")
        return self._put(dead, "_ledger", "dead", tick)

    def _subtracted(self, name: str, node: DeltaNode, change: Rel, old: Rel | None, dead: DataFrame | None, tick: int) -> Rel:
        group = _ALGEBRAS[node["algebra"]]
        known = self._read(name, "totals", tick - 1) if tick else None
        totals = D.group_aggregate_delta(change, node["by"], group, node.value(), node["into"], known)
        cols, one = sorted({*node["by"], node["into"]}), F.lit(1).cast("long").alias("__n")
        if not self.why and known is not None:
            old = _rel(known.select(*cols, one))
        if "__w" in totals.columns:
            kept = D.without_dead(Rel(totals.withColumnRenamed("__rows", "__n"), tuple(cols)), dead)
            totals = kept.df.withColumnRenamed("__n", "__rows")
        totals = self._put(totals, name, "totals", tick)
        out = _rel(totals.select(*cols, one, *(c for c in totals.columns if c == "__w")))
        return self._stored(name, D.diff(out, old) if old is not None else out, tick)

    def run(self, feed: DataFrame, source: str, checkpoint: str) -> None:
        """One streaming source until it is exhausted: one tick a micro-batch, found again by its number.
        The numbers start where the plan stands at the first run of the checkpoint."""

        def tick(df: DataFrame, i: int) -> None:
            self.advance({source: df}, i)

        feed.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(tick).start().awaitTermination()


def _rel(df: DataFrame) -> Rel:
    names = tuple(sorted(c for c in df.columns if not c.startswith("__")))
    return Rel(df, names, S.ZxWhy if "__w" in df.columns else S.Z)


def _both(a: DataFrame | None, b: DataFrame | None) -> DataFrame | None:
    return b if a is None else a if b is None else a.unionByName(b)
