"""Transforms with identity, a write-once store, memoised builds, layers and export."""

from __future__ import annotations

import hashlib
import inspect
import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from enum import IntEnum
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiltrel.files import Files
from quiltrel.functions import semiring as S
from quiltrel.functions.values import address, canonical, decanonical, is_ref, ref_hex, ref_of
from quiltrel.operators.relation import Rel


class BuildRefused(ValueError):
    pass


class IntegrityRefused(RuntimeError):
    pass


class Layer(IntEnum):
    CAPTURE = 0
    SERVE = 1
    DECODE = 2
    DERIVE = 3


_REACH = {"select": Layer.SERVE, "project": Layer.SERVE, "map_rows": Layer.DECODE}


def layer_of(operators: frozenset[str]) -> Layer:
    """The widest layer that a set of operators needs; none at all is CAPTURE."""
    return max((_REACH.get(o, Layer.DERIVE) for o in operators), default=Layer.CAPTURE)


_DESCRIBED: dict[str, tuple[Callable, str]] = {}


def transform(*, kind: str, params: dict[str, Any] | None = None, layer: Layer | None = None):
    """Registers a function of relations under an identity made of its source text and parameters."""

    def register(fn: Callable) -> Callable:
        name = f"{fn.__module__}/{fn.__qualname__}"
        if fn.__name__ == "<lambda>" or not inspect.isfunction(fn):
            raise BuildRefused("a transform is a named function")
        code = "sha256:" + hashlib.sha256(inspect.getsource(fn).encode()).hexdigest()
        own = address({"kind": kind, "name": name, "code_hash": code, "params_hash": address(params or {})})
        if name in _DESCRIBED and _DESCRIBED[name][1] != own:
            raise BuildRefused(f"{name} is registered already")
        _DESCRIBED[name] = (fn, own)
        fn.descriptor, fn.layer = own, layer
        return fn

    return register


def derivation_id(inputs: list[str], descriptor: str) -> str:
    return address({"inputs": sorted(inputs), "transform": descriptor})


@dataclass(frozen=True)
class Node:
    """A registered transform and the refs of what it reads."""

    transform: Callable[..., Rel]
    inputs: tuple[str, ...]

    def __post_init__(self):
        if not hasattr(self.transform, "descriptor"):
            raise BuildRefused("the function is not registered")
        if not all(is_ref(i) for i in self.inputs):
            raise BuildRefused("inputs are refs")

    @property
    def derivation_id(self) -> str:
        return derivation_id(list(self.inputs), self.transform.descriptor)


@dataclass(frozen=True)
class Built:
    """output_ref and rel are None where the transform raised; reason and detail then say why."""

    derivation_id: str
    output_ref: str | None
    rebuilt: bool
    layer: Layer
    operators: frozenset[str]
    rel: Rel | None
    reason: str | None = None
    detail: str | None = None


class Store:
    """Bytes, values and relations by content address, under any URI; written once. A relation is Parquet
    beside a small description, which is written last and makes it part of the store."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files = spark, Files(spark, root)

    # -- bytes and values
    @staticmethod
    def _at(ref: str, suffix: str) -> str:
        digits = ref_hex(ref)
        return f"{digits[:2]}/{digits}{suffix}"

    def put_bytes(self, data: bytes, *, exclusive: bool = False) -> str:
        """exclusive: refused where the bytes are there already, so that one of several writers wins."""
        ref = ref_of(data)
        if not self.files.put(self._at(ref, ".bytes"), data):
            if exclusive:
                raise FileExistsError(ref)
            if ref_of(self.files.get(self._at(ref, ".bytes"))) != ref:
                raise IntegrityRefused(f"{ref} holds other bytes")
        return ref

    def get_bytes(self, ref: str) -> bytes:
        data = self.files.get(self._at(ref, ".bytes"))
        if ref_of(data) != ref:
            raise IntegrityRefused(f"{ref} holds other bytes")
        return data

    def put_value(self, value: Any, *, exclusive: bool = False) -> str:
        return self.put_bytes(canonical(value), exclusive=exclusive)

    def get_value(self, ref: str) -> Any:
        return decanonical(self.get_bytes(ref))

    def put_files(self, path: str) -> DataFrame:
        """Raw files as sources: path, ref (of the bytes), length; read by the executors."""
        content = self.spark.read.format("binaryFile").load(path)
        return content.select("path", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("ref"), "length")

    def has(self, ref: str) -> bool:
        return self.files.has(self._at(ref, ".bytes")) or self.files.has(self._at(ref, ".rel"))

    def iter_refs(self) -> Iterator[str]:
        for suffix in (".bytes", ".rel"):
            yield from ("sha256:" + x for x in self.files.walk("", suffix))

    def gc(self) -> str:
        """Nothing is ever collected: what a trace or a row's provenance names must stay."""
        return "refused: refs may be held by traces and rows outside this store"

    # -- relations
    def put(self, rel: Rel) -> str:
        """Rows go into a folder of this attempt; the description names the folder of whoever came first."""
        rel = rel.consolidated()
        ref = rel.address()
        if not self.files.has(self._at(ref, ".rel")):
            folder = self._at(ref, f".{uuid.uuid4().hex}")
            rel.df.write.parquet(self.files.uri(folder))
            side = {"folder": folder, "operators": sorted(rel.operators), "schema": list(rel.schema), "semiring": rel.semiring.name}
            if not self.files.put(self._at(ref, ".rel"), canonical(side)):
                self.files.delete(folder)
        return ref

    def get(self, ref: str, verify: bool = True) -> Rel:
        if not is_ref(ref):
            raise BuildRefused(f"{ref!r} is no ref")
        side = json.loads(self.files.get(self._at(ref, ".rel")))
        rel = Rel(self.spark.read.parquet(self.files.uri(side["folder"])), tuple(side["schema"]), S.named(side["semiring"]), operators=frozenset(side["operators"]))
        if verify and rel.address() != ref:
            raise IntegrityRefused(f"{ref} holds other rows")
        return rel

    # -- rows of sources
    def put_rows(self, rows: DataFrame) -> None:
        """ref, source, row: those whose ref is new are added."""
        known = self.rows()
        fresh = rows.dropDuplicates(["ref"]) if known is None else rows.dropDuplicates(["ref"]).join(known.select("ref"), "ref", "left_anti")
        fresh.select("ref", "source", "row").write.parquet(self.files.uri(f"rows/batch={uuid.uuid4().hex}"))

    def rows(self) -> DataFrame | None:
        if not self.files.names("rows"):
            return None
        # two writers may have added the same row
        return self.spark.read.schema("ref string, source string, row string").parquet(*(self.files.uri(f"rows/{x}") for x in self.files.names("rows"))).dropDuplicates(["ref"])

    # -- builds
    def build(self, fn: Callable[..., Rel], inputs: list[str], *, memo: bool = True) -> Built:
        """The output of a registered transform over stored relations: from the trace if it is there
        (memo), else computed. A transform that raises gives a build without output and no trace."""
        node = Node(fn, tuple(inputs))
        own, traces = node.derivation_id, TraceStore(self)
        if memo and (ref := traces.lookup(own)):
            rel = self.get(ref)
            return Built(own, ref, False, layer_of(rel.operators), rel.operators, rel)
        try:
            rel = fn(*(self.get(i) for i in inputs))
        except IntegrityRefused:
            raise
        except Exception as e:
            return Built(own, None, True, Layer.CAPTURE, frozenset(), None, type(e).__name__, str(e) or type(e).__name__)
        layer = layer_of(rel.operators)
        if fn.layer is not None and layer > fn.layer:
            raise BuildRefused(f"declared {fn.layer.name}, needs {layer.name}")
        ref = self.put(rel)
        traces.record(own, ref)
        return Built(own, ref, True, layer, rel.operators, replace(self.get(ref, verify=False), operators=rel.operators))

    def export(self, built: Built) -> DataFrame:
        """The bag of a SERVE build; other layers do not leave, nor does a build without output."""
        if built.rel is None or layer_of(built.operators) is not Layer.SERVE:
            raise BuildRefused(f"{layer_of(built.operators).name} is not exported")
        return built.rel.to_bag()


@dataclass(frozen=True)
class TraceStore:
    """derivation id -> ref of its output, recorded once."""

    store: Store

    def lookup(self, derivation: str) -> str | None:
        path = f"traces/{ref_hex(derivation)}.json"
        if not self.store.files.has(path):
            return None
        ref = json.loads(self.store.files.get(path)).get("output")
        if not is_ref(ref):
            raise IntegrityRefused(f"the trace of {derivation} is broken")
        return ref

    def record(self, derivation: str, ref: str) -> None:
        path, data = f"traces/{ref_hex(derivation)}.json", canonical({"output": ref})
        if not self.store.files.put(path, data) and self.store.files.get(path) != data:
            raise IntegrityRefused(f"{derivation} is recorded otherwise")
