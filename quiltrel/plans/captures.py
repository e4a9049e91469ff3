"""Answers from outside: captured once, replayed after, and paid from a budget."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiltrel.functions.values import address, canonical, decanonical, ref_hex
from quiltrel.plans.builds import Store
from quiltrel.plans.oracles import Budget, Oracle, RequestRefused, Transport


class NovelRefused(RuntimeError):
    """No capture, and none may be made."""


class SpendRefused(RuntimeError):
    """The worst case is beyond the budget."""


class CaptureConflict(RuntimeError):
    """An answer was captured otherwise."""


class ReservationConflict(RuntimeError):
    """Another session has reserved the same question and not settled it."""


class OverrunRefused(RuntimeError):
    """An answer cost more than its worst case."""


RESERVED = "id string, scope string, unit string, kind string, worst long"
CAPTURED = "reservation string, oracle string, input_key string, kind string, price long, response string"


def spent(reservations: DataFrame, captures: DataFrame) -> DataFrame:
    """scope, unit, kind, spent: settled prices, and the worst case of what is not settled."""
    settled = captures.select(F.col("reservation").alias("id"), "price")
    return reservations.join(settled, "id", "left").groupBy("scope", "unit", "kind").agg(F.sum(F.coalesce("price", "worst")).cast("long").alias("spent"))


@dataclass
class Oracles:
    """Driver-side boundary over a store. replay=True: only captured answers. Every reservation and every
    capture is one file that is created exclusively: of two sessions that ask the same at once, one
    asks and pays, the other is refused. A capture holds the answer's ref."""

    spark: SparkSession
    folder: str
    budget: Budget
    scope: str = "run"
    replay: bool = True

    def __post_init__(self):
        self.store = Store(self.spark, self.folder)

    def _table(self, name: str, schema: str) -> DataFrame:
        """Records, one JSON object a file, read by the executors."""
        if not self.store.files.names(name):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).json(self.store.files.uri(name))

    def reservations(self) -> DataFrame:
        return self._table("reservations", RESERVED)

    def captures(self) -> DataFrame:
        return self._table("captures", CAPTURED)

    def known(self, asked: DataFrame) -> DataFrame:
        """asked (oracle, input_key) -> with the captured response: many look-ups as one join."""
        return asked.join(self.captures().select("oracle", "input_key", "response"), ["oracle", "input_key"])

    def invoke(self, oracle: Oracle, request: Any, call: Transport | None = None) -> str:
        """The ref of the answer: captured, or else asked for, paid and captured."""
        oracle.check(request)
        own, key = oracle.address(), address(request)
        ident = address({"input_key": key, "oracle": own})
        capture, reservation = f"captures/{ref_hex(ident)}.json", f"reservations/{ref_hex(ident)}.json"
        if self.store.files.has(capture):
            return json.loads(self.store.files.get(capture))["response"]
        if self.replay or call is None:
            raise NovelRefused(key)
        oracle.preflight()
        worst = oracle.worst(request)
        if type(worst) is not int or worst < 0:
            raise RequestRefused("a worst case is a whole number from 0")
        rows = spent(self.reservations(), self.captures()).where(F.col("scope") == self.scope).collect()  # one row a kind
        totals = {r.kind: r.spent for r in rows if r.unit == self.budget.unit}
        if why := self.budget.admits(oracle.kind, oracle.unit, totals, worst):
            raise SpendRefused(why)
        record = {"id": ident, "kind": oracle.kind, "scope": self.scope, "unit": oracle.unit, "worst": worst}
        if not self.store.files.put(reservation, canonical(record)):
            raise ReservationConflict(ident)
        answer, price = call(request)
        if type(price) is not int or price < 0 or price > worst:
            raise OverrunRefused(f"{price} of at most {worst}")
        ref = self.store.put_value(answer)
        done = {"input_key": key, "kind": oracle.kind, "oracle": own, "price": price, "reservation": ident, "response": ref}
        if not self.store.files.put(capture, canonical(done)):
            if self.store.files.get(capture) != canonical(done):
                raise CaptureConflict(key)
        return ref

    def read(self, ref: str) -> Any:
        """A captured answer, its bytes verified."""
        return decanonical(self.store.get_bytes(ref))
