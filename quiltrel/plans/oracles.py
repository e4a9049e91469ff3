"""What stands outside: descriptors of fetches, language models and clocks, their worst prices, and the
budget that admits them. Driver-side; nothing here runs on executors."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from datetime import UTC, datetime
from typing import Any, Protocol

from quiltrel.functions.values import address, canonical


class OracleRefused(ValueError):
    """A descriptor that cannot be one."""


class RequestRefused(ValueError):
    """A request that its oracle does not take."""


class CredentialRefused(OracleRefused):
    """A descriptor or request that carries a secret."""


class BudgetRefused(ValueError):
    """A budget that is no mapping of kinds to whole numbers."""


class UnitRefused(RuntimeError):
    """A price in another unit than the budget's."""


CLASSES = ("bit", "in-distribution", "non-reproducible")
_SECRET = re.compile(r"authorization|cookie|api[-_]?key|secret|token|password", re.I)


def _clean(headers: Mapping[str, str], uri: str = "") -> None:
    for name in headers:
        if _SECRET.search(name):
            raise CredentialRefused(f"header {name}")
    if re.search(r"//[^/@]+@", uri) or _SECRET.search(uri.partition("?")[2]):
        raise CredentialRefused("the address carries a credential")


@dataclass(frozen=True)
class Oracle:
    """kind, unit and reproducibility are part of the identity, as is the whole specification."""

    kind: str = field(init=False, default="")
    unit: str = "unit"
    reproducible: str = "non-reproducible"

    def __post_init__(self):
        if self.reproducible not in CLASSES:
            raise OracleRefused(f"{self.reproducible} is none of {CLASSES}")

    def spec(self) -> dict[str, Any]:
        raise NotImplementedError

    def to_value(self) -> dict[str, Any]:
        return {"class": self.reproducible, "kind": self.kind, "spec": self.spec(), "tag": "oracle/1", "unit": self.unit}

    def address(self) -> str:
        return address(self.to_value())

    def check(self, request: Any) -> None:
        """Refuses a request that the oracle does not take."""

    def worst(self, request: Any) -> int:
        """The most that an answer may cost."""
        raise NotImplementedError

    def preflight(self) -> None:
        """Refuses before anything is spent."""


@dataclass(frozen=True)
class Fetch(Oracle):
    kind: str = field(init=False, default="fetch")
    method: str = "GET"
    headers: tuple[tuple[str, str], ...] = ()
    price: int = 0

    def __post_init__(self):
        super().__post_init__()
        if self.method not in ("GET", "HEAD"):
            raise OracleRefused("a fetch only reads")
        if type(self.price) is not int or self.price < 0:
            raise OracleRefused("a price is a whole number from 0")
        _clean(dict(self.headers))

    def spec(self) -> dict[str, Any]:
        return {"headers": [list(h) for h in sorted(self.headers)], "method": self.method, "price": self.price}

    def check(self, request: Any) -> None:
        if not isinstance(request, dict) or set(request) != {"uri"} or not str(request["uri"]).startswith(("http://", "https://")):
            raise RequestRefused("a fetch asks for one http address")
        _clean({}, request["uri"])

    def worst(self, request: Any) -> int:
        return self.price


@dataclass(frozen=True)
class LLM(Oracle):
    kind: str = field(init=False, default="llm")
    model: str = ""
    max_tokens: int = 0
    input_price: int = 0
    output_price: int = 0
    parameters: tuple[tuple[str, Any], ...] = ()

    def __post_init__(self):
        super().__post_init__()
        if not self.model or self.max_tokens < 1 or min(self.input_price, self.output_price) < 0:
            raise OracleRefused("a model, tokens from 1 and prices from 0")

    def spec(self) -> dict[str, Any]:
        return {
            "input_price": self.input_price, "max_tokens": self.max_tokens, "model": self.model, "output_price": self.output_price,
            "parameters": [list(p) for p in sorted(self.parameters)],
        }

    def check(self, request: Any) -> None:
        if not isinstance(request, dict) or "messages" not in request:
            raise RequestRefused("a model is asked by messages")

    def worst(self, request: Any) -> int:
        # no text has more tokens than bytes
        return self.input_price * len(canonical(request)) + self.output_price * self.max_tokens


@dataclass(frozen=True)
class Clock(Oracle):
    kind: str = field(init=False, default="clock")

    def spec(self) -> dict[str, Any]:
        return {}

    def check(self, request: Any) -> None:
        if not isinstance(request, dict) or set(request) != {"label"}:
            raise RequestRefused("a clock is asked by a label")

    def worst(self, request: Any) -> int:
        return 0


@dataclass(frozen=True)
class Budget:
    """Ceilings by kind and in total, in one unit. What has no ceiling has none to spend."""

    ceilings: Mapping[str, int]
    unit: str = "unit"

    def __post_init__(self):
        if not isinstance(self.ceilings, Mapping):
            raise BudgetRefused("a budget maps kinds to ceilings")
        for k, v in self.ceilings.items():
            if not isinstance(k, str) or type(v) is not int or v < 0:
                raise BudgetRefused(f"{k}: {v!r} is no whole number from 0")

    def clamped(self, other: Budget | None) -> Budget:
        """Of two budgets the smaller ceiling of each kind; one cannot widen the other."""
        if other is None:
            return self
        if other.unit != self.unit:
            raise UnitRefused(f"{other.unit} is not {self.unit}")
        return Budget({k: min(v, other.ceilings.get(k, 0)) for k, v in self.ceilings.items()}, self.unit)

    def admits(self, kind: str, unit: str, spent: Mapping[str, int], worst: int) -> str | None:
        """None, or why not."""
        if unit != self.unit:
            raise UnitRefused(f"{unit} is not {self.unit}")
        for name, used in ((kind, spent.get(kind, 0)), ("total", sum(spent.values()))):
            ceiling = self.ceilings.get(name, 0)
            if ceiling <= 0 or used + worst > ceiling:
                return f"{name}: {used} + {worst} of {ceiling}"
        return None


class Transport(Protocol):
    """Answers a request: (answer, price). Clients are given by the caller."""

    def __call__(self, request: Any) -> tuple[Any, int]: ...


def utc_clock(now: Callable[[], datetime] = lambda: datetime.now(UTC)) -> Transport:
    return lambda request: ({"now": now().astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%S.%fZ")}, 0)
