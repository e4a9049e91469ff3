"""Annotation structures as column expressions.

A structure keeps its annotation in one or more physical columns. `add` gives their aggregates,
`mul` and the others plain expressions; columns are passed as dicts from leaf name to Column.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

Cols = dict[str, Column]
WHY = "array<array<string>>"


class SemiringRefused(ValueError):
    pass


@dataclass(frozen=True)
class Leaf:
    kind: str  # Z, B or Why

    @property
    def name(self) -> str:
        return self.kind

    @property
    def bag(self) -> bool:
        return True

    def leaves(self, path: str = "") -> dict[str, str]:
        return {f"__{path}{ {'Z': 'n', 'B': 'b', 'Why': 'w'}[self.kind] }": self.kind}


@dataclass(frozen=True)
class Product:
    left: Leaf | Product
    right: Leaf | Product

    @property
    def name(self) -> str:
        part = lambda s: f"({s.name})" if isinstance(s, Product) else s.name
        return f"{part(self.left)}*{part(self.right)}"

    @property
    def bag(self) -> bool:
        return self.left.bag and self.right.bag

    def leaves(self, path: str = "") -> dict[str, str]:
        return self.left.leaves(path + "l_") | self.right.leaves(path + "r_")


Semiring = Leaf | Product
Z, B, Why = Leaf("Z"), Leaf("B"), Leaf("Why")


@dataclass(frozen=True)
class _Default(Product):
    """Count and provenance, with short column names."""

    @property
    def name(self) -> str:
        return "Z*Why"

    def leaves(self, path: str = "") -> dict[str, str]:
        return {f"__{path}n": "Z", f"__{path}w": "Why"}


ZxWhy = _Default(Z, Why)


def product(left: Semiring, right: Semiring) -> Semiring:
    return ZxWhy if (left, right) == (Z, Why) else Product(left, right)


def named(name: str) -> Semiring:
    """The structure of a name: Z, B, Why and their products, bracketed as `name` writes them."""
    parts = re.findall(r"Z|B|Why|\(|\)|\*", name)
    if "".join(parts) != name:
        raise SemiringRefused(f"{name!r} names no structure")

    def one_of(i: int) -> tuple[Semiring, int]:
        if parts[i : i + 1] == ["("]:
            out, i = pair(i + 1)
            if parts[i : i + 1] != [")"]:
                raise SemiringRefused(f"{name!r}: a bracket stays open")
            return out, i + 1
        if i >= len(parts) or parts[i] not in ("Z", "B", "Why"):
            raise SemiringRefused(f"{name!r} names no structure")
        return Leaf(parts[i]), i + 1

    def pair(i: int) -> tuple[Semiring, int]:
        left, i = one_of(i)
        if parts[i : i + 1] != ["*"]:
            return left, i
        right, i = one_of(i + 1)
        return product(left, right), i

    out, end = pair(0)
    if end != len(parts):
        raise SemiringRefused(f"{name!r} names no structure")
    return out


def group_slots(s: Semiring) -> tuple[str, ...]:
    """Columns of the counts."""
    return tuple(c for c, k in s.leaves().items() if k == "Z")


def why_slots(s: Semiring) -> tuple[str, ...]:
    return tuple(c for c, k in s.leaves().items() if k == "Why")


def is_delta(s: Semiring) -> bool:
    """Can its relations change by difference? Every leaf needs a negation, and one a count."""
    return "B" not in s.leaves().values() and bool(group_slots(s))


def minimal(u: Column) -> Column:
    """Supports without those that strictly contain another; sorted. The cheap case first: supports
    of one ref each never contain one another."""
    kept = F.filter(u, lambda s: ~F.exists(u, lambda o: (F.size(o) < F.size(s)) & (F.size(F.array_except(o, s)) == 0)))
    return F.array_sort(F.when(F.exists(u, lambda s: F.size(s) != 1), kept).otherwise(u))


def once_each(u: Column) -> Column:
    """Supports once each, sorted. array_distinct compares every pair of arrays; here only neighbours are
    compared. The outer array binds the sorted one, which would else be sorted anew for each element."""
    fresh = lambda a: F.filter(a, lambda s, i: ~s.eqNullSafe(F.get(a, i - 1)))
    return F.element_at(F.transform(F.array(F.sort_array(u)), fresh), 1)


def none_why() -> Column:
    return F.expr(f"cast(array() as {WHY})")


def one(kind: str) -> Column:
    return {"Z": F.lit(1).cast("long"), "B": F.lit(True), "Why": F.expr(f"cast(array(array()) as {WHY})")}[kind]


def add(kind: str, c: str) -> Column:
    if kind == "Z":
        return F.sum(c).alias(c)  # ANSI arithmetic refuses what does not fit
    if kind == "B":
        return F.bool_or(c).alias(c)
    return minimal(once_each(F.flatten(F.collect_set(c)))).alias(c)


def mul(kind: str, a: Column, b: Column) -> Column:
    if kind == "Z":
        return a * b
    if kind == "B":
        return a & b
    pairs = F.flatten(F.transform(a, lambda s: F.transform(b, lambda t: F.array_sort(F.array_union(s, t)))))
    return minimal(F.array_distinct(pairs))


def is_zero(kind: str, c: Column) -> Column:
    return {"Z": lambda: c == 0, "B": lambda: ~c, "Why": lambda: F.size(c) == 0}[kind]()


def multiplicity(kind: str, c: Column) -> Column:
    return {"Z": lambda: c, "B": lambda: c.cast("long"), "Why": lambda: (F.size(c) > 0).cast("long")}[kind]()


def collapse(kind: str, c: Column) -> Column:
    return F.when(c > 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")) if kind == "Z" else c


def negate(kind: str, c: Column) -> Column:
    if kind == "B":
        raise SemiringRefused("B has no negation")
    return -c if kind == "Z" else c


def surviving(w: Column, dead: Column) -> Column:
    return F.filter(w, lambda s: ~F.arrays_overlap(s, dead))
