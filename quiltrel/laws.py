"""Laws: named checks, the evidence of their runs, and what it says about the laws as they stand.

A law is a function that takes a session and returns how many cases it examined, or raises. Its
descriptor is the address of its name, milestone and source text; evidence of another descriptor is
stale.
"""

from __future__ import annotations

import hashlib
import importlib
import inspect
import pkgutil
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiltrel.functions.values import address

EVIDENCE = "law string, milestone string, descriptor string, verdict string, examined long, detail string, run_at string"
STATUSES = ("fresh", "failing", "conflicting", "stale", "pending")


class LawRefused(ValueError):
    pass


@dataclass(frozen=True)
class Law:
    name: str
    milestone: str
    check: Callable[[SparkSession], int]

    @property
    def descriptor(self) -> str:
        code = "sha256:" + hashlib.sha256(inspect.getsource(self.check).encode()).hexdigest()
        return address({"code": code, "law": self.name, "milestone": self.milestone, "tag": "law/1"})


def law(name: str, milestone: str = "1"):
    """Marks a function as a law."""

    def mark(fn: Callable[[SparkSession], int]) -> Callable[[SparkSession], int]:
        if not inspect.isfunction(fn) or fn.__name__ == "<lambda>":
            raise LawRefused("a law is a named function")
        fn.law = Law(name, milestone, fn)
        return fn

    return mark


def discovered(package: str) -> list[Law]:
    """Laws of a module, or of a package and all its modules, by name; a name stands for one law."""
    root = importlib.import_module(package)
    modules = [root, *(importlib.import_module(m.name) for m in pkgutil.walk_packages(getattr(root, "__path__", []), package + "."))]
    found: dict[str, Law] = {}
    for module in modules:
        for _, fn in inspect.getmembers(module, inspect.isfunction):
            own = getattr(fn, "law", None)
            if own is None or fn.__module__ != module.__name__:
                continue
            if own.name in found:
                raise LawRefused(f"{own.name} stands twice")
            found[own.name] = own
    return [found[k] for k in sorted(found)]


def run(spark: SparkSession, laws: Iterable[Law], folder: str | None = None) -> DataFrame:
    """Evidence of one run of each law; with a folder it is added to the evidence there."""
    rows = []
    for one in laws:
        at = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%S.%fZ")
        try:
            n, verdict, detail = one.check(spark), "holds", None
            if type(n) is not int or n < 1:
                n, verdict, detail = 0, "fails", "nothing was examined"
        except Exception as e:
            n, verdict, detail = 0, "fails", f"{type(e).__name__}: {e}"[:1000]
        rows.append((one.name, one.milestone, one.descriptor, verdict, n, detail, at))
    out = spark.createDataFrame(rows, EVIDENCE)
    if folder:
        out.coalesce(1).write.mode("append").parquet(folder)
    return out


def report(spark: SparkSession, laws: Iterable[Law], evidence: DataFrame) -> DataFrame:
    """law, milestone, status, examined: of the records with the present descriptor the verdict decides
    (conflicting: they disagree); records of other descriptors only are stale, none is pending."""
    now = spark.createDataFrame([(x.name, x.milestone, x.descriptor) for x in laws], "law string, milestone string, descriptor string")
    theirs = evidence.select("law", F.col("descriptor").alias("_d"), "verdict", F.col("examined").alias("_n"))
    own = F.col("descriptor") == F.col("_d")
    seen = now.join(theirs, "law", "left").groupBy("law", "milestone").agg(
        F.bool_or(own & (F.col("verdict") == "holds")).alias("held"),
        F.bool_or(own & (F.col("verdict") != "holds")).alias("failed"),
        F.count("_d").alias("records"),
        F.coalesce(F.max(F.when(own, F.col("_n"))), F.lit(0)).cast("long").alias("examined"),
    )
    status = F.when(F.col("held") & F.col("failed"), "conflicting").when(F.col("failed"), "failing").when(F.col("held"), "fresh").when(F.col("records") > 0, "stale").otherwise("pending")
    return seen.select("law", "milestone", status.alias("status"), "examined").orderBy("milestone", "law")
