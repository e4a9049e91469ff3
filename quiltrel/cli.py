"""python -m quiltrel: run a pipeline with captures, or report on laws."""

from __future__ import annotations

import argparse
import importlib
import json
import sys
from pathlib import Path

from quiltrel.plans.captures import CaptureConflict, NovelRefused, Oracles, ReservationConflict, SpendRefused
from quiltrel.plans.oracles import Budget, BudgetRefused, UnitRefused

REFUSALS = (NovelRefused, SpendRefused, CaptureConflict, ReservationConflict, BudgetRefused, UnitRefused)


def budget_of(path: str | None, override: str | None) -> Budget:
    """A file {"unit": ..., "ceilings": {...}}, narrowed by an override `kind=n,...`; an override alone spends
    nothing, as there is no ceiling to narrow."""
    base = Budget({})
    if path:
        try:
            got = json.loads(Path(path).read_text())
            base = Budget(got["ceilings"], got.get("unit", "unit"))
        except (json.JSONDecodeError, KeyError, TypeError) as e:
            raise BudgetRefused(f"{path}: {e}") from e
    if override:
        pairs = dict(x.partition("=")[::2] for x in override.split(","))
        if not all(v.isdigit() for v in pairs.values()):
            raise BudgetRefused(f"{override}: kind=number, comma-separated")
        own = {k: int(v) for k, v in pairs.items()}
        base = base.clamped(Budget({**base.ceilings, **own}, base.unit))
    return base


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="quiltrel")
    commands = out.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run", help="call MODULE:CALLABLE(spark, oracles)")
    run.add_argument("target", metavar="MODULE:CALLABLE")
    run.add_argument("--store", required=True)
    run.add_argument("--budget")
    run.add_argument("--budget-override")
    run.add_argument("--spend", action="store_true", help="ask what is not captured; else only replay")
    laws = commands.add_parser("laws").add_subparsers(dest="action", required=True)
    report = laws.add_parser("report", help="what the evidence says about the laws of a package")
    report.add_argument("package")
    report.add_argument("--root", required=True, help="folder of the evidence")
    report.add_argument("--milestone")
    report.add_argument("--json", action="store_true")
    report.add_argument("--run", action="store_true", help="run the laws first and add their evidence")
    return out


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    from quiltrel.session import session

    try:
        if args.command == "run":
            budget = budget_of(args.budget, args.budget_override)  # before any of the pipeline's code is imported
            module, _, name = args.target.partition(":")
            spark = spark or session()
            out = getattr(importlib.import_module(module), name)(spark, Oracles(spark, args.store, budget, replay=not args.spend))
            if out is not None:
                print(out)
            return 0
        from quiltrel import laws

        spark = spark or session()
        found = [x for x in laws.discovered(args.package) if args.milestone in (None, x.milestone)]
        if args.run:
            laws.run(spark, found, args.root)
        evidence = spark.read.schema(laws.EVIDENCE).parquet(args.root) if args.run or _there(spark, args.root) else spark.createDataFrame([], laws.EVIDENCE)
        rows = [r.asDict() for r in laws.report(spark, found, evidence).collect()]  # one row a law
        print(json.dumps(rows) if args.json else "\n".join(f"{r['status']:12} {r['milestone']:4} {r['law']} ({r['examined']})" for r in rows))
        return 0 if all(r["status"] == "fresh" for r in rows) else 2
    except REFUSALS as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1


def _there(spark, root: str) -> bool:
    from quiltrel.files import Files

    return bool(Files(spark, root).names(""))
