"""Signed differences of relations, and maintenance of results from them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiltrel.functions import semiring as S
from quiltrel.operators.algebra import AbelianGroup
from quiltrel.operators.relation import Rel, RelationRefused, guard

OVER = "more was retracted than there was"


def negate(rel: Rel) -> Rel:
    """Counts inverted, provenance kept."""
    if not S.is_delta(rel.semiring):
        raise RelationRefused(f"{rel.semiring.name} has no differences")
    cols = {c: S.negate(k, F.col(c)) for c, k in rel.leaves.items()}
    return replace(rel, df=rel.df.withColumns(cols), signed=True, unit=False)


def diff(new: Rel, old: Rel) -> Rel:
    """What turns old into new. A row whose annotation alone moved has count 0 and new's provenance."""
    a, b = new.consolidated(), old.consolidated()
    names = a.schema
    right = b.df.withColumnsRenamed({c: f"__o{c}" for c in b.df.columns}).withColumn("__was", F.lit(True))
    left = a.df.withColumn("__is", F.lit(True))
    both = left.join(right, [F.col(c).eqNullSafe(F.col(f"__o{c}")) for c in names], "full")
    cells = [F.when(F.col("__is"), F.col(c)).otherwise(F.col(f"__o{c}")).alias(c) for c in names]
    same, anns = F.col("__is") & F.col("__was"), []
    for c, k in a.leaves.items():
        same = same & F.col(c).eqNullSafe(F.col(f"__o{c}"))
        if k == "Z":
            anns.append((F.coalesce(F.col(c), F.lit(0)) - F.coalesce(F.col(f"__o{c}"), F.lit(0))).alias(c))
        elif k == "Why":
            anns.append(F.coalesce(F.col(c), F.col(f"__o{c}")).alias(c))
        else:
            raise RelationRefused("only structures with counts have differences")
    return replace(a, df=both.where(~F.coalesce(same, F.lit(False))).select(*cells, *anns), merged=True, signed=True, unit=False)


def apply(base: Rel, delta: Rel, dead: DataFrame | None = None) -> Rel:
    """base plus delta: over-retraction refused, rows without a count dropped, then supports with a
    dead ref (a column `ref`) removed everywhere, and rows left without a witness refused."""
    df = base.df.unionByName(delta.df).groupBy(*base.schema).agg(*(S.add(k, c) for c, k in base.leaves.items()))
    counts = [c for c, k in base.leaves.items() if k == "Z"]
    for c in counts:
        df = df.where(guard(F.col(c) < 0, OVER))
    gone = F.lit(True)
    for c in counts:
        gone = gone & (F.col(c) == 0)
    df = df.where(~gone) if counts else df
    # what is left has a count of 1 or more in its only count slot
    out = replace(base, df=df, merged=True, unit=False, signed=len(counts) != 1)
    if dead is not None:
        out = without_dead(out, dead)
    return out.checked()


def without_dead(rel: Rel, dead: DataFrame) -> Rel:
    """Supports that hold a dead ref are dropped: exploded, looked up and put together again by the row
    itself, so that no list of dead refs has to fit anywhere and a task that runs again finds the same."""
    rel = rel.consolidated()
    df = rel.df
    gone = dead.select(F.col("ref").alias("__ref")).distinct().withColumn("__dead", F.lit(True))
    for c in S.why_slots(rel.semiring):
        rest = [x for x in df.columns if x != c]
        flat = df.select(*rest, F.explode_outer(c).alias("__s")).select(*rest, "__s", F.explode_outer("__s").alias("__ref"))
        seen = flat.join(gone, "__ref", "left").groupBy(*rest, "__s").agg(F.coalesce(F.bool_or("__dead"), F.lit(False)).alias("__hit"))
        live = F.collect_list(F.when(~F.col("__hit"), F.col("__s")))
        df = seen.groupBy(*rest).agg(F.array_sort(live).alias(c)).select(*rest, c)
    return replace(rel, df=df)


LINEAR = ("select", "project", "map_rows", "union")


def linear_delta(op: str, *deltas: Rel, **params: Any) -> Rel:
    """select, project, map_rows and union: the change of the output is the output of the change. No other
    operator is linear, and none but these is taken."""
    if op not in LINEAR:
        raise RelationRefused(f"{op} is not linear")
    return getattr(deltas[0], op)(*deltas[1:], **params)


def join_delta(a_new: Rel, d_a: Rel, b_old: Rel, d_b: Rel, on: Sequence[str]) -> Rel:
    """Change of a join: the change of a with old b, and new a with the change of b."""
    return d_a.join(b_old, on).union(a_new.join(d_b, on))


def presence_delta(old: Rel | None, change: Rel, on: Sequence[str]) -> Rel:
    """Keys that a relation of counts gains (1) or loses (-1) by a change. Over all columns that is the
    change of its distinct."""
    if change.semiring != S.Z:
        raise RelationRefused("presence follows changes of counts alone")
    keys = sorted(on)
    rows = change.df.select(*keys, "__n", F.lit(0).cast("long").alias("__o"))
    if old is not None:
        rows = rows.unionByName(old.df.select(*keys, "__n", F.col("__n").alias("__o")))
    net = rows.groupBy(*keys).agg(F.sum("__n").alias("__n"), F.sum("__o").alias("__o")).where(guard((F.col("__n") < 0) | (F.col("__o") < 0), OVER))
    sign = (F.col("__n") > 0).cast("long") - (F.col("__o") > 0).cast("long")
    return Rel(net.select(*keys, sign.alias("__n")).where("__n <> 0"), tuple(keys), S.Z)


def anti_join_delta(a_old: Rel | None, d_a: Rel | None, b_old: Rel | None, d_b: Rel | None, b_new: Rel, on: Sequence[str]) -> Rel:
    """Change of an anti-join over counts: the change of a without partners in new b, and the rows of old a
    whose last partner went or whose first one came. None: nothing there, or nothing that changed."""
    parts = [] if d_a is None else [replace(d_a.anti_join(b_new, on), signed=True)]
    if a_old is not None and d_b is not None:
        parts.append(a_old.join(negate(presence_delta(b_old, d_b, on)), on))
    return parts[0] if len(parts) == 1 else parts[0].union(parts[1])


def replace_delta(out_new: Rel, out_old: Rel) -> Rel:
    """For distinct, anti_join and folds: recomputed, then differenced."""
    return diff(out_new, out_old)


def group_aggregate_delta(d_in: Rel, by: Sequence[str], group: AbelianGroup, value: Column, into: str, out_old: DataFrame | None) -> DataFrame:
    """Totals kept by subtraction. out_old and the result: by..., into, __rows (count of the group), and
    the provenance of d_in if it has any. A group whose count reaches 0 goes, one whose count would
    fall below it is refused. Only the change is aggregated. A null value refuses the job: its group
    could not be brought back by subtraction."""
    if not isinstance(group, AbelianGroup) or group.spark is None:
        raise RelationRefused("subtraction needs a group with an aggregate of its own")
    keys = sorted(by)
    slots = S.group_slots(d_in.semiring)
    if len(slots) != 1:
        raise RelationRefused("subtraction needs exactly one count")
    whys = S.why_slots(d_in.semiring)
    rows = d_in.consolidated().df.withColumns({"__x": value, "__m": F.col(slots[0])})
    rows = rows.where(guard(F.col("__x").isNull() & (F.col("__m") != 0), "a value of the change is null"))
    change = rows.groupBy(*keys).agg(group.spark(F.col("__x"), F.col("__m")).alias(into), F.sum("__m").cast("long").alias("__rows"), *(S.add("Why", w) for w in whys))
    if out_old is None:
        both = change
    else:
        kind = change.schema[into].dataType
        old = out_old.select(*keys, F.col(into).cast(kind).alias(into), "__rows", *whys)
        one = F.lit(1).cast("long")
        both = old.unionByName(change).groupBy(*keys).agg(group.spark(F.col(into), one).alias(into), F.sum("__rows").cast("long").alias("__rows"), *(S.add("Why", w) for w in whys))
    return both.where(guard(F.col("__rows") < 0, OVER)).where("__rows <> 0")
