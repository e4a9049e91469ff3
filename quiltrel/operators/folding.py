"""Ordered folds of monoids that Spark has no aggregate for.

Rows are ranged over the cluster by (group, canonical text), so that a hot group lies on as many
tasks as it needs; every task folds its run of each group, and the runs' results, one a group and
task, are folded in their order. Associativity makes the result that of one left fold.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiltrel.functions.values import canonical, decanonical
from quiltrel.operators.algebra import Monoid
from quiltrel.tables import written


def power(monoid: Monoid, x: Any, n: int) -> Any:
    """x folded n times, by squaring."""
    out = monoid.identity
    while n:
        if n & 1:
            out = monoid.op(out, x)
        x, n = (monoid.op(x, x) if n > 1 else x), n >> 1
    return out


def folded(rows: DataFrame, keys: tuple[str, ...], monoid: Monoid, into: str, annotations: DataFrame) -> DataFrame:
    """rows (keys, __x, __m, __c) -> keys, into, __e (why the group has no result, or null), and the
    columns of annotations."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = T._parse_datatype_string(monoid.kind)
    arrow = to_arrow_type(kind)
    key_fields = [rows.schema[k] for k in keys]
    g = len(keys)
    order = [*keys, "__c"]
    ranged = rows.select(*keys, "__c", "__m", "__x").repartitionByRange(*order).sortWithinPartitions(*order)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, acc, error, out = TaskContext.get().partitionId(), None, None, None, []

        def close() -> None:
            text = None if error else canonical(acc).decode()
            out.append((*at, part, text, *(error or (None, None))))

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:g] != at:
                    if at is not None:
                        close()
                    at, acc, error = row[:g], monoid.identity, None
                if error or not row[g + 1]:
                    continue
                try:
                    if row[g + 2] is None:
                        raise TypeError("a value of the group is null")
                    acc = monoid.op(acc, power(monoid, row[g + 2], row[g + 1]))
                except Exception as e:
                    error = (type(e).__name__, str(e) or type(e).__name__)
        if at is not None:
            close()
        cols = zip(*out, strict=True) if out else [[]] * len(fields)
        yield pa.RecordBatch.from_arrays([pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(cols, fields, strict=True)], names=[f.name for f in fields])

    text = T.StringType()
    fields = [*key_fields, T.StructField("__part", T.LongType()), *(T.StructField(c, text) for c in ("__acc", "__reason", "__detail"))]
    parts = written(ranged.mapInArrow(runs, T.StructType(fields)), "runs")
    # one entry for each task that holds rows of the group
    lists = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__part", "__acc", "__reason", "__detail"))).alias("__parts"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            results, errors = [], []
            for entries in batch.column(g).to_pylist():
                failed = next((e for e in entries if e["__reason"] is not None), None)
                try:
                    if failed:
                        raise ValueError
                    acc = monoid.identity
                    for e in entries:
                        acc = monoid.op(acc, decanonical(e["__acc"]))
                    results.append(pa.scalar(acc, arrow).as_py())
                    errors.append(None)
                except Exception as e:
                    results.append(None)
                    errors.append({"reason": failed["__reason"], "detail": failed["__detail"]} if failed else {"reason": type(e).__name__, "detail": str(e) or type(e).__name__})
            yield pa.RecordBatch.from_arrays([*batch.columns[:g], pa.array(results, arrow), pa.array(errors, to_arrow_type(why))], names=[*keys, into, "__e"])

    why = T.StructType([T.StructField("reason", text), T.StructField("detail", text)])
    done = lists.mapInArrow(whole, T.StructType([*key_fields, T.StructField(into, kind), T.StructField("__e", why)]))
    named = annotations.withColumnsRenamed({k: f"__a_{k}" for k in keys})
    return done.join(named, [F.col(k).eqNullSafe(F.col(f"__a_{k}")) for k in keys]).drop(*(f"__a_{k}" for k in keys))
