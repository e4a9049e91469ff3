"""Annotated relations and their eight operators, compiled to DataFrames.

A relation's physical columns are its schema, sorted by name, and the leaves of its annotation.
Data-dependent refusals stand in filter conditions, where the optimizer keeps them.

Equal rows are merged late. select, project, map_rows, union and join are linear in the annotation,
so they take rows as they come, and an aggregate adds them up itself; only what depends on a row's
whole annotation (distinct, a signed right side of anti_join, a sink) merges first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiltrel.functions import semiring as S
from quiltrel.functions.values import canonical, canonical_column, nfc_column, ref_column
from quiltrel.operators import folding
from quiltrel.operators.algebra import Monoid
from quiltrel.tables import written


class RelationRefused(ValueError):
    pass


class OperatorRefused(ValueError):
    pass


def guard(bad: Column, message: str) -> Column:
    """A filter condition that passes every row and refuses the job at a bad one."""
    return F.when(bad, F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True))


@dataclass(frozen=True)
class Rel:
    df: DataFrame
    schema: tuple[str, ...]
    semiring: S.Semiring = S.ZxWhy
    merged: bool = True  # no two rows equal
    signed: bool = True  # a count may be below 1
    unit: bool = False  # every physical row counts once
    reason: str | None = None
    operators: frozenset[str] = frozenset()
    quarantined: DataFrame | None = None  # operator, reason, detail, row, n

    # -- construction
    @staticmethod
    def of(df: DataFrame, semiring: S.Semiring = S.Z, *, refs: Column | None = None, counts: Column | None = None, unique: bool = False, nfc: bool = False, reason: str | None = None) -> Rel:
        """Every row of df once (or `counts` times), with provenance {{refs}} (or {{}}). unique: no two
        rows of df are equal. nfc: text is brought to form C (it stops predicates from reaching a scan)."""
        names = tuple(sorted(df.columns))
        if len(set(names)) != len(names) or not names or any(n.startswith("__") for n in names):
            raise RelationRefused("a schema is non-empty, without repeats, and no name begins with __")
        for f in df.schema:
            if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.TimestampType, T.TimestampNTZType, T.DateType, T.BinaryType)):
                raise RelationRefused(f"{f.name}: {f.dataType.simpleString()} is not a value; lower it first")
        extra = {}
        for leaf, kind in semiring.leaves().items():
            if kind == "Z" and counts is not None:
                extra[leaf] = counts.cast("long")
            elif kind == "Why" and refs is not None:
                extra[leaf] = F.array(F.array(refs))
            else:
                extra[leaf] = S.one(kind)
        cell = lambda f: nfc_column(F.col(f.name)).alias(f.name) if nfc and isinstance(f.dataType, T.StringType) else F.col(f.name)
        cells = [cell(f) for f in sorted(df.schema, key=lambda f: f.name)]
        return Rel(
            df.select(*cells, *(c.alias(n) for n, c in extra.items())), names, semiring, merged=unique and not nfc,
            signed=counts is not None, unit=counts is None and semiring == S.Z, reason=reason,
        )

    @property
    def leaves(self) -> dict[str, str]:
        return self.semiring.leaves()

    def _zero(self) -> Column:
        test = F.lit(True)
        for leaf, kind in self.leaves.items():
            test = test & S.is_zero(kind, F.col(leaf))
        return test

    def consolidated(self) -> Rel:
        """Equal rows merged, annotations added, zero rows dropped."""
        if self.merged:
            return self
        got = self.df.groupBy(*self.schema).agg(*(S.add(k, c) for c, k in self.leaves.items()))
        return replace(self, df=got.where(~self._zero()) if self.signed else got, merged=True, unit=False)

    def without(self, leaf_kind: str) -> Rel:
        """Annotation pruning: the Z part of Z*Why, say. Legal wherever no sink reads the rest."""
        if self.semiring == S.ZxWhy and leaf_kind == "Why":
            # a row that has a witness and no count is no row of the counts alone
            return replace(self, df=self.df.where("__n <> 0").drop("__w"), semiring=S.Z)
        raise RelationRefused("only Z*Why can drop its Why")

    def checked(self) -> Rel:
        """Refuses a row with an empty provenance leaf."""
        whys = [c for c, k in self.leaves.items() if k == "Why"]
        df = self.df
        for c in whys:
            df = df.where(guard(F.size(c) == 0, "a row without a witness"))
        return replace(self, df=df)

    def multiplicity(self) -> Column:
        out = F.lit(1).cast("long")
        for c, k in self.leaves.items():
            out = out * S.multiplicity(k, F.col(c))
        return out

    def types(self) -> dict[str, T.DataType]:
        return {n: self.df.schema[n].dataType for n in self.schema}

    def canon(self) -> Column:
        return canonical_column({n: (F.col(n), t) for n, t in self.types().items()})

    def row_refs(self, source: str) -> Column:
        """The address of each row as a row of a source."""
        head = '{"row":'
        return ref_column(F.concat(F.lit(head), self.canon(), F.lit(f',"source":{canonical(source).decode()},"tag":"srcrow/1"}}')))

    def to_bag(self) -> DataFrame:
        """Rows as often as their multiplicity; a negative one is refused. Rows that count once each are
        the bag already; others are repeated in chunks, so no array is longer than CHUNK."""
        if self.unit:
            return self.df.select(*self.schema)
        rel = self.consolidated() if self.signed else self
        n = rel.multiplicity()
        df = rel.df.where(guard(n < 0, "a bag has no negative counts")).where(n > 0).withColumn("__m", n)
        chunks = df.withColumn("__i", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(__m - 1) div {CHUNK}"))))
        copies = F.least(F.col("__m") - F.col("__i") * CHUNK, F.lit(CHUNK)).cast("int")
        return chunks.select(*self.schema, F.explode(F.array_repeat(F.lit(0), copies)).alias("__i")).drop("__i")

    def annotated(self) -> DataFrame:
        """Rows with their annotation in plain columns: n, b, and w as text."""
        df = self.consolidated().df
        cols = []
        for c, k in self.leaves.items():
            text = F.array_join(F.array_sort(F.transform(F.col(c), lambda s: F.array_join(F.array_sort(s), "|"))), ";") if k == "Why" else F.col(c)
            cols.append(text.alias(c[2:]))
        return df.select(*self.schema, *cols)

    def address(self) -> str:
        """Content address of the whole relation: the root of a tree of digests over its merged rows, which
        are placed by the leading bits of their own hashes. One row reaches the driver."""
        from quiltrel.functions.values import address

        rel = self.consolidated()
        parts = [F.to_json(F.col(c)) if k == "Why" else F.col(c).cast("string") for c, k in rel.leaves.items()]
        ann = parts[0] if len(parts) == 1 else F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))
        text = F.concat(F.lit("["), rel.canon(), F.lit(","), ann, F.lit("]"))
        hashed = written(rel.df.select(F.sha2(text, 256).alias("h")), "hashes")
        n = hashed.count()
        bits = max(0, (n // FEW).bit_length())
        level = hashed.select(F.conv(F.substring("h", 1, 15), 16, 10).cast("long").alias("at"), "h").withColumn("at", F.shiftright("at", 60 - bits))
        while True:
            level = level.groupBy("at").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"))
            if bits == 0:
                break
            step = min(bits, 9)
            bits -= step
            # a digest is told apart by its place below the next one
            below = F.format_string("%03x", F.col("at").bitwiseAND(F.lit((1 << step) - 1)))
            level = level.select(F.shiftright("at", step).alias("at"), F.concat(below, F.col("h")).alias("h"))
        root = level.first()
        return address({"digest": root.h if root else "", "rows": n, "schema": list(self.schema), "semiring": self.semiring.name, "tag": "rel/2"})

    def _next(self, name: str, *others: Rel, **changes: Any) -> Rel:
        ops = self.operators.union(*(o.operators for o in others)) | {name}
        q = [x.quarantined for x in (self, *others) if x.quarantined is not None]
        if (fresh := changes.pop("fresh", None)) is not None:
            q.append(fresh)
        merged = None
        for x in q:
            merged = x if merged is None else merged.unionByName(x)
        return replace(self, operators=ops, quarantined=merged, **changes)

    def quarantine(self) -> DataFrame:
        """operator, reason, detail, row, n: equal ones merged."""
        spark = self.df.sparkSession
        if self.quarantined is None:
            return spark.createDataFrame([], "operator string, reason string, detail string, row string, n long")
        return self.quarantined.groupBy("operator", "reason", "detail", "row").agg(F.sum("n").cast("long").alias("n"))

    # -- the operators
    def select(self, predicate: Column | Callable[[dict], Any]) -> Rel:
        """Rows of which the predicate holds. A callable that raises quarantines the row."""
        if isinstance(predicate, Column):
            return self._next("select", df=self.df.where(predicate))
        a = self.consolidated()
        good, bad = tagged(a, predicate, T.BooleanType(), "select", bool)
        return a._next("select", df=good.where(F.col("__v")).drop("__v"), fresh=bad)

    def project(self, columns: Sequence[str]) -> Rel:
        """Annotations of rows that agree on the columns are added."""
        cols = _columns(columns, self.schema)
        whole = set(cols) == set(self.schema)
        return self._next("project", df=self.df.select(*cols, *self.leaves), schema=cols, merged=whole and self.merged)

    def map_rows(self, f: dict[str, Column] | Callable[[dict], dict], schema: str | None = None) -> Rel:
        """New rows by expressions, or by a callable with a declared schema (a DDL string). A row for which
        the callable raises or gives the wrong shape is quarantined."""
        if isinstance(f, dict):
            names = tuple(sorted(f))
            df = self.df.select(*(f[n].alias(n) for n in names), *self.leaves)
            return self._next("map_rows", df=df, schema=names, merged=False)
        kind = T._parse_datatype_string(schema)
        names = tuple(sorted(kind.names))

        def shaped(out: Any) -> tuple:
            if set(out) != set(kind.names):
                raise ValueError("the result has other columns than declared")
            for v in out.values():
                canonical(v)
            return tuple(out[n] for n in kind.names)

        a = self.consolidated()
        good, bad = tagged(a, f, kind, "map_rows", shaped)
        df = good.select(*(F.col("__v")[n].alias(n) for n in names), *self.leaves)
        return a._next("map_rows", df=df, schema=names, merged=False, fresh=bad)

    def union(self, other: Rel) -> Rel:
        """Annotations added."""
        _same_semiring(self, other)
        if self.schema != other.schema:
            raise OperatorRefused("union of different schemas")
        for n in self.schema:
            if self.types()[n] != other.types()[n]:
                raise OperatorRefused(f"{n}: {self.types()[n].simpleString()} and {other.types()[n].simpleString()} are different values")
        return self._next("union", other, df=self.df.unionByName(other.df), merged=False, signed=self.signed or other.signed, unit=self.unit and other.unit)

    def join(self, other: Rel, on: Sequence[str]) -> Rel:
        """Equal keys, null equal to null; annotations multiplied. The row determines both inputs' rows,
        so merged inputs give a merged result. A side that has no other columns than the keys is merged
        first: else its copies would be multiplied with the other side's."""
        keys = _columns(on, self.schema)
        _columns(on, other.schema)
        _same_semiring(self, other)
        if clash := (set(self.schema) & set(other.schema)) - set(keys):
            raise OperatorRefused(f"columns of both sides that are no keys: {sorted(clash)}")
        a, b = (x.consolidated() if set(x.schema) == set(keys) else x for x in (self, other))
        right = b.df.withColumnsRenamed({c: f"__right_{c}" for c in (*keys, *b.leaves)})
        match = [_equal(k, a.df, b.df) for k in keys]
        names = tuple(sorted({*a.schema, *b.schema}))
        anns = [S.mul(k, F.col(c), F.col(f"__right_{c}")).alias(c) for c, k in self.leaves.items()]
        return a._next(
            "join", b, df=a.df.join(right, match).select(*names, *anns), schema=names,
            merged=a.merged and b.merged, signed=a.signed or b.signed, unit=a.unit and b.unit,
        )

    def distinct(self) -> Rel:
        """Multiplicities above 0 become 1, others 0; provenance stays. No shuffle if merged."""
        if not self.semiring.bag:
            raise OperatorRefused(f"distinct over {self.semiring.name}, which has no counts to collapse")
        if self.unit:
            return self._next("distinct", df=self.df if self.merged else self.df.dropDuplicates(list(self.schema)), merged=True)
        a = self.consolidated()
        df = a.df
        for c, k in self.leaves.items():
            if k == "Z":
                df = df.where(guard(F.col(c) < 0, "distinct of a negative count")).withColumn(c, S.collapse(k, F.col(c)))
        out = a._next("distinct", df=df)
        return replace(out, df=out.df.where(~out._zero()))

    def anti_join(self, other: Rel, on: Sequence[str]) -> Rel:
        """Rows without a present partner. Where the right side is not empty, every support of a
        survivor gains the right side's address."""
        keys = _columns(on, self.schema)
        _columns(on, other.schema)
        _same_semiring(self, other)
        whys = [c for c, k in self.leaves.items() if k == "Why"]
        if len(whys) > 1:
            raise OperatorRefused("anti_join of more than one provenance leaf")
        b = other.consolidated() if other.signed else other
        n = b.multiplicity()
        present = b.df.where(guard(n < 0, "anti_join with a negative count")).where(n > 0) if b.signed else b.df
        there = present.select(*(F.col(k).alias(f"__right_{k}") for k in keys))
        # the keys of the right side are many or few copies: only the first case is worth merging them
        there = there.distinct() if not b.merged or set(keys) != set(b.schema) else there
        df = self.df.join(there, [_equal(k, self.df, b.df) for k in keys], "left_anti")
        if whys and not b.df.isEmpty():
            mark = b.address()
            w = whys[0]
            df = df.withColumn(w, S.minimal(F.array_distinct(F.transform(F.col(w), lambda s: F.array_sort(F.array_union(s, F.array(F.lit(mark))))))))
        return self._next("anti_join", other, df=df)

    def aggregate(self, by: Sequence[str], monoid: Monoid, value: Column | Callable[[dict], Any], into: str, kind: str = "long") -> Rel:
        """One row a group: the fold of the value, each as often as its multiplicity. A group with a null
        value has no row: all its members are quarantined, as they are where folding raises. value may
        be a callable with values of a declared kind; a row for which it raises is quarantined alone.
        Of a monoid without an aggregate of its own, runs of the rows in canonical order are folded
        apart and their results then in order: associativity makes that the same."""
        keys = _columns(by, self.schema)
        if not keys or not into or into in keys or not isinstance(monoid, Monoid):
            raise OperatorRefused("aggregate needs columns to group by, a new name and a monoid")
        if not self.semiring.bag:
            raise OperatorRefused(f"aggregate over {self.semiring.name}, which has no multiplicities")
        a = self.consolidated() if self.signed else self
        if isinstance(value, Column):
            rows, lost = a.df.withColumn("__x", value), None
        else:
            a = a.consolidated()
            rows, lost = tagged(a, value, T._parse_datatype_string(kind), "aggregate", lambda v: v)
            rows = rows.withColumnRenamed("__v", "__x")
        n = a.multiplicity()
        rows = rows.where(guard(n < 0, "aggregate of a negative count")) if a.signed else rows
        rows = rows.withColumn("__m", n)
        broken = F.bool_or(F.col("__x").isNull() & (F.col("__m") != 0))
        once = a.unit  # then every group counts 1 or more, and collapses to 1
        anns = [F.first("__n").alias("__n")] if once else [S.add(k, c) for c, k in self.leaves.items()]
        names = tuple(sorted({*keys, into}))
        if monoid.spark is not None:
            failed = F.when(F.col("__bad"), F.struct(F.lit("TypeError").alias("reason"), F.lit("a value of the group is null").alias("detail")))
            grouped = rows.groupBy(*keys).agg(monoid.spark(F.col("__x"), None if once else F.col("__m")).alias(into), broken.alias("__bad"), *anns).withColumn("__e", failed)
        else:
            grouped = folding.folded(rows.withColumn("__c", a.canon()), keys, monoid, into, rows.groupBy(*keys).agg(*anns))
        good = grouped.where(F.col("__e").isNull()).select(*names, *(S.collapse(k, F.col(c)).alias(c) for c, k in self.leaves.items()))
        dead = grouped.where(F.col("__e").isNotNull()).select(*(F.col(k).alias(f"__g_{k}") for k in keys), "__e")
        match = [F.col(k).eqNullSafe(F.col(f"__g_{k}")) for k in keys]
        bad = rows.join(dead, match).select(
            F.lit("aggregate").alias("operator"), F.col("__e.reason").alias("reason"), F.col("__e.detail").alias("detail"), a.canon().alias("row")
        ).distinct().withColumn("n", F.lit(1).cast("long"))
        bad = bad if lost is None else bad.unionByName(lost)
        return a._next("aggregate", df=good, schema=names, merged=True, signed=a.signed or self.semiring != S.Z, unit=self.semiring == S.Z and not a.signed, fresh=bad)


CHUNK = 10_000  # copies of a row that one array holds
FEW = 512  # row hashes that one digest takes in, about

OPERATORS = ("select", "project", "map_rows", "union", "join", "distinct", "anti_join", "aggregate")


def _columns(names: Sequence[str], schema: tuple[str, ...]) -> tuple[str, ...]:
    names = tuple(names)
    if not names or len(set(names)) != len(names) or not set(names) <= set(schema):
        raise OperatorRefused(f"{names} are not distinct columns of {schema}")
    return tuple(sorted(names))


def _same_semiring(a: Rel, b: Rel) -> None:
    if a.semiring.name != b.semiring.name:
        raise OperatorRefused(f"annotations differ: {a.semiring.name} and {b.semiring.name}")


def _equal(key: str, left: DataFrame, right: DataFrame) -> Column:
    """Null equals null. Where either side has no nulls, plain equality says the same and needs one key."""
    a, b = F.col(key), F.col(f"__right_{key}")
    return a.eqNullSafe(b) if left.schema[key].nullable and right.schema[key].nullable else a == b


def tagged(rel: Rel, f: Callable, kind: T.DataType, operator: str, shape: Callable[[Any], Any]) -> tuple[DataFrame, DataFrame]:
    """A callable over rows, in Arrow batches, evaluated once and stored: (rows with __v, quarantine)."""
    from pyspark.sql.pandas.types import to_arrow_type

    names, arrow = rel.schema, to_arrow_type(kind)
    k = len(rel.df.columns)

    def value(row: dict) -> tuple[Any, str | None, str | None]:
        try:
            out = shape(f(row))
            if isinstance(kind, T.StructType):
                out = dict(zip(kind.names, out, strict=True))
            return pa.scalar(out, arrow).as_py(), None, None
        except Exception as e:  # a failing row is data, not a failing job
            return None, type(e).__name__, str(e) or type(e).__name__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.select(list(names)).to_pylist()
            out = [value(row) for row in cells]
            v, reason, detail = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:k], pa.array(v, arrow), pa.array(reason, pa.string()), pa.array(detail, pa.string())],
                names=[*batch.schema.names[:k], "__v", "__reason", "__detail"],
            )

    text = [T.StructField(c, T.StringType()) for c in ("__reason", "__detail")]
    df = written(rel.df.mapInArrow(run, T.StructType([*rel.df.schema.fields, T.StructField("__v", kind), *text])), operator)
    good = df.where(F.col("__reason").isNull()).drop("__reason", "__detail")
    bad = df.where(F.col("__reason").isNotNull()).select(
        F.lit(operator).alias("operator"), F.col("__reason").alias("reason"), F.col("__detail").alias("detail"), rel.canon().alias("row"), F.lit(1).cast("long").alias("n")
    )
    return good, bad
