"""Ingest of typed tables as annotated relations, and lineage back to their rows."""

from __future__ import annotations

from dataclasses import replace
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiltrel.functions import semiring as S
from quiltrel.functions.values import Lossy, nfc_column
from quiltrel.operators.relation import Rel, RelationRefused, guard


def instant(c: Column) -> Column:
    """A time as RFC 3339 text in UTC, with microseconds where there are any. The session's zone and its
    summer times have no part in it."""
    since = F.make_dt_interval(secs=(F.unix_micros(c).cast("decimal(24,0)") / 1_000_000).cast("decimal(18,6)"))
    plain = F.expr("timestamp_ntz'1970-01-01 00:00:00'") + since
    return F.concat(F.translate(plain.cast("string"), " ", "T"), F.lit("Z"))


def lowered(df: DataFrame, grid: str = "0.01", digits: int = 12) -> DataFrame:
    """Doubles through the lossy door to DECIMAL(digits, places), times to RFC 3339 text in UTC. A time
    without a zone (TIMESTAMP_NTZ) stays without one: the same text, but no Z at its end."""
    door = Lossy(Decimal(grid))
    places = max(-Decimal(grid).as_tuple().exponent, 0)
    cols = []
    for f in df.schema:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = door.column(c.cast("double")).cast(T.DecimalType(digits, places))
        elif isinstance(f.dataType, T.TimestampType):
            c = instant(c)
        elif isinstance(f.dataType, T.TimestampNTZType):
            c = F.translate(c.cast("string"), " ", "T")
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def _composed(df: DataFrame, nfc: bool) -> DataFrame:
    text = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)} if nfc else set()
    return df.select(*(nfc_column(F.col(c)).alias(c) if c in text else F.col(c) for c in sorted(df.columns)))


def ingest(df: DataFrame, source: str, store=None, *, nfc: bool = True) -> Rel:
    """Equal rows counted; each row is supported by its own source ref. With a store, the source's rows
    go into it first, so that lineage finds them; rows that it holds already are not added again."""
    names = tuple(sorted(df.columns))
    counted = _composed(df, nfc).groupBy(*names).agg(F.count("*").alias("__n"))
    bare = Rel(counted, names, S.Z)
    rel = Rel(counted.select(*names, "__n", F.array(F.array(bare.row_refs(source))).alias("__w")), names, signed=False)
    if store is not None:
        store.put_rows(source_rows(rel, source))
    return rel


def ingest_delta(source: str, arrivals: DataFrame | None, retractions: DataFrame | None = None, store=None, *, nfc: bool = True) -> Rel:
    """A change of a source: rows that come and rows that go, each with `occ` (how often, 1 and more;
    without that column once) and the same refs as ingest. A column `ref` gives a row's ref itself."""
    parts = []
    for df, sign in ((arrivals, 1), (retractions, -1)):
        if df is None:
            continue
        cells = sorted(set(df.columns) - {"occ", "ref"})
        occ = F.col("occ").cast("long") if "occ" in df.columns else F.lit(1).cast("long")
        own = F.col("ref") if "ref" in df.columns else F.lit(None).cast("string")
        rows = df.where(guard(F.coalesce(occ < 1, F.lit(True)), "occ counts from 1")) if "occ" in df.columns else df
        parts.append(_composed(rows.withColumns({"__n": occ * sign, "__given": own}).select(*cells, "__n", "__given"), nfc))
    if not parts:
        raise RelationRefused("a change has arrivals or retractions")
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    names = tuple(sorted(set(both.columns) - {"__n", "__given"}))
    given = F.coalesce(F.col("__given"), Rel(both, names, S.Z).row_refs(source))
    rel = Rel(both.select(*names, "__n", F.array(F.array(given)).alias("__w")), names, merged=False)
    out = rel.consolidated()
    if store is not None:
        store.put_rows(source_rows(out, source))
    return out


def net_delta(feed: DataFrame, *, nfc: bool = True) -> Rel:
    """A change of a source by its counts alone: rows with a signed count `occ`, equal ones added up."""
    names = tuple(sorted(set(feed.columns) - {"occ"}))
    net = _composed(feed.withColumnRenamed("occ", "__n"), nfc).groupBy(*names).agg(F.sum("__n").cast("long").alias("__n"))
    return Rel(net.where("__n <> 0"), names, S.Z)


def source_rows(rel: Rel, source: str) -> DataFrame:
    """ref, source, row: what lineage reads."""
    return rel.df.select(rel.row_refs(source).alias("ref"), F.lit(source).alias("source"), rel.canon().alias("row"))


def lineage(rel: Rel, sources: DataFrame, key: list[str], values: DataFrame | None = None) -> DataFrame:
    """One row for each row of rel, support and ref: key..., support (place of the support), at (place in
    it), ref, kind, source, row. kind: source-row, value (values holds the ref: ref, row), unresolved."""
    flat = rel.df.select(*key, F.posexplode("__w").alias("support", "__s")).select(*key, "support", F.posexplode("__s").alias("at", "ref"))
    out = flat.join(sources.dropDuplicates(["ref"]), "ref", "left")
    kind = F.when(F.col("source").isNotNull(), "source-row")
    if values is not None:
        known = values.dropDuplicates(["ref"]).select(F.col("ref").alias("__ref"), F.col("row").alias("__row"))
        out = out.join(known, F.col("ref") == F.col("__ref"), "left").withColumn("row", F.coalesce("row", "__row"))
        kind = kind.when(F.col("__ref").isNotNull(), "value")
    return out.select(*key, "support", "at", "ref", kind.otherwise("unresolved").alias("kind"), "source", "row")


def citations(rel: Rel, sources: DataFrame, key: list[str], values: DataFrame | None = None) -> DataFrame:
    """key..., citations: the supports of each row, in order, each a list of (ref, kind, source, row)."""
    cited = lineage(rel, sources, key, values)
    one = F.struct("ref", "kind", "source", "row")
    supports = cited.groupBy(*key, "support").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", one.alias("c")))), lambda x: x["c"]).alias("cs"))
    return supports.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("support", "cs"))), lambda x: x["cs"]).alias("citations"))


def unsigned(rel: Rel) -> Rel:
    """Says that every count of rel is 1 or more, and refuses the job where one is not."""
    bad = F.lit(False)
    for c in S.group_slots(rel.semiring):
        bad = bad | (F.col(c) < 1)
    return replace(rel, df=rel.df.where(guard(bad, "a count below 1")), signed=False)
