"""Choosing a candidate by measured size, and comparing two productions byte by byte."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltrel.functions.values import first_difference_column


class CorpusRefused(ValueError):
    pass


def select_vertical(measured: DataFrame) -> DataFrame:
    """measured (candidate, loc, operators: array) -> the row of least loc * operators, then of fewest
    operators, then first by code point."""
    n = F.size(F.array_distinct("operators"))
    rank = F.struct((F.col("loc") * n).cast("long").alias("weight"), n.alias("operators"), F.encode("candidate", "UTF-8").alias("name"))
    least = measured.agg(F.min(F.struct(rank.alias("rank"), "candidate")).alias("m")).where("m IS NOT NULL")
    return least.select("m.candidate", "m.rank.weight", F.col("m.rank.operators").alias("n_operators"))


def compare(expected: DataFrame, ours: DataFrame) -> DataFrame:
    """expected, ours (item, output: text or bytes) -> item, offset, classification of every item whose
    outputs differ: `missing` and `extra` on one side only, else `differs` at a byte offset."""
    a = expected.select("item", F.col("output").cast("binary").alias("__a"), F.lit(True).alias("__in_a"))
    b = ours.select(F.col("item").alias("__item"), F.col("output").cast("binary").alias("__b"), F.lit(True).alias("__in_b"))
    both = a.join(b, F.col("item").eqNullSafe(F.col("__item")), "full")
    one = F.col("__in_a") & F.col("__in_b")
    kind = F.when(F.col("__in_b").isNull(), "missing").when(F.col("__in_a").isNull(), "extra").when(~F.col("__a").eqNullSafe(F.col("__b")), "differs")
    at = F.when(one, first_difference_column(F.coalesce("__a", F.lit(b"")), F.coalesce("__b", F.lit(b"")))).cast("long")
    return both.select(F.coalesce("item", "__item").alias("item"), at.alias("offset"), kind.alias("classification")).where("classification IS NOT NULL")
