"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quiltrel.shipping import ship
from quiltrel.tables import shared_folder, written

__all__ = ["BLANKS", "WORD", "broadcast_if_small", "documents", "n_words", "shared_folder", "text_or_empty", "written"]

#: White space of the word rules: space and the five ASCII controls 09-0D.
BLANKS = r"\x20\x09-\x0D"
WORD = rf"[^{BLANKS}]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(text: Column | str = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def n_words(text: Column | str = "text") -> Column:
    """Number of words of a text (null: 0)."""
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


#: Rows up to which a table of groups (languages, sources) is broadcast; beyond, it is joined by shuffle.
SMALL = 10_000


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """df, a written table, with a broadcast hint if it has at most SMALL rows."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df
