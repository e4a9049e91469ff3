"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as
the docs of the next; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quiltrel.llm import mixing, neardup, packing, pii, quality
from quiltrel.llm.common import BLANKS, documents, n_words, text_or_empty, written
from quiltrel.shipping import ship

#: The packed pieces follow a trained language model, a hash schedule and a tokenizer: not SQL.
ORACLE_SQL: str | None = None


def _with_text(row: DataFrame, text: Column, columns: list[str]) -> DataFrame:
    """The columns of documents from `_row`, with another text; n_chars follows it."""
    own = {"text": text, "n_chars": F.length(text).cast("long")}
    return row.select(*(own.get(c, F.col(f"_row.`{c}`")).alias(c) for c in columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the base rules or the perplexity bands reject. Null and empty texts
    go, repeated rows share their verdict, whole texts count however long, any further column is
    carried along and an empty table stays empty."""
    ship(spark)
    rows = docs.select(F.struct("*").alias("_row"), "lang", "text")
    return quality.verdicts(rows, ("_row", "lang")).where("kept").select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one document of each group of near-duplicates: of equal rows one, of ties the least
    doc_id (null last). Null texts are in no group and stay. Any further column is carried along; an
    empty table stays empty."""
    ship(spark)
    return neardup.deduplicated(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the kind of each personal span in its place. Null texts stay null, texts without spans
    as they are; overlapping spans become one. Row by row: repeated rows, any further column and an
    empty table need no rule."""
    found = pii.spans(docs.select(F.struct("*").alias("_row"), "text"), ("_row",))
    text = F.when(F.col("_row.text").isNotNull(), pii.redacted(F.col("_row.text"), F.col("spans")))
    return _with_text(found, text, docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and shortens documents to the words the mix takes: a document taken 2.4 times makes
    two whole rows and one of its first words. Documents of which nothing is taken go, so null texts
    and those without words. Rows equal in id, source and text share their words alike, and what does
    not divide comes from one row of them. An empty table gives none."""
    key = F.xxhash64("text", F.lit(5))
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", n_words().alias("size"), key.alias("key"))
    mixed = mixing.mix_sized(written(sized, "sizes"), ident="key")
    # rows equal in id, source and text are interchangeable and share alike
    total = mixed.groupBy("doc_id", "source", "key").agg(F.max("size").alias("size"), F.sum("taken").alias("all"), F.count("*").alias("n"))
    share = written(total.where("`all` > 0").select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("key").alias("_k"), "size", F.expr("`all` div n").alias("taken"), F.expr("`all` % n").alias("rest")), "shares")
    rows = docs.select(F.struct("*").alias("_row"), key.alias("_key"))
    match = (F.col("_key") == F.col("_k")) & F.col("_row.doc_id").cast("long").eqNullSafe(F.col("_id")) & F.col("_row.source").eqNullSafe(F.col("_source"))
    met = rows.join(share.where("taken > 0"), match).select("_row", "size", "taken")
    uneven = share.where("rest > 0")
    if not uneven.isEmpty():
        one = rows.join(uneven, match).groupBy("_k", "_id", "_source").agg(F.first("_row").alias("_row"), F.first("size").alias("size"), F.first("rest").alias("taken"))
        met = met.union(one.select("_row", "size", "taken"))
    text = text_or_empty(F.col("_row.text"))
    words = F.regexp_extract_all(text, F.lit(rf"[^{BLANKS}]+[{BLANKS}]*"), F.lit(0))
    rest = F.col("taken") % F.col("size")
    first = F.array_join(F.slice(words, F.lit(1), rest.cast("int")), "")
    copies = F.concat(
        F.array_repeat(text, F.floor(F.col("taken") / F.col("size")).cast("int")),
        F.when(rest > 0, F.array(first)).otherwise(F.expr("cast(array() as array<string>)")),
    )
    return _with_text(met.select("_row", F.explode(copies).alias("_text")), F.col("_text"), docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of 1024 tokens: one row a piece. A null or empty text has
    its closing id only, repeated rows are packed as often as they stand, further columns are left
    out, an empty table gives no piece."""
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("personal data", personal_data),
    ("source mix", source_mix),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs
