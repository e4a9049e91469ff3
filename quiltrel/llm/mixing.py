"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

Sources by code point, null last, weigh 5, 2, 1, 5, ... and share all words; a target stops at
`copies` times its source's words and the excess goes to the others by weight. Slots of equal
size are dealt to sources by the van der Corput sequence: slot i's point, the bit reversal of i,
falls into the interval of one source on the scale of cumulative slot counts. A slot's rank
within its source names the block of the source's shuffled stream that it takes; the stream
begins anew after its end, `copies` times at most, and stops exactly at the target.

Null text: no words. Texts without words are never taken. A table without words: targets 0.
Repeated rows are separate documents. Extra columns are ignored. Results depend on the rows
alone: ties in the shuffle are rows equal in doc_id and size, whose order cannot be told apart
except by their share, which is dealt in row order of equal rows.

No group is gathered in one task: prefix sums run over (source, bucket) with a bucket count that
grows with the table, ranks over (source, chunk of slots).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiltrel.llm.common import broadcast_if_small, n_words, written

WEIGHTS, COPIES, BLOCK = (5, 2, 1), 3, 1024
_CHUNK = 1 << 16  # slots ranked together
_BUCKET = 20_000  # documents whose prefix sums run in one window group
_GRID = 4096


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, copies: int = COPIES) -> DataFrame:
    """sized (source, size) -> one row a source: source, k, weight, source_size, target.

    The level at which targets stop rising: sources ordered by the level copies * size / weight at
    which each is full; a source is full exactly if all words cover filling it and those before
    at its level. The windows hold one row a source."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = Window.orderBy(F.col("source").isNull(), F.encode(F.col("source"), "UTF-8"))
    cycle = F.array(*map(F.lit, weights))
    named = sums.withColumn("k", (F.row_number().over(place) - 1).cast("long")).withColumn(
        "weight", F.element_at(cycle, (F.col("k") % len(weights) + 1).cast("int")).cast("long")
    )
    cap = (F.lit(copies) * F.col("source_size")).cast("double")
    level = cap / F.col("weight")
    by_level = Window.orderBy("level", "k")
    everything = Window.partitionBy()
    filled = named.withColumns({"cap": cap, "level": level}).withColumns(
        {
            "capped": F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "open": F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)).cast("double"),
            "total": F.sum("source_size").over(everything).cast("double"),
        }
    )
    # water = level if this source and all after it stay below their caps
    water = (F.col("total") - F.col("capped")) / F.col("open")
    stops = filled.withColumns({"water": water, "fits": water <= F.col("level")})
    final = stops.withColumn("at", F.min(F.when(F.col("fits"), F.struct("level", "k", "water"))).over(everything))
    target = F.when(F.col("at").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * F.col("at")["water"]))
    return final.select("source", "k", "weight", F.col("source_size").cast("long").alias("source_size"), target.alias("target"))


def _reversed_bits(i: Column, bits: int) -> Column:
    return F.conv(F.reverse(F.lpad(F.bin(i), bits, "0")), 2, 10).cast("long")


def schedule(plan: DataFrame, block: int) -> DataFrame:
    """plan (k, source_size, target) -> slots: k, slot, rank (from 0, by slot, within the source).

    A source whose target takes r blocks owns r units of the scale; slots whose point lies beyond
    all units are void."""
    spark = plan.sparkSession
    blocks = F.ceil(F.col("source_size") / F.lit(block)).cast("long")
    rounds = F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))).cast("long")
    need = F.when(F.col("source_size") > 0, blocks * rounds + F.ceil((F.col("target") - rounds * F.col("source_size")) / block)).otherwise(0).cast("long")
    needed = plan.select("k", need.alias("need")).where("need > 0")
    row = needed.agg(F.sum("need"), F.count("*")).first()
    if not row[0]:
        return spark.range(0).select(F.col("id").alias("k"), F.col("id").alias("slot"), F.col("id").alias("rank"))
    units, sources = int(row[0]), int(row[1])
    bits = max(4, math.ceil(math.log2(units)))
    # the points of all 2**bits slots are 0 .. 2**bits - 1, each once: a source gets exactly its units
    lines = needed.withColumn("hi", F.sum("need").over(Window.orderBy("k"))).select("k", (F.col("hi") - F.col("need")).alias("lo"), "hi")
    width = max(1, -(-units // max(_GRID, 2 * sources)))
    grid = lines.select("k", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))).alias("cell"))
    slots = spark.range(1 << bits).select(F.col("id").alias("slot"), _reversed_bits(F.col("id"), bits).alias("point")).where(F.col("point") < units)
    dealt = (
        slots.withColumn("cell", F.floor(F.col("point") / width))
        .join(grid, "cell")
        .where("lo <= point AND point < hi")
        .select("k", "slot", F.floor(F.col("slot") / _CHUNK).alias("chunk"))
    )
    inside = dealt.withColumn("r", F.row_number().over(Window.partitionBy("k", "chunk").orderBy("slot")) - 1)
    before = Window.partitionBy("k").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("k", "chunk").count().select("k", "chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    return inside.join(starts, ["k", "chunk"]).select("k", "slot", (F.col("base") + F.col("r")).alias("rank"))


def mix(docs: DataFrame, *, block: int | None = None, weights: tuple[int, ...] = WEIGHTS, copies: int = COPIES) -> DataFrame:
    """docs (doc_id, text, source) -> doc_id, source, size, source_size, target, taken.

    block: words of a slot; by default 1024, and less where the table is small, so that every
    source gets a thousand slots on average."""
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", n_words().alias("size"))
    return mix_sized(written(sized, "sizes"), block=block, weights=weights, copies=copies)


def mix_sized(sized: DataFrame, *, block: int | None = None, weights: tuple[int, ...] = WEIGHTS, copies: int = COPIES, ident: str | None = None) -> DataFrame:
    """As mix(), from a written table doc_id, source, size. ident: a column of it that tells documents
    of one id apart and stays in the result."""
    plan = written(targets(sized, weights, copies), "targets")
    rows, words, sources = sized.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0)), F.approx_count_distinct("source")).first()
    block = block or max(1, min(BLOCK, int(words) // (1000 * max(1, sources))))
    buckets = max(1, -(-rows // _BUCKET))
    extra = [ident] if ident else []
    order = F.xxhash64("doc_id", "size", *extra, F.lit(41))
    named = sized.join(broadcast_if_small(plan), sized["source"].eqNullSafe(plan["source"])).select(
        "doc_id", sized["source"].alias("source"), "size", "k", "source_size", "target", order.alias("_order"), F.pmod(order, F.lit(buckets)).alias("bucket"), *extra
    )
    inside = Window.partitionBy("k", "bucket").orderBy("_order", "doc_id", "size", *extra)
    before = Window.partitionBy("k").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = named.groupBy("k", "bucket").agg(F.sum("size").alias("n")).select("k", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # n: makes equal rows (same id and size) separate documents
    streamed = written(
        named.withColumns({"upto": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)), "n": F.row_number().over(inside)})
        .join(bases, ["k", "bucket"])
        .withColumn("start", F.col("base") + F.col("upto") - F.col("size"))
        .select("doc_id", "source", "size", "k", "source_size", "target", "bucket", "n", "start", *extra),
        "streams",
    )
    # every slot's rank -> epoch and block of its source, up to the target
    slots = schedule(plan, block).join(plan.select("k", "source_size", "target"), "k")
    blocks = F.ceil(F.col("source_size") / F.lit(block)).cast("long")
    ranked = slots.withColumns({"b": F.col("rank") % blocks, "epoch": F.floor(F.col("rank") / blocks)})
    size = F.least(F.lit(block).cast("long"), F.col("source_size") - F.col("b") * block)
    left = F.floor("target") - F.col("epoch") * F.col("source_size") - F.col("b") * block
    used = ranked.select("k", "b", size.alias("len"), F.least(size, left).alias("take")).where("take > 0")
    taken = used.groupBy("k", "b").agg(
        F.sum((F.col("take") == F.col("len")).cast("long")).alias("full"),
        F.max(F.when(F.col("take") < F.col("len"), F.col("take"))).alias("part"),
    )
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    cuts = streamed.where("size > 0").select("k", "bucket", "n", "start", "size", F.explode(F.sequence(first, last)).alias("b"))
    lo = F.greatest(F.col("start") - F.col("b") * block, F.lit(0))
    hi = F.least(F.col("start") + F.col("size") - F.col("b") * block, F.lit(block).cast("long"))
    share = F.col("full") * (hi - lo) + F.greatest(F.lit(0), F.least(hi, F.coalesce("part", F.lit(0))) - lo)
    got = cuts.join(taken, ["k", "b"]).groupBy("k", "bucket", "n").agg(F.sum(share).cast("long").alias("taken"))
    return streamed.join(got, ["k", "bucket", "n"], "left").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), *extra
    )


def digest(mixed: DataFrame) -> DataFrame:
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")
