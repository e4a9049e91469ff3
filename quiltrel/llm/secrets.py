"""Secret scan in native expressions only: three pattern kinds plus entropy windows.

Every row is handled on its own: one scan, no shuffle, no Python. Texts are whole; null is the
empty text (no spans). Very long texts are safe: every quantifier is possessive or runs over
one character class, so the regular-expression engine never recurses per character.
Repeated rows give repeated results; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiltrel.llm.common import text_or_empty

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{6})"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a longer run than 20, from its first AKIA on
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"

#: Known harmless strings: identifiers with dashes, placeholders, alphabets, one repeated character.
ALLOW = (
    r"^(?:[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}"
    r"|(?i:.*(?:example|placeholder|changeme|dummy|sample|xxxx|0123456789|abcdefgh).*)"
    r"|(.)\1*|[A-Za-z_/=-]+|[0-9_/+=-]+)$"
)

SPAN = "array<struct<kind:string,start:long,end:long>>"
KINDS = ("assign", "access", "hex", "entropy")


def found(text: Column, pattern: str) -> Column:
    """array<struct<m, start, end>>: matches with offsets in code points. The gaps between
    matches come from split(), the matches from regexp_extract_all(); a running sum of both
    lengths gives the offsets."""
    gaps = F.split(text, pattern, -1)
    got = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = F.aggregate(
        F.zip_with(gaps, got, lambda g, m: F.struct(F.length(g).alias("g"), m.alias("m"))),
        F.struct(
            F.lit(0).cast("long").alias("at"),
            F.expr("cast(array() as array<struct<m:string,start:long,end:long>>)").alias("out"),
        ),
        lambda acc, x: F.when(x["m"].isNull(), acc).otherwise(
            F.struct(
                (acc["at"] + x["g"] + F.length(x["m"])).alias("at"),
                F.concat(
                    acc["out"],
                    F.array(
                        F.struct(
                            x["m"].alias("m"),
                            (acc["at"] + x["g"]).alias("start"),
                            (acc["at"] + x["g"] + F.length(x["m"])).alias("end"),
                        )
                    ),
                ).alias("out"),
            )
        ),
        lambda acc: acc["out"],
    )
    return start


EMPTY_FOUND = "cast(array() as array<struct<m:string,start:long,end:long>>)"


def found_if(text: Column, pattern: str, test: Column | None = None) -> Column:
    """found(), computed only for the texts that hold a match at all."""
    return F.when(text.rlike(pattern) if test is None else test, found(text, pattern)).otherwise(F.expr(EMPTY_FOUND))


def spans_of(hits: Column, kind: str) -> Column:
    return F.transform(
        hits, lambda h: F.struct(F.lit(kind).alias("kind"), h["start"].alias("start"), h["end"].alias("end"))
    )


def joined(spans: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """kind:start:end by start, then by kind in the listed order, comma-joined."""
    order = F.array(*map(F.lit, kinds))
    keyed = F.transform(
        spans,
        lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("k"), s["end"].alias("end"), s["kind"].alias("kind")),
    )
    return F.array_join(
        F.transform(
            F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
        ),
        ",",
    )


def entropy_run(word: Column, window: int, least: float) -> Column:
    """struct<first, last, bits>: the first and last window start whose Shannon entropy is at
    least `least` bits (first -1: none), and the highest entropy. One pass with a count per
    character: a step changes two counts and the running sum of c*log2(c) by their difference."""
    chars = F.transform(F.split(word, ""), F.ascii)  # candidates are ASCII
    part = lambda c: F.when(c > 1, c * F.log2(c)).otherwise(F.lit(0.0))

    def step(acc: Column, at: Column) -> Column:
        entering = F.element_at(acc["chars"], at)
        leaving = F.when(at > window, F.element_at(acc["chars"], F.greatest(at - window, F.lit(1)))).otherwise(F.lit(-1))
        plus = F.element_at(acc["n"], entering + 1)
        minus = F.when(leaving >= 0, F.element_at(acc["n"], F.greatest(leaving, F.lit(0)) + 1)).otherwise(F.lit(0))
        same = entering == leaving
        s = F.when(same, acc["s"]).otherwise(
            acc["s"] + part(plus + 1) - part(plus) + F.when(leaving >= 0, part(minus - 1) - part(minus)).otherwise(F.lit(0.0))
        )
        n = F.when(same, acc["n"]).otherwise(
            F.transform(
                acc["n"],
                lambda c, i: c + F.when(i == entering, 1).otherwise(0) - F.when(i == leaving, 1).otherwise(0),
            )
        )
        bits = F.lit(float(_log2(window))) - s / F.lit(float(window))
        hot = (at >= window) & (bits >= least)
        return F.struct(
            acc["chars"].alias("chars"),
            n.alias("n"),
            s.alias("s"),
            F.when(hot & (acc["first"] < 0), at - window).otherwise(acc["first"]).alias("first"),
            F.when(hot, at - window).otherwise(acc["last"]).alias("last"),
            F.greatest(acc["bits"], F.when(at >= window, bits).otherwise(F.lit(0.0))).alias("bits"),
        )

    return F.aggregate(
        F.sequence(F.lit(1), F.length(word)),
        F.struct(
            chars.alias("chars"),
            F.array_repeat(F.lit(0), 128).alias("n"),
            F.lit(0.0).alias("s"),
            F.lit(-1).alias("first"),
            F.lit(-1).alias("last"),
            F.lit(0.0).alias("bits"),
        ),
        step,
        lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last"), acc["bits"].alias("bits")),
    )


def _log2(x: float) -> float:
    import math

    return math.log2(x)


def scan(
    docs: DataFrame,
    *,
    window: int = 20,
    hex_bits: float = 2.9,
    mixed_bits: float = 3.6,
    keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """docs (with a column text) -> keep, base and spans (both array<struct<kind,start,end>>).

    Base kinds are the patterns above; the kind `entropy` adds, for every candidate string that
    the allow-list does not suppress, the run from its first to its last window of `window`
    characters with at least `hex_bits` (strings of hex digits) or `mixed_bits` (all others) of
    entropy, unless one base span already covers it."""
    t = text_or_empty()
    assigned = F.filter(
        found_if(t, ASSIGN), lambda h: h["m"].rlike(ASSIGN_VALUE)
    )
    base = docs.select(
        *keep,
        spans_of(assigned, "assign").alias("_a"),
        spans_of(found_if(t, ACCESS, t.contains("AKIA") & t.rlike(ACCESS)), "access").alias("_k"),
        spans_of(found_if(t, HEX), "hex").alias("_h"),
        found_if(t, CANDIDATE).alias("_c"),
    )
    windows = F.transform(
        F.filter(F.col("_c"), lambda c: ~c["m"].rlike(ALLOW)),
        lambda c: F.struct(
            c["start"].alias("at"),
            F.when(c["m"].rlike("^[0-9A-Fa-f]+$"), entropy_run(c["m"], window, hex_bits))
            .otherwise(entropy_run(c["m"], window, mixed_bits))
            .alias("run"),
        ),
    )
    hot = F.transform(
        F.filter(windows, lambda x: x["run"]["first"] >= 0),
        lambda x: F.struct(
            F.lit("entropy").alias("kind"),
            (x["at"] + x["run"]["first"]).cast("long").alias("start"),
            (x["at"] + x["run"]["last"] + window).cast("long").alias("end"),
        ),
    )
    staged = base.select(
        *keep,
        F.concat("_a", "_k", "_h").alias("base"),
        F.when(F.size("_c") > 0, hot).otherwise(F.expr(f"cast(array() as {SPAN})")).alias("_e"),
    )
    fresh = F.filter(
        F.col("_e"), lambda e: ~F.exists(F.col("base"), lambda b: (b["start"] <= e["start"]) & (e["end"] <= b["end"]))
    )
    return staged.select(*keep, "base", F.concat(F.col("base"), fresh).alias("spans"))


def digest(found_spans: DataFrame) -> DataFrame:
    """The columns of the query, from scan()'s spans."""
    n = lambda kind: F.size(F.filter(F.col("base"), lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found_spans.select(
        "doc_id",
        n("assign"),
        n("access"),
        n("hex"),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_entropy"),
    )
