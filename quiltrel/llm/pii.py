"""Personal data by weak supervision, in DataFrame operations only.

Candidate spans come from patterns. Four labelers (format, checksum, gazetteer, context) vote
for, against or not at all on each. Votes are counted by pattern over the whole corpus; the
pattern table has at most len(KINDS) * 3**4 * 4 rows, and only it reaches the driver, where
expectation-maximisation estimates how reliable each labeler is and a logistic span classifier
is fitted to the resulting posteriors. Its score is then one native expression on each span.

Texts are whole; null is the empty text. Quantifiers are possessive or over one character
class, so long runs neither recurse nor backtrack quadratically. Spans of the base rules are
always kept. Repeated rows count as often as they stand. An empty table gives no rows. Extra
columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiltrel.llm.common import text_or_empty, written
from quiltrel.llm.secrets import found_if, joined

KINDS = ("email", "ip", "card", "phone", "tel", "ssn", "iban")
BASE = KINDS[:4]
VOTERS = ("format", "check", "gazetteer", "context")

PATTERNS = {
    # a run's first character or the end of the match before: no other start can do better
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "tel": r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
}
#: A cheap test that every text with a span of the kind passes.
GATES = {
    "email": "@",
    "phone": "+",
    "card": r"[0-9](?:[\x20-]?[0-9]){11}",
}
_OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
CUES = {
    "email": "mail|contact|write|address",
    "ip": r"\bip\b|host|server|address|login|from",
    "card": "card|visa|mastercard|amex|pay|credit",
    "phone": "phone|tel|call|mobile|fax|contact|dial",
    "tel": "phone|tel|call|mobile|fax|contact|dial",
    "ssn": "ssn|social|security",
    "iban": "iban|account|bank|konto",
}
AGAINST = r"(?i:version|order|invoice|isbn|part no|build|article|ticket)[^A-Za-z]{0,8}$"
GAZETTEER = {
    "email": r"\.(?i:com|org|net|edu|gov|io|info|biz|de|fr|es|uk|eu|it|nl|ch|at|us|ca|au|jp|cn|in|br|mx|ru|pl)$",
    "ip": r"^(?!0|10\.|127\.|192\.168\.|2[3-5][0-9]\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)",
    "phone": r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "tel": r"^\(?[2-9]",
    "ssn": r"^(?!000|666|9)",
    "iban": r"^(?:AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IT|LT|LU|LV|MT|NL|NO|PL|PT|RO|SE|SI|SK)",
}


def luhn(digits: Column) -> Column:
    """Does a string of digits pass the Luhn sum?"""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c: F.ascii(c) - 48)
    doubled = F.transform(each, lambda d, i: F.when(i % 2 == 0, d).when(d * 2 > 9, d * 2 - 9).otherwise(d * 2))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _passes(kind: str, m: Column) -> Column:
    """The rule of a kind, beyond its pattern."""
    n = F.length(_digits(m))
    if kind == "ip":
        return m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.when(n.between(12, 19), luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _check(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    if kind == "email":
        return F.length(m).between(6, 254) & ~m.rlike(r"\.\.|^\.|\.@")
    if kind == "ip":
        return m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$") & ~m.rlike(r"(?:^|\.)0[0-9]")
    if kind in ("phone", "tel"):
        return n.between(10, 14)
    if kind == "ssn":
        return ~m.rlike("^(?:000|666|9)|-00-|-0000$")
    if kind == "iban":
        return F.length(F.replace(m, F.lit(" "), F.lit(""))).between(15, 34)
    return _passes(kind, m)


def candidates(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs (keep..., text) -> keep, found: array<struct<kind, start, end, base, v0..v3, size>>."""
    t = text_or_empty()
    parts = []
    hits = {}
    for kind in KINDS:
        gate = GATES.get(kind)
        test = None if gate is None else (t.contains(gate) & t.rlike(PATTERNS[kind]) if len(gate) == 1 else t.rlike(gate))
        hits[kind] = found_if(t, PATTERNS[kind], test)
    staged = docs.select(*keep, t.alias("_t"), *(h.alias(f"_{k}") for k, h in hits.items()))
    for kind in KINDS:
        usable = F.filter(F.col(f"_{kind}"), lambda h: F.length(_digits(h["m"])) >= 12) if kind == "card" else F.col(f"_{kind}")

        def span(h: Column) -> Column:
            m = h["m"]
            before = F.substring(F.col("_t"), F.greatest(h["start"] - 39, F.lit(1)).cast("int"), F.least(h["start"], F.lit(40)).cast("int"))
            vote = lambda test: F.when(test, 1).otherwise(0)
            return F.struct(
                F.lit(kind).alias("kind"),
                h["start"].alias("start"),
                h["end"].alias("end"),
                (_passes(kind, m) if kind in BASE else F.lit(False)).alias("base"),
                vote(_passes(kind, m)).alias("v0"),
                vote(_check(kind, m)).alias("v1"),
                F.when(m.rlike(GAZETTEER[kind]), 1).otherwise(-1 if kind in ("email", "phone") else 0).alias("v2"),
                F.when(before.rlike(AGAINST), 0).when(before.rlike(f"(?i:{CUES[kind]})"), 1).otherwise(-1).alias("v3"),
                F.least(F.floor((h["end"] - h["start"]) / 8), F.lit(3)).cast("int").alias("size"),
            )

        kind_of = "array<struct<kind:string,start:bigint,end:bigint,base:boolean,v0:int,v1:int,v2:int,v3:int,size:int>>"
        parts.append(F.when(F.size(f"_{kind}") > 0, F.transform(usable, span).cast(kind_of)).otherwise(F.expr(f"cast(array() as {kind_of})")))
    return staged.select(*keep, F.concat(*parts).alias("found"))


def vote_patterns(found: DataFrame) -> list[tuple[tuple, int]]:
    """((kind, v0..v3, size), count) over the corpus: a bounded number of rows."""
    names = ("kind", "v0", "v1", "v2", "v3", "size")
    rows = found.where(F.size("found") > 0).select(F.explode("found").alias("c")).groupBy(*(F.col(f"c.{n}").alias(n) for n in names)).count().collect()
    return sorted((tuple(r[:6]), r["count"]) for r in rows)


@dataclass
class SpanModel:
    reliability: dict[tuple[str, int], tuple[float, float]] = field(default_factory=dict)  # (kind, voter): P(for | private), P(for | not)
    weights: dict[str, float] = field(default_factory=dict)

    def score(self, c: Column) -> Column:
        """The classifier's log odds of a candidate."""
        w = self.weights
        total = F.lit(w.get("bias", 0.0))
        for k in KINDS:
            total = total + F.when(c["kind"] == k, F.lit(w.get(f"kind={k}", 0.0))).otherwise(0.0)
        for j in range(len(VOTERS)):
            total = total + F.when(c[f"v{j}"] == 1, F.lit(w.get(f"v{j}=1", 0.0))).when(c[f"v{j}"] == 0, F.lit(w.get(f"v{j}=0", 0.0))).otherwise(0.0)
        return total + c["size"] * F.lit(w.get("size", 0.0))


def _features(pattern: tuple) -> dict[str, float]:
    kind, *votes, size = pattern
    out = {"bias": 1.0, f"kind={kind}": 1.0, "size": float(size)}
    out |= {f"v{j}={v}": 1.0 for j, v in enumerate(votes) if v >= 0}
    return out


def fit(patterns: list[tuple[tuple, int]], rounds: int = 30, steps: int = 150) -> SpanModel:
    """EM over counted vote patterns, one two-class model a kind; then weighted logistic regression."""
    model = SpanModel()
    posterior: dict[tuple, float] = {}
    for kind in KINDS:
        own = [(p, n) for p, n in patterns if p[0] == kind]
        if not own:
            continue
        prior, rate = 0.5, [(0.85, 0.25)] * len(VOTERS)
        for _ in range(rounds):
            for p, _n in own:
                odds = math.log(prior / (1 - prior))
                for (a, b), v in zip(rate, p[1:5], strict=True):
                    odds += math.log(a / b) if v == 1 else math.log((1 - a) / (1 - b)) if v == 0 else 0.0
                posterior[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
            mass = sum(n * posterior[p] for p, n in own)
            total = sum(n for _, n in own)
            prior = min(0.98, max(0.02, (mass + 2) / (total + 4)))
            fresh = []
            for j in range(len(VOTERS)):
                yes = sum(n * posterior[p] for p, n in own if p[1 + j] == 1)
                no = sum(n * posterior[p] for p, n in own if p[1 + j] == 0)
                yes0 = sum(n * (1 - posterior[p]) for p, n in own if p[1 + j] == 1)
                no0 = sum(n * (1 - posterior[p]) for p, n in own if p[1 + j] == 0)
                # the beta priors hold a labeler better than chance where the data say nothing
                a, b = (yes + 8.5) / (yes + no + 10), (yes0 + 2.5) / (yes0 + no0 + 10)
                fresh.append((max(a, b + 0.01) if a < b else a, b))
            rate = [(min(0.99, a), max(0.01, b)) for a, b in fresh]
        model.reliability |= {(kind, j): r for j, r in enumerate(rate)}
    rows = [(_features(p), n, posterior[p]) for p, n in patterns]
    scale = sum(n for _, n, _ in rows) or 1
    w: dict[str, float] = {}
    speed: dict[str, float] = {}
    for _ in range(steps):
        grad: dict[str, float] = {}
        for f, n, y in rows:
            z = sum(w.get(k, 0.0) * v for k, v in f.items())
            e = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - y) * n / scale
            for k, v in f.items():
                grad[k] = grad.get(k, 0.0) + e * v
        for k, g in grad.items():
            speed[k] = speed.get(k, 0.0) + g * g
            w[k] = w.get(k, 0.0) - 0.5 * g / (math.sqrt(speed[k]) + 1e-9) - 1e-4 * w.get(k, 0.0)
    model.weights = w
    return model


def spans(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs (keep..., text) -> keep, base and spans (both array<struct<kind,start,end>>). Spans are
    the base ones and every further candidate that the classifier accepts and no base span meets."""
    found = written(candidates(docs, keep), "pii")
    model = fit(vote_patterns(found))
    slim = lambda xs: F.transform(xs, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    base = F.filter("found", lambda c: c["base"])
    more = F.filter(
        "found",
        lambda c: ~c["base"]
        & (model.score(c) >= 0)
        & ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])),
    )
    return found.select(*keep, slim(base).alias("base"), slim(F.concat(base, more)).alias("spans"))


def redacted(text: Column, marks: Column) -> Column:
    """text with every span replaced by its kind in angle brackets; of overlapping spans the first."""
    ordered = F.array_sort(F.transform(marks, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    walked = F.aggregate(
        ordered,
        F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(
                s["start"] >= acc["at"],
                F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit("<"), s["kind"], F.lit(">")),
            )
            .otherwise(acc["out"])
            .alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))),
    )
    return F.when(F.size(marks) > 0, walked).otherwise(text)


def digest(found: DataFrame) -> DataFrame:
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *map(n, BASE),
        F.sha2(joined(F.col("base"), KINDS), 256).alias("base_sha256"),
        joined(F.col("spans"), KINDS).alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_more"),
    )
