"""Values, their canonical text and content addresses, and the door for floats."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from decimal import Decimal
from fractions import Fraction
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

REF = re.compile(r"sha256:[0-9a-f]{64}")


class ValueRefused(ValueError):
    """Not a value of the model."""


def _plain(d: Decimal) -> str:
    if not d.is_finite():
        raise ValueRefused("only finite decimals are values")
    sign, digits, exponent = d.as_tuple()
    text = "".join(map(str, digits)) + "0" * max(exponent, 0)
    if exponent < 0:
        text = text.rjust(1 - exponent, "0")
        text = (text[:exponent] + "." + text[exponent:]).rstrip("0").rstrip(".")
    text = text.lstrip("0") or "0"
    text = "0" + text if text[0] == "." else text
    return "-" + text if sign and text != "0" else text


def _shape(value: Any, above: tuple[int, ...] = ()) -> Any:
    if value is None or isinstance(value, bool) or type(value) is int:
        return value
    if isinstance(value, str):
        return unicodedata.normalize("NFC", value)
    if isinstance(value, Decimal):
        return {"$decimal": _plain(value)}
    if id(value) in above:
        raise ValueRefused("a value cannot hold itself")
    if isinstance(value, list):
        return [_shape(x, (*above, id(value))) for x in value]
    if isinstance(value, dict):
        out: dict[str, Any] = {}
        for k, v in value.items():
            if not isinstance(k, str):
                raise ValueRefused("keys are strings")
            name = unicodedata.normalize("NFC", k)
            if name in out or name == "$decimal":
                raise ValueRefused(f"key {name!r} is taken")
            out[name] = _shape(v, (*above, id(value)))
        return out
    raise ValueRefused(f"{type(value).__name__} is not a value")


def canonical(value: Any) -> bytes:
    """One byte string for each value: sorted keys, no blanks, NFC, minimal decimals."""
    return json.dumps(_shape(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()


def _once(pairs: list[tuple[str, Any]]) -> Any:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueRefused("a key stands twice")
    if "$decimal" in out:
        if len(out) != 1 or not isinstance(out["$decimal"], str) or not re.fullmatch(r"-?\d+(\.\d+)?", out["$decimal"]):
            raise ValueRefused("broken decimal")
        return Decimal(out["$decimal"])
    return out


def _refuse(text: str) -> Any:
    raise ValueRefused(f"{text} is not a value")


def decanonical(data: bytes | str) -> Any:
    try:
        return json.loads(data, object_pairs_hook=_once, parse_float=_refuse, parse_constant=_refuse)
    except json.JSONDecodeError as e:
        raise ValueRefused(str(e)) from e


def address(value: Any) -> str:
    return ref_of(canonical(value))


def ref_of(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()


def is_ref(x: object) -> bool:
    return isinstance(x, str) and REF.fullmatch(x) is not None


def ref_hex(ref: str) -> str:
    """The 64 digits of a ref."""
    if not is_ref(ref):
        raise ValueRefused(f"{ref!r} is no ref")
    return ref[7:]


def first_difference(a: bytes, b: bytes) -> int | None:
    """Offset of the first byte in which two strings differ (the shorter's length, if it begins the longer)."""
    n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return None if n == len(a) == len(b) else n


def first_difference_column(a: Column, b: Column) -> Column:
    """The same over two binary columns. Equal ones cost one comparison."""
    n = F.least(F.octet_length(a), F.octet_length(b))
    at = F.element_at(
        F.filter(F.sequence(F.lit(0), n - 1), lambda i: a.substr(i + 1, F.lit(1)) != b.substr(i + 1, F.lit(1))), 1
    )
    inside = F.when(a.substr(F.lit(1), n) != b.substr(F.lit(1), n), at).otherwise(n)
    return F.when(a == b, F.lit(None).cast("int")).otherwise(inside)


def nfc_column(text: Column) -> Column:
    """Unicode form C, by the library that Spark brings for collations. Text below U+0300 is in it already."""
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(False))
    return F.when(text.rlike(r"[^\x{0}-\x{2FF}]"), composed).otherwise(text)


class Lossy:
    """float -> nearest multiple of a decimal grid, ties to the even multiple, by exact rationals."""

    def __init__(self, grid: Decimal):
        if not isinstance(grid, Decimal) or not grid.is_finite() or grid <= 0:
            raise ValueRefused("the grid is a positive decimal")
        self.grid = grid

    def __call__(self, x: float) -> Decimal:
        if type(x) is not float or x != x or x in (float("inf"), float("-inf")):
            raise ValueRefused("only finite floats pass this door")
        whole = round(Fraction(x) / Fraction(self.grid))
        return Decimal(whole) * self.grid

    def to_value(self) -> dict[str, Any]:
        return {"lossy": self.grid}

    def column(self, x: Column, *, exact: bool = False) -> Column:
        """The door as a column, DECIMAL(38, s). A double whose shortest text has no more places than
        a power-of-ten grid, and is below 2**52 grid steps, casts exactly. Any other double is
        refused, or with exact=True every double goes through the rational function, row by row."""
        places = -self.grid.as_tuple().exponent
        kind = T.DecimalType(38, max(places, 0))
        if exact:
            return F.udf(lambda v: None if v is None else self(v), kind)(x)
        if places < 0 or self.grid != Decimal(1).scaleb(-places):
            raise ValueRefused("a grid that is no power of ten needs exact=True")
        cast = x.cast(kind)
        same = (cast.cast("double") == x) & (F.abs(x) < float(Fraction(2**52) * Fraction(self.grid)))
        return F.when(x.isNull(), F.lit(None).cast(kind)).when(same, cast).otherwise(
            F.raise_error(F.concat(F.lit("not on the grid: "), x.cast("string"))).cast(kind)
        )


def canonical_column(cells: dict[str, tuple[Column, T.DataType]]) -> Column:
    """The canonical text of a row, by built-in functions. Strings are taken as NFC already: ingest, and
    Rel.of with nfc=True, bring them to it."""
    fields = []
    for name in sorted(cells):
        col, kind = cells[name]
        if isinstance(kind, (T.FloatType, T.DoubleType, T.TimestampType, T.DateType, T.BinaryType)):
            raise ValueRefused(f"column {name}: {kind.simpleString()} is not a value")
        if isinstance(kind, T.DecimalType):
            text = col.cast("string")
            text = F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)
            col = F.when(col.isNotNull(), F.struct(text.alias("$decimal")))
        fields.append(col.alias(name))
    # to_json writes control characters in upper-case hex, the canonical text in lower case
    text = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    lower = text
    for code in (0x0B, 0x0E, 0x0F, *range(0x1A, 0x20)):
        lower = F.replace(lower, F.lit(f"\\u{code:04X}"), F.lit(f"\\u{code:04x}"))
    return F.when(text.contains("\\u00"), lower).otherwise(text)


def ref_column(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))
