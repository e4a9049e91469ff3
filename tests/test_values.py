from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quiltrel.functions.values import Lossy, ValueRefused, address, canonical, decanonical, first_difference, first_difference_column, is_ref, nfc_column, ref_hex
from quiltrel.operators.algebra import AlgebraRefused, Monoid
from quiltrel.sources.ingest import lowered


def test_canonical_text():
    assert canonical({"b": Decimal("1.50"), "a": [None, True, 1]}) == b'{"a":[null,true,1],"b":{"$decimal":"1.5"}}'
    assert canonical("é") == canonical("é")
    assert canonical(Decimal("-0.00")) == b'{"$decimal":"0"}'
    assert canonical(Decimal("1E+2")) == b'{"$decimal":"100"}'
    assert address(1) != address(True) != address(Decimal(1))


@pytest.mark.parametrize("bad", [1.5, b"x", (1,), {1: 2}, {"$decimal": "1"}, Decimal("NaN")])
def test_refused(bad):
    with pytest.raises(ValueRefused):
        canonical(bad)


@pytest.mark.parametrize("text", ["1.5", "NaN", '{"a":1,"a":2}', '{"$decimal":"x"}'])
def test_decode_refused(text):
    with pytest.raises(ValueRefused):
        decanonical(text)


def test_lossy():
    door = Lossy(Decimal("0.01"))
    assert [door(x) for x in (2.675, 1.005, 0.125, -0.125)] == [Decimal(x) for x in ("2.67", "1.00", "0.12", "-0.12")]


def test_monoid_laws():
    with pytest.raises(AlgebraRefused):
        Monoid("minus", lambda a, b: a - b, 0, (1, 2))


def test_refs():
    ref = address("x")
    assert is_ref(ref) and len(ref_hex(ref)) == 64 and not is_ref(ref.upper())
    with pytest.raises(ValueRefused):
        ref_hex("sha256:1")


def test_first_difference(spark):
    pairs = [(b"", b""), (b"abc", b"abc"), (b"abc", b"abd"), (b"ab", b"abc"), (b"", b"x"), (b"\x00\xff" * 500, b"\x00\xff" * 499 + b"\x01")]
    df = spark.createDataFrame(pairs, "a binary, b binary")
    got = [r[0] for r in df.select(first_difference_column(F.col("a"), F.col("b"))).collect()]
    assert got == [first_difference(a, b) for a, b in pairs] == [None, None, 2, 2, 0, 998]


def test_form_c_in_the_engine(spark):
    import unicodedata

    texts = ["e\u0301", "\u00e9", "plain", "\u1100\u1161", "\u212b", "q\u0323\u0307", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(nfc_column(F.col("t"))).collect()]
    assert got == [t and unicodedata.normalize("NFC", t) for t in texts]


def test_times_in_any_zone(spark):
    df = spark.sql("SELECT timestamp_micros(1704067200100000) AS a, timestamp_micros(1699165800000001) AS b, timestamp_micros(-1) AS c, timestamp_ntz'2024-03-10 02:30:00.5' AS d, date'2024-01-02' AS e")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", z)
            assert tuple(lowered(df).first()) == ("2024-01-01T00:00:00.1Z", "2023-11-05T06:30:00.000001Z", "1969-12-31T23:59:59.999999Z", "2024-03-10T02:30:00.5", "2024-01-02")
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
