"""Repeated substrings: hot passages, long and periodic repeats, copies, and colliding identifiers."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("quiltrel.llm")

from quiltrel.llm import substrings as S  # noqa: E402

rng = random.Random(11)
text = lambda n: " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(n))


def brute(raws):
    seen = Counter(b[p : p + 400] for b in raws for p in range(len(b) - 399))
    for b in raws:
        gone = np.zeros(len(b) + 1, int)
        for p in range(len(b) - 399):
            if seen[b[p : p + 400]] > 1:
                gone[p : p + 400] = 1
        yield int(gone.sum()), int((np.diff(np.insert(gone, 0, 0)) == 1).sum()), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()


def test_every_kind_of_repeat(spark):
    hot, long, base = text(80), text(700), text(300)
    texts = [f"{text(rng.randint(0, 60))} {hot} {text(rng.randint(0, 60))}" for _ in range(40)]
    texts += [long + text(30), text(20) + long, long[700:3500] + text(9), long, long]
    texts += [base, base.replace(" ", "  ", 1), base[:900] + "X" + base[901:], base[5:], "ab" * 900, "x" * 399, "x" * 400, "x" * 401, (text(40) + " ") * 6]
    texts += [None, "", "é" * 300, hot[:399], hot[1:]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    out = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in S.removals(docs).collect()}
    raws = [(t or "").encode() for t in texts]
    assert [out[i] for i in range(len(texts))] == list(brute(raws))


def test_the_operator_gives_kept_bytes_and_spans_and_the_query_derives_from_them(spark):
    hot, twice, umlauts = text(80), text(90), "ü" * 199
    texts = [f"{text(9)} {hot} {text(9)} {twice} é", f"é {hot} {text(30)}", f"{twice}", twice, hot[:399], "x" * 401, None, "a" + umlauts + "ä", "b" + umlauts + "ö", text(200)]
    ids = [*range(len(texts) - 1), None]
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(3)
    raws = {i: (t or "").encode() for i, t in zip(ids, texts)}
    want = dict(zip(ids, brute(raws.values())))
    rows = S.cut(docs).collect()
    assert len(rows) == len(ids)
    for r in rows:
        raw, spans, at = raws[r.doc_id], [tuple(s) for s in r.spans], 0
        left = b"".join(raw[a:b] for a, b in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(raw)]))
        assert left == bytes(r.kept) and r.n_bytes == len(raw)
        assert (sum(e - s for s, e in spans), len(spans), hashlib.sha256(left).hexdigest()) == want[r.doc_id]
        for s, e in spans:  # maximal: runs never touch
            assert at <= s < e and (s > at or not at)
            at = e
    assert len({r.doc_id: r.spans for r in rows}[0]) == 2
    got = S.removals(docs)
    assert got.columns[:5] == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    kept = {r.doc_id: bytes(r.kept) for r in rows}
    assert all(r.text == kept[r.doc_id].decode(errors="replace") for r in got.collect())


def test_a_removed_run_may_divide_a_character(spark):
    docs = spark.createDataFrame([(1, "ä" + "z" * 399), (2, "å" + "z" * 399)], "doc_id long, text string")  # C3 A4, C3 A5
    shared = spark.createDataFrame([(3, "\u00e4" + "y" * 399 + "1"), (4, "\u0124" + "y" * 399 + "2")], "doc_id long, text string")  # both end in A4
    got = {r.doc_id: (r.n_removed, r.text) for r in S.removals(docs.union(shared)).collect()}
    assert got == {1: (0, "ä" + "z" * 399), 2: (0, "å" + "z" * 399), 3: (400, "\ufffd1"), 4: (400, "\ufffd2")}


def test_chains_of_anchors_settle_the_inside_of_a_long_repeat(spark):
    shared = text(900)
    docs = spark.createDataFrame([(i, text(50) + shared + text(50)) for i in range(3)], "doc_id long, text string")
    texts, _ = S._bucketed(S.keyed(docs))
    standing = S._looked_up(texts.select("k1", "k2", "raw").mapInArrow(S._anchor_rows, S._ROW), "anchors")
    rows = S.refined(standing).collect()
    assert len(rows) > 30 and 0 < sum(r.shown for r in rows) <= len(rows) / 2
    raw = {(r.k1, r.k2): bytes(r.raw) for r in texts.collect()}
    strings = Counter(b[p : p + 400] for b in raw.values() for p in range(len(b) - 399))
    assert all(strings[raw[r.k1, r.k2][p : p + 400]] > 1 for r in rows for p in (r.lo, r.hi))


@pytest.mark.parametrize("third, kept", [((5, 5), [3, 2]), ((5, 6), [1, 1])])
def test_identifiers_that_collide_remove_nothing(third, kept):
    """Equal in 64-bit identifiers of core and context; only the second identifiers tell them apart."""
    one = lambda *x: pa.array(x, pa.int64())
    names = ["route", "second", "third", "k1", "k2", "at", "sure", "own"]
    batch = pa.RecordBatch.from_arrays([one(1, 1), one(2, 2), one(*third), one(7, 8), one(7, 8), one(0, 0), pa.array([False, False]), one(1, 1)], names=names)
    got = [x for b in S._repeated(iter([batch])) for x in b.column(5).to_pylist()]
    assert got == kept
    local = S._Local()
    list(local.add(*(np.array(x) for x in ([1, 1], [2, 2], list(third), [7, 8], [7, 8], [0, 0]))))
    flushed = next(local.flush())
    assert flushed.column(6).to_pylist() == [third[0] == third[1]] * 2
