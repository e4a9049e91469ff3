"""Every stage of the pipeline on awkward rows, and the whole of it against its parts."""

import re
from collections import Counter

import pytest

pytest.importorskip("quiltrel.llm")

import corpus_pipeline as P  # noqa: E402
from quiltrel.llm import mixing  # noqa: E402

FULL = " ".join(f"word{i}" for i in range(60))
TEXTS = [None, "", FULL, FULL, FULL + " end", " ".join(f"other{i}" for i in range(5000)), "call bob@x.example.com now please", "tiny text", "x " * 400]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `a b` string, `x-y` struct<`p q`:int>, size int, kept string, _row int"


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    rows = [(i, t, ["en", None][i % 2], ["s", "t", None][i % 3], len(t or ""), "e", (1,), 7, "k", 3) for i, t in enumerate(TEXTS)]
    path = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame([*rows, rows[2], rows[2], (None, FULL, None, None, None, None, None, None, None, None)], SCHEMA).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("i", range(len(P.STAGES)))
def test_stage_takes_any_rows(spark, docs, i):
    name, stage = P.STAGES[i]
    out = stage(spark, docs, "")
    out.collect()
    if i < len(P.STAGES) - 1:
        assert out.columns == docs.columns and out.schema["x-y"].dataType == docs.schema["x-y"].dataType
    assert stage(spark, docs.where("doc_id < 0"), "").count() == 0, name


def test_quality_rules_keep_and_drop(spark, docs):
    kept = Counter(r.doc_id for r in P.quality_rules(spark, docs, "").collect())
    assert 0 not in kept and 1 not in kept and 7 not in kept and 8 not in kept
    assert kept[2] == 3 and kept[5] == 1


def test_near_duplicates_leave_one(spark, docs):
    out = P.near_duplicates(spark, docs, "").collect()
    assert sum(r.text is not None and r.text.startswith("word0") for r in out) == 1
    assert min(r.doc_id for r in out if r.text and r.text.startswith("word0")) == 2
    assert sum(r.text is None for r in out) == 1


def test_personal_data_is_written_over(spark, docs):
    out = {r.doc_id: r for r in P.personal_data(spark, docs, "").collect()}
    assert out[6].text == "call <email> now please" and out[6].n_chars == len(out[6].text)
    assert out[0].text is None and out[5].text == TEXTS[5]


def test_source_mix_loses_no_word(spark, docs):
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r.source] += r.taken
    got = Counter()
    for r in P.source_mix(spark, docs, "").collect():
        got[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert got == want


def test_run_is_its_stages(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    ids, n = {r.doc_id for r in docs.select("doc_id").collect()}, docs.count()
    rows = P.run(spark, d).collect()
    assert {r.doc_id for r in rows} <= ids and len({r.doc_id for r in rows}) > 0.4 * n
    filled = Counter()
    for r in rows:
        filled[r.sequence_id] += r.length
    assert all(x == 1024 for s, x in filled.items() if s < max(filled))
