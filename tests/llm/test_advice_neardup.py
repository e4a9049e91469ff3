
import random

import pytest

pytest.importorskip("quiltrel.llm")

from quiltrel.llm import neardup  # noqa: E402


@pytest.mark.parametrize("n,line,times", [(400, 90, 8), (400, 60, 8), (1000, 150, 30)])
def test_repeated_lines_share_a_bucket(n, line, times):
    rng = random.Random(1)
    say = lambda k: " ".join(f"w{rng.randrange(10**6)}" for _ in range(k))
    missed = 0
    for _ in range(40):
        text = say(n)
        one, two = neardup.band_keys([text.encode(), f"{text} {' '.join([say(line)] * times)}".encode()])
        missed += not (one == two).any()
    assert missed <= 1


def test_every_link_of_a_large_group_counts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16384)  # several blocks
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(10**6)}"
    base = [word() for _ in range(300)]
    texts = []
    for _ in range(70):
        own = list(base)
        for _ in range(rng.randrange(1, 5)):
            own[rng.randrange(300)] = word()
        texts.append(" ".join(own))
    texts += [" ".join(word() for _ in range(300)) for _ in range(5)]
    doc, key, _ = neardup.shingles([t.encode() for t in texts])
    sets = [set(key[doc == i].tolist()) for i in range(len(texts))]
    want = {i: sum(len(a & b) >= 0.8 * len(a | b) for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets)}
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    out = neardup.clusters(spark.read.parquet(f"{tmp_path}/docs")).collect()
    assert {r.doc_id: r.n_links for r in out} == want


def test_copies_without_an_id_are_grouped(spark, tmp_path):
    rng = random.Random(3)
    some = [[f"w{rng.randrange(10**6)}" for _ in range(200)] for _ in range(2)]
    near = [" ".join([*t[:-1], "end"]) for t in some]
    a, b = (" ".join(t) for t in some)
    rows = [(1, a), (None, a), (2, near[0]), (None, b), (3, near[1])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    out = sorted((r.cluster_id, r.cluster_size, r.n_links) for r in neardup.clusters(docs).collect())
    assert out == [(1, 3, 1)] * 3 + [(3, 2, 1)] * 2
    assert sorted(r.doc_id for r in neardup.deduplicated(docs).collect()) == [1, 3]
