
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("quiltrel.llm")

from quiltrel.llm import quality  # noqa: E402

rng = random.Random(7)
SYLLABLES = ["ско", "го", "при", "ста", "ени", "ров", "ате", "льн", "мо", "ка", "пре", "дов"]
WORDS = ["".join(rng.choices(SYLLABLES, k=rng.randrange(2, 4))) for _ in range(200)]
REAL = [" ".join(rng.choices(WORDS, k=120)) for _ in range(60)]
LETTERS = sorted({c for t in REAL for c in t} - {" "})
NOISE = ["".join(c if c == " " else rng.choice(LETTERS) for c in t) for t in REAL[:3]]


def brute(texts):
    """Log perplexity of each text by the half it is not in, from plain dictionaries."""
    n = quality.LENGTH
    half = quality.halves(texts)
    padded = [["", *[""] * (n - 2), *t] for t in texts]
    tables = []
    for own in (0, 1):
        top = Counter(tuple(p[i - n + 1 : i + 1]) for p, h in zip(padded, half) if h == own for i in range(n - 1, len(p)))
        levels = {n: top}
        for k in range(n - 1, 0, -1):
            levels[k] = Counter(g[1:] for g in levels[k + 1])
        made = {}
        for k, grams in levels.items():
            d = quality._discounts([sum(c == i for c in grams.values()) for i in (1, 2, 3, 4)])
            total, left = defaultdict(int), defaultdict(float)
            for g, c in grams.items():
                total[g[:-1]] += c
                left[g[:-1]] += min(d[min(c, 3) - 1], c)
            made[k] = (grams, d, total, left)
        tables.append(made)
    base = 1 / (len({c for t in texts for c in t}) + 1)

    def p(made, g):
        if not g:
            return base
        grams, d, total, left = made[len(g)]
        lower = p(made, g[1:])
        if not total[g[:-1]]:
            return lower
        c = grams[g]
        return (max(c - d[min(c, 3) - 1], 0) * (c > 0) + left[g[:-1]] * lower) / total[g[:-1]]

    return [np.mean([-math.log(p(tables[1 - h], tuple(w[i - n + 1 : i + 1]))) for i in range(n - 1, len(w))]) for w, h in zip(padded, half)]


def test_noise_of_another_script_is_told_from_text(spark, tmp_path):
    texts = REAL + NOISE
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'ru' AS lang").write.parquet(f"{tmp_path}/docs")
    out = {r.doc_id: r for r in quality.verdicts(spark.read.parquet(f"{tmp_path}/docs")).collect()}
    assert min(out[i].log_ppl for i in range(60, 63)) > 1.5 * max(out[i].log_ppl for i in range(60))
    assert all(out[i].kept == (i < 60) for i in out)
    np.testing.assert_allclose([out[i].log_ppl for i in range(len(texts))], brute(texts), rtol=1e-5)


def test_any_number_of_letters():
    for texts in (["".join(map(chr, range(0x4E00, 0x4E00 + 9000))) * 2, "", "\0a"], REAL[:3]):
        hi, lo, gram, who = quality.distinct(texts)
        want = Counter()
        for t in texts:
            v = [0] * 4 + [ord(c) + 1 for c in t]
            want.update((v[i - 4] << 21 | v[i - 3], v[i - 2] << 42 | v[i - 1] << 21 | v[i]) for i in range(4, len(v)))
        assert dict(zip(zip(hi.tolist(), lo.tolist()), np.bincount(gram).tolist())) == want
        assert np.bincount(who, minlength=len(texts)).tolist() == [len(t) for t in texts]


def test_bands_of_a_rare_language(spark, tmp_path):
    rows = [("en", 1.5 + 0.001 * (i % 100)) for i in range(2000)]

    def widths(n):
        some = [("es", 2.6 + 0.001 * (i % 20)) for i in range(n)]
        path = f"{tmp_path}/{n}"
        spark.createDataFrame([(k, p, 100, 0, 600) for k, p in rows + some], "lang string, log_ppl double, n_words long, n_repeat_words long, word_chars long").write.parquet(path)
        found = quality.judged(spark.read.parquet(path)).where("lang = 'es'").collect()
        assert all(r.kept for r in found)
        return found[0].low, found[0].high

    (low, high), (low_, high_) = widths(49), widths(50)
    assert abs(low - low_) < 0.1 and abs(high - high_) < 0.1
