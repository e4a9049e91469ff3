"""Contract columns against plain brute force on the smallest table, and recall of the pair operator."""

import hashlib
import re
from collections import Counter

import duckdb
import pytest

pytest.importorskip("quiltrel.llm")

from quiltrel.llm import language, licenses, mixing, neardup, pii, quality  # noqa: E402

D = "/root/testdata/sf0.001/documents.parquet"
HARD = [
    None, "", "x <|endoftext|> y", "mail a@b.c.d and a@b..c x@y 999.1.1.1 1.2.3.4.5 +49 (0) 30 1234567 4111111111111111 4111-1111-1111-1112",
    "MIT  License, the mit-license; General\nPublic LICENSE apache license", "a b c d e f g h " * 9, "one\n\n two \none\n# * $ %\ttwo", "Привет мир " * 30,
]


@pytest.fixture(scope="module")
def docs(spark):
    real = spark.read.parquet(D)
    return real.unionByName(spark.createDataFrame([(10_000 + i, t, "en", "s", 0) for i, t in enumerate(HARD)], real.schema)).cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


def test_personal_data_base(docs, texts):
    out = {r.doc_id: r for r in pii.digest(pii.spans(docs)).collect()}

    def luhn(d):
        return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(int(c) for c in d[::-1])) % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m[0])
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    }
    for i, t in texts.items():
        own = {k: [(m.start(), m.end()) for m in re.finditer(p, t) if ok(m)] for k, (p, ok) in rules.items()}
        flat = sorted((a, n, b, k) for n, (k, xs) in enumerate(own.items()) for a, b in xs)
        assert [out[i][f"n_{k}"] for k in own] == [len(x) for x in own.values()], i
        assert out[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in flat).encode()).hexdigest()
        spans = out[i].spans.split(",") if out[i].spans else []
        assert {f"{k}:{a}:{b}" for a, _, b, k in flat} <= set(spans)


def test_licenses_base(docs, texts):
    out = {r.doc_id: r for r in licenses.scan(docs).collect()}
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    for i, t in texts.items():
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at = [(j, k) for p, k in phrases.items() for j in range(len(w)) if w[j : j + len(p.split())] == p.split()]
        want = (len(w), len(at), min((j for j, _ in at), default=None), max((j for j, _ in at), default=None), ",".join(sorted({k for _, k in at})))
        assert (out[i].n_words, out[i].n_base, out[i].first_word, out[i].last_word, out[i].base_labels) == want
        assert set(filter(None, want[4].split(","))) <= set(filter(None, out[i].labels.split(","))) and 0 <= out[i].score <= 1


def test_quality_statistics_and_verdict(docs, texts):
    rows = {r.doc_id: r for r in quality.digest(quality.verdicts(docs)).collect()}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen = Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        cover = {j + k for j in range(len(w) - 7) if seen[tuple(w[j : j + 8])] > 1 for k in range(8)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for x in w for c in x))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(cover))
        assert r.base_failed == (len(w) < 20 or 100 * len(cover) > 30 * len(w)) and not (r.base_failed and r.kept)
    good = [r for r in rows.values() if not r.base_failed]
    assert sum(r.kept for r in good) > 0.9 * len(good)


def test_language_of_held_out_rows(docs):
    out = language.digest(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").where("held_out AND lang IS NOT NULL AND doc_id < 10000").collect()
    real = [r for r in out if len(r.text.split()) >= 5]
    assert len(real) > 20 and sum(r.lang == r.lang_pred for r in real) >= 0.95 * len(real)


def test_language_is_stable_under_a_flood(spark, docs):
    some = docs.where("doc_id < 10000")
    flood = some.limit(1).select("doc_id", "text", "lang", "source", "n_chars").crossJoin(spark.range(20_000).select()).cache()
    a = {r.doc_id: r.lang_pred for r in language.digest(some).collect()}
    b = {r.doc_id: r.lang_pred for r in language.identify(some, language.fit(some.unionByName(flood))).collect()}
    assert a == b


def test_mix_meets_every_target(docs):
    out = mixing.digest(mixing.mix(docs))
    con = duckdb.connect()
    con.register("m", out.toPandas())
    got = con.execute("SELECT source, sum(size) s, max(source_size) n, sum(taken) t, max(target) g, max(taken - 3 * size) over_ FROM m GROUP BY ALL ORDER BY source NULLS LAST").fetchall()
    total, open_, level = sum(r[1] for r in got), list(range(len(got))), {}
    weight, left = [(5, 2, 1)[i % 3] for i in range(len(got))], None
    left = float(total)
    while open_:  # water filling, by hand
        share = {i: left * weight[i] / sum(weight[j] for j in open_) for i in open_}
        full = [i for i in open_ if share[i] > 3 * got[i][1]]
        if not full:
            level |= share
            break
        for i in full:
            level[i] = 3.0 * got[i][1]
            left -= level[i]
        open_ = [i for i in open_ if i not in full]
    for i, r in enumerate(got):
        assert r[1] == r[2] and abs(r[4] - level[i]) < 1e-6 and abs(r[3] - r[4]) <= 1 and r[5] <= 0


def test_near_duplicates_against_all_pairs(docs, texts):
    def sh(t):
        w = t.encode().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    block = " ".join(f"r{j}" for j in range(10))
    extra, n = {}, 20_000
    for k in range(12):
        words = [f"w{k}x{j}" for j in range(200)]
        extra[n + 2 * k] = " ".join(words)
        extra[n + 2 * k + 1] = " ".join([*words, *([block] * (1 + 8 * k))])
    more = docs.sparkSession.createDataFrame([(i, t, "en", "s", 0) for i, t in extra.items()], docs.schema)
    out = {r.doc_id: r for r in neardup.clusters(docs.where("text IS NOT NULL").unionByName(more)).collect()}
    every = {i: sh(t) for i, t in (texts | extra).items() if i in out and sh(t)}
    ids, links = sorted(every), []
    by = {}
    for i in ids:
        for s in every[i]:
            by.setdefault(s, []).append(i)
    near = {(a, b) for xs in by.values() if len(xs) < 200 for k, a in enumerate(xs) for b in xs[k + 1 :]}
    for a, b in near:
        both = len(every[a] & every[b])
        if both / (len(every[a]) + len(every[b]) - both) >= 0.8:
            links.append((a, b))
    found = sum(out[a].cluster_id == out[b].cluster_id for a, b in links)
    assert len(links) > 12 and found >= 0.9 * len(links)
