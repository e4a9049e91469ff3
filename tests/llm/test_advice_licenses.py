
import itertools

import pytest

pytest.importorskip("quiltrel.llm")

from quiltrel.llm import licenses  # noqa: E402

INDEX = licenses.Index()
WORDS = {k: t.encode().split() for k, (t, _) in licenses.TEMPLATES.items()}


def by_every_alignment(words, flat):
    out = {}
    for k, own in WORDS.items():
        if all(b" " + p.encode() + b" " in flat for p in licenses.TEMPLATES[k][1]):
            places = {v: [x for x, w in enumerate(words) if w == v] for v in own}
            share = max(
                sum(INDEX.idf[v] for j, v in enumerate(own) if any(abs(x - at - j) <= licenses.GAP for x in places[v]))
                for at in range(-len(own) - licenses.GAP, len(words) + licenses.GAP)
            ) / INDEX.weight[k]
            if share >= (licenses.LEAST if len(own) <= 12 else licenses.LEAST / 2):
                out[k] = share
    return out


def check(words):
    flat = b" " + b" ".join(words) + b" "
    got = INDEX.match(words, flat)
    assert got == pytest.approx(by_every_alignment(words, flat))
    return got


def test_all_template_words_hide_no_notice():
    every = sorted({w for ws in WORDS.values() for w in ws})
    for k, own in WORDS.items():
        assert k in check(every + own)


def test_foreign_words_between_hide_no_notice():
    for k, own in WORDS.items():
        words, phrases = list(own), [p.encode().split() for p in licenses.TEMPLATES[k][1]]
        for cut in (len(words) // 4, len(words) // 2, 3 * len(words) // 4):
            longer = words[:cut] + [b"foreign"] + words[cut:]
            if all(any(longer[i : i + len(p)] == p for i in range(len(longer))) for p in phrases):
                words = longer
        assert check(words)[k] == pytest.approx(1.0)


def test_joined_templates_keep_their_labels():
    for few in itertools.islice(itertools.combinations(WORDS, 4), 0, None, 20):
        got = check([w for k in few for w in WORDS[k]])
        assert set(few) <= set(got)
