"""Language identification by error-correcting output codes over character n-grams.

Every language gets a codeword; one binary n-gram classifier per bit tells the languages with a
1 from those with a 0. A text gets one margin per bit, and the codeword of least weighted
logistic loss names its language; a small lead over the next one flags ambiguity.

Fitting counts the n-grams of a sample of labelled texts, about SAMPLE different texts of every
language; which, a hash of the text decides, so a text that stands a million times counts once
and starves no other. Texts stay on the executors: what reaches the driver are a histogram of
2 * BUCKETS counts a language and one row of margins a sampled text. Prediction uses the text
alone, whole. A null text, or one without letters, is `und` with score 0. Without training texts
every row is `und`. Repeated rows and ties give equal results (ties: the first language by code
point). Extra columns are ignored. An empty table gives none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiltrel.llm.common import text_or_empty, written
from quiltrel.llm.textvec import pieces

SAMPLE, BUCKETS = 1500, 1 << 15
AMBIGUOUS = 0.6  # score under which a prediction is flagged
_LETTER = re.compile(r"[^\W\d_]")


def codebook(k: int) -> np.ndarray:
    """(k, bits) of -1/+1: exhaustive for up to 5 classes, else random words far apart."""
    if k <= 1:
        return np.ones((k, 1), np.float32)
    if k <= 5:
        cols = [[1 if (c >> i) & 1 else -1 for i in range(k)] for c in range(1, 1 << (k - 1))]
        return np.array(cols, np.float32).T
    rng, best, most = np.random.default_rng(7), None, -1
    bits = max(15, int(np.ceil(10 * np.log2(k))))
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], np.float32), (k, bits))
        code = code[:, np.abs(code.sum(0)) < k]
        gap = (code.shape[1] - code @ code.T) / 2
        least = gap[~np.eye(k, dtype=bool)].min()
        if least > most:
            best, most = code, least
    return best


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashed pairs, hashed triples, starts, ends): buckets at each symbol; texts set apart by three spaces."""
    low = [t.lower() for t in texts]
    sizes = np.array([len(t) + 3 for t in low], np.int64)
    points = np.frombuffer(("   ".join(["", *low]) + "   ").encode("utf-32-le", "surrogatepass"), np.uint32)
    folded = np.where((points < 65) | (points == 0xA0), 32, points).astype(np.uint32)  # blanks, digits and signs are one symbol
    two = folded * np.uint32(2654435761)
    two[1:] ^= folded[:-1] * np.uint32(2246822519)
    three = two.copy()
    three[2:] ^= folded[:-2] * np.uint32(3266489917)
    shift = np.uint32(32 - 15)
    three = (three ^ (three >> np.uint32(13))) * np.uint32(0x85EBCA6B) >> shift
    two = (two ^ (two >> np.uint32(15))) * np.uint32(0xC2B2AE35) >> shift
    ends = np.cumsum(sizes) + 1  # a text with the space after it
    return two, three, ends - sizes + 2, ends


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray  # (languages, bits)
    weights: np.ndarray  # (2 * BUCKETS, bits): pairs, then triples
    trust: np.ndarray  # weight of each bit in the decoding
    scale: float = 1.0

    def margins(self, texts: list[str]) -> np.ndarray:
        two, three, starts, ends = _grams(texts)
        cuts = np.minimum(np.stack([starts, ends], 1).ravel(), len(two) - 1)
        out = np.empty((len(texts), self.code.shape[1]))
        size = np.maximum(ends - starts, 1)
        for b in range(out.shape[1]):
            w = self.weights[:, b]
            each = w[:BUCKETS][two] + w[BUCKETS:][three]
            out[:, b] = np.add.reduceat(each, cuts, dtype=np.float64)[::2] / size
        return out

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the language, score): the score is 1 - loss / (loss + the next one's), rescaled to 0-1."""
        if len(self.langs) == 1:
            return np.zeros(len(margins), np.int64), np.ones(len(margins))
        z = np.clip(margins * self.scale, -30, 30)
        loss = np.logaddexp(0, -z[:, None, :] * self.code[None]) @ self.trust
        order = np.argsort(loss, axis=1, kind="stable")
        rows = np.arange(len(loss))
        a, b = loss[rows, order[:, 0]], loss[rows, order[:, 1]]
        return order[:, 0], np.clip(1 - a / np.maximum(b, 1e-12), 0.0, 1.0)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        real = [t or "" for t in texts]
        if not self.langs or not real:
            return ["und"] * len(real), np.zeros(len(real))
        best, score = self.decode(self.margins(real))
        none = [not _LETTER.search(t) for t in real]
        return ["und" if n else self.langs[i] for i, n in zip(best, none, strict=True)], np.where(none, 0.0, score)


def histogram(texts: list[str]) -> np.ndarray:
    """Counts of the buckets of pairs, then of triples."""
    out = np.zeros(2 * BUCKETS, np.int64)
    for lo in range(0, len(texts), 256):
        two, three, *_ = _grams(texts[lo : lo + 256])
        out[:BUCKETS] += np.bincount(two, minlength=BUCKETS)
        out[BUCKETS:] += np.bincount(three, minlength=BUCKETS)
    return out


def untuned(names: list[str], counts: np.ndarray) -> Model:
    """Binary classifiers from (languages, 2 * BUCKETS) counts: each bit's weight of an n-gram is the log
    ratio of its share among languages with 1 and with 0, every language counting alike."""
    if not names:
        return Model([], np.ones((0, 1)), np.zeros((2 * BUCKETS, 1), np.float32), np.ones(1))
    code = codebook(len(names))
    if len(names) == 1:
        return Model(names, code, np.zeros((2 * BUCKETS, 1), np.float32), np.ones(1))
    share = counts + 0.02
    share /= share.sum(1, keepdims=True)
    up, down = (code > 0).astype(float), (code < 0).astype(float)
    weights = np.log((up / up.sum(0)).T @ share) - np.log((down / down.sum(0)).T @ share)
    return Model(names, code, np.ascontiguousarray(weights.T, np.float32), np.ones(code.shape[1]))


def tuned(model: Model, margins: np.ndarray, langs: list[str]) -> Model:
    """Scale of the margins and trust in each bit, from the margins of labelled texts."""
    if len(model.langs) > 1 and len(margins):
        place = {x: i for i, x in enumerate(model.langs)}
        truth = model.code[[place[x] for x in langs]]
        model.scale = float(4 / max(np.median(np.abs(margins)), 1e-9))
        right = np.clip((np.sign(margins) == truth).mean(0), 0.01, 0.999)
        model.trust = np.maximum(np.log(right / (1 - right)), 0.01)
        model.trust /= model.trust.sum()
    return model


def train(texts: list[str], langs: list[str]) -> Model:
    """In memory, from labelled texts."""
    names = sorted(set(langs))
    counts = np.array([histogram([t for t, x in zip(texts, langs, strict=True) if x == name]) for name in names], np.float64)
    model = untuned(names, counts)
    m = [model.margins(texts[lo : lo + 256]) for lo in range(0, len(texts), 256)] if len(names) > 1 else []
    return tuned(model, np.concatenate(m) if m else np.zeros((0, 1)), langs)


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """Is crc32 of the id, as text, 2 modulo 4? A null id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """docs (doc_id, text, lang): learns from rows that are not held out. Languages are the labels' names:
    one row each on the driver."""
    usable = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    place = F.pmod(F.xxhash64("text", F.lit(11)), F.lit(1 << 30))
    # a hash of the text stands for it, so copies count once
    counts = usable.groupBy("lang").agg(F.approx_count_distinct(place).alias("n")).collect()
    if not counts:
        return untuned([], np.zeros((0, 2 * BUCKETS)))
    names = sorted(r["lang"] for r in counts)
    # about `sample` texts of each language: a share of the hash space, no sort of any group
    share = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], min(1.0, sample / max(1, r["n"])))))
    some = usable.where(place < share[F.col("lang")] * (1 << 30)).select("lang", "text")
    texts = written(some.groupBy("lang", F.md5(F.col("text").cast("binary")).alias("h")).agg(F.first("text").alias("text")).select("lang", "text"), "labelled")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str, np.ndarray] = {}
        for batch in batches:
            for lo, hi in pieces(batch, 1):
                part = batch.slice(lo, hi - lo)
                langs, raw = part.column(0).to_pylist(), part.column(1).to_pylist()
                for name in sorted(set(langs)):
                    more = histogram([t for t, x in zip(raw, langs, strict=True) if x == name])
                    own[name] = own[name] + more if name in own else more
        for name, c in own.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(c[at])], names=["lang", "at", "n"])

    sums = texts.mapInArrow(counted, "lang string, at long, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toArrow()
    counts_of = np.zeros((len(names), 2 * BUCKETS))
    row = {x: i for i, x in enumerate(names)}
    counts_of[[row[x] for x in sums["lang"].to_pylist()], sums["at"].to_numpy()] = sums["n"].to_numpy()
    model = untuned(names, counts_of)
    if len(names) == 1:
        return model
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in pieces(batch, 1):
                part = batch.slice(lo, hi - lo)
                m = shared.value.margins(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(m), pa.list_(pa.float64()))], names=["lang", "m"])

    got = texts.mapInArrow(placed, "lang string, m array<double>").toArrow()
    return tuned(model, np.array(got["m"].to_pylist()).reshape(-1, model.code.shape[1]), got["lang"].to_pylist())


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs (keep..., text) -> keep, lang_pred, score, ambiguous."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    k = len(keep)
    inner = docs.select(*keep, text_or_empty().alias("_text"))
    own = (("lang_pred", T.StringType()), ("score", T.DoubleType()), ("ambiguous", T.BooleanType()))
    fields = T.StructType([*inner.schema.fields[:k], *(T.StructField(*x) for x in own)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in pieces(batch, k):
                part = batch.slice(lo, hi - lo)
                pred, score = shared.value.predict(part.column(k).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in range(k)), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(score < AMBIGUOUS)],
                    names=[*keep, "lang_pred", "score", "ambiguous"],
                )

    return inner.mapInArrow(run, fields)


def digest(docs: DataFrame) -> DataFrame:
    found = identify(docs, fit(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")
