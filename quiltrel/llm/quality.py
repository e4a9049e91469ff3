"""Quality rules: text statistics and the perplexity of a modified Kneser-Ney n-gram model.

The model is over characters as they are, of order 5, and grows with the corpus: n-grams, their
contexts and probabilities are tables that Spark counts and joins, and none of them is collected
or broadcast. The probabilities end as sorted hash arrays in the shared folder, a file for each
hash range, which tasks map and read by binary search. Each text is scored by the half of the
corpus that it is not in (halves by a hash of the text), so that no text vouches for itself.
Lower and upper bands of log perplexity are taken per language from all texts.

Null texts are empty: no words, perplexity null, rejected by the base rule. Languages are bands
of their own, null one more; they shrink towards the bands of all texts by PRIOR / (PRIOR + scored
texts), but hold the language's own quartiles at least, however rare it is.
Repeated rows and ties give equal verdicts; other columns are ignored. An empty table gives an
empty result.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiltrel.llm.common import broadcast_if_small, shared_folder, text_or_empty, written
from quiltrel.llm.textvec import U, hash_spans, mix, pieces, windows, words_of

ORDER, BITS = 4, 5
SPACE = 1 << (ORDER * BITS)
PRIOR = 50  # texts that the bands of all texts count for in those of a language
#: Bands: this many interquartile ranges beyond the quartiles of log perplexity, times
#: sqrt(1 + typical size / size): the mean over a short text scatters more.
REACH = 4.0


def _fold() -> np.ndarray:
    """Symbol (1-31) of every code point below U+0250; 0 stands before a text's first symbol."""
    import unicodedata

    out = np.full(0x251, 31, np.uint8)  # the last: any other code point
    out[0] = 0
    for c in range(1, 0x250):
        base = unicodedata.normalize("NFD", chr(c))[0].lower()
        if "a" <= base <= "z":
            out[c] = ord(base) - 96
        elif chr(c).isalpha():
            out[c] = 30
        elif chr(c).isspace():
            out[c] = 27
        elif chr(c).isdigit():
            out[c] = 28
        elif chr(c) in ".,;:!?'\"()-":
            out[c] = 29
    return out


FOLD = _fold()


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code of the n-gram ending at each symbol, text starts, text ends). Texts are set apart by
    ORDER-1 symbols 0, whose own codes belong to no text."""
    gap = "\0" * (ORDER - 1)
    sizes = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer((gap + gap.join(texts) + gap).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(sizes + ORDER - 1)
    sym = FOLD[np.minimum(points, 0x250)]
    out = sym.astype(np.int32)
    for j in range(1, ORDER):
        out[j:] |= sym[:-j].astype(np.int32) << np.int32(BITS * j)
    return out, ends - sizes, ends


class KneserNey:
    """In memory, over folded codes; no query uses it. Interpolated modified Kneser-Ney from counts of the highest order. Orders below use the
    number of distinct symbols before an n-gram. Each order has one sorted array of n-gram hashes
    with log probabilities aside, and one of contexts with back-off weights."""

    def __init__(self, code: np.ndarray, n: np.ndarray):
        base = 1.0 / ((1 << BITS) - 1)
        order = np.argsort(code)
        grams, counts = code[order].astype(np.int64), n[order].astype(np.float64)
        tables = [(grams, counts)]
        for k in range(ORDER - 1, 0, -1):  # n-grams of order k: drop the first symbol, count distinct ones
            grams, counts = np.unique(tables[-1][0] & ((1 << (BITS * k)) - 1), return_counts=True)
            tables.append((grams, counts.astype(np.float64)))
        self.gram_keys: list[np.ndarray] = []
        self.gram_p: list[np.ndarray] = []
        self.context_keys: list[np.ndarray] = []
        self.context_w: list[np.ndarray] = []
        for grams, counts in reversed(tables):
            f = [float(np.sum(counts == i)) for i in (1, 2, 3, 4)]
            y = f[0] / (f[0] + 2 * f[1]) if f[0] + f[1] else 0.5
            d = [min(max(i - (i + 1) * y * f[i] / f[i - 1], 0.0), float(i)) if f[i - 1] else min(0.5 * i, 1.5) for i in (1, 2, 3)]
            if max(d) == 0:
                d = [0.5, 0.75, 0.9]
            context = grams >> BITS
            names, inverse = np.unique(context, return_inverse=True)
            total = np.bincount(inverse, counts)
            cut = np.select([counts == 1, counts == 2], d[:2], d[2])
            left = np.bincount(inverse, np.minimum(cut, counts)) / total
            lower = self._lower(grams) if self.gram_keys else np.full(len(grams), base)
            p = np.maximum(counts - cut, 0) / total[inverse] + left[inverse] * lower
            self._put(self.gram_keys, self.gram_p, grams, p)
            self._put(self.context_keys, self.context_w, names, left)
        self.base = base

    @staticmethod
    def _put(keys: list[np.ndarray], values: list[np.ndarray], name: np.ndarray, value: np.ndarray) -> None:
        h = mix(name.astype(U) + U(1))
        order = np.argsort(h)
        keys.append(h[order])
        values.append(value[order])

    @staticmethod
    def _get(keys: np.ndarray, values: np.ndarray, name: np.ndarray) -> np.ndarray:
        """Value by binary search among the sorted hashes, NaN where absent."""
        if not len(keys):
            return np.full(len(name), np.nan)
        h = mix(name.astype(U) + U(1))
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return np.where(keys[at] == h, values[at], np.nan)

    def _lower(self, grams: np.ndarray) -> np.ndarray:
        k = len(self.gram_keys)
        return self.probability(grams & ((1 << (BITS * k)) - 1), k)

    def probability(self, grams: np.ndarray, k: int = ORDER) -> np.ndarray:
        """P(last symbol | the k-1 before it)."""
        if k == 0:
            return np.full(len(grams), self.base if hasattr(self, "base") else 1.0 / ((1 << BITS) - 1))
        p = self._get(self.gram_keys[k - 1], self.gram_p[k - 1], grams)
        miss = np.flatnonzero(np.isnan(p))
        if len(miss):
            weight = self._get(self.context_keys[k - 1], self.context_w[k - 1], grams[miss] >> BITS)
            p[miss] = np.where(np.isnan(weight), 1.0, weight) * self.probability(grams[miss] & ((1 << (BITS * (k - 1))) - 1), k - 1)
        return p

    def log_perplexity(self, texts: list[str]) -> np.ndarray:
        """Mean of -ln P over the symbols of each text (NaN if none)."""
        code, starts, ends = codes(texts)
        seen = np.zeros(SPACE, bool)
        seen[code] = True
        there = np.flatnonzero(seen)
        dense = np.zeros(SPACE, np.float32)
        dense[there] = -np.log(self.probability(there))
        cuts = np.minimum(np.stack([starts, ends], 1).ravel(), len(code) - 1)
        sums = np.add.reduceat(dense[code], cuts, dtype=np.float64)[::2] if len(texts) else np.zeros(0)
        sizes = ends - starts
        return np.where(sizes > 0, sums / np.maximum(sizes, 1), np.nan)


#: n-grams of the corpus model: LENGTH code points plus 1 (0: before the text) of WIDE bits each,
#: the last three in `lo` and those before in `hi`.
LENGTH, WIDE = 5, 21
_ONE = (1 << WIDE) - 1
RANGE = 2_000_000  # n-grams of a hash range, about
FLUSH = 2_000_000  # n-grams that a counting task holds


def distinct(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hi, lo) of the distinct n-grams that end at a character of the texts; (n-gram, text) of every
    character, in order of the n-grams."""
    gap = "\0" * (LENGTH - 1)
    sizes = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer((gap + gap.join(texts)).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    starts = np.cumsum(sizes + LENGTH - 1) - sizes
    own = np.ones(len(points), bool)
    own[(starts[:, None] - np.arange(1, LENGTH)).ravel()] = False
    sym = np.where(own, points.astype(np.int64) + 1, 0)
    seen = np.zeros(int(sym.max(initial=0)) + 1, bool)
    seen[sym] = True
    seen[0] = True
    letters = np.flatnonzero(seen)
    bits, more = (len(letters) - 1).bit_length(), len(owner).bit_length()
    if LENGTH * bits + more <= 63:  # letters by rank, and the place, in one word
        rank = np.cumsum(seen) - 1
        short = rank[sym]
        code = short.copy()
        for j in range(1, LENGTH):
            code[j:] |= short[:-j] << np.int64(bits * j)
        both = np.sort((code[own] << np.int64(more)) | np.arange(len(owner)))
        ranked, place = both >> np.int64(more), both & np.int64((1 << more) - 1)
        fresh = np.append(True, ranked[1:] != ranked[:-1])[: len(ranked)]
        code = ranked[fresh]
        parts = [letters[(code >> np.int64(bits * j)) & np.int64((1 << bits) - 1)] for j in range(LENGTH)]
        lo, hi = (sum((x << np.int64(WIDE * j) for j, x in enumerate(some)), np.zeros(len(code), np.int64)) for some in (parts[:3], parts[3:]))
    else:
        lo, hi = sym.copy(), np.zeros(len(sym), np.int64)
        for j in range(1, LENGTH):
            (lo if j < 3 else hi)[j:] |= sym[:-j] << np.int64(WIDE * (j % 3))
        lo, hi = lo[own], hi[own]
        place = np.lexsort((lo, hi))
        lo, hi = lo[place], hi[place]
        fresh = np.append(True, (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]))[: len(lo)]
        lo, hi = lo[fresh], hi[fresh]
    return hi, lo, np.cumsum(fresh) - 1, owner[place]


def hashes(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    return (mix(mix(lo.astype(U)) + hi.astype(U)) >> U(1)).astype(np.int64)


def halves(texts: list[str]) -> np.ndarray:
    """0 or 1: the half of the corpus that a text is in."""
    return np.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) >> 7 & 1 for t in texts], np.int64)


def _summed(h: np.ndarray, hi: np.ndarray, lo: np.ndarray, n0: np.ndarray, n1: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(h)
    ranked = h[order]
    heads = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(h) else order
    first = order[heads]
    sums = [np.add.reduceat(n[order], heads) if len(h) else n for n in (n0, n1)]
    return (h[first], hi[first], lo[first], *sums)


def count_ngrams(docs: DataFrame) -> DataFrame:
    """docs (text) -> (hi, lo, n0, n1): occurrences in each half of the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        base = size = 0  # n-grams held after the last merge, and now

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in held[0][1:]], names=["hi", "lo", "n0", "n1"])

        for batch in batches:
            for lo_, hi_ in pieces(batch, 0):
                texts = batch.column(0).slice(lo_, hi_ - lo_).to_pylist()
                hi, lo, gram, who = distinct(texts)
                n = np.bincount(gram, minlength=len(hi))
                n1 = np.bincount(gram, halves(texts)[who], len(hi)).astype(np.int64)
                held.append((hashes(hi, lo), hi, lo, n - n1, n1))
                size += len(held[-1][0])
                if size - base > FLUSH:
                    held = [_summed(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                    base = size = len(held[0][0])
                    if size > FLUSH:
                        yield out()
                        held, base, size = [], 0, 0
        if held:
            held = [_summed(*(np.concatenate(x) for x in zip(*held, strict=True)))]
            yield out()

    got = docs.where(F.length("text") > 0).select("text").mapInArrow(run, "hi long, lo long, n0 long, n1 long")
    return got.groupBy("hi", "lo").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _suffix(k: int) -> list[Column]:
    """Key of an n-gram of k characters without its first."""
    hi = F.col("hi").bitwiseAND(F.lit((1 << (WIDE * (k - 4))) - 1)) if k > 4 else F.lit(0).cast("long")
    lo = F.col("lo").bitwiseAND(F.lit((1 << (WIDE * (k - 1))) - 1)) if k < 4 else F.col("lo")
    return [hi.alias("shi"), lo.alias("slo")]


def _context() -> list[Column]:
    """Key of an n-gram without its last character."""
    lo = F.shiftright("lo", WIDE).bitwiseOR(F.shiftleft(F.col("hi").bitwiseAND(F.lit(_ONE)), 2 * WIDE))
    return [F.shiftright("hi", WIDE).alias("chi"), lo.alias("clo")]


def _discounts(f: list[int]) -> list[float]:
    """Of counts 1, 2 and more, from the numbers of n-grams with counts 1 to 4; 0.1 at least, so that
    every context leaves some probability to what the other half of the corpus has after it."""
    y = f[0] / (f[0] + 2 * f[1]) if f[0] + f[1] else 0.5
    return [min(max(i - (i + 1) * y * f[i] / f[i - 1], 0.1), float(i)) if f[i - 1] else min(0.5 * i, 1.5) for i in (1, 2, 3)]


def probabilities(top: DataFrame) -> DataFrame:
    """(hi, lo, n0, n1) -> (hi, lo, p0, p1): the interpolated modified Kneser-Ney probability of the last
    character by the counts of either half. Orders below the highest count distinct characters before an
    n-gram. Every suffix of an n-gram has its row, so that joins find all of them."""
    tables = {LENGTH: written(top, f"grams{LENGTH}")}
    for k in range(LENGTH, 1, -1):
        seen = [F.sum((F.col(n) > 0).cast("long")).alias(n) for n in ("n0", "n1")]
        tables[k - 1] = written(tables[k].select(*_suffix(k), "n0", "n1").groupBy(F.col("shi").alias("hi"), F.col("slo").alias("lo")).agg(*seen), f"grams{k - 1}")
    base = 1.0 / (tables[1].count() + 1)
    lower = None
    for k in range(1, LENGTH + 1):
        table = tables[k]
        times = table.agg(*(F.count_if(F.col(n) == i).alias(f"{n}_{i}") for n in ("n0", "n1") for i in (1, 2, 3, 4))).first()
        cut = {}
        for i, n in enumerate(("n0", "n1")):
            d = _discounts(list(times[4 * i : 4 * i + 4]))
            cut[n] = F.when(F.col(n) <= 0, 0.0).when(F.col(n) == 1, d[0]).when(F.col(n) == 2, d[1]).otherwise(d[2])
        keyed = table.select("hi", "lo", "n0", "n1", *_context())
        sums = [F.sum(x).alias(f"{what}{n[1]}") for n in ("n0", "n1") for what, x in (("total", F.col(n)), ("left", F.least(cut[n], F.col(n).cast("double"))))]
        wide = keyed.join(keyed.groupBy("chi", "clo").agg(*sums), ["chi", "clo"])
        if lower is None:
            wide = wide.withColumns({"q0": F.lit(base), "q1": F.lit(base)})
        else:
            wide = wide.select("*", *_suffix(k)).join(lower.select(F.col("hi").alias("shi"), F.col("lo").alias("slo"), F.col("p0").alias("q0"), F.col("p1").alias("q1")), ["shi", "slo"])
        p = [
            F.when(F.col(f"total{i}") > 0, (F.greatest(F.col(f"n{i}") - cut[f"n{i}"], F.lit(0.0)) + F.col(f"left{i}") * F.col(f"q{i}")) / F.col(f"total{i}")).otherwise(F.col(f"q{i}")).alias(f"p{i}")
            for i in (0, 1)
        ]
        lower = written(wide.select("hi", "lo", *p), f"p{k}")
    return lower


class CorpusModel:
    """-ln of the probabilities as sorted hash arrays in a folder: range b has the hashes whose first
    `bits` bits are b. What is held here and sent to tasks is the folder's name only."""

    def __init__(self, folder: str, bits: int):
        self.folder, self.bits = folder, bits

    def cost(self, h: np.ndarray) -> np.ndarray:
        """(n, 2): -ln P by either half, of sorted hashes."""
        out = np.empty((len(h), 2), np.float32)
        cuts = np.searchsorted(h >> np.int64(63 - self.bits), np.arange((1 << self.bits) + 1))
        for b in np.flatnonzero(cuts[1:] > cuts[:-1]):
            q = h[cuts[b] : cuts[b + 1]]
            keys = np.load(f"{self.folder}/{b}.h.npy", mmap_mode="r")
            at = np.minimum(np.searchsorted(keys, q), len(keys) - 1)
            if (keys[at] != q).any():
                raise ValueError("a text is not of the corpus that the model was counted from")
            out[cuts[b] : cuts[b + 1]] = np.load(f"{self.folder}/{b}.p.npy", mmap_mode="r")[at]
        return out

    def log_perplexity(self, texts: list[str]) -> np.ndarray:
        """Mean of -ln P over the characters of each text (NaN if none), by the half it is not in."""
        hi, lo, gram, who = distinct(texts)
        h = hashes(hi, lo)
        order = np.argsort(h)
        cost = np.empty((len(h), 2), np.float32)
        cost[order] = self.cost(h[order])
        each = cost[gram, 1 - halves(texts)[who]]
        sums, sizes = np.bincount(who, each, len(texts)), np.bincount(who, minlength=len(texts))
        return np.where(sizes > 0, np.round(sums / np.maximum(sizes, 1), 9), np.nan)


def fit(docs: DataFrame) -> CorpusModel:
    """docs (text) -> the model, which stays in the shared folder."""
    got = probabilities(count_ngrams(docs))
    spark = docs.sparkSession
    folder = f"{shared_folder(spark).removeprefix('file://')}/tables/model-{uuid.uuid4().hex}"
    os.makedirs(folder)
    bits = max(1, (got.count() // RANGE).bit_length())

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = hashes(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            cost = [pa.array(-np.log(batch.column(i).to_numpy()).astype(np.float32)) for i in (2, 3)]
            yield pa.RecordBatch.from_arrays([pa.array(h >> np.int64(63 - bits)), pa.array(h), *cost], names=["b", "h", "c0", "c1"])

    def put(b: int, parts: list[pa.RecordBatch]) -> None:
        h, *cost = (np.concatenate([x.column(i).to_numpy() for x in parts]) for i in (1, 2, 3))
        for name, values in (("h", h), ("p", np.stack(cost, 1))):
            own = f"{folder}/{b}.{name}.{uuid.uuid4().hex}"
            with open(own, "wb") as f:
                np.save(f, values)
            os.replace(own, f"{folder}/{b}.{name}.npy")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        done: list[int] = []
        for batch in batches:
            b = batch.column(0).to_numpy()
            heads = [*np.flatnonzero(np.append(True, b[1:] != b[:-1])), len(b)] if len(b) else []
            for lo, hi in zip(heads, heads[1:]):
                part = batch.slice(lo, hi - lo)
                if parts and parts[0].column(0)[0] != part.column(0)[0]:
                    done.append(parts[0].column(0)[0].as_py())
                    put(done[-1], parts)
                    parts = []
                parts.append(part)
        if parts:
            done.append(parts[0].column(0)[0].as_py())
            put(done[-1], parts)
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.int64())], names=["b"])

    ranges = got.mapInArrow(hashed, "b long, h long, c0 float, c1 float").repartition(1 << bits, "b").sortWithinPartitions("b", "h")
    ranges.mapInArrow(store, "b long").count()
    return CorpusModel(folder, bits)


_SYMBOLS = str.maketrans("", "", "#*$%&|<>")
_ASCII_BLANKS = str.maketrans("", "", " \t\n\r\x0b\x0c")


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.translate(_ASCII_BLANKS)]
    return len(lines) - len(set(lines))


def statistics(texts: list[str]) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    raws = [t.encode("utf-8", "surrogatepass") for t in texts]
    buf, starts, first, last, doc = words_of(raws)
    n = len(texts)
    heads = np.ones(len(buf), bool)
    heads[(buf & 0xC0) == 0x80] = False  # code points: bytes that do not continue one
    seen = np.concatenate([[0], np.cumsum(heads)])
    h = hash_spans(buf, first, last)
    at, key = windows(h, doc, 8)
    key = mix(key ^ mix(doc[at].astype(U)))
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    twin = np.zeros(len(key), bool)
    equal = ranked[1:] == ranked[:-1]
    twin[order[1:][equal]] = True
    twin[order[:-1][equal]] = True
    cover = np.zeros(len(h) + 9, np.int64)
    np.add.at(cover, at[twin], 1)
    np.add.at(cover, at[twin] + 8, -1)
    covered = np.cumsum(cover)[: len(h)] > 0
    return {
        "n_words": np.bincount(doc, minlength=n),
        "word_chars": np.bincount(doc, seen[last] - seen[first], n).astype(np.int64),
        "n_symbols": np.array([len(t) - len(t.translate(_SYMBOLS)) for t in texts], np.int64),
        "n_dup_lines": np.array([duplicate_lines(t) for t in texts], np.int64),
        "n_repeat_words": np.bincount(doc, covered, n).astype(np.int64),
    }


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(docs: DataFrame, model: CorpusModel, keep: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """docs (keep..., text) -> keep, MEASURES, log_ppl (null for an empty text), in one pass."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    k = len(keep)
    inner = docs.select(*keep, text_or_empty().alias("_text"))
    fields = T.StructType([*inner.schema.fields[:k], *(T.StructField(m, T.LongType()) for m in MEASURES), T.StructField("log_ppl", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lm = shared.value
        for batch in batches:
            for lo, hi in pieces(batch, k):
                part = batch.slice(lo, hi - lo)
                texts = part.column(k).to_pylist()
                got, ppl = statistics(texts), lm.log_perplexity(texts)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in range(k)), *(pa.array(got[m]) for m in MEASURES), pa.array(ppl, mask=np.isnan(ppl))],
                    names=[*keep, *MEASURES, "log_ppl"],
                )

    return inner.mapInArrow(run, fields)


def bands(measured: DataFrame) -> DataFrame:
    """(lang, everything, n, q25, q75, typical) of log perplexity and size, from every text with 20
    words or more: a row for each language, and one with `everything` true for all texts."""
    usable = measured.where("n_words >= 20 AND log_ppl IS NOT NULL")
    cuts = [
        F.percentile_approx("log_ppl", [0.25, 0.75], 10000).alias("q"),
        F.percentile_approx("word_chars", 0.5, 10000).alias("typical"),
        F.count("*").alias("n"),
    ]
    rows = usable.groupBy("lang").agg(*cuts).withColumn("everything", F.lit(False))
    whole = usable.agg(*cuts).withColumns({"everything": F.lit(True), "lang": F.lit(None).cast("string")})
    return rows.unionByName(whole).select("lang", "everything", "n", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q75"), "typical")


def judged(measured: DataFrame, reach: float = REACH) -> DataFrame:
    """measured -> with base_failed, low, high and kept. measured is read twice: write it first."""
    rows = written(bands(measured), "bands")
    names = ("q25", "q75", "typical")
    own = rows.where("NOT everything").select(F.col("lang").alias("_lang"), F.col("n").alias("_n"), *(F.col(c).alias(f"_{c}") for c in names))
    whole = rows.where("everything").select(*names).first() or (None,) * 3
    joined = measured.join(broadcast_if_small(own), F.col("lang").eqNullSafe(F.col("_lang")), "left")
    share = F.coalesce(F.col("_n") / (F.col("_n") + PRIOR), F.lit(0.0))
    common = [F.lit(v).cast("double") for v in whole]
    q25, q75, typical = (share * F.coalesce(F.col(f"_{c}"), v) + (1 - share) * v for c, v in zip(names, common, strict=True))
    q25, q75 = F.least(q25, "_q25"), F.greatest(q75, "_q75")  # nulls do not count
    width = reach * F.greatest(q75 - q25, F.lit(0.02)) * F.sqrt(1 + typical / F.greatest(F.col("word_chars"), F.lit(1)))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    inside = F.coalesce(F.col("log_ppl").between(q25 - width, q75 + width), F.lit(True))
    return joined.select(*measured.columns, failed.alias("base_failed"), (q25 - width).alias("low"), (q75 + width).alias("high"), (~failed & inside).alias("kept"))


def verdicts(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """docs (keep..., text) -> keep, MEASURES, log_ppl, base_failed, low, high, kept."""
    return judged(written(measure(docs, fit(docs), keep), "quality"))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", *(F.col(m).cast("long").alias(m) for m in MEASURES), "base_failed", "kept", F.exp("log_ppl").alias("perplexity"))
