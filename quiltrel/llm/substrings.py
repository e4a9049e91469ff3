"""Exact removal of repeated 400-byte strings, by bucket-pointer refinement over sampled suffixes.

 0. Sampled suffixes. In every 400-byte string, the least identifier among its 200 q-grams of q = 201
    bytes is its anchor. Equal strings have equal anchors at equal places, so an anchor whose q-gram
    stands nowhere else settles all strings it belongs to. About one byte in a hundred is an anchor.
    The others' suffixes start in buckets by their q-gram.
 1. Refinement. Members of a bucket are sorted on the bucket of the next anchor of their text and its
    distance; every run of two or more equal ones becomes a bucket with a pointer of its own (its rank
    in that order), all others leave. The next round sorts on the new pointers two anchors on, so
    that each round reuses the last one's work and doubles the depth. Pointers are ranks, not hashes:
    members of one bucket of four anchors are equal from the first anchor's start to the last
    q-gram's end, and every 400-byte string in there stands twice. That settles the inside of long
    repeats; one member of each bucket goes on, to show the others' strings to what is left.
 2. The ends of repeats. Around the anchors left, starts fall into blocks of 20. The 381 bytes common
    to a block's strings (core) tell a block that holds no repeat; the 419 bytes that they cover
    (context), if they stand twice, one that holds nothing else.
 3. In the blocks left, each start is looked up by its 400 bytes.

Identifiers are 64 bits, made by doubling (1, 2, 4 ... 256 bytes, then 201, 381, 400 and 419 from two
that overlap). What only rules strings out may rest on them: a collision there costs a look-up. What
removes bytes (a q-gram bucket, a context or a 400-byte string that stands twice) must agree in a
second, independent identifier of the same bytes too.
Every level ships (identifiers, text key, position), never text; texts are shuffled once, into
buckets by key, and joined there; what is kept of a text stays there too. Identifiers repeated within a task are settled there, so an
identifier has at most one row a task, however often it stands; buckets of step 1 are counted with
map-side combination and joined under the splitting of skewed partitions.

Null is the empty text. Texts of under 400 bytes lose nothing. Two equal texts of 400 bytes or
more lose everything, as do repeated rows. Extra columns are ignored. An empty table gives none.

cut() gives the kept bytes and the removed spans of every document; removals() derives numbers and
digest from them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiltrel.llm.common import shared_folder, text_or_empty, written
from quiltrel.llm.textvec import U, hash_spans, mix, pieces

SPAN, REACH, BLOCK = 400, 200, 20
GRAM = SPAN - REACH + 1
CORE, CONTEXT = SPAN - BLOCK + 1, SPAN + BLOCK - 1
_HELD = 2_000_000  # rows a task compares before it passes them on
_BUCKET = 32 << 20  # bytes of text in a bucket, about
_BYTE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * U(0x9E3779B97F4A7C15) + b
    x ^= x >> U(29)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(32)
    return x


class Identifiers:
    """Identifiers of all strings of a length in a buffer, by doubling."""

    def __init__(self, buf: np.ndarray):
        self.made = {1: _BYTE[buf]}

    def of(self, size: int) -> np.ndarray:
        """One for each start; too short a buffer gives none."""
        if size not in self.made:
            half = 1 << ((size - 1).bit_length() - 1)
            part = self.of(half)
            step = size - half
            self.made[size] = _pair(part[:-step], part[step:]) if len(part) > step else part[:0]
        return self.made[size]


def anchors(ids: np.ndarray, reach: int = REACH) -> np.ndarray:
    """Place of the least of each `reach` consecutive identifiers, the first of equals."""
    if len(ids) < reach:
        return np.zeros(0, np.int64)
    least, place, size = ids, np.arange(len(ids)), 1
    while size < reach:
        step = min(size, reach - size)
        n = len(least) - step
        later = least[step:] < least[:n]
        least, place = np.where(later, least[step:], least[:n]), np.where(later, place[step:], place[:n])
        size += step
    return place


def _texts(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(r) for r in raws], np.int64)
    ends = np.cumsum(sizes)
    return np.frombuffer(b"".join(raws), np.uint8), ends - sizes, ends


def _starts(begin: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Is each byte the start of a 400-byte string within its text?"""
    turn = np.zeros(n + 1, np.int64)
    long = ends - begin >= SPAN
    turn[begin[long]] += 1
    turn[ends[long] - SPAN + 1] -= 1
    return np.cumsum(turn)[:n] > 0


class _Local:
    """Holds a task's rows (route, second, third, k1, k2, at) and settles repeats among them. Of rows
    with equal route, second and third one is passed on under the route, marked as repeated; the
    others need no partner: they are passed on under a route of their own."""

    names = ("route", "second", "third", "k1", "k2", "at", "sure", "own")

    def __init__(self):
        self.held: list[tuple[np.ndarray, ...]] = []
        self.n = 0

    def add(self, *cols: np.ndarray, sure: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        """sure: rows known to be repeated."""
        if len(cols[0]):
            self.held.append((*cols, np.zeros(len(cols[0]), bool) if sure is None else sure))
            self.n += len(cols[0])
        if self.n >= _HELD:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        cols = [np.concatenate(c) for c in zip(*self.held, strict=True)]
        self.held, self.n = [], 0
        order = np.lexsort(cols[-2::-1])
        route, second, third, k1, k2, at, known = (c[order] for c in cols)
        same = (route[1:] == route[:-1]) & (second[1:] == second[:-1]) & (third[1:] == third[:-1])
        again, sure = np.concatenate([[False], same]), known.copy()
        sure[1:] |= same
        sure[:-1] |= same
        apart = mix(k1.view(U) ^ mix(at.astype(U) + route.view(U)))
        own = np.where(again, apart.view(np.int64), route)
        step = 100_000
        for lo in range(0, len(route), step):
            cut = slice(lo, lo + step)
            yield pa.RecordBatch.from_arrays([pa.array(c[cut]) for c in (route, second, third, k1, k2, at, sure, own)], names=list(self.names))


_ROW = "route long, second long, third long, k1 long, k2 long, at long, sure boolean, own long"


def _checked(buf: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Second identifiers of the strings of a length at some places, from their bytes."""
    spare = np.concatenate([buf, np.zeros(8, np.uint8)])
    return hash_spans(spare, at, at + size).view(np.int64)


def _keys(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_numpy(zero_copy_only=False)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    local = _Local()
    for batch in batches:
        for lo, hi in pieces(batch, 2):
            part = batch.slice(lo, hi - lo)
            buf, begin, ends = _texts(part.column(2).to_pylist())
            if len(buf) < SPAN:
                continue
            ids = Identifiers(buf).of(GRAM)
            own = anchors(ids)
            place = np.unique(own[_starts(begin, ends, len(buf))[: len(own)]])
            doc = np.searchsorted(begin, place, "right") - 1
            k1, k2 = _keys(part)
            yield from local.add(ids[place].view(np.int64), _checked(buf, place, GRAM), np.zeros(len(place), np.int64), k1[doc], k2[doc], place - begin[doc])
    yield from local.flush()


def _flat(lists: pa.Array, begin: np.ndarray) -> np.ndarray:
    """Positions of every row's list, as positions in the buffer."""
    sizes = np.array([0 if x is None else len(x) for x in lists], np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False) + np.repeat(begin, sizes)


def _covered(los: pa.Array, his: pa.Array, begin: np.ndarray, n: int) -> np.ndarray:
    """Is each position of the buffer in one of the intervals lo..hi, hi included?"""
    turn = np.zeros(n + 1, np.int64)
    np.add.at(turn, _flat(los, begin), 1)
    np.add.at(turn, _flat(his, begin) + 1, -1)
    return np.cumsum(turn)[:n] > 0


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    local = _Local()
    for batch in batches:
        for lo, hi in pieces(batch, 2):
            part = batch.slice(lo, hi - lo)
            buf, begin, ends = _texts(part.column(2).to_pylist())
            made = Identifiers(buf)
            own = anchors(made.of(GRAM))
            live = np.zeros(len(buf), bool)
            live[_flat(part.column(3), begin)] = True
            start = np.flatnonzero(_starts(begin, ends, len(buf))[: len(own)] & live[own])
            anchor = own[start]
            ends_at = anchor - (anchor - start) // BLOCK * BLOCK  # a block by its last start
            last, member = np.unique(ends_at, return_inverse=True)
            settled = _covered(part.column(4), part.column(5), begin, len(buf))[start]
            shown = _covered(part.column(6), part.column(7), begin, len(buf))[start]
            n_settled, n_live = np.bincount(member, settled, len(last)), np.bincount(member, minlength=len(last))
            on = (n_settled < n_live) | (np.bincount(member, shown, len(last)) > 0)
            last, whole = last[on], n_settled[on] == BLOCK  # some of a block's starts may belong to no repeated anchor
            doc = np.searchsorted(begin, last, "right") - 1
            core, context = made.of(CORE), made.of(CONTEXT)
            first = last - (BLOCK - 1)
            fits = (first >= begin[doc]) & (last + SPAN <= ends[doc])
            alone = mix(mix(last.astype(U)) ^ _keys(part)[0][doc].view(U) ^ mix(_keys(part)[1][doc].view(U) + U(9)))
            around = np.where(fits, context[np.where(fits, first, 0)] if len(context) else alone, alone)
            k1, k2 = _keys(part)
            third = np.where(fits, _checked(buf, np.where(fits, first, 0), CONTEXT) if len(context) else 0, alone.view(np.int64))
            yield from local.add(core[last].view(np.int64), around.view(np.int64), third, k1[doc], k2[doc], last - begin[doc], sure=whole)
    yield from local.flush()


def _start_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    local = _Local()
    for batch in batches:
        for lo, hi in pieces(batch, 2):
            part = batch.slice(lo, hi - lo)
            buf, begin, ends = _texts(part.column(2).to_pylist())
            ids = Identifiers(buf).of(SPAN)
            last = _flat(part.column(3), begin)
            low = begin[np.searchsorted(begin, last, "right") - 1]
            start = np.unique(np.concatenate([last - j for j in range(BLOCK)])[np.concatenate([last - j >= low for j in range(BLOCK)])]) if len(last) else last
            start = start[_starts(begin, ends, len(buf))[start]]
            doc = np.searchsorted(begin, start, "right") - 1
            k1, k2 = _keys(part)
            yield from local.add(ids[start].view(np.int64), _checked(buf, start, SPAN), np.zeros(len(start), np.int64), k1[doc], k2[doc], start - begin[doc])
    yield from local.flush()


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (own, second, third) -> those whose own stands twice or that are sure. State 1:
    only own stands twice; 2: (own, second, third) does, or the row is sure; 3: the first of those. A
    row is judged by its two neighbours, so two rows are carried from batch to batch."""
    columns = ("own", "second", "third", "route", "k1", "k2", "at", "sure")
    carry: list[np.ndarray] | None = None

    def judge(c: list[np.ndarray], lo: int, hi: int) -> pa.RecordBatch:
        own, second, third, route, k1, k2, at, sure = c
        near = own[1:] == own[:-1]
        alike = near & (second[1:] == second[:-1]) & (third[1:] == third[:-1])
        left, right = np.insert(near, 0, False), np.append(near, False)
        like_left, like_right = np.insert(alike, 0, False), np.append(alike, False)
        state = np.where(like_left | like_right | sure, 2 + (~like_left & (own == route)), 1).astype(np.int32)
        kept = left | right | sure
        kept[:lo] = kept[hi:] = False
        return pa.RecordBatch.from_arrays([pa.array(x[kept]) for x in (route, second, k1, k2, at, state)], names=["route", "second", "k1", "k2", "at", "state"])

    skip = 0  # carried rows that are judged already
    for batch in batches:
        if not batch.num_rows:
            continue
        fresh = [batch.column(batch.schema.get_field_index(x)).to_numpy(zero_copy_only=False) for x in columns]
        c = fresh if carry is None else [np.concatenate(p) for p in zip(carry, fresh, strict=True)]
        yield judge(c, skip, len(c[0]) - 1)
        carry = [x[-2:].copy() for x in c]
        skip = len(carry[0]) - 1
    if carry is not None:
        yield judge(carry, skip, len(carry[0]))


_FOUND = "route long, second long, k1 long, k2 long, at long, state int"


def _looked_up(rows: DataFrame, label: str) -> DataFrame:
    sorted_ = rows.repartition("own").sortWithinPartitions("own", "second", "third")
    return written(sorted_.mapInArrow(_repeated, _FOUND), label)


ROUNDS = 2  # chains of 2 ** ROUNDS anchors


def refined(standing: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """standing (route, second, k1, k2, at) -> k1, k2, lo, hi, shown: starts lo..hi are settled, as all
    400-byte strings there stand in another text or place too. shown: the bucket's member that goes on."""
    text = Window.partitionBy("k1", "k2")
    members = standing.where("state > 1").select("k1", "k2", "at", F.struct("route", "second").alias("ptr"))
    members = members.withColumns({"i": F.row_number().over(text.orderBy("at")), "end": F.col("at")})
    for r in range(rounds):
        ahead = text.orderBy("i").rangeBetween(1 << r, 1 << r)
        paired = members.withColumns({"next": F.first("ptr").over(ahead), "gap": F.first("at").over(ahead) - F.col("at"), "far": F.first("end").over(ahead)}).where("next IS NOT NULL")
        # no byte between the last q-gram of one and the first of the next
        paired = written(paired.where(F.col("at") + F.col("gap") - F.col("end") <= GRAM), "paired")
        buckets = paired.groupBy("ptr", "gap", "next").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "at")).alias("head")).where("n > 1")
        # the order of the buckets makes the pointers: ranks within tasks, tasks apart
        ranked = buckets.sortWithinPartitions("ptr", "gap", "next").select("ptr", "gap", "next", "head", F.monotonically_increasing_id().alias("rank"))
        ranked = written(ranked, "pointers")
        members = paired.join(ranked, ["ptr", "gap", "next"]).select("k1", "k2", "at", F.col("rank").alias("ptr"), "i", F.col("far").alias("end"), (F.struct("k1", "k2", "at") == F.col("head")).alias("shown"))
    inside = members.where(F.col("end") + (GRAM - SPAN) >= F.col("at"))
    return written(inside.select("k1", "k2", F.col("at").alias("lo"), (F.col("end") + (GRAM - SPAN)).alias("hi"), "shown"), "settled")


def keyed(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, raw, k1, k2: the MD5 of the text's bytes as two numbers."""
    raw = text_or_empty().cast("binary")
    digest = F.md5(raw)
    half = lambda at: F.shiftleft(F.conv(F.substring(digest, at, 8), 16, 10).cast("long"), 32).bitwiseOR(F.conv(F.substring(digest, at + 8, 8), 16, 10).cast("long"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw.alias("raw"), half(1).alias("k1"), half(17).alias("k2"))


_TEXT = ["k1", "k2", "raw", "doc_id", "copies"]


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k1, k2, raw, doc_id) -> k1, k2, raw, doc_id, copies: each text once a task, then the number of its further rows."""
    more: dict[tuple[int, int], int] = {}
    for batch in batches:
        fresh = []
        for i, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            more[key] = more.get(key, -1) + 1
            if not more[key]:
                fresh.append(i)
        kept = batch.take(pa.array(fresh, pa.int32()))
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([1] * kept.num_rows, pa.int64())], names=_TEXT)
    rest = [(*k, None, None, n) for k, n in more.items() if n]
    cols = zip(*rest, strict=True) if rest else [[]] * 5
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()), strict=True)], names=_TEXT)


def _bucketed(rows: DataFrame) -> tuple[DataFrame, int]:
    """rows (k1, k2, raw, doc_id) -> k1, k2, raw, doc_id (of one row), copies of every different text: a
    table in buckets by k1, so that later joins on k1 do not move it. Texts are moved once, a hot one
    once a task."""
    spark = rows.sparkSession
    size = rows.agg(F.sum(F.length("raw"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // _BUCKET + 1)
    name = f"texts_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/tables/{name}"
    moved = rows.select("k1", "k2", "raw", "doc_id").mapInArrow(_once, "k1 long, k2 long, raw binary, doc_id long, copies long").repartition(n, "k1")
    # partitioned by k1, so by (k1, k2) as well: no second exchange
    texts = moved.groupBy("k1", "k2").agg(F.first("raw", ignorenulls=True).alias("raw"), F.min("doc_id").alias("doc_id"), F.sum("copies").alias("copies"))
    texts.write.bucketBy(n, "k1").option("path", path).option("compression", "zstd").saveAsTable(name)
    return spark.table(name), n


def _beside(texts: DataFrame, n: int, found: DataFrame, all_texts: bool = False) -> DataFrame:
    """texts with, for each of the columns of found (k1, k2, ...), an array of its values for the text,
    nulls left out. Only positions move."""
    cols = [c for c in found.columns if c not in ("k1", "k2")]
    own = found.repartition(n, "k1").groupBy("k1", "k2").agg(*(F.collect_list(c).alias(c) for c in cols)).withColumnsRenamed({"k1": "_k1", "k2": "_k2"})
    # equality of k2 as a plain condition: the join's only key is then the one the table is bucketed by
    match = (F.col("k1") == F.col("_k1")) & (F.col("k2") <= F.col("_k2")) & (F.col("k2") >= F.col("_k2"))
    return texts.join(own.hint("shuffle_hash"), match, "left" if all_texts else "inner").drop("_k1", "_k2")


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_CUT = "doc_id long, n_bytes long, kept binary, spans array<struct<start: long, end: long>>"


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc_id, raw, blocks, starts, los, his in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            n = len(raw)
            turn = np.zeros(n + 1, np.int64)
            last = np.array(blocks or [], np.int64)
            np.add.at(turn, last - (BLOCK - 1), 1)
            np.add.at(turn, last + SPAN, -1)
            single = np.array(starts or [], np.int64)
            np.add.at(turn, single, 1)
            np.add.at(turn, single + SPAN, -1)
            np.add.at(turn, np.array(los or [], np.int64), 1)
            np.add.at(turn, np.array(his or [], np.int64) + SPAN, -1)
            gone = np.cumsum(turn)[:n] > 0
            edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))).tolist()
            spans = [{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2], strict=True)]
            out.append((doc_id, n, np.frombuffer(raw, np.uint8)[~gone].tobytes() if spans else raw, spans))
        cols = zip(*out, strict=True) if out else [[]] * 4
        types = (pa.int64(), pa.int64(), pa.binary(), _SPANS)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "n_bytes", "kept", "spans"])


def cut(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_bytes, kept (the remaining bytes, concatenated), spans (maximal
    removed runs: start, end, end exclusive, in bytes of the text)."""
    rows = keyed(docs)
    texts, n = _bucketed(rows)
    slim = texts.select("k1", "k2", "raw")
    standing = _looked_up(slim.mapInArrow(_anchor_rows, _ROW), "anchors")
    settled = refined(standing)
    none = F.lit(None).cast("long")
    one = F.col("shown")
    facts = standing.select("k1", "k2", "at", *(none.alias(c) for c in ("lo", "hi", "lo1", "hi1"))).union(
        settled.select("k1", "k2", none, "lo", "hi", F.when(one, F.col("lo")), F.when(one, F.col("hi")))
    )
    around = _beside(texts, n, facts).select("k1", "k2", "raw", "at", "lo", "hi", "lo1", "hi1")
    blocks = _looked_up(around.mapInArrow(_block_rows, _ROW), "blocks")
    # settled blocks whose core stands also in an unsettled one must be seen by that one: once for each context
    unsettled = blocks.where("state = 1")
    shown = blocks.where("state = 3").join(unsettled.select("route").distinct(), "route", "left_semi")
    wanted = unsettled.select("k1", "k2", "at").union(shown.select("k1", "k2", "at"))
    starts = _looked_up(_beside(texts, n, wanted).select("k1", "k2", "raw", "at").mapInArrow(_start_rows, _ROW), "starts")
    gone = blocks.where("state > 1").select("k1", "k2", F.col("at").alias("block"), none.alias("start"), none.alias("lo"), none.alias("hi")).union(
        starts.where("state > 1").select("k1", "k2", none, "at", none, none)
    ).union(settled.select("k1", "k2", none, none, "lo", "hi"))
    # short texts and copies are known from their own rows; what is left of any other text stays in its bucket
    alone = _beside(texts.where(f"copies = 1 AND length(raw) >= {SPAN}"), n, gone, all_texts=True)
    alone = alone.select("doc_id", "raw", "block", "start", "lo", "hi").mapInArrow(_kept, _CUT)
    size = F.length("raw").cast("long")
    no_span = F.expr("cast(array() AS array<struct<start: long, end: long>>)")
    short = rows.where(size < SPAN).select("doc_id", size.alias("n_bytes"), F.col("raw").alias("kept"), no_span.alias("spans"))
    copied = texts.where(f"copies > 1 AND length(raw) >= {SPAN}").select("k1", "k2")
    copies = rows.where(size >= SPAN).select("doc_id", size.alias("n_bytes"), "k1", "k2").join(copied, ["k1", "k2"], "left_semi")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    return alone.union(short).union(copies.select("doc_id", "n_bytes", F.lit(b"").alias("kept"), whole.alias("spans")))


def removals(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256, text: the remaining bytes
    as text, U+FFFD where the edge of a removed run divides a character."""
    return cut(docs).select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        F.make_valid_utf8(F.col("kept").cast("string")).alias("text"),
    )
