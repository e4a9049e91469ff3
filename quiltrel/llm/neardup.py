"""Near-duplicates by ProbMinHash, banding and exact verification.

A text's shingles are five consecutive words (fewer words: the text is one shingle), each of
weight 1 however often it occurs, as the similarity that decides is of sets. ProbMinHash draws
each shingle's arrivals as a Poisson process of that rate and stops once the next arrival is
later than every register's earliest; the winner in each of 168 registers is the signature, and
two texts agree in a register with probability the Jaccard similarity of their shingle sets. 28
bands of 6 registers find candidates (a pair at 0.8 shares none with probability 2e-4), and that
similarity, computed exactly, decides: 0.8 or more is a link.

Within a bucket, all members are compared with its first and last member, not with each other.
Two members not yet in one component are compared too unless the triangle inequality of the
Jaccard distance, by their distances from the first member, proves them apart; so no link
between texts joining two groups is lost between texts that share a bucket. Components of the links are the
groups. All links of a group are then counted exactly, by blocks of its texts (see degrees()).

Identical texts are one class before anything else; null texts are no duplicates of anything,
texts without words only of identical texts. Null doc_ids come after all others. Repeated rows belong to one class. Extra columns
are ignored. An empty table gives no rows. Hot buckets reduce to two members by map-side
aggregation; hot members and copies are joined under the adaptive splitting of skewed partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiltrel.llm.common import written
from quiltrel.llm.textvec import U, hash_spans, mix, pieces, windows, words_of

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 28, 6
M = BANDS * ROWS


def shingles(raws: list[bytes], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, occurrences), distinct within a text, in order of text."""
    buf, starts, first, last, doc = words_of(raws)
    h = hash_spans(buf, first, last)
    at, key = windows(h, doc, k)
    owner = doc[at]
    sizes = np.bincount(doc, minlength=len(raws))
    short = np.flatnonzero((sizes > 0) & (sizes < k))
    if len(short):
        begin = np.concatenate([[0], np.cumsum(sizes)])
        folded = np.full(len(short), U(77), U)
        for j in range(k - 1):
            on = sizes[short] > j
            folded[on] = mix(folded[on] * U(31) + h[begin[short[on]] + j])
        owner, key = np.concatenate([owner, short]), np.concatenate([key, folded])
    order = np.lexsort((key, owner))
    owner, key = owner[order], key[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    heads = np.flatnonzero(fresh)
    return owner[heads], key[heads], np.diff(np.append(heads, len(key)))


def signatures(doc: np.ndarray, key: np.ndarray, weight: np.ndarray, n: int, m: int = M) -> np.ndarray:
    """(n, m): the element that arrives first in each register."""
    earliest = np.full(n * m, np.inf)
    winner = np.zeros(n * m, U)
    at, owner, element, rate = np.zeros(len(key)), doc.astype(np.int64), key, weight
    k = 0
    while len(element):
        k += 1
        draw = mix(element + U(k * 0x9E3779B97F4A7C15 % 2**64))
        at = at - np.log(((draw >> U(11)).astype(np.float64) + 1.0) * 2.0**-53) / rate
        register = owner * m + (mix(draw) >> U(32)).astype(np.int64) % m
        np.minimum.at(earliest, register, at)
        won = at == earliest[register]
        winner[register[won]] = element[won]
        # an element whose latest arrival is after every register's earliest can win no more
        slowest = earliest.reshape(n, m).max(1)
        on = at < slowest[owner]
        at, owner, element, rate = at[on], owner[on], element[on], rate[on]
    return winner.reshape(n, m)


def band_keys(raws: list[bytes]) -> list[np.ndarray | None]:
    """28 bucket keys of each text; none for a text without words."""
    doc, key, _ = shingles(raws)
    sig = signatures(doc, key, np.ones(len(key)), len(raws))
    out = np.zeros((len(raws), BANDS), U)
    for j in range(ROWS):
        out = out * U(0x9E3779B97F4A7C15) + mix(sig.reshape(len(raws), BANDS, ROWS)[:, :, j] + U(j))
    out = mix(out + np.arange(1, BANDS + 1, dtype=U) * U(0xD6E8FEB86659FD93)).view(np.int64)
    some = np.bincount(doc, minlength=len(raws)) > 0
    return [row if yes else None for row, yes in zip(out, some, strict=True)]


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in pieces(batch, 2):
            part = batch.slice(lo, hi - lo)
            keys = [x if x is None else x.tolist() for x in band_keys([r or b"" for r in part.column(2).to_pylist()])]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "h", "bands"])


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in pieces(batch, 1):
            part = batch.slice(lo, hi - lo)
            doc, key, _ = shingles([r or b"" for r in part.column(1).to_pylist()])
            ends = np.cumsum(np.bincount(doc, minlength=part.num_rows))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(key.view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["uid", "shingles"])


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> uid, comp: the least uid of its component. Labels spread over links and then
    jump to their label's label, so a chain of n links takes about log n rounds; each is written."""
    both = written(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("uid")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        seen = both.join(labels.withColumnRenamed("uid", "b"), "b").groupBy(F.col("a").alias("uid")).agg(F.min("comp").alias("near"))
        spread = labels.join(seen, "uid").select("uid", "comp", F.least("comp", "near").alias("new"))
        jump = labels.select(F.col("uid").alias("new"), F.col("comp").alias("far"))
        moved = written(spread.join(jump, "new", "left").select("uid", "comp", F.least("new", F.coalesce("far", "new")).alias("new")), "labels")
        labels = moved.select("uid", F.col("new").alias("comp"))
        if moved.where("comp <> new").isEmpty():
            return labels


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) -> a, b, j: the Jaccard similarity of the shingle sets."""
    left = sets.select(F.col("uid").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("uid").alias("b"), F.col("shingles").alias("sb"))
    # sets whose sizes differ too much cannot be similar, but their distance still serves as a pivot
    both = F.size(F.array_intersect("sa", "sb")).cast("double")
    return pairs.join(left, "a").join(right, "b").select("a", "b", (both / (F.size("sa") + F.size("sb") - both)).alias("j"))


def groups(docs: DataFrame, similar: float = SIMILAR) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """docs (doc_id, text) -> (rows, classes, grouped, sets), all written.

    rows: doc_id, h (16 bytes of the text, null for null). classes: uid, h, class_id (least doc_id),
    n, same (rows with that doc_id). grouped: uid, comp, for classes with a link. sets: uid, shingles,
    for classes that share a bucket."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("h"), F.col("text").cast("binary").alias("raw"))
    signed = written(named.mapInArrow(_banded, "doc_id long, h binary, bands array<long>"), "signed")
    rows = signed.select("doc_id", "h")
    by_id = signed.where("h IS NOT NULL").groupBy("h", "doc_id").agg(F.count("*").alias("c"), F.first("bands").alias("bands"))
    by_text = by_id.groupBy("h").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "c")).alias("least"), F.sum("c").alias("n"), F.first("bands").alias("bands"))
    classes = written(
        by_text.select(F.monotonically_increasing_id().alias("uid"), "h", F.col("least.doc_id").alias("class_id"), "n", F.col("least.c").alias("same"), "bands"),
        "classes",
    )
    banded = classes.select("uid", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("uid").alias("first"), F.max("uid").alias("last"), F.count("*").alias("n")).where("first < last")
    members = written(banded.join(buckets, "key"), "members")
    star = members.select(F.col("first").alias("a"), F.col("uid").alias("b")).union(members.select(F.col("uid").alias("a"), F.col("last").alias("b")))
    pairs = written(star.where("a < b").distinct(), "pairs")
    involved = pairs.select(F.col("a").alias("uid")).union(pairs.select(F.col("b"))).distinct()
    wanted = classes.join(involved, "uid").select("uid", F.col("h").alias("_h"), "class_id")
    texts = named.join(wanted, (F.col("h") == F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("class_id")))
    sets = written(texts.select("uid", "raw").mapInArrow(_shingled, "uid long, shingles array<long>").dropDuplicates(["uid"]), "sets")
    tried = written(verified(pairs, sets), "tried")
    links = tried.where(F.col("j") >= similar)
    if not links.isEmpty() or not members.where("n > 2").isEmpty():
        links = links.unionByName(_cross(members, tried, links, sets, similar))
        links = written(links.distinct(), "links")
    labels = components(links)
    return rows, classes, written(labels, "grouped"), sets


def _cross(members: DataFrame, tried: DataFrame, links: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """Links between members of one bucket that the stars left in different components."""
    labels = components(links)
    large = members.where("n > 2").select("key", "first", "last", "uid")
    pivot = tried.select(F.col("a").alias("first"), F.col("b").alias("uid"), (1 - F.col("j")).alias("d"))
    placed = large.join(pivot, ["first", "uid"]).where("uid <> last").join(labels, "uid", "left").withColumn("comp", F.coalesce("comp", "uid"))
    open_ = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    width = 1.0 - similar
    left = written(placed.join(open_, "key").select("key", "uid", "comp", "d", F.floor(F.col("d") / width).alias("bin")), "open")
    x = left.select("key", F.col("uid").alias("a"), F.col("comp").alias("ca"), F.col("d").alias("da"), F.explode(F.sequence(F.col("bin") - 1, F.col("bin") + 1)).alias("bin"))
    y = left.select("key", F.col("uid").alias("b"), F.col("comp").alias("cb"), F.col("d").alias("db"), "bin")
    near = x.join(y, ["key", "bin"]).where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & (F.abs(F.col("da") - F.col("db")) <= width))
    fresh = near.select("a", "b").distinct().join(tried.select("a", "b"), ["a", "b"], "left_anti")
    return verified(fresh, sets).where(F.col("j") >= similar)


#: Weight of a block of texts: each weighs its shingles and EACH more.
BLOCK, EACH = 1 << 17, 512


def _tiled(similar: float):
    """Batches sorted by (comp, i, j) -> (uid, n): the links of each text within its tile, which holds the
    sets of blocks i and j; pairs of one block count in the tile i = j."""

    def count(rows: list[tuple]) -> tuple[list[int], np.ndarray]:
        rows = sorted(rows, key=lambda x: x[3])  # block i first
        block = np.array([x[3] for x in rows])
        cut = int(np.searchsorted(block, block[0], "right"))
        size = np.array([len(x[5]) for x in rows], np.float64)
        own = rows[0][1] == rows[0][2]
        if own:
            cut = len(rows)
        first, second = slice(0, cut), slice(0 if own else cut, len(rows))
        who = np.repeat(np.arange(len(rows)), size.astype(np.int64))
        _, name = np.unique(np.concatenate([x[5] for x in rows]), return_inverse=True)
        order = np.argsort(name, kind="stable")
        who, name = who[order], name[order]
        both = np.zeros((cut, second.stop - second.start))
        width = 4096
        for lo in range(0, int(name[-1]) + 1 if len(name) else 0, width):
            a, b = np.searchsorted(name, [lo, lo + width])
            held = np.zeros((len(rows), width), np.float32)
            held[who[a:b], name[a:b] - lo] = 1
            both += held[first] @ held[second].T
        linked = both / (size[first, None] + size[None, second] - both) >= similar
        if own:
            np.fill_diagonal(linked, False)
            return [x[4] for x in rows], linked.sum(1)
        return [x[4] for x in rows], np.concatenate([linked.sum(1), linked.sum(0)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            uid, n = count(held)
            return pa.RecordBatch.from_arrays([pa.array(uid, pa.int64()), pa.array(n, pa.int64())], names=["uid", "n"])

        for batch in batches:
            plain = [batch.column(i).to_pylist() for i in range(5)]
            for k, row in enumerate(zip(*plain, strict=True)):
                if held and held[0][:3] != row[:3]:
                    yield out()
                    held = []
                held.append((*row, batch.column(5)[k].values.to_numpy()))
        if held:
            yield out()

    return run


def degrees(labels: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """labels (uid, comp) -> uid, n_links: the texts of its component at `similar` or more, all counted.

    Every link is within a component. A component's texts by number of shingles are cut into blocks; a
    tile is two blocks of it whose numbers do not rule a link out."""
    sized = sets.join(labels, "uid").select("uid", "comp", F.size("shingles").alias("size"))
    upto = F.sum(F.col("size").cast("long") + EACH).over(Window.partitionBy("comp").orderBy("size", "uid").rowsBetween(Window.unboundedPreceding, -1))
    placed = written(sized.withColumn("block", F.floor(F.coalesce(upto, F.lit(0)) / BLOCK)), "blocks")
    blocks = placed.groupBy("comp", "block").agg(F.min("size").alias("least"), F.max("size").alias("most"))
    one = blocks.select("comp", F.col("block").alias("i"), F.col("most"))
    two = blocks.select("comp", F.col("block").alias("j"), F.col("least"))
    tiles = one.join(two, "comp").where((F.col("i") <= F.col("j")) & (F.col("most") >= (similar - 1e-9) * F.col("least"))).select("comp", "i", "j")
    sides = tiles.withColumn("block", F.explode(F.array_distinct(F.array("i", "j"))))
    met = placed.join(sides, ["comp", "block"]).join(sets, "uid").select("comp", "i", "j", "block", "uid", "shingles")
    counted = met.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j").mapInArrow(_tiled(similar), "uid long, n long")
    return counted.groupBy("uid").agg(F.sum("n").alias("n_links"))


def clusters(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """docs -> doc_id, class_id (least doc_id of its identical texts), cluster_id (least doc_id of its
    group), cluster_size (rows in the group), n_links (of its text to different texts of the group, all
    of them)."""
    rows, classes, grouped, sets = groups(docs, similar)
    wide = classes.join(grouped.join(degrees(grouped, sets, similar), "uid"), "uid")
    whole = wide.groupBy("comp").agg(F.min("class_id").alias("cluster_id"), F.sum("n").alias("cluster_size"))
    own = wide.join(whole, "comp").select("uid", "cluster_id", "cluster_size", "n_links")
    named = classes.select("uid", "h", "class_id", "n").join(own, "uid", "left")
    joined = rows.join(named, "h", "left")
    return joined.select(
        "doc_id",
        F.when(F.col("h").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(F.col("h").isNull(), F.col("doc_id")).otherwise(F.coalesce("cluster_id", "class_id")).alias("cluster_id"),
        F.coalesce("cluster_size", "n", F.lit(1)).cast("long").alias("cluster_size"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def deduplicated(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """docs with one row of each group: that of the least doc_id (of several rows with it, any one of
    the same text). Rows with a null text stay."""
    _, classes, grouped, _ = groups(docs, similar)
    comp = classes.join(grouped.select("uid", "comp"), "uid", "left").withColumn("comp", F.coalesce("comp", "uid"))
    chosen = comp.groupBy("comp").agg(F.min(F.struct(F.col("class_id").isNull(), "class_id", "uid", "h", "same")).alias("k")).select(F.col("k.h").alias("_h"), F.col("k.class_id").alias("_id"), F.col("k.same").alias("_same"))
    chosen = written(chosen, "chosen")
    keyed = docs.select(F.struct("*").alias("_row"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("_key"))
    match = (F.col("_key") == F.col("_h")) & F.col("_row.doc_id").cast("long").eqNullSafe(F.col("_id"))
    kept = keyed.where("_key IS NOT NULL").join(chosen, match).select("_row", "_h", "_id", "_same")
    parts = [docs.where(F.col("text").isNull())]
    if chosen.where("_same > 1").isEmpty():
        parts.append(kept.select("_row.*"))
    else:
        parts.append(kept.where("_same = 1").select("_row.*"))
        parts.append(kept.where("_same > 1").dropDuplicates(["_h", "_id"]).select("_row.*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
