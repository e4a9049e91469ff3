"""Packing by concatenate and cut.

Pass one tokenizes each text once, inside Arrow batches, and writes its ids with their place in
the task's own stream. Partition totals (one row a task) are summed up to global offsets. Pass
two cuts every document where its global positions cross a multiple of the sequence length; a
piece that does not begin or end with its document is a boundary record. No text is shuffled.

A null text is empty: its only id is the closing 0. Repeated rows are packed as often as they
stand. Very long texts make many pieces. An empty table gives no pieces. Extra columns are
ignored. Only the last sequence is shorter than `length`.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiltrel.llm.common import broadcast_if_small, text_or_empty, written

LENGTH, END = 1024, 0


class Tokens:
    """Ids of texts under a byte-level BPE. Texts of Latin letters go through the rank table of the
    same vocabulary, which is faster; all others, and those that hold the string of a special
    token, through the tokenizer file itself."""

    def __init__(self, tokenizer: str, ranks: str | None = None, pattern: str | None = None):
        self.paths, self.pattern = (tokenizer, ranks), pattern
        self._slow = self._fast = self._special = None

    def __getstate__(self):
        return {"paths": self.paths, "pattern": self.pattern, "_slow": None, "_fast": None, "_special": None}

    def special(self) -> tuple[str, ...]:
        """The strings that the tokenizer file takes out of a text before its rules apply."""
        if self._special is None:
            import json

            with open(self.paths[0], encoding="utf-8") as f:
                self._special = tuple(x["content"] for x in json.load(f).get("added_tokens", ()))
        return self._special

    def ids(self, text: str) -> np.ndarray:
        if self.paths[1] and (text.isascii() or max(text) < "ɐ") and not any(x in text for x in self.special()):
            if self._fast is None:
                import tiktoken

                with open(self.paths[1], "rb") as f:
                    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
                self._fast = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
            return np.array(self._fast.encode_ordinary(text), np.uint32)
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self.paths[0])
        return np.array(self._slow.encode(text, add_special_tokens=False).ids, np.uint32)


def public_tokens() -> Tokens:
    import public_tokenizers as P

    return Tokens(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


_KEPT: dict[tuple, Tokens] = {}


def tokenized(docs: DataFrame, tokens: Tokens) -> DataFrame:
    """docs (doc_id, text) -> doc_id, part, start (ids before it in its part), ids (unsigned 32-bit,
    little-endian), each document closed by id 0. Written: read it as often as needed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _KEPT.setdefault((tokens.paths, tokens.pattern), tokens)
        part, at = TaskContext.get().partitionId(), 0
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                batch = whole.slice(lo, 1000)
                ids = [np.append(own.ids(t), np.uint32(END)) for t in batch.column(1).to_pylist()]
                ends = at + np.cumsum([len(x) for x in ids])
                starts = np.concatenate([[at], ends[:-1]])
                at = int(ends[-1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.full(len(ids), part, np.int64)), pa.array(starts.astype(np.int64)), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())],
                    names=["doc_id", "part", "start", "ids"],
                )

    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    return written(rows.mapInArrow(run, "doc_id long, part long, start long, ids binary"), "tokens")


SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long,"
    " boundary string"
)


def pack(docs: DataFrame, tokens: Tokens | None = None, length: int = LENGTH) -> DataFrame:
    """docs (doc_id, text) -> SCHEMA, one row a piece."""
    stream = tokenized(docs, tokens or public_tokens())
    totals = stream.groupBy("part").agg(F.max(F.col("start") + F.length("ids") / 4).cast("long").alias("n"))
    # one row for each task of pass one: the window holds no more than that
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = written(totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "bases")
    placed = stream.join(broadcast_if_small(bases), "part").select("doc_id", (F.col("base") + F.col("start")).alias("at"), "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, at, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                n = len(raw) // 4
                edges = [0, *range(length - at % length, n, length), n]
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    kind = ("whole", "head", "tail", "middle")[(b < n) + 2 * (a > 0)]
                    out.append((doc, a, b - a, zlib.crc32(raw[4 * a : 4 * b]), n, (at + a) // length, (at + a) % length, kind))
            cols = zip(*out, strict=True) if out else [[]] * 8
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.string() if i == 7 else pa.int64()) for i, c in enumerate(cols)], names=[x.split()[0] for x in SCHEMA.split(",")]
            )

    return placed.mapInArrow(cut, SCHEMA)
