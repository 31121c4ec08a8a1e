"""Vector bin packing of tokenised documents into training sequences.

Every document is a vector (tokens, one segment, loss-bearing tokens) and every sequence a bin with a
limit on each. The dot-product heuristic puts next the pending item whose demand points most along the
bin's remaining capacity. Items may be cut, so a bin that no whole item fits takes a cut of the best one that
the room left lets in. A bin that another limit closes before its tokens are full, and what is left when a partition
ends, go into sequences whose lengths are powers of two, which need no padding.

Loss-bearing ids are those after a document's prompt: its first ids, a share that the caller gives (rounded down).

Packing happens inside the partitions of the input: there is no shuffle, no shared state, and memory is
bounded by the pool of pending items. A sequence never spans two partitions; its id carries the
partition's number, so a task that is run again on another executor gives the same ids.

Defined results: a null or empty text is the end id alone, one piece; repeated rows are packed once
each; a null key stays null; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters on which the two tokenizer libraries' patterns agree whatever their Unicode tables: ASCII, Latin, general punctuation.
SAFE = r"[^\x00-ɏ‐-‧‰-›]"
POOL = 384
FLUSH = 1 << 20

SCHEMA = "key long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, loss_tokens long, n_segments int"


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold at most, on each axis at once."""

    tokens: int = 1024
    segments: int = 256
    loss_tokens: int = 1024

    def __post_init__(self):
        if self.tokens < 1 or self.segments < 1 or self.loss_tokens < 1:
            raise ValueError("limits must be positive")


@functools.lru_cache(maxsize=2)
def tokenizer(name: str):
    """text -> ids. The ids are those of the tokenizers library; texts of plain Latin characters take the
    faster library over the same vocabulary, whose ids are the same there (tests compare them)."""
    import base64
    import re

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
    slow.encode_special_tokens = True
    lines = open(public_tokenizers.path(f"{name}.tiktoken"), "rb").read().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}
    fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    unsafe = re.compile(SAFE)

    def encode(text: str) -> np.ndarray:
        if unsafe.search(text) is None:
            return np.asarray(fast.encode_ordinary(text), dtype="<u4")
        return np.asarray(slow.encode(text, add_special_tokens=False).ids, dtype="<u4")

    return encode


class Packer:
    """Packs items as they come; piece() rows come out when their sequence closes."""

    def __init__(self, limits: Limits, first_id: int):
        self.limits, self.next_id = limits, first_id
        self.items: list[list] = []  # [key, ids, start, loss_from]
        self.size = np.zeros((POOL, 3))
        self.scale = 1.0 / np.array([limits.tokens, limits.segments, limits.loss_tokens], dtype=float)

    def _demand(self, item) -> tuple[int, int, int]:
        _, ids, start, loss_from = item
        return len(ids) - start, 1, len(ids) - max(start, loss_from)

    def _cut(self, item, room) -> int:
        """Tokens of the item that fit the room."""
        _, ids, start, loss_from = item
        free = max(0, loss_from - start)
        return int(min(len(ids) - start, room[0], free + room[2])) if room[1] > 0 else 0

    def _close(self, bin_) -> Iterator[tuple]:
        """Rows of one sequence; pieces are (key, ids, start, length, loss_from)."""
        at = 0
        for key, ids, start, length, loss_from in bin_:
            loss = max(0, start + length - max(start, loss_from))
            yield key, start, length, ids[start : start + length].tobytes(), len(ids), self.next_id, at, loss, len(bin_)
            at += length
        self.next_id += 1

    def _hold(self, item) -> None:
        self.items.append(item)
        if len(self.items) > len(self.size):
            self.size = np.vstack([self.size, np.zeros_like(self.size)])

    def _cut_back(self, taken: list[tuple], most: int) -> list[tuple]:
        """The first `most` tokens of what was taken; the rest goes back to the pool. taken: (item, start, length, whole)."""
        kept, left = [], most
        for _, _, length, _ in taken:
            kept.append(min(length, left))
            left -= kept[-1]
        for (item, start, length, whole), stays in zip(reversed(taken), reversed(kept), strict=True):
            if stays < length:
                item[2] = start + stays
                if whole:
                    self._hold(item)
        changed = {id(item) for (item, _, length, _), stays in zip(taken, kept, strict=True) if stays < length}
        for i, item in enumerate(self.items):
            if id(item) in changed:
                self.size[i] = self._demand(item)
        return [(item, start, stays, whole) for (item, start, _, whole), stays in zip(taken, kept, strict=True) if stays]

    def _fill(self, last: bool) -> Iterator[tuple]:
        """Close sequences until the pool is half empty, or empty if this is the end."""
        lim = self.limits
        while self.items and (last or len(self.items) > POOL // 2):
            room = np.array([lim.tokens, lim.segments, lim.loss_tokens], dtype=float)
            taken = []
            while room[0] > 0 and room[1] > 0 and self.items:
                n = len(self.items)
                size = self.size[:n]
                fits = (size <= room).all(axis=1)
                whole = bool(fits.any())
                if whole:
                    value = np.where(fits, (size * (room * self.scale**2)).sum(axis=1), -1.0)
                else:  # what each item can put into the room, cut
                    free = size[:, 0] - size[:, 2]
                    cut = np.minimum(np.minimum(size[:, 0], room[0]), free + room[2])
                    put = np.column_stack((cut, np.ones(n), np.maximum(0, cut - free)))
                    value = np.where(cut > 0, (put * (room * self.scale**2)).sum(axis=1), -1.0)
                best = int(np.argmax(value))
                if value[best] < 0:
                    break
                item = self.items[best]
                start = item[2]
                take = len(item[1]) - start if whole else int(cut[best])
                taken.append((item, start, take, whole))
                room -= (take, 1, max(0, start + take - max(start, item[3])))
                if whole:
                    self.items[best] = self.items[-1]
                    self.size[best] = self.size[n - 1]
                    self.items.pop()
                else:
                    item[2] += take
                    self.size[best] = self._demand(item)
            total = sum(t[2] for t in taken)
            if total < lim.tokens:  # a limit other than tokens, or the end of the data: a power of two needs no padding
                taken = self._cut_back(taken, 1 << (total.bit_length() - 1))
            yield from self._close([(item[0], item[1], start, take, item[3]) for item, start, take, _ in taken])

    def add(self, key, ids: np.ndarray, loss_from: int = 0) -> Iterator[tuple]:
        lim, item = self.limits, [key, ids, 0, loss_from]
        while len(ids) - item[2] >= lim.tokens and self._cut(item, (lim.tokens, 1, lim.loss_tokens)) == lim.tokens:
            yield from self._close([(key, ids, item[2], lim.tokens, loss_from)])
            item[2] += lim.tokens
        if item[2] < len(ids):
            self._hold(item)
            self.size[len(self.items) - 1] = self._demand(item)
            if len(self.items) >= POOL:
                yield from self._fill(last=False)

    def end(self) -> Iterator[tuple]:
        yield from self._fill(last=True)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


ARROW = pa.schema([("key", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("loss_tokens", pa.int64()), ("n_segments", pa.int32())])


def pack(docs: DataFrame, key: str, text: str, limits: Limits = Limits(), tokens: str = "byte_bpe_50k", end_id: int = 0, loss_from: str | None = None, prompt: float = 0.0) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence, and its ids (little-endian
    unsigned 32-bit). loss_from names a column with the number of leading ids that bear no loss; without it that is
    the share `prompt` of a document's ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(tokens)
        packer = Packer(limits, TaskContext.get().partitionId() << 40)
        rows, held = [], 0
        for batch in batches:
            keys, texts, skips = (batch.column(i) for i in range(3))
            for i in range(batch.num_rows):
                t = texts[i].as_py() or ""
                ids = np.append(encode(t), np.uint32(end_id)).astype("<u4") if t else np.array([end_id], dtype="<u4")
                skip = skips[i].as_py()
                for row in packer.add(keys[i].as_py(), ids, int(prompt * len(ids)) if skip is None else skip):
                    rows.append(row)
                    held += len(row[3]) + 80
                if held > FLUSH:
                    yield _batch(rows, ARROW)
                    rows, held = [], 0
        for row in packer.end():
            rows.append(row)
            if len(rows) >= 4096:
                yield _batch(rows, ARROW)
                rows = []
        if rows:
            yield _batch(rows, ARROW)

    skip = F.coalesce(F.col(loss_from).cast("long"), F.lit(0)) if loss_from else F.lit(None).cast("long")
    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"), skip.alias("skip")).mapInArrow(run, SCHEMA)


#: The limits of op5_packing and the pipeline: a sequence holds at most 1024 ids, pieces of 12 documents, and 992 ids
#: that bear loss. PROMPT: the first eighth of a document's ids is its prompt and bears none.
PRODUCTION, PROMPT = Limits(1024, 12, 992), 1 / 8


def op5_packing(spark, sf_dir: str) -> DataFrame:
    """All documents, in sequences within PRODUCTION."""
    from lodestar.llm.common import read_table

    return digest(pack(read_table(spark, sf_dir, "documents"), "doc_id", "text", PRODUCTION, prompt=PROMPT))


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select(F.col("key").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "n_segments", "loss_tokens")
