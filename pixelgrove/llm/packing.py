"""Hierarchical packing of token sequences into several context sizes.

Each task encodes its documents once and streams them through a packer:

1. Route. A document of at least the longest context fills whole windows of
   its own; what is left, or a shorter document, goes to the smallest tier
   that can hold it.
2. Pack. Per tier, each rest opens a window of that size when its turn comes.
3. Fill. The gap behind a rest is filled by cutting pieces from rests of the
   shorter tiers, longest tier first, and of its own tier last.
4. Balance. Full windows are dealt in rounds to training-step groups so that
   each group of a round gets windows of the same tier from the same buffer.

A buffer holds ``buffer_tokens`` tokens; when the short tiers can't fill the
gaps any more, what remains waits for the next buffer. At the end of a task
the remainder is cut along the powers of two, where a sequence needs no
padding. Nothing is shuffled: sequence ids are (task number, running number),
so a task that runs again after a lost executor gives the same rows.

Cases: null or empty text gives only the end id; a null doc_id is carried as
null; repeated rows are packed as often as they occur; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group int"
#: Windows that one training-step group takes at a time.
STEP_GROUPS = 8


def json_vocabulary(lines: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Byte ranks and special tokens of a byte-level BPE file in the tokenizers format.

    In this format the id of a token is the rank of its merge.
    """
    spec = json.loads(lines)
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in printable]
    to_byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    return {bytes(to_byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}, special


class Packer:
    """Cuts id arrays into pieces; yields rows of SCHEMA for finished sequences."""

    def __init__(self, task: int, context: int = 2048, tiers: int = 4):
        self.context, self.sizes = context, [context >> i for i in range(tiers)]
        self.wait: list[deque] = [deque() for _ in self.sizes]  # (doc, ids, start)
        self.held = [0] * len(self.sizes)  # ids that wait in each tier
        self.next_id, self.dealt = task << 33, [0] * (context.bit_length())
        self.rows: list[tuple] = []

    @property
    def waiting(self) -> int:
        return sum(self.held)

    def _emit(self, pieces: list[tuple], tier: int) -> None:
        at, group = 0, self.dealt[tier.bit_length() - 1] % STEP_GROUPS
        self.dealt[tier.bit_length() - 1] += 1
        for doc, ids, start, n in pieces:
            self.rows.append((doc, start, n, zlib.crc32(ids[start : start + n]), len(ids), self.next_id, at, tier, group))
            at += n
        self.next_id += 1

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        start = 0
        while len(ids) - start >= self.context:
            self._emit([(doc, ids, start, self.context)], self.context)
            start += self.context
        self._hold(doc, ids, start)

    def _hold(self, doc, ids, start) -> None:
        if left := len(ids) - start:
            k = max(i for i, s in enumerate(self.sizes) if left <= s)
            self.wait[k].append((doc, ids, start))
            self.held[k] += left

    def _take(self, k: int, most: int) -> tuple:
        """A piece of at most ``most`` ids from tier k; the rest of its document goes back to wait."""
        doc, ids, start = self.wait[k].popleft()
        n = min(most, len(ids) - start)
        self.held[k] -= len(ids) - start
        self._hold(doc, ids, start + n)
        return doc, ids, start, n

    def pack(self) -> None:
        """Fill windows, longest tier first, as long as a whole window can be filled."""
        for k, size in enumerate(self.sizes):
            while self.wait[k] and sum(self.held[k:]) >= size:
                pieces, room = [], size
                while room:
                    # the window's own rest first, then the gap from the next shorter tiers
                    order = [k] if not pieces else [*range(k + 1, len(self.sizes)), k]
                    j = next(j for j in order if self.wait[j])
                    pieces.append(self._take(j, room))
                    room -= pieces[-1][3]
                self._emit(pieces, size)

    def finish(self) -> None:
        """Cut the remainder along the powers of two."""
        self.pack()
        while self.waiting:
            size = 1 << (self.waiting.bit_length() - 1)
            size, pieces = min(size, self.context), []
            room = size
            while room:
                j = next(j for j in range(len(self.sizes)) if self.wait[j])
                pieces.append(self._take(j, room))
                room -= pieces[-1][3]
            self._emit(pieces, size)

    def flush(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.int32()] * 2
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", context: int = 2048, end_id: int = 1, buffer_tokens: int = 1 << 21, tiers: int = 4) -> DataFrame:
    """Rows (SCHEMA), one per piece. vocabulary: path of a tokenizers JSON file of a byte-level BPE.

    buffer_tokens bounds the ids that a task holds, besides one document.
    """
    if context & (context - 1) or context >> (tiers - 1) < 1:
        raise ValueError("context must be a power of two of at least 2**(tiers-1)")
    with open(vocabulary, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken
        from pyspark import TaskContext

        ranks, special = json_vocabulary(spec.value)
        coder = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        packer, end = Packer(TaskContext.get().partitionId(), context, tiers), np.array([end_id], "<u4")
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = coder.encode_to_numpy(text.as_py() or "", allowed_special="all").astype("<u4", copy=False)
                packer.add(doc, np.concatenate([ids, end]))
                if packer.waiting >= buffer_tokens:
                    packer.pack()
                if len(packer.rows) >= 20000:
                    yield _batch(packer.flush())
        packer.finish()
        if packer.rows:
            yield _batch(packer.flush())

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


#: Fixed value: the pattern by which byte-level BPE vocabularies of this kind split text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
