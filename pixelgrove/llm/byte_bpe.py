"""Byte-level BPE encoding and decoding with a global distinct-word shuffle.

Encoding:

1. Each task cuts its documents into pre-tokens and gathers them in blocks of
   bounded size. A block is one sequence row (documents, and the position list
   as numbers of the block's distinct words) and some word rows: its distinct
   words with those numbers, split by a hash of the word into shards.
2. One exchange sends sequence rows to the partition of their block and word
   rows to that of their shard. It is read twice, by steps 3 and 4.
3. A shard meets a word from all blocks and encodes it once; the ids are joined
   back to (block, number) and sent to the block.
4. Each block looks the numbers of its position list up and puts the ids of
   each document together.

Only (block, distinct word) pairs travel, not occurrences, so frequent words
cost one entry a block and no key is hot. Memory is bounded by the block
limits, and in a shard by ``word_cache`` words (beyond which a word may be
encoded again, with the same result).

Decoding joins ids with the table of token bytes, whose size is that of the
vocabulary file.

Cases: null text is the empty text and gives no ids; a null doc_id is carried
as null; repeated rows are encoded each; an empty table gives no rows; other
columns are ignored; one document is always in one block, whatever its length.
"""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Limits of a block: distinct words, and pre-tokens.
BLOCK_WORDS, BLOCK_TOKENS = 200_000, 3_000_000
#: Least words of a full block that go to a shard; it bounds the number of shards.
SHARD_WORDS = 64
BLOCK_SCHEMA = "route long, home long, docs array<long>, counts array<long>, numbers binary, words binary"


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _squeeze(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays of u32 as byte planes, and bytes, in one compressed value."""
    import zstandard

    parts = [x if isinstance(x, bytes) else np.ascontiguousarray(x.astype("<u4").view("u1").reshape(-1, 4).T).tobytes() for x in arrays]
    head = np.array([len(p) for p in parts], "<u8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(bytes([len(parts)]) + head + b"".join(parts))


def _unsqueeze(value: bytes) -> list[bytes]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(value)
    sizes, at, out = np.frombuffer(raw, "<u8", raw[0], 1), 1 + 8 * raw[0], []
    for n in sizes.tolist():
        out.append(raw[at : at + n])
        at += n
    return out


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, "u1").reshape(4, -1).T).view("<u4").ravel()


def _pieces(blob: bytes, sizes: np.ndarray) -> list[bytes]:
    ends = np.cumsum(sizes, dtype="i8").tolist()
    return [blob[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []


class _Block:
    def __init__(self):
        self.docs, self.counts, self.parts, self.tokens = [], [], [], 0
        self.number: defaultdict = defaultdict()
        self.number.default_factory = self.number.__len__

    def add(self, doc: int | None, words: list[str]) -> None:
        self.docs.append(doc)
        self.counts.append(len(words))
        self.parts.append(np.fromiter(map(self.number.__getitem__, words), "<u4", len(words)))
        self.tokens += len(words)

    def rows(self, home: int, shards: int) -> Iterator[tuple]:
        yield home, home, self.docs, self.counts, _squeeze(np.concatenate(self.parts)), None
        split: list[list] = [[] for _ in range(shards)]
        for word, number in self.number.items():
            word = word.encode()
            split[zlib.crc32(word) % shards].append((word, number))
        for shard, pairs in enumerate(split):
            if pairs:
                words = [w for w, _ in pairs]
                # shards have negative routes, blocks have others
                yield -1 - shard, home, None, None, None, _squeeze(np.array([n for _, n in pairs]), np.array([len(w) for w in words]), b"".join(words))


def _record(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["route", "home", "docs", "counts", "numbers", "words"])


def _cut(pattern: str, shards: int, block_words: int, block_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        from pyspark import TaskContext

        find, home, block = regex.compile(pattern).findall, TaskContext.get().partitionId() << 32, _Block()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                block.add(doc, find(text.as_py() or ""))
                if len(block.number) >= block_words or block.tokens >= block_tokens:
                    yield _record(list(block.rows(home, shards)))
                    home, block = home + 1, _Block()
        if block.docs:
            yield _record(list(block.rows(home, shards)))

    return run


def _encode_words(ranks, pattern: str, word_cache: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encode = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={}).encode_ordinary
        last, known = None, {}
        for batch in batches:
            routes, homes, out = batch.column("route").to_pylist(), batch.column("home").to_pylist(), []
            for route, value in zip(routes, batch.column("words"), strict=True):
                if route != last or len(known) > word_cache:
                    last, known = route, {}
                numbers, sizes, blob = _unsqueeze(value.as_py())
                ids = []
                for word in _pieces(blob, _numbers(sizes)):
                    if (got := known.get(word)) is None:
                        got = known[word] = np.array(encode(word.decode()), "<u4").tobytes()
                    ids.append(got)
                out.append(_squeeze(_numbers(numbers), np.array([len(x) for x in ids]), np.frombuffer(b"".join(ids), "<u4")))
            yield pa.RecordBatch.from_arrays([pa.array(homes, pa.int64()), pa.array(out, pa.binary())], ["route", "coded"])

    return run


def _reassemble(left: pa.Table, right: pa.Table) -> pa.Table:
    coded: dict[int, bytes] = {}
    for value in right.column("coded"):
        numbers, sizes, ids = _unsqueeze(value.as_py())
        coded.update(zip(_numbers(numbers).tolist(), _pieces(_numbers(ids).tobytes(), _numbers(sizes)), strict=True))
    table = [coded[i] for i in range(len(coded))]
    doc_ids, out = [], []
    for docs, counts, numbers in zip(left.column("docs"), left.column("counts"), left.column("numbers"), strict=True):
        seq, at = _numbers(_unsqueeze(numbers.as_py())[0]), 0
        for n in counts.as_py():
            out.append(b"".join(map(table.__getitem__, seq[at : at + n].tolist())))
            at += n
        doc_ids += docs.as_py()
    ids = pa.chunked_array([pa.array(out[i : i + 1000], pa.binary()) for i in range(0, len(out), 1000)], pa.binary())
    return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "ids": ids})


def _kind(words: bool) -> Column:
    """Word or sequence rows. The partition id keeps the filter above the exchange, so that both readers share it."""
    return F.when(F.spark_partition_id() >= 0, F.col("route") < 0) == F.lit(words)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None, block_words: int = BLOCK_WORDS, block_tokens: int = BLOCK_TOKENS, word_cache: int = 2_000_000) -> DataFrame:
    """(doc_id, ids): ids as little-endian u32 in a binary value, one row per input row.

    shards: as many as there are shuffle partitions, within 64 and block_words / SHARD_WORDS, unless given.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = shards or max(64, min(parts, block_words // SHARD_WORDS))
    held = spark.sparkContext.broadcast(ranks)  # a vocabulary file: fixed size
    blocks = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_cut(pattern, shards, block_words, block_tokens), BLOCK_SCHEMA)
    dealt = blocks.repartition(parts, "route")
    coded = dealt.where(_kind(True)).sortWithinPartitions("route").mapInArrow(_encode_words(held, pattern, word_cache), "route long, coded binary").repartition(parts, "route")
    return dealt.where(_kind(False)).groupBy("route").cogroup(coded.groupBy("route")).applyInArrow(_reassemble, "doc_id long, ids binary")


def decode(coded: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds, or replaces, the bytes of the ids (null stays null), by a join with the table of token bytes inside each batch."""
    held = coded.sparkSession.sparkContext.broadcast({i: token for token, i in ranks.items()})  # fixed size, as above

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = held.value.__getitem__
        for batch in batches:
            out = [None if (x := v.as_py()) is None else b"".join(map(token, np.frombuffer(x, "<u4").tolist())) for v in batch.column(ids_col)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, pa.binary())], [*keep, out_col])

    keep = [c for c in coded.columns if c != out_col]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema if f.name in keep] + [f"`{out_col}` binary"])
    return coded.mapInArrow(run, schema)
