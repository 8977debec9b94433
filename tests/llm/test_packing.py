import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from pixelgrove.llm.packing import Packer, pack

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, start string, sequence_id string"
ROWS = [(1, "a b c", "x", "y"), (2, None, None, None), (3, "", "x", "y"), (None, "no id", "x", "y"), (4, "word " * 30_000, "x", "y"), (5, "ab<|endoftext|>c \n\n'll é", "x", "y"), (5, "ab<|endoftext|>c \n\n'll é", "x", "y"), (6, "b " * 700, "x", "y")]


def test_pieces_cover_every_document_and_sequences_have_no_gap(spark):
    rows = pack(spark.createDataFrame(ROWS, SCHEMA).coalesce(1), PATH).collect()
    coder = Tokenizer.from_file(PATH)
    ids = [np.array([*coder.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for _, t, *_ in ROWS]
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for doc in {r[0] for r in ROWS}:
        own = [x for x, r in zip(ids, ROWS, strict=True) if r[0] == doc]
        assert {r.doc_tokens for r in by_doc[doc]} == {len(own[0])}
        seen = sorted((r.start, r.length, r.ids_crc32) for r in by_doc[doc])
        assert sum(n for _, n, _ in seen) == sum(map(len, own))
        assert all(crc == zlib.crc32(own[0][a : a + n].tobytes()) for a, n, crc in seen)
        if len(own) == 1:
            assert [a for a, *_ in seen] == [0, *np.cumsum([n for _, n, _ in seen])[:-1].tolist()]
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        assert [p.offset for p in pieces] == [0, *np.cumsum([p.length for p in pieces])[:-1].tolist()]
        total = sum(p.length for p in pieces)
        assert total <= 2048 and (total & (total - 1)) == 0  # no padding at all


def test_long_windows_are_filled_from_shorter_tiers():
    packer = Packer(0, context=16, tiers=3)
    for i, n in enumerate([13, 3, 2, 7, 9, 30, 5]):
        packer.add(i, np.arange(n, dtype="<u4"))
    packer.pack()
    tiers = defaultdict(int)
    for row in packer.flush():
        tiers[row[7], row[5]] += row[2]
    assert all(total == tier for (tier, _), total in tiers.items()) and any(tier == 16 for tier, _ in tiers)


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], SCHEMA), PATH).count() == 0
