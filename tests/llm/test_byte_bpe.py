import numpy as np
import public_tokenizers
import tiktoken

from pixelgrove.llm.byte_bpe import decode, encode, read_ranks

RANKS = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
SCHEMA = "doc_id long, text string, ids string, route string"
TEXTS = ["a  b\n\n c 'store ''s", None, "", "   ", "é ñ 漢字 😀 x1y2 ½²", "the " * 5000, "same words same words", "same words same words", "\x00​<|endoftext|>"]


def test_like_the_library_and_round_trip(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate(TEXTS)] + [(None, "no id here", "x", None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    coder = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    found = decode(encode(docs, RANKS, public_tokenizers.PATTERN, block_words=20, shards=5, word_cache=3), RANKS).collect()
    assert len(found) == len(rows)
    want = {i: t or "" for i, t, *_ in rows}
    for r in found:
        assert np.frombuffer(r.ids, "<u4").tolist() == coder.encode_ordinary(want[r.doc_id])
        assert bytes(r.decoded).decode() == want[r.doc_id]


def test_empty_table_and_null_ids(spark):
    assert encode(spark.createDataFrame([], SCHEMA), RANKS, public_tokenizers.PATTERN).count() == 0
    odd = decode(spark.createDataFrame([(1, None, "x")], "doc_id long, ids binary, decoded string"), RANKS)
    assert odd.columns == ["doc_id", "ids", "decoded"] and odd.first().decoded is None
