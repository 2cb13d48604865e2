import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from newsloom.llm import tokenizers

pytestmark = pytest.mark.skipif(not os.path.exists(tokenizers.FOLDER), reason="no tokenizers here")


def test_tree_is_one_encoding():
    enc = tokenizers.tiktoken_encoding("byte_bpe_50k")
    byte = lambda ids: b"".join(map(enc.decode_single_token_bytes, ids))

    @settings(max_examples=150, deadline=None)
    @given(st.text(alphabet="abetrns", min_size=1, max_size=600), st.integers(1, 40))
    def check(text, size):
        data = text.encode()
        leaves = [enc._encode_single_piece(data[i : i + size]) for i in range(0, len(data), size)]
        assert tokenizers.join_tree(leaves, enc._encode_single_piece, byte) == enc._encode_single_piece(data)

    check()


def test_encode(spark):
    enc = tokenizers.tiktoken_encoding("byte_bpe_50k")
    rng = random.Random(2)
    odd = ["", None, " ", "\n\n\n", "<|endoftext|> x", "a" * 5000, " " * 3000 + "x", "9" * 777, "".join(rng.choice("abcxyz") for _ in range(20_000)), "खबर " * 500 + "क" * 400, "!" * 300 + "don't 's 're", "😀👍🏽" * 60, "�", "x‍" * 100]
    rows = [(i, t, 1) for i, t in enumerate(odd)] + [(5, odd[5], 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, t int")
    got = tokenizers.encode(df, "text", ["doc_id"]).collect()
    assert len(got) == len(rows)
    for r in got:
        text = odd[r.doc_id]
        assert list(r.ids) == (enc.encode_ordinary(text) if text else []), text
    assert tokenizers.encode(df.limit(0), "text", ["doc_id"]).count() == 0
