"""Encoding in chunks against tiktoken on the whole text, and the way back."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from corpusloom.llm import byte_bpe


def _library():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _texts():
    rng = random.Random(11)
    bits = ["we'll", "they're", "'re", "'", "'r", " ", "  ", "\n\n ", "\t", "ÄÖ", "naïve", "€", "12345", "日本語", "🙂", "!?", "x" * 40, " " * 70, "don't", "<|endoftext|>", " ", "é", "a" * 300]
    texts = [None, "", " ", "x", "a" * 5000, " " * 3000 + "b", "\n" * 2000, "'re" * 700, "🙂" * 600, ("z" * 900 + " ") * 6]
    return texts + ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 400))) for _ in range(150)]


@pytest.mark.parametrize(("chunk_bytes", "overlap"), [(64, 16), (257, 256), (1 << 16, 1 << 10)])
def test_digests_equal_the_library(spark, chunk_bytes, overlap):
    texts = _texts()
    rows = [(i, t, "clash", 5) for i, t in enumerate(texts)] + [(7, texts[7], None, None), (None, texts[-1], None, None), (None, texts[-1], None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, part string, row long").repartition(3)
    enc, want = _library(), []
    for doc_id, text, *_ in rows:
        ids = np.array(enc.encode_ordinary(text or ""), "<u4")
        want.append((doc_id if doc_id is not None else -1, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    got = [(r[0] if r[0] is not None else -1, *r[1:]) for r in byte_bpe.digests(df, chunk_bytes=chunk_bytes, overlap=overlap).collect()]
    assert sorted(got) == sorted(want)


def test_parts_are_several_and_give_the_bytes_back(spark):
    text = "It's a naïve text, isn't it? " * 400
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    whole, parts = byte_bpe.encoded(df, chunk_bytes=512, overlap=64)
    rows = sorted(byte_bpe.decoded(parts).collect(), key=lambda r: r["part"])
    assert whole.count() == 0 and len(rows) > 10
    assert b"".join(bytes(r["raw"]) for r in rows) == text.encode()


def test_no_rows(spark):
    assert byte_bpe.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0
