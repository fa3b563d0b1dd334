"""Token counts hold one text's tokens at a time."""

import public_tokenizers
import pyarrow as pa

from corpusloom.functions import bpe


def test_texts_go_on_in_steps(monkeypatch):
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    monkeypatch.setattr(bpe, "STEP_BYTES", 200)
    texts = ["a b c " * (i + 1) + "\u4f60\u597d" * (i % 3) for i in range(30)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["id", "text"])
    out = list(bpe._counts(ranks, 20)(iter([batch])))
    assert len(out) > 3 and all(b.num_rows < len(texts) for b in out)
    rows = [r for b in out for r in b.to_pylist()]
    encoding = bpe._encoding(ranks)
    assert [r["id"] for r in rows] == list(range(len(texts)))
    for text, r in zip(texts, rows, strict=True):
        ids = encoding.encode_ordinary(text or "")
        assert (r["n_tokens"], r["kept"]) == (len(ids), encoding.decode_bytes(ids[:20]).decode("utf-8", "ignore"))
