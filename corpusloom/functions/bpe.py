"""Token counts and truncation by a public byte-pair vocabulary; its ranks file is a parameter and stays where it is."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that are handed on at once.
STEP_BYTES = 1 << 22
_loaded: dict = {}


def _encoding(ranks: str):
    """One for each Python worker."""
    if ranks not in _loaded:
        import base64

        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        _loaded[ranks] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    return _loaded[ranks]


def _counts(ranks: str, most: int):
    """Batches of id and text -> id, n_tokens, kept, in batches of STEP_BYTES or one text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(ranks)
        for batch in batches:
            out, size = [], 0
            for id_, text in zip(batch.column("id"), batch.column("text"), strict=True):
                text = text.as_py() or ""
                ids = encoding.encode_ordinary(text)
                kept = text if len(ids) <= most else encoding.decode_bytes(ids[:most]).decode("utf-8", "ignore")
                out.append((id_.as_py(), len(ids), kept))
                size += len(kept)
                if size >= STEP_BYTES:
                    yield _rows(out)
                    out, size = [], 0
            if out:
                yield _rows(out)

    return count


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"id": pa.int64(), "n_tokens": pa.int64(), "kept": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))


def counted(texts: DataFrame, ranks: str, most: int = 8191) -> DataFrame:
    """id, n_tokens, kept: the text of its first `most` tokens, without the bytes of a character that the cut parts.

    texts has id (long) and text; a null text has no tokens. A worker holds the tokens of one text at a time."""
    return texts.select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).mapInArrow(_counts(ranks, most), "id long, n_tokens long, kept string")


def embeddable(texts: DataFrame, ranks: str, most: int = 8191) -> DataFrame:
    """id, input: what an embedding model with a limit of `most` tokens gets: one space for an empty text, else the text of its
    first `most` tokens. A token has a byte at least, so only texts of more bytes than that meet the tokenizer."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = texts.select("id", F.when(text == "", " ").otherwise(text).alias("text"))
    long = F.octet_length("text") > most
    return rows.filter(~long).select("id", F.col("text").alias("input")).unionByName(counted(rows.filter(long), ranks, most).select("id", F.col("kept").alias("input")))
