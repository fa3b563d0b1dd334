"""Token ids by a public tokenizer; its files are parameters and stay where they are."""

from __future__ import annotations

import base64
import json

import numpy as np

_loaded: dict[tuple, Encoder] = {}


def public_files(name: str = "byte_bpe_50k") -> tuple[str, str]:
    """The tokenizer's definition and its vocabulary as ranks."""
    import public_tokenizers

    return public_tokenizers.path(f"{name}.json"), public_tokenizers.path(f"{name}.tiktoken")


class Encoder:
    """Ids as `tokenizers` gives them with add_special_tokens=False.

    The ranks file holds the same vocabulary and gives the same ids four times as fast; texts that contain the
    string of a special token, which only the definition knows, go through the definition."""

    def __init__(self, definition: str, ranks: str):
        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        self._fast = tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        with open(definition) as f:
            self._special = [x["content"] for x in json.load(f).get("added_tokens") or []]
        self._definition, self._exact = definition, None

    def __call__(self, text: str) -> np.ndarray:
        if any(s in text for s in self._special):
            if self._exact is None:
                from tokenizers import Tokenizer

                self._exact = Tokenizer.from_file(self._definition)
            return np.array(self._exact.encode(text, add_special_tokens=False).ids, np.uint32)
        return self._fast.encode_to_numpy(text, disallowed_special=())


def encoder(files: tuple[str, str]) -> Encoder:
    """One encoder for each Python worker."""
    if files not in _loaded:
        _loaded[files] = Encoder(*files)
    return _loaded[files]
