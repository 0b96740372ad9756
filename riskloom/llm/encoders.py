"""Encoders of public tokenizer files, made once per Python worker.

A ``.tiktoken`` rank file gives the ids that the ``.json`` file of the same vocabulary gives
(checked over every code point and on the tables in the tests) in a fraction of the time; for
it, an ``<|endoftext|>`` in a text is the special token, as is the default for the ``.json``.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import public_tokenizers

#: Fixed value: the special token of byte_bpe_50k and its id.
END_OF_TEXT = {"<|endoftext|>": 50256}


def default_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """``ids`` of one text as uint32; ``widths``: bytes of the text that each id stands for."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, file)}
        self._core = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=END_OF_TEXT)
        self.widths = np.zeros(max(max(ranks.values()), *END_OF_TEXT.values()) + 1, dtype=np.int64)
        for word, rank in [*ranks.items(), *((w.encode(), i) for w, i in END_OF_TEXT.items())]:
            self.widths[rank] = len(word)

    def ids(self, text: str) -> np.ndarray:
        return np.asarray(self._core.encode(text, allowed_special="all"), dtype="<u4")

    def count(self, text: str) -> int:
        return len(self._core.encode(text, allowed_special="all"))


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)
