"""Token ids of a public byte-level BPE vocabulary, for use inside tasks."""

from __future__ import annotations

import base64
import os
import re
from functools import lru_cache

import numpy as np

VOCABULARY = "byte_bpe_50k"
END = 2
#: White space runs of two or more, and at the end: only there do the two patterns below differ.
_LONG_SPACE = re.compile(r"\s\s|\s$")
#: A piece without white space of this many characters is left to the slower encoder, whose time grows more gently.
_LONG_PIECE = re.compile(r"\S{2000}")
_PLAIN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"


class Encoder:
    """Ids as ``tokenizers`` gives them without special tokens.

    The same merges, stored as ranks, run several times faster in ``tiktoken`` and give the same ids; texts that hold
    a special token's string or an extremely long piece go through ``tokenizers`` itself.
    """

    def __init__(self, vocabulary: str = VOCABULARY):
        import public_tokenizers
        from tokenizers import Tokenizer

        self._json = public_tokenizers.path(f"{vocabulary}.json")
        self._slow = Tokenizer.from_file(self._json)
        special = [t.content for t in self._slow.get_added_tokens_decoder().values()]
        self._special = re.compile("|".join(map(re.escape, special))) if special else None
        ranks_file = public_tokenizers.path(f"{vocabulary}.tiktoken")
        self._fast = self._plain = None
        if os.path.exists(ranks_file):
            import tiktoken

            with open(ranks_file, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self._fast = tiktoken.Encoding("fast", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self._plain = tiktoken.Encoding("plain", pat_str=_PLAIN_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str | None) -> np.ndarray:
        """Ids of one text, unsigned 32-bit, without an end mark; none for null."""
        if not text:
            return np.empty(0, "<u4")
        if self._fast is None or (self._special and self._special.search(text)) or _LONG_PIECE.search(text):
            return np.array(self._slow.encode(text, add_special_tokens=False).ids, "<u4")
        chosen = self._fast if _LONG_SPACE.search(text) else self._plain
        return np.array(chosen.encode_ordinary(text), "<u4")

    def document(self, text: str | None) -> np.ndarray:
        """Ids of one text and the end mark."""
        return np.append(self.ids(text), np.uint32(END)).astype("<u4")


@lru_cache(maxsize=2)
def encoder(vocabulary: str = VOCABULARY) -> Encoder:
    """One encoder per worker process."""
    return Encoder(vocabulary)


def cut(length: int, width: int) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of a document; the first may be shorter than the width."""
    first = length % width or min(width, length)
    return [(0, first)] + [(s, width) for s in range(first, length, width)]
