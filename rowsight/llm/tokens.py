"""Token ids of whole texts with a public byte-level BPE, for use inside Arrow tasks."""

from __future__ import annotations

import base64
import re

import numpy as np

VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
END_OF_TEXT, END_ID = "<|endoftext|>", 50256
#: letters and signs on which both libraries' patterns agree by their definition; other texts go to ``tokenizers``
_COMMON = re.compile("[^\t-\r\x20-\x7e\xa1-ɏ]")


class Encoder:
    """Ids as ``tokenizers`` gives them without special tokens around the text.

    ``tiktoken`` reads the same vocabulary four times as fast, so it encodes all
    texts but those that hold characters outside Latin letters and signs, or the
    end-of-text string. ``special``: whether that string in a text is one token.
    """

    def __init__(self, special: bool = True, vocabulary: str | None = None, ranks: str | None = None):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        ranks = ranks or public_tokenizers.path(RANKS)
        with open(ranks, "rb") as file:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.exact = Tokenizer.from_file(vocabulary or public_tokenizers.path(VOCABULARY))
        self.exact.encode_special_tokens = not special

    def __call__(self, text: str) -> list[int]:
        if END_OF_TEXT in text or _COMMON.search(text):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def array(self, text: str | None, end: int) -> np.ndarray:
        """uint32 ids of a text (null: none) and ``end`` after them."""
        return np.array([*self(text or ""), end], np.uint32)
