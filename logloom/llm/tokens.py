"""Token ids of texts under a fixed public vocabulary."""

from __future__ import annotations

import base64
import re

import numpy as np

END_OF_TEXT, END_ID, N_IDS = "<|endoftext|>", 50256, 50257
#: Texts of these characters alone are cut into words alike by both libraries; others go the plain way.
COMMON = re.compile("[\t\n\r -~¡-¬®-ɏ]*")


class Encoder:
    """Ids of the byte-level vocabulary, equal to those of the ``tokenizers`` library.

    The two files of the vocabulary are parameters.  ``tiktoken`` reads the ranks of the same
    vocabulary four times as fast and encodes texts of common characters; every other text, and
    one that spells a special token, goes through ``tokenizers`` itself.
    """

    def __init__(self, file: str | None = None, ranks: str | None = None, special_as_text: bool = False):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(file or public_tokenizers.path("byte_bpe_50k.json"))
        self.exact.encode_special_tokens = special_as_text
        with open(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        if END_OF_TEXT not in text and COMMON.fullmatch(text):
            return np.asarray(self.fast.encode_ordinary(text), np.uint32)
        return np.asarray(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)
