"""Token counts of texts in a public tokenizer's vocabulary."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable
from functools import lru_cache

#: Folder with the vocabulary files; a parameter everywhere, this is only its default.
TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pre-token pattern that belongs to the vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Most distinct words whose counts one Python worker remembers.
REMEMBERED = 400_000

#: White space characters of ASCII besides the blank, and the pattern of those beyond ASCII.
_OTHER_BLANKS = "\n\t\r\v\f\x1c\x1d\x1e\x1f"
_WIDE_BLANK = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def _blanks_touch(text: str) -> bool:
    """Whether a blank may stand beside other white space; true also for white space beyond ASCII."""
    if "  " in text:
        return True
    for c in _OTHER_BLANKS:
        if c in text and (" " + c in text or c + " " in text):
            return True
    return not text.isascii() and _WIDE_BLANK.search(text) is not None


class _Counts(dict):
    """Word -> tokens of a blank and the word."""

    def __init__(self, encode: Callable[[str], list[int]]):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        n = len(self.encode(" " + word))
        self[word] = n
        return n


@lru_cache(maxsize=4)
def counter(directory: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> Callable[[str], int]:
    """A function that counts a text's tokens exactly as encoding it would.

    No pre-token reaches over a blank that stands between two other characters,
    so that a text without runs of white space around blanks is the sum of its
    words, whose counts are remembered. Other texts are encoded as a whole.
    """
    import tiktoken

    with open(os.path.join(directory, vocabulary), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encode = tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    known = _Counts(encode)
    look = known.__getitem__

    def count(text: str) -> int:
        if _blanks_touch(text):
            return len(encode(text))
        first, *rest = text.split(" ")
        return len(encode(first)) + sum(map(look, rest))

    return count
