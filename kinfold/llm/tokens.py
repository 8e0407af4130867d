"""A public byte-level BPE vocabulary as this subpackage's measure of size.

The vocabulary's word pattern never joins characters over a blank but for one space ahead of a word, so the tokens of a
text are the sum over its parts: words with the space ahead, and the blanks between. Parts repeat a lot, so each process
encodes a part once and keeps its count. The sum equals len(encode(text)).
"""

from __future__ import annotations

import base64
import os
import re
import sys
import unicodedata
from collections.abc import Iterator

#: Where the vocabulary lies on every machine; a parameter of all operators that count tokens.
VOCABULARY = os.environ.get("KINFOLD_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")

# Fixed value: the published word pattern of these vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLANKS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PARTS = re.compile(rf" ?[^{BLANKS}]+|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]+")
KEPT_PARTS, KEPT_LENGTH = 300_000, 64


def _ranges(codes: Iterator[int]) -> str:
    out, start, last = [], None, None
    for c in [*codes, None]:
        if c is not None and last is not None and c == last + 1:
            last = c
            continue
        if start is not None:
            out.append(f"{re.escape(chr(start))}-{re.escape(chr(last))}")
        start = last = c
    return "".join(out)


def word_pattern() -> re.Pattern:
    """PATTERN for the standard library's engine, whose classes of letters, digits and blanks differ a little."""
    odd = _ranges(c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("Nl", "No"))
    letter, number = rf"[^\W\d_{odd}]", rf"[\d{odd}]"
    return re.compile(rf"'(?:[sdmt]|ll|ve|re)| ?{letter}+| ?{number}+| ?(?:[^{BLANKS}\w]|_)+|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]+")


class Vocabulary(dict):
    """part -> tokens, filled as parts come; bounded."""

    def __init__(self, path: str = VOCABULARY):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.words = word_pattern().findall

    def __missing__(self, part: str) -> int:
        n = len(self.encoding.encode_ordinary(part))
        if len(part) <= KEPT_LENGTH:
            if len(self) >= KEPT_PARTS:
                self.clear()
            self[part] = n
        return n

    def count(self, text: str) -> int:
        return sum(map(self.__getitem__, PARTS.findall(text)))


_LOADED: dict[str, Vocabulary] = {}


def load(path: str = VOCABULARY) -> Vocabulary:
    """Once per process."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]
