"""Token ids of a byte-level BPE vocabulary file, a word at a time.

In texts whose white space is single blanks and line ends, no token crosses the
start of a blank-led word, so a word's ids can be kept and reused. All other
texts go to the tokenizer whole. The ids are those of
``Tokenizer.encode(text, add_special_tokens=False)``.
"""

from __future__ import annotations

import json
from array import array

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: Words kept at most, then the store starts anew; longer words are not kept.
KEPT = 400_000
LONGEST = 64

#: White space in a row, or other than blanks and line ends.
ODD = ("  ", "\n\n", " \n", "\n ", *(chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n"))

_ready: dict[int, WordTokenizer] = {}


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones stand for themselves, the rest follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Words(dict):
    """Ids of a word, with a blank before it if ``lead``, as little-endian bytes."""

    def __init__(self, encode, lead: str) -> None:
        self.encode, self.lead = encode, lead

    def __missing__(self, word: str) -> bytes:
        found = array("I", self.encode(self.lead + word)).tobytes()
        if len(word) <= LONGEST:
            if len(self) >= KEPT:
                self.clear()
            self[word] = found
        return found


class WordTokenizer:
    def __init__(self, source: str) -> None:
        self.whole = Tokenizer.from_str(source)
        held = json.loads(source)
        byte_of = _byte_of()
        self.specials = [t["content"] for t in held["added_tokens"]]
        ranks = {bytes(byte_of[c] for c in token): i for token, i in held["model"]["vocab"].items() if token not in self.specials}
        words = tiktoken.Encoding("words", pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=ranks, special_tokens={})
        self.led, self.bare = _Words(words.encode_ordinary, " "), _Words(words.encode_ordinary, "")
        self.line_end = np.asarray(words.encode_ordinary("\n"), np.uint32).tobytes()

    @staticmethod
    def source(path: str) -> str:
        with open(path, encoding="utf-8") as f:
            return f.read()

    @classmethod
    def of(cls, source: str) -> WordTokenizer:
        """One tokenizer a process and source."""
        key = hash(source)
        if key not in _ready:
            _ready[key] = cls(source)
        return _ready[key]

    def encode_bytes(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        if any(s in text for s in ODD) or any(s in text for s in self.specials):
            return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()
        out, led, bare = [], self.led.__getitem__, self.bare
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            out.append(bare[first] + b"".join(map(led, rest)))
        return self.line_end.join(out)
