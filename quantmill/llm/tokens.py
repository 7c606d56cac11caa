"""Public subword tokenizers, loaded once per Python worker from a file given by path."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np

#: The vocabulary file and the published word pattern that belongs to it.
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts longer than this are encoded in parts, cut where the pattern cuts anyway.
PART = 100_000
#: White space of more characters than this does not go through the pattern, whose matching has a depth limit there.
BLANKS = 2000
#: The characters that the pattern's ``\s`` matches.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


@lru_cache(maxsize=4)
def encoder(path: str = DEFAULT_VOCABULARY):
    """(encoding, bytes of each token) of a vocabulary of ranks."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        size[rank] = len(token)
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), size


def parts(text: str) -> list[str]:
    """``text`` in parts of about PART characters whose tokens, one after the other, are those of the whole. A part ends before a blank
    between two letters, where the pattern always ends a match; without one in reach it goes on."""
    if len(text) <= PART:
        return [text]
    out, start = [], 0
    while len(text) - start > PART:
        at = text.find(" ", start + PART)
        while at != -1 and not (at + 1 < len(text) and text[at - 1].isalpha() and text[at + 1].isalpha()):
            at = text.find(" ", at + 1)
        if at == -1:
            break
        out.append(text[start:at])
        start = at
    return [*out, text[start:]]


def encode(text: str, path: str = DEFAULT_VOCABULARY) -> list[int]:
    enc, _ = encoder(path)
    if len(text) <= BLANKS:
        return enc.encode_ordinary(text)
    return [t for p in parts(text) for t in _with_blanks(p, enc)]


@lru_cache(maxsize=4)
def _long_blanks(most: int) -> re.Pattern:
    return re.compile(f"[{WHITE}]{{{most + 1},}}")


def _with_blanks(text: str, enc) -> list[int]:
    """The tokens of the whole: long white space, but for a last character before something else, is one match of the pattern, so its
    tokens are those of a single piece; the pattern cuts before and after it."""
    out, start = [], 0
    for m in _long_blanks(BLANKS).finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        if m.start() > start:
            out += enc.encode_ordinary(text[start : m.start()])
        out += enc._core_bpe.encode_single_piece(text[m.start() : end].encode())
        start = end
    return out + enc.encode_ordinary(text[start:]) if start < len(text) else out


def count(text: str | None, path: str = DEFAULT_VOCABULARY) -> int:
    """Tokens of a text; 0 for a null text."""
    return len(encode(text, path)) if text else 0
