"""Problem 8: texts over a size limit in pieces under it, cut at natural boundaries, with an overlap.

Method: a recursive hierarchy of separators. A text is split into sections; a section that is too large into paragraphs; these into
sentences, words and at last characters. The parts are packed greedily into pieces up to the limit; each piece begins with the
last tokens of the one before.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quantmill.llm import tokens as T

LIMIT, OVERLAP = 1000, 50
#: Tokens left free in a part, for pieces that take more tokens by themselves.
SPARE = 8
#: Places before which a text may be cut, from the strongest to the weakest.
SEPARATORS = (
    re.compile(rb"\n(?=#{1,6} )|(?=<h[1-6][ >])|\x0c|\n[-=*_]{3,}[ \t]*(?=\n)", re.I),  # sections: headings, page breaks, rules
    re.compile(rb"\n[ \t\r]*\n\s*|(?<=</p>)|(?<=</div>)|(?<=</li>)|(?<=<br>)|(?<=<br/>)", re.I),  # paragraphs
    re.compile(rb"(?<=[.!?])(?=\s)|(?<=\.[\"')\]])(?=\s)|(?<=\xe3\x80\x82)"),  # sentences
    re.compile(rb"(?=[ \t\n\r])"),  # words
)


@dataclass(frozen=True)
class Piece:
    first: int
    tokens: int
    text: str
    #: Characters at its start that the piece before has too.
    shared: int = 0


class _Text:
    def __init__(self, text: str, path: str) -> None:
        self.bytes = text.encode("utf-8", "surrogatepass")
        ids = np.array(T.encode(text, path), np.int64)
        self.at = np.append(0, np.cumsum(T.encoder(path)[1][ids]))
        self.n = len(ids)
        raw = np.append(np.frombuffer(self.bytes, np.uint8), np.uint8(0))
        #: whether a token starts at the start of a character
        self.whole = (raw[self.at] & 0xC0) != 0x80
        self.cuts: dict[int, np.ndarray] = {}

    def cut_places(self, level: int) -> np.ndarray:
        """Tokens that begin at a separator of this level."""
        if level not in self.cuts:
            ends = np.array([m.end() for m in SEPARATORS[level].finditer(self.bytes)], np.int64)
            k = np.searchsorted(self.at, ends, "right") - 1
            self.cuts[level] = np.unique(k[self.whole[k]]) if len(k) else k
        return self.cuts[level]

    def atoms(self, lo: int, hi: int, size: int, level: int = 0) -> Iterator[int]:
        """Ends of consecutive parts of [lo, hi) of at most ``size`` tokens, cut at the strongest separators that do."""
        if hi - lo <= size:
            yield hi
        elif level == len(SEPARATORS):
            while lo < hi:
                lo = self.char_start(min(lo + size, hi), lo + 1)
                yield lo
        else:
            places = self.cut_places(level)
            inner = places[np.searchsorted(places, lo, "right") : np.searchsorted(places, hi, "left")]
            for end in [*inner.tolist(), hi]:
                yield from self.atoms(lo, end, size, level + 1)
                lo = end

    def char_start(self, k: int, least: int) -> int:
        """The last token at or before k, but not before ``least``, that starts with a whole character; else the next one."""
        j = k
        while j > least and not self.whole[j]:
            j -= 1
        while not self.whole[j]:
            j += 1
        return j

    def slice(self, lo: int, hi: int) -> str:
        return self.bytes[self.at[lo] : self.at[hi]].decode("utf-8", "surrogatepass")


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP, path: str = T.DEFAULT_VOCABULARY) -> list[Piece]:
    """The pieces of one text in order; one piece if the text is within the limit, none if it is empty.

    Every piece has at most ``limit`` tokens, also when it is encoded by itself. A piece begins with the last ``overlap`` tokens of
    the one before (a few more where that is inside a character). Without the overlaps the pieces are the text.
    """
    if overlap < 0 or limit < 2 * overlap + 2 * SPARE:
        raise ValueError("limit must be at least twice the overlap, and some tokens more")
    if not text:
        return []
    t = _Text(text, path)
    if t.n <= limit:
        return [Piece(0, t.n, text)]
    ends = list(t.atoms(0, t.n, limit - overlap - SPARE))
    out: list[Piece] = []
    done, k = 0, 0
    while done < t.n:
        start = t.char_start(max(0, done - overlap), 0)
        first = k
        while k < len(ends) and ends[k] - start <= limit:
            k += 1
        k = max(k, first + 1)
        # by itself a piece may take a few tokens more, as its first letters are cut from a word: then it gives up its last part
        while True:
            piece = t.slice(start, ends[k - 1])
            size = T.count(piece, path)
            if size <= limit:
                break
            if k - first > 1:
                k -= 1
            else:
                half = t.char_start((done + ends[first]) // 2, done + 1)
                ends.insert(first, half)
        out.append(Piece(start, size, piece, len(t.slice(start, done)) if done > start else 0))
        done = ends[k - 1]
    return out


def split_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, path: str = T.DEFAULT_VOCABULARY) -> DataFrame:
    """(doc_id, piece, pieces, first_token, n_tokens, shared_chars, text) of the documents longer than ``limit`` tokens; ``piece`` counts from 0, and
    ``shared_chars`` are those at a piece's start that the piece before has too.

    Documents within the limit give no row, as do null and empty texts. A document given twice is split twice. Texts of any length are
    taken whole; one without any separator is cut between characters. Other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    # a token has at least one byte
    rows = rows.where(F.octet_length("text") > limit)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, piece, pieces, first, size, shared, texts = ([] for _ in range(7))
            for i, x in enumerate(b.column("text").to_pylist()):
                found = split_text(x, limit, overlap, path)
                if len(found) < 2:
                    continue
                at += [i] * len(found)
                piece += range(len(found))
                pieces += [len(found)] * len(found)
                first += [p.first for p in found]
                size += [p.tokens for p in found]
                shared += [p.shared for p in found]
                texts += [p.text for p in found]
            yield pa.record_batch(
                [b.column("doc_id").take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(pieces, pa.int32()),
                 pa.array(first, pa.int64()), pa.array(size, pa.int32()), pa.array(shared, pa.int32()), pa.array(texts, pa.string())],
                ["doc_id", "piece", "pieces", "first_token", "n_tokens", "shared_chars", "text"],
            )

    return rows.mapInArrow(run, f"doc_id {kind}, piece int, pieces int, first_token long, n_tokens int, shared_chars int, text string")
