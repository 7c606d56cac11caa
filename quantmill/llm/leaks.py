"""Problem 6: evaluation texts inside training texts.

Method: an FM-index per shard of the training texts. A task gathers what it reads, batch after batch, into shards of SHARD symbols.
The text of a shard is the words of the documents; words that no item has become separators, and stretches too short to hold a
phrase are dropped, which loses no occurrence. Every phrase of an item (13 consecutive words, or the whole of a shorter item) is searched backwards through the ranks of
a wavelet matrix; occurrences are located by sampled suffix positions, and their spans merged per document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quantmill.llm import words as W
from quantmill.llm.fm import FMIndex

U64 = np.uint64
#: Consecutive words that make a leak.
PHRASE = 13
#: Items of a block, and letters of them: the items are a stated query set, taken in blocks of bounded size, and PASS blocks of these with
#: one reading of the documents.
ITEM_BLOCK, BLOCK_CHARS, PASS = 20_000, 2_000_000, 8
#: Symbols of a shard after which it is indexed.
SHARD = 2_000_000


@dataclass(frozen=True)
class Phrases:
    """The distinct phrases of a block of items over the items' own vocabulary (symbol = place in it + 1)."""

    vocabulary: np.ndarray
    phrases: np.ndarray
    lengths: np.ndarray
    phrase_of: np.ndarray
    item_of: np.ndarray

    @staticmethod
    def of(ids: list[int], texts: list[str], size: int = PHRASE) -> Phrases:
        h, o = W.words(pa.array([(t or "").lower() for t in texts], pa.string()))
        vocabulary = np.unique(h)
        symbol = np.searchsorted(vocabulary, h) + 1
        rows: dict[bytes, int] = {}
        table, lengths, phrase_of, item_of = [], [], [], []
        for i, item in enumerate(ids):
            s = symbol[o[i] : o[i + 1]]
            if not len(s):
                continue
            for k in range(max(1, len(s) - size + 1)):
                p = s[k : k + size]
                at = rows.setdefault(p.tobytes(), len(rows))
                if at == len(table):
                    table.append(np.pad(p, (0, size - len(p))))
                    lengths.append(len(p))
                phrase_of.append(at)
                item_of.append(item)
        pairs = np.unique(np.array([phrase_of, item_of], np.int64).reshape(2, -1), axis=1)
        return Phrases(vocabulary, np.array(table, np.int32).reshape(-1, size), np.array(lengths, np.int64), pairs[0], pairs[1])

    def hits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, first word, words) of every occurrence of a phrase."""
        shards = Shards(self)
        for first, _, data, offsets in W.chunks(texts):
            h, o, _, _ = W.words_of_bytes(data, offsets)
            shards.add(h, o, first)
        shards.close()
        return shards.found()

    def _reduce(self, h: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbols with separators, place of each in its text, text) of the stretches that can hold a phrase."""
        v = self.vocabulary
        at = np.minimum(np.searchsorted(v, h), len(v) - 1)
        known = v[at] == h
        owner = np.repeat(np.arange(len(o) - 1), np.diff(o))
        edge = known.copy()
        edge[1:] &= ~known[:-1] | (owner[1:] != owner[:-1])
        starts = np.flatnonzero(edge)
        stretch = np.cumsum(edge) - 1
        length = np.bincount(stretch[known], minlength=len(starts))
        keep = np.flatnonzero(known & (length[np.maximum(stretch, 0)] >= self.lengths.min())) if len(starts) else np.zeros(0, np.int64)
        if not len(keep):
            none = np.zeros(0, np.int64)
            return none, none, none
        # a separator before every stretch that is kept
        new = edge[keep]
        target = np.arange(len(keep)) + np.cumsum(new)
        n = len(keep) + int(new.sum())
        symbols, place, text = np.zeros(n, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        symbols[target] = at[keep] + 1
        place[target] = keep - o[:-1][owner[keep]]
        text[target] = owner[keep]
        return symbols, place, text

    def _shard(self, symbols: list[np.ndarray], where: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, ...]:
        text = np.concatenate(symbols)
        place, doc = (np.concatenate(x) for x in zip(*where))
        index = FMIndex(text, len(self.vocabulary) + 1)
        lo, hi = index.search(self.phrases, self.lengths)
        count = np.maximum(hi - lo, 0)
        phrase = np.repeat(np.arange(len(lo)), count)
        row = np.repeat(lo, count) + np.arange(len(phrase)) - np.repeat(np.cumsum(count) - count, count)
        at = index.locate(row)
        # every item that has the phrase
        order = np.argsort(self.phrase_of, kind="stable")
        begin = np.searchsorted(self.phrase_of[order], phrase, "left")
        items = np.searchsorted(self.phrase_of[order], phrase, "right") - begin
        each = np.repeat(np.arange(len(phrase)), items)
        k = np.repeat(begin, items) + np.arange(len(each)) - np.repeat(np.cumsum(items) - items, items)
        return doc[at[each]], self.item_of[order][k], place[at[each]], self.lengths[phrase[each]]


class Shards:
    """What a task has read, in shards that are indexed and searched when they are full. Texts are numbered by the caller."""

    def __init__(self, phrases: Phrases) -> None:
        self.phrases, self.size, self.indexed = phrases, 0, 0
        self.symbols: list[np.ndarray] = []
        self.where: list[tuple[np.ndarray, np.ndarray]] = []
        self.hits: list[tuple[np.ndarray, ...]] = []

    def add(self, h: np.ndarray, o: np.ndarray, first: int) -> None:
        """Texts of word hashes ``h`` with offsets ``o``, numbered from ``first``."""
        if not len(self.phrases.lengths):
            return
        s, place, text = self.phrases._reduce(h, o)
        self.symbols.append(s)
        self.where.append((place, text + first))
        self.size += len(s)
        if self.size >= SHARD:
            self.close()

    def close(self) -> None:
        if self.size:
            self.hits.append(self.phrases._shard(self.symbols, self.where))
            self.indexed += 1
        self.symbols, self.where, self.size = [], [], 0

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, first word, words) of the hits since the last call."""
        none = np.zeros(0, np.int64)
        out = tuple(np.concatenate(x) for x in zip(*self.hits)) if self.hits else (none, none, none, none)
        self.hits = []
        return out


def merge_spans(doc: np.ndarray, item: np.ndarray, first: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, ...]:
    """(doc, item, first word, end word) with overlapping and touching spans of the same document and item joined."""
    order = np.lexsort((first, item, doc))
    doc, item, first, end = doc[order], item[order], first[order], (first + words)[order]
    if not len(doc):
        return doc, item, first, end
    group = np.cumsum(np.append(True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])))
    far = np.int64(max(1, end.max() + 1))
    reach = np.maximum.accumulate(end + group * far) - group * far
    new = np.append(True, (group[1:] != group[:-1]) | (first[1:] > reach[:-1]))
    start = np.flatnonzero(new)
    return doc[start], item[start], first[start], np.maximum.reduceat(end, start)


def leaked_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "item_text") -> DataFrame:
    """(doc_id, item_id, spans): the documents that contain a phrase of an item, and the merged spans to remove, as
    array of (first word, word after the last).

    Null or empty texts and items, and items without a word, give no row, as do null ids of items; an item of fewer than 13 words
    must occur whole. A document given twice under one id gives its rows twice. Empty tables give no rows. Texts of any length are
    searched as wholes. Other columns are ignored. The documents are read once per PASS blocks of items.
    """
    wanted = docs.select(docs[doc_id].cast("long").alias("doc_id"), F.lower(docs[text]).alias("text")).where("text is not null")
    held = items.select(items[item_id].cast("long").alias("i"), items[item_text].alias("t")).where("i is not null and t is not null")
    schema = "doc_id long, item_id long, spans array<struct<first:int,end:int>>"
    out = None
    for blocks in _passes(held):
        phrases = wanted.sparkSession.sparkContext.broadcast([Phrases.of([r.i for r in block], [r.t for r in block]) for block in blocks])

        def search(batches: Iterator[pa.RecordBatch], phrases=phrases) -> Iterator[pa.RecordBatch]:
            shards = [Shards(p) for p in phrases.value]
            ids: list[pa.Array] = []
            seen = 0
            for b in batches:
                ids.append(b.column("doc_id"))
                for first, _, data, offsets in W.chunks(b.column("text")):
                    h, o, _, _ = W.words_of_bytes(data, offsets)
                    for x in shards:
                        x.add(h, o, seen + first)
                seen += b.num_rows
            for x in shards:
                x.close()
                if seen:
                    yield _rows(pa.concat_arrays(ids), *merge_spans(*x.found()))

        part = wanted.mapInArrow(search, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else wanted.sparkSession.createDataFrame([], schema)


def _passes(items: DataFrame) -> Iterator[list[list]]:
    held: list[list] = []
    for block in _blocks(items):
        held.append(block)
        if len(held) == PASS:
            yield held
            held = []
    if held:
        yield held


def _blocks(items: DataFrame) -> Iterator[list]:
    block: list = []
    size = 0
    for row in items.toLocalIterator():
        block.append(row)
        size += len(row.t)
        if len(block) == ITEM_BLOCK or size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def _rows(ids: pa.Array, doc: np.ndarray, item: np.ndarray, first: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]))) if len(doc) else np.zeros(0, np.int64)
    spans = pa.StructArray.from_arrays([pa.array(first.astype(np.int32)), pa.array(end.astype(np.int32))], ["first", "end"])
    lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(doc)).astype(np.int32)), spans)
    return pa.record_batch([ids.take(pa.array(doc[new])), pa.array(item[new].astype(np.int64)), lists], ["doc_id", "item_id", "spans"])
