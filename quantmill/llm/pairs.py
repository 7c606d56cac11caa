"""Shared machinery of the near-duplicate operators: keys in buckets, candidate pairs, exact check.

Texts with the same set of words form one *class*, named by a 64-bit hash of that set, so that exact
copies, however many, are compared once. (Two different sets share a name with probability below
n*n / 2**65.) A pass over the texts cuts every class into keyed entries (suffixes, or sketches), packs them by
bucket into column-wise blobs, and shuffles the blobs. A bucket is sorted; runs of equal keys give candidate
pairs, kept if their lengths and two 64-bit parities of their words allow the similarity. The filters never
drop a pair that reaches it. Candidates are checked exactly on the texts.

A key that many texts may hold is spread over cells, each of which has two blocks of its classes; every two
classes meet in some cell, and no task gets more than about 2 * BLOCK of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quantmill.llm import words as W
from quantmill.session import cut

U64 = np.uint64
#: Similarity of the word sets, as a fraction, so that the check is exact in integers.
SIM_NUM, SIM_DEN = 3, 5
#: Tag of an entry: its lowest bit says that it leads (a word that only meets the leading words of sets of no more words does
#: not), the next two the side that its text is on, the others what follows in the text.
LEADS, SIDE = U64(1), U64(1)
#: Runs longer than this are compared in blocks of so many rows and columns.
LONG, ROWS, COLUMNS = 64, 512, 4096
#: Classes of one key in a block of a cell.
BLOCK = 1 << 17
#: Entries held by a task before they are packed.
FLUSH = 2_000_000
#: Bytes that a bucket should have.
BUCKET_BYTES = 24 << 20
#: Words are counted by this many bits of their hash.
COUNT_BITS = 18

_FIELDS = (("key", "<u8"), ("rid", "<u8"), ("s1", "<u8"), ("s2", "<u8"), ("n", "<u4"), ("tag", "<u8"))
_OF_CLASS = ("rid", "s1", "s2", "n")
Entries = dict[str, np.ndarray]


def _planes(x: np.ndarray, kind: str) -> bytes:
    """Bytes of equal weight together, so that high zero bytes compress away."""
    return np.ascontiguousarray(x.astype(kind).view(np.uint8).reshape(len(x), np.dtype(kind).itemsize).T).tobytes()


def pack(e: Entries) -> bytes:
    """Entries as one blob: sorted by key, keys as differences, what belongs to a class once in a table of the blob's classes."""
    order = np.argsort(e["key"], kind="stable")
    key = e["key"][order].astype(U64)
    rid, first, place = np.unique(e["rid"][order], return_index=True, return_inverse=True)
    key[1:] -= key[:-1].copy()
    columns = [(key, "<u8"), (place, "<u4"), (e["tag"][order], "<u8"), (rid, "<u8")] + [(e[f][order][first], kind) for f, kind in _FIELDS if f in _OF_CLASS[1:]]
    return np.array([len(key), len(rid)], np.int64).tobytes() + b"".join(_planes(x, kind) for x, kind in columns)


def unpack(blob: bytes) -> Entries:
    n, classes = (int(x) for x in np.frombuffer(blob, np.int64, 2))
    at, columns = 16, []
    for size, kind in ((n, "<u8"), (n, "<u4"), (n, "<u8"), (classes, "<u8"), (classes, "<u8"), (classes, "<u8"), (classes, "<u4")):
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(blob, np.uint8, size * width, at).reshape(width, size)
        columns.append(np.ascontiguousarray(planes.T).view(kind).reshape(size))
        at += size * width
    key, place, tag, *of_class = columns
    return {"key": np.cumsum(key, dtype=U64), "tag": tag} | {f: x[place] for f, x in zip(_OF_CLASS, of_class)}


class Classes:
    """The distinct word sets of a batch of texts."""

    def __init__(self, texts: pa.Array, salt: np.ndarray | None = None, side: np.ndarray | None = None) -> None:
        self.hashes, self.offsets = W.words(texts)
        self.set_hashes, self.set_offsets, self.set_places = W.distinct_sorted(self.hashes, self.offsets)
        self.n = np.diff(self.set_offsets)
        self.side = np.zeros(len(self.n), np.int64) if side is None else side
        rid = W.segment_sum(W.mix(self.set_hashes), self.set_offsets) + self.n.astype(U64)
        self.rid = W.mix(rid if salt is None else rid + W.mix(salt.astype(U64)))

    @staticmethod
    def of(b: pa.RecordBatch) -> Classes:
        """A batch with a text and, if wanted, a table number that keeps tables apart, and a side."""
        number = lambda name: np.asarray(b.column(name).to_numpy(zero_copy_only=False), np.int64) if name in b.schema.names else None
        return Classes(b.column("text"), number("tab"), number("side"))

    def first_of_each(self) -> np.ndarray:
        """One text of every class that has words, on every side."""
        order = np.lexsort((self.side, self.rid))
        first = order[_differ(self.rid[order], self.side[order])]
        return first[self.n[first] > 0]

    @cached_property
    def parities(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits, each the parity of the words whose hash names it: sets that differ in d words differ in at most d bits."""
        bit = U64(1) << (self.set_hashes & U64(63))
        high = (self.set_hashes >> U64(6)) & U64(1) == 1
        full, out = self.n > 0, []
        for mask in (high, ~high):
            p = np.zeros(len(self.n), U64)
            if full.any():
                p[full] = np.bitwise_xor.reduceat(np.where(mask, bit, U64(0)), self.set_offsets[:-1][full])
            out.append(p)
        return out[0], out[1]

    def entries(self, key: np.ndarray, at: np.ndarray, tag: np.ndarray, held: np.ndarray) -> Entries:
        """Keyed entries of the texts ``at``. ``held`` bounds the number of texts with the key: those of more than BLOCK go to cells."""
        blocks = -(-held // BLOCK)
        if (blocks > 2).any():
            key, at, tag = _cells(key, at, tag, np.maximum(blocks, 2), self.rid)
        s1, s2 = self.parities
        side = self.side[at].astype(U64) << SIDE
        return {"key": key, "rid": self.rid[at], "s1": s1[at], "s2": s2[at], "n": self.n[at], "tag": tag.astype(U64) | side}


def _cells(key: np.ndarray, at: np.ndarray, tag: np.ndarray, blocks: np.ndarray, rid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of keys of more than two blocks, once for each other block: the cell of two blocks is a key of its own."""
    copies = blocks - 1
    copies[blocks == 2] = 1
    where = np.repeat(np.arange(len(key)), copies)
    other = np.arange(len(where)) - np.repeat(np.cumsum(copies) - copies, copies)
    of = blocks[where]
    own = (W.mix(rid[at[where]] ^ key[where]) % of.astype(U64)).astype(np.int64)
    other = other + (other >= own)
    cell = np.minimum(own, other) * of + np.maximum(own, other) + 1
    new = W.mix(key[where] + cell.astype(U64) * U64(0x9E3779B97F4A7C15))
    return np.where(of == 2, key[where], new), at[where], tag[where]


def slots(h: np.ndarray) -> np.ndarray:
    """Place of a word in the table of counts."""
    return (W.mix(h + U64(1)) >> U64(64 - COUNT_BITS)).astype(np.int64)


def word_counts(texts: DataFrame) -> tuple[np.ndarray, int]:
    """(table of the number of texts with a word, by ``slots``; number of texts). Words of one slot are counted together, so a count
    is an upper bound. Counts are taken in each task first; the table has 2**COUNT_BITS places whatever the data's size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, rows = np.zeros(1 << COUNT_BITS, np.int64), 0
        for b in batches:
            c = Classes.of(b)
            table += np.bincount(slots(c.set_hashes), minlength=len(table))
            rows += b.num_rows
        used = np.flatnonzero(table)
        yield pa.record_batch([pa.array(np.append(used, -1).astype(np.int32)), pa.array(np.append(table[used], rows))], ["slot", "n"])

    rows = texts.mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    slot, n = rows.column("slot").to_numpy(), rows.column("n").to_numpy()
    table = np.zeros(1 << COUNT_BITS, np.int64)
    table[slot[slot >= 0]] = n[slot >= 0]
    return table, int(n[slot < 0].sum())


def is_in(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Membership in a sorted table."""
    if not len(table):
        return np.zeros(len(values), np.bool_)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values


def joined(*parts: Entries) -> Entries:
    return {f: np.concatenate([x[f].astype(kind) for x in parts]) for f, kind in _FIELDS}


def candidate_pairs(texts: DataFrame, entries: Callable[[Classes, np.ndarray], Entries], total: int, per_text: int, sides: bool = False, most: int | None = None) -> DataFrame:
    """Distinct pairs (a, b), a < b, of classes that share a key and may be similar; with ``sides`` only those of texts on different ones.

    ``texts`` has a lower-cased text and, if wanted, a table number and a side. ``entries`` gives the keyed entries of the chosen texts
    of a batch; ``total`` and ``per_text`` size the buckets. With ``most``, a class is paired with at most so many others of a
    run, and the classes of a run that this leaves open come out as rows (a, run, s1, s2, n) without b, for ``open_pairs``.
    """
    width = sum(np.dtype(t).itemsize for _, t in _FIELDS)
    buckets = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), total * per_text * width // BUCKET_BYTES + 1)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Entries] = []
        for b in batches:
            c = Classes.of(b)
            held.append(entries(c, c.first_of_each()))
            if sum(len(e["key"]) for e in held) >= FLUSH:
                yield _by_bucket(held, buckets)
                held = []
        if held:
            yield _by_bucket(held, buckets)

    def pair(table: pa.Table) -> pa.Table:
        return bucket_pairs([unpack(x.as_buffer()) for x in table.column("blob").combine_chunks()], sides, most)

    blobs = texts.mapInArrow(split, "bucket int, blob binary")
    # as many partitions as buckets, so that a task's part stays as large as it is when the data grow
    return blobs.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(pair, PAIRS).distinct()


PAIRS = "a long, b long, run long, s1 long, s2 long, n int"


def _by_bucket(held: list[Entries], buckets: int) -> pa.RecordBatch:
    e = {f: np.concatenate([x[f] for x in held]) for f, _ in _FIELDS}
    bucket = (W.mix(e["key"]) % U64(buckets)).astype(np.int32)
    # copies of a class in other batches of this task are dropped here already
    order = np.lexsort((e["tag"], e["rid"], e["key"], bucket))
    e, bucket = {f: x[order] for f, x in e.items()}, bucket[order]
    keep = _differ(e["key"], e["rid"], e["tag"])
    e, bucket = {f: x[keep] for f, x in e.items()}, bucket[keep]
    names, first = np.unique(bucket, return_index=True)
    ends = np.append(first[1:], len(bucket))
    blobs = [pack({f: x[i:j] for f, x in e.items()}) for i, j in zip(first, ends)]
    return pa.record_batch([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])


def _differ(*columns: np.ndarray) -> np.ndarray:
    """Rows that are not the same as the one before."""
    out = np.ones(len(columns[0]), np.bool_)
    out[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in columns])
    return out


def bucket_pairs(parts: list[Entries], sides: bool = False, most: int | None = None) -> pa.Table:
    """Candidate pairs of one bucket, and what ``most`` leaves open: see ``candidate_pairs``."""
    e = {f: np.concatenate([x[f] for x in parts]).astype(kind) for f, kind in _FIELDS}
    # suffixes in order: first the key, then what follows
    order = np.lexsort((e["rid"], e["tag"], e["key"]))
    e = {f: x[order] for f, x in e.items()}
    keep = _differ(e["key"], e["rid"], e["tag"])
    e = {f: x[keep] for f, x in e.items()}
    order = np.lexsort((e["rid"], e["n"], e["key"]))
    e = {f: x[order] for f, x in e.items()}
    return _matched(e, sides, most, None)


def open_pairs(rows: DataFrame, group_of: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of the runs that ``most`` left open, of classes that are not in one group yet. ``rows``: (a, run, s1, s2, n) of
    ``candidate_pairs``, materialised; ``group_of``: (node, component), nodes that do not appear being groups of their own."""

    def pair(table: pa.Table) -> pa.Table:
        column = lambda name: table.column(name).to_numpy().astype(np.int64).view(U64)
        e = {"key": column("run"), "rid": column("a"), "s1": column("s1"), "s2": column("s2"), "n": table.column("n").to_numpy(), "tag": np.full(table.num_rows, LEADS)}
        group = column("component")
        order = np.lexsort((e["rid"], e["n"], e["key"]))
        return _matched({f: x[order] for f, x in e.items()}, False, None, group[order]).select(["a", "b"])

    known = rows.join(group_of.withColumnRenamed("node", "a"), "a", "left").withColumn("component", F.coalesce("component", "a"))
    return known.groupBy("run").applyInArrow(pair, "a long, b long").distinct()


def _matched(e: Entries, sides: bool, most: int | None, group: np.ndarray | None) -> pa.Table:
    """Pairs among entries in order of key, n and rid."""
    key, n, tag = e["key"], e["n"].astype(np.int64), e["tag"]
    leads, side = tag & LEADS == 1, (tag >> SIDE) & U64(3)
    fold = e["s1"] ^ e["s2"]
    start = np.flatnonzero(_differ(key)) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(key)))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    open_runs: list[int] = []

    def add(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = (leads[i] | (leads[j] & (n[i] == n[j]))) & (e["rid"][i] != e["rid"][j])
        if sides:
            ok &= side[i] != side[j]
        if group is not None:
            ok &= group[i] != group[j]
        i, j = i[ok], j[ok]
        ok = _may_reach(n[i], n[j], np.bitwise_count(e["s1"][i] ^ e["s1"][j]).astype(np.int64) + np.bitwise_count(e["s2"][i] ^ e["s2"][j]))
        return i[ok], j[ok]

    for s, m in zip(start[size > LONG], size[size > LONG]):
        if sides:
            parts = [np.flatnonzero(side[s : s + m] == x) + s for x in np.unique(side[s : s + m])]
            blocks = [(x[leads[x]], y) for k, x in enumerate(parts) for o, y in enumerate(parts) if k != o]
        elif group is not None:
            # two classes of different groups: one at least is not of the largest
            whole, (names, count) = np.arange(s, s + m), np.unique(group[s : s + m], return_counts=True)
            others = whole[group[s : s + m] != names[count.argmax()]]
            blocks = [(others, whole), (whole, others)] if len(others) else []
        else:
            blocks = [(np.arange(s, s + m), np.arange(s, s + m))]
        is_open = False
        for x, y in blocks:
            is_open |= _run_pairs(x, y, n, fold, leads, add, most, found)
        if is_open:
            open_runs.append(int(s))
    left = np.repeat(np.where(size > LONG, 0, start + size), size) - np.arange(len(key)) - 1
    i, lag = np.flatnonzero(left > 0), 1
    while len(i):
        for at in np.array_split(i, len(i) // 4_000_000 + 1):
            j = at + lag
            ok = _may_reach(n[at], n[j], np.bitwise_count(fold[at] ^ fold[j]).astype(np.int64))
            found.append(add(at[ok], j[ok]))
        lag += 1
        i = i[left[i] >= lag]
    rid = e["rid"].view(np.int64)
    i, j = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    a, b = np.minimum(rid[i], rid[j]), np.maximum(rid[i], rid[j])
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    once = _differ(a, b)
    a, b = a[once], b[once]
    rows = np.concatenate([np.arange(s, s + m) for s, m in zip(start, size) if s in set(open_runs)]) if open_runs else np.zeros(0, np.int64)
    none = lambda k, kind=pa.int64(): pa.nulls(k, kind)
    count = len(a)
    columns = {
        "a": pa.array(np.append(a, rid[rows])), "b": pa.chunked_array([pa.array(b), none(len(rows))]),
        "run": pa.chunked_array([none(count), pa.array(key[rows].view(np.int64))]), "s1": pa.chunked_array([none(count), pa.array(e["s1"][rows].view(np.int64))]),
        "s2": pa.chunked_array([none(count), pa.array(e["s2"][rows].view(np.int64))]), "n": pa.chunked_array([none(count, pa.int32()), pa.array(n[rows].astype(np.int32))]),
    }
    return pa.table(columns)


def _run_pairs(rows: np.ndarray, columns: np.ndarray, n: np.ndarray, fold: np.ndarray, leads: np.ndarray, add: Callable, most: int | None, found: list) -> bool:
    """Adds to ``found`` the (i, j) of two parts of one run that may reach the similarity, i of no more words than j, and i before j where both are in one
    part. Both parts are in order of n. True if ``most`` left pairs out."""
    small = np.minimum(n, 256).astype(np.uint16)  # a set of 256 words passes the filter with any other
    wide, same, is_open = n[columns], rows is columns or (len(rows) == len(columns) and (rows == columns).all()), False
    for k in range(0, len(rows), ROWS):
        i = rows[k : k + ROWS]
        low = k if same else np.searchsorted(wide, n[i[0]])
        high = np.searchsorted(wide, SIM_DEN * n[i[-1]] // SIM_NUM, "right")
        have = np.zeros(len(i), np.int64)
        for first in range(low, high, COLUMNS):
            live = np.flatnonzero(have <= most) if most is not None else np.arange(len(i))
            if not len(live):
                break
            j = columns[first : min(first + COLUMNS, high)]
            differ = np.bitwise_count(fold[i[live]][:, None] ^ fold[j][None, :])
            x, y = np.nonzero(differ * np.uint16(SIM_DEN + SIM_NUM) <= (SIM_DEN - SIM_NUM) * (small[i[live]][:, None] + small[j][None, :]))
            ok = n[i[live[x]]] <= n[j[y]]
            if same:
                ok &= i[live[x]] < j[y]
            x, (a, b) = live[x[ok]], (i[live[x[ok]]], j[y[ok]])
            if most is None:
                found.append(add(a, b))
                continue
            a, b = add(a, b)
            x = np.searchsorted(i, a)
            nth = have[x] + np.arange(len(x)) - np.searchsorted(x, x)
            have += np.bincount(x, minlength=len(i))
            found.append((a[nth < most], b[nth < most]))
        is_open |= most is not None and bool((have > most).any())
    return is_open


def _may_reach(n1: np.ndarray, n2: np.ndarray, differ: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can reach the similarity if they differ in at least so many words. With intersection i and union u,
    i / u >= s needs |A xor B| = u - i <= (1 - s) / (1 + s) * (n1 + n2), and at least min / max >= s."""
    return (differ * (SIM_DEN + SIM_NUM) <= (SIM_DEN - SIM_NUM) * (n1 + n2)) & (SIM_DEN * np.minimum(n1, n2) >= SIM_NUM * np.maximum(n1, n2))


def class_texts(texts: DataFrame) -> DataFrame:
    """(rid, text): one text of every class, thinned in each task before the shuffle."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = Classes.of(b)
            first = c.first_of_each()
            yield pa.record_batch([pa.array(c.rid[first].view(np.int64)), b.column("text").take(pa.array(first))], ["rid", "text"])

    return texts.mapInArrow(one, "rid long, text string")


def with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``pairs`` (a, b, ...), materialised, with text_a and text_b. Texts of classes without a candidate leave at the first join."""
    ends = pairs.select(F.col("a").alias("rid")).union(pairs.select("b")).distinct()
    held = cut(class_texts(texts).join(ends, "rid", "left_semi").groupBy("rid").agg(F.first("text").alias("text")))
    left = pairs.join(held.select(F.col("rid").alias("a"), F.col("text").alias("text_a")), "a")
    return left.join(held.select(F.col("rid").alias("b"), F.col("text").alias("text_b")), "b")


def shared_words(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(size of the intersection, of the union) of the word sets of aligned texts."""
    ha, oa, _ = W.distinct_sorted(*W.words(a))
    hb, ob, _ = W.distinct_sorted(*W.words(b))
    na, nb = np.diff(oa), np.diff(ob)
    owner = np.concatenate([np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)])
    h = np.concatenate([ha, hb])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    twice = owner[1:][(h[1:] == h[:-1]) & (owner[1:] == owner[:-1])]
    inter = np.bincount(twice, minlength=len(na))
    return inter, na + nb - inter


def reaches(inter: np.ndarray, union: np.ndarray) -> np.ndarray:
    return SIM_DEN * inter >= SIM_NUM * union


def memberships(rows: DataFrame) -> DataFrame:
    """(tab, id, split, source, rid) of the last delivery of every (tab, id); ``rows`` has text, tab, id, split, source, at.

    A delivery that is later by ``at`` replaces the others, also when its text is null or empty: such records
    have no words, are in no class and do not appear."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = Classes.of(b)
            rid = pa.array(c.rid.view(np.int64), mask=c.n == 0)
            yield pa.record_batch([*(b.column(x) for x in ("tab", "id", "split", "source", "at")), rid], ["tab", "id", "split", "source", "at", "rid"])

    named = rows.select("text", "tab", "id", "split", "source", "at").mapInArrow(name, "tab int, id long, split string, source string, at timestamp, rid long")
    last = named.groupBy("tab", "id").agg(F.max_by(F.struct("rid", "split", "source"), F.struct("at", "rid", "split", "source")).alias("x"))
    return last.select("tab", "id", F.col("x.split").alias("split"), F.col("x.source").alias("source"), F.col("x.rid").alias("rid")).where("rid is not null")
