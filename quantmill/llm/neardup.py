"""Problem 4: groups of texts that differ by small edits.

Method: order MinHash. The k-mers of a text are its words, labelled by occurrence. For each of SKETCHES hash functions
the k-mers of least hash are kept in the order of the text; together they are one key. Two texts meet if a key
agrees, which needs the same k-mers in the same order and so follows edit similarity. A key has MINIMA k-mers, and more, up to
MOST, as long as all of its words are frequent: it then says about as much as one with a rarer word, and
a large group of similar texts is found by its frequent words.

Candidates are verified by a banded alignment: it proves the similarity where the aligned words suffice. What it
leaves open (words moved far) is settled by the sets of words. Links are closed to groups by connected components; a class of a long
run is at first linked to a few others, and then to those of other groups, so that large groups stay linear.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quantmill.llm import pairs as P, words as W
from quantmill.operators.components import connected_components
from quantmill.session import cut

U64 = np.uint64
_USED = U64(2**64 - 1)
#: Words in a k-mer, and how many sketches are taken.
K, SKETCHES = 1, 32
#: K-mers in a key; up to MOST while all of its words are held by FREQUENT of the texts or more.
MINIMA, MOST, FREQUENT = 2, 4, 0.02
#: Other classes of a long run that a class is linked to at first.
PARTNERS = 16
#: Half width of the alignment's band, in words.
BAND = 8


def kmers(h: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, owner, place) of the spans of k words, in text order; a text of fewer words is one k-mer."""
    n = len(h)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    end = offsets[1:][owner]
    key = h + U64(k)
    for j in range(1, k):
        key = key * U64(0x9E3779B97F4A7C15) + np.where(np.arange(n) + j < end, W.ahead(h, j), U64(0))
    keep = (np.arange(n) + k <= end) | ((np.diff(offsets) < k)[owner] & (np.arange(n) == offsets[:-1][owner]))
    return W.mix(key[keep]), owner[keep], np.flatnonzero(keep)


def occurrence(key: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """How often the same k-mer stood before in the same text."""
    order = np.lexsort((np.arange(len(key)), key, owner))
    new = np.ones(len(key), np.bool_)
    new[1:] = (key[order][1:] != key[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    start = np.flatnonzero(new)
    label = np.empty(len(key), np.int64)
    label[order] = np.arange(len(key)) - np.repeat(start, np.diff(np.append(start, len(key))))
    return label


def sketch_entries(c: P.Classes, texts: np.ndarray, counts: np.ndarray, total: int) -> P.Entries:
    """The order-MinHash keys of the chosen texts; ``counts``: table of the number of texts with a word, of ``total``."""
    chosen = np.zeros(len(c.n), np.bool_)
    chosen[texts] = True
    key, owner, place = kmers(c.hashes, c.offsets, K)
    keep = chosen[owner]
    key, owner = key[keep], owner[keep]
    held = counts[P.slots(c.hashes[place[keep]])]
    key = W.mix(key + occurrence(key, owner).astype(U64) * U64(0x632BE59BD9B4E019))
    offsets = np.searchsorted(owner, np.arange(len(c.n) + 1))
    have = np.flatnonzero(np.diff(offsets) > 0)
    keys, bounds = [], []
    for seed in W.mix(np.arange(1, SKETCHES + 1).astype(U64)) if len(have) else ():
        k, bound = _order_minhash(key, held, offsets[:-1][have], offsets[1:][have], seed, FREQUENT * total)
        keys.append(k)
        bounds.append(bound)
    at = np.tile(have, len(keys))
    key, bound = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((keys, U64), (bounds, np.int64)))
    return c.entries(key, at, np.full(len(at), P.LEADS), bound)


def _order_minhash(key: np.ndarray, held: np.ndarray, first: np.ndarray, last: np.ndarray, seed: np.uint64, frequent: float) -> tuple[np.ndarray, np.ndarray]:
    """(the k-mers of least rank of every text, joined in text order; how many texts hold the rarest of them, at most)."""
    rank = W.mix(key ^ seed)
    bound, places = np.full(len(first), np.iinfo(np.int64).max), []
    for m in range(MOST):
        least = np.minimum.reduceat(rank, first)
        at = np.flatnonzero(rank == np.repeat(least, last - first))
        where = np.empty(len(first), np.int64)
        where[(np.searchsorted(first, at, "right") - 1)[::-1]] = at[::-1]
        if places:  # a text whose k-mers are used up repeats its last place
            where = np.where((least == _USED) | ((m >= MINIMA) & (bound < frequent)), places[-1], where)
        bound = np.minimum(bound, held[where])
        places.append(where)
        rank[where] = _USED
    joined, before = np.full(len(first), seed, U64), np.full(len(first), -1)
    for p in np.sort(np.stack(places), axis=0):
        joined = np.where(p == before, joined, W.mix(joined * U64(0x9E3779B97F4A7C15) + key[p]))
        before = p
    return joined, bound


def banded_shared(a: pa.Array, b: pa.Array, band: int = BAND) -> np.ndarray:
    """Words in the longest common subsequence of each pair of texts, within ``band`` words of the diagonal.
    All pairs of a batch advance together, so a step is a few numpy operations; pairs are taken in order of length."""
    ha, oa = W.words(a)
    hb, ob = W.words(b)
    la, lb = np.diff(oa), np.diff(ob)
    out = np.zeros(len(la), np.int64)
    order = np.argsort(la)
    for part in np.array_split(order, max(1, len(order) // 2048)):
        if not len(part):
            continue
        width = 2 * band + 1
        # best[d] : columns j = i + d - band
        row = np.zeros((len(part), width + 1), np.int32)
        shift = np.arange(width) - band
        for i in range(int(la[part].max(initial=0))):
            j = i + shift
            inside = (i < la[part])[:, None] & (j >= 0)[None, :] & (j[None, :] < lb[part][:, None])
            at_a = np.minimum(oa[:-1][part] + i, max(len(ha) - 1, 0))
            at_b = np.clip(ob[:-1][part][:, None] + j[None, :], 0, max(len(hb) - 1, 0))
            same = inside & (ha[at_a][:, None] == hb[at_b]) if len(ha) and len(hb) else np.zeros_like(inside)
            # row[:, d] of the last step is (i-1, j-1); row[:, d+1] is (i-1, j)
            new = np.maximum(row[:, :width] + same, row[:, 1:])
            np.maximum.accumulate(new, axis=1, out=new)
            alive = (i < la[part])[:, None]
            row[:, :width] = np.where(alive, new, row[:, :width])
            row[:, width] = 0
        out[part] = row.max(axis=1)
    return out


def verified(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whether the similarity is reached, whether the alignment proves it, edit similarity) of aligned texts. Words of an alignment are in both
    texts; at most as many of them are repetitions as the text with fewer of these has."""
    (ha, oa), (hb, ob) = W.words(a), W.words(b)
    la, lb = np.diff(oa), np.diff(ob)
    na, nb = np.diff(W.distinct_sorted(ha, oa)[1]), np.diff(W.distinct_sorted(hb, ob)[1])
    aligned = banded_shared(a, b)
    least = np.maximum(0, aligned - np.minimum(la - na, lb - nb))
    proved = P.reaches(least, na + nb - least) & (least > 0)
    reached = proved.copy()
    rest = np.flatnonzero(~proved)
    if len(rest):
        reached[rest] = P.reaches(*P.shared_words(a.take(pa.array(rest)), b.take(pa.array(rest))))
    return reached, proved, 2 * aligned / np.maximum(1, la + lb)


def _links(found: DataFrame, texts: DataFrame) -> DataFrame:
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            reached, proved, edit = verified(b.column("text_a"), b.column("text_b"))
            keep = pa.array(np.flatnonzero(reached))
            columns = [b.column("a"), b.column("b"), pa.array(proved), pa.array(edit)]
            yield pa.record_batch([x.take(keep) for x in columns], ["a", "b", "aligned", "edit_similarity"])

    return P.with_texts(found, texts).mapInArrow(check, "a long, b long, aligned boolean, edit_similarity double")


def near_duplicate_links(texts: DataFrame) -> DataFrame:
    """(a, b, aligned, edit_similarity): links of the classes of ``texts`` (text, tab) whose closure is the groups; each reaches the similarity."""
    counts, total = P.word_counts(texts)
    entries = lambda c, t: sketch_entries(c, t, counts, total)
    found = cut(P.candidate_pairs(texts, entries, total, SKETCHES, most=PARTNERS))
    links = cut(_links(found.where("b is not null").select("a", "b"), texts))
    left = found.where("b is null").drop("b")
    if left.isEmpty():
        return links
    more = cut(P.open_pairs(left, connected_components(links.select("a", "b"))))
    return links if more.isEmpty() else links.unionByName(cut(_links(more, texts)))


def near_duplicate_groups(rows: DataFrame) -> DataFrame:
    """(id, group_id, rid, aligned) of every record with words: its group, its set of words, and how many of the links by which it was
    found the alignment proved.

    ``rows``: id long, at timestamp, text string; more columns are ignored. Records of the same group have the same
    ``group_id``; records without a near duplicate are groups of one. Records delivered again count once, as last delivered.
    Null or empty texts, or texts without a word, are in no group and do not appear; texts with the same words are in one
    group; an empty table gives no rows. Texts of any length are compared as wholes.
    """
    base = rows.select(
        F.lower("text").alias("text"), F.lit(0).alias("tab"), F.col("id").cast("long").alias("id"), F.lit("").alias("split"), F.lit("").alias("source"), F.col("at").cast("timestamp").alias("at"),
    )
    links = near_duplicate_links(base.where("text is not null").select("text", "tab"))
    ends = links.select(F.col("a").alias("rid"), "aligned").unionAll(links.select("b", "aligned"))
    proved = ends.groupBy("rid").agg(F.count_if("aligned").alias("aligned"))
    group = connected_components(links.select("a", "b")).withColumnRenamed("node", "rid")
    known = group.join(proved, "rid")
    return P.memberships(base).join(known, "rid", "left").select(
        "id", F.coalesce("component", "rid").alias("group_id"), "rid", F.coalesce("aligned", F.lit(0)).alias("aligned")
    )


def group_pairs(groups: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b, of the records of the same group."""
    g = groups.select("id", "group_id")
    return (
        g.select(F.col("id").alias("id_a"), "group_id")
        .join(g.select(F.col("id").alias("id_b"), "group_id"), "group_id")
        .where("id_a < id_b")
        .select("id_a", "id_b")
    )
