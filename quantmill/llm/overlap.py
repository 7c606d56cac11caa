"""Problem 3: the same or nearly the same record in the train split and in an evaluation split.

Method: a partitioned suffix array over the words of all texts. It is sparse: of every text it has the suffixes that start at
its rarest words, as many as two similar texts cannot avoid sharing one of, since with long common prefixes alone a pair whose
words are edited here and there, or moved, would be lost. Suffixes are partitioned by their first word; those of
a train and of an evaluation text in one partition are candidates. Candidates are checked exactly, and the suffix array of the texts
of all pairs, concatenated, gives the spans that neighbouring suffixes of the two sides share: they are merged into
the part of each record that they cover.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quantmill.llm import pairs as P, words as W
from quantmill.session import cut

U64 = np.uint64
#: Words that a shared span has at least, to count for the coverage.
GRAM = 4
TRAIN, EVAL, NONE = 1, 2, 0


def suffix_entries(c: P.Classes, texts: np.ndarray, counts: np.ndarray) -> P.Entries:
    """The suffixes of the chosen texts that start at their rarest words (``counts``: table of the number of texts with a word): n - ceil(s n) + 1 of
    the n words, as two sets of similarity s share at least ceil(s n) words. The first word that they share, rarest first, is also
    among the first n - ceil(2 s n / (1 + s)) + 1 of the set of fewer words; these lead."""
    chosen = np.zeros(len(c.n), np.bool_)
    chosen[texts] = True
    owner = np.repeat(np.arange(len(c.n)), c.n)
    keep = chosen[owner]
    owner, h = owner[keep], c.set_hashes[keep]
    held = counts[P.slots(h)]
    order = np.lexsort((h, held, owner))
    h, held = h[order], held[order]
    rank = np.arange(len(h)) - np.searchsorted(owner, owner)
    size = c.n[owner]
    first = rank <= size + (P.SIM_NUM * -size // P.SIM_DEN)
    leads = rank <= size + (2 * P.SIM_NUM * -size // (P.SIM_NUM + P.SIM_DEN))
    return c.entries(W.mix(h[first] + U64(1)), owner[first], leads[first].astype(U64), held[first])


def similar_classes(texts: DataFrame) -> DataFrame:
    """(a, b, inter, total, span, cover_a, cover_b) of the classes of ``texts`` (text, tab, side) that reach the similarity and have texts on different
    sides; ``span`` is the longest run of words that both have, ``cover`` the share of a text's words inside shared runs of GRAM words or more."""
    counts, total = P.word_counts(texts)
    found = cut(P.candidate_pairs(texts, lambda c, t: suffix_entries(c, t, counts), total, 14, sides=True).select("a", "b"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            inter, union = P.shared_words(b.column("text_a"), b.column("text_b"))
            keep = np.flatnonzero(P.reaches(inter, union))
            a, b, ta, tb = (b.column(x).take(pa.array(keep)) for x in ("a", "b", "text_a", "text_b"))
            span, cover_a, cover_b = shared_spans(ta, tb)
            columns = [a, b, pa.array(inter[keep]), pa.array(union[keep]), pa.array(span), pa.array(cover_a), pa.array(cover_b)]
            yield pa.record_batch(columns, ["a", "b", "inter", "total", "span", "cover_a", "cover_b"])

    return P.with_texts(found, texts).mapInArrow(check, "a long, b long, inter long, total long, span long, cover_a double, cover_b double")


def ranks(symbols: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes of a concatenation of texts by their first 1, 2, 4, ... symbols, by doubling, until they decide. ``end``: end of
    the text of each place, where its suffixes end; equal ranks are equal beginnings."""
    at = np.arange(len(symbols))
    out, length = [np.unique(symbols, return_inverse=True)[1].astype(np.int64)], 1
    longest = int((end - at).max(initial=0))
    while length < longest and out[-1].max() + 1 < len(symbols):
        rank, inside = out[-1], at + length < end
        later = np.where(inside, rank[np.where(inside, at + length, 0)] + 1, 0)
        both = rank * (len(at) + 1) + later
        order = np.argsort(both)
        new = np.zeros(len(at), np.int64)
        new[1:] = both[order][1:] != both[order][:-1]
        out.append(np.empty(len(at), np.int64))
        out[-1][order] = np.cumsum(new)
        length *= 2
    return out


def common_prefix(levels: list[np.ndarray], end: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Symbols that the suffixes i and j begin with alike."""
    i, j, start = i.copy(), j.copy(), i
    for k in reversed(range(len(levels))):
        live = np.flatnonzero((i < end[start]) & (j < end[j - (i - start)]))
        same = live[levels[k][i[live]] == levels[k][j[live]]]
        step = np.minimum(1 << k, end[i[same]] - i[same])
        i[same] += step
        j[same] += step
    return i - start


def shared_spans(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(longest span of words that both have; share of the words of each inside common spans of GRAM words or more, merged) of aligned pairs of texts.
    Words are told apart by pair, so that the neighbours of a suffix in the suffix array of all texts are of its own pair."""
    (ha, oa), (hb, ob) = W.words(a), W.words(b)
    na, nb = np.diff(oa), np.diff(ob)
    span, covers = np.zeros(len(na), np.int64), np.zeros((2, len(na)))
    text = np.concatenate([2 * np.repeat(np.arange(len(na)), na), 2 * np.repeat(np.arange(len(nb)), nb) + 1])
    if not len(text):
        return span, *covers
    order = np.argsort(text, kind="stable")
    text, h = text[order], np.concatenate([ha, hb])[order]
    pair, side, n = text // 2, text % 2, len(text)
    end = np.searchsorted(text, text, "right")
    levels = ranks(W.mix(h + W.mix(pair.astype(U64))), end)
    array = np.argsort(2 * levels[-1] + side)
    common, at = np.zeros(n, np.int64), np.arange(n)
    for way in (1, -1):  # the nearest suffix of the other side before, and after, in the array
        sa = array[::way]
        last = [np.maximum.accumulate(np.where(side[sa] == s, at, -1)) for s in (0, 1)]
        near = np.where(side[sa] == 0, last[1], last[0])
        i, j = sa[near >= 0], sa[near[near >= 0]]
        i, j = i[pair[i] == pair[j]], j[pair[i] == pair[j]]
        common[i] = np.maximum(common[i], common_prefix(levels, end, i, j))
    np.maximum.at(span, pair, common)
    edge = np.zeros(n + 1, np.int64)
    start = np.flatnonzero(common >= GRAM)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + common[start], -1)
    words = np.bincount(text[np.cumsum(edge)[:-1] > 0], minlength=2 * len(na)).reshape(-1, 2)
    return span, words[:, 0] / np.maximum(1, na), words[:, 1] / np.maximum(1, nb)


def _overlapping(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, links): the last deliveries of the records of a split, and the pairs of classes that are similar, a class being similar to itself."""
    flag = F.when(F.col("split") == "train", TRAIN).when(F.col("split").isin("val", "test"), EVAL).otherwise(NONE)
    base = rows.select(
        F.lower("text").alias("text"), F.col("tab").cast("int").alias("tab"), F.col("id").cast("long").alias("id"),
        flag.cast("int").alias("side"), F.col("split").cast("string").alias("split"), F.col("source").cast("string").alias("source"), F.col("at").cast("timestamp").alias("at"),
    )
    links = similar_classes(base.where("text is not null and side > 0").select("text", "tab", "side"))
    kind = F.when(F.col("split") == "train", TRAIN).when(F.col("split").isin("val", "test"), EVAL).otherwise(NONE)
    members = cut(P.memberships(base).withColumn("side", kind).where("side > 0"))
    return members, links


def split_overlaps(rows: DataFrame) -> DataFrame:
    """All pairs of records of one table, one in the train split and one in val or test, of word-set similarity >= 0.6.

    ``rows``: tab int, id long, split string, source string, at timestamp, text string; more columns are ignored.
    Result: tab, id_a, id_b (id_a < id_b), similarity, span (longest run of words that both have), cover_a, cover_b (share of the words of each
    inside shared runs), eval_id, eval_split, eval_source, train_source.

    Records delivered again under one (tab, id) count once, as last delivered. Null or empty texts, texts without
    a word, and records of no or another split give no pair; an empty table gives no rows; records with the same set
    of words have similarity 1. Texts of any length are compared as wholes.
    """
    members, links = _overlapping(rows)
    side = lambda s, rid: members.where(F.col("side") == s).select("tab", *(F.col(x).alias(f"{x}_{s}") for x in ("id", "split", "source")), F.col("rid").alias(rid))
    train, held = side(TRAIN, "a"), side(EVAL, "b").drop("tab")
    turned = links.select(F.col("b").alias("a"), F.col("a").alias("b"), "inter", "total", "span", F.col("cover_b").alias("cover_a"), F.col("cover_a").alias("cover_b"))
    # a pair of classes links the train records of either with the evaluation records of the other
    near = train.join(links.unionByName(turned), "a").join(held, "b")
    same = train.join(held, F.col("a") == F.col("b")).withColumns({"inter": F.lit(1), "total": F.lit(1), "span": F.lit(None).cast("long"), "cover_a": F.lit(1.0), "cover_b": F.lit(1.0)})
    columns = ["tab", "id_1", "id_2", "split_2", "source_1", "source_2", "inter", "total", "span", "cover_a", "cover_b"]
    both = near.select(*columns).unionByName(same.select(*columns))
    swap = F.col("id_1") > F.col("id_2")
    return both.select(
        "tab",
        F.least("id_1", "id_2").alias("id_a"),
        F.greatest("id_1", "id_2").alias("id_b"),
        (F.col("inter") / F.col("total")).alias("similarity"),
        "span",
        F.when(swap, F.col("cover_b")).otherwise(F.col("cover_a")).alias("cover_a"),
        F.when(swap, F.col("cover_a")).otherwise(F.col("cover_b")).alias("cover_b"),
        F.col("id_2").alias("eval_id"), F.col("split_2").alias("eval_split"), F.col("source_2").alias("eval_source"), F.col("source_1").alias("train_source"),
    )


def overlap_report(rows: DataFrame) -> DataFrame:
    """(tab, split, source, records, overlapping, exact): of every evaluation split and source the records with words, those that a train
    record of the table is similar to, and those whose set of words a train record has. ``rows`` as for ``split_overlaps``; a null source is
    a source of its own. Records are looked up by class: no pair of records is made."""
    members, links = _overlapping(rows)
    trained = cut(members.where(F.col("side") == TRAIN).select("rid").distinct())
    near = links.select(F.col("a").alias("rid"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("rid"), F.col("a").alias("other")))
    near = near.join(trained.withColumnRenamed("rid", "other"), "other", "left_semi").select("rid")
    hit = trained.withColumn("exact", F.lit(1)).unionByName(near.withColumn("exact", F.lit(0))).groupBy("rid").agg(F.max("exact").alias("exact"))
    held = members.where(F.col("side") == EVAL).join(hit, "rid", "left")
    return held.groupBy("tab", "split", "source").agg(F.count("*").alias("records"), F.count("exact").alias("overlapping"), F.coalesce(F.sum("exact"), F.lit(0)).alias("exact"))
