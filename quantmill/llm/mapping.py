"""Problem 2: freely typed values mapped to the closest entry of a reference list.

Method: a prefix-filter set-similarity join. A value becomes the set of its letters and letter pairs, each labelled by occurrence, word by word,
so that neither the order of words nor one wrong letter changes much of it. Tokens are put in one global order, rarest first;
two sets of Jaccard similarity t share SHARED tokens among the first |x| - ceil(t |x|) + SHARED of each, so only those that have two such tokens in
common are joined: letters and pairs of letters are few, but two rare ones together are rare also among millions of names. Length and
positional filters thin the candidates, the exact Jaccard similarity is computed for the rest, and the best is kept. Every distinct
spelling is matched once.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Least similarity, as a fraction: well between what one slip leaves (0.62) and what unrelated entries reach (0.41).
SIM_NUM, SIM_DEN = 11, 20
#: Prefix tokens that must agree. A word has three tokens at least, so any two similar sets share two.
SHARED = 2
#: Tokens whose frequency goes to every task, the most frequent ones; all others are rarer and rank first.
RANKED_TOKENS = 50_000
#: Reference forms up to which the reference side is broadcast.
BROADCAST_FORMS = 20_000
_NOT_TEXT = re.compile(r"[^\w%$€£₹¥‰°µ'/]+|_")
#: Words that may stand before an entry without a meaning.
LEAD_WORDS = frozenset({"re", "the", "in"})


def normal_form(value: str, drop: frozenset[str] = frozenset(), lead: frozenset[str] = LEAD_WORDS) -> str:
    """Lower case without accents, marks, doubled blanks and one of the words of ``lead`` before others; without the words of ``drop`` (scales) and an ``of``
    beside them."""
    s = "".join(c for c in unicodedata.normalize("NFD", value.lower()) if not unicodedata.combining(c))
    w = _NOT_TEXT.sub(" ", s).replace("/", " ").split()
    if len(w) > 1 and w[0] in lead:
        w = w[1:]
    kept = [x for x in w if x not in drop]
    if len(kept) < len(w):
        kept = [x for x in kept if x != "of"]
    return " ".join(kept)


def tokens(s: str) -> list[str]:
    """Letters and letter pairs (with the edges of words), each with its number of occurrence."""
    seen: Counter[str] = Counter()
    out = []
    for w in s.split():
        p = f"_{w}_"
        for g in [*(p[i : i + 2] for i in range(len(p) - 1)), *w]:
            out.append(f"{g}{seen[g]}")
            seen[g] += 1
    return out


def _least_overlap(n1: Column, n2: Column) -> Column:
    """ceil(t / (1 + t) * (n1 + n2)) in integers."""
    return F.ceil((n1 + n2) * F.lit(SIM_NUM) / F.lit(SIM_NUM + SIM_DEN))


def match(values: DataFrame, reference: DataFrame, drop: dict[str, frozenset[str]]) -> DataFrame:
    """(kind, value, ref_name, similarity): the best reference entry of every value that reaches the least similarity.

    ``values`` (kind, value) are distinct spellings; ``reference`` (kind, form, ref_name) the forms of each entry; ``drop`` words to leave
    out by kind. Of equally similar forms the one at the smaller edit distance is kept, then the first by name. Values and forms that are
    null or have no letter match nothing; repeated rows change nothing.
    """
    spark = values.sparkSession
    tokenised = _tokenised(values.withColumn("ref_name", F.lit(None).cast("string")), drop)
    forms = _tokenised(reference.select("kind", F.col("form").alias("value"), "ref_name"), {k: frozenset() for k in drop})
    counts = (
        tokenised.select(F.explode("tokens").alias("t")).unionAll(forms.select(F.explode("tokens"))).groupBy("t").agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "t").limit(RANKED_TOKENS).collect()
    )
    rank = spark.sparkContext.broadcast({r.t: r.n for r in counts})
    # no longer value can be similar to any form
    longest = forms.agg(F.max(F.size("tokens"))).first()[0] or 0
    usable = tokenised.where(F.size("tokens") * SIM_NUM <= longest * SIM_DEN)
    x = _prefixes(usable, rank).select("kind", "value", "norm", "tokens", F.explode(_keys()).alias("k")).select("kind", "value", "norm", "tokens", "k.key", F.col("k.last").alias("i"))
    y = _prefixes(forms, rank).select(
        "kind", F.col("value").alias("form"), F.col("norm").alias("form_norm"), F.col("ref_name").alias("name"), F.col("tokens").alias("form_tokens"), F.explode(_keys()).alias("k")
    ).select("kind", "form", "form_norm", "name", "form_tokens", "k.key", F.col("k.last").alias("j"))
    if reference.count() <= BROADCAST_FORMS:
        y = F.broadcast(y)
    n1, n2 = F.size("tokens"), F.size("form_tokens")
    # of the first two tokens that both have, the later one is at i and j: no more can follow than the shorter rest
    most = SHARED - 1 + F.least(n1 - F.col("i"), n2 - F.col("j"))
    met = (
        x.join(y, ["kind", "key"])
        .where((n1 * SIM_DEN >= n2 * SIM_NUM) & (n2 * SIM_DEN >= n1 * SIM_NUM))
        .where(most >= _least_overlap(n1, n2))
        .dropDuplicates(["kind", "value", "form", "name"])
    )
    shared = F.size(F.array_intersect("tokens", "form_tokens"))
    exact = met.withColumn("inter", shared).withColumn("total", n1 + n2 - F.col("inter")).where(F.col("inter") * SIM_DEN >= F.col("total") * SIM_NUM)
    order = F.struct((-F.col("inter") / F.col("total")).alias("s"), F.levenshtein("norm", "form_norm").alias("d"), F.col("name").alias("name"))
    best = exact.groupBy("kind", "value").agg(F.min(order).alias("b"))
    return best.select("kind", "value", F.col("b.name").alias("ref_name"), (-F.col("b.s")).alias("similarity"))


def _keys() -> Column:
    """(key, last) of every two tokens of the prefix: a hash of both, and the place of the later one."""
    prefix = F.col("prefix")
    later = lambda t, i: F.transform(F.slice(prefix, i + 2, F.size(prefix)), lambda u, j: F.struct(F.xxhash64(t, u).alias("key"), (i + 1 + j).alias("last")))
    return F.flatten(F.transform(prefix, later))


def _tokenised(df: DataFrame, drop: dict[str, frozenset[str]]) -> DataFrame:
    """(kind, value, ref_name, norm, tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            norm = [normal_form(v, drop.get(k, frozenset())) if v is not None else "" for k, v in zip(b.column("kind").to_pylist(), b.column("value").to_pylist())]
            yield pa.record_batch(
                [b.column("kind"), b.column("value"), b.column("ref_name"), pa.array(norm, pa.string()), pa.array([tokens(s) for s in norm], pa.list_(pa.string()))],
                ["kind", "value", "ref_name", "norm", "tokens"],
            )

    return df.select("kind", "value", "ref_name").mapInArrow(run, "kind string, value string, ref_name string, norm string, tokens array<string>")


def _prefixes(df: DataFrame, rank) -> DataFrame:
    """Adds ``prefix``: the rarest tokens of each set, as many as the similarity asks for, in the global order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = rank.value
        for b in batches:
            prefix = []
            for t in b.column("tokens").to_pylist():
                k = len(t) - (-(-len(t) * SIM_NUM // SIM_DEN)) + SHARED if t else 0
                prefix.append(sorted(t, key=lambda g: (n.get(g, 0), g))[:k])
            yield pa.record_batch([*b.columns, pa.array(prefix, pa.list_(pa.string()))], [*b.schema.names, "prefix"])

    return df.mapInArrow(run, "kind string, value string, ref_name string, norm string, tokens array<string>, prefix array<string>")


def map_entries(rows: DataFrame, reference: DataFrame, exact: DataFrame, drop: dict[str, frozenset[str]]) -> DataFrame:
    """``rows`` (kind, value, and more columns) whose value is not letter for letter in ``exact`` (kind, value), with ``ref_name`` and
    ``similarity``; ``none`` and null for values that no entry is close to.

    Rows with a null, empty or blank value or ``-`` are left out. A spelling that makes up a large share of the rows is matched once.
    """
    kept = rows.where("value is not null and trim(value) not in ('', '-')").join(F.broadcast(exact) if exact.count() <= BROADCAST_FORMS else exact, ["kind", "value"], "left_anti")
    found = match(kept.select("kind", "value").distinct(), reference, drop)
    return kept.join(found, ["kind", "value"], "left").withColumn("ref_name", F.coalesce("ref_name", F.lit("none")))
