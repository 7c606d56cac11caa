import datetime as dt
import random

import numpy as np
import pyarrow as pa
import pytest

from conftest import SMALL
from llm import brute
from quantmill.llm import neardup, overlap, pairs as P, words as W
from quantmill.llm.queries import p3_found, p4_found

T0 = dt.datetime(2030, 1, 1)
SCHEMA = "tab int, id long, split string, source string, at timestamp, text string, group_id string, rid string, a string"


def rows(spark, data):
    """(id, split, text[, hours]) with extra columns whose names clash with those used inside."""
    full = [(0, r[0], r[1], f"s{r[0] % 3}", T0 + dt.timedelta(hours=r[3] if len(r) > 3 else 0), r[2], "x", "y", "z") for r in data]
    return spark.createDataFrame(full, SCHEMA)


def edited(rng, words, share):
    out = list(words)
    for _ in range(int(len(out) * share)):
        k, i = rng.randrange(4), rng.randrange(len(out))
        if k == 0:
            out[i] = f"w{rng.randrange(10**6)}"
        elif k == 1:
            del out[i]
        elif k == 2:
            out.insert(i, f"w{rng.randrange(10**6)}")
        else:
            j = rng.randrange(len(out))
            out[i], out[j] = out[j], out[i]
    return out


def corpus(seed, n=40):
    rng = random.Random(seed)
    out = []
    for g in range(n):
        base = [f"v{rng.randrange(300)}" for _ in range(rng.randrange(20, 50))]
        for _ in range(rng.randrange(1, 4)):
            out.append((len(out), rng.choice(["train", "val", "test", None]), " ".join(edited(rng, base, rng.choice([0, 0.1, 0.2])))))
    return out


def test_words_match_the_definition():
    texts = ["Hello, World 42", "", None, "été naïve x1", "a" * 3000, "ab cd ab", "x-y_z", "K 1"]
    lower = [t.lower() if t is not None else None for t in texts]
    h, o = W.words(pa.array(lower, pa.string()))
    want = [brute.words(t) for t in texts]
    assert np.diff(o).tolist() == [len(w) for w in want]
    flat = [x for w in want for x in w]
    by_word = {}
    for word, value in zip(flat, h.tolist()):
        assert by_word.setdefault(word, value) == value
    assert len(set(by_word.values())) == len(by_word)


def test_words_in_chunks(monkeypatch):
    monkeypatch.setattr(W, "CHUNK_BYTES", 16)
    texts = pa.array(["one two three", "four", "", "five six seven eight nine ten", "eleven"])
    h, o = W.words(texts)
    monkeypatch.setattr(W, "CHUNK_BYTES", 1 << 20)
    h2, o2 = W.words(texts)
    assert (h == h2).all() and (o == o2).all()


def test_pack_round_trip():
    rng = np.random.default_rng(1)
    rid = rng.integers(0, 300, 1000).astype("<u8") * np.uint64(0x9E3779B97F4A7C15)
    e = {"key": rng.integers(0, 2**64, 1000, dtype="<u8"), "rid": rid, "s1": rid * np.uint64(3), "s2": ~rid, "n": (rid % np.uint64(90)).astype("<u4"), "tag": rng.integers(0, 8, 1000, dtype="<u8")}
    order = np.argsort(e["key"], kind="stable")
    back = P.unpack(P.pack(e))
    assert all((back[f] == e[f][order]).all() for f in e)
    empty = P.unpack(P.pack({f: x[:0] for f, x in e.items()}))
    assert all(len(x) == 0 for x in empty.values())


def test_filters_keep_all_similar_pairs():
    rng = random.Random(3)
    texts = [t for _, _, t in corpus(3)]
    c = P.Classes(pa.array(texts))
    s1, s2 = c.parities
    for _ in range(3000):
        i, j = rng.randrange(len(texts)), rng.randrange(len(texts))
        if brute.similar(texts[i], texts[j]):
            for d in (np.bitwise_count((s1 ^ s2)[i] ^ (s1 ^ s2)[j]), np.bitwise_count(s1[i] ^ s1[j]) + np.bitwise_count(s2[i] ^ s2[j])):
                assert P._may_reach(c.n[[i]], c.n[[j]], np.array([int(d)]))[0]


@pytest.mark.parametrize("seed", [1, 2])
def test_overlaps_equal_brute_force(spark, seed):
    data = corpus(seed)
    got = {(r.id_a, r.id_b) for r in overlap.split_overlaps(rows(spark, data)).collect()}
    side = lambda s: 1 if s == "train" else 2 if s in ("val", "test") else 0
    want = {(a[0], b[0]) for k, a in enumerate(data) for b in data[k + 1 :] if side(a[1]) + side(b[1]) == 3 and side(a[1]) * side(b[1]) and brute.similar(a[2], b[2])}
    assert got == want


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_equal_brute_force(spark, seed):
    data = corpus(seed)
    got = {(r.id_a, r.id_b) for r in neardup.group_pairs(neardup.near_duplicate_groups(rows(spark, data))).collect()}
    assert got == brute.groups({i: t for i, _, t in data})


EDGE = [
    (1, "train", None), (2, "val", ""), (3, "val", "!!! ???"), (4, "train", "one"), (5, "val", "ONE!"), (6, "test", "two words"), (7, "train", "two words here"),
    (8, None, "two words"), (9, "other", "two words"), (10, "train", "w " * 30), (11, "val", "w"), (12, "train", "a b c d e f g h"), (13, "test", "h g f e d c b a"),
    (14, "train", "old text that is replaced later by another", 0), (14, "train", "fresh delivery of another kind of text altogether", 5), (15, "test", "old text that is replaced later by another"),
    (16, "test", "fresh delivery of another kind of text altogether"),
]


def test_overlap_edges(spark):
    got = {(r.id_a, r.id_b) for r in overlap.split_overlaps(rows(spark, EDGE)).collect()}
    assert got == {(4, 5), (6, 7), (10, 11), (12, 13), (14, 16)}


def test_group_edges(spark):
    out = neardup.near_duplicate_groups(rows(spark, EDGE))
    assert {r.id for r in out.collect()} == {4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16}
    got = {(r.id_a, r.id_b) for r in neardup.group_pairs(out).collect()}
    assert {(4, 5), (6, 8), (8, 9), (10, 11), (12, 13), (14, 16)} <= got
    assert not {p for p in got if 15 in p}


def test_empty_tables(spark):
    none = rows(spark, EDGE).where("false")
    assert overlap.split_overlaps(none).count() == 0
    assert neardup.near_duplicate_groups(none).count() == 0


def test_long_texts_and_many_copies(spark):
    rng = random.Random(5)
    long = [f"v{rng.randrange(5000)}" for _ in range(60_000)]
    data = [(1, "train", " ".join(long)), (2, "test", " ".join(edited(rng, long, 0.001)))]
    copies = "the same sentence delivered under very many different ids of the table"
    data += [(100 + i, "train" if i % 2 else "val", copies) for i in range(60)]
    got = {(r.id_a, r.id_b) for r in overlap.split_overlaps(rows(spark, data)).collect()}
    assert (1, 2) in got and len(got) == 1 + 30 * 30
    out = neardup.near_duplicate_groups(rows(spark, data))
    assert out.select("group_id").distinct().count() == 2


def test_banded_alignment():
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            prev = 0
            for j, y in enumerate(b):
                prev, row[j + 1] = row[j + 1], prev + 1 if x == y else max(row[j + 1], row[j])
        return row[-1]

    rng = random.Random(2)
    left, right = [], []
    for _ in range(50):
        base = [rng.choice("abcdefgh") for _ in range(rng.randrange(0, 8))]
        left.append(" ".join(base))
        right.append(" ".join(edited(rng, base, 0.4)) if base else "")
    got = neardup.banded_shared(pa.array(left), pa.array(right), band=12)
    assert got.tolist() == [lcs(brute.words(a), brute.words(b)) for a, b in zip(left, right)]


def test_found_queries_on_the_small_tables(spark):
    c = spark.read.parquet(f"{SMALL}/collection.parquet").select("doc_id", "ingested_at", "sentence", "split").collect()
    q = spark.read.parquet(f"{SMALL}/queries.parquet").select("qid", "created_at", "query_text", "split").collect()
    texts = {i: r for i, r in brute.last([tuple(r) for r in c]).items()}
    want4 = brute.groups({i: r[2] for i, r in texts.items()})
    assert {(r.doc_id_a, r.doc_id_b) for r in p4_found(spark, SMALL).collect()} == want4
    want3 = set()
    for tab, rs in (("collection", list(texts.values())), ("queries", [tuple(r) for r in q])):
        train = [r for r in rs if r[3] == "train"]
        want3 |= {(tab, min(a[0], b[0]), max(a[0], b[0])) for a in rs if a[3] in ("val", "test") for b in train if brute.similar(a[2], b[2])}
    assert {tuple(r) for r in p3_found(spark, SMALL).select("tab", "id_a", "id_b").collect()} == want3


def test_large_group_of_edited_texts(spark):
    """All words of a large group are frequent but the one that each member has changed."""
    rng = random.Random(4)
    base = [f"v{i}" for i in range(20)]
    data = []
    for i in range(1000):
        words = list(base)
        words[rng.randrange(20)] = f"e{i}"
        data.append((i, None, " ".join(words)))
    data += [(1000 + i, None, " ".join(f"o{rng.randrange(10**6)}" for _ in range(20))) for i in range(500)]
    out = neardup.near_duplicate_groups(rows(spark, data))
    assert out.where("id < 1000").select("group_id").distinct().count() == 1
    assert out.select("group_id").distinct().count() == 501


def similar_pairs(c, texts):
    rid = c.rid.view(np.int64)
    return {(min(rid[i], rid[j]), max(rid[i], rid[j])) for i in range(len(texts)) for j in range(i) if rid[i] != rid[j] and brute.similar(texts[i], texts[j])}


def pairs_of(parts, *args):
    t = P.bucket_pairs(parts, *args)
    return {(a, b) for a, b in zip(t.column("a").to_pylist(), t.column("b").to_pylist()) if b is not None}


def counted(c):
    return np.bincount(P.slots(c.set_hashes), minlength=1 << P.COUNT_BITS)


@pytest.mark.parametrize("seed", [5, 6])
def test_suffixes_meet_all_similar_pairs(monkeypatch, seed):
    """Short and long runs, with counts and without, all pairs and those of two sides, whole keys and cells."""
    texts = [t for _, _, t in corpus(seed, 60)] + ["a b c d e", "a b c d", "a b c", "a b", "a", "a b c x y"]
    plain = P.Classes(pa.array(texts))
    rng = random.Random(seed)
    side = np.array([rng.choice([1, 2]) for _ in texts])
    sided = P.Classes(pa.array(texts), side=side)
    want = similar_pairs(plain, texts)
    of = {int(r): set() for r in plain.rid.view(np.int64)}
    for r, s in zip(plain.rid.view(np.int64), side):
        of[int(r)].add(int(s))
    cross = {(a, b) for a, b in want if any(x != y for x in of[a] for y in of[b])}
    monkeypatch.setattr(P, "ROWS", 3)
    monkeypatch.setattr(P, "COLUMNS", 5)
    for long, block, counts in ((64, 1 << 17, np.zeros(1 << P.COUNT_BITS, np.int64)), (64, 1 << 17, counted(plain)), (2, 1 << 17, counted(plain)), (2, 3, counted(plain)), (2, 1, counted(plain))):
        monkeypatch.setattr(P, "LONG", long)
        monkeypatch.setattr(P, "BLOCK", block)
        assert want <= pairs_of([overlap.suffix_entries(plain, plain.first_of_each(), counts)])
        got = pairs_of([overlap.suffix_entries(sided, sided.first_of_each(), counts)], True)
        assert cross <= got and all(any(x != y for x in of[a] for y in of[b]) for a, b in got)


def test_cells_bound_the_classes_of_a_key(monkeypatch):
    """A key of many texts is spread: every two classes meet in a cell, and no cell has more than about two blocks."""
    monkeypatch.setattr(P, "BLOCK", 50)
    c = P.Classes(pa.array([f"same x{i}" for i in range(500)]))
    at = np.arange(500)
    e = c.entries(np.full(500, 7, np.uint64), at, np.ones(500, np.uint64), np.full(500, 500))
    keys, size = np.unique(e["key"], return_counts=True)
    assert len(keys) == 45 and size.max() < 150
    met = set()
    for k in keys:
        r = sorted(e["rid"][e["key"] == k].tolist())
        met |= {(x, y) for i, x in enumerate(r) for y in r[i + 1 :]}
    assert len(met) == 500 * 499 // 2


def test_template_with_short_runs(spark):
    """Records of one frequent template that share one run of six words, whose spans are all frequent."""
    data = []
    for i in range(600):
        words = [f"x{i}y{k}" if k in (3, 10, 14) else f"t1w{k}" for k in range(18)]
        data.append((i, "val" if i % 20 == 0 else "train", " ".join(words)))
    assert brute.similar(data[0][2], data[1][2])
    assert overlap.split_overlaps(rows(spark, data)).count() == 30 * 570


def test_pairs_without_a_shared_span(spark):
    """The same words in another order, of all lengths, without a third record."""
    rng = random.Random(11)
    data = []
    for g in range(60):
        words = [f"g{g}w{k}" for k in range(16 + g)]
        other = words[: len(words) * 4 // 5] + [f"h{g}w{k}" for k in range(len(words) // 10)]
        rng.shuffle(other)
        data += [(2 * g, "train", " ".join(words)), (2 * g + 1, "test", " ".join(other))]
    got = {(r.id_a, r.id_b) for r in overlap.split_overlaps(rows(spark, data)).collect()}
    assert got == {(2 * g, 2 * g + 1) for g in range(60)}


def template(n, seed=1):
    """Records of 30 words, 25 of which all have; every word of the template is frequent, and no record shares its own five."""
    rng = random.Random(seed)
    own = rng.sample(range(30), 5)
    return [(i, "train" if i % 2 else "val", " ".join(f"e{i}x{k}" if k in own else f"v{k}" for k in range(30))) for i in range(n)]


def others(n, first, seed=2):
    rng = random.Random(seed)
    return [(first + i, "train" if i % 2 else "test", " ".join(f"o{rng.randrange(20000)}" for _ in range(30))) for i in range(n)]


@pytest.mark.parametrize("size,rest", [(90, 0), (120, 0), (400, 0), (250, 20000), (2000, 10000)])
def test_template_groups_of_all_sizes(spark, size, rest):
    data = rows(spark, template(size) + others(rest, size))
    out = neardup.near_duplicate_groups(data)
    assert out.where(f"id < {size}").select("group_id").distinct().count() == 1
    assert out.where("aligned > 0").count() == size
    if size <= 400:
        assert overlap.split_overlaps(data).where(f"id_a < {size}").count() == (size // 2) ** 2


def test_alignment_decides(monkeypatch):
    """Small edits are proved by the alignment alone; words moved far are left to the sets of words; other texts are neither."""
    base = [f"v{i}" for i in range(30)]
    moved = base[15:] + base[:15]
    texts = [" ".join(x) for x in (base[:12] + ["new"] + base[13:], moved, [f"o{i}" for i in range(30)])]
    reached, proved, edit = neardup.verified(pa.array([" ".join(base)] * 3), pa.array(texts))
    assert reached.tolist() == [True, True, False] and proved.tolist() == [True, False, False] and edit[0] > 0.9
    monkeypatch.setattr(neardup, "banded_shared", lambda a, b: np.zeros(len(a), np.int64))
    assert not neardup.verified(pa.array([" ".join(base)]), pa.array(texts[:1]))[1].any()


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_alignment_never_proves_too_much(seed):
    rng = random.Random(seed)
    left = [" ".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 14))) for _ in range(400)]
    right = [" ".join(edited(rng, t.split(), 0.4)) or "z" for t in left]
    reached, proved, _ = neardup.verified(pa.array(left), pa.array(right))
    assert reached.tolist() == [brute.similar(a, b) for a, b in zip(left, right)]
    assert proved.any() and not (proved & ~reached).any()


def test_open_runs_are_closed(spark, monkeypatch):
    """Runs in which only one partner is linked at first: the rest is found among classes of different groups."""
    monkeypatch.setattr(P, "LONG", 4)
    monkeypatch.setattr(neardup, "PARTNERS", 1)
    data = template(60, 3) + corpus(4, 30)
    data = [(i, s, t) for i, (_, s, t) in enumerate(data)]
    got = {(r.id_a, r.id_b) for r in neardup.group_pairs(neardup.near_duplicate_groups(rows(spark, data))).collect()}
    assert got == brute.groups({i: t for i, _, t in data})


def test_sketches_alone_find_nearly_all_links():
    texts = [t for _, _, t in corpus(8, 300)]
    c = P.Classes(pa.array(texts))
    want = similar_pairs(c, texts)
    got = pairs_of([neardup.sketch_entries(c, c.first_of_each(), counted(c), len(texts))])
    assert len(want & got) >= 0.995 * len(want)


def spans(a, b, least):
    """(longest common span, covered words of a) by brute force."""
    a, b = a.split(), b.split()
    covered, longest = set(), 0
    for i in range(len(a)):
        for j in range(len(b)):
            k = 0
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                k += 1
            longest = max(longest, k)
            if k >= least:
                covered |= set(range(i, i + k))
    return longest, len(covered) / max(1, len(a))


@pytest.mark.parametrize("seed", [1, 2])
def test_shared_spans_equal_brute_force(seed):
    rng = random.Random(seed)
    left = [" ".join(rng.choice("abcd") for _ in range(rng.randrange(0, 25))) for _ in range(120)]
    right = [" ".join(edited(rng, t.split(), 0.3)) if t else "" for t in left]
    span, ca, cb = overlap.shared_spans(pa.array(left), pa.array(right))
    for i, (a, b) in enumerate(zip(left, right)):
        assert (span[i], ca[i]) == pytest.approx(spans(a, b, overlap.GRAM)) and (span[i], cb[i]) == pytest.approx(spans(b, a, overlap.GRAM))


def test_report_per_split_and_source(spark):
    data = corpus(2) + [(900 + i, s, "one exact copy of a text of some words") for i, s in enumerate(["train", "val", "test", None])]
    df = rows(spark, data)
    side = {i: s for i, s, _ in data}
    pairs = overlap.split_overlaps(df).collect()
    assert {(r.eval_split, r.eval_source, r.train_source) for r in pairs} == {(side[r.eval_id], f"s{r.eval_id % 3}", f"s{(r.id_a + r.id_b - r.eval_id) % 3}") for r in pairs}
    got = {(r.split, r.source): (r.records, r.overlapping, r.exact) for r in overlap.overlap_report(df).collect()}
    want = {}
    trained = [set(brute.words(t)) for _, s, t in data if s == "train"]
    hit = {r.eval_id for r in pairs}
    for i, s, t in data:
        if s in ("val", "test"):
            n, o, e = want.get((s, f"s{i % 3}"), (0, 0, 0))
            want[s, f"s{i % 3}"] = (n + 1, o + (i in hit), e + (set(brute.words(t)) in trained))
    assert got == want
