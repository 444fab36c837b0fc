import random
from collections import Counter

import numpy as np
import pytest

from driftfield.llm import neardup


def classes(rows, similarity=0.8):
    """Brute force: components over all pairs of multisets."""
    def shingles(t):
        words = (t or "").encode().split()
        return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()

    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sets:
        for j in sets:
            if i >= j:
                continue
            both = (sets[i] & sets[j]).total()
            if both >= similarity * (sets[i].total() + sets[j].total() - both):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: root(i) for i in sets}


def family(n, seed, words=120, edits=6):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = [" ".join(base)]
    for _ in range(n - 1):
        copy = list(base)
        for _ in range(rng.randrange(1, edits)):
            copy[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("part", [neardup.PART, 700])
def test_matches_all_pairs(spark, part):
    texts = [t for s in range(12) for t in family(1 + 5 * (s % 4), s)] + ["same words here again and again"] * 4
    chain = family(1, 99)[0].split()
    for step in range(6):  # each like the one before, the ends unlike
        chain = chain[:]
        chain[step * 19 : step * 19 + 2] = ["c%d" % step, "d%d" % step]
        texts.append(" ".join(chain))
    rows = list(enumerate(texts))
    random.Random(3).shuffle(rows)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), part=part).collect()}
    assert got == classes(rows)


def test_corpus(corpus):
    rows = [(r.doc_id, r.text) for r in corpus.select("doc_id", "text").collect()]
    assert {r.doc_id: r.class_id for r in neardup.near_duplicates(corpus).collect()} == classes(rows)


def test_odd_rows(odd, none):
    got = sorted((str(r.doc_id), r.class_id) for r in neardup.near_duplicates(odd).collect())
    assert got == sorted([("1", 1), ("2", 1), ("3", 3), ("4", 3), ("5", 3), ("6", 6), ("7", 7), ("8", 8), ("9", 9), ("None", None), ("10", 10), ("10", 10), ("12", 12)])
    assert neardup.near_duplicates(none).collect() == []


def test_unlike_texts_of_one_id_and_rows_without_id(spark):
    a, b = family(1, 5)[0], family(1, 6)[0]
    rows = [(5, a), (5, b), (6, b + " more"), (None, a), (None, "x " + a), (7, a), (None, "some other words that stand alone here"), (None, "some other words that stand alone here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup.classify(df).collect()
    by = {}
    for r in got:
        by.setdefault(r.class_text, []).append((r.doc_id, r.class_id))
    assert sorted(map(sorted_ids, by.values())) == sorted(map(sorted_ids, [[(5, 5), (None, 5), (None, 5), (7, 5)], [(5, 5), (6, 5)], [(None, None), (None, None)]]))
    kept = neardup.keep_one(df.withColumn("_row", df.doc_id).withColumn("rep", df.text)).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted([("5", a), ("5", b), ("None", rows[-1][1])])
    assert kept[0].asDict().keys() == {"doc_id", "text", "_row", "rep"}


def sorted_ids(rows):
    return sorted(map(str, rows))


def test_hot_texts_are_dealt(spark):
    words = family(1, 3)[0]
    rows = [(i, words) for i in range(700)] + [(1000 + i, f"{i} " + family(1, 50 + i)[0]) for i in range(300)]
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == {i: 0 if i < 700 else i for i, _ in rows}


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    for draw in (lambda: rng.integers(1, 5, 80), lambda: rng.integers(1, 300, 80), lambda: rng.random(80) * 3):
        hits = []
        for _ in range(150):
            key = np.sort(rng.integers(0, 2**63, 80).astype(np.uint64))
            w1, w2 = draw(), draw()
            same = neardup.signature(key, w1) == neardup.signature(key, w2)
            hits.append(same.mean() - np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum())
        assert abs(np.mean(hits)) < 4 * 0.05 / len(hits) ** 0.5


def test_tiny_sets_fill_all_coordinates():
    assert len(neardup.signature(np.array([5], np.uint64), np.array([1]))) == neardup.COORDINATES
    assert len(neardup.signature(np.array([5], np.uint64), np.array([10**6]))) == neardup.COORDINATES


@pytest.mark.parametrize("seed", range(4))
def test_group_links_join_what_all_pairs_join(seed):
    rng = np.random.default_rng(seed)
    common = np.arange(60)
    sets = []
    for g in range(12):  # members share a passage; only those of a family are similar
        own = 1000 * (g + 1) + np.arange(60)
        for _ in range(rng.integers(1, 6)):
            k = np.sort(np.concatenate((common, own)))
            k = np.setdiff1d(k, rng.choice(k, rng.integers(0, 12), replace=False))
            sets.append((k, rng.integers(1, 3, len(k)).astype(np.int32) if g % 2 else np.ones(len(k), np.int32)))
    want = list(range(len(sets)))
    for i, (a, v) in enumerate(sets):
        for j in range(i):
            b, w = sets[j]
            x, y = Counter(dict(zip(a.tolist(), v.tolist()))), Counter(dict(zip(b.tolist(), w.tolist())))
            if (x & y).total() >= 0.8 * (x | y).total():
                low, high = sorted((want[i], want[j]))
                want = [low if c == high else c for c in want]
    got = list(range(len(sets)))
    for i, j in neardup.group_links(sets, np.arange(len(sets)), 0.8):
        low, high = sorted((got[i], got[j]))
        got = [low if c == high else c for c in got]
    assert got == want
