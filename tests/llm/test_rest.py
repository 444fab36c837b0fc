import hashlib
import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from driftfield.llm import lm, packing, quality, sharding, warc

# ---- packing


@pytest.mark.parametrize("seed", range(6))
def test_boundaries_are_optimal(seed):
    rng = np.random.default_rng(seed)
    counts = {int(k): int(n) for k, n in zip(rng.choice(np.arange(1, 40), 9, replace=False), rng.integers(1, 20, 9))}

    def padding(ends):
        return sum(n * (min(e for e in ends if e >= k) - k) for k, n in counts.items())

    for buckets in (1, 2, 3, 9, 12):
        got = packing.boundaries(counts, buckets)
        best = min(padding((*c, max(counts))) for r in range(buckets) for c in itertools.combinations(sorted(counts)[:-1], r))
        assert padding(got) == best and len(got) <= buckets and got[-1] == max(counts)
    assert packing.boundaries({}, 3) == []


def test_packing_holds_every_token(odd, none, corpus):
    for df in (odd, corpus):
        rows = packing.pack(df, max_length=64, buckets=4, budget=256).collect()
        want = Counter({})
        for r in df.collect():
            want[r.doc_id] += len((r.text or "").encode().split()) + 1
        got = Counter()
        for r in rows:
            got[r.doc_id] += r.length
            assert 0 < r.length <= r.padded_to <= 64
        assert got == want
        batches = Counter((r.bucket, r.batch) for r in rows)
        size = {r.bucket: 256 // r.padded_to for r in rows}
        assert all(n <= size[b] for (b, _), n in batches.items())
        for b in size:  # all batches of a bucket but its last are full
            mine = sorted((k[1], n) for k, n in batches.items() if k[0] == b)
            assert [k for k, _ in mine] == list(range(len(mine))) and all(n == size[b] for _, n in mine[:-1])
        assert len({(r.bucket, r.batch, r.place) for r in rows}) == len(rows)
    assert packing.pack(none).collect() == []


# ---- sharding


def test_shards(odd, none, corpus):
    for df in (odd, corpus):
        rows = sharding.shard_documents(df).collect()
        text = {(r.doc_id, (r.text or "")) for r in df.collect()}
        assert len(rows) == df.count()
        assert {(r.doc_id, r.size, r.text_crc32) for r in rows} == {(i, len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in text}
        slots = {}
        for r in rows:
            slots.setdefault(r.shard, []).append(r.slot)
            assert r.law == "key" and 0 <= r.shard < 40 and r.grown_shard in (r.shard, 40)
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.shard_documents(none).collect() == []


@pytest.mark.parametrize("n", [3000, 70_000])
def test_equal_rows_have_slots_of_their_own(spark, n):
    df = spark.range(n).selectExpr("cast(null as long) as doc_id", "'same' as text").unionByName(spark.range(50).selectExpr("id as doc_id", "cast(id as string) as text"))
    slots = {}
    for r in sharding.shard_documents(df).select("shard", "slot").collect():
        slots.setdefault(r.shard, []).append(r.slot)
    assert sum(map(len, slots.values())) == n + 50 and all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_shards_are_even_and_growth_moves_its_share(spark):
    df = spark.range(40_000).selectExpr("id as doc_id", "cast(id as string) as text")
    rows = sharding.shard_documents(df).collect()
    n = Counter(r.shard for r in rows)
    assert len(n) == 40 and max(abs(v - 1000) for v in n.values()) < 6 * 1000**0.5
    assert abs(sum(r.grown_shard == 40 for r in rows) - 40_000 / 41) < 6 * 1000**0.5


def test_weights_move_rows_only_between_changed_subtrees(spark):
    def tree(w):
        leaf = lambda s, x: sharding.Node(f"s{s}", x, (), s)
        return sharding.Node("root", 0, tuple(sharding.Node(f"r{r}", 0, tuple(sharding.Node(f"r{r}k{k}", 0, tuple(leaf(4 * r + 2 * k + i, w.get(4 * r + 2 * k + i, 1.0)) for i in range(2))) for k in range(2))) for r in range(3)))

    df = spark.range(8000).selectExpr("id as doc_id")
    both = sharding.assign(sharding.assign(df, "doc_id", tree({}), "a"), "doc_id", tree({5: 3.0}), "b").collect()
    moved = [(r.a, r.b) for r in both if r.a != r.b]
    # rows enter the region whose weight grew, or move inside it into the grown rack or shard
    assert moved and all(b // 4 == 1 for _, b in moved) and all(b == 5 for a, b in moved if a // 2 == b // 2)
    share = Counter(r.b for r in both)
    assert abs(share[5] / 8000 - 3 / 14) < 0.03 and abs(share[0] / 8000 - 1 / 14) < 0.02


def test_further_shards_take_rows_only_into_themselves(spark):
    df = spark.range(3000).selectExpr("id as doc_id")
    for n in (41, 45, 57):
        both = sharding.assign(sharding.assign(df, "doc_id", sharding.layout(n), "a"), "doc_id", sharding.layout(n + 1), "b").collect()
        assert all(r.b in (r.a, n) for r in both) and any(r.b == n for r in both)


# ---- archives


def test_archive_round_trip(spark, tmp_path):
    long_page = "<p>" + "same payload " * 200 + "</p>"
    rows = [(1, "http://a/", long_page), (2, None, long_page), (9, "http://b/ x", long_page), (3, "", "short"), (4, "http://c/", "short"), (5, "u", None), (None, "v", "x" * 2000), (7, "é\n", "ü" * 600), (8, "w", "big" * 10**6), (9, "http://b/ x", long_page)]
    rows += [(100 + i, f"http://h/{i}", f"<html><body>{'common words of a page ' * 20}{i}</body></html>") for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.archive_and_read(df.withColumn("digest", df.page_id).withColumn("n", df.url)).collect()
    assert len(got) == len(rows)
    want = Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        revisit = h == long_page and i != 9
        want[(i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", 9 if revisit else None)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert warc.archive_and_read(df.where("false")).collect() == []
    path = f"file://{tmp_path}/archives"
    warc.write_archives(df.coalesce(1), path)
    assert warc.rename_archives(spark, path) == len(list((tmp_path / "archives").glob("*.warc.zst"))) > 0
    kinds = Counter()
    for f in (tmp_path / "archives").glob("*.warc.zst"):
        found = list(warc.read_archive(f.read_bytes()))
        assert found[0][0]["warc-type"] == "warcinfo"
        kinds.update(h["warc-type"] for h, _ in found)
    assert kinds["response"] + kinds["revisit"] == len(rows)


def test_common_payloads_are_dealt(spark):
    page = "<p>" + "the same page " * 100 + "</p>"
    df = spark.range(900).selectExpr("id as page_id", "cast(id as string) as url", f"if(id % 3 = 0, '{page}', repeat(cast(id as string), 500)) as html")
    got = warc.archive_and_read(df).collect()
    assert Counter((r.record_type, r.refers_to) for r in got) == {("revisit", 897): 299, ("response", None): 601}


def test_dictionary_stands_in_front():
    records = [warc.record(i, f"http://h/{i}", (f"<html>{'words of all pages ' * 30}{i}" + str(i * 7919)).encode(), 3, "d", None, None) for i in range(300)]
    data = warc.write_archive(records)
    assert data[:4] == bytes([0x5D, 0x2A, 0x4D, 0x18]) and int.from_bytes(data[4:8], "little") > 0
    assert len(data) < sum(map(len, records)) / 4


# ---- quality


def repeats_brute(words, least):
    n, covered, longest = len(words), set(), 0
    seen = Counter(tuple(words[i:j]) for i in range(n) for j in range(i + least, n + 1))
    for i in range(n):
        for j in range(i + least, n + 1):
            if seen[tuple(words[i:j])] > 1:
                covered.update(range(i, j))
                longest = max(longest, j - i)
    return len(covered), longest


@pytest.mark.parametrize("seed", range(30))
def test_repetition_matches_all_substrings(seed):
    rng = np.random.default_rng(seed)
    ids = rng.integers(0, rng.integers(1, 6), rng.integers(0, 45))
    start, length = quality.maximal_spans(ids, 3)
    got = quality.covered_words(len(ids), start, length), int(length.max()) if len(length) else 0
    assert got == repeats_brute(ids.tolist(), 3)
    windows = Counter(tuple(ids[i : i + 3]) for i in range(len(ids) - 2))
    hit = {k for i in range(len(ids) - 2) if windows[tuple(ids[i : i + 3])] > 1 for k in range(i, i + 3)}
    assert quality.words_in_repeated_windows(ids, 3) == len(hit)


def test_quality_counts(odd, none):
    import re

    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.quality_rules(odd).collect())
    want = []
    for r in odd.collect():
        t = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        rep = len({k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(i, i + 3)})
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want.append((str(r.doc_id), len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), rep, len(w) < 50 or 100 * rep > 50 * len(w)))
    assert got == sorted(want)
    assert quality.quality_rules(none).collect() == [] and quality.keep_good(odd).columns == odd.columns
    assert {r.doc_id for r in quality.keep_good(odd).collect()} == {9}


# ---- language model


def brute_score(train, text):
    """Context-tree weighting over the whole tree, without arrays or Spark."""
    counts = {}

    def bits(t):
        data = b"\0" * lm.DEPTH + b" ".join(lm.words_of(t)) + b"\0"
        for i in range(lm.DEPTH, len(data)):
            for k in range(8):
                yield data[i - lm.DEPTH : i], (1 << k) | (data[i] >> (8 - k)), (data[i] >> (7 - k)) & 1

    for t in train:
        for ctx, node, bit in bits(t):
            for d in range(lm.DEPTH + 1):
                counts.setdefault((ctx[lm.DEPTH - d :], node), [0, 0])[bit] += 1
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
    weight, below = {}, {}
    for ctx, node in sorted(counts, key=lambda k: -len(k[0])):
        own = kt(*counts[ctx, node])
        if len(ctx) == lm.DEPTH:
            total, weight[ctx, node] = own, 1.0
        else:
            child = below[ctx, node]
            total, weight[ctx, node] = float(np.logaddexp(own, child)) - math.log(2), 1 / (1 + math.exp(min(700, child - own)))
        if ctx:
            below[ctx[1:], node] = below.get((ctx[1:], node), 0.0) + total
    out = 0.0
    for ctx, node, bit in bits(text):
        p, known = 0.5, False
        for d in range(lm.DEPTH, -1, -1):
            c = counts.get((ctx[lm.DEPTH - d :], node))
            if c:
                own = (c[bit] + 0.5) / (sum(c) + 1)
                w = weight[ctx[lm.DEPTH - d :], node] if known else 1.0
                p, known = w * own + (1 - w) * p, True
        out += math.log10(p)
    return out


def test_scores_match_brute_force(spark, monkeypatch, odd):
    texts = [(i, f"the cat {w} sat on a mat and {w} again, Über {i % 3}") for i, w in enumerate("alpha beta gamma delta beta alpha eps zeta".split())]
    rows = texts + [(20, None), (21, ""), (22, "zzz unseen \x01 words"), (None, "the cat")] + [texts[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    is_held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    train = [t or "" for i, t in rows if not is_held(i)]
    assert any(is_held(i) for i, _ in rows)
    c = Counter(w for t in train for w in [*lm.words_of(t), b""])
    n, v = sum(c.values()), len(c)
    for chunk, grams, held in ((48 << 20, 50_000, 1 << 20), (60, 3, 5)):  # the latter deals common endings by a third byte
        monkeypatch.setattr(lm, "CHUNK_BYTES", chunk)
        monkeypatch.setattr(lm, "TASK_GRAMS", grams)
        monkeypatch.setattr(lm, "HELD", held)
        got = lm.score_texts(df).collect()
        assert len(got) == len(rows)
        by = {(r.doc_id): r for r in got}
        for i, t in rows:
            r, w = by[i], [*lm.words_of(t or ""), b""]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (is_held(i), len(w), sum(c[x] > 0 for x in w), n)
            assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel=1e-9)
            assert r.score == pytest.approx(brute_score(train, t or ""), rel=1e-9)
            assert r.bits_per_byte == pytest.approx(-r.score / math.log10(2) / (len(b" ".join(w[:-1])) + 1))


def test_lm_odd_rows(odd, none):
    got = lm.score_texts(odd).collect()
    assert len(got) == odd.count() and all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert lm.score_texts(none).collect() == []


def test_probabilities_of_all_bytes_sum_to_one():
    gram, _ = lm.windows([lm.words_of("some words and some more words")])
    key, n = np.unique(gram, return_counts=True)
    levels, total = lm.grow(key, n, 2)
    root = levels[-1]
    up = (((root.key >> 8) & 255) << 8) | (root.key & 255)
    k, at = np.unique(up, return_inverse=True)
    levels += lm.top_levels(k, *[np.bincount(at, x, minlength=len(k)) for x in (root.n0, root.n1, total)])
    for ctx in (gram[3] >> 8, gram[7] >> 8, 12345):
        assert (10 ** lm.log10_probability((ctx << 8) + np.arange(256), levels)).sum() == pytest.approx(1)


def test_plan_deals_every_key():
    rng = np.random.default_rng(0)
    key = rng.integers(0, 1 << 48, 20000)
    key[:9000] = key[:9000] & ~np.int64(0xFFFF00) | 0x202000  # a common ending
    root, n = np.unique(key >> 8 & 0xFFFF, return_counts=True)
    plan = lm.Plan.of(dict(zip(root.tolist(), (n * 1000).tolist())), 10)
    task = plan.task_of(np.concatenate((key, [-1, -77])))
    assert task.min() >= 0 and task.max() < plan.tasks and set(task[-2:]) == {plan.grams}
    most = np.bincount(task[:9000]).max()
    assert len(set(task[:9000])) > 100 and most < 9000 / 60
    leaf = {}
    for k, t in zip((key >> 8 & 0xFFFFFF).tolist(), task.tolist()):
        assert leaf.setdefault(k, t) == t  # a subtree below three bytes lies in one task


def test_differences_and_back():
    key, offsets = np.array([-5, 3, 9, 7, 8, 2, 50], np.int64), np.array([0, 3, 3, 5, 7])
    assert lm.whole(lm.differences(key, np.array([0, 3, 5])), offsets).tolist() == key.tolist()
