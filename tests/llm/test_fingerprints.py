import hashlib
import random
import re

import xxhash
from pyspark.sql import functions as F

from driftfield.llm import fingerprints


def fingerprint(text):
    words = {w for w in re.split("[\x20\x09-\x0d]+", text) if w}
    hashes = {w: xxhash.xxh64_intdigest(w.encode(), 42) for w in words}
    total = sum(map(len, words))
    return sum(1 << b for b in range(64) if 2 * sum(len(w) for w, h in hashes.items() if h >> b & 1) > total)


def brute(rows):
    rows = [(i, t or "") for i, t in rows]
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5(f"{'null' if r[0] is None else r[0]}|{r[1]}".encode()).digest()))
    fps, out = {fingerprint(t) for _, t in rows}, []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        n = len(t) // 3
        edited = t[: len(t) - n] + after[:n]
        a, b, c = map(fingerprint, (t, edited, after))
        out.append((str(i), len(t), hashlib.sha256(edited.encode()).hexdigest(), f"{a:016x}", f"{b:016x}", 1 - (a ^ b).bit_count() / 64, 1 - (a ^ c).bit_count() / 64, sum(x != a and (x ^ a).bit_count() <= 3 for x in fps)))
    return sorted(out)


def got(df):
    return sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next, r.n_near) for r in df.collect())


def test_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert got(fingerprints.fingerprint_documents(odd)) == brute(rows)
    assert got(fingerprints.fingerprint_documents(none)) == []
    one = odd.where("doc_id = 9")
    assert got(fingerprints.fingerprint_documents(one)) == brute([x for x in rows if x[0] == 9])


def test_corpus_and_repeated_rows(spark, corpus):
    some = corpus.unionByName(corpus.where("doc_id % 3 = 0")).unionByName(corpus.where("doc_id = 3"))
    rows = [(r.doc_id, r.text) for r in some.select("doc_id", "text").collect()]
    assert got(fingerprints.fingerprint_documents(some.repartition(7))) == brute(rows)


def test_search_finds_every_near_pair_once(spark):
    rng = random.Random(4)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for center in list(fps)[:3] + [0, (1 << 64) - 1]:  # groups of near copies
        for _ in range(150):
            x = center
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    want = {(a, b) for a in fps for b in fps if a != b and (a ^ b).bit_count() <= 3}
    df = spark.createDataFrame([(fingerprints.signed(x),) for x in fps], "fp long").repartition(4)
    for crowd in (1, 20, 10_000):
        pairs = [(r.fp % 2**64, r.n % 2**64) for r in fingerprints.near_fingerprints(df, crowd=crowd).select("fp", F.explode("near").alias("n")).collect()]
        assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_tables_leave_no_gap():
    rng = random.Random(1)
    for blocks in (fingerprints.BLOCKS, fingerprints.FINE_BLOCKS):
        masks = fingerprints.masks(blocks, fingerprints.RADIUS)
        for _ in range(300):
            x = 0
            for _ in range(rng.randint(1, 3)):
                x |= 1 << rng.randrange(64)
            assert sum(x & (kept % 2**64) == 0 and all(x & (g % 2**64) for g in gaps) for _, kept, gaps in masks) == 1


def test_likeness_tells_edited_texts_from_others(spark, corpus):
    r = fingerprints.fingerprint_documents(corpus).where("n_chars > 300").agg(F.avg("near_edited"), F.avg("near_next"), F.avg((F.col("near_edited") > F.col("near_next")).cast("int"))).first()
    assert r[0] > 0.7 and r[1] < 0.56 and r[2] > 0.95


def test_plan_has_no_python(spark, odd):
    plan = fingerprints.fingerprint_documents(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
