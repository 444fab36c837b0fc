from collections import Counter
from functools import lru_cache

import corpus_pipeline
from driftfield.llm import quality, toxicity

DATA = "/root/testdata/sf0.001"


def test_stages_match_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    rows = [r for r in docs.collect() if model.above(__import__("numpy").array([model.score(r.text or "")]))[0, 0] < toxicity.REJECT]
    got = docs
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "quality", "near_duplicates", "packing"]
    got = corpus_pipeline.STAGES[0][1](spark, got, DATA)
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in rows) and got.columns == docs.columns
    rows = [r for r in rows if quality.judge(r.text or "", quality.Limits())[6]]
    got = corpus_pipeline.STAGES[1][1](spark, got, DATA)
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in rows) and got.columns == docs.columns
    rows = least_of_classes(rows)
    got = corpus_pipeline.STAGES[2][1](spark, got, DATA)
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in rows) and got.columns == docs.columns
    out = corpus_pipeline.run(spark, DATA).collect()
    want = Counter()
    for r in rows:
        tokens = len((r.text or "").encode().split()) + 1
        want.update((r.doc_id, k, min(2048, tokens - 2048 * k)) for k in range(-(-tokens // 2048)))
    assert Counter((r.doc_id, r.piece, r.length) for r in out) == want
    assert all(r.padded_to >= r.length and r.start == 2048 * r.piece for r in out)
    lengths = Counter(n for (_, _, n), c in want.items() for _ in range(c))
    assert sum(r.padded_to - r.length for r in out) == least_padding(lengths, 16) and len({r.padded_to for r in out}) <= 16
    for bucket in {r.bucket for r in out}:
        mine = [r for r in out if r.bucket == bucket]
        each = 16_384 // mine[0].padded_to
        assert sorted((r.batch, r.place) for r in mine) == [divmod(i, each) for i in range(len(mine))]


def least_of_classes(rows):
    """One row of each connected class of texts whose five-word shingles have a weighted Jaccard similarity of 0.8, by all pairs."""
    def shingles(text):
        words = (text or "").encode().split()
        return Counter(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, min(len(words), 1))))

    sets, group = [shingles(r.text) for r in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both, whole = sum((a & b).values()), sum(a.values()) + sum(b.values())
            if group[i] != group[j] and (a == b or both >= 0.8 * (whole - both)):
                group = [group[j] if g == group[i] else g for g in group]
    least = {g: min(r.doc_id for r, h in zip(rows, group) if h == g) for g in set(group)}
    return [r for r, g in zip(rows, group) if least[g] == r.doc_id]


def least_padding(lengths, buckets):
    """The least padding that so many upper lengths allow, by trying every last bucket."""
    order = sorted(lengths)

    @lru_cache(None)
    def best(m, k):
        if m == 0:
            return 0
        if k == 0:
            return float("inf")
        out, cost = float("inf"), 0
        for j in range(m - 1, -1, -1):  # the last bucket holds lengths j to m - 1
            cost += lengths[order[j]] * (order[m - 1] - order[j])
            if cost >= out:
                break
            out = min(out, cost + best(j, k - 1))
        return out

    return best(len(order), buckets)


def test_odd_rows_pass_every_stage(spark, odd, none, tmp_path):
    spark.createDataFrame([(1, 1), (6, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        for df in (odd, none):
            out = stage(spark, df, str(tmp_path))
            rows = out.collect()
            if name != "packing":
                assert out.columns == df.columns
            if name == "near_duplicates" and df is odd:
                assert sorted(str(r.doc_id) for r in rows) == sorted(map(str, [1, 3, 6, 7, 8, 9, 10, 12, None]))
