import math
import re

import numpy as np
import pytest

from driftfield.llm import toxicity

DATA = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet").where("toxic is not null")
    model = toxicity.fit(docs, labels.where("doc_id % 3 <> 0"))
    rest = toxicity.severity(docs, model).join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    flag, got = np.array([r.toxic == 1 for r in rest]), np.array([r.rejected for r in rest])
    assert got[flag].mean() > 0.78 and got[~flag].mean() < 0.01  # some labels go against the text
    assert all(0 <= r.severity <= 1 and r.grade in (0, 1) for r in rest)


def test_fit_recovers_order():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 6)) < 0.4
    s = x @ np.array([2.0, 1.0, 0.5, 0.0, -1.0, 0.0]) + rng.logistic(size=3000)
    grade = np.digitize(s, [0.5, 1.5, 3.0])
    rows, cols = np.nonzero(x)
    w, t = toxicity.fit_ordinal(rows, cols, grade, 6, 3, steps=800, penalty=0.0)
    assert np.allclose(w, [2.0, 1.0, 0.5, 0.0, -1.0, 0.0], atol=0.3) and np.allclose(t, [0.5, 1.5, 3.0], atol=0.3)


def test_two_grades_equal_newton():
    """With one threshold the fit is the penalised likeliest logistic regression, found here by Newton steps."""
    rng = np.random.default_rng(3)
    x = (rng.random((600, 8)) < 0.3).astype(float)
    y = rng.random(600) < 1 / (1 + np.exp(1.0 - x @ rng.normal(size=8)))
    penalty, full, beta = 1e-3, np.column_stack((x, -np.ones(600))), np.zeros(9)
    ridge = np.diag([penalty] * 8 + [0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-full @ beta))
        beta = beta + np.linalg.solve((full * (p * (1 - p))[:, None]).T @ full / 600 + ridge, full.T @ (y - p) / 600 - ridge @ beta)
    rows, cols = np.nonzero(x)
    w, t = toxicity.fit_ordinal(rows, cols, y.astype(int), 8, 1, steps=4000, penalty=penalty, rate=0.02)
    assert np.allclose(w, beta[:8], atol=2e-3) and np.allclose(t, beta[8:], atol=2e-3)


def test_graded_labels(spark):
    rng = np.random.default_rng(1)
    docs, labels = [], []
    for i in range(900):
        grade = int(rng.choice([0, 2, 5], p=[0.6, 0.25, 0.15]))
        words = [f"w{rng.integers(400)}" for _ in range(30)] + [f"mild{rng.integers(3)}"] * (grade >= 2) + [f"harsh{rng.integers(3)}"] * (grade >= 5)
        docs.append((i, " ".join(words)))
        labels.append((i, grade))
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.fit(docs.unionByName(docs), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert model.grades == (0, 2, 5) and len(model.thresholds) == 2
    got = {r.doc_id: r for r in toxicity.severity(docs, model).collect()}
    assert np.mean([got[i].grade == g for i, g in labels]) > 0.95
    assert all(abs(got[i].severity - g) < 1.5 for i, g in labels if got[i].grade == g)


def test_severity_matches_brute_force(spark, corpus):
    model = toxicity.fit(corpus, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    model = toxicity.Model(model.weights | {b"the": 0.25, b"lore*": -0.5}, (0.5, 2.0), (0, 1, 3))
    got = {r.doc_id: r for r in toxicity.severity(corpus, model).collect()}
    for r in corpus.collect():
        found = set()
        for word in re.findall(rb"[a-z0-9\x80-\xff]+", (r.text or "").lower().encode()):
            found |= {word} | {word[:n] + b"*" for n in (4, 5, 6) if len(word) > n}
        s = math.fsum(model.weights[f] for f in found if f in model.weights)
        above = [1 / (1 + math.exp(t - s)) for t in model.thresholds]
        p = [1 - above[0], above[0] - above[1], above[1]]
        x = got[r.doc_id]
        assert x.p_toxic == pytest.approx(above[0]) and x.severity == pytest.approx(p[1] + 3 * p[2])
        assert x.grade == (0, 1, 3)[p.index(max(p))] and x.rejected == (above[0] >= toxicity.REJECT)
    kept = {r.doc_id for r in toxicity.keep_clean(corpus, model).collect()}
    assert kept == {i for i, r in got.items() if not r.rejected}


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels)  # one kind of label only
    rows = toxicity.severity(odd, model).collect()
    assert len(rows) == odd.count() and not any(r.rejected for r in rows)
    assert toxicity.severity(none, model).collect() == [] and toxicity.keep_clean(odd, model).count() == odd.count()
    assert toxicity.keep_clean(odd, model).columns == odd.columns
    assert toxicity.fit(none, labels.where("false")) is toxicity.NOTHING


def test_long_clean_text_stays_clean():
    model = toxicity.Model({b"bad": 4.0}, (2.0, 4.0, 6.0))
    p = model.above(np.array([model.score("good " * 10**5), model.score("one BAD! word")]))
    assert p[0, 0] < 0.5 < p[1, 0]
