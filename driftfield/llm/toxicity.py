"""Severity of toxic texts: cumulative-link ordinal regression on sparse word features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import DOUBLE, FLAG, INT, LONG, materialize, schema, text_of

#: Labelled rows used to fit, at most; taken by the order of a hash of their ids.
SAMPLE = 8_192
#: Features kept, at most: words and word beginnings that speak most surely for toxic rows.
FEATURES = 4_096
#: Least standardised log-odds of a kept feature, and least part of the sample's toxic rows
#: that hold it (and least number of them); near copies count once in all of these.
LEAST_Z, LEAST_SHARE, LEAST_ROWS = 4.0, 0.02, 4
#: Bytes from which a word is rare enough to tell texts apart.
RARE = 10
#: A document is rejected if its probability of any grade above 0 is at least this.
REJECT = 0.5

#: ASCII letters in lower case, and the bytes of other letters, stand for themselves; all else is space.
_WORD_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
BEGINNINGS = (4, 5, 6)


def features(text: str) -> set[bytes]:
    """The distinct words of a text, and their beginnings marked by a star."""
    words = set(text.lower().encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split())
    out = set(words)
    for n in BEGINNINGS:
        out.update([w[:n] + b"*" for w in words if len(w) > n])
    return out


@dataclass(frozen=True)
class Model:
    """P(grade > j) = 1 / (1 + exp(threshold[j] - s)); s sums the weights of the features present.

    grades are the labels' values in order, one more than thresholds.
    """

    weights: dict[bytes, float]
    thresholds: tuple[float, ...]
    grades: tuple[int, ...] = (0, 1)

    def score(self, text: str) -> float:
        get = self.weights.get
        return sum(map(get, self.weights.keys() & features(text)))

    def above(self, s: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(np.array(self.thresholds)[None, :] - s[:, None], -60, 60)))


NOTHING = Model({}, (60.0,))


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, grade: np.ndarray, n_features: int, k: int, steps: int = 1000, penalty: float = 1e-5, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights shared by all thresholds, by Adam on the penalised mean log-likelihood.

    rows and cols name the entries, all 1, of a sparse matrix; grades run from 0 to k.
    """
    n = len(grade)
    w, t = np.zeros(n_features), np.linspace(1.0, 3.0, k)
    moments = [np.zeros(n_features + k), np.zeros(n_features + k)]
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -60, 60)))
    for step in range(1, steps + 1):
        s = np.bincount(rows, w[cols], minlength=n)
        edge = np.concatenate((np.full((n, 1), 0.0), sig(t[None, :] - s[:, None]), np.full((n, 1), 1.0)), axis=1)
        slope = edge * (1 - edge)
        i = np.arange(n)
        p = np.maximum(edge[i, grade + 1] - edge[i, grade], 1e-12)
        ds = (slope[i, grade + 1] - slope[i, grade]) / p  # minus log-likelihood by s
        dt = np.array([(slope[:, j + 1] / p * ((grade == j + 1) * 1.0 - (grade == j))).sum() for j in range(k)])
        g = np.concatenate((np.bincount(cols, ds[rows], minlength=n_features) / n + penalty * w, dt / n))
        moments[0] = 0.9 * moments[0] + 0.1 * g
        moments[1] = 0.999 * moments[1] + 0.001 * g * g
        move = rate * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.999**step)) + 1e-8)
        w, t = w - move[:n_features], np.sort(t - move[n_features:])
    return w, t


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on at most `sample` labelled documents. The grades are the values of the labels'
    toxic column that occur, in order, and 0: labels of 0 and 1 give one threshold, where
    the model is logistic regression; graded labels give more, which share the weights.

    Features are counted over sketches, the least hash of a row's long words, which near
    copies share: else a copied text would make markers of its ordinary words.

    Labels without id or toxic grade are left out; of several labels of an id the largest
    holds, and of several documents of an id the one whose text comes first in order.
    Without both kinds of rows the model rejects nothing.
    """
    chosen = (
        labels.where("doc_id is not null and toxic >= 0").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )

    def found(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array([sorted(features(t)) for t in text_of(b)], pa.list_(pa.binary()))], ["doc_id", "toxic", "features"])

    wanted = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.first("toxic").cast("int").alias("toxic"), F.min("text").alias("text"))
    rows = materialize(wanted.mapInArrow(found, "doc_id long, toxic int, features array<binary>"), "toxicity-sample")
    sketched = rows.select((F.col("toxic") != 0).alias("toxic"), "features", F.expr(f"coalesce(array_min(transform(filter(features, f -> length(f) >= {RARE}), f -> xxhash64(f))), xxhash64(features))").alias("sketch"))
    counts = [F.count_distinct(F.when(flag, F.col("sketch"))).alias(name) for name, flag in (("a", F.col("toxic")), ("b", ~F.col("toxic")))]
    toxic, clean = sketched.agg(*counts).first()
    if not clean or not toxic:
        return NOTHING
    held = sketched.select("toxic", "sketch", F.explode("features").alias("f")).groupBy("f").agg(*counts)
    odds = F.expr(f"ln((a + 0.5) / ({toxic} - a + 0.5)) - ln((b + 0.5) / ({clean} - b + 0.5))")
    best = held.where(f"a >= {max(LEAST_ROWS, LEAST_SHARE * toxic)}").withColumn("odds", odds).withColumn("z", F.col("odds") / F.sqrt(F.expr("1 / (a + 0.5) + 1 / (b + 0.5)"))).where(f"z >= {LEAST_Z}")
    kept = best.orderBy(F.desc("z"), "f").limit(FEATURES).select("f").collect()
    if not kept:
        return NOTHING
    names = [bytes(r.f) for r in kept]
    place = {f: i for i, f in enumerate(names)}

    def sparse(batches):
        for b in batches:
            all_of = b.column("features").to_pylist()
            hits = [[place[f] for f in fs if f in place] for fs in all_of]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array(hits, pa.list_(pa.int32()))], ["doc_id", "toxic", "at"])

    got = rows.mapInArrow(sparse, "doc_id long, toxic int, at array<int>").orderBy("doc_id").collect()
    grades = sorted({0, *(r.toxic for r in got)})
    size = np.array([len(r["at"]) for r in got])
    cols = np.array([c for r in got for c in r["at"]], int)
    w, t = fit_ordinal(np.repeat(np.arange(len(got)), size), cols, np.array([grades.index(r.toxic) for r in got]), len(names), len(grades) - 1)
    return Model({f: float(x) for f, x in zip(names, w)}, tuple(map(float, t)), tuple(grades))


def severity(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: expected severity (the mean grade), probability of any grade above 0, the likeliest
    grade and whether it is rejected. Map only; the broadcast model has at most FEATURES weights.

    Null and empty texts hold no features and get the model's score of nothing. Repeated
    rows are kept; further columns are not read; texts are taken whole.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    out = schema(doc_id=LONG, severity=DOUBLE, p_toxic=DOUBLE, grade=INT, rejected=FLAG)

    def run(batches):
        m = shared.value
        grades = np.array(m.grades)
        for b in batches:
            p = m.above(np.array([m.score(t) for t in text_of(b)], float))
            full = np.concatenate((np.ones((len(p), 1)), p, np.zeros((len(p), 1))), axis=1)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(grades[0] + p @ np.diff(grades)), pa.array(p[:, 0]), pa.array(grades[np.argmax(full[:, :-1] - full[:, 1:], axis=1)].astype(np.int32)), pa.array(p[:, 0] >= REJECT)], out.names)

    return df.selectExpr(f"`{id_col}` as doc_id", f"`{text_col}` as text").mapInArrow(run, out)


def keep_clean(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows that the model does not reject, with all their columns as they are.

    Null and empty texts hold no features and get the model's score of nothing; repeated
    rows stay or go together; an empty table stays empty; columns may have any names.
    """
    shared, at = df.sparkSession.sparkContext.broadcast(model), df.columns.index(text_col)

    def run(batches):
        m = shared.value
        for b in batches:
            s = np.array([m.score(t or "") for t in b.column(at).to_pylist()], float)
            yield b.filter(pa.array(m.above(s)[:, 0] < REJECT))

    return df.mapInArrow(run, df.schema)
