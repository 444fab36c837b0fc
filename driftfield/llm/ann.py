"""Approximate nearest neighbours on shifted space-filling curves.

Each ordering rotates the vectors into a few dimensions, shifts them, and sorts them by
their place on a Hilbert curve. Spark's range partitioning makes the order; rows get
their positions in it, and blocks of positions meet the queries whose windows they touch.
How wide windows must be is measured on a bounded sample of queries against all rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import DOUBLE, INT, LONG, materialize, repeated, schema

#: Neighbours of a query; orderings; projected dimensions and bits of each on the curve.
NEAREST, ORDERINGS, DIMENSIONS, BITS = 20, 32, 12, 5
#: Queries whose true neighbours set the windows, at most; the share of those that must lie in them.
SAMPLE, RECALL = 256, 0.94
#: Positions of a block; blocks are small beside windows, so that queries meet little else.
BLOCK = 256
#: Pairs that a task holds before it sends the best of them, and places kept beyond the
#: wanted ones until scores are added up in a fixed order.
HELD, SPARE = 1 << 21, 12
#: Every so-manieth vec_id is a query.
EVERY = 20
SEED = 7


def rotation(dim: int, ordering: int) -> tuple[np.ndarray, np.ndarray]:
    """An ordering's own orthonormal projection and shift; depends on its number alone."""
    rng = np.random.default_rng([SEED, ordering])
    q, _ = np.linalg.qr(rng.normal(size=(dim, min(dim, DIMENSIONS))))
    return q, rng.random(q.shape[1])


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on a Hilbert curve of points with `bits`-bit coordinates, one row each.

    Gray-code rotations are undone from the highest bit down, then bits are interleaved.
    """
    x = [c.astype(np.int64) for c in cells.T]
    n, q = len(x), 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn, q = np.zeros(len(cells), np.int64), 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    place = np.zeros(len(cells), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            place = (place << 1) | (((x[i] ^ turn) >> b) & 1)
    return place


def curve_places(v: np.ndarray, ordering: int, spread: float) -> np.ndarray:
    """Projections are squashed to (0, 1) by a logistic curve of the data's spread, then shifted."""
    q, shift = rotation(v.shape[1], ordering)
    u = 1 / (1 + np.exp(-1.7 * np.clip((v @ q) / max(spread, 1e-300), -20, 20)))
    return hilbert(np.minimum((u + shift) / 2 * (1 << BITS), (1 << BITS) - 1).astype(np.int64), BITS)


def vectors_of(column) -> np.ndarray:
    """A list column without nulls, of lists of equal length, as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def usable(df: DataFrame) -> DataFrame:
    """Rows with an id and a vector that is not null, empty or zero and has finite components only."""
    good = F.expr("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    return df.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(good)


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """One row per vector: its least id, and its NEAREST + 1 least ids, of which a query needs no more.

    An id stands there as often as its row is repeated. Spark limits the rank inside each task before it shuffles, so that a task sends at most
    that many rows of a vector, however often it occurs.
    """
    most = NEAREST + 1
    least = rows.withColumn("r", F.expr("row_number() over (partition by v order by vec_id)")).where(f"r <= {most}")
    return least.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("cls"), "v", "ids")


def told_apart(vectors: DataFrame) -> DataFrame:
    """vectors with a `cls` of their own: the least id, or, where unlike vectors share that, their place in its order.

    Classes keep the order of least ids, by which ties are broken.
    """
    n, low = vectors.agg(F.count(F.lit(1)), F.countDistinct("cls")).first()
    if n == low:
        return vectors
    order = "partition by task order by cls, v"
    ranged = materialize(vectors.repartitionByRange("cls", "v").withColumn("task", F.spark_partition_id()), "ranged-vectors")
    before = ranged.groupBy("task").count().select(F.col("task").alias("k"), F.expr("coalesce(sum(count) over (order by task rows between unbounded preceding and 1 preceding), 0)").alias("before"))
    placed = ranged.withColumn("r", F.expr(f"row_number() over ({order})")).join(F.broadcast(before), F.col("task") == F.col("k"))
    return materialize(placed.select((F.col("r") + F.col("before")).cast("long").alias("cls"), "v", "ids"), "vectors")


def positions(vectors: DataFrame, spread: float, orderings: int) -> DataFrame:
    """ordering, pos and cls: each vector's place in each ordering, from 0 without gaps.

    Only places and ids are sorted. Offsets of the range partitions, one number each, are
    the sole thing that the driver adds up.
    """
    def place(batches):
        for b in batches:
            v, cls = vectors_of(b.column("v")), b.column("cls")
            for o in range(orderings):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), o, np.int32)), pa.array(curve_places(v, o, spread)), cls], ["ordering", "place", "cls"])

    placed = vectors.select("cls", "v").mapInArrow(place, "ordering int, place long, cls long")
    ranged = placed.repartitionByRange("ordering", "place", "cls").withColumn("task", F.spark_partition_id())
    ranged = materialize(ranged, "curve")
    sizes = ranged.groupBy("ordering", "task").count()
    before = sizes.select(F.col("ordering").alias("o"), F.col("task").alias("k"), F.expr("coalesce(sum(count) over (partition by ordering order by task rows between unbounded preceding and 1 preceding), 0)").alias("before"))
    inside = ranged.withColumn("r", F.expr("row_number() over (partition by ordering, task order by place, cls) - 1"))
    return inside.join(before, (F.col("ordering") == F.col("o")) & (F.col("task") == F.col("k"))).select("ordering", (F.col("r") + F.col("before")).cast("long").alias("pos"), "cls")


def best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k largest scores of each row, ties to smaller ids, in no order."""
    m, n = score.shape
    if n <= k:
        return np.repeat(np.arange(m), n), np.tile(np.arange(n), m)
    cols = np.argpartition(score, n - k, axis=1)[:, n - k :]
    edge = np.take_along_axis(score, cols, 1).min(1)
    for i in np.flatnonzero((score >= edge[:, None]).sum(1) > k):  # ties at the last place
        some = np.flatnonzero(score[i] >= edge[i])
        cols[i] = some[np.lexsort((ids[some], -score[i][some]))][:k]
    return np.repeat(np.arange(m), k), cols.ravel()


def leaders(q: np.ndarray, c: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of each query, each candidate once, ties to smaller ids."""
    order = np.lexsort((c, q))
    q, c, s = q[order], c[order], s[order]
    new = np.concatenate(([True], (q[1:] != q[:-1]) | (c[1:] != c[:-1])))[: len(q)]
    q, c, s = q[new], c[new], s[new]
    order = np.lexsort((c, -s, q))
    q, c, s = q[order], c[order], s[order]
    first = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))[: len(q)]
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.concatenate((first, [len(q)]))))
    return q[rank < k], c[rank < k], s[rank < k]


def inner_products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    return q @ c.T


def _search(k: int):
    def run(batches):
        """Rows come sorted by block, candidates first; a task keeps the best of its blocks and sends them when they are many."""
        block, cand_ids, cand, mat = None, [], [], None
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0

        def search(qids, qv):
            nonlocal mat, held
            if not cand:
                return
            if mat is None:
                mat = (np.concatenate(cand_ids), np.concatenate(cand))
            ids, rows = mat
            s = inner_products(qv, rows)
            row, col = best(s, ids, k)
            found.append((qids[row], ids[col], s[row, col]))
            held += len(row)

        def send():
            nonlocal held
            if found:
                q, c, s = leaders(*(np.concatenate(x) for x in zip(*found)), k)
                found.clear()
                held = 0
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(c), pa.array(s)], ["qcls", "cls", "score"])

        for b in batches:
            key = np.array(b.column("block").to_pylist(), np.int64)
            is_query = np.array(b.column("role").to_pylist()) == 1
            ids, v = b.column("id").to_numpy(), vectors_of(b.column("v"))
            cut = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (is_query[1:] != is_query[:-1]), [True])))
            for lo, hi in zip(cut[:-1], cut[1:]):
                if key[lo] != block:
                    block, cand_ids, cand, mat = key[lo], [], [], None
                if is_query[lo]:
                    for at in range(lo, hi, 256):
                        search(ids[at : min(hi, at + 256)], v[at : min(hi, at + 256)])
                        if held > HELD:
                            yield from send()
                else:
                    cand_ids.append(ids[lo:hi])
                    cand.append(v[lo:hi])
        yield from send()

    return run


def search_blocks(blocks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k best classes of each query class among the blocks it meets: qcls, cls, score.

    blocks: block, cls, v. queries: block, cls, v. A task sends k rows of a query, each time that it holds many.
    """
    rows = blocks.select("block", F.lit(0).alias("role"), F.col("cls").alias("id"), "v").unionByName(queries.select("block", F.lit(1).alias("role"), F.col("cls").alias("id"), "v"))
    met = rows.repartition("block").sortWithinPartitions("block", "role")
    part = met.mapInArrow(_search(k), "qcls long, cls long, score double").dropDuplicates(["qcls", "cls"])
    return part.withColumn("r", F.expr("row_number() over (partition by qcls order by score desc, cls)")).where(f"r <= {k}").drop("r")


def window(vectors: DataFrame, query_classes: DataFrame, places: DataFrame, n: int, recall: float) -> int:
    """Positions to each side of a query that hold the wanted share of true neighbours in some ordering.

    The true neighbours of at most SAMPLE queries come from a search of all rows in blocks.
    """
    sample = query_classes.orderBy(F.xxhash64("cls"), "cls").limit(SAMPLE).select("cls", "v")
    count = -(-n // BLOCK)
    blocks = vectors.withColumn("block", F.pmod(F.xxhash64("cls"), F.lit(count)))
    asked = sample.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))))
    true = search_blocks(blocks, asked, NEAREST + 1).where("qcls <> cls")
    a, b = places.alias("a"), places.alias("b")
    near = F.broadcast(true.select("qcls", "cls"))
    theirs = b.join(near, F.col("b.cls") == near["cls"]).select("ordering", "qcls", near["cls"].alias("hit"), F.col("b.pos").alias("hit_pos"))
    mine = a.join(F.broadcast(sample.select(F.col("cls").alias("q"))), F.col("a.cls") == F.col("q")).select("ordering", F.col("q").alias("qcls"), "pos")
    apart = theirs.join(mine, ["ordering", "qcls"]).groupBy("qcls", "hit").agg(F.min(F.abs(F.col("pos") - F.col("hit_pos"))).alias("apart"))
    return math.ceil(apart.agg(F.coalesce(F.percentile("apart", F.lit(recall)), F.lit(0.0))).first()[0])


def nearest(df: DataFrame, k: int = NEAREST, every: int = EVERY, orderings: int = ORDERINGS, recall: float = RECALL, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest rows found of each query, by inner product.

    Queries are rows whose id is divisible by `every`; all other rows and queries are
    candidates. Ties go to smaller ids. Equal vectors are searched as one and spelled out
    again from their least ids, so that ties are whole. Vectors that are null, empty, zero
    or hold a null or non-finite component take no part, nor do those of another length
    than most. A repeated row is a candidate, also for its twin, and a query as often as it
    occurs; so is a row of the same id with another vector. Further columns are not read.
    """
    source = usable(df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")))
    dim = source.agg(F.mode(F.size("v"))).first()[0]
    out = schema(query_id=LONG, rank=INT, vec_id=LONG, score=DOUBLE)
    source = source.where(F.size("v") == dim)
    vectors = told_apart(materialize(distinct_vectors(source), "vectors"))
    n, squares = vectors.agg(F.count(F.lit(1)), F.avg(F.expr("aggregate(v, 0D, (a, x) -> a + x * x)"))).first()
    if not n:
        return df.sparkSession.createDataFrame([], out)
    spread = math.sqrt(squares / dim)
    asking = source.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id"), F.col("v").alias("qv")).agg(F.count(F.lit(1)).alias("times"))
    query_of = asking.join(vectors.select("cls", "v"), F.col("qv") == F.col("v")).select("query_id", "cls", "times")
    query_of = materialize(query_of, "queries")
    query_classes = vectors.select("cls", "v").join(query_of.select("cls").distinct(), "cls")
    places = materialize(positions(vectors, spread, orderings), "positions")
    width = window(vectors, query_classes, places, n, recall)

    def block(ordering, pos):
        return ordering * F.lit(1 << 40) + F.floor(pos / BLOCK).cast("long")

    o = F.col("ordering").cast("long")
    blocks = places.join(vectors.select("cls", "v"), "cls").select(block(o, F.col("pos")).alias("block"), "cls", "v")
    reach = F.sequence(block(o, F.greatest(F.col("pos") - width, F.lit(0))), block(o, F.least(F.col("pos") + width, F.lit(n - 1))))
    asked = places.join(query_classes, "cls").select(F.explode(reach).alias("block"), "cls", "v")
    hits = search_blocks(blocks, asked, k + 1 + SPARE).drop("score")
    both = hits.join(vectors.select("cls", "v", "ids"), "cls").join(query_classes.select(F.col("cls").alias("qcls"), F.col("v").alias("qv")), "qcls")
    # products are added up in the order of components, whatever block the pair met in
    exact = F.expr("aggregate(zip_with(qv, v, (a, b) -> double(a) * double(b)), 0D, (a, x) -> a + x)")
    members = both.select("qcls", "cls", "ids", exact.alias("score")).join(query_of.withColumnRenamed("cls", "qcls"), "qcls")
    at = F.array_position("ids", F.col("query_id"))  # of the query's own class its own row, once, is left out
    others = F.when((F.col("cls") == F.col("qcls")) & (at > 0), F.concat(F.slice("ids", F.lit(1), (at - 1).cast("int")), F.slice("ids", (at + 1).cast("int"), F.size("ids")))).otherwise(F.col("ids"))
    spelled = members.select("query_id", "qcls", "times", "score", F.explode(others).alias("vec_id"))
    ranked = spelled.withColumn("rank", F.expr("row_number() over (partition by query_id, qcls order by score desc, vec_id)")).where(f"rank <= {k}")
    return repeated(ranked, "times").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
