"""Hard negatives by an exact nearest-neighbour join over a Voronoi partition.

A vector x of length at most L is augmented by sqrt(L^2 - |x|^2), an anchor by 0: then the
largest inner product is the least distance. Candidates and anchors belong to the cell of
their nearest pivot. What a cell's anchors still need (scores in some range) bounds, by the
triangle inequality, how far from its own pivot a candidate of each cell must lie, so
candidates go to those groups of anchors that they might serve. Each group then joins what
it got exactly, anchors in memory and candidates in batches.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ann import vectors_of
from .common import INT, LONG, materialize, repeated, schema, tidy

#: Positives of an anchor, negatives of a positive, and the shares of the positive's score between which they lie, in hundredths.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
#: Every so-manieth vec_id is an anchor; of every so-manieth the label is moved on, modulo LABELS.
ANCHORS, MOVED, LABELS = 100, 7, 10
#: Steps of a component's unit.
SCALE = 256
#: Pivots, at most (a bounded sample that decides what is compared, never a result); rows of a cell for each of them.
PIVOTS, CELL = 512, 512
#: Anchors that a task holds at a time, and rows that it reads for them, about.
GROUP, SLICE = 4096, 4096
#: Rows that are compared with the anchors at once.
BATCH = 2048
#: Bounds from distances are widened by this share of the largest length, against rounding.
_SLACK = 1e-6
FOUND = "anchor_id long, variant long, j int, score long, id_list array<long>"


def integer_vectors(df: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """vec_id, label and v of the rows that take part, labels moved and components as whole steps."""
    named = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("v"))
    good = F.expr("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    named = named.where("vec_id is not null and label is not null and v is not null and size(v) > 0").where(good)
    label = F.when(F.col("vec_id") % MOVED == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return named.select("vec_id", label.alias("label"), F.expr(f"transform(v, x -> double(floor({SCALE} * double(x))))").alias("v"))


def augmented(v: np.ndarray, square: float, anchors: bool) -> np.ndarray:
    rest = np.zeros(len(v)) if anchors else np.sqrt(np.maximum(square - np.einsum("ij,ij->i", v, v), 0))
    return np.hstack((v, rest[:, None]))


def place(rows: DataFrame, pivots: np.ndarray, square: float, anchors: bool) -> DataFrame:
    """rows (with v) with their cell, the distance to its pivot, and their own length squared."""
    half = np.einsum("ij,ij->i", pivots, pivots) / 2

    def run(batches):
        for b in batches:
            x = augmented(vectors_of(b.column("v")), square, anchors)
            cell = np.argmax(x @ pivots.T - half, axis=1) if len(x) else np.zeros(0, np.int64)
            away = np.sqrt(((x - pivots[cell]) ** 2).sum(1))
            extra = [pa.array(cell.astype(np.int32)), pa.array(away), pa.array((x[:, :-1] ** 2).sum(1))]
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], [*b.schema.names, "cell", "away", "square"])

    fields = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    return rows.mapInArrow(tidy(run), f"{fields}, cell int, away double, square double")


def reach(pivots: np.ndarray, square: float, cells: np.ndarray, away: np.ndarray, short: np.ndarray, long: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest distance from each pivot (columns) at which a candidate may serve each cell's anchors (rows).

    away: the anchors' largest distance from their pivot; short, long: their least and
    largest squared lengths; low, high: scores that they want. A score s is a distance
    sqrt(|q|^2 + L^2 - 2 s), which differs from the pivots' by no more than both distances to them.
    """
    apart = np.sqrt(np.array([((pivots - p) ** 2).sum(1) for p in pivots[cells]]))
    far = np.sqrt(np.maximum(long + square - 2 * low, 0))[:, None]
    close = np.sqrt(np.maximum(short + square - 2 * high, 0))[:, None]
    away, slack = away[:, None], _SLACK * math.sqrt(max(square, 1))
    inner = np.maximum(apart - away - far, close - apart - away)
    return np.maximum(inner - slack, 0), apart + away + far + slack


def bundles(counts: np.ndarray, pivots: np.ndarray, cells: np.ndarray, group: int) -> np.ndarray:
    """Numbers of bundles of anchor cells: neighbours on a walk from pivot to nearest unused pivot, about `group` anchors each."""
    left, at, walk = set(range(len(cells))), 0, []
    while left:
        left.discard(at)
        walk.append(at)
        rest = np.array(sorted(left), np.int64)
        if len(rest):
            at = int(rest[np.argmin(((pivots[cells[rest]] - pivots[cells[at]]) ** 2).sum(1))])
    out, number, held = np.zeros(len(cells), np.int64), 0, 0
    for i in walk:
        if held and held + counts[i] > group:
            number, held = number + 1, 0
        out[i] = number
        held += counts[i]
    return out


def _keep(held: tuple[np.ndarray, ...], new: tuple[np.ndarray, ...], k: int) -> tuple[np.ndarray, ...]:
    """The k best (score, then least id) of each slot, of rows (slot, score, least id, row)."""
    slot, score, low, row = (np.concatenate(x) for x in zip(held, new))
    order = np.lexsort((low, -score, slot))
    slot, score, low, row = slot[order], score[order], low[order], row[order]
    first = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1])))[: len(slot)]
    rank = np.arange(len(slot)) - np.repeat(first, np.diff(np.concatenate((first, [len(slot)]))))
    keep = rank < k
    return slot[keep], score[keep], low[keep], row[keep]


def _candidates(negatives: bool, width: int, k: int, label, v, told, labels, low, cand) -> tuple[np.ndarray, ...]:
    """slot (anchor * width + j), score, least id and row of all that reach the k-th best of their slot, ties included."""
    found = []
    for lo in range(0, len(label), 512):
        at = slice(lo, lo + 512)
        s, same = v[at] @ cand.T, label[at, None] == labels[None, :]
        for j in range(width):
            p = told[at, j][:, None]
            fit = ~same & (LOW * p <= 100 * s) & (100 * s <= HIGH * p) if negatives else same
            if s.shape[1] > k:
                masked = np.where(fit, s, -np.inf)
                fit &= masked >= np.partition(masked, s.shape[1] - k, axis=1)[:, -k, None]
            r, c = np.nonzero(fit)
            found.append(((lo + r) * width + j, s[r, c], low[c], c))
    return tuple(np.concatenate(x) for x in zip(*found))


def _others(ids: list[int], variant: int, anchor: int, own: int) -> list[int]:
    """A candidate's ids without one of the anchor's, where it is the anchor's own."""
    if variant != own or anchor not in ids:
        return ids
    at = ids.index(anchor)
    return ids[:at] + ids[at + 1 :]


def _join(negatives: bool, width: int, k: int):
    """Rows come sorted by group and slice, anchors (role 0) first. Without `negatives` the k best
    candidates of the anchor's label; else, for each of its `width` scores, the k best of other
    labels in the range of scores. An anchor's own row is a candidate like any other."""

    def run(batches):
        key = None

        def start():
            nonlocal anchors, waiting, count, best, kept
            anchors, waiting, count, kept = [], [], 0, {}
            best = tuple(np.zeros(0, t) for t in (np.int64, np.float64, np.int64, np.int64))

        def look():
            nonlocal waiting, count, best, kept
            if waiting and anchors:
                _, _, label, v, told = (np.concatenate(x) for x in zip(*anchors))
                ids, base = [x for w in waiting for x in zip(w[0], w[3])], max(kept, default=-1) + 1
                slot, score, low, row = _candidates(negatives, width, k, label, v, told, np.concatenate([w[1] for w in waiting]), np.array([x[0][0] for x in ids]), np.concatenate([w[2] for w in waiting]))
                best = _keep(best, (slot, score, low, row + base), k)
                kept = {r: kept[r] if r < base else ids[r - base] for r in set(best[3].tolist())}
            waiting, count = [], 0

        def end():
            look()
            if anchors and len(best[0]):
                slot, score, _, row = best
                names, variants = (np.concatenate([x[i] for x in anchors])[slot // width] for i in (0, 1))
                lists = [_others(*kept[r], a, x) for r, a, x in zip(row.tolist(), names.tolist(), variants.tolist())]
                columns = [pa.array(names), pa.array(variants), pa.array((slot % width).astype(np.int32)), pa.array(score.astype(np.int64)), pa.array(lists, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["anchor_id", "variant", "j", "score", "id_list"])

        anchors, waiting, count, best, kept = [], [], 0, (), {}
        for b in batches:
            keys = list(zip(*[b.column(c).to_pylist() for c in ("grp", "part", "slice", "role")]))
            v, labels = vectors_of(b.column("v")), b.column("label").to_numpy()
            cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)] if keys else []
            for lo, hi in zip(cuts, cuts[1:]):
                if keys[lo][:3] != key:
                    if key is not None:
                        yield from end()
                    key = keys[lo][:3]
                    start()
                lists = b.column("ids").slice(lo, hi - lo).to_pylist()
                if keys[lo][3] == 0:
                    told = np.full((hi - lo, width), np.nan)
                    for i, x in enumerate(b.column("scores").slice(lo, hi - lo).to_pylist()):
                        told[i, : len(x)] = x
                    anchors.append((np.array([x[0] for x in lists]), b.column("variant").slice(lo, hi - lo).to_numpy(), labels[lo:hi], v[lo:hi], told))
                else:
                    waiting.append((lists, labels[lo:hi], v[lo:hi], b.column("variant").slice(lo, hi - lo).to_pylist()))
                    count += hi - lo
                    if count >= BATCH:
                        look()
        if key is not None:
            yield from end()

    return run


def serve(asked: DataFrame, placed: DataFrame, groups: list[tuple], needs: list[tuple], negatives: bool, width: int, k: int) -> DataFrame:
    """anchor_id, variant, j, score and id_list of the local joins.

    groups: (cell, grp, parts, slices) of anchor cells; needs: (cell, grp, parts, slices,
    inner, outer) of candidate cells. There are at most PIVOTS groups and PIVOTS^2 needs, so both are broadcast.
    """
    spark = asked.sparkSession
    to = F.broadcast(spark.createDataFrame(groups, "cell int, grp int, parts int, slices int"))
    wanted = F.broadcast(spark.createDataFrame(needs, "cell int, grp int, parts int, slices int, inner double, outer double"))
    columns = ["grp", "part", "slice", "role", "ids", "variant", "label", "v", "scores"]
    a = asked.join(to, "cell").withColumn("part", F.pmod(F.xxhash64("variant", "vec_id"), F.col("parts")).cast("int")).withColumn("slice", F.explode(F.expr("sequence(0, slices - 1)")))
    a = a.withColumn("role", F.lit(0)).withColumn("ids", F.array("vec_id")).select(columns)
    c = placed.join(wanted, "cell").where("away between inner and outer").withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).withColumn("slice", F.pmod(F.xxhash64("variant"), F.col("slices")).cast("int"))
    c = c.withColumn("role", F.lit(1)).withColumn("scores", F.expr("cast(array() as array<double>)")).select(columns)
    dealt = a.unionByName(c).repartition("grp", "part", "slice").sortWithinPartitions("grp", "part", "slice", "role")
    return dealt.mapInArrow(tidy(_join(negatives, width, k)), FOUND)


def ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """keys, rank (from 1), vec_id and score: the k best ids, ties to smaller ones."""
    each = found.select(*keys, "score", F.explode("id_list").alias("vec_id"))
    return each.withColumn("rank", F.expr(f"row_number() over (partition by {', '.join(keys)} order by score desc, vec_id)")).where(f"rank <= {k}")


def hard_negatives(df: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, group: int = GROUP, slice_rows: int = SLICE, most_pivots: int = PIVOTS, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    Rows without an id or a label, and those whose vector is null, empty or holds a null or
    non-finite component, take no part, nor do vectors of another length than most. Anchors
    and candidates are rows: a repeated row is a candidate as often as it occurs, another
    row to its twin, and an anchor as often. Ties go to smaller ids. Scores are exact while
    squared lengths stay below 2^53. An empty table gives no rows; further columns are not read.
    Rows of one label and vector are one candidate with its least ids, of which no anchor needs more.
    """
    spark, most = df.sparkSession, max(positives + 1, negatives) + 1
    none = spark.createDataFrame([], schema(anchor_id=LONG, positive_id=LONG, rank=INT, negative_id=LONG, positive_score=LONG, negative_score=LONG))
    rows = integer_vectors(df, id_col, label_col, vector_col)
    dim = rows.agg(F.mode(F.size("v"), deterministic=True)).first()[0]
    rows = rows.where(F.size("v") == F.lit(dim))
    variant = F.xxhash64("label", "v").alias("variant")
    least = rows.withColumn("r", F.expr("row_number() over (partition by label, v order by vec_id)")).where(f"r <= {most}")
    candidates = least.groupBy("label", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    candidates = materialize(candidates.select("label", "v", "ids", variant), "candidates")
    n, square = candidates.agg(F.count(F.lit(1)), F.max(F.expr("aggregate(v, 0D, (a, x) -> a + x * x)"))).first()
    if not n:
        return none
    chosen = candidates.orderBy("variant").limit(min(most_pivots, max(1, n // CELL))).select("v").collect()
    pivots = augmented(np.array([r.v for r in chosen]), square, anchors=False)
    placed = materialize(place(candidates, pivots, square, anchors=False), "placed")
    asked = rows.where(F.col("vec_id") % ANCHORS == 0).groupBy("vec_id", "label", "v").agg(F.count(F.lit(1)).alias("times"))
    asked = materialize(place(asked.select("vec_id", "label", "v", variant, "times"), pivots, square, anchors=True), "anchors")
    sizes = {r.cell: r.n for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    name = ["anchor_id", "variant"]

    def plan(anchors: DataFrame, low, high) -> tuple[list, list]:
        """Groups and needs for anchors that want scores from low to high; the driver holds a row a cell."""
        of_cell = anchors.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("away"), F.min("square").alias("short"), F.max("square").alias("long"), F.min(low).alias("low"), F.max(high).alias("high"))
        cells, counts, away, short, long, lowest, highest = (np.array(x) for x in zip(*of_cell.orderBy("cell").collect()))
        inner, outer = reach(pivots, square, cells, away, short, long, lowest, highest)
        number = bundles(counts, pivots, cells, group)
        groups, needs = [], []
        for g in range(number.max() + 1):
            mine = number == g
            lo, hi = inner[mine].min(0), outer[mine].max(0)
            met = [c for c in sizes if lo[c] <= hi[c]]
            parts, slices = int(-(-counts[mine].sum() // group)), int(-(-sum(sizes[c] for c in met) // slice_rows)) or 1
            groups += [(int(c), g, parts, slices) for c in cells[mine]]
            needs += [(c, g, parts, slices, float(lo[c]), float(hi[c])) for c in met]
        return groups, needs

    anchors = asked.withColumn("scores", F.expr("cast(array() as array<double>)"))
    if anchors.isEmpty():
        return none
    # own cells first: what they hold bounds what other cells must offer
    crowd = {r.cell: -(-r.n // group) for r in asked.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    own = [(c, c, parts, -(-sizes.get(c, 1) // CELL)) for c, parts in crowd.items()]
    near = serve(anchors, placed, own, [(*x, 0.0, math.inf) for x in own], False, 1, positives + 1)
    edge = ranked(near, name, positives).where(F.col("rank") == positives).select(F.col("anchor_id").alias("vec_id"), "variant", F.col("score").alias("edge"))
    known = materialize(anchors.join(edge, ["vec_id", "variant"], "left").withColumn("edge", F.coalesce(F.col("edge").cast("double"), F.lit(-math.inf))), "bounds")
    best = serve(known, placed, *plan(known, F.col("edge"), F.lit(math.inf)), False, 1, positives + 1)
    best = ranked(best, name, positives).select(*name, (F.col("rank") - 1).alias("j"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    best = materialize(best, "positives")
    told = best.groupBy(*name).agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "positive_score"))), lambda x: x["positive_score"].cast("double")).alias("scores"))
    told = told.where(F.col("scores")[0] >= 0).withColumnRenamed("anchor_id", "vec_id")  # below 0 the range is empty
    asking = materialize(asked.join(told, ["vec_id", "variant"]), "asking")
    if asking.isEmpty():
        return none
    low, high = F.expr(f"array_min(filter(scores, x -> x >= 0)) * {LOW} / 100"), F.expr(f"scores[0] * {HIGH} / 100")
    worse = ranked(serve(asking, placed, *plan(asking, low, high), True, positives, negatives), [*name, "j"], negatives)
    worse = worse.select(*name, "j", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    times = asked.select(F.col("vec_id").alias("anchor_id"), "variant", "times")
    out = repeated(worse.join(best, [*name, "j"]).join(times, name), "times")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
