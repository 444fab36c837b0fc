"""The graph of the places that a session has: shortest ways by relaxation, steps along them, and routes between wells."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.rounds import forget, written
from .batches import score_matrices
from .models import by_event, deals
from .tracks import Grid


def place_edges(places: DataFrame, grid: Grid, diagonal: bool = True) -> DataFrame:
    """session, src, dst and length: from each place of a session to those beside it, and over corners if wanted.

    places: session, bin_id, each once. An equi join with the places that the moves reach.
    """
    moves = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (dx or dy) and (diagonal or not (dx and dy))]
    ix, iy = F.floor(F.col("bin_id") / grid.ny).cast("int"), F.col("bin_id") % grid.ny
    each = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(grid.size * math.hypot(dx, dy)).alias("length")) for dx, dy in moves]))
    out = places.select("session", F.col("bin_id").alias("src"), ix.alias("_x"), iy.alias("_y"), each.alias("m"))
    out = out.withColumn("_x", F.col("_x") + F.col("m.dx")).withColumn("_y", F.col("_y") + F.col("m.dy")).where(F.col("_x").between(0, grid.nx - 1) & F.col("_y").between(0, grid.ny - 1))
    to = places.select(F.col("session").alias("_s"), F.col("bin_id").alias("dst"))
    dst = F.col("_x") * grid.ny + F.col("_y")
    return out.join(to, (F.col("session") == F.col("_s")) & (dst == F.col("dst"))).select("session", "src", "dst", F.col("m.length").alias("length"))


def shortest_ways(edges: DataFrame, sources: DataFrame, longest: float | None = None) -> DataFrame:
    """session, src, dst and distance of every pair that a way joins, from each source (session, src).

    Each round goes one edge on from the pairs that the last one shortened, keeps the least
    length of each pair, and writes what it knows; it ends when nothing gets shorter. With
    `longest`, ways beyond it are not followed, so that work is what lies within it. A
    source reaches itself at distance 0; pairs without a way have no row. Of equal edges the
    shortest counts.
    """
    known = written(sources.select("session", "src", F.col("src").alias("dst"), F.lit(0.0).alias("distance"), F.lit(True).alias("new")).distinct(), "ways")
    while not known.where("new").isEmpty():
        step = edges.select("session", F.col("src").alias("dst"), F.col("dst").alias("to"), "length")
        further = known.where("new").join(step, ["session", "dst"]).select("session", "src", F.col("to").alias("dst"), (F.col("distance") + F.col("length")).alias("distance"))
        if longest is not None:
            further = further.where(F.col("distance") <= longest)
        both = known.select("session", "src", "dst", "distance", F.lit(0).alias("_late")).unionByName(further.withColumn("_late", F.lit(1)))
        best = both.groupBy("session", "src", "dst").agg(F.min("distance").alias("distance"), F.min(F.when(F.col("_late") == 0, F.col("distance"))).alias("_had"))
        # rounding of sums in another order is no shorter way
        shorter = F.col("_had").isNull() | (F.col("distance") < F.col("_had") - 1e-9)
        new = best.select("session", "src", "dst", F.when(shorter, F.col("distance")).otherwise(F.col("_had")).alias("distance"), shorter.alias("new"))
        before, known = known, written(new, "ways")
        forget(before)
    return known.drop("new")


def way_components(ways: DataFrame) -> DataFrame:
    """session, bin_id and component, the least place that it reaches by any way."""
    return ways.groupBy("session", F.col("src").alias("bin_id")).agg(F.min("dst").alias("component"))


def way_steps(ways: DataFrame, sigma: float, truncate: float = 4.0, stay: float = 0.0) -> DataFrame:
    """session, src, dst and probability: a normal law of the way's length round each place, cut at `truncate` deviations.

    `stay` is a chance of its own to remain.
    """
    near = ways.where(F.col("distance") <= truncate * sigma).withColumn("_w", F.exp(-0.5 * (F.col("distance") / sigma) ** 2))
    p = F.col("_w") / F.sum("_w").over(Window.partitionBy("session", "src")) * (1 - stay) + F.when(F.col("src") == F.col("dst"), stay).otherwise(0.0)
    return near.withColumn("probability", p).select("session", "src", "dst", "probability")


def way_matrices(steps: DataFrame, places: int) -> DataFrame:
    """session and matrix: the steps (session, src, dst, probability) of each session as an array of arrays [dst, src]."""
    row = F.array_repeat(F.lit(0.0), places)
    fill = lambda pairs: F.transform(F.sequence(F.lit(0), F.lit(places - 1)), lambda b: F.coalesce(F.element_at(pairs, b), F.lit(0.0)))
    rows = steps.groupBy("session", "dst").agg(fill(F.map_from_entries(F.collect_list(F.struct("src", "probability")))).alias("r"))
    whole = rows.groupBy("session").agg(F.map_from_entries(F.collect_list(F.struct("dst", "r"))).alias("m"))
    return whole.select("session", F.transform(F.sequence(F.lit(0), F.lit(places - 1)), lambda b: F.coalesce(F.element_at("m", b), row)).alias("matrix"))


def score_ways(emissions: DataFrame, steps: DataFrame | None, places: int, model: str) -> DataFrame:
    """Evidence and last law of each event under its session's steps (session, src, dst, probability), over whole batches of events.

    Only places with steps are there, at even odds in the first bin. Events of sessions
    without any have no row. A session's steps are one matrix of places^2 numbers, which
    stands before the events of each of the session's parts; emissions that were made
    beside it (`models.event_emissions`) need no steps.
    """
    if "matrix" in emissions.columns:
        return score_matrices(emissions, places, model)
    tasks = deals(emissions)
    parts = F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))
    dealt_rows = by_event(emissions).select("session", "event_index", "bins").withColumn("part", F.pmod(F.xxhash64("event_index"), F.lit(tasks)).cast("int"))
    both = dealt_rows.unionByName(way_matrices(steps, places).withColumn("part", parts), allowMissingColumns=True).repartition(tasks, "session", "part")
    return score_matrices(both.sortWithinPartitions("session", "part", F.col("matrix").isNull()), places, model)


def well_routes(wells: DataFrame, both_ways: bool = True) -> DataFrame:
    """session, route, place_no, well_id, x and y: the ordered waypoints of a route from each well to each other one.

    wells: session, well_id, x, y. Routes are numbered within a session by their ends.
    """
    a, b = (wells.select("session", *[F.col(c).alias(f"{n}_{c}") for c in ("well_id", "x", "y")]) for n in "ab")
    met = a.join(b, "session").where("a_well_id <> b_well_id" if both_ways else "a_well_id < b_well_id")
    numbered = met.withColumn("route", F.row_number().over(Window.partitionBy("session").orderBy("a_well_id", "b_well_id")) - 1)
    ends = F.array(*[F.struct(F.lit(k).alias("place_no"), *[F.col(f"{n}_{c}").alias(c) for c in ("well_id", "x", "y")]) for k, n in enumerate("ab")])
    return numbered.select("session", "route", F.explode(ends).alias("w")).select("session", "route", "w.*")


def route_labels(points: DataFrame, routes: DataFrame, keys: list[str]) -> DataFrame:
    """points (session, keys, x, y) with the nearest route: route, the distance to it and how far along it the point lies, from 0 to 1.

    A route's pieces are the lines between its waypoints. Ties go to the smaller route.
    Points of sessions without routes keep null labels.
    """
    w = Window.partitionBy("session", "route").orderBy("place_no")
    piece = routes.withColumn("_n", F.max("place_no").over(Window.partitionBy("session", "route"))).withColumns({f"_{c}2": F.lead(c).over(w) for c in ("x", "y")}).where("_x2 is not null")
    piece = piece.select("session", "route", F.col("place_no").alias("_k"), "_n", F.col("x").alias("_x1"), F.col("y").alias("_y1"), "_x2", "_y2")
    # a point meets its session's pieces as one array and is not copied: the pieces are as few as pairs of wells
    pieces = piece.groupBy("session").agg(F.collect_list(F.struct("route", "_k", "_n", "_x1", "_y1", "_x2", "_y2")).alias("_pieces"))

    def near(p):
        dx, dy = p["_x2"] - p["_x1"], p["_y2"] - p["_y1"]
        along = F.when(dx * dx + dy * dy > 0, ((F.col("x") - p["_x1"]) * dx + (F.col("y") - p["_y1"]) * dy) / (dx * dx + dy * dy)).otherwise(0.0)
        u = F.least(F.greatest(along, F.lit(0.0)), F.lit(1.0))
        ax, ay = F.col("x") - p["_x1"] - u * dx, F.col("y") - p["_y1"] - u * dy
        # routes that share an end agree there but for rounding
        return F.struct(F.round(F.sqrt(ax * ax + ay * ay), 9).alias("_d"), p["route"].alias("route"), p["_k"].alias("_k"), u.alias("_u"), p["_n"].alias("_n"))

    best = points.join(F.broadcast(pieces), "session", "left").withColumn("b", F.array_min(F.transform("_pieces", near)))
    return best.select(*points.columns, F.col("b.route").alias("route"), F.col("b._d").alias("route_distance"), ((F.col("b._k") + F.col("b._u")) / F.col("b._n")).alias("route_progress"))
