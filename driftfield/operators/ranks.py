"""Exact order statistics of groups of any size: no task holds the values of a large group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.rounds import forget, written

#: Values that one task may hold and sort; ranges of a pass; tasks that a group's values are dealt over.
SMALL, RANGES, DEAL = 1 << 20, 1024, 32


def group_medians(rows: DataFrame, keys: list[str], value: str, bound: DataFrame | None = None, small: int = SMALL, ranges: int = RANGES) -> DataFrame:
    """keys and median, the exact median of the value, which is finite or null; nulls do not count.

    Where the largest group has at most `small` rows (of `bound`, if that is cheaper to
    count and no smaller), Spark's own aggregate sorts each in memory. Else the two middle
    ranks are narrowed down in passes: values are counted by equal ranges between the
    least and the largest, and the next pass looks into the range that holds the rank,
    until that holds few values or a single one. Each pass is one aggregation.
    """
    largest = (rows if bound is None else bound).groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if largest <= small:
        return rows.groupBy(*keys).agg(F.median(value).alias("median"))
    values = written(rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v")).withColumn("_deal", F.pmod(F.xxhash64("_v", F.monotonically_increasing_id()), F.lit(DEAL)).cast("int")), "values")
    each = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    middle = F.array(*[F.struct(F.lit(i).alias("which"), r.alias("rank")) for i, r in enumerate((F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)))])
    sought = written(each.withColumn("_m", F.explode(middle)).select(*keys, F.col("_m.which").alias("_which"), F.col("_m.rank").alias("_rank"), "_n", "_lo", "_hi"), "ranks")
    few = (F.col("_n") <= small) | (F.col("_lo") == F.col("_hi"))

    def within(some: DataFrame) -> DataFrame:
        return values.join(some.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(DEAL - 1)))), [*keys, "_deal"]).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))

    while not sought.where(~few).isEmpty():
        part = F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * ranges), F.lit(ranges - 1))
        counts = within(sought.where(~few)).withColumn("_part", part).groupBy(*keys, "_which", "_rank", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        before = F.sum("_n").over(Window.partitionBy(*keys, "_which").orderBy("_part")) - F.col("_n")
        held = counts.withColumn("_before", before).where((F.col("_before") <= F.col("_rank")) & (F.col("_rank") < F.col("_before") + F.col("_n")))
        narrowed = held.select(*keys, "_which", (F.col("_rank") - F.col("_before")).alias("_rank"), "_n", "_lo", "_hi")
        last, sought = sought, written(sought.where(few).unionByName(narrowed), "ranks")
        forget(last)
    sure = sought.where("_lo = _hi").select(*keys, "_which", F.col("_lo").alias("_v"))
    found = within(sought.where("_lo < _hi")).groupBy(*keys, "_which", "_rank").agg(F.sort_array(F.collect_list("_v")).alias("_all")).select(*keys, "_which", F.get("_all", F.col("_rank").cast("int")).alias("_v"))
    return sure.unionByName(found).groupBy(*keys).agg(F.avg("_v").alias("median"))
