"""Small helpers that the operators share."""

from __future__ import annotations

import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new path below the cluster's shared checkpoint folder.

    Where spark.checkpoint.dir and the context's checkpoint folder are unset, a folder is
    chosen here for a local master only; on a cluster that is an error, as executors do not
    share folders of a machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        chosen = spark.sparkContext._jsc.sc().getCheckpointDir()
        if chosen.isDefined():
            root = chosen.get()
        elif spark.sparkContext.master.startswith("local"):
            root = f"file:///tmp/spark-checkpoints-{uuid.uuid4().hex[:8]}"
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back, which also cuts its lineage."""
    path = shared_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Removes the files of a materialized frame that nothing reads any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


#: Equal rows that one array of numbers spells out, at most.
SPELLED = 1 << 16


def repeated(df: DataFrame, times: str) -> DataFrame:
    """Each row as often as its column `times` says, without that column."""
    part = df.withColumn("_part", F.explode(F.expr(f"sequence(0L, ({times} - 1) div {SPELLED})")))
    each = part.withColumn("_each", F.explode(F.expr(f"sequence(1L, least({SPELLED}L, {times} - _part * {SPELLED}))")))
    return each.drop(times, "_part", "_each")


#: A key is hot if it holds more than one in so many rows; there are fewer hot keys than that.
HOT = 256


def attach(rows: DataFrame, lookup: DataFrame, keys: list[str], count: str = "n") -> DataFrame:
    """Left join of rows with a lookup that has one row per key and `count`, the rows that hold it.

    Rows of hot keys are dealt over HOT tasks, and the lookup's rows of those keys, fewer
    than HOT, go to each of them; what is broadcast is those keys alone. The lookup is read
    three times, so it should be written out. Keys are not null.
    """
    total = lookup.agg(F.sum(count)).first()[0] or 0
    is_hot = F.col(count) * HOT > total
    hot = lookup.where(is_hot).select(*keys, F.lit(True).alias("_hot"))
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.when(F.col("_hot"), F.monotonically_increasing_id() % HOT).otherwise(0))
    copies = lookup.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0).cast("long"), F.lit(HOT - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))))
    return dealt.join(copies.drop(count), [*keys, "_salt"], "left").drop("_hot", "_salt")


class Recent(dict):
    """A memo of two generations, bounded in bytes: `compute(key)` fills misses; a full young
    generation becomes the old one, so that what is in use survives.

    Keys longer than `longest` are computed each time. Of texts and byte strings the bytes
    count, and `overhead` for each entry.
    """

    def __init__(self, compute, most_bytes: int, longest: int = 1024, overhead: int = 200):
        super().__init__()
        self.compute, self.most, self.longest, self.overhead, self.size, self.old = compute, most_bytes // 2, longest, overhead, 0, {}

    def __missing__(self, key):
        if len(key) > self.longest:
            return self.compute(key)
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        self.size += self.overhead + 4 * len(key) + (len(value) if isinstance(value, (str, bytes)) else 0)
        if self.size > self.most:
            self.old, self.size = dict(self), 0
            self.clear()
        self[key] = value
        return value


def give_back() -> None:
    """Returns freed memory to the system: workers are used again, and two share an executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run):
    """A map function over batches that gives its memory back once its task is done."""
    def whole(batches):
        yield from run(batches)
        give_back()

    return whole


def text_of(batch, name: str = "text") -> list[str]:
    """The texts of an Arrow batch; null counts as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def _cell_of(order: list[str], n: int):
    """By the digest of the order columns, so that any engine can number the rows alike."""
    digest = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in order]))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % F.lit(n)).cast("int")


def slots(df: DataFrame, group: str, order: list[str], out: str, per_cell: int = 4096) -> DataFrame:
    """Adds `out`: a gapless number from 0 within each value of `group`, which is not null.

    Equal rows are counted first and written once, so that df is made once and a row that
    occurs very often is one row until the end. Each group is cut by a hash of its rows'
    order columns into cells of about `per_cell` rows; cells are numbered by one window over
    their counts, rows by a window inside their cell. So a group of any size is spread over
    many tasks, and equal inputs give equal numbers. Rows that agree in group and order
    columns but not in others are numbered in any order.
    """
    equal = materialize(df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n")), "equal-rows")
    rows, most = equal.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("_n"), F.lit(0))).first()
    cell = equal.withColumn("_cell", _cell_of(order, max(1, -(-rows // per_cell))))
    before = "coalesce(sum(_n) over (partition by {} order by {} rows between unbounded preceding and 1 preceding), 0)"
    starts = cell.groupBy(group, "_cell").agg(F.sum("_n").alias("_n")).select(F.col(group).alias("_g"), F.col("_cell").alias("_c"), F.expr(before.format(group, "_cell")).alias("_start"))
    inside = cell.withColumn("_rank", F.expr(before.format(f"{group}, _cell", ", ".join(order))))
    placed = inside.join(starts, (F.col(group) == F.col("_g")) & (F.col("_cell") == F.col("_c"))).withColumn("_start", F.col("_start") + F.col("_rank"))

    def spelled(some: DataFrame) -> DataFrame:
        number = F.expr(f"explode(sequence(_part * {SPELLED}, least(_n, (_part + 1) * {SPELLED}) - 1))")
        return some.select(*df.columns, "_start", number.alias("_k")).select(*df.columns, (F.col("_start") + F.col("_k")).cast("long").alias(out))

    each = spelled(placed.where(f"_n <= {SPELLED}").withColumn("_part", F.lit(0).cast("long")))
    if most <= SPELLED:
        return each
    parts = placed.where(f"_n > {SPELLED}").withColumn("_part", F.expr(f"explode(sequence(0L, (_n - 1) div {SPELLED}))"))
    return each.unionByName(spelled(parts.repartition("_start", "_part")))


LONG, TEXT, FLAG, DOUBLE, INT = T.LongType(), T.StringType(), T.BooleanType(), T.DoubleType(), T.IntegerType()


def schema(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v, True) for k, v in fields.items()])
