"""SimHash fingerprints of documents and the search for those within a Hamming radius, in DataFrame functions alone."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, materialize, repeated

#: Bits of a fingerprint, and those in which near fingerprints may differ.
BITS, RADIUS = 64, 3
#: Blocks of the tables: all but RADIUS of them are equal in some table, whichever bits differ.
#: Fine tables leave 12 bits free, so that a bucket of theirs holds at most 4,096 fingerprints.
BLOCKS, FINE_BLOCKS = 6, 16
#: A fingerprint in a bucket of more than so many is crowded: it meets other crowded ones in the fine tables.
CROWD = 64
#: Two counters of 32 bits in one number: bits i and i + 32.
_LANES = 0x0000000100000001
_LOW = 0xFFFFFFFF
_SPACE = "[\\x20\\x09-\\x0D]+"


def signed(x: int) -> int:
    """A 64-bit pattern as the number that Spark has for it."""
    return x - (1 << 64) if x >> 63 else x


def simhash(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys and fp: the fingerprint of each row's text, 0 for one without words. Keys name rows; texts are not null.

    The terms are the distinct words between ASCII white space, each with its number of
    code points as weight. A term's hash votes with that weight on every bit, for it where
    the hash has a one and against it elsewhere; ties give 0.
    """
    terms = df.select(*keys, F.explode(F.array_distinct(F.split(text, _SPACE))).alias("term"))  # an empty term has no weight
    hashed = terms.select(*keys, F.xxhash64("term").alias("h"), F.length("term").cast("long").alias("w"))
    lanes = [F.sum(F.col("w") * F.shiftright("h", i).bitwiseAND(F.lit(_LANES))).alias(f"s{i}") for i in range(BITS // 2)]
    votes = hashed.groupBy(*keys).agg(F.sum("w").alias("w"), *lanes)
    fp = F.lit(0).cast("long")
    for i in range(BITS // 2):
        low, high = F.col(f"s{i}").bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(f"s{i}", 32)
        for bit, ones in ((i, low), (i + BITS // 2, high)):
            fp = fp.bitwiseOR(F.when(2 * ones > F.col("w"), F.lit(signed(1 << bit)).cast("long")).otherwise(0))
    return votes.select(*keys, fp.alias("fp"))


def likeness(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), BITS // 4, "0"))


def masks(blocks: int, free: int) -> list[tuple[int, int, list[int]]]:
    """Of each table: its number, the bits that its key keeps, and the free blocks below its last kept one.

    A pair meets in every table that frees all blocks in which it differs. It counts in the
    one that keeps the lowest of its equal blocks: there all of those free blocks differ.
    """
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    block = [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:])]
    out = []
    for number, freed in enumerate(combinations(range(blocks), free)):
        last = max(i for i in range(blocks) if i not in freed)
        out.append((number, signed(((1 << BITS) - 1) & ~sum(block[i] for i in freed)), [signed(block[i]) for i in freed if i < last]))
    return out


def tables(fps: DataFrame, blocks: int, radius: int) -> DataFrame:
    """Rows of fps (fp and more) with `at` and `key`, for each table: what its permutation puts first."""
    each = F.array(*[F.struct(F.lit(n).cast("int").alias("at"), F.lit(kept).cast("long").alias("kept")) for n, kept, _ in masks(blocks, radius)])
    return fps.select("*", F.explode(each).alias("t")).select(*fps.columns, "t.at", F.col("fp").bitwiseAND(F.col("t.kept")).alias("key"))


def neighbours(rows: DataFrame, blocks: int, radius: int) -> DataFrame:
    """fp and near (an array) of the fingerprints of each bucket (at, key) that are near and count there.

    Rows (at, key, fp, crowded): two crowded ones do not meet if `crowded` is set for both.
    """
    gaps = F.array(*[F.array(*map(F.lit, g)).cast("array<bigint>") for _, _, g in masks(blocks, radius)])
    buckets = rows.groupBy("at", "key").agg(F.collect_list(F.struct("fp", "crowded")).alias("all")).where(F.size("all") > 1)
    buckets = buckets.select("all", F.get(gaps, F.col("at")).alias("gaps"))
    near = F.expr(f"""transform(all, a -> struct(a.fp as fp, transform(filter(all, b -> a.fp <> b.fp and bit_count(a.fp ^ b.fp) <= {radius}
        and not (a.crowded and b.crowded) and forall(gaps, g -> (a.fp ^ b.fp) & g <> 0)), b -> b.fp) as near))""")
    return buckets.select(F.inline(F.filter(near, lambda x: F.size(x["near"]) > 0)))


def near_fingerprints(fps: DataFrame, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """fp and near, arrays of all other fingerprints within the radius; each in one array of a row's fp.

    fps: distinct fingerprints, not null. Of BLOCKS blocks some table keeps just the equal
    ones, so no pair is missed. Buckets of more than `crowd` fingerprints, which near copies
    of one text make, are not compared: their members meet in the fine tables, whose
    buckets have few free bits, so work stays in proportion to fingerprints.
    """
    rows = tables(fps.select("fp"), BLOCKS, radius)
    sizes = rows.groupBy("at", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = materialize(rows.join(sizes, ["at", "key"]), "shared-buckets")
    crowded = shared.where(F.col("n") > crowd).select("fp", F.lit(True).alias("crowded")).distinct()
    crowded = materialize(crowded, "crowded")
    small = shared.where(F.col("n") <= crowd).join(crowded, "fp", "left").withColumn("crowded", F.coalesce("crowded", F.lit(False)))
    found = neighbours(small, BLOCKS, radius)
    if crowded.isEmpty():
        return found
    fine = tables(crowded.select("fp", F.lit(False).alias("crowded")), FINE_BLOCKS, radius)
    return found.unionByName(neighbours(fine, FINE_BLOCKS, radius))


def next_rows(slim: DataFrame) -> DataFrame:
    """key, doc_id, n_chars, next_key and times from rows (key, doc_id, n_chars, n), whose keys are distinct.

    The order is by descending doc_id, null last, then by key; after the last comes the
    first. Of n equal rows all but one are followed by an equal one. Only these numbers are
    sorted, in ranges; what crosses the edge of a range is one key of each.
    """
    ranged = materialize(slim.repartitionByRange(F.col("doc_id").desc_nulls_last(), "key").withColumn("task", F.spark_partition_id()), "order")
    placed = ranged.withColumn("following", F.expr("lead(key) over (partition by task order by doc_id desc nulls last, key)")).withColumn("place", F.expr("row_number() over (partition by task order by doc_id desc nulls last, key)"))
    firsts = placed.where("place = 1").select(F.col("task").alias("t"), F.expr("coalesce(lead(key) over (order by task), first_value(key) over (order by task))").alias("edge"))
    pairs = placed.join(firsts, F.col("task") == F.col("t")).select("key", "doc_id", "n_chars", F.coalesce("following", "edge").alias("next_key"), "n")
    again = pairs.where("n > 1").select("key", "doc_id", "n_chars", F.col("key").alias("next_key"), (F.col("n") - 1).alias("times"))
    return pairs.select("key", "doc_id", "n_chars", "next_key", F.lit(1).cast("long").alias("times")).unionByName(again)


def fingerprint_documents(df: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and
    n_near, the number of other fingerprints within the radius, of every row.

    The edited text has its last third replaced by the beginning of the next row's text, as
    `next_rows` orders them. Null and empty texts have no words and the fingerprint 0; a text
    of fewer than three code points is its own edited text, and a single row its own next.
    Equal rows follow each other, so that all but one of them are edited by their own text.
    An empty table gives no rows; further columns are not read.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    named = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("|"), "text").cast("binary")))
    docs = docs.select(named.alias("key"), "doc_id", "text")
    slim = docs.select("key", "doc_id", F.length("text").alias("n_chars")).groupBy("key", "doc_id", "n_chars").agg(F.count(F.lit(1)).alias("n"))
    pairs = materialize(next_rows(slim), "next-rows")
    # texts are dealt by key once, for both joins; a piece goes to the text that it is for
    texts, take = docs.select("key", "text").dropDuplicates(["key"]), F.floor(F.col("n_chars") / 3).cast("int")
    pieces = pairs.join(texts.select(F.col("key").alias("next_key"), "text").hint("merge"), "next_key").select(*pairs.columns, F.substring("text", F.lit(1), take).alias("piece"))
    both = pieces.join(texts.hint("merge"), "key").withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars") - take), "piece"))
    row = [*pairs.columns, "edited_sha256"]
    bodies = both.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).select(*row, F.posexplode(F.array("text", "edited")).alias("which", "body"))
    prints = simhash(bodies, [*row, "which"], "body").groupBy(*row).agg(F.max(F.when(F.col("which") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("which") == 1, F.col("fp"))).alias("edited"))
    prints = materialize(prints, "fingerprints")
    fps = prints.groupBy("fp").agg(F.sum("times").alias("n"))
    near = near_fingerprints(fps, radius).groupBy("fp").agg(F.sum(F.size("near")).alias("n_near"))
    counts = materialize(fps.join(near, "fp", "left").select("fp", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near")), "near-counts")
    following = prints.select(F.col("key").alias("next_key"), F.col("fp").alias("next_fp")).dropDuplicates(["next_key"])
    out = attach(prints.join(following, "next_key"), counts, ["fp"])
    out = repeated(out, "times")
    return out.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", hexadecimal(F.col("fp")).alias("fingerprint"), hexadecimal(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), "n_near")
