"""Spelling variants: words one edit apart meet by their deletions, and each variant goes to the commonest form.

A word emits itself and its single deletions. Of two words one edit apart either one is a
deletion of the other, or both leave the same rest with the gap at the same place. So rows
meet on (rest, gap), which verifies the distance without comparing pairs: a group of one
rest and gap has at most one word a letter of the alphabet, and is summed up, not paired.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, tidy

#: Letters of a run; code points and occurrences of a word, at least.
LETTERS, LEAST_LENGTH, LEAST_COUNT = "A-Za-zÀ-ÿ", 7, 2
#: One in so many (document, run) pairs has a code point deleted.
EVERY = 31
#: A form occurs at least so many times as often as its variant.
RATIO = 10
#: Up to this length rests are spelled out; longer words, whose rests would add up to the
#: square of their length, go by 127-bit polynomial digests of them.
SPELLED_LENGTH = 64
#: Fixed modulus (a Mersenne prime) and base of the digests.
_PRIME, _BASE = (1 << 127) - 1, 0x9E3779B97F4A7C15F39CC0605CEDC835


def count_words(df: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word and n: runs of letters after the numbered deletions, with how often they occur."""
    runs = F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"([{LETTERS}]{{{least_length},}})"))).alias("run")
    named = df.select(F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("null")).alias("id"), runs)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    plain = F.length("run") == F.octet_length("run")
    small = named.select("id", F.when(plain, F.lower("run")).otherwise(F.translate("run", upper, lower)).alias("run"))
    dealt = small.select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = dealt.select(F.when(F.col("h") % EVERY == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def emitted(words: DataFrame) -> DataFrame:
    """rest, gap, first, word and n: each word whole (gap 0), and without the code point at each gap.

    Gaps inside a run of one letter leave the same rest; the first of them stands for the deletion.
    """
    gap, word = F.col("gap"), F.col("word")
    each = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.when(F.length("word") > SPELLED_LENGTH + 1, 0).otherwise(F.length("word")))).alias("gap"))
    rest = F.when(gap == 0, word).otherwise(F.concat(F.substring(word, F.lit(1), gap - 1), F.substring(word, gap + 1, F.length(word))))
    first = (gap == 1) | (F.substring(word, gap, F.lit(1)) != F.substring(word, gap - 1, F.lit(1)))
    return each.where((gap > 0) | (F.length("word") <= SPELLED_LENGTH)).select(rest.alias("rest"), "gap", ((gap > 0) & first).alias("first"), "word", "n")


def met(rows: DataFrame) -> DataFrame:
    """word, n_near and best, the least (-n, word) of the words near it, from what `emitted` gives."""
    alike, rest = Window.partitionBy("rest", "gap"), Window.partitionBy("rest")
    ordered = alike.orderBy("less", "word")
    rows = rows.withColumn("less", -F.col("n"))
    me, deletion = F.struct("less", "word"), F.col("first")
    seen = rows.select(
        "rest", "gap", "first", "word", "less",
        F.row_number().over(ordered).alias("place"), F.lead(me).over(ordered).alias("second"), F.first(me).over(ordered).alias("top"),
        F.count(F.lit(1)).over(alike).alias("alike"),
        F.min(F.when(F.col("gap") == 0, F.col("less"))).over(rest).alias("whole"),
        F.count(F.when(deletion, 1)).over(rest).alias("longer"), F.min(F.when(deletion, me)).over(rest).alias("longest"),
    )
    swapped = F.when(F.col("place") == 1, F.col("second")).otherwise(F.col("top"))
    shorter = deletion & F.col("whole").isNotNull()
    near = seen.select(
        "word", "gap",
        F.when(F.col("gap") == 0, F.col("longer")).otherwise(F.col("alike") - 1 + shorter.cast("long")).alias("c"),
        F.when(F.col("gap") == 0, F.col("longest")).otherwise(F.least(swapped, F.when(shorter, F.struct(F.col("whole").alias("less"), F.col("rest").alias("word"))))).alias("best"),
    )
    return near.where("c > 0").groupBy("word").agg(F.sum("c").alias("n_near"), F.min("best").alias("best"))


def _long_rests(batches):
    """Digests of a long word's rests, from one pass over it: the rest without code point p has
    the word's digest, without its term and with all terms before it one power lower."""
    for b in batches:
        for word, n in zip(b.column("word").to_pylist(), b.column("n").to_pylist()):
            points, name = [*map(ord, word)], hashlib.md5(word.encode()).digest()
            power, whole, before = 1, 0, 0
            for c in points:
                whole = (whole * _BASE + c) % _PRIME
            powers = []
            for _ in points:
                powers.append(power)
                power = power * _BASE % _PRIME
            rests, gaps, firsts = [whole], [0], [False]
            if len(points) > SPELLED_LENGTH + 1:
                for p, c in enumerate(points):
                    after = (before * _BASE + c) % _PRIME
                    rests.append((whole + (before - after) * powers[-1 - p]) % _PRIME)
                    gaps.append(p + 1)
                    firsts.append(p == 0 or c != points[p - 1])
                    before = after
            size = len(rests)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r.to_bytes(16, "big") for r in rests]), pa.array(gaps, pa.int32()), pa.array(firsts), pa.array([name] * size), pa.array([n] * size, pa.int64())],
                ["rest", "gap", "first", "name", "n"],
            )


def met_long(words: DataFrame) -> DataFrame:
    """What `met` gives, of the words beyond SPELLED_LENGTH, by digests; rows name a word by its MD5."""
    rows = words.mapInArrow(tidy(_long_rests), "rest binary, gap int, first boolean, name binary, n long")
    rows = materialize(rows, "long-rests")
    a, b = rows.alias("a"), rows.alias("b")
    swaps = a.join(b, (F.col("a.rest") == F.col("b.rest")) & (F.col("a.gap") == F.col("b.gap"))).where("a.gap > 0 and a.name <> b.name").select("a.name", F.col("b.name").alias("other"), F.col("b.n").alias("n"))
    cuts = a.join(b, F.col("a.rest") == F.col("b.rest")).where("a.first and b.gap = 0").select(F.col("a.name").alias("long"), F.col("a.n").alias("long_n"), F.col("b.name").alias("short"), F.col("b.n").alias("short_n"))
    pairs = swaps.unionByName(cuts.selectExpr("long as name", "short as other", "short_n as n")).unionByName(cuts.selectExpr("short as name", "long as other", "long_n as n"))
    pairs = materialize(pairs, "long-pairs")
    names = words.select("word", F.unhex(F.md5(F.col("word").cast("binary"))).alias("md5"))
    most = pairs.groupBy("name").agg(F.count(F.lit(1)).alias("n_near"), F.max("n").alias("n"))
    best = pairs.join(most.select("name", "n"), ["name", "n"]).join(names.withColumnRenamed("md5", "other"), "other").groupBy("name").agg(F.min(F.struct((-F.col("n")).alias("less"), "word")).alias("best"))
    out = most.drop("n").join(best, "name").join(names.withColumnRenamed("md5", "name"), "name").select("word", "n_near", "best")
    out = materialize(out, "long-words")
    discard(rows)
    discard(pairs)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """word and root, the last word on the way of forms, from rows (word, form).

    Each round every root is replaced by that root's own, so that ways double; a form is
    at least RATIO times as frequent, so ways have no circles and are logarithmically short.
    """
    ways = materialize(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "ways")
    while not ways.where("moved").isEmpty():
        on = ways.select(F.col("word").alias("at"), F.col("root").alias("to"))
        further = ways.join(on, F.col("root") == F.col("at"), "left").select("word", F.coalesce("to", "root").alias("root"), F.col("to").isNotNull().alias("moved"))
        before, ways = ways, materialize(further, "ways")
        discard(before)
    return ways.select("word", "root")


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n and root of every row of `words` (word, n), whose words are distinct and not null.

    near: differing by one inserted, deleted or replaced code point. form: the near word of
    largest n (ties: least in code-point order) if it is `ratio` times as frequent, else null.
    """
    near = met(emitted(words))
    long = words.where(F.length("word") > SPELLED_LENGTH)
    if not long.isEmpty():
        near = near.unionByName(met_long(long)).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    taken = -F.col("best.less") >= ratio * F.col("n")
    found = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("best.word")).alias("form"), F.when(taken, -F.col("best.less")).alias("form_n"))
    found = materialize(found, "forms")
    return found.join(roots(found.where("form is not null")), "word", "left").withColumn("root", F.coalesce("root", "word"))


def group_variants(df: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the texts.

    Null and empty texts have no words; a null id reads as the word `null` in the deletion
    rule. Repeated rows count as often as they occur, and with them their words. Ties of
    forms go to the least word. Words of any length are met whole. An empty table gives no
    rows; further columns are not read.
    """
    words = materialize(count_words(df, least_length, least_count, id_col, text_col), "words")
    return variants(words, ratio).select("word", "form", "root", "n", "n_near", "form_n")
