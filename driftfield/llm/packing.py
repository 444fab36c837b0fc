"""Optimal length buckets: boundaries by dynamic programming, token-budget batches inside each."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slots

#: Tokens of a piece at most, number of buckets at most, and padded tokens of a batch at most.
MAX_LENGTH, BUCKETS, BUDGET = 2_048, 16, 16_384


def boundaries(counts: dict[int, int], buckets: int) -> list[int]:
    """The upper lengths of at most `buckets` buckets that minimise total padding.

    cost[j] is the least padding of all rows up to the j-th length that occurs, when a
    bucket ends there; each round allows one bucket more. Ties take the earlier cut.
    """
    lengths = np.array(sorted(k for k, n in counts.items() if n > 0), np.int64)
    m = len(lengths)
    if not m:
        return []
    n = np.array([counts[int(x)] for x in lengths], np.float64)
    rows, tokens = np.concatenate(([0.0], np.cumsum(n))), np.concatenate(([0.0], np.cumsum(n * lengths)))
    cost, cuts = np.full(m + 1, np.inf), []
    cost[0] = 0.0
    for _ in range(min(buckets, m)):
        new, cut = np.full(m + 1, np.inf), np.zeros(m + 1, np.int64)
        new[0] = 0.0
        for j in range(1, m + 1):
            total = cost[:j] + lengths[j - 1] * (rows[j] - rows[:j]) - (tokens[j] - tokens[:j])
            cut[j] = int(np.argmin(total))
            new[j] = total[cut[j]]
        cost = new
        cuts.append(cut)
    out, j = [], m
    for cut in reversed(cuts):
        if j == 0:
            break
        out.append(int(lengths[j - 1]))
        j = int(cut[j])
    return out[::-1]


def pieces(docs: DataFrame, max_length: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of at most max_length tokens: the words of a text, then one end token.

    Tokens are runs of characters that are not ASCII white space, not those of a vocabulary.
    Longer texts give several pieces, which cover all their tokens. Null and empty texts
    are one piece that holds the end token only. Texts are read once; their lengths are written.
    """
    n = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")) + 1
    rows = materialize(docs.select(F.col(id_col).alias("doc_id"), n.cast("long").alias("n_tokens"), F.xxhash64(text_col).alias("h")), "lengths")
    split = rows.withColumn("piece", F.explode(F.expr(f"sequence(0L, (n_tokens - 1) div {max_length})")))
    return split.withColumn("start", F.col("piece") * max_length).withColumn("length", F.least(F.lit(max_length).cast("long"), F.col("n_tokens") - F.col("start")))


def pack(docs: DataFrame, max_length: int = MAX_LENGTH, buckets: int = BUCKETS, budget: int = BUDGET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: its bucket, the length it is padded to, its batch and place there.

    The histogram of all lengths has at most max_length rows, whatever the table's size;
    only it reaches the driver. A batch holds budget // boundary pieces of one bucket, the
    last of a bucket maybe fewer. Repeated rows are packed as often as they occur; further
    columns are not read; an empty table packs into nothing.
    """
    if budget < max_length:
        raise ValueError("a batch must hold a piece of the largest length")
    rows = pieces(docs, max_length, id_col, text_col)
    counts = {r.length: r["count"] for r in rows.groupBy("length").count().collect()}
    ends = boundaries(counts, buckets) or [max_length]
    at = F.lit(len(ends) - 1)
    for i in range(len(ends) - 2, -1, -1):
        at = F.when(F.col("length") <= ends[i], i).otherwise(at)
    placed = slots(rows.withColumn("bucket", at), "bucket", ["doc_id", "piece", "h"], "slot")
    boundary = F.element_at(F.array(*map(F.lit, ends)), F.col("bucket") + 1).cast("long")
    each = F.floor(F.lit(budget) / boundary).cast("long")
    return placed.select(
        "doc_id", "piece", "start", "length", "bucket", boundary.alias("padded_to"),
        F.expr("slot").alias("slot"), F.floor(F.col("slot") / each).cast("long").alias("batch"), (F.col("slot") % each).alias("place"),
    ).drop("slot")
