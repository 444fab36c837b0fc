"""Near duplicates by weighted MinHash of word shingles: dart signatures, banded joining, exact check."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, attach, discard, materialize, tidy

#: Words of a shingle, and the least similarity of a link.
WORDS, SIMILARITY = 5, 0.8
#: Coordinates of a signature, in bands of so many. At a similarity of 0.8 a pair misses
#: all bands with a probability of (1 - 0.8**4)**24, about 3 in a million.
BAND, BANDS = 4, 24
COORDINATES = BAND * BANDS
#: Weighted shingles of a bucket that one task compares at a time, about.
PART = 1_500_000
#: Bytes of a task's memo of word hashes.
_HASHES = 64 << 20
_GOLDEN, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (fixed multipliers of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1)."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def weighted_shingles(text: str, hashes: Recent) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles and their weights: how often each occurs. A text of fewer words is one shingle."""
    words = text.encode("utf-8", "surrogatepass").split()
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = len(h) - WORDS + 1
    if len(h) and n < 1:
        n = 1
        h = np.concatenate((h, np.full(WORDS - len(h), len(h), np.uint64)))
    out = np.zeros(max(0, n), np.uint64)
    for k in range(WORDS):
        out = mix(out * _GOLDEN + h[k : k + n])
    key, weight = np.unique(out, return_counts=True)
    return key, weight


def strips(key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
    """The regions under the elements' weights, cut at 1, 2, 4, 8, ...: name, floor, height and the weight.

    An element has as many strips as its weight has binary digits, so a large weight costs
    little more than a small one; weights may be any positive numbers.
    """
    if (weight <= 1).all():
        return key, np.zeros(len(key)), np.ones(len(key)), weight.astype(np.float64)
    levels = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1, 1)
    at = np.repeat(np.arange(len(key)), levels)
    level = np.arange(len(at)) - np.repeat(np.cumsum(levels) - levels, levels)
    floor = np.where(level == 0, 0.0, 2.0 ** (level - 1.0))
    return key[at] + _MIX1 * level.astype(np.uint64), floor, np.where(level == 0, 1.0, floor), weight[at].astype(np.float64)


def darts(region: tuple[np.ndarray, ...], rank: float) -> tuple[np.ndarray, np.ndarray]:
    """Hashed darts under the weights up to a rank: their ranks and names.

    In each strip darts follow each other at exponential gaps over its height, so they fall
    evenly and depend on the strip alone; those that land above the weight are dropped. A
    lower rank limit only cuts the list.
    """
    strip, floor, height, weight = region
    cut, ranks, names, serial, block = floor + height > weight, [], [], 1, max(1, int(rank + 2 * math.sqrt(rank)))
    at = np.zeros(len(strip))
    while len(strip):
        name = mix(strip[:, None] + _GOLDEN * np.arange(serial, serial + block, dtype=np.uint64)[None, :])
        late = at[:, None] + np.cumsum(-np.log(unit(name)), axis=1) / height[:, None]
        inside = late < rank
        under = inside.copy()
        if cut.any():  # only strips that the weight ends in can be hit above it
            landed = floor[cut, None] + height[cut, None] * unit(mix(name[cut] ^ _MIX1))
            under[cut] &= landed < weight[cut, None]
        ranks.append(late[under])
        names.append(name[under])
        on = inside[:, -1]
        strip, floor, height, weight, cut, at = strip[on], floor[on], height[on], weight[on], cut[on], late[on, -1]
        serial, block = serial + block, 2 * block
    return np.concatenate(ranks), np.concatenate(names)


def signature(key: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The earliest dart of each coordinate, for a weighted set that is not empty."""
    region = strips(key, weight)
    rank = COORDINATES * (math.log(COORDINATES) + 3) / float(weight.sum())
    while True:
        at, name = darts(region, rank)
        name = name[np.argsort(at)]
        where, first = np.unique((mix(name ^ _MIX2) % np.uint64(COORDINATES)).astype(np.int64), return_index=True)
        if len(where) == COORDINATES:
            return name[first]
        rank *= 2


def band_keys(sign: np.ndarray) -> np.ndarray:
    rows, out = sign.reshape(BANDS, BAND), np.arange(BANDS, dtype=np.uint64)
    for k in range(BAND):
        out = mix(out * _GOLDEN + rows[:, k])
    return out


def word_hashes() -> Recent:
    return Recent(xxhash.xxh3_64_intdigest, _HASHES)


def content(key: np.ndarray, weight: np.ndarray) -> tuple[int, int]:
    """128 bits that name a weighted set: sums of two hashes of its elements and weights."""
    w = weight.astype(np.uint64)
    return int(mix(mix(key + _MIX1) + w).sum().view(np.int64)), int(mix(mix(key ^ _MIX2) ^ w).sum().view(np.int64))


def _sign(batches):
    hashes = word_hashes()
    for b in batches:
        h1, h2, size, bands = [], [], [], []
        for text in b.column("text").to_pylist():
            key, weight = weighted_shingles(text or "", hashes)
            a, c = content(key, weight)
            h1.append(a)
            h2.append(c)
            size.append(int(weight.sum()))
            bands.append(band_keys(signature(key, weight)).view(np.int64) if len(key) else np.empty(0, np.int64))
        yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id").cast(pa.int64()), b.column("digest"), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(size, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["row", "doc_id", "digest", "h1", "h2", "size", "bands"])


def _sets(batches):
    hashes = word_hashes()
    for b in batches:
        sets = [weighted_shingles(t or "", hashes) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("rep"), pa.array([k.view(np.int64) for k, _ in sets], pa.list_(pa.int64())), pa.array([w.astype(np.int32) for _, w in sets], pa.list_(pa.int32()))], ["rep", "shingles", "weights"])


def prefixes(code: np.ndarray, weight: np.ndarray, member: np.ndarray, often: np.ndarray, size: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The rarest elements of each set, sorted by element: two sets whose rare elements are
    disjoint cannot be similar, as the rest of either weighs less than the overlap that is needed."""
    order = np.lexsort((code, often[code], member))
    code, weight, member = code[order], weight[order], member[order]
    start = np.concatenate(([0], np.cumsum(np.bincount(member, minlength=len(size)))[:-1]))
    total = np.cumsum(weight) - weight
    rare = total - total[start][member] <= (1 - similarity) * size[member] + 1e-9
    code, member = code[rare], member[rare]
    order = np.argsort(code, kind="stable")
    return code[order], member[order]


def group_links(sets: list[tuple[np.ndarray, np.ndarray]], found: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links (places in the list) that connect all members whose sets are similar, directly or by way of others.

    `found` numbers the components known so far. The member that shares most with the
    group goes first, so that a group of copies joins in one pass; then every member
    outside the largest component is held against the members that share one of its rare
    elements. So the result joins just what all pairs would.
    """
    n = len(sets)
    if n < 2 or (found == found[0]).all():
        return []
    weights = [w for _, w in sets]
    size, length = np.array([w.sum() for w in weights]), np.array([len(w) for w in weights])
    flat_weight = np.concatenate(weights)
    _, code, often = np.unique(np.concatenate([k for k, _ in sets]), return_inverse=True, return_counts=True)
    starts = np.concatenate(([0], np.cumsum(length)[:-1]))
    order = np.argsort(-np.add.reduceat(often[code], starts) / length, kind="stable")
    comp, done, links = np.unique(found, return_inverse=True)[1], np.zeros(n, bool), []
    held = np.zeros(len(often), flat_weight.dtype)

    def hold(i, others=None):
        """Ties all of the others' components that member i is near to its own."""
        at = slice(starts[i], starts[i] + length[i])
        held[code[at]] = flat_weight[at]
        if others is None:
            others, both = np.arange(n), np.add.reduceat(np.minimum(flat_weight, held[code]), starts)
        else:
            where = np.concatenate([np.arange(starts[j], starts[j] + length[j]) for j in others])
            both = np.add.reduceat(np.minimum(flat_weight[where], held[code[where]]), np.concatenate(([0], np.cumsum(length[others])[:-1])))
        held[code[at]] = 0
        done[i] = True
        near = (both >= similarity * (size[others] + size[i] - both)) & (comp[others] != comp[i])
        for j in others[near]:
            if comp[j] != comp[i]:
                links.append((i, int(j)))
                comp[comp == comp[j]] = comp[i]

    hold(int(order[0]))
    if (comp == comp[0]).all():
        return links
    rare, owner = prefixes(code, flat_weight, np.repeat(np.arange(n), length), often, size, similarity)
    mine = np.argsort(owner, kind="stable")
    first = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n))))
    for i in order.tolist():
        if done[i] or comp[i] == int(np.argmax(np.bincount(comp))):
            continue
        keys = rare[mine[first[i] : first[i + 1]]]
        low, high = np.searchsorted(rare, keys, "left"), np.searchsorted(rare, keys, "right")
        others = np.unique(np.concatenate([owner[a:b] for a, b in zip(low, high)]))
        others = others[comp[others] != comp[i]]
        if len(others):
            hold(i, others)
    return links


def _compare(similarity: float):
    def run(batches):
        """Rows come sorted by bucket and part, so that each part is whole in a run of rows."""
        key, reps, sets, found = None, [], [], []

        def flush():
            links = group_links(sets, np.array(found), similarity)
            return pa.RecordBatch.from_arrays([pa.array([reps[a] for a, _ in links], pa.int64()), pa.array([reps[b] for _, b in links], pa.int64())], ["a", "b"])

        for b in batches:
            lists, more, keys, parts = b.column("shingles"), b.column("weights"), b.column("key").to_pylist(), b.column("part").to_pylist()
            offsets, values, weights = lists.offsets.to_numpy(), lists.values.to_numpy(), more.values.to_numpy()
            for i, (k, p, r, c) in enumerate(zip(keys, parts, b.column("rep").to_pylist(), b.column("comp").to_pylist())):
                if (k, p) != key:
                    if len(reps) > 1:
                        yield flush()
                    key, reps, sets, found = (k, p), [], [], []
                reps.append(r)
                sets.append((values[offsets[i] : offsets[i + 1]].copy(), weights[offsets[i] : offsets[i + 1]].copy()))
                found.append(c)
        if len(reps) > 1:
            yield flush()

    return run


def components(links: DataFrame) -> DataFrame:
    """rep and comp, the smallest rep that it is connected with, of all reps in links (a, b).

    Alternates: every larger neighbour of a node, then every smaller one, is tied to the
    least of them, until nothing changes. Rounds are written out, so lineage stays short;
    a round's files go once the next one stands.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges, seen = materialize(edges, "links"), None
    while True:
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen or not state[0]:
            return edges.groupBy(F.col("u").alias("rep")).agg(F.min("v").alias("comp")).unionByName(edges.select(F.col("v").alias("rep"), F.col("v").alias("comp")).distinct())
        seen = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        before, edges = edges, materialize(tied.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        discard(before)


#: In a pair of parts (i, j) of a dealt bucket the first is i // SPREAD.
SPREAD = 1 << 24


def paired_parts(apart: DataFrame) -> DataFrame:
    """Rows of dealt buckets with the pairs of parts that they are compared in.

    Members outside their bucket's main component are dealt anew, into `rests` parts numbered
    from `parts` on; each meets every part, two parts a task, and main parts never meet.
    """
    pairs = F.expr(f"transform(sequence(0L, parts - 1), i -> i * {SPREAD} + part)")
    both = F.expr(f"transform(sequence(parts, parts + rests - 1), k -> least(k, part) * {SPREAD} + greatest(k, part))")
    rest = apart.where("comp <> main").withColumn("part", F.expr("parts + pmod(xxhash64(rep, key), rests)")).withColumn("part", F.explode(F.concat(pairs, both)))
    main = apart.where("comp = main").withColumn("part", F.explode(F.expr(f"transform(sequence(parts, parts + rests - 1), k -> part * {SPREAD} + k)")))
    return main.unionByName(rest).select("key", "part", "rep", "comp")


def classify(df: DataFrame, similarity: float = SIMILARITY, part: int = PART, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, the MD5 of its text, the number of its weighted shingles, class_id
    and class_text, a number that only rows of its class have.

    A class is a connected component of texts whose multisets of five-word shingles have a
    weighted Jaccard similarity of at least `similarity`; class_id is its least doc_id, null
    if no row of it has an id. Texts are told apart by their shingles alone: those with the
    same ones are one text from the start, whatever their ids, and unlike texts of one id
    are texts of their own. Texts without words (null, empty, white space) are copies of
    each other. Further columns are not read; repeated rows are members of one class.

    Buckets of a band that have the same members are compared once. A bucket of more than
    `part` shingles is dealt over several tasks; afterwards the members of it that are not
    in its largest component meet all its parts, two parts at a time, so that dealing loses no link.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    docs = docs.withColumn("digest", F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8")))
    signed = docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(tidy(_sign), "row long, doc_id long, digest string, h1 long, h2 long, size long, bands array<long>")
    signed = materialize(signed, "signatures")
    # a text goes by the number of its first row; its shingles are made again from that row's text
    texts = signed.groupBy("h1", "h2").agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("low"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    texts = materialize(texts, "texts")
    banded = texts.where("size > 0").select("rep", "size", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("low"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("who"), F.sum("size").alias("weight")).where("n > 1")
    once = buckets.groupBy("n", "low", "who", "weight").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("weight") / part).cast("long").alias("parts"))
    members = materialize(banded.join(once, "key").select("key", "parts", "rep", "size", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("rep", "key"), F.col("parts"))).otherwise(0).alias("part")), "buckets")
    first = signed.join(members.select(F.col("rep").alias("row")).distinct().hint("merge"), "row")  # grows with the corpus: never broadcast
    wanted = first.select(F.col("row").alias("rep"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "digest").hint("merge")
    text_rows = docs.withColumn("doc_id", F.coalesce("doc_id", F.lit(0))).join(wanted, ["doc_id", "digest"]).select("rep", "text").dropDuplicates(["rep"])
    sets = materialize(text_rows.mapInArrow(tidy(_sets), "rep long, shingles array<long>, weights array<int>"), "shingles")

    def compare(rows: DataFrame) -> DataFrame:
        put = rows.join(sets, "rep").select("key", "part", "rep", "comp", "shingles", "weights").repartition("key", "part").sortWithinPartitions("key", "part")
        return put.mapInArrow(tidy(_compare(similarity)), "a long, b long")

    links = materialize(compare(members.withColumn("comp", F.col("rep"))), "links")
    comps = components(links)
    large = members.where("parts > 1")
    if not large.isEmpty():
        placed = materialize(large.join(comps, "rep", "left").withColumn("comp", F.coalesce("comp", "rep")), "large-buckets")
        by_comp = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("weight"))
        main = by_comp.groupBy("key").agg(F.max(F.struct("n", "comp", "weight")).alias("m"), F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
        main = main.select("key", F.col("m.comp").alias("main"), F.ceil((F.col("weight") - F.col("m.weight")) / part).cast("long").alias("rests"))
        comps = components(links.unionByName(compare(paired_parts(placed.join(main, "key")))))
    named = texts.select("h1", "h2", "rep", "n", "low").join(comps, "rep", "left").withColumn("class_text", F.coalesce("comp", "rep"))
    named = materialize(named.select("h1", "h2", "n", "low", "class_text"), "named")
    classes = materialize(named.groupBy("class_text").agg(F.min("low").alias("class_id"), F.count(F.lit(1)).alias("n")), "classes")
    named = materialize(attach(named.drop("low"), classes, ["class_text"]), "named")
    out = attach(signed.select("doc_id", "digest", "size", "h1", "h2"), named, ["h1", "h2"])
    return out.select("doc_id", "digest", F.col("size").alias("n_shingles"), "class_id", "class_text")


def near_duplicates(df: DataFrame, similarity: float = SIMILARITY, part: int = PART, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, class_id and the number of weighted shingles, as `classify` finds them."""
    return classify(df, similarity, part, id_col, text_col).select("doc_id", "class_id", "n_shingles")


def keep_one(df: DataFrame, similarity: float = SIMILARITY, part: int = PART, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, with all its columns as they are.

    The row of the least id stays, one without id only where no row of the class has any,
    and of unlike texts of that id the one of the least MD5. Of rows that agree in id and
    text any one stays. Null and empty texts are one class. An empty table stays empty.
    """
    def row_of(doc_id, digest):
        return F.md5(F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("null")), digest))

    name = "_row"
    while name in df.columns:
        name += "_"
    kept = classify(df, similarity, part, id_col, text_col).groupBy("class_text").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "digest")).alias("r"))
    kept = kept.select(row_of(F.col("r.doc_id"), F.col("r.digest")).alias(name)).hint("merge")
    keyed = df.withColumn(name, row_of(F.col(id_col).cast("long"), F.md5(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8"))))
    return keyed.join(kept, name, "left_semi").dropDuplicates([name]).drop(name)
