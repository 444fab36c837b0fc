"""Context-tree weighting over bytes, learned and applied with Spark.

A byte is eight binary decisions. The node of a decision is the last d bytes before it
(d from 0 to DEPTH) and the bits of the byte so far. Each node has a Krichevsky-Trofimov
estimate of its counts, and weighs it against the product of its children, one byte
deeper, by their block probabilities (context-tree weighting). After training the
weights are frozen, so that a byte's probability depends on it and the DEPTH bytes before
it alone: the text's code length is a sum over its (DEPTH + 1)-byte windows.

Grams are counted in map tasks and summed by key. The model is dealt into tasks by the
last two bytes of the context, common ones by the third last too. Documents are dealt into
chunks of a bounded size; a chunk asks for the value of each distinct gram and word in it
once, the answers are computed where the gram's subtree is, and meet the chunk's documents
again. What a chunk asks of a task is one row, an array of sorted keys as differences.
Nothing that grows with the corpus is broadcast or sent to the driver: the driver holds
the nodes of depth 0 and 1, at most 256 * 256, and how many grams end in each two bytes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import DOUBLE, FLAG, LONG, give_back, materialize, schema, tidy

DEPTH = 5
#: UTF-8 bytes of a chunk of documents, about.
CHUNK_BYTES = 16 << 20
#: Bytes whose windows are counted at a time.
BLOCK = 1 << 20
#: Grams of the model in a task, about, and the least number of tasks that hold it.
TASK_GRAMS, TASKS = 50_000, 32
#: Keys that a task holds before it answers them or sends them on, about.
HELD = 1 << 20
#: A task's counts are sent on when they have so many words, or three times as many grams;
#: Spark adds up what a task sends twice before it shuffles.
WORDS = 100_000
#: The subtree below the last two bytes lies in one task if it is small; that below the last three always does.
ROOT = 2
END = b""


def held_out(doc_id: Column) -> Column:
    """Documents kept from training; a null id is not."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 1, F.lit(False))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def word_key(word: bytes) -> int:
    """A negative number for a word; grams have numbers from 0 up."""
    return (xxhash.xxh3_64_intdigest(word) | 1 << 63) - (1 << 64)


def windows(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The grams of all texts in a row, and where each text's begin.

    A text is its words joined by spaces, and one zero byte as its end; the contexts of
    its first bytes are filled with zero bytes.
    """
    pad = b"\0" * DEPTH
    raw = [b" ".join(w) for w in texts]
    sizes = np.array([len(r) + 1 for r in raw], np.int64)
    data = np.frombuffer(pad + (b"\0" + pad).join(raw) + b"\0", np.uint8)
    starts = np.concatenate(([0], np.cumsum(sizes + DEPTH)))[:-1]
    code = np.zeros(len(data) - DEPTH, np.int64)
    for k in range(DEPTH + 1):
        code = (code << 8) | data[k : len(data) - DEPTH + k]
    keep = np.ones(len(code), bool)
    for k in range(DEPTH):  # windows that would end in the next text's padding
        keep[starts[1:] - DEPTH + k] = False
    return code[keep], np.concatenate(([0], np.cumsum(sizes)))[:-1]


def texts_of(column):
    """The texts of an Arrow column, few at a time; null counts as empty."""
    for i in range(0, len(column), 256):
        for x in column.slice(i, 256).to_pylist():
            yield x or ""


def blocks(texts):
    """Lists of the words of whole texts, about BLOCK bytes each."""
    held, size = [], 0
    for t in texts:
        held.append(words_of(t))
        size += len(t)
        if size >= BLOCK:
            yield held
            held, size = [], 0
    if held:
        yield held


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return key, np.bincount(at, np.concatenate([n for _, n in parts]), minlength=len(key)).astype(np.int64)


def _rows(key, n):
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(n, pa.int64())], ["key", "n"])


def count_keys(batches):
    """Partial counts of grams and words, sent on whenever a task's tables are large."""
    grams: list[tuple[np.ndarray, np.ndarray]] = []
    words: dict[bytes, int] = {}
    for b in batches:
        for held in blocks(texts_of(b.column("text"))):
            grams.append(np.unique(windows(held)[0], return_counts=True))
            if len(grams) > 8:
                grams = [merged(grams)]
                if len(grams[0][0]) > 3 * WORDS:
                    yield _rows(*grams.pop())
            for ws in held:
                for w in ws:
                    words[w] = words.get(w, 0) + 1
            words[END] = words.get(END, 0) + len(held)
            if len(words) > WORDS:
                yield _rows([word_key(w) for w in words], list(words.values()))
                words = {}
    if grams:
        yield _rows(*merged(grams))
    if words:
        yield _rows([word_key(w) for w in words], list(words.values()))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x > 0: Stirling's series at x + 8, brought back by the recurrence."""
    y = x + 8
    out = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    for k in range(8):
        out = out - np.log(x + k)
    return out


def block_probability(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Natural logarithm of the Krichevsky-Trofimov probability of a block with these counts."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - math.log(math.pi) - log_gamma(n0 + n1 + 1.0)


def bit_nodes(byte: np.ndarray, bit: int) -> tuple[np.ndarray, np.ndarray]:
    """The bits before this one with a leading 1, and this bit, of each byte."""
    return (1 << bit) | (byte >> (8 - bit)), (byte >> (7 - bit)) & 1


class Level:
    """The nodes of one depth: sorted keys (context * 256 + bits so far) and their counts."""

    def __init__(self, key, n0, n1):
        self.key, self.n0, self.n1 = key, n0, n1
        self.own = block_probability(n0, n1)
        self.below = None

    @classmethod
    def gathered(cls, key, n0, n1):
        key, at = np.unique(key, return_inverse=True)
        return cls(key, np.bincount(at, n0, minlength=len(key)), np.bincount(at, n1, minlength=len(key))), at

    def weigh(self, below=None) -> np.ndarray:
        """Sets the own estimate's weight against the children; returns log block probabilities."""
        self.weight = np.ones(len(self.key)) if below is None else 1 / (1 + np.exp(np.clip(below - self.own, -700, 700)))
        return self.own if below is None else np.logaddexp(self.own, below) - math.log(2)

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.key):
            return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return at, self.key[at] == key


def context(gram: np.ndarray, depth: int) -> np.ndarray:
    return (gram >> 8) & ((1 << 8 * depth) - 1)


def grow(gram: np.ndarray, n: np.ndarray, root: int = ROOT + 1) -> tuple[list[Level], np.ndarray]:
    """Levels DEPTH down to `root` from gram counts, and the block probabilities at `root`."""
    byte = gram & 255
    parts = [bit_nodes(byte, i) for i in range(8)]
    key = np.concatenate([(context(gram, DEPTH) << 8) | node for node, _ in parts])
    bit, count = np.concatenate([b for _, b in parts]), np.tile(n.astype(float), 8)
    level, _ = Level.gathered(key, count * (bit == 0), count * (bit == 1))
    levels, total = [level], level.weigh()
    for depth in range(DEPTH - 1, root - 1, -1):
        child = levels[-1]
        up = (((child.key >> 8) & ((1 << 8 * depth) - 1)) << 8) | (child.key & 255)
        level, at = Level.gathered(up, child.n0, child.n1)
        total = level.weigh(np.bincount(at, total, minlength=len(level.key)))
        levels.append(level)
    return levels, total


def top_levels(key, n0, n1, total) -> list[Level]:
    """Depths ROOT - 1 down to 0 from sums over the subtrees: nodes of depth ROOT - 1."""
    levels = []
    for depth in range(ROOT - 1, -1, -1):
        level, at = Level.gathered(((key >> 8) & ((1 << 8 * depth) - 1)) << 8 | (key & 255), n0, n1)
        total = level.weigh(np.bincount(at, total, minlength=len(level.key)))
        levels.append(level)
        key, n0, n1 = level.key, level.n0, level.n1
    return levels


def log10_probability(gram: np.ndarray, levels: list[Level]) -> np.ndarray:
    """Of each gram's last byte after the bytes before it; levels from DEPTH to 0.

    Where a node was never seen, its parent's own estimate stands alone; with no training
    at all every bit costs one bit.
    """
    byte, out = gram & 255, np.zeros(len(gram))
    for i in range(8):
        node, bit = bit_nodes(byte, i)
        p, known = np.full(len(gram), 0.5), np.zeros(len(gram), bool)
        for depth, level in zip(range(DEPTH, -1, -1), levels):
            at, found = level.find((context(gram, depth) << 8) | node)
            if not found.any():
                continue
            at = at[found]
            n = np.where(bit[found] == 1, level.n1[at], level.n0[at])
            own = (n + 0.5) / (level.n0[at] + level.n1[at] + 1)
            w = np.where(known[found], level.weight[at], 1.0)
            p[found] = w * own + (1 - w) * p[found]
            known |= found
        out += np.log10(p)
    return out


class Slots:
    """Values by integer key, looked up for whole arrays: open addressing with linear probes."""

    def __init__(self, key: np.ndarray, value: np.ndarray):
        self.bits = max(4, int(len(key) * 2).bit_length())
        self.key = np.full(1 << self.bits, -1, np.int64)
        self.value = np.zeros(1 << self.bits)
        todo, at = np.arange(len(key)), self.start(key)
        while len(todo):
            free = self.key[at] == -1
            self.key[at[free]] = key[todo[free]]  # of several keys at a slot one stays
            placed = self.key[at] == key[todo]
            self.value[at[placed]] = value[todo[placed]]
            todo, at = todo[~placed], (at[~placed] + 1) & (len(self.key) - 1)

    def start(self, key):
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, key: np.ndarray) -> np.ndarray:
        """All keys must be there."""
        at = self.start(key)
        wrong = np.flatnonzero(self.key[at] != key)
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & (len(self.key) - 1)
            wrong = wrong[self.key[at[wrong]] != key[wrong]]
        return self.value[at]


@dataclass(frozen=True)
class Plan:
    """Which task holds a key. Each two bytes have a first task and a number of ways, by the byte before them."""

    first: np.ndarray
    ways: np.ndarray
    grams: int
    words: int

    @classmethod
    def of(cls, counts: dict[int, int], n_words: int) -> Plan:
        """From the number of grams that end in each two bytes (of the context) and that of words."""
        n = np.zeros(1 << 8 * ROOT, np.int64)
        n[list(counts)] = list(counts.values())
        ways = np.clip(-(-n // TASK_GRAMS), 1, 256)
        common = ways > 1
        rest = max(TASKS, -(-int(n[~common].sum()) // TASK_GRAMS))
        first = np.where(common, rest + np.cumsum(np.where(common, ways, 0)) - ways, (np.arange(len(n)) * 40503 & 0xFFFF) * rest >> 16)
        return cls(first, ways, rest + int(ways[common].sum()), max(1, n_words // (4 * TASK_GRAMS)))

    @property
    def tasks(self) -> int:
        return self.grams + self.words

    def task_of(self, key: np.ndarray) -> np.ndarray:
        root = (key >> 8) & 0xFFFF
        way = (((key >> 24) & 255) * 167 & 255) * self.ways[root] >> 8
        return np.where(key >= 0, self.first[root] + way, self.grams + key % self.words)


#: Kinds of rows that meet in a task, in order: nodes of depth ROOT, counts of grams or words, and what chunks ask.
NODES, COUNTS, ASKS = range(3)
MET = "task int, kind int, chunk int, keys array<long>, x array<double>, y array<double>, z array<double>"
NUMBERS, KEYS = pa.list_(pa.float64()), pa.list_(pa.int64())


def differences(key: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of sorted runs of keys, each run's first key and then the steps, which compress well."""
    out = np.diff(key, prepend=0)
    out[starts] = key[starts]
    return out


def whole(steps: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The keys again, of runs that begin at the offsets (the last one ends the runs)."""
    key = np.cumsum(steps)
    size = np.diff(offsets)
    begin = offsets[:-1][size > 0]
    return key - np.repeat(key[begin] - steps[begin], size[size > 0])


def arrays(column) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column without nulls, and its offsets into them."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0]


def bundle(plan: Plan, kind: int, key: np.ndarray, values=(), chunk: int = -1, task: np.ndarray | None = None) -> pa.RecordBatch:
    """Rows of sorted keys for each task that holds any, with up to three numbers a key."""
    task = plan.task_of(key) if task is None else task
    order = np.lexsort((key, task))
    key, task = key[order], task[order]
    starts = np.flatnonzero(np.concatenate(([True], task[1:] != task[:-1])))[: len(task)]
    offsets = pa.array(np.concatenate((starts, [len(key)])).astype(np.int32))
    n = len(starts)
    cols = [pa.array(task[starts].astype(np.int32)), pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, chunk, np.int32)), pa.ListArray.from_arrays(offsets, pa.array(differences(key, starts)))]
    cols += [pa.ListArray.from_arrays(offsets, pa.array(np.asarray(v, np.float64)[order])) for v in values]
    cols += [pa.nulls(n, NUMBERS)] * (3 - len(values))
    return pa.RecordBatch.from_arrays(cols, ["task", "kind", "chunk", "keys", "x", "y", "z"])


def bundled_counts(plan: Plan):
    def run(batches):
        held, size = [], 0
        for b in batches:
            held.append((b.column("key").to_numpy(), b.column("n").to_numpy()))
            size += b.num_rows
            if size > HELD:
                yield bundle(plan, COUNTS, np.concatenate([k for k, _ in held]), [np.concatenate([n for _, n in held])])
                held, size = [], 0
        if size:
            yield bundle(plan, COUNTS, np.concatenate([k for k, _ in held]), [np.concatenate([n for _, n in held])])

    return run


def bundled_nodes(plan: Plan):
    """Nodes of depth ROOT for every task that holds a part of their subtree."""
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            key, *values = (b.column(c).to_numpy() for c in ("key", "n0", "n1", "below"))
            ways = plan.ways[key >> 8]
            at = np.repeat(np.arange(len(key)), ways)
            way = np.arange(len(at)) - np.repeat(np.cumsum(ways) - ways, ways)
            yield bundle(plan, NODES, key[at], [v[at] for v in values], task=plan.first[key[at] >> 8] + way)

    return run


def asks(plan: Plan):
    """The distinct grams and words of each chunk, as its documents come."""
    def run(batches):
        held: dict[int, tuple[list, set]] = {}

        def send():
            for c, (grams, words) in held.items():
                yield bundle(plan, ASKS, np.concatenate((np.unique(np.concatenate(grams)), np.array([word_key(w) for w in words], np.int64))), chunk=c)
            held.clear()

        for b in batches:
            chunk = np.array(b.column("chunk").to_pylist(), np.int64)
            for c in np.unique(chunk).tolist():
                grams, words = held.setdefault(c, ([], {END}))
                for some in blocks(texts_of(b.column("text").filter(pa.array(chunk == c)))):
                    grams.append(np.unique(windows(some)[0]))
                    words.update(*some)
                    if len(grams) > 8:
                        grams[:] = [np.unique(np.concatenate(grams))]
            if sum(len(g) for grams, _ in held.values() for g in grams) > 4 * HELD:
                yield from send()
        yield from send()

    return run


def partial_nodes(batches):
    """Sums of the subtrees' block probabilities by node of depth ROOT, from a task's bundles."""
    keys, n = [], []
    for b in batches:
        if b.num_rows:
            steps, offsets = arrays(b.column("keys"))
            keys.append(whole(steps, offsets))
            n.append(arrays(b.column("x"))[0])
    if not keys:
        return
    key, n = np.concatenate(keys), np.concatenate(n)
    if not (key >= 0).any():
        return
    levels, total = grow(key[key >= 0], n[key >= 0])
    leaf = levels[-1]
    up = ((leaf.key >> 8 & ((1 << 8 * ROOT) - 1)) << 8) | (leaf.key & 255)
    key, at = np.unique(up, return_inverse=True)
    sums = [np.bincount(at, x, minlength=len(key)) for x in (leaf.n0, leaf.n1, total)]
    yield pa.RecordBatch.from_arrays([pa.array(key), *map(pa.array, sums)], ["key", "n0", "n1", "below"])


def partial_tops(batches):
    """Sums over the nodes of depth ROOT by node one byte shorter."""
    for b in batches:
        key, n0, n1, below = (b.column(c).to_numpy() for c in ("key", "n0", "n1", "below"))
        up = ((key >> 8 & ((1 << 8 * (ROOT - 1)) - 1)) << 8) | (key & 255)
        total = np.logaddexp(block_probability(n0, n1), below) - math.log(2)
        key, at = np.unique(up, return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(key), *(pa.array(np.bincount(at, x, minlength=len(key))) for x in (n0, n1, total))], ["key", "n0", "n1", "total"])


@dataclass(frozen=True)
class Trained:
    """Counts of grams and words (key, n), the nodes of depth ROOT, the levels above, the plan, and N and V of the words."""

    counts: DataFrame
    nodes: DataFrame
    top: list[Level]
    plan: Plan
    n: float
    v: float


def train(docs: DataFrame) -> Trained:
    """Counts the training documents' grams and words, and weighs all nodes bottom up."""
    training = docs.where(~held_out(F.col("doc_id"))).select("text")
    counts = materialize(training.mapInArrow(tidy(count_keys), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "lm-counts")
    n, v = counts.where("key < 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    roots = counts.where("key >= 0").groupBy((F.shiftright("key", 8) % (1 << 8 * ROOT)).alias("root")).count().collect()
    plan = Plan.of({r["root"]: r["count"] for r in roots}, v)
    grams = counts.where("key >= 0").mapInArrow(tidy(bundled_counts(plan)), MET).select("task", "keys", "x").repartition(plan.tasks, "task")
    sums = [F.sum(c).alias(c) for c in ("n0", "n1", "below")]
    nodes = materialize(grams.mapInArrow(tidy(partial_nodes), "key long, n0 double, n1 double, below double").groupBy("key").agg(*sums), "lm-nodes")
    top = nodes.mapInArrow(partial_tops, "key long, n0 double, n1 double, total double").groupBy("key").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "total")]).orderBy("key").collect()
    cols = [np.array([r[i] for r in top], np.int64 if i == 0 else float) for i in range(4)]
    return Trained(counts, nodes, top_levels(*cols), plan, float(n), float(v))


def answers(top: list[Level]):
    """The values of asked keys: log10 probabilities of grams, counts of words. Rows come by
    task, its nodes and counts first; what is asked is answered HELD keys at a time."""
    def run(batches):
        task, model, levels, pending, size = None, ([], []), None, [], 0

        def build():
            """Levels of this task's grams, or its words' keys and counts."""
            (nodes, counts), none = model, np.zeros(0, np.int64)
            key = np.concatenate([k for k, _ in counts]) if counts else none
            n = np.concatenate([x for _, x in counts]) if counts else np.zeros(0)
            order = np.argsort(key)
            key, n = key[order], n[order]
            gram = key >= 0
            cols = [np.concatenate(c) for c in zip(*nodes)] if nodes else [none, np.zeros(0), np.zeros(0), np.zeros(0)]
            order = np.argsort(cols[0])
            root = Level(*(c[order] for c in cols[:3]))
            root.weigh(cols[3][order])
            return key[~gram], n[~gram], [*grow(key[gram], n[gram])[0], root, *top]

        def answer():
            words, n, tree = levels
            distinct, at = np.unique(np.concatenate([k for _, k in pending]), return_inverse=True)
            value, gram = np.zeros(len(distinct)), distinct >= 0
            for i in range(int(np.count_nonzero(~gram)), len(distinct), 1 << 18):
                value[i : i + (1 << 18)] = log10_probability(distinct[i : i + (1 << 18)], tree)
            if len(words):
                place = np.minimum(np.searchsorted(words, distinct), len(words) - 1)
                value = np.where(~gram & (words[place] == distinct), n[place], value)
            sizes = np.array([len(k) for _, k in pending])
            offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            keys = np.concatenate([k for _, k in pending])
            steps = differences(keys, offsets[:-1][sizes > 0])
            return pa.RecordBatch.from_arrays([pa.array([c for c, _ in pending], pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(steps)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(value[at]))], ["chunk", "keys", "values"])

        for b in batches:
            tasks, kinds, chunks = b.column("task").to_pylist(), b.column("kind").to_pylist(), b.column("chunk").to_pylist()
            for i, (t, kind, c) in enumerate(zip(tasks, kinds, chunks)):
                if t != task:
                    if pending:
                        yield answer()
                    task, model, levels, pending, size = t, ([], []), None, [], 0
                keys = np.cumsum(b.column("keys")[i].values.to_numpy())
                if kind == ASKS:
                    if levels is None:
                        levels, model = build(), ([], [])
                    pending.append((c, keys))
                    size += len(keys)
                    if size > HELD:
                        yield answer()
                        pending, size = [], 0
                else:
                    model[kind].append((keys, *(b.column(x)[i].values.to_numpy().copy() for x in ("xyz" if kind == NODES else "x"))))
        if pending:
            yield answer()

    return run


def score_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: whether it is held out, its tokens, those known from training, the unigram
    base score, the score of the context-tree model, as log10 probabilities, and the model's
    code length in bits per byte (of the words, the spaces between them and the end).

    Null and empty texts are the end alone. Null ids train. Repeated rows train and score as
    often as they occur; further columns are not read. With no training rows every bit
    counts one bit, and each token's base probability is 1.
    """
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    model = train(docs)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = -(-size // CHUNK_BYTES) or 1
    # by the row's place in the input, so that repeated rows are dealt too
    chunk = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(chunks)).cast("int")
    # as many tasks as chunks; not fewer than other shuffles have, or Spark deals the texts anew to meet the answers
    tasks = max(chunks, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = docs.withColumn("held_out", held_out(F.col("doc_id"))).withColumn("chunk", chunk).repartition(tasks, "chunk")
    known = model.counts.mapInArrow(tidy(bundled_counts(model.plan)), MET)
    nodes = model.nodes.mapInArrow(tidy(bundled_nodes(model.plan)), MET)
    met = nodes.unionByName(known).unionByName(placed.mapInArrow(tidy(asks(model.plan)), MET)).repartition(model.plan.tasks, "task").sortWithinPartitions("task", "kind")
    answered = met.mapInArrow(tidy(answers(model.top)), "chunk int, keys array<long>, values array<double>")
    n, every = model.n, math.log10(model.n + 0.5 * (model.v + 1))
    out = schema(doc_id=LONG, held_out=FLAG, n_tokens=LONG, n_known=LONG, train_tokens=LONG, base_score=DOUBLE, score=DOUBLE, bits_per_byte=DOUBLE)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, values = [], []
        for b in right.to_batches():
            if b.num_rows:
                keys.append(whole(*arrays(b.column("keys"))))
                values.append(arrays(b.column("values"))[0])
        del right
        key, value = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((keys, np.int64), (values, float)))
        keys = values = None
        gram = key >= 0
        grams = Slots(key[gram], value[gram])
        key, value = key[~gram], value[~gram]
        order = np.argsort(key)
        key, value = key[order], value[order]
        unknown, rows = float(np.log10(0.5)), []
        for held in blocks(texts_of(left["text"])):
            words = list({w for ws in held for w in ws} | {END})
            known = value[np.searchsorted(key, np.array([word_key(w) for w in words], np.int64))]
            found = dict(zip(words, np.log10(known + 0.5).tolist()))
            code, starts = windows(held)
            bits = np.concatenate([grams.get(code[i : i + (1 << 18)]) for i in range(0, len(code), 1 << 18)])
            sizes = np.diff(starts, append=len(code))
            for ws, total, size in zip(held, np.add.reduceat(bits, starts).tolist(), sizes.tolist()):
                got = [*map(found.__getitem__, ws), found[END]]
                rows.append((len(got), len(got) - got.count(unknown), math.fsum(got) - every * len(got), total, -total / math.log10(2) / size))
        cols = list(zip(*rows)) or [()] * 5
        return pa.Table.from_arrays([left["doc_id"].cast(pa.int64()), left["held_out"], *(pa.array(c, pa.int64()) for c in cols[:2]), pa.array([int(n)] * len(rows), pa.int64()), *(pa.array(c, pa.float64()) for c in cols[2:])], names=out.names)

    def score_and_tidy(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = score(left, right)
        give_back()
        return rows

    return placed.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(score_and_tidy, out)
