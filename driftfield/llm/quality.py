"""Quality rules: word counts of a text, and its repetition from a suffix array over words."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import FLAG, LONG, schema, text_of

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Limits:
    """A text fails the base rules with fewer words, or more percent of words in repeated
    windows; it fails the repetition rules when repeats of at least `repeat` words cover a
    larger part of its words than `covered`, or its longest repeat is over `longest` words."""

    min_words: int = 50
    window: int = 3
    repeat_percent: int = 50
    repeat: int = 8
    covered: float = 0.4
    longest: int = 400


def word_ids(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def suffix_array(ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix order by prefix doubling, and the ranks by the first 1, 2, 4, ... words."""
    n = len(ids)
    rank, ranks, width = ids, [ids], 1
    order = np.argsort(rank, kind="stable")
    while n > 1 and width < n:
        second = np.zeros(n, np.int64)
        second[: n - width] = rank[width:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
        rank = new
        if int(rank[order[-1]]) == n - 1:
            break
        ranks.append(rank)
        width *= 2
    return order, ranks


def common_prefixes(order: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """Length of the common prefix of each suffix and the one before it in the order; first 0.

    Greedy over halving widths: equal ranks of a width are equal words of that width.
    """
    n = len(order)
    a, b, length = order[:-1].copy(), order[1:].copy(), np.zeros(max(0, n - 1), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        w, r = 1 << k, ranks[k]
        fits = (a + w <= n) & (b + w <= n)
        same = fits.copy()
        same[fits] = r[a[fits]] == r[b[fits]]
        a += same * w
        b += same * w
        length += same * w
    return np.concatenate(([0], length)) if n else length


def repeat_lengths(ids: np.ndarray) -> np.ndarray:
    """For each position, the longest prefix from there that occurs elsewhere too."""
    n = len(ids)
    if n < 2:
        return np.zeros(n, np.int64)
    order, ranks = suffix_array(ids)
    lcp = common_prefixes(order, ranks)
    here = np.maximum(lcp, np.concatenate((lcp[1:], [0])))
    out = np.empty(n, np.int64)
    out[order] = here
    return out


def maximal_spans(ids: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the spans of maximal repeats of at least `least` words.

    A suffix's span is the deeper of the two common-prefix intervals it borders; it cannot
    grow to the right, and those that only continue the span one word before are left out.
    """
    length = repeat_lengths(ids)
    grown = np.concatenate(([0], length[:-1])) if len(length) else length
    keep = (length >= least) & (grown != length + 1)
    start = np.flatnonzero(keep)
    return start, length[start]


def covered_words(n: int, start: np.ndarray, length: np.ndarray) -> int:
    """Size of the union of the spans."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + length, -1)
    return int(np.count_nonzero(np.cumsum(edge[:n]) > 0))


def words_in_repeated_windows(ids: np.ndarray, window: int) -> int:
    n = len(ids) - window + 1
    if n < 2:
        return 0
    key, base = ids[:n].copy(), int(ids.max()) + 1
    for k in range(1, window):  # exact: ids are dense, and re-numbered after each step
        key = np.unique(key * base + ids[k : k + n], return_inverse=True)[1]
    twice = np.bincount(key)[key] > 1
    hit = np.zeros(len(ids), bool)
    for k in range(window):
        hit[k : k + n] |= twice
    return int(np.count_nonzero(hit))


def repeated_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return len(lines) - len(set(lines))


def judge(text: str, limits: Limits) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, covered, longest."""
    words = text.encode("utf-8", "surrogatepass").split()  # ASCII white space only
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACE))
    symbols = sum(map(text.count, SYMBOLS))
    ids = word_ids(words)
    repeats = words_in_repeated_windows(ids, limits.window)
    failed = n < limits.min_words or 100 * repeats > limits.repeat_percent * n
    start, length = maximal_spans(ids, limits.repeat)
    covered, longest = covered_words(n, start, length), int(length.max()) if len(length) else 0
    kept = not failed and covered <= limits.covered * n and longest <= limits.longest
    return n, chars, symbols, repeated_lines(text), repeats, failed, kept, covered, longest


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_words", "longest_repeat")


def quality_rules(df: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: the counts, base_failed, kept, and the repetition's cover and longest length.

    Map only. Null and empty texts have no words, so fail. Repeated rows are kept; further
    columns are not read; texts are taken whole.
    """
    out = schema(doc_id=LONG, **{k: FLAG if k in ("base_failed", "kept") else LONG for k in NAMES})

    def run(batches):
        for b in batches:
            found = [judge(t, limits) for t in text_of(b)]
            cols = list(zip(*found)) if found else [[] for _ in NAMES]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64())] + [pa.array(c, pa.bool_() if k in ("base_failed", "kept") else pa.int64()) for k, c in zip(NAMES, cols)], out.names)

    return df.selectExpr(f"`{id_col}` as doc_id", f"`{text_col}` as text").mapInArrow(run, out)


def keep_good(df: DataFrame, limits: Limits = Limits(), text_col: str = "text") -> DataFrame:
    """The rows whose text is kept, with all their columns as they are; null texts go."""
    at = df.columns.index(text_col)

    def run(batches):
        for b in batches:
            mask = [judge(t or "", limits)[6] for t in b.column(at).to_pylist()]
            yield b.filter(pa.array(mask, pa.bool_()))

    return df.mapInArrow(run, df.schema)
