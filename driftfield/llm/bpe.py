"""Byte-level BPE: a minimal perfect hash for whole pre-tokens, a heap over linked bytes for the rest."""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from .common import LONG, TEXT, Recent, schema, text_of

#: Bytes of a worker's memo of encoded pre-tokens, about.
MEMO = 160 << 20
#: Stands for no part; no pair with it has a rank.
NONE = 0xFFFFFFFF


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = [b""] * (max(int(r) for _, r in pairs) + 1)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class PerfectHash:
    """Hash and displace: a key's bucket holds the seed that sends its keys to free slots.

    n keys fill n slots. Buckets of one key, placed last, hold their slot itself
    (as -1 - slot). A looked-up key is compared with the slot's key, so others miss.
    """

    def __init__(self, keys: list[bytes], load: int = 2):
        n = self.n = len(keys)
        self.buckets = max(1, n // load)
        self.seeds = np.zeros(self.buckets, np.int64)
        self.at = np.full(n, -1, np.int64)
        self.keys = keys
        groups: dict[int, list[int]] = {}
        hashes = [xxhash.xxh3_128_intdigest(k) for k in keys]
        for i, h in enumerate(hashes):
            groups.setdefault((h >> 64) % self.buckets, []).append(i)
        taken, single = bytearray(n), []
        for b, members in sorted(groups.items(), key=lambda x: -len(x[1])):
            if len(members) == 1:
                single.append((b, members[0]))
                continue
            seed = 0
            while True:
                spots = {self.spot(hashes[i], seed) for i in members}
                if len(spots) == len(members) and not any(taken[s] for s in spots):
                    break
                seed += 1
            self.seeds[b] = seed
            for i in members:
                s = self.spot(hashes[i], seed)
                taken[s], self.at[s] = 1, i
        free = (s for s in range(n) if not taken[s])
        for b, i in single:
            s = next(free)
            self.seeds[b], self.at[s] = -1 - s, i
        self.seeds, self.at = self.seeds.tolist(), self.at.tolist()  # faster to index one by one

    def spot(self, h: int, seed: int) -> int:
        low = h & 0xFFFFFFFFFFFFFFFF
        return ((low & 0xFFFFFFFF) + seed * ((low >> 32) | 1) + seed * seed) % self.n

    def find(self, key: bytes) -> int:
        """The key's index, or -1."""
        if not self.n:
            return -1
        h = xxhash.xxh3_128_intdigest(key)
        seed = self.seeds[(h >> 64) % self.buckets]
        i = self.at[-1 - seed if seed < 0 else self.spot(h, seed)]
        return i if self.keys[i] == key else -1


class BytePairs:
    """Encodes one pre-token. The whole pre-token is looked up first; otherwise adjacent
    parts merge, lowest rank first and leftmost among equals, until none can."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.whole = PerfectHash([t for t in tokens if t])
        self.rank_of = [r for r, t in enumerate(tokens) if t]
        ranks = {t: r for r, t in enumerate(tokens) if t}
        self.byte = [ranks[bytes([b])] for b in range(256)]
        #: (left rank, right rank) as one integer -> the rank of both together
        self.joined = {}
        for t, r in ranks.items():
            for cut in range(1, len(t)):
                a, b = ranks.get(t[:cut]), ranks.get(t[cut:])
                if a is not None and b is not None:
                    self.joined[a << 32 | b] = r

    def encode(self, piece: bytes) -> list[int]:
        found = self.whole.find(piece)
        return [self.rank_of[found]] if found >= 0 else self.merge(piece)

    def merge(self, piece: bytes) -> list[int]:
        """A heap entry is rank * 2**32 + place; it is stale if its pair no longer has that rank."""
        joined, n = self.joined.get, len(piece)
        part = list(map(self.byte.__getitem__, piece))
        part.append(NONE)  # beyond the last part, and in merged places
        after, before = list(range(1, n + 2)), list(range(-1, n))
        heap = [r << 32 | i for i, r in enumerate(map(joined, [a << 32 | b for a, b in zip(part, part[1:])])) if r is not None]
        heapq.heapify(heap)
        while heap:
            entry = heapq.heappop(heap)
            i, r = entry & 0xFFFFFFFF, entry >> 32
            j = after[i]
            if joined(part[i] << 32 | part[j]) != r:
                continue
            part[i], part[j] = r, NONE
            k = after[i] = after[j]
            before[k] = i
            if (s := joined(r << 32 | part[k])) is not None:
                heapq.heappush(heap, s << 32 | i)
            k = before[i]
            if k >= 0 and (s := joined(part[k] << 32 | r)) is not None:
                heapq.heappush(heap, s << 32 | k)
        return [p for p in part if p != NONE]


class Codec:
    """Whole texts to ids and back. Ids stay as decimal text per pre-token in the memo."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.pairs, self.split = BytePairs(tokens), regex.compile(pattern).findall
        self.bytes_of = {str(r): t for r, t in enumerate(tokens)}
        self.memo = Recent(lambda w: ",".join(map(str, self.pairs.encode(w.encode("utf-8", "surrogatepass")))), MEMO)

    def encode(self, text: str) -> str:
        """Decimal ids joined by commas."""
        return ",".join(map(self.memo.__getitem__, self.split(text)))

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.split(","))) if ids else b""


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec a worker process, built on first use from the installed vocabulary file."""
    return Codec(read_ranks(path), pattern)


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of long) of each row's whole text; null text counts as empty: no ids.

    Map only. Repeated rows are kept; further columns are not read; no rows give no rows.
    """
    def run(batches):
        c = codec(path, pattern)
        for b in batches:
            ids = [np.array(s.split(","), np.int64) if s else np.empty(0, np.int64) for s in map(c.encode, text_of(b))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "ids"])

    return df.selectExpr(f"`{id_col}` as doc_id", f"`{text_col}` as text").mapInArrow(run, "doc_id long, ids array<long>")


def decode(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the decoded bytes of rows of doc_id and ids; null ids decode to no bytes."""
    def run(batches):
        c = codec(path, pattern)
        for b in batches:
            out = [c.decode(",".join(map(str, ids or ()))) for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "decoded"])

    return df.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the number of ids, and the digests of the ids and of the bytes they decode to.

    One map-only pass encodes and decodes, so neither ids nor bytes leave the task.
    Null text counts as empty: no ids, and digests of nothing.
    """
    out = schema(doc_id=LONG, n_tokens=LONG, ids_sha256=TEXT, decoded_sha256=TEXT)

    def run(batches):
        c = codec(path, pattern)
        for b in batches:
            n, ids_sum, bytes_sum = [], [], []
            for text in text_of(b):
                ids = c.encode(text)
                n.append(ids.count(",") + 1 if ids else 0)
                ids_sum.append(hashlib.sha256(ids.encode()).hexdigest())
                bytes_sum.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids_sum), pa.array(bytes_sum)], out.names)

    return df.selectExpr(f"`{id_col}` as doc_id", f"`{text_col}` as text").mapInArrow(run, out)
