"""Files of fixed-size binary records as a data source: partitions are ranges of records, so no task holds a whole file.

Paths are those that every executor can open: a shared mount, or a local folder for a local
master. Only headers and end marks are read when the partitions are made.
"""

from __future__ import annotations

import glob
import os
import re
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import DATA_END, DATA_START, NO_LIGHT, POSITION_RECORD, number

#: Channels of a tetrode record; each has a big-endian time stamp and signed samples.
CHANNELS = 4
#: Bytes of a partition, and of what is read at once; bytes looked through for the header and the end mark.
SPLIT, CHUNK, HEAD, TAIL = 64 << 20, 4 << 20, 1 << 20, 4096

SCHEMAS = {
    "position": "session string, frame_idx long, t double, x double, y double",
    "tetrode": "session string, tetrode int, spike_row long, t double, waveform array<tinyint>",
    "signal": "session string, sample long, t double, value int",
}
GLOBS = {"position": "*.pos", "tetrode": "*.[0-9]*", "signal": "*.egf"}


def plain(path: str) -> str:
    """The path that open() takes; other stores than mounted ones are refused by name."""
    parts = urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"records are read from mounted folders, not from {parts.scheme}://; use the readers of whole files there")
    return unquote(parts.path) if parts.scheme else path


@dataclass
class Layout:
    """Of one file: where its records begin, how many there are and how long, and the numbers of its header."""

    path: str
    at: int
    size: int
    count: int
    head: dict


def layout(path: str, kind: str) -> Layout:
    """Reads the header, and looks for the end mark in the last bytes; a part of a record before it does not count."""
    length = os.path.getsize(path)
    with open(path, "rb") as f:
        start = f.read(HEAD)
        mark = start.find(DATA_START)
        if mark < 0:
            raise ValueError(f"{path}: no start mark in its first {HEAD} bytes")
        f.seek(max(mark + len(DATA_START), length - TAIL))
        base, rest = f.tell(), f.read()
    end = rest.rfind(DATA_END)
    if end < 0:
        raise ValueError(f"{path}: the binary part has no end mark")
    pairs = (line.split(None, 1) for line in start[:mark].decode("latin-1").splitlines() if line.strip())
    head = {p[0]: p[1].strip() if len(p) > 1 else "" for p in pairs}
    size = {"position": POSITION_RECORD.itemsize, "signal": 2}.get(kind) or CHANNELS * (4 + int(number(head.get("samples_per_spike", "50"))))
    named = head.get({"position": "num_pos_samples", "tetrode": "num_spikes", "signal": "num_EGF_samples"}[kind])
    at = mark + len(DATA_START)
    count = (base + end - at) // size
    return Layout(path, at, size, min(count, int(number(named))) if named else count, head)


def session_of(path: str) -> str:
    return os.path.basename(path).rsplit(".", 1)[0]


def _position(raw: bytes, of: Layout, first: int) -> list[pa.Array]:
    rows = np.frombuffer(raw, POSITION_RECORD)
    v = rows["v"].astype(float)
    v[v == NO_LIGHT] = np.nan
    lights = np.stack((v[:, 0:2], v[:, 2:4]))
    seen = np.isfinite(lights).all(2, keepdims=True)
    with np.errstate(invalid="ignore"):
        xy = np.where(seen, lights, 0).sum(0) / np.where(seen.any(0), seen.sum(0), np.nan) * (100.0 / number(of.head["pixels_per_metre"]))
    t = rows["frame"] / number(of.head.get("sample_rate", of.head.get("timebase", "50")))
    return [pa.array(rows["frame"].astype(np.int64)), pa.array(t), pa.array(xy[:, 0], from_pandas=True), pa.array(xy[:, 1], from_pandas=True)]


def _tetrode(raw: bytes, of: Layout, first: int) -> list[pa.Array]:
    samples = of.size // CHANNELS - 4
    rows = np.frombuffer(raw, np.dtype([("c", [("t", ">u4"), ("v", "i1", (samples,))], (CHANNELS,))]))["c"]
    wave, n = np.ascontiguousarray(rows["v"]).reshape(-1), len(rows)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (CHANNELS * samples)), pa.array(wave))
    tetrode = int(re.search(r"\.(\d+)$", of.path)[1])
    return [pa.array(np.full(n, tetrode, np.int32)), pa.array(np.arange(first, first + n)), pa.array(rows["t"][:, 0] / number(of.head.get("timebase", "96000"))), lists]


def _signal(raw: bytes, of: Layout, first: int) -> list[pa.Array]:
    v = np.frombuffer(raw, ">i2").astype(np.int32)
    at = np.arange(first, first + len(v))
    return [pa.array(at), pa.array(at / number(of.head.get("sample_rate", "4800"))), pa.array(v)]


DECODERS = {"position": _position, "tetrode": _tetrode, "signal": _signal}


@dataclass
class Range(InputPartition):
    of: Layout
    first: int
    count: int


class Records(DataSource):
    """format("records") with the options path, kind (position, tetrode or signal), glob and split_bytes."""

    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> str:
        return SCHEMAS[self.options["kind"]]

    def reader(self, schema) -> DataSourceReader:
        return RecordReader(self.options)


class RecordReader(DataSourceReader):
    def __init__(self, options):
        self.kind, self.path = options["kind"], plain(options["path"])
        self.glob, self.split = options.get("glob") or GLOBS[self.kind], int(options.get("split_bytes") or SPLIT)

    def partitions(self) -> list[Range]:
        found = [self.path] if os.path.isfile(self.path) else sorted(glob.glob(os.path.join(glob.escape(self.path), "**", self.glob), recursive=True))
        out = []
        for path in found:
            if self.kind == "tetrode" and not re.search(r"\.\d+$", path):
                continue
            of = layout(path, self.kind)
            step = max(1, self.split // of.size)
            out += [Range(of, first, min(step, of.count - first)) for first in range(0, of.count, step)]
        return out or [Range(None, 0, 0)]

    def read(self, partition: Range):
        of = partition.of
        if of is None:
            return
        names = [x.split()[0] for x in SCHEMAS[self.kind].split(", ")]
        with open(of.path, "rb") as f:
            f.seek(of.at + partition.first * of.size)
            step, left, first = max(1, CHUNK // of.size), partition.count, partition.first
            while left:
                raw = f.read(min(step, left) * of.size)
                n = len(raw) // of.size
                if not n:
                    raise ValueError(f"{of.path} ends before its record {first}")
                columns = DECODERS[self.kind](raw[: n * of.size], of, first)
                yield pa.RecordBatch.from_arrays([pa.array([session_of(of.path)] * n, pa.string()), *columns], names)
                left, first = left - n, first + n


def read_records(spark: SparkSession, path: str, kind: str, glob: str | None = None, split_bytes: int = SPLIT) -> DataFrame:
    """Records of all files of a kind below a folder, or of one file.

    position: as `files.read_positions`. tetrode: waveform has the samples of all channels
    in order. signal: as `files.read_signal`, with its time. A folder without such files gives no rows.
    """
    if kind not in SCHEMAS:
        raise ValueError(f"kind is one of {sorted(SCHEMAS)}")
    spark.dataSource.register(Records)
    read = spark.read.format("records").option("kind", kind).option("path", path).option("split_bytes", str(split_bytes))
    return (read.option("glob", glob) if glob else read).load()


def peak_marks(waveforms: DataFrame) -> DataFrame:
    """session, t, mark_id, grp and f1 to f4, from tetrode records: each channel's largest sample less its least.

    grp is the tetrode, and mark_id names a spike within its session.
    """
    samples = (F.size("waveform") / CHANNELS).cast("int")

    def height(k: int) -> Column:
        part = F.slice("waveform", samples * k + 1, samples)
        return (F.array_max(part).cast("int") - F.array_min(part).cast("int")).cast("double")

    mark = F.col("spike_row") * 1024 + F.col("tetrode")
    return waveforms.select("session", "t", mark.alias("mark_id"), F.col("tetrode").cast("long").alias("grp"), *[height(k).alias(f"f{k + 1}") for k in range(CHANNELS)])
