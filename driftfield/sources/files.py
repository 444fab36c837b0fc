"""Files of recordings and results: binary position, label and signal records, score tables, manifests."""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.evidence import MISSING, to_flag

#: Marks that enclose the binary part, and its records: a big-endian frame
#: number and eight big-endian shorts (x and y of two lights, then four unused).
DATA_START, DATA_END = b"data_start", b"\r\ndata_end"
POSITION_RECORD = np.dtype([("frame", ">u4"), ("v", ">i2", (8,))])
NO_LIGHT = 1023


def _files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content")


def header(content: bytes) -> tuple[dict[str, str], bytes]:
    """Key and value lines up to the binary part, and that part, which must be whole."""
    at = content.find(DATA_START)
    text, body = (content, b"") if at < 0 else (content[:at], content[at + len(DATA_START) :])
    if at >= 0:
        end = body.rfind(DATA_END)
        if end < 0:
            raise ValueError("the binary part has no end mark")
        body = body[:end]
    pairs = (line.split(None, 1) for line in text.decode("latin-1").splitlines() if line.strip())
    return {p[0]: p[1].strip() if len(p) > 1 else "" for p in pairs}, body


def number(value: str) -> float:
    """The number at the start of a value such as '96000 hz'."""
    return float(re.match(r"\s*([-+.\dEe]+)", value)[1])


def positions(content: bytes) -> dict[str, np.ndarray]:
    """Times in seconds and centimetres of the mean of the lights that were seen."""
    head, body = header(content)
    rows = np.frombuffer(body, POSITION_RECORD, count=min(len(body) // POSITION_RECORD.itemsize, int(number(head.get("num_pos_samples", "1e18")))))
    v = rows["v"].astype(float)
    v[v == NO_LIGHT] = np.nan
    both = np.stack((v[:, 0:2], v[:, 2:4]))
    seen = np.isfinite(both).all(2, keepdims=True)
    with np.errstate(invalid="ignore"):
        xy = np.where(seen, both, 0).sum(0) / np.where(seen.any(0), seen.sum(0), np.nan)
    cm = xy * (100.0 / number(head["pixels_per_metre"]))
    rate = number(head.get("sample_rate", head.get("timebase", "50")))
    return {"frame": rows["frame"].astype(np.int64), "t": rows["frame"] / rate, "x": cm[:, 0], "y": cm[:, 1]}


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """session, frame_idx, t, x, y of all .pos files below a path; a file is one task's row."""
    def run(batches):
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                p = positions(content)
                session = name.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                yield pa.RecordBatch.from_arrays([pa.array([session] * len(p["t"]), pa.string()), pa.array(p["frame"]), *(pa.array(p[k], from_pandas=True) for k in "txy")], ["session", "frame_idx", "t", "x", "y"])

    return _files(spark, path, "*.pos").mapInArrow(run, "session string, frame_idx long, t double, x double, y double")


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """session, key, value of all .set files below a path, without Python."""
    lines = _files(spark, path, "*.set").select(F.regexp_extract("path", r"([^/]+)\.set$", 1).alias("session"), F.explode(F.split(F.decode("content", "ISO-8859-1"), r"\r?\n")).alias("line")).where(F.trim("line") != "")
    return lines.select("session", F.regexp_extract("line", r"^(\S+)", 1).alias("key"), F.trim(F.regexp_replace("line", r"^\S+", "")).alias("value"))


def read_cuts(spark: SparkSession, path: str) -> DataFrame:
    """session, tetrode, spike_row, cluster of all .cut files: the labels after the line that names the spikes."""
    body = _files(spark, path, "*.cut").select("path", F.decode("content", "ISO-8859-1").alias("text"))
    named = body.select(F.regexp_extract("path", r"([^/]+)_(\d+)\.cut$", 1).alias("session"), F.regexp_extract("path", r"_(\d+)\.cut$", 1).cast("int").alias("tetrode"), F.regexp_extract("text", r"(?s)spikes:\s*(\d+)(.*)$", 1).cast("int").alias("n"), F.regexp_extract("text", r"(?s)spikes:\s*\d+(.*)$", 1).alias("labels"))
    return named.select("session", "tetrode", "n", F.posexplode(F.split(F.trim(F.regexp_replace("labels", r"\s+", " ")), " ")).alias("spike_row", "cluster")).where("spike_row < n").select("session", "tetrode", "spike_row", F.col("cluster").cast("int").alias("cluster"))


def read_signal(spark: SparkSession, path: str) -> DataFrame:
    """session, sample, value of all .egf files: big-endian shorts."""
    def run(batches):
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                v = np.frombuffer(header(content)[1], ">i2").astype(np.int32)
                for i in range(0, len(v), 1 << 20):
                    part = v[i : i + (1 << 20)]
                    yield pa.RecordBatch.from_arrays([pa.array([name.rsplit("/", 1)[-1].rsplit(".", 1)[0]] * len(part), pa.string()), pa.array(np.arange(i, i + len(part))), pa.array(part)], ["session", "sample", "value"])

    return _files(spark, path, "*.egf").mapInArrow(run, "session string, sample long, value int")


def read_scores(spark: SparkSession, path: str, schema: str, flags: tuple[str, ...] = (), malformed: str = "fail") -> DataFrame:
    """Score tables as CSV: words for nothing become null, NaN too, and flags are read as written by any tool.

    Rows that do not fit the schema stop the read; with "drop" they go, and with "mark" they
    stay, with what was readable, their text in the column malformed_row.
    """
    mode = {"fail": "FAILFAST", "drop": "DROPMALFORMED", "mark": "PERMISSIVE"}[malformed]
    reader = spark.read.option("columnNameOfCorruptRecord", "malformed_row")
    df = reader.csv(path, header=True, schema=f"{schema}, malformed_row string" if malformed == "mark" else schema, nullValue="", nanValue="NaN", mode=mode, enforceSchema=True)
    for name, kind in df.dtypes:
        if name == "malformed_row":
            continue
        if kind == "string":
            df = df.withColumn(name, to_flag(F.col(name)) if name in flags else F.when(F.lower(F.trim(name)).isin(*MISSING), None).otherwise(F.col(name)))
        elif kind in ("double", "float"):
            df = df.withColumn(name, F.when(~F.isnan(name), F.col(name)))
    return df


def discover_sessions(spark: SparkSession, root: str, rats: tuple[int, ...] = (1, 2, 3, 4)) -> DataFrame:
    """The open-field sessions below a folder, in order: session (Rat1/Open1), rat, number of files and bytes.

    Only names and sizes are read. A session is a folder Open* in a folder Rat<number>.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    part = F.regexp_extract("path", r"/(Rat(\d+)/Open[^/]*)/[^/]+$", 1)
    named = files.withColumn("session", part).where("session <> ''").withColumn("rat", F.split("session", "/")[0])
    return named.where(F.col("rat").isin(*[f"Rat{r}" for r in rats])).groupBy("session", "rat").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes")).orderBy("session")


def settings_text(settings: dict) -> str:
    """A run's settings as YAML, keys in order; values are numbers, flags, texts, lists of those, or nested settings."""
    def value(v) -> str:
        if v is None:
            return "null"
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, (list, tuple)):
            return "[" + ", ".join(map(value, v)) + "]"
        return json.dumps(v, ensure_ascii=False) if isinstance(v, str) else repr(v)

    def lines(d: dict, depth: int):
        for k in sorted(d):
            if isinstance(d[k], dict) and d[k]:
                yield "  " * depth + f"{k}:"
                yield from lines(d[k], depth + 1)
            else:
                yield "  " * depth + f"{k}: {'{}' if isinstance(d[k], dict) else value(d[k])}"

    return "\n".join(lines(settings, 0)) + "\n"


def report_text(title: str, tables: dict[str, DataFrame], rows: int = 50) -> str:
    """Small result tables as Markdown, each up to so many rows; a longer one says so."""
    out = [f"# {title}", ""]
    for name, df in tables.items():
        found = df.limit(rows + 1).collect()
        out += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v).replace("|", "\\|") for v in r) + " |" for r in found[:rows]]
        out += ["", f"First {rows} rows.", ""] if len(found) > rows else [""]
    return "\n".join(out)


def union_shards(shards: list[DataFrame], settings: list[str]) -> DataFrame:
    """All shards as one table; shards that were made under other settings are refused."""
    out = shards[0]
    for s in shards[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    if out.select(*settings).distinct().limit(2).count() > 1:
        raise ValueError(f"shards differ in their settings {settings}")
    return out


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Name, size, time and SHA-256 of every file below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", "modificationTime", F.sha2("content", 256).alias("sha256"))


def write_tables(tables: dict[str, DataFrame], folder: str, kind: str = "parquet") -> None:
    """Each table in a folder of its name; CSV cannot hold arrays, so those are joined by commas."""
    for name, df in tables.items():
        if kind == "csv":
            df = df.select(*[F.concat_ws(",", F.col(c).cast("array<string>")).alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])
            df.write.mode("overwrite").csv(f"{folder}/{name}", header=True)
        else:
            df.write.mode("overwrite").parquet(f"{folder}/{name}")
