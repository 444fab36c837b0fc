"""WARC archives whose records are Zstandard frames of their own, with a dictionary in front."""

from __future__ import annotations

import hashlib
import io
import struct

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LONG, TEXT, attach, materialize, schema, shared_folder

#: The skippable frame that holds a dictionary, and an ordinary frame's magic number.
DICTIONARY_FRAME, FRAME = 0x184D2A5D, 0xFD2FB528
#: Raw bytes of records in one archive, of a dictionary, and of the records it is built from, at most.
ARCHIVE, DICTIONARY, TRAINING = 16 << 20, 16 << 10, 1 << 20
#: Payloads from this size on are stored once.
REVISIT_BYTES = 1_000
DATE = "2024-01-01T00:00:00Z"
#: An empty skippable frame, all ASCII, with which Spark's text writer ends each file.
EMPTY_FRAME = struct.pack("<II", 0x184D2A50, 0).decode()
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id, url, payload: bytes, size: int, digest: str, refers_to, refers_uri, date: str = DATE) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP header and leaves out the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {uri(url, page_id)}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Refers-To-Target-URI: {uri(refers_uri, refers_to)}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def uri(url, page_id) -> str:
    """The address on one line; a null or empty one gives way to the page's own name."""
    clean = "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "")
    return clean or f"urn:page:{'' if page_id is None else page_id}"


def info(name: str, date: str = DATE) -> bytes:
    """The warcinfo record that opens an archive."""
    block = b"software: driftfield\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:archive:{name}>", f"WARC-Date: {date}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_dictionary(records: list[bytes]):
    """A dictionary trained on records spread over the whole list, or None where too few repeat."""
    total = sum(map(len, records))
    step = max(1, -(-total // TRAINING))
    try:
        return zstandard.train_dictionary(DICTIONARY, [r[: 64 << 10] for r in records[::step]], k=256, d=8)
    except zstandard.ZstdError:
        return None


def write_archive(records: list[bytes], level: int = 3) -> bytes:
    """The bytes of a .warc.zst file: the dictionary's skippable frame, then a frame a record."""
    found = build_dictionary(records)
    squeeze = zstandard.ZstdCompressor(level=level, dict_data=found, write_checksum=True) if found else zstandard.ZstdCompressor(level=level, write_checksum=True)
    out = [squeeze.compress(r) for r in records]
    if found:
        raw = found.as_bytes()
        out.insert(0, struct.pack("<II", DICTIONARY_FRAME, len(raw)) + raw)
    return b"".join(out)


def read_archive(content: bytes):
    """The records of a .warc.zst file: a dict of headers and the block of each."""
    magic, size = struct.unpack_from("<II", content) if len(content) >= 8 else (0, 0)
    at, found = 0, None
    if magic == DICTIONARY_FRAME:
        raw, at = content[8 : 8 + size], 8 + size
        if raw[:4] == struct.pack("<I", FRAME):
            raw = zstandard.ZstdDecompressor().decompress(raw)
        found = zstandard.ZstdCompressionDict(raw)
    expand = zstandard.ZstdDecompressor(dict_data=found) if found else zstandard.ZstdDecompressor()
    with io.BufferedReader(expand.stream_reader(io.BytesIO(content[at:]), read_across_frames=True), 1 << 20) as f:
        while (first := f.readline()) :
            if first.strip() != b"WARC/1.1":
                raise ValueError(f"not a record: {first[:40]!r}")
            head = {}
            while (line := f.readline().rstrip(b"\r\n")):
                name, _, value = line.partition(b":")
                head[name.decode().lower()] = value.strip().decode()
            block = f.read(int(head["content-length"]))
            f.read(4)
            yield head, block


def plan_records(pages: DataFrame) -> DataFrame:
    """Each row's payload digest and size, and the page it revisits, if any.

    Of rows with equal payloads of REVISIT_BYTES or more, those of the largest page_id are
    responses. Only digests that occur twice or more are looked up, and rows of a very
    common payload are dealt over many tasks.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(F.encode(html, "UTF-8")).alias("digest"), F.octet_length(html).cast("long").alias("size"))
    narrow = rows.where(F.col("size") >= REVISIT_BYTES).select("page_id", "url", "digest")
    first = narrow.groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("first"), F.count(F.lit(1)).alias("n"))
    first = materialize(first.where("n > 1").select("digest", "n", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url")), "revisited")
    both = attach(rows, first, ["digest"])
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return both.select("page_id", "url", F.when(revisit, F.lit("")).otherwise(F.col("html")).alias("html"), "digest", "size", F.when(revisit, F.col("first_id")).alias("refers_to"), F.when(revisit, F.col("first_url")).alias("refers_uri"))


def write_archives(pages: DataFrame, path: str, date: str = DATE) -> None:
    """Writes .warc.zst archives below a new folder, a file each, of about ARCHIVE bytes of records.

    Spark's text writer commits the files, so lost tasks leave nothing behind and any store
    that Spark reaches will do. It names them part-*.txt and ends each with a line
    separator, for which an empty skippable frame stands, so that every file is a valid
    archive; `rename_archives` gives them their usual ending. Null html is an empty payload,
    repeated rows are records of their own that share a record id, and an empty table gives
    no archives.
    """
    def run(batches):
        part, serial, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([write_archive([info(f"part-{part:06d}-{serial:04d}", date), *held])], pa.binary())], ["content"])

        for b in batches:
            for r in b.to_pylist():
                held.append(record(r["page_id"], r["url"], r["html"].encode("utf-8", "surrogatepass"), r["size"], r["digest"], r["refers_to"], r["refers_uri"], date))
                size += len(held[-1])
                if size >= ARCHIVE:
                    yield flush()
                    held, size, serial = [], 0, serial + 1
        if held:
            yield flush()

    archives = plan_records(pages).mapInArrow(run, "content binary").select(F.col("content").cast("string"))
    archives.write.option("compression", "none").option("lineSep", EMPTY_FRAME).option("maxRecordsPerFile", 1).text(path)


def archives_in(spark: SparkSession, path: str) -> DataFrame:
    """path and content of the archives below a folder; files without bytes are left out."""
    return spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")


def rename_archives(spark: SparkSession, path: str) -> int:
    """Gives the archives of a folder the ending .warc.zst, by the store's own renaming; their number."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store, n = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), 0
    for f in store.listStatus(at):
        name = f.getPath().getName()
        if name.startswith("part-") and name.endswith(".txt"):
            n += bool(store.rename(f.getPath(), spark._jvm.org.apache.hadoop.fs.Path(path, name.removesuffix(".txt") + ".warc.zst")))
    return n


def read_archives(archives: DataFrame) -> DataFrame:
    """One row per record of the archives, from its headers and block."""
    out = schema(page_id=LONG, payload_bytes=LONG, payload_digest=TEXT, record_type=TEXT, refers_to=LONG, target_uri=TEXT, stored_bytes=LONG)

    def number(urn: str | None):
        digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
        return int(digits) if digits else None

    def run(batches):
        for b in batches:
            for content in b.column("content"):
                rows = {k: [] for k in out.names}
                for head, block in read_archive(content.as_py()):
                    if head["warc-type"] == "warcinfo":
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    digest, kind = head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"]
                    size = int(http.rpartition(b"Content-Length:")[2])
                    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                        raise ValueError(f"damaged record {head['warc-record-id']}")
                    for k, v in zip(out.names, (number(head["warc-record-id"]), size, digest, kind, number(head.get("warc-refers-to")), head["warc-target-uri"], len(payload))):
                        rows[k].append(v)
                yield pa.RecordBatch.from_arrays([pa.array(rows[f.name], pa.int64() if f.dataType == LONG else pa.string()) for f in out], out.names)

    return archives.select("content").mapInArrow(run, out)


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Writes all pages to archive files in the shared folder and reads the records back.

    One row per row of pages, repeated ones too; of equal payloads of REVISIT_BYTES or more
    the rows of the largest page_id are responses (a null id only where no row has one),
    all others revisit it. Null html is an empty payload and a null or empty url gives way
    to the page's name. An empty table gives no rows; further columns are not read.
    """
    path = shared_folder(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_archives(archives_in(pages.sparkSession, path))
