"""WARC archives with a two-level capture index.

Records are written by Spark's text sink, whose line separator is the two line breaks that end a
WARC record, so any store that Spark writes to will do and a lost task leaves no partial file. The
index sorts reversed-host URL keys into compressed blocks; a sparse directory keeps the first key of
each block. A lookup searches the directory by bisection, opens only the blocks it points to, and
reads only the byte ranges of the captures found there.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.arrow_files import open_fs
from .base import query, small_or_shuffled, table, text_or_empty
from .url_rules import url_host

BREAK = "\r\n"
RECORD_END = BREAK * 2
#: Equal payloads of at least so many bytes are stored once.
REVISIT_BYTES = 100
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The directory never has more entries; larger archives get larger blocks.
MAX_DIRECTORY = 100_000


@dataclass(frozen=True)
class Archive:
    """Folders of the records, of the index blocks and of the block directory."""

    records: str
    blocks: str
    directory: str


def clean_url(url: Column) -> Column:
    """The URL as it may stand in a header: controls and spaces percent-encoded, null as empty."""
    return F.regexp_replace(text_or_empty(url), r"[\x00-\x20\x7F]", "%20")


def capture_key(url: Column) -> Column:
    """Sort key with the host reversed: ``http://a.b.com/x?y`` becomes ``com,b,a)/x?y``."""
    host = F.array_join(F.reverse(F.split(url_host(url), r"\.")), ",")
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(.*)$", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(host, F.lit(")"), rest)).otherwise(url)


def _record(kind: Column, page: Column, url: Column, digest: Column, refers: Column, payload: Column, when: str) -> Column:
    is_revisit = kind == "revisit"
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{BREAK}Content-Length: "),
        F.octet_length(payload).cast("string"),
        F.lit(RECORD_END),
    )
    block = F.concat(http, F.when(is_revisit, F.lit("")).otherwise(payload))
    return F.concat(
        F.lit(f"WARC/1.1{BREAK}WARC-Type: "), kind,
        F.lit(f"{BREAK}WARC-Record-ID: <urn:page:"), F.coalesce(page, F.lit("")),
        F.lit(f">{BREAK}WARC-Date: {when}{BREAK}WARC-Target-URI: "), url,
        F.lit(f"{BREAK}WARC-Payload-Digest: sha256:"), digest,
        F.when(is_revisit, F.concat(
            F.lit(f"{BREAK}WARC-Refers-To: <urn:page:"), refers, F.lit(f">{BREAK}WARC-Profile: {REVISIT_PROFILE}")
        )).otherwise(F.lit("")),
        F.lit(f"{BREAK}Content-Type: application/http; msgtype=response{BREAK}Content-Length: "),
        F.octet_length(block).cast("string"), F.lit(RECORD_END), block,
    )


def write_records(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    when: str = "2024-01-01T00:00:00Z",
    records_per_file: int = 4096,
    small: int = 200_000,
) -> None:
    """One WARC record per row of ``pages``.

    Of equal payloads of at least ``REVISIT_BYTES`` bytes the smallest id becomes the response, the
    others revisit it; null html is an empty payload. Rows that repeat the winning id are responses
    too; a null id revisits, unless no row of its payload has an id. Only digests travel: the table
    of repeated digests is broadcast if it is counted small, else joined by shuffle.
    """
    rows = pages.select(
        F.col(id_col).alias("page"), clean_url(F.col(url_col)).alias("url"), text_or_empty(html_col).alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    repeated = (
        rows.filter(F.octet_length("payload") >= REVISIT_BYTES)
        .groupBy("digest").agg(F.min("page").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1").drop("n").withColumnRenamed("digest", "same")
    )
    firsts = pages.sparkSession.read.schema(repeated.schema).parquet(_kept(repeated, f"{path}-repeated"))
    joined = rows.join(small_or_shuffled(firsts, small), F.col("digest") == F.col("same"), "left")
    revisits = F.col("first").isNotNull() & ~F.col("page").eqNullSafe(F.col("first"))
    record = _record(
        F.when(revisits, "revisit").otherwise("response"), F.col("page").cast("string"), F.col("url"),
        F.col("digest"), F.col("first").cast("string"), F.col("payload"), when,
    )
    joined.select(record.alias("value")).write.option("lineSep", RECORD_END).option(
        "maxRecordsPerFile", records_per_file
    ).text(path)


def _kept(df: DataFrame, path: str) -> str:
    df.write.parquet(path)
    return path


def split_record(data, at: int = 0) -> tuple[dict[str, str], int, int]:
    """Headers, start and end of the block of the record that begins at ``at``."""
    head = data.index(RECORD_END.encode(), at)
    lines = bytes(data[at:head]).decode("utf-8").split(BREAK)
    headers = dict(line.split(": ", 1) for line in lines[1:])
    start = head + len(RECORD_END)
    return headers, start, start + int(headers["Content-Length"])


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where each record of a file begins, by jumping from Content-Length to Content-Length."""
    for batch in batches:
        for file, content in zip(batch["path"], batch["content"]):
            data, at, name = content.as_py(), 0, file.as_py()
            rows = []
            while at < len(data):
                headers, _, end = split_record(data, at)
                rows.append((headers["WARC-Target-URI"], name, at, end - at))
                at = end + len(RECORD_END)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, (pa.string(), pa.string(), pa.int64(), pa.int64()))],
                ["url", "file", "offset", "length"],
            )


def _blocks(lines_per_block: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []

        def block() -> pa.RecordBatch:
            data = zlib.compress("\n".join(json.dumps(x) for x in held).encode())
            return pa.RecordBatch.from_pydict({"first_key": [held[0][0]], "n": [len(held)], "data": [data]})

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(list(row))
                if len(held) == lines_per_block:
                    yield block()
                    held.clear()
        if held:
            yield block()

    return pack


def build_index(spark: SparkSession, records: str, path: str, lines_per_block: int = 3000) -> Archive:
    """Index every record below ``records``; ties on a key are dealt over partitions by position."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(records)
    entries = files.select("path", "content").mapInArrow(_positions, "url string, file string, offset long, length long")
    found = spark.read.schema(entries.schema).parquet(_kept(entries, f"{path}/positions"))
    entries = found.select(capture_key(F.col("url")).alias("key"), "file", "offset", "length")
    lines = max(lines_per_block, -(-entries.count() // MAX_DIRECTORY))
    order = ["key", "file", "offset"]
    packed = entries.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _blocks(lines), "first_key string, n long, data binary"
    )
    made = Archive(records, f"{path}/blocks", f"{path}/directory")
    packed.withColumn("block", F.monotonically_increasing_id()).write.parquet(made.blocks)
    spark.read.parquet(made.blocks).select("block", "first_key").write.parquet(made.directory)
    return made


def lookup(spark: SparkSession, archive: Archive, keys: DataFrame) -> DataFrame:
    """(key, file, offset, length) of all captures of the distinct ``keys`` (one column)."""
    directory = sorted(spark.read.parquet(archive.directory).select("first_key", "block").collect())
    firsts, numbers = [r.first_key for r in directory], [r.block for r in directory]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[int] = []
            for key in batch.column(0).to_pylist():
                low, high = bisect_left(firsts, key) - 1, bisect_right(firsts, key)
                found += numbers[max(low, 0) : high]
            yield pa.RecordBatch.from_pydict({"block": pa.array(sorted(set(found)), pa.int64())})

    wanted = keys.toDF("key").distinct()
    needed = wanted.mapInArrow(search, "block long").distinct()
    opened = spark.read.parquet(archive.blocks).select("block", "data").join(needed, "block", "left_semi")

    def open_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch["data"]:
                rows = [json.loads(x) for x in zlib.decompress(data.as_py()).decode().split("\n")]
                columns = zip(*rows)
                types = (pa.string(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types)], ["key", "file", "offset", "length"]
                )

    entries = opened.select("data").mapInArrow(open_blocks, "key string, file string, offset long, length long")
    return entries.join(wanted, "key", "left_semi")


READ_SCHEMA = "page string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary"


def _named(urn: str) -> str | None:
    return urn[len("<urn:page:") : -1] or None


def read_ranges(positions: DataFrame, payload: bool = True) -> DataFrame:
    """The records at ``positions``, each fetched by one range read of its file.

    Length and digest of a response are those of the bytes read; a revisit repeats what its headers say.
    """

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = None, None
        for batch in batches:
            rows = []
            for file, offset, length in zip(*(batch[c].to_pylist() for c in ("file", "offset", "length"))):
                if file != name:
                    if source is not None:
                        source.close()
                    fs, where = open_fs(file)
                    name, source = file, fs.open_input_file(where)
                data = source.read_at(length, offset)
                headers, start, end = split_record(data)
                body = data.index(RECORD_END.encode(), start) + len(RECORD_END)
                size = int(data[start:body].split(b"Content-Length: ")[1].split(BREAK.encode())[0])
                digest = headers["WARC-Payload-Digest"].partition(":")[2]
                content = data[body:end] if headers["WARC-Type"] == "response" else None
                if content is not None:
                    size, digest = len(content), hashlib.sha256(content).hexdigest()
                refers = _named(headers["WARC-Refers-To"]) if "WARC-Refers-To" in headers else None
                rows.append((_named(headers["WARC-Record-ID"]), headers["WARC-Target-URI"], size, digest, headers["WARC-Type"], refers, content if payload else None))
            text = pa.string()
            types = (text, text, pa.int64(), text, text, text, pa.binary())
            columns = zip(*rows) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)],
                ["page", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"],
            )
        if source is not None:
            source.close()

    order = ["file", "offset"]
    return positions.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(fetch, READ_SCHEMA)


@query(
    "op8_warc",
    f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
r AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS f FROM q)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {REVISIT_BYTES} AND f < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {REVISIT_BYTES} AND f < page_id THEN f END AS refers_to
FROM r""",
)
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "warc")
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    write_records(pages, f"{root}/records")
    archive = build_index(spark, f"{root}/records", root)
    keys = pages.select(capture_key(clean_url(F.col("url"))).alias("key"))
    read = read_ranges(lookup(spark, archive, keys), payload=False)
    return read.select(
        F.col("page").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )
