"""WARC archives with a two-level capture index.

Writing: each page becomes a record of a gzip member of its own; members follow one another in archive files of up to
``SEGMENT_BYTES`` in the shared folder, each file written by one attempt of one task under a name of its own. Of pages with
equal payloads of at least ``REVISIT_BYTES`` that with the smallest id is stored in full, the others refer to it.

Index: captures sorted by their URL key (host reversed, then path) are cut into blocks of lines, each compressed; the
sparse directory holds every block's first key. A lookup searches the directory by bisection, then the block, then
reads the byte range of the file. Only what is asked travels: keys go to blocks and ranges to readers, which open the
file, jump to the range and read it; the archives themselves are never shuffled. The directory is sent to the tasks if
it has at most ``DIRECTORY_ROWS`` rows (a few MB); of a longer one every n-th row is, and the slots between them are
searched by a sorted merge.

Files are opened through the file systems that Arrow knows (local and mounted folders, HDFS, S3, GCS); a shared folder
in another store is refused with an error when the archive is written.

Defined cases: a null html is an empty payload; a null url gets the key of an empty host; a null page id is written as
empty, stays null and is never referred to; repeated rows are records each, all found again, and equal ids with equal
payloads do not revisit each other; ties in the key are told apart by page id; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .linededup import host
from .shared import join_counted, new_folder, written

REVISIT_BYTES = 100
SEGMENT_BYTES = 256 << 20
#: Ranges that begin in the same stretch of a file are read by one task.
READ_BYTES = 8 << 20
BLOCK_LINES = 300
DIRECTORY_ROWS = 50_000
#: The tables have no capture time.
CAPTURED = "2024-01-01T00:00:00Z"
_LEVEL = 4


@dataclass(frozen=True)
class Archive:
    #: folder of the archive files, as a URI
    folder: str
    #: block string, first_key string, first_page long, data binary; blocks sort as ``<part>-<number>``
    blocks: DataFrame
    #: of all archive files together
    size: int


def url_key(url: Column) -> Column:
    """``com,example,www)/path?query`` of a URL; the fragment, port and user go."""
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    names = F.array_join(F.reverse(F.split(host(url), r"\.")), ",")
    return F.coalesce(F.concat(names, F.lit(")"), F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))), F.lit(")/"))


def record(page: str, url: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """A WARC/1.1 record as a gzip member; a revisit keeps the HTTP header and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page}>", f"WARC-Date: {CAPTURED}", "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"), "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    block = http if refers_to is not None else http + payload
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode("utf-8")
    packer = zlib.compressobj(_LEVEL, zlib.DEFLATED, 31)
    return packer.compress(head + block + b"\r\n\r\n") + packer.flush()


def parse(member: bytes) -> dict:
    """``page, url, kind, digest, bytes, refers_to, payload`` of a record; a response's digest and size are taken anew."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    field = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(field["Content-Length"])]
    if len(block) != int(field["Content-Length"]):
        raise ValueError("record ends early")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode("ascii").split("\r\n")[1:])["Content-Length"])
    digest = field["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = field["WARC-Type"]
    if kind == "response":
        if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError("payload differs from its digest")
        digest, size = hashlib.sha256(payload).hexdigest(), len(payload)
    name = lambda x: x.removeprefix("<urn:page:").removesuffix(">") if x else None
    return {"page": name(field["WARC-Record-ID"]), "url": field["WARC-Target-URI"], "kind": kind, "digest": digest, "bytes": size, "refers_to": name(field.get("WARC-Refers-To")), "payload": payload if kind == "response" else None}


def write(spark: SparkSession, pages: DataFrame) -> Archive:
    """Archive ``page_id, url, html`` rows."""
    captures = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", url_key(F.col("url")).alias("key"), F.sha2(F.coalesce("html", F.lit("")), 256).alias("digest"), F.coalesce(F.octet_length("html"), F.lit(0)).alias("bytes"))
    groups = captures.filter(f"bytes >= {REVISIT_BYTES}").groupBy("digest").agg(F.min("page_id").alias("original"), F.count("*").alias("copies")).filter("copies > 1 AND original IS NOT NULL")
    marked = join_counted(captures, groups, ["digest"], "copies", pages.count())
    marked = marked.select("page_id", "url", "html", "key", "digest", F.when(F.coalesce(F.col("page_id") != F.col("original"), F.col("original").isNotNull()), F.col("original")).alias("refers_to"))

    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(new_folder(spark, "archives"))
    folder = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()
    store_of(folder)  # an unknown store fails here rather than in every task

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = store_of(folder)
        files.create_dir(path, recursive=True)
        name, out, size = "", None, 0
        try:
            for batch in batches:
                for first in range(0, batch.num_rows, 200):
                    some = batch.slice(first, 200)
                    entries: tuple[list, list, list] = ([], [], [])
                    for page, url, html, digest, other in zip(*(some.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                        if out is None or size >= SEGMENT_BYTES:
                            if out is not None:
                                out.close()
                            name, size = f"{TaskContext.get().partitionId():08d}-{uuid.uuid4().hex}.warc.gz", 0
                            out = files.open_output_stream(f"{path}/{name}", compression=None)
                        member = record("" if page is None else str(page), url or "", (html or "").encode("utf-8"), digest, None if other is None else str(other))
                        for column, value in zip(entries, (name, size, len(member)), strict=True):
                            column.append(value)
                        out.write(member)
                        size += len(member)
                    yield pa.RecordBatch.from_arrays([some.column("key"), some.column("page_id"), pa.array(entries[0], pa.string()), pa.array(entries[1], pa.int64()), pa.array(entries[2], pa.int64())], ["key", "page", "segment", "at", "size"])
        finally:
            if out is not None:
                out.close()

    lines = written(spark, marked.mapInArrow(store, "key string, page long, segment string, at long, size long"), "captures")
    return Archive(folder, _index(spark, lines), lines.agg(F.sum("size")).first()[0] or 0)


def store_of(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a folder's URI and the path there."""
    return pyarrow.fs.FileSystem.from_uri(folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder)


def _sort_page(page: int | None) -> int:
    return -(2**63) if page is None else page


def _index(spark: SparkSession, lines: DataFrame) -> DataFrame:
    ordered = lines.repartitionByRange("key", "page").sortWithinPartitions("key", "page")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, done = TaskContext.get().partitionId(), [], 0

        def block() -> pa.RecordBatch:
            text = "\n".join("\t".join(map(str, x)) for x in held)
            return pa.RecordBatch.from_arrays([pa.array([f"{part:08d}-{done:010d}"]), pa.array([held[0][0]]), pa.array([held[0][1]], pa.int64()), pa.array([zlib.compress(text.encode("utf-8"))], pa.binary())], ["block", "first_key", "first_page", "data"])

        for batch in batches:
            for key, page, segment, at, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append((key.replace("\t", "%09").replace("\n", "%0A"), _sort_page(page), segment, at, size))
                if len(held) == BLOCK_LINES:
                    yield block()
                    held, done = [], done + 1
        if held:
            yield block()

    return written(spark, ordered.mapInArrow(cut, "block string, first_key string, first_page long, data binary"), "blocks")


def _blocks_of(spark: SparkSession, archive: Archive, asked: DataFrame, most: int) -> DataFrame:
    """``asked`` (key, page) with every ``block`` that may hold it."""
    directory = archive.blocks.select("first_key", "first_page", "block")
    n = directory.count()
    if n <= most:
        rows = directory.orderBy("block").collect()
        firsts, names = [(r.first_key.encode(), r.first_page) for r in rows], [r.block for r in rows]

        def bisect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                row, block = [], []
                for k, (key, page) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                    want = (key.encode(), page)
                    for b in names[max(0, bisect_left(firsts, want) - 1) : bisect_right(firsts, want)]:
                        row.append(k)
                        block.append(b)
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row, pa.int64())) for c in batch.columns), pa.array(block, pa.string())], ["key", "page", "block"])

        return asked.mapInArrow(bisect, "key string, page long, block string")
    # a part's blocks are numbered from 0: every step-th one tops a slot, which its part and number name
    step = -(-n // most)
    part, number = (F.split("block", "-")[k].cast("long") for k in (0, 1))
    placed = directory.withColumn("slot", part * (1 << 34) + F.floor(number / step))
    tops = placed.filter(number % step == 0).orderBy("block").collect()
    firsts, slots = [(r.first_key.encode(), r.first_page) for r in tops], [r.slot for r in tops]

    def slot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [slots[max(0, bisect_left(firsts, (key.encode(), page)) - 1)] for key, page in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], ["key", "page", "slot"])

    own = placed.select(F.col("first_key").alias("key"), F.col("first_page").alias("page"), "slot", "block")
    both = own.withColumn("ask", F.lit(1)).unionByName(asked.mapInArrow(slot, "key string, page long, slot long").withColumn("block", F.lit(None).cast("string")).withColumn("ask", F.lit(0)))
    before = F.last("block", ignorenulls=True).over(Window.partitionBy("slot").orderBy("key", "page", "ask").rowsBetween(Window.unboundedPreceding, -1))
    # the last block that begins before the key, and all that begin with it
    below = both.withColumn("block", before).filter("ask = 0 AND block IS NOT NULL").select("key", "page", "block")
    return below.union(asked.join(own.select("key", "page", "block"), ["key", "page"]).select("key", "page", "block")).distinct()


def locate(spark: SparkSession, archive: Archive, asked: DataFrame, *, directory_rows: int = DIRECTORY_ROWS) -> DataFrame:
    """``key, page, segment, at, size`` of the captures that have the ``url`` and ``page_id`` asked for."""
    plain = F.regexp_replace(F.regexp_replace(url_key(F.col("url")), "\t", "%09"), "\n", "%0A")
    wanted = asked.select(plain.alias("key"), F.coalesce(F.col("page_id").cast("long"), F.lit(-(2**63))).alias("page")).distinct()
    by_block = _blocks_of(spark, archive, wanted, directory_rows).groupBy("block").agg(F.collect_list(F.struct("key", "page")).alias("asks"))

    def bisect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for k in range(batch.num_rows):
                lines = [x.split("\t") for x in zlib.decompress(batch.column(0)[k].as_py()).decode("utf-8").split("\n")]
                keys = [(x[0].encode(), int(x[1])) for x in lines]
                for ask in batch.column(1)[k].as_py():
                    want = (ask["key"].encode(), ask["page"])
                    for x in lines[bisect_left(keys, want) : bisect_right(keys, want)]:
                        out.append((x[0], int(x[1]), x[2], int(x[3]), int(x[4])))
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)], ["key", "page", "segment", "at", "size"])

    return archive.blocks.select("block", "data").join(by_block, "block").select("data", "asks").mapInArrow(bisect, "key string, page long, segment string, at long, size long")


def read(spark: SparkSession, archive: Archive, asked: DataFrame, *, payloads: bool = True, directory_rows: int = DIRECTORY_ROWS) -> DataFrame:
    """Records of the captures asked for (``url, page_id``): ``page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload]``."""
    found = locate(spark, archive, asked, directory_rows=directory_rows).withColumn("stretch", F.floor(F.col("at") / READ_BYTES))
    # ranges are small beside what they name, so the number of tasks follows the archive
    spread = found.repartition(max(1, -(-archive.size // (2 * READ_BYTES))), "segment", "stretch")
    ranges = spread.groupBy("segment", "stretch").agg(F.collect_list(F.struct("at", "size")).alias("ranges"))
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payloads
    folder = archive.folder

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = store_of(folder)
        for batch in batches:
            for k in range(batch.num_rows):
                spans = sorted((s["at"], s["size"]) for s in batch.column(1)[k].as_py())
                with files.open_input_file(f"{path}/{batch.column(0)[k].as_py()}") as file:
                    for a in range(0, len(spans), 500):
                        got = []
                        for run in _adjoining(spans[a : a + 500]):
                            begin = run[0][0]
                            data = file.read_at(run[-1][0] + run[-1][1] - begin, begin)
                            got += [parse(data[at - begin : at - begin + size]) for at, size in run]
                        cols = [pa.array([int(r["page"]) if r["page"] else None for r in got], pa.int64()), pa.array([r["url"] for r in got], pa.string()), pa.array([r["bytes"] for r in got], pa.int64()), pa.array([r["digest"] for r in got], pa.string()), pa.array([r["kind"] for r in got], pa.string()), pa.array([int(r["refers_to"]) if r["refers_to"] else None for r in got], pa.int64())]
                        if payloads:
                            cols.append(pa.array([r["payload"] for r in got], pa.binary()))
                        yield pa.RecordBatch.from_arrays(cols, names)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    return ranges.select("segment", "ranges").mapInArrow(fetch, schema)


def _adjoining(spans: list[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
    """Sorted ranges in runs without a gap, which one read takes, of about ``READ_BYTES`` at most."""
    run: list[tuple[int, int]] = []
    for at, size in spans:
        if run and (at > run[-1][0] + run[-1][1] or at + size - run[0][0] > READ_BYTES):
            yield run
            run = []
        run.append((at, size))
    if run:
        yield run


OP4_SQL = f"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT payload_digest, min(page_id) AS original FROM p WHERE payload_bytes >= {REVISIT_BYTES} GROUP BY payload_digest
)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
  CASE WHEN g.original IS NULL OR g.original = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN g.original <> p.page_id THEN g.original END AS refers_to
FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest AND p.payload_bytes >= {REVISIT_BYTES}
"""
