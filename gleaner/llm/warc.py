"""WARC archives: a writer with revisit records and a splittable reader.

Archives are one gzip member per record.  The reader cuts every archive into
byte ranges; a task looks for gzip magic in its range, takes a position as a
record's start only if the bytes there inflate to a WARC header, and owns the
records that start inside its range (the last one may end outside).
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
#: Bytes of an archive that one reading task owns.
SPLIT_BYTES = 4 << 20
#: Payload bytes from which equal payloads become revisit records.
MIN_REVISIT_BYTES = 1000
#: Rows that one archive holds at most.
ARCHIVE_ROWS = 20_000

#: The table of a folder's archives.
MANIFEST = "_archives"

RECORD = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload string, archive string, record_offset long"


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def render(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One record as a gzip member.  A revisit keeps the HTTP header (whose
    Content-Length is that of the payload) and leaves the payload out."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = [
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Page-ID: {'' if page_id is None else page_id}",
        "WARC-Date: 2024-01-01T00:00:00Z",
        "Content-Type: application/http; msgtype=response",
        "WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    return gzip.compress(VERSION + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", compresslevel=5, mtime=0)


def _parse(data: bytes) -> dict:
    head, _, block = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    http_fields = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't match its digest")
    page, refers = fields["WARC-Page-ID"].strip(), fields.get("WARC-Refers-To-Page-ID")
    return {
        "page_id": int(page) if page else None, "url": fields.get("WARC-Target-URI"), "record_type": kind, "refers_to": int(refers) if refers else None,
        "payload_digest": digest, "payload_bytes": int(http_fields["Content-Length"]), "payload": payload.decode() if kind == "response" else None,
    }


class _Window:
    """Buffered reads of a file from a position on."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.data = file, size, 0, b""

    def get(self, pos: int, n: int) -> bytes:
        n = min(n, self.size - pos)
        if n <= 0:
            return b""
        if pos < self.at or pos + n > self.at + len(self.data):
            self.file.seek(pos)
            self.at, self.data = pos, self.file.read(max(n, min(1 << 20, self.size - pos)))
        return self.data[pos - self.at : pos - self.at + n]


def _starts(window: _Window, pos: int) -> bool:
    """Whether a record's member starts at ``pos``: its first bytes must inflate
    to the version line."""
    try:
        return zlib.decompressobj(31).decompress(window.get(pos, 4096), len(VERSION)) == VERSION
    except zlib.error:
        return False


def _member(window: _Window, pos: int) -> tuple[bytes, int]:
    """The member at ``pos``, inflated, and where it ends."""
    z, out, at = zlib.decompressobj(31), [], pos
    while not z.eof:
        chunk = window.get(at, 1 << 16)
        if not chunk:
            raise ValueError(f"the member at {pos} is cut off")
        out.append(z.decompress(chunk))
        at += len(chunk)
    return b"".join(out), at - len(z.unused_data)


def read_range(file, size: int, begin: int, end: int) -> Iterator[tuple[int, dict]]:
    """The records that start in ``[begin, end)``."""
    window, pos, end = _Window(file, size), begin, min(end, size)
    while pos < end:
        # Find the next validated member; a magic may begin in the range's last bytes.
        step = window.get(pos, min(1 << 16, end - pos) + len(MAGIC) - 1)
        found = step.find(MAGIC)
        while found >= 0 and pos + found < end and not _starts(window, pos + found):
            found = step.find(MAGIC, found + 1)
        if found < 0 or pos + found >= end:
            pos += max(1, len(step) - len(MAGIC) + 1)
            continue
        pos += found
        while pos < end:
            data, after = _member(window, pos)
            if not data.startswith(VERSION):
                raise ValueError(f"the member at {pos} isn't a WARC record")
            yield pos, _parse(data)
            pos = after


def mark_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``pages`` plus payload_bytes, payload_digest, record_type, refers_to.

    The keeper of a digest is an aggregate with partial sums; it is joined back
    by an ordinary join, whose hot keys Spark may split.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    sized = pages.select("page_id", "url", html.alias("html"), F.octet_length(html).cast("long").alias("payload_bytes"), F.sha1(html.cast("binary")).alias("payload_digest"))
    narrow = pages.select("page_id", F.octet_length(html).alias("b"), F.sha1(html.cast("binary")).alias("payload_digest"))
    keeper = narrow.where(F.col("b") >= min_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1 and keeper is not null").select("payload_digest", "keeper")
    joined = sized.join(keeper, "payload_digest", "left")
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper")) & (F.col("payload_bytes") >= min_bytes)
    return joined.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("keeper"))).drop("keeper")


def write_warc(marked: DataFrame, path: str, archive_rows: int = ARCHIVE_ROWS) -> DataFrame:
    """Write the records under ``path``, one or more archives a task, and return the
    table of them (archive, records, bytes), which is written beside them.

    Every attempt of a task writes archives of its own names.  Its rows of the table
    count only if Spark commits the attempt, so of attempts that ran again, or side by
    side, one's archives are all listed and the others' not at all; those stay unread."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        fs, root = _filesystem(path)
        fs.create_dir(root, recursive=True)
        part, rows, out, done = 0, 0, None, []

        def close():
            nonlocal out, part, rows
            if out is not None:
                out.close()
                fs.move(temp, f"{root}/{name()}")
                done.append((name(), rows, fs.get_file_info(f"{root}/{name()}").size))
                out, part, rows = None, part + 1, 0

        def name():
            return f"part-{task:05d}-{part:04d}-{attempt}.warc.gz"

        temp = f"{root}/_attempt-{attempt}"
        for batch in batches:
            for page_id, url, html, digest, refers in zip(batch.page_id, batch.url, batch.html, batch.payload_digest, batch.refers_to, strict=True):
                if out is None:
                    out = fs.open_output_stream(temp, compression=None)
                whole = lambda x: None if pd.isna(x) else int(x)
                out.write(render(whole(page_id), url, html.encode(), digest, whole(refers)))
                rows += 1
                if rows >= archive_rows:
                    close()
        close()
        yield pd.DataFrame(done, columns=["archive", "records", "bytes"])

    # ids as text: pandas would turn nullable longs into doubles
    columns = marked.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", "payload_digest", F.col("refers_to").cast("string").alias("refers_to"))
    listed = f"{path}/{MANIFEST}"
    columns.mapInPandas(write, "archive string, records long, bytes long").write.mode("overwrite").parquet(listed)
    return marked.sparkSession.read.parquet(listed)


def _archives(spark, path: str) -> DataFrame:
    """(path, length) of the archives that ``write_warc`` listed, or of all where it
    wrote no table."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{MANIFEST}/_SUCCESS")
    if mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
        return spark.read.parquet(f"{path}/{MANIFEST}").select(F.concat(F.lit(path.rstrip("/") + "/"), "archive").alias("path"), F.col("bytes").alias("length"))
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("path", "length")


def read_warc(spark, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """All records of the archives under ``path`` (columns: ``RECORD``)."""
    ranges = _archives(spark, path).where("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long"))).alias("begin"))
    # Many small files share a listing task; deal the ranges out evenly.
    n = max(1, min(100_000, ranges.count()))
    ranges = ranges.repartition(n, "path", "begin")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in RECORD.split(", ")]

        def frame(rows):
            out = pd.DataFrame(rows, columns=names)
            for c in ("page_id", "refers_to"):
                out[c] = out[c].astype("Int64")
            return out

        for batch in batches:
            for name, size, begin in zip(batch.path, batch.length, batch.begin, strict=True):
                fs, file = _filesystem(name)
                rows, held = [], 0
                with fs.open_input_file(file) as f:
                    for at, r in read_range(f, int(size), int(begin), int(begin) + split_bytes):
                        rows.append([*(r[c] for c in names[:7]), file.rsplit("/", 1)[-1], at])
                        held += len(r["payload"] or "")
                        if held > 8 << 20 or len(rows) >= 2000:
                            yield frame(rows)
                            rows, held = [], 0
                if rows:
                    yield frame(rows)

    return ranges.mapInPandas(read, RECORD)


def archive(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``pages(page_id, url, html)`` as WARC archives and read them back.

    Null html is an empty payload; a null page_id is written and read as null and
    is never the target of a revisit; repeated rows are records each (of equal
    payloads with the largest page_id on several rows, all are responses); an
    empty table gives no archive and no record.  Extra columns are ignored.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    written = write_warc(mark_revisits(pages), path).agg(F.sum("records").alias("n")).first()
    if not written["n"]:
        return spark.createDataFrame([], RECORD)
    return read_warc(spark, path)


def op7_warc(spark, sf_dir):
    """Every page as a WARC record, written and read back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return archive(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH p AS (
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), k AS (
    SELECT payload_digest, max(page_id) AS keeper FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest
)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN k.keeper <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN k.keeper <> p.page_id THEN k.keeper END AS refers_to
FROM p LEFT JOIN k ON p.payload_digest = k.payload_digest AND p.payload_bytes >= 1000
"""
