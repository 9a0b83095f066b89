"""WARC archives: written with an index, read back by coalesced byte ranges.

Each task writes archives of its own to the shared store, one gzip member a
record, and gives back where each record lies. A read sorts the wanted index
rows by place, joins neighbouring ranges into one read and cuts it up again.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import quote, unquote, urlparse

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.rows import spread_join
from lodestack.plans.storage import Scratch

#: A new archive begins beyond this size.
ARCHIVE_BYTES = 1 << 30
#: Ranges closer than GAP are read as one, up to SPAN.
GAP, SPAN = 64 << 10, 8 << 20
#: Most bytes of archives that a reading task gets.
TASK_BYTES = 256 << 20
#: Hadoop's names for a file system that pyarrow calls otherwise.
_SCHEMES = {"s3a": "s3", "s3n": "s3"}
DATE = "1970-01-01T00:00:00Z"
INDEX = "page_id long, url string, payload_digest string, record_type string, archive string, offset long, length long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@contextmanager
def _opened(uri: str, mode: str):
    """A file of the shared store: a plain file, or whatever file system of
    pyarrow the URI names (object stores, HDFS)."""
    if urlparse(uri).scheme in ("", "file"):
        path = unquote(urlparse(uri).path)
        if mode == "wb":
            os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, mode) as file:
            yield file
    else:
        from pyarrow.fs import FileSystem

        scheme, _, rest = uri.partition("://")
        store, path = FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}://{rest}")
        if mode == "wb":
            store.create_dir(os.path.dirname(path), recursive=True)
            with store.open_output_stream(path) as file:
                yield file
        else:
            with store.open_input_file(path) as file:
                yield file


def digest(payload: bytes) -> str:
    """The bare base32 SHA-1 that WARC files name payloads by."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> tuple[bytes, str]:
    """One record as a gzip member, and its payload digest. A revisit holds the
    HTTP head alone; the payload's size and digest are those of the whole."""
    name = digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    # Line ends and other controls in a URL would end the header line.
    target = "urn:unknown" if url is None else "".join(quote(c) if ord(c) < 33 or ord(c) == 127 else c for c in url)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{name}", "Content-Type: application/http;msgtype=response"]
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    head.append(f"Content-Length: {len(block)}")
    whole = "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"
    gzip = zlib.compressobj(4, zlib.DEFLATED, 31)
    return gzip.compress(whole) + gzip.flush(), name


def parse(member: bytes) -> dict:
    """The fields and the payload of one record; a payload that does not match
    its digest is an error."""
    whole = zlib.decompress(member, 31)
    head, _, rest = whole.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rsplit(b"Content-Length: ", 1)[1])
    name = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or digest(payload) != name):
        raise ValueError(f"record {fields['WARC-Record-ID']} does not match its digest")
    page = lambda x: None if x is None or x == "<urn:page:none>" else int(x[len("<urn:page:") : -1])
    url = fields["WARC-Target-URI"]
    return {"page_id": page(fields["WARC-Record-ID"]), "url": None if url == "urn:unknown" else url, "payload_bytes": size, "payload_digest": name, "record_type": kind, "refers_to": page(fields.get("WARC-Refers-To")), "payload": payload if kind == "response" else None}


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, html, url, refers_to): for pages whose payload of at least
    ``least_bytes`` a smaller page_id holds too, that page.

    Only digests and ids are grouped and joined; pages meet what they refer to
    by their id. A payload that a third of all pages share is dealt to several
    parts. A null html is an empty payload. Rows of equal page_id and payload
    get the same answer, each of them; a null page_id refers to nothing and
    nothing to it. Other columns are not read; an empty table gives an empty
    result.
    """
    body = F.coalesce(F.col("html").cast("binary"), F.lit(b"").cast("binary"))
    ids = pages.select("page_id", F.sha1(body).alias("sha"), F.octet_length(body).alias("size")).filter(F.col("page_id").isNotNull() & (F.col("size") >= least_bytes))
    first = ids.groupBy("sha").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).filter("last > first")
    again = spread_join(ids, first, ["sha"], F.col("page_id")).filter("page_id > first").groupBy(F.col("page_id").alias("_p"), F.col("sha").alias("_s")).agg(F.min("first").alias("refers_to"))
    rows = pages.select("page_id", "url", body.alias("html"))
    return rows.join(again, (F.col("page_id") == F.col("_p")) & (F.sha1("html") == F.col("_s")), "left").select("page_id", "url", "html", "refers_to")


def write(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Write a record for each row of ``pages`` (page_id, url, html) and return
    the index. A file name holds the task's attempt, so a repeated task leaves
    the archives of the attempt that counts alone. Null html, ties and repeated
    rows are as in ``revisits``, a record for each row; a null url is written as
    one that ``read`` gives back as null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        files = 0
        batches = iter(batches)
        rows = ((batch, i) for batch in batches for i in range(batch.num_rows))
        row = next(rows, None)
        while row is not None:
            uri = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{files:04d}-{uuid.uuid4().hex[:8]}.warc.gz"
            files, offset, out = files + 1, 0, []
            with _opened(uri, "wb") as file:
                while row is not None and offset < ARCHIVE_BYTES:
                    batch, i = row
                    page, url, html, refers = (batch.column(c)[i].as_py() for c in range(4))
                    member, name = record(page, url, html, refers, refers is not None)
                    file.write(member)
                    out.append((page, url, name, "response" if refers is None else "revisit", uri, offset, len(member)))
                    offset += len(member)
                    row = next(rows, None)
                    if len(out) >= 5000:
                        yield _batch(out)
                        out = []
            if out:
                yield _batch(out)

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], ["page_id", "url", "payload_digest", "record_type", "archive", "offset", "length"])

    return revisits(pages, least_bytes).mapInArrow(run, INDEX)


def ranges(places: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, list[int]]]:
    """Coalesced reads (archive, offset, length, rows) of places in order."""
    own: list[int] = []
    archive, start, stop = "", 0, 0
    for k, (name, offset, length) in enumerate(places):
        if own and (name != archive or offset - stop > GAP or offset + length - start > SPAN):
            yield archive, start, stop - start, own
            own = []
        if not own:
            archive, start, stop = name, offset, offset
        own.append(k)
        stop = max(stop, offset + length)
    if own:
        yield archive, start, stop - start, own


def read(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the rows of ``index`` (any selection of it).

    Rows are dealt by archive and span, so that a task reads whole stretches
    and no task gets more of one archive than a span at a time. The number of
    tasks follows the bytes to read, not those of the index. Rows given twice
    are read twice; an empty index gives an empty result.
    """
    fields = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = list(zip(*(batch.column(c).to_pylist() for c in range(3))))
            for archive, start, length, rows in ranges(places):
                with _opened(archive, "rb") as file:
                    file.seek(start)
                    block = file.read(length)
                found = [parse(block[places[k][1] - start : places[k][1] - start + places[k][2]]) for k in rows]
                if not payloads:
                    for x in found:
                        x["payload"] = None
                yield pa.RecordBatch.from_arrays([pa.array([x[f] for x in found], t) for f, t in zip(fields, kinds)], fields)

    size = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, -(-size // TASK_BYTES), min(size // SPAN, 2 * index.sparkSession.sparkContext.defaultParallelism))
    dealt = index.select("archive", "offset", "length").repartition(tasks, "archive", F.floor(F.col("offset") / SPAN)).sortWithinPartitions("archive", "offset")
    return dealt.mapInArrow(run, RECORD)


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    scratch = Scratch(spark, "warc")
    index = scratch.table(write(pages, scratch.path("archives")), "index")
    return read(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(1 + ((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM p JOIN f USING (h)
"""
