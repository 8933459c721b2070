"""WARC archives as a chunked record table.

A record is a run of rows (``record``, ``chunk_no``, ``last``, ``data``, ``payload_sha256``): the ``data`` of its
chunks, in order, are the bytes of one WARC/1.1 record, header first. A chunk is bounded, so a payload of any size is
written and read without a record-sized allocation in Python, and each row carries the digest of the payload
up to and with that chunk. The table is written by Spark's committer, which outlives lost executors.
"""

from __future__ import annotations

import hashlib
import uuid
from datetime import UTC, datetime
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Payload bytes in a chunk, and chunk bytes that are handed to Arrow at a time.
CHUNK = 1 << 18
FLUSH = 4 << 20
#: Payloads below this size are never written as revisits.
MIN_REVISIT = 100
SCHEMA = "record string, chunk_no bigint, last boolean, data binary, payload_sha256 string"


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Which pages are responses and which revisit another one.

    Returns ``page_id``, ``url``, ``payload`` (null: empty), ``digest`` and ``refers_to``. Of equal payloads of
    at least ``min_revisit`` bytes the smallest id is the response and the others refer to it; rows that repeat
    that id are responses as well. A null id never is one that others refer to; if all ids of a group are null
    they are all responses.

    The group's smallest id comes from an aggregate with partial sums of 64-byte digests, and goes back by an
    equi-join that adaptive execution can split where one payload makes up much of the table.
    """
    rows = pages.select(
        pages[id_col].alias("page_id"), pages[url_col].cast("string").alias("url"),
        F.encode(F.coalesce(pages[payload_col].cast("string"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    firsts = (
        rows.where(F.octet_length("payload") >= min_revisit)
        .groupBy(F.col("digest").alias("d"))
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
        .where("n > 1 and first_id is not null")
        .drop("n")
    )
    joined = rows.join(firsts, F.col("digest") == F.col("d"), "left")
    return joined.select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("refers_to"))


def record_id(kind: str, page_id: str, digest: str) -> str:
    """A record's URN: a name-based UUID of its type, page and payload digest, so a revisit can name its response."""
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind} {page_id} {digest}')}"


def _header(page_id, url: str | None, digest: str, size: int, refers_to, date: str) -> bytes:
    revisit = refers_to is not None
    kind, name = "revisit" if revisit else "response", quote(str(page_id), safe="") if page_id is not None else ""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    safe = "".join(ch if ch > " " and ch != "\x7f" else quote(ch) for ch in (url or "urn:photonlake:no-uri"))
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id(kind, name, digest)}>", f"WARC-Date: {date}",
             *([f"WARC-Page-ID: {name}"] if page_id is not None else []), f"WARC-Target-URI: {safe}",
             "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}"]
    if revisit:
        first = quote(str(refers_to), safe="")
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: <{record_id('response', first, digest)}>", f"WARC-Refers-To-Page: {first}"]
    lines.append(f"Content-Length: {len(http) + (0 if revisit else size)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def to_chunks(planned: DataFrame, chunk: int = CHUNK, date: str | None = None) -> DataFrame:
    """The chunk table of planned records, all of one ``date`` (null: now). A revisit has no payload; its header names length and digest."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches):
        task, number = TaskContext.get().partitionId(), 0
        rows, held = [], 0

        def flushed():
            cols = list(zip(*rows, strict=True))
            kinds = [pa.string(), pa.int64(), pa.bool_(), pa.binary(), pa.string()]
            names = ["record", "chunk_no", "last", "data", "payload_sha256"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

        for batch in batches:
            ids, urls, digests, refers = (batch.column(k).to_pylist() for k in (0, 1, 3, 4))
            payloads = batch.column(2)
            for i in range(batch.num_rows):
                record, number = f"{task:06d}-{number:09d}", number + 1
                view = memoryview(payloads[i].as_buffer())
                data = _header(ids[i], urls[i], digests[i], len(view), refers[i], date)
                size = 0 if refers[i] is not None else len(view)
                sha, at, k = hashlib.sha256(), 0, 0
                while True:
                    piece = view[at : min(at + chunk, size)]
                    sha.update(piece)
                    at += len(piece)
                    done = at >= size
                    data = b"".join((data, piece, b"\r\n\r\n" if done else b""))
                    rows.append((record, k, done, data, sha.hexdigest()))
                    held += len(data)
                    if held >= FLUSH:
                        yield flushed()
                        rows, held = [], 0
                    if done:
                        break
                    data, k = b"", k + 1
        if rows:
            yield flushed()

    cols = ["page_id", "url", "payload", "digest", "refers_to"]
    return planned.select(*cols).mapInArrow(run, SCHEMA)


def read_chunks(chunks: DataFrame, id_type: str = "bigint") -> DataFrame:
    """Read records back: ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``.

    A record of one chunk is read where it lies. The chunks of a longer one meet in order (a shuffle by record, as
    a file may be split inside it) and stream through running digests. Of a response, length and digest are those of the bytes read; a digest that differs
    from the header's or from the running one of a chunk, a missing chunk or a wrong length fails the job. Of a
    revisit they are what its header says of the payload it stands for.
    """
    convert = str if id_type == "string" else int
    arrow_id = {"string": pa.string(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}.get(id_type, pa.int64())

    def run(batches):
        now: dict = {}

        def closed() -> tuple:
            head, size = now["head"], now["size"]
            revisit = head["WARC-Type"] == "revisit"
            digest = head["WARC-Payload-Digest"].partition(":")[2]
            if now["left"] != 0 or (not revisit and (digest != now["sha"].hexdigest() or size != now["stated"])):
                raise ValueError(f"record {now['record']} is damaged")
            page, refers = head.get("WARC-Page-ID"), head.get("WARC-Refers-To-Page")
            return (None if page is None else convert(unquote(page)), now["stated"] if revisit else size,
                    digest if revisit else now["sha"].hexdigest(), head["WARC-Type"], None if refers is None else convert(unquote(refers)))

        def built(rows):
            cols = list(zip(*rows, strict=True))
            kinds = [arrow_id, pa.int64(), pa.string(), pa.string(), arrow_id]
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

        for batch in batches:
            rows = []
            records, numbers, digests = (batch.column(k).to_pylist() for k in (0, 1, 3))
            for i, (record, k, said) in enumerate(zip(records, numbers, digests, strict=True)):
                view = memoryview(batch.column(2)[i].as_buffer())
                if k == 0:
                    if now:
                        rows.append(closed())
                    # A header is whole in the first chunk, however long it is.
                    raw = bytes(view)
                    end = raw.index(b"\r\n\r\n")
                    head, http = raw[:end], raw[end + 4 : raw.index(b"\r\n\r\n", end + 4)]
                    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
                    stated = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
                    left = int(fields["Content-Length"]) - len(http) - 4
                    view = view[len(head) + 4 + len(http) + 4 :]
                    now = {"record": record, "head": fields, "sha": hashlib.sha256(), "size": 0, "stated": stated, "left": left, "next": 0}
                if now["record"] != record or now["next"] != k:
                    raise ValueError(f"record {record} lacks a chunk")
                now["next"] = k + 1
                piece = view[: now["left"]]
                now["sha"].update(piece)
                now["size"] += len(piece)
                now["left"] -= len(piece)
                if said != now["sha"].hexdigest():
                    raise ValueError(f"chunk {k} of record {record} is damaged")
            if rows:
                yield built(rows)
        if now:
            yield built([closed()])

    schema = f"page_id {id_type}, payload_bytes bigint, payload_digest string, record_type string, refers_to {id_type}"
    whole = F.col("last") & (F.col("chunk_no") == 0)
    cols = ["record", "chunk_no", "data", "payload_sha256"]
    longer = chunks.where(~whole).select(*cols).repartition("record").sortWithinPartitions("record", "chunk_no")
    return chunks.where(whole).select(*cols).mapInArrow(run, schema).union(longer.mapInArrow(run, schema))


def write_archive(pages: DataFrame, path: str, chunk: int = CHUNK, date: str | None = None, **columns) -> None:
    """Write a WARC record for each row of ``pages`` to the chunk table at ``path``.

    Null payloads are empty, null and empty urls get a URN that says so, control characters and spaces of urls and ids
    are percent-encoded (ids come back as they were), repeated rows make repeated records of one record id; an empty table
    makes an empty archive. Columns beside id, url and payload are not read. Ids can be of any integer or string type.
    ``date`` is all records' WARC-Date (null: the time of the call).
    """
    to_chunks(plan_records(pages, **columns), chunk, date).write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_archive(spark, path: str, id_type: str = "bigint") -> DataFrame:
    """The records of the archive at ``path``; see :func:`read_chunks`."""
    return read_chunks(spark.read.schema(SCHEMA).parquet(path), id_type)
