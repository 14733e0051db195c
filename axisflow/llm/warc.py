"""WARC archives: writing, normalising monolithic gzip files to one member per record, and reading by offset.

Files go through pyarrow's file systems, so a folder may be local, HDFS or an object store. Every attempt writes files
of its own, and only rows of successful attempts name them; files of lost attempts are never read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from axisflow.llm.common import fresh_folder, kept, trimmed

VERSION = b"WARC/1.1"
WRITTEN = ["archive", "place", "page_id", "digest", "size"]
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def _one_line(s: str) -> str:
    return "".join(c if c.isprintable() and c != " " else f"%{ord(c):02X}" for c in s)


def record(headers: dict[str, str | None], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in headers.items() if v is not None), b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(row_id: str, page_id: str | None, url: str | None, payload: bytes, digest: str) -> bytes:
    """A response with the payload. Extension fields carry the page's id and the payload's length."""
    return record(
        {
            "WARC-Type": "response",
            "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, row_id)}>",
            "WARC-Date": DATE,
            "WARC-Target-URI": _one_line(url) if url else "urn:unknown",
            "WARC-Payload-Digest": f"sha256:{digest}",
            "X-Page-Id": page_id,
            "X-Payload-Length": str(len(payload)),
            "Content-Type": "application/http; msgtype=response",
        },
        HTTP % len(payload) + payload,
    )


def as_revisit(headers: dict[str, str], block: bytes, refers_to: str) -> tuple[dict[str, str], bytes]:
    """The headers and block of a response's record without its payload, which is that of another page."""
    return headers | {"WARC-Type": "revisit", "WARC-Profile": PROFILE, "X-Refers-To-Page-Id": refers_to}, block[: block.index(b"\r\n\r\n") + 4]


def inflated(source, step: int = 1 << 20) -> Iterator[bytes]:
    """The content of a gzip file of one or many members, a bounded piece at a time."""
    z = zlib.decompressobj(31)
    while data := source.read(step):
        while data:
            yield z.decompress(data, step)
            data = z.unconsumed_tail
            if z.eof:
                data, z = z.unused_data, zlib.decompressobj(31)
    yield z.flush()


def parsed_records(parts: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record; holds one record at a time."""
    buffer = bytearray()
    parts = iter(parts)

    def fill(n: int) -> bool:
        while len(buffer) < n:
            part = next(parts, None)
            if part is None:
                return False
            buffer.extend(part)
        return True

    while True:
        at = -1
        seen = 0
        while (at := buffer.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(buffer)
            if not fill(seen + 1):
                if bytes(buffer).strip():
                    raise ValueError("the archive ends within a record")
                return
        lines = bytes(buffer[:at]).decode().lstrip("\r\n").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        end = at + 4 + int(headers["Content-Length"])
        if not fill(end + 4):
            raise ValueError("the archive ends within a record")
        yield headers, bytes(buffer[at + 4 : end])
        del buffer[: end + 4]


def _open(folder: str):
    system, path = pafs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    return system, path


def write_monolithic(records: DataFrame, folder: str, most: int = 1 << 30, rows: int = 10_000) -> DataFrame:
    """archive, place, page_id, digest, size of every record: each task's rows as whole-file gzip streams, a new one after
    `most` bytes of content.

    records: row_id, page_id, url (strings), payload (binary).
    """

    @trimmed
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, path = _open(folder)
        out = z = name = None
        size, done = 0, []
        for batch in batches:
            for row in batch.itertuples(index=False):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, z, place, size = system.open_output_stream(f"{path}/{name}", compression=None), zlib.compressobj(6, zlib.DEFLATED, 31), 0, 0
                payload = row.payload or b""
                digest = hashlib.sha256(payload).hexdigest()
                data = page_record(row.row_id, row.page_id, row.url, payload, digest)
                out.write(z.compress(data))
                done.append((name, place, row.page_id, digest, len(payload)))
                place, size = place + 1, size + len(data)
                if size >= most:
                    out.write(z.flush()), out.close()
                    out = None
            if len(done) >= rows:
                yield pd.DataFrame(done, columns=WRITTEN)
                done = []
        if out is not None:
            out.write(z.flush()), out.close()
        yield pd.DataFrame(done, columns=WRITTEN)

    return records.mapInPandas(write, "archive string, place long, page_id string, digest string, size long")


def revisits(written: DataFrame, least: int, kind: DataType) -> DataFrame:
    """archive, place, refers_to: the records of `written` whose payload of at least `least` bytes the page with the
    smallest id (of type `kind`) has too.

    Digests are counted with map-side sums; only those that occur twice go into the join, of rows without payloads, which
    deals its rows out by itself so that Spark can split a hot digest."""
    pages = written.where(F.col("size") >= least).select("archive", "place", "digest", F.col("page_id").cast(kind).alias("_id"))
    first = pages.groupBy("digest").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1 AND _first IS NOT NULL")
    first = first.select(F.lower("digest").alias("_digest"), "_first")
    both = pages.join(first, F.col("digest") == F.col("_digest")).where(~F.col("_id").eqNullSafe(F.col("_first")))
    return both.select("archive", "place", F.col("_first").cast("string").alias("refers_to"))


def normalise(written: DataFrame, later: DataFrame, source: str, folder: str) -> DataFrame:
    """archive, offset, length, record_id: every file inflated once, every record rewritten as a member of its own, and
    those that `later` names (archive, place, refers_to) as revisits without their payload.

    The index rows are also written beside each new file, as a text file with a line for each record. written: the
    archives' names under `source`, in a column archive. A task holds the places of an archive's revisits and a record.
    """

    @trimmed
    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read, source_path = pafs.FileSystem.from_uri(source)
        system, path = _open(folder)
        for old, other in _by_archive(batches):
            name, at, rows = f"{uuid.uuid4().hex}.warc.gz", 0, []
            with read.open_input_stream(f"{source_path}/{old}", compression=None) as data, system.open_output_stream(f"{path}/{name}", compression=None) as out:
                for place, (headers, block) in enumerate(parsed_records(inflated(data))):
                    own = {k: v for k, v in headers.items() if k != "Content-Length"}
                    if place in other:
                        own, block = as_revisit(own, block, other[place])
                    z = zlib.compressobj(6, zlib.DEFLATED, 31)
                    member = z.compress(record(own, block)) + z.flush()
                    out.write(member)
                    rows.append((name, at, len(member), headers["WARC-Record-ID"]))
                    at += len(member)
            with system.open_output_stream(f"{path}/{name}.idx", compression=None) as sidecar:
                sidecar.write("".join(f"{o} {n} {r}\n" for _, o, n, r in rows).encode())
            yield pd.DataFrame(rows, columns=["archive", "offset", "length", "record_id"])

    archives = written.select("archive").distinct()
    work = archives.select("archive", F.lit(-1).cast("long").alias("place"), F.lit(None).cast("string").alias("refers_to")).unionAll(later)
    dealt = work.repartition(max(1, archives.count()), "archive").sortWithinPartitions("archive", "place")
    return dealt.mapInPandas(rewrite, "archive string, offset long, length long, record_id string")


def _by_archive(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, dict[int, str]]]:
    """(archive, {place: refers_to}) from sorted rows, of which each archive's first has place -1."""
    now, other = None, {}
    for batch in batches:
        for archive, place, refers_to in zip(batch["archive"], batch["place"], batch["refers_to"]):
            if place < 0:
                if now is not None:
                    yield now, other
                now, other = archive, {}
            else:
                other[place] = refers_to
    if now is not None:
        yield now, other


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """page_id (string), url, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to (string)
    of the records that an index names, each read by its offset. A payload that its digest denies is an error."""

    @trimmed
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, path = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            rows = []
            for archive, members in batch.groupby("archive", sort=False):
                with system.open_input_file(f"{path}/{archive}") as data:
                    for offset, length in sorted(zip(members["offset"], members["length"])):
                        data.seek(offset)
                        (headers, block), = parsed_records([zlib.decompress(data.read(length), 31)])
                        digest, size = headers["WARC-Payload-Digest"].removeprefix("sha256:"), int(headers["X-Payload-Length"])
                        payload = block[block.index(b"\r\n\r\n") + 4 :] if headers["WARC-Type"] == "response" else None
                        if payload is not None and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
                            raise ValueError(f"{archive} at {offset}: the payload isn't the one that its header names")
                        rows.append((headers.get("X-Page-Id"), headers["WARC-Target-URI"], payload, size, digest, headers["WARC-Type"], headers.get("X-Refers-To-Page-Id")))
            yield pd.DataFrame(rows, columns=["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return index.mapInPandas(read, "page_id string, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to string")


def plan_records(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """The rows that write_monolithic takes."""
    text = F.col(id_col).cast("string")
    return pages.select(F.concat_ws("/", text, F.uuid()).alias("row_id"), text.alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))


def archive_pages(pages: DataFrame, least: int = 100, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write pages as monolithic archives, normalise these, and read every record back by its offset.

    One row per input row: the id, payload_bytes, payload_digest, record_type, refers_to. A null html is an empty
    payload; a null url becomes urn:unknown; pages with a null id are written and read back with a null id, and a null
    id is referred to only never (of equal payloads the smallest non-null id responds, as do all rows that have it).
    Other columns aren't read; an empty table gives no rows. Archives and index are left in the shared folder.

    Payloads are never shuffled: they go into the first archives where they are read, and which of them another page has
    too, known once all digests are, is applied when an archive is rewritten.
    """
    spark, kind = pages.sparkSession, pages.schema[id_col].dataType
    base = fresh_folder(spark, "warc")
    written = kept(write_monolithic(plan_records(pages, id_col, url_col, html_col), f"{base}/raw"))
    index = kept(normalise(written, revisits(written, least, kind), f"{base}/raw", f"{base}/members"))
    found = read_records(index, f"{base}/members")
    return found.select(F.col("page_id").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
