"""WARC archives as a chunked record table: payloads pass in chunks of bounded size, with digests carried from chunk to chunk."""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm.common import read, settle, shared_dir, text_of

#: Bytes of a payload chunk.
CHUNK = 1 << 18
_VERSION = b"WARC/1.1\r\n"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _open(uri: str, mode: str):
    """A stream on a file of the shared folder, whatever file system it is on."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    if mode == "w":
        system.create_dir(path.rpartition("/")[0], recursive=True)
        return system.open_output_stream(path)
    return gzip.GzipFile(fileobj=system.open_input_stream(path, buffer_size=1 << 20), mode="rb")


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{page_id}')}>"


def first_holders(pages: DataFrame, id_col: str, payload_col: str, least: int = 0) -> DataFrame:
    """(id_col, holder): for each page whose payload of `least` bytes or more an earlier id holds too, the smallest such id.

    Only hashes and ids are shuffled; the digest is compared in full (SHA-1 and length).
    """
    p = text_of(payload_col)
    thin = settle(pages.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.sha1(p.cast("binary"))).alias("sha"), F.octet_length(p).alias("n")).where(F.col("id").isNotNull() & (F.col("n") >= least)))
    groups = settle(thin.groupBy("sha", "n").agg(F.min("id").alias("holder"), F.max("id").alias("last")).where("holder < last"))
    return thin.join(groups, ["sha", "n"]).where("id > holder").select("id", "holder").distinct()


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_least: int = 0, date: str = "2020-01-01T00:00:00Z") -> DataFrame:
    """Write a WARC record per row of pages into files under folder; the manifest (path, records) names those of the tasks that succeeded.

    A record is a response with its payload, or a revisit if a page with a smaller id has an equal
    payload of at least revisit_least bytes; it then has that page's record as WARC-Refers-To and no
    payload, but the full payload's length and digest. Null payload is the empty payload, null url is
    left out; rows of one id with equal payloads are all responses, and a row without id is a response.
    A retried task writes to a new file, so a half written one is never read.
    """
    holders = first_holders(pages, id_col, payload_col, revisit_least).withColumnRenamed("id", "holder_of")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), text_of(payload_col).alias("payload")).join(holders.hint("shuffle_hash"), F.col("id") == F.col("holder_of"), "left").select("id", "url", "payload", "holder")

    def run(batches):
        import pyarrow as pa

        path, out, n = f"{folder}/{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            for i in range(batch.num_rows):
                if out is None:
                    out = _open(path, "w")
                key, url, holder = batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), batch.column(3)[i].as_py()
                payload = batch.column(2)[i].as_buffer()
                digest = hashlib.sha1(payload)
                head = [f"WARC-Type: {'response' if holder is None else 'revisit'}", f"WARC-Record-ID: {record_id(key)}", f"WARC-Date: {date}", f"X-Page-ID: {'' if key is None else key}", f"WARC-Payload-Digest: sha1:{base64.b32encode(digest.digest()).decode()}", f"X-Payload-Length: {payload.size}"]
                if url is not None:
                    head.append(f"WARC-Target-URI: {url}".replace("\r", "%0D").replace("\n", "%0A"))
                if holder is not None:
                    head += [f"WARC-Refers-To: {record_id(holder)}", f"X-Refers-To-Page: {holder}", f"WARC-Profile: {_REVISIT}"]
                http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
                head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (payload.size if holder is None else 0)}"]
                # a gzip member for each record, as archives have it
                with gzip.GzipFile(fileobj=out, mode="wb", compresslevel=1, mtime=0) as member:
                    member.write(_VERSION + "\r\n".join(head).encode() + b"\r\n\r\n" + http)
                    if holder is None:
                        for at in range(0, payload.size, CHUNK):
                            member.write(payload.slice(at, min(CHUNK, payload.size - at)))
                    member.write(b"\r\n\r\n")
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], ["path", "records"])

    return settle(rows.mapInArrow(run, "path string, records long"))


def _line(stream, rest: bytearray, most: int = 1 << 16) -> bytes:
    """Bytes up to and with the next CRLF; rest holds what has been read ahead."""
    seen = 0
    while (at := rest.find(b"\r\n", seen)) < 0:
        seen = max(0, len(rest) - 1)
        more = stream.read(1 << 16)
        if not more:
            at = len(rest) - 2
            break
        rest += more
        if len(rest) > most + (1 << 16):
            raise ValueError("a WARC header line is too long")
    out = bytes(rest[: at + 2])
    del rest[: at + 2]
    return out


def read_chunks(path: str, chunk: int = CHUNK) -> Iterator[tuple[dict[str, str], int, bytes, str, int, bool]]:
    """(headers, chunk number, payload bytes, digest of the payload so far, bytes so far, last) of each record's chunks, in file order. At least one chunk comes for each record; no more than a chunk and a header are held."""
    stream, rest = _open(path, "r"), bytearray()
    while True:
        line = _line(stream, rest)
        if not line:
            return
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{path}: no WARC record where one should begin")
        head: dict[str, str] = {}
        while (line := _line(stream, rest)) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        left = int(head.get("content-length", 0))
        if head.get("content-type", "").startswith("application/http"):
            while left > 0:
                line = _line(stream, rest)
                left -= len(line)
                if line in (b"\r\n", b""):
                    break
        digest, done, number = hashlib.sha1(), 0, 0
        while True:
            part = bytes(rest[: min(left, chunk)])
            del rest[: len(part)]
            while len(part) < min(left, chunk):
                more = stream.read(min(left, chunk) - len(part))
                if not more:
                    raise ValueError(f"{path}: a record is cut off")
                part += more
            left -= len(part)
            done += len(part)
            digest.update(part)
            yield head, number, part, base64.b32encode(digest.digest()).decode(), done, left == 0
            number += 1
            if left == 0:
                break


SCHEMA = "record_id string, chunk_no int, page_id long, url string, record_type string, refers_to long, declared_bytes long, declared_digest string, bytes_so_far long, digest_so_far string, last boolean, chunk binary"


def chunk_table(manifest: DataFrame, keep_bytes: bool = True) -> DataFrame:
    """The chunked record table of archives: a row per record and chunk number (see SCHEMA), written out chunk by chunk as read.

    keep_bytes=False leaves `chunk` null, for those who want the digests alone. Rows go out in batches of
    a few chunks, so an oversized record never stands in memory whole.
    """

    def run(batches):
        import pyarrow as pa

        types = (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.binary())
        names = [x.split()[0] for x in SCHEMA.split(", ")]

        def number(x):
            return int(x) if x else None

        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                for head, no, part, digest, done, last in read_chunks(path):
                    rows.append((head.get("warc-record-id"), no, number(head.get("x-page-id")), head.get("warc-target-uri"), head.get("warc-type"), number(head.get("x-refers-to-page")), number(head.get("x-payload-length")), head.get("warc-payload-digest", "").removeprefix("sha1:"), done, digest, last, part if keep_bytes else None))
                    held += len(part) * keep_bytes
                    if held >= 8 * CHUNK or len(rows) >= 2000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    paths = manifest.select("path")
    return paths.repartition(max(1, manifest.count())).mapInArrow(run, SCHEMA)


def op6_chunked_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC records and read back; a row per row of pages. Null payloads are empty ones; an empty table gives no archive and no row."""
    manifest = write_archives(read(spark, sf_dir, "pages"), f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    last = chunk_table(manifest, keep_bytes=False).where("last")
    full = F.col("record_type") == "response"
    # a response's length and digest are those of the bytes read back; a revisit has none of its own
    return last.select("page_id", F.when(full, F.col("bytes_so_far")).otherwise(F.col("declared_bytes")).alias("payload_bytes"), F.when(full, F.col("digest_so_far")).otherwise(F.col("declared_digest")).alias("payload_digest"), "record_type", "refers_to")


def oracle() -> str:
    """DuckDB SQL of op6: digests of the payloads, and the smallest page of equal ones."""
    char = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> {}) & 31 AS INT) + 1, 1)"
    four = " || ".join(char.format(n) for n in (15, 10, 5, 0))
    return f"""WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT *, min(page_id) OVER (PARTITION BY n, h) AS holder FROM p),
b AS (SELECT page_id, i, CAST('0x' || substr(h, 5 * i + 1, 5) AS BIGINT) AS v FROM p, range(8) r(i)),
s AS (SELECT page_id, string_agg({four}, '' ORDER BY i) AS digest FROM b GROUP BY page_id)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = holder THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> holder THEN holder END AS refers_to FROM d JOIN s USING (page_id)"""
