"""A deterministic sharded WARC writer and its reader.

Records are range-sorted by page id into shards; a task writes one shard, one gzip member a record, and rolls to the
next file once the compressed size passes ``roll_bytes``. Headers and digests are made anew from the payload. Files are
written under temporary names; the manifest of the attempts that succeeded gives them their own names (``commit``).
The same rows give the same bytes, however Spark split the input.

Payloads of at least ``min_revisit`` bytes that are equal (by SHA-1 and length) are stored once, in the record with the
largest page id; the others become revisit records without a body, whose stored HTTP header still gives the length.
Only one row a digest takes part in finding them, so a payload that a third of all rows share is no hot group.

Defined cases: null html is an empty payload; payloads of any size are written whole; a null url gives a record without a
target; page ids of any type come back in their type (integers are ordered as numbers, others by code point); a null page id
has a record id of its own and sorts first; rows that repeat the largest page id of a payload are all responses; an empty
table gives no file and an empty result. Other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkreg.functions.storage import bounded_broadcast, materialise, new_folder
from sparkreg.llm.layout import NewFile, commit, file_tasks, rows_of, sorted_shards

MANIFEST = "name string, temp string, shard int, seq int, records long, bytes long, sha256 string"
RECORDS = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string, file string"
_ARROW = pa.schema([("page_id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("url", pa.string()), ("file", pa.string())])


def _urn(page_id: str | None) -> str:
    return "<urn:x-no-page:0>" if page_id is None else f"<urn:x-page:{quote(page_id, safe='')}>"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _target(url: str | None) -> str | None:
    return None if url is None else re.sub("[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(page_id, url, payload: bytes, refers_to, refers_url, is_revisit: bool, date: str) -> bytes:
    """One WARC/1.1 record, uncompressed."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block += b"" if is_revisit else payload
    head = [("WARC-Type", "revisit" if is_revisit else "response"), ("WARC-Record-ID", _urn(page_id)), ("WARC-Date", date), ("WARC-Target-URI", _target(url))]
    if is_revisit:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _urn(refers_to)), ("WARC-Refers-To-Target-URI", _target(refers_url))]
    head += [("WARC-Payload-Digest", _sha1(payload)), ("WARC-Block-Digest", _sha1(block)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head if v is not None) + "\r\n").encode() + block + b"\r\n\r\n"


def _member(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_warc(
    pages: DataFrame, folder: str, *, min_revisit: int = 1000, records_per_shard: int = 4_000, roll_bytes: int = 64 << 20,
    level: int = 6, date: str = "1970-01-01T00:00:00Z", prefix: str = "part",
) -> DataFrame:
    """Write pages (page_id, url, html) as WARC files below folder; returns the manifest."""
    base = pages.select(F.col("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload"))
    base = base.withColumn("digest", F.sha1("payload")).withColumn("n", F.octet_length("payload").cast("long"))
    shared = base.where(F.col("n") >= min_revisit).groupBy("digest", "n")
    shared = shared.agg(F.max(F.struct("page_id", "url")).alias("m"), F.count(F.lit(1)).alias("c")).where("c > 1")
    shared = materialise(shared.select(F.col("digest").alias("d"), F.col("n").alias("dn"), F.col("m.page_id").alias("to"), F.col("m.url").alias("to_url")), "warc-shared")
    rows = base.join(bounded_broadcast(shared), (F.col("digest") == F.col("d")) & (F.col("n") == F.col("dn")), "left")
    revisit = F.col("d").isNotNull() & ~F.col("to").eqNullSafe(F.col("page_id"))
    rows = rows.select("page_id", "url", "payload", F.when(revisit, F.col("to")).alias("to"), F.when(revisit, F.col("to_url")).alias("to_url"), revisit.alias("revisit"), "digest")
    rows = sorted_shards(rows, "page_id", ["url", "digest"], records_per_shard).select(F.col("page_id").cast("string"), "url", "payload", F.col("to").cast("string"), "to_url", "revisit", "__shard")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, at = None, None

        def end() -> dict:
            file.close()
            return {"name": file.name, "temp": file.temp, "shard": at[0], "seq": at[1], "records": at[2], "bytes": file.size, "sha256": at[3].hexdigest()}

        done: list[dict] = []
        for page_id, url, payload, to, to_url, is_revisit, shard in rows_of(batches):
            if file is not None and (at[0] != shard or file.size >= roll_bytes):
                done.append(end())
                at = [shard, at[1] + 1 if at[0] == shard else 0, 0, hashlib.sha256()]
                file = None
            if file is None:
                at = at if at and at[0] == shard else [shard, 0, 0, hashlib.sha256()]
                file = NewFile(folder, f"{prefix}-{at[0]:06d}-{at[1]:04d}.warc.gz")
                name = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x-file:{file.name}>\r\nWARC-Date: {date}\r\nWARC-Filename: {file.name}\r\nContent-Type: application/warc-fields\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
                member = _member(name.encode(), level)
                file.write(member)
                at[3].update(member)
            member = _member(record(page_id, url, payload, to, to_url, is_revisit, date), level)
            file.write(member)
            at[3].update(member)
            at[2] += 1
        if file is not None:
            done.append(end())
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("name", pa.string()), ("temp", pa.string()), ("shard", pa.int32()), ("seq", pa.int32()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]))

    return commit(folder, materialise(rows.mapInArrow(write, MANIFEST), "warc-files"))


def parse(stream) -> Iterator[tuple[dict, bytes]]:
    """Headers (lower-case names) and block of every record of an uncompressed WARC stream."""
    while line := stream.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:40]!r}")
        head = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            key, _, value = line.decode("utf-8").partition(":")
            head[key.strip().lower()] = value.strip()
        yield head, stream.read(int(head["content-length"]))


def _hex(digest: str) -> str:
    return base64.b32decode(digest.removeprefix("sha1:")).hex()


def _page(urn: str) -> str | None:
    return unquote(urn.removeprefix("<urn:x-page:").removesuffix(">")) if urn.startswith("<urn:x-page:") else None


def read_warc(folder: str, manifest: DataFrame, id_type: str = "long") -> DataFrame:
    """One row a response or revisit record of the manifest's files; block and payload digests are verified."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        for (name,) in rows_of(batches):
            out = []
            with system.open_input_stream(f"{root}/{name}", compression=None) as raw, gzip.open(raw) as stream:
                for head, block in parse(stream):
                    if head["warc-type"] not in ("response", "revisit"):
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    if _sha1(block) != head["warc-block-digest"]:
                        raise ValueError(f"{name}: block of {head['warc-record-id']} is damaged")
                    size = int(re.search(rb"(?im)^Content-Length: (\d+)", http)[1])
                    is_revisit = head["warc-type"] == "revisit"
                    if not is_revisit and (len(payload) != size or _sha1(payload) != head["warc-payload-digest"]):
                        raise ValueError(f"{name}: payload of {head['warc-record-id']} is damaged")
                    out.append((_page(head["warc-record-id"]), size, _hex(head["warc-payload-digest"]), head["warc-type"], _page(head["warc-refers-to"]) if is_revisit else None, head.get("warc-target-uri"), name))
                    if len(out) >= 5000:
                        yield pa.RecordBatch.from_pylist([dict(zip(_ARROW.names, x, strict=True)) for x in out], schema=_ARROW)
                        out = []
            yield pa.RecordBatch.from_pylist([dict(zip(_ARROW.names, x, strict=True)) for x in out], schema=_ARROW)

    rows = file_tasks(manifest.select("name")).mapInArrow(read, RECORDS)
    return rows.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def round_trip(pages: DataFrame, **settings) -> DataFrame:
    """Write pages to a new folder and read the archives back."""
    folder = new_folder(pages.sparkSession, "warc")
    return read_warc(folder, write_warc(pages, folder, **settings), dict(pages.dtypes)["page_id"])
