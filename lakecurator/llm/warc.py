"""WARC archives: a deterministic sharded writer and a reader.

Records are sorted by page_id into ranges of about equal bytes. A task writes
one range, one gzip member for each record, and begins a new file when the
compressed size is reached; headers, lengths and digests are made from the
payload. Files are written under temporary names and renamed when complete;
their manifest entries are the task's result, and manifest.json names the
files that count. The same pages give the same bytes, so an attempt that is
repeated writes what the first one wrote.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, with_arrow
from .storage import NO_KEY, commit, dealt, key_ranges, new_folder, opened, write_json

#: Payloads below this many bytes are never replaced by a revisit.
REVISIT_BYTES = 100
#: The date that headers carry, a parameter so that archives don't depend on the clock.
DATE = "2024-01-01T00:00:00Z"
_EOL = b"\r\n"
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record_id(page_id: int, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.sha256(f'{page_id}/{digest}'.encode()).hexdigest()[:32])}>"


def _uri(url: str | None, page_id: int) -> str:
    return urllib.parse.quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else f"urn:page:{page_id}"


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(lines).encode() + _EOL * 2 + block + _EOL * 2, 6, mtime=0)


def page_record(page_id: int, url: str | None, payload: bytes | None, size: int, digest: str, first: int | None, date: str) -> bytes:
    """One page as a response, or as a revisit of page `first` with no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    headers = [("WARC-Type", "response" if first is None else "revisit"), ("WARC-Record-ID", _record_id(page_id, digest)), ("WARC-Date", date), ("WARC-Target-URI", _uri(url, page_id)), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Page-Id", str(page_id)), ("X-Payload-Length", str(size))]
    if first is not None:
        headers += [("WARC-Profile", _REVISIT_PROFILE), ("WARC-Refers-To", _record_id(first, digest)), ("X-Refers-To-Page-Id", str(first))]
    return _record(headers, http if first is not None else http + (payload or b""))


def write_archives(pages: DataFrame, folder: str | None = None, range_bytes: int = 16 << 20, roll_bytes: int | None = None, date: str = DATE) -> str:
    """Write pages (page_id, url, html) and return the folder.

    Of equal payloads of at least REVISIT_BYTES, the one with the smallest
    page_id is a response and others revisit it; rows that share that smallest
    page_id are all responses. Null html is an empty payload. A null page_id
    is written as -2**63, comes first, and doesn't count as the smallest. Very
    long payloads are one record each; other columns are ignored. An empty
    table gives a manifest without files.

    A task writes one range of about range_bytes, or of more where there would
    be over RANGES of them, and rolls to a new file at roll_bytes of compressed
    records, an eighth of a range unless given. Rows of a page_id that fills
    several ranges, a null one too, are dealt over them by their digest.
    """
    spark = pages.sparkSession
    prepare(spark)
    folder = folder or new_folder(spark, "warc")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    light = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("size")).where(F.col("page_id").isNotNull() & (F.col("size") >= REVISIT_BYTES))
    firsts = light.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first").checkpoint()
    bounds = key_ranges(pages.select(F.col("page_id").cast("long").alias("page_id"), (F.coalesce(F.octet_length("html"), F.lit(0)) + 512).alias("w")), "page_id", "w", range_bytes)
    roll = roll_bytes or max(1, bounds.target // 8)

    def pack(batch: pa.RecordBatch) -> Iterator[dict]:
        squeeze = zstandard.ZstdCompressor(level=6).compress
        payloads = [(x or "").encode() for x in batch["html"].to_pylist()]
        digests = [hashlib.sha256(x).hexdigest() for x in payloads]
        ties = np.array([int(x[:8], 16) for x in digests], np.uint32)
        yield {"page_id": batch["page_id"], "url": batch["url"], "digest": digests, "size": [len(x) for x in payloads], "z": [squeeze(x) for x in payloads], "shard": bounds.of(batch["page_id"].to_numpy(), ties)}

    packed = with_arrow(pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(NO_KEY)).alias("page_id"), F.col("url").cast("string").alias("url"), "html"), pack, "page_id long, url string, digest string, size long, z binary, shard int")
    revisit = F.col("first").isNotNull() & (F.col("page_id") != F.col("first"))
    placed = packed.join(firsts, "digest", "left").select("page_id", "url", "digest", "size", "shard", F.when(revisit, F.col("first")).alias("first"), F.when(~revisit, F.col("z")).alias("z"))
    system, path = opened(folder)
    system.create_dir(path, recursive=True)
    kinds = pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = opened(folder)
        attempt, expand = uuid.uuid4().hex, zstandard.ZstdDecompressor().decompress
        shard = out = hashed = None
        part = records = size = 0

        def name(attempt: str = "") -> str:
            return f"{path}/.{shard:06d}-{part:04d}.{attempt}" if attempt else f"{path}/{shard:06d}-{part:04d}.warc.gz"

        def put(data: bytes) -> None:
            nonlocal size
            out.write(data)
            hashed.update(data)
            size += len(data)

        def begin() -> None:
            nonlocal out, hashed, records, size
            out, hashed, records, size = system.open_output_stream(name(attempt), compression=None), hashlib.sha256(), 0, 0
            info = f"software: lakecurator\r\nformat: WARC File Format 1.1\r\nrange: {shard}\r\npart: {part}\r\n".encode()
            put(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _record_id(shard, f"info-{part}")), ("WARC-Date", date), ("WARC-Filename", name().rpartition("/")[2]), ("Content-Type", "application/warc-fields")], info))

        def close() -> pa.RecordBatch:
            out.close()
            commit(system, name(attempt), name())
            return pa.RecordBatch.from_pylist([{"shard": shard, "part": part, "records": records, "bytes": size, "sha256": hashed.hexdigest()}], kinds)

        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != shard or size >= roll:
                    if out is not None:
                        yield close()
                    part = part + 1 if row["shard"] == shard else 0
                    shard = row["shard"]
                    begin()
                put(page_record(row["page_id"], row["url"], expand(row["z"]) if row["z"] else None, row["size"], row["digest"], row["first"], date))
                records += 1
        if out is not None:
            yield close()

    rows = dealt(placed, len(bounds), "shard", "page_id", "digest", "url").mapInArrow(write, "shard int, part int, records long, bytes long, sha256 string").collect()  # one row a file, of which there are RANGES times a few at most
    files = [r.asDict() | {"file": f"{r.shard:06d}-{r.part:04d}.warc.gz"} for r in sorted(rows)]
    write_json(f"{folder}/manifest.json", {"version": 1, "files": files})
    return folder


def _members(source) -> Iterator[bytes]:
    """The gzip members of an archive, one at a time."""
    unzip, found = zlib.decompressobj(31), []
    while data := source.read(1 << 20):
        while data:
            found.append(unzip.decompress(data))
            data = unzip.unused_data
            if unzip.eof:
                yield b"".join(found)
                unzip, found = zlib.decompressobj(31), []


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name, and the block; a block that doesn't match its length or digest raises."""
    head, _, rest = raw.partition(_EOL * 2)
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    size = int(headers["content-length"])
    block = rest[:size]
    if rest[size:] != _EOL * 2 or f"sha256:{hashlib.sha256(block).hexdigest()}" != headers["warc-block-digest"]:
        raise ValueError(f"broken record {headers.get('warc-record-id')}")
    return headers, block


def read_archives(spark, folder: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and payload of every page record.

    Length and digest of a response are taken from the payload read; those of a revisit from its headers.
    Pages that were written with a null page_id have it again, null payloads
    are empty, rows that were repeated come as often, and very long payloads
    are read whole. Archives without records give an empty result.
    """
    prepare(spark)
    system, path = opened(folder)
    with system.open_input_stream(f"{path}/manifest.json") as source:
        files = [x["file"] for x in json.loads(source.read())["files"]]

    def read(batch: pa.RecordBatch) -> Iterator[dict]:
        system, path = opened(folder)
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        for i in batch["id"].to_pylist():
            rows: list[tuple] = []
            held = 0
            with system.open_input_stream(f"{path}/{files[i]}", compression=None) as source:
                for raw in _members(source):
                    headers, block = parse_record(raw)
                    kind = headers["warc-type"]
                    if kind not in ("response", "revisit"):
                        continue
                    payload = block.partition(_EOL * 2)[2] if kind == "response" else None
                    size, digest = (len(payload), hashlib.sha256(payload).hexdigest()) if kind == "response" else (int(headers["x-payload-length"]), headers["warc-payload-digest"].removeprefix("sha256:"))
                    page, first = int(headers["x-page-id"]), headers.get("x-refers-to-page-id")
                    rows.append((None if page == NO_KEY else page, headers["warc-target-uri"], size, digest, kind, None if first is None else int(first), payload))
                    held += len(raw)
                    if held > 4 << 20 or len(rows) >= 1000:
                        yield dict(zip(names, map(list, zip(*rows))))
                        rows, held = [], 0
            if rows:
                yield dict(zip(names, map(list, zip(*rows))))

    return with_arrow(spark.range(0, len(files), 1, max(1, len(files))), read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
