"""WARC (4): a deterministic sharded writer of web archives, and a reader of what it has committed.

Pages are range-sorted by page_id into shards of about equal bytes, from histograms of at most BUCKETS cells, in which
heavy cells are divided again, so that outlying ids do no harm; only a single id that alone exceeds a shard's share, or
the null ids, are split further by digest. A shard's task
streams its rows into gzip members, rolls files by their compressed size, and writes them under temporary names. The
manifest, itself a table that Spark commits, names the files of the attempts that count; a second job renames them, and
readers follow the manifest alone, so lost, repeated or speculative tasks leave nothing that is read. With the same
pages and number of shards, all files are the same bytes.

Of pages with equal payloads of at least MIN_REVISIT bytes, the one with the smallest page_id is a response and the others
revisit it. Digests are grouped and joined without payloads, hot ones apart; revisits reach the writer as marker rows
that sort just before their page, so payloads are shuffled once. Headers and digests are made anew for each record.

Null html: an empty payload. Null page_id: a record without an id, a revisit if a page with an id has its payload. Null
url: the target urn:page:<id>. Rows that repeat both id and payload are alike: all response, or all revisit. Empty table:
an archive of no files. Other columns of the input aren't written.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import STAGED, batches, hot_join, shared_dir, stage, table

BUCKETS, PER_SHARD, MIN_REVISIT, SHARD_BYTES, ROLL_BYTES, CHUNK = 65_536, 8, 100, 256 << 20, 64 << 20, 1 << 16
DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("7d1c1b0a-52b8-5e0e-9b43-1d8c1a7b6f10")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _member(data: bytes) -> bytes:
    """A gzip member without time or name, so that equal records are equal bytes."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *[f"{k}: {v}" for k, v in headers], f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}:{digest}')}>"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response, or a revisit of the page refers_to, which has the same payload."""
    digest = hashlib.sha256(payload).hexdigest()
    target = f"urn:page:{page_id}" if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~^|{}`\"\\<>")
    headers = [("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", DATE), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(len(payload)))]
    if page_id is not None:
        headers.append(("X-Page-Id", str(page_id)))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = ("Content-Type", "application/http;msgtype=response")
    if refers_to is None:
        return _record("response", [*headers, kind], http + payload)
    return _record("revisit", [*headers, ("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-Id", str(refers_to)), kind], http)


def _writer(root: str, roll: int):
    names = ["shard", "seq", "temp", "name", "records", "bytes", "sha256"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, at = fs.FileSystem.from_uri(root)
        done, out, shard, seq = [], None, None, 0

        def close() -> None:
            nonlocal out
            if out:
                out["stream"].close()
                done.append((out["shard"], out["seq"], out["temp"], out["name"], out["records"], out["bytes"], out["sha"].hexdigest()))
            out = None

        def put(data: bytes, records: int) -> None:
            out["stream"].write(data)
            out["sha"].update(data)
            out["bytes"] += len(data)
            out["records"] += records

        marked: dict[tuple, int] = {}
        for b in batches(it, "html"):
            for s, page, url, html, digest, first in zip(*(b.column(c).to_pylist() for c in ("shard", "page_id", "url", "html", "digest", "first_id"))):
                if first is not None:  # a marker: rows of this id and digest come next
                    marked = {(page, digest): first}
                    continue
                if s != shard:
                    close()
                    shard, seq = s, 0
                elif out and out["bytes"] >= roll:
                    close()
                    seq += 1
                if not out:
                    name, temp = f"part-{s:06d}-{seq:04d}.warc.gz", f"_temporary/{s:06d}-{seq:04d}-{uuid.uuid4().hex}"
                    out = {"stream": files.open_output_stream(f"{at}/{temp}", compression=None), "sha": hashlib.sha256(), "shard": s, "seq": seq, "temp": temp, "name": name, "bytes": 0, "records": 0}
                    info = [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_SPACE, name)}>"), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")]
                    put(_member(_record("warcinfo", info, b"format: WARC File Format 1.1\r\n")), 0)
                put(_member(page_record(page, url, (html or "").encode(), marked.get((page, digest)))), 1)
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()))], names=names)

    return run


_MANIFEST = "shard int, seq int, temp string, name string, records long, bytes long, sha256 string"


def _renamer(root: str):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, at = fs.FileSystem.from_uri(root)
        for b in it:
            for temp, name, size in zip(*(b.column(c).to_pylist() for c in ("temp", "name", "bytes"))):
                info = files.get_file_info(f"{at}/{temp}")
                if info.type == fs.FileType.File:
                    files.move(f"{at}/{temp}", f"{at}/{name}")
                elif files.get_file_info(f"{at}/{name}").size != size:  # else an earlier attempt has renamed it
                    raise OSError(f"{name} is missing")
            yield b

    return run


def _cuts(slim: DataFrame, lo: int | None, hi: int | None, n: int, share: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where ranges of ids start, about PER_SHARD to a shard or finer; then for the null ids, the first range and so on, the first shard and over how many shards it spreads. From exact histograms of BUCKETS cells at most, of which those that hold more than a range's share are divided again, so ids may lie anyhow."""
    most = max(1, share // PER_SHARD)
    heavy = [] if lo is None else [(lo, hi + 1)]
    cells = {}
    while heavy:
        each = max(2, BUCKETS // len(heavy))
        at = np.array([a for a, _ in heavy], np.int64)
        stop = np.array([b - 1 for _, b in heavy], np.int64)
        width = np.array([-(-(b - a) // each) for a, b in heavy], np.uint64)

        def tally(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                ids, size = b.column("page_id").to_numpy(), b.column("bytes").to_numpy()
                i = np.searchsorted(at, ids, side="right") - 1
                ok = (i >= 0) & (ids <= stop[i])
                i, ids, size = i[ok], ids[ok], size[ok]
                # differences of 64-bit integers, in unsigned arithmetic
                cell = i * each + ((ids.view(np.uint64) - at[i].view(np.uint64)) // width[i]).astype(np.int64)
                cell, inv = np.unique(cell, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.bincount(inv, size, len(cell)).astype(np.int64))], names=["cell", "bytes"])

        rows = slim.filter("page_id is not null").select("page_id", (F.col("bytes") + 512).alias("bytes")).mapInArrow(tally, "cell long, bytes long").groupBy("cell").agg(F.sum("bytes").alias("bytes")).toArrow()
        again = []
        for cell, size in zip(rows.column("cell").to_pylist(), rows.column("bytes").to_pylist()):
            a, w = int(at[cell // each]) + cell % each * int(width[cell // each]), int(width[cell // each])
            if size > most and w > 1:
                again.append((a, min(a + w, int(stop[cell // each]) + 1)))
            else:
                cells[a] = size
        heavy = sorted(again)
    of_null = slim.filter("page_id is null").agg(F.sum(F.col("bytes") + 512)).first()[0] or 0
    starts, sizes = [], [of_null]
    for a in sorted(cells):
        if not starts or sizes[-1] + cells[a] > most:
            starts.append(a)
            sizes.append(0)
        sizes[-1] += cells[a]
    sizes = np.array(sizes, np.int64)
    first = np.minimum(n - 1, (np.cumsum(sizes) - sizes) // share)
    # values under the first start don't occur; index 0 is of null ids
    return np.array(starts, np.int64), first.astype(np.int32), np.maximum(1, -(-sizes // share)).astype(np.int32)


def write_archives(pages: DataFrame, root: str, shards: int | None = None, roll: int = ROLL_BYTES) -> DataFrame:
    """Write the pages (page_id, url, html) under the URI root, new or empty; the committed manifest, one row for each file."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html"), F.lit(""))
    full = pages.select(F.col("page_id").cast("long"), "url", payload.alias("html"), F.sha2(payload, 256).alias("digest"))
    slim = stage(full.select("page_id", "digest", F.octet_length("html").cast("long").alias("bytes")))
    span = slim.agg(F.min("page_id").alias("lo"), F.max("page_id").alias("hi"), F.sum(F.col("bytes") + 512).alias("bytes"), F.count("*").alias("n")).first()
    n = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(span["bytes"] or 0) // SHARD_BYTES))
    share = max(1, -(-(span["bytes"] or 1) // n))
    starts, first_shard, parts = _cuts(slim, span["lo"], span["hi"], n, share)
    known = spark.sparkContext.broadcast((starts, first_shard, parts))  # a few numbers for each shard

    @F.pandas_udf("first_shard int, parts int")
    def place(page_id: pd.Series) -> pd.DataFrame:
        starts, first_shard, parts = known.value
        own = page_id.isna().to_numpy()
        at = np.where(own, 0, np.searchsorted(starts, page_id.fillna(0).astype("int64").to_numpy(), side="right"))
        return pd.DataFrame({"first_shard": first_shard[at], "parts": parts[at]})

    firsts = slim.filter(F.col("bytes") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1")
    again = hot_join(slim.filter(F.col("bytes") >= MIN_REVISIT), stage(firsts), ["digest"], "n", span["n"])
    again = again.filter("first_id is not null and not (page_id <=> first_id)").select("page_id", "digest", "first_id").distinct()
    marker = again.select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "digest", "first_id")
    rows = full.select("page_id", "url", "html", "digest", F.lit(None).cast("long").alias("first_id")).union(marker)
    rows = rows.withColumn("_at", place("page_id"))
    shard = F.least(F.lit(n - 1), F.col("_at.first_shard") + F.pmod(F.xxhash64("digest"), F.col("_at.parts")).cast("int"))
    rows = rows.select(shard.alias("shard"), "page_id", "url", "html", "digest", "first_id")
    rows = rows.repartitionById(n, F.col("shard")).sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "digest", F.col("first_id").desc_nulls_last(), F.col("url").asc_nulls_first())
    files, at = fs.FileSystem.from_uri(root)
    files.create_dir(f"{at}/_temporary", recursive=True)
    manifest = stage(rows.mapInArrow(_writer(root, roll), _MANIFEST))
    committed = manifest.repartition(max(1, min(n, 64))).mapInArrow(_renamer(root), _MANIFEST)
    committed.drop("temp").write.mode("error").parquet(f"{root}/_manifest")  # the commit: readers start here
    return spark.read.parquet(f"{root}/_manifest")


def members(read: Callable[[int], bytes]) -> Iterator[bytes]:
    """The contents of a stream's gzip members. It is read by CHUNK bytes, so the rest of a file is never held or copied."""
    z, parts, data = zlib.decompressobj(31), [], b""
    while data or (data := read(CHUNK)):
        parts.append(z.decompress(data))
        data = b""
        if z.eof:
            yield b"".join(parts)
            data, parts, z = z.unused_data, [], zlib.decompressobj(31)
    if parts:
        raise ValueError("a file that ends within a record")


def parse(read: Callable[[int], bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of a stream of gzip members: headers by lower-case name, and the block, whose digest has to hold."""
    for text in members(read):
        end = text.index(b"\r\n\r\n")
        headers = {k.lower(): v for k, v in (re.split(r":\s*", x, maxsplit=1) for x in text[:end].decode().split("\r\n")[1:])}
        block = text[end + 4 : end + 4 + int(headers["content-length"])]
        if headers["warc-block-digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
            raise ValueError(f"a damaged block: {headers.get('warc-record-id')}")
        yield headers, block


def _reader(root: str):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, at = fs.FileSystem.from_uri(root)
        kinds = (pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64())
        names = ["page_id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for b in it:
            for name, sha in zip(b.column("name").to_pylist(), b.column("sha256").to_pylist()):
                rows, size, whole = [], 0, hashlib.sha256()
                with files.open_input_stream(f"{at}/{name}", compression=None) as f:

                    def read(n: int) -> bytes:
                        data = f.read(n)
                        whole.update(data)
                        return data

                    for h, block in parse(read):
                        if h["warc-type"] == "warcinfo":
                            continue
                        payload = block.partition(b"\r\n\r\n")[2] if h["warc-type"] == "response" else None
                        digest = h["warc-payload-digest"].removeprefix("sha256:")
                        if payload is not None and hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"a damaged payload: {h['warc-record-id']}")
                        page, to = h.get("x-page-id"), h.get("x-refers-to-page-id")
                        length = len(payload) if payload is not None else int(h["x-payload-length"])
                        rows.append((None if page is None else int(page), h["warc-target-uri"], h["warc-type"], payload, length, digest, None if to is None else int(to)))
                        size += len(payload or b"")
                        if size > 8 << 20:
                            yield batch(rows)
                            rows, size = [], 0
                if whole.hexdigest() != sha:
                    raise ValueError(f"{name} isn't the file of the manifest")
                if rows:
                    yield batch(rows)

    return run


def read_archives(spark: SparkSession, root: str) -> DataFrame:
    """page_id, url, record_type, payload (null in a revisit), payload_bytes, payload_digest, refers_to of the manifest's files, a task for a few files."""
    manifest = spark.read.parquet(f"{root}/_manifest")
    n = max(1, manifest.count())
    by_file = manifest.repartition(min(n, 100_000), "name").select("name", "sha256")
    return by_file.mapInArrow(_reader(root), "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    STAGED.append(root)
    write_archives(table(spark, sf_dir, "pages"), root)
    return read_archives(spark, root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_id IS NOT NULL AND first_id IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id IS DISTINCT FROM page_id THEN first_id END AS refers_to FROM q
"""
