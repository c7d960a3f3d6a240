"""A content-addressed WARC archive.

Payload bytes are stored once under their SHA-256; record headers are kept
byte for byte in a table of their own. Reading joins the two, checks that the
stored bytes still have the digest that names them, and gives back whole records.
Payloads are compressed one by one before anything is shuffled, as record
archives are, and a digest that many records share is salted in the join.
"""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, spread_join, stored

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"


def http_head(payload_bytes: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()


def record_head(page_id, url, payload_bytes: int, sha1: str, refers_to, date: str = _DATE) -> bytes:
    """The exact bytes in front of a record's payload, the HTTP head included.

    refers_to: of a revisit, whose block ends with the HTTP head; None for a
    response. Line breaks in a URL are percent-encoded; a null URL has no line.
    """
    head = http_head(payload_bytes)
    name = "" if page_id is None else page_id
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Date: {date}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines.append(f"WARC-Payload-Digest: sha1:{sha1}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += [
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(head) + (payload_bytes if refers_to is None else 0)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + head


def parse_head(head: bytes) -> dict[str, str]:
    """The named fields of a record header."""
    lines = head.partition(b"\r\n\r\n")[0].decode().split("\r\n")
    return dict(line.split(": ", 1) for line in lines[1:])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        raw = [(t or "").encode() for t in batch.column(0).to_pylist()]
        digests = [hashlib.sha256(x).digest() for x in raw]
        yield pa.RecordBatch.from_arrays(
            [pa.array(digests, pa.binary()), pa.array(map(pack, raw), pa.binary())], names=["sha256", "packed"]
        )


def _heads(date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            made = [
                record_head(p, u, n, s, r, date)
                for p, u, n, s, r in zip(
                    rows["page_id"], rows["url"], rows["n"], rows["sha1"], rows["refers_to"], strict=True
                )
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(made, pa.binary()), batch.column("sha256"), batch.column("copies")],
                names=["head", "sha256", "copies"],
            )

    return run


def write_archive(pages: DataFrame, path: str, *, min_revisit_bytes: int = 1000, date: str = _DATE) -> None:
    """Write pages (page_id, url, html) as `path`/payloads and `path`/heads.

    Of rows with equal payloads of min_revisit_bytes or more, that with the
    largest page_id is the response, and so is any row that repeats its id; the
    others revisit it. Shorter payloads, and groups without any id, are all
    responses. A null html is an empty payload. Other columns are left out.
    """
    slim = pages.select(F.col("page_id").cast("long"), "url", "html")
    bytes_ = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    facts = slim.select(
        "page_id",
        "url",
        F.octet_length(bytes_).cast("long").alias("n"),
        F.sha1(bytes_).alias("sha1"),
        F.unhex(F.sha2(bytes_, 256)).alias("sha256"),
    )
    spark = pages.sparkSession
    facts.write.parquet(f"{path}/facts")
    facts = spark.read.parquet(f"{path}/facts")
    groups = facts.groupBy("sha256").agg(F.max("page_id").alias("keeper"), F.count("*").alias("copies"))
    many = groups.where("copies > 1")
    judged = spread_join(facts, many, "sha256", facts.count(), "left").select(
        "page_id",
        "url",
        "n",
        "sha1",
        "sha256",
        F.coalesce("copies", F.lit(1).cast("long")).alias("copies"),
        F.when((F.col("n") >= min_revisit_bytes) & ~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper")).alias(
            "refers_to"
        ),
    )
    judged.mapInArrow(_heads(date), "head binary, sha256 binary, copies long").write.parquet(f"{path}/heads")
    slim.select("html").mapInArrow(_packed, "sha256 binary, packed binary").groupBy("sha256").agg(
        F.first("packed").alias("packed")
    ).write.option("compression", "uncompressed").parquet(f"{path}/payloads")


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress
    last: tuple[bytes, bytes] = (b"", b"")
    for batch in batches:
        rows: dict[str, list] = {c: [] for c in ("head", "payload")}
        for head, digest, packed in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            if digest != last[0]:
                payload = unpack(packed)
                if hashlib.sha256(payload).digest() != digest:
                    raise ValueError(f"stored payload is not {digest.hex()}")
                last = (digest, payload)
            rows["head"].append(head)
            rows["payload"].append(last[1])
            if len(rows["head"]) == 256:
                yield pa.RecordBatch.from_pydict(rows, schema=_RECORD)
                rows = {c: [] for c in rows}
        yield pa.RecordBatch.from_pydict(rows, schema=_RECORD)


_RECORD = pa.schema([("head", pa.binary()), ("payload", pa.binary())])


def _joined(spark: SparkSession, path: str, salt_rows: int) -> DataFrame:
    heads = spark.read.schema("head binary, sha256 binary, copies long").parquet(f"{path}/heads")
    payloads = spark.read.schema("sha256 binary, packed binary").parquet(f"{path}/payloads")
    salts = F.ceil(F.col("copies") / F.lit(salt_rows)).cast("int")
    hot = heads.where(salts > 1).select("sha256", salts.alias("salts")).distinct()
    spread = payloads.join(hot, "sha256", "left").select(
        "sha256", "packed", F.explode(F.sequence(F.lit(1), F.coalesce("salts", F.lit(1)))).alias("salt")
    )
    salted = heads.select("head", "sha256", (F.pmod(F.xxhash64("head"), salts) + 1).cast("int").alias("salt"))
    return salted.join(spread, ["sha256", "salt"]).select("head", "sha256", "packed")


def read_archive(spark: SparkSession, path: str, *, salt_rows: int = 2000) -> DataFrame:
    """(head, payload) of every record; a revisit has its response's payload.

    Head followed by payload, for a response, and a blank line are the exact
    record. A payload that no longer has its digest fails the job.
    """
    return _joined(spark, path, salt_rows).mapInArrow(_records, "head binary, payload binary")


def read_facts(spark: SparkSession, path: str, *, salt_rows: int = 2000) -> DataFrame:
    """What each record of an archive holds, parsed from the whole record where it is put together."""
    return _joined(spark, path, salt_rows).mapInArrow(
        lambda batches: _parsed(_records(batches)),
        "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long",
    )


def warc_bytes(head: bytes, payload: bytes) -> bytes:
    """One record of a WARC file."""
    return head + (b"" if b"\r\nWARC-Type: revisit\r\n" in head else payload) + b"\r\n\r\n"


def write_warc_files(spark: SparkSession, path: str, out: str, *, salt_rows: int = 2000) -> DataFrame:
    """Rebuild an archive's records into files that WARC readers open; (file, records, bytes) of each.

    The files are written when this is called; what it returns may be used any number of times. A task
    writes one file of gzip members, a record each, under `out`, a URI that driver and workers
    reach. It is written under the attempt's own name and then moved, so a task that is run again
    leaves one whole file. A folder that holds anything is refused, so no file of an earlier run can
    stay among these. An archive without a record gives no file.
    """
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(out)
    if store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        raise ValueError(f"{out} is not empty")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        context = TaskContext.get()
        store, root = fs.FileSystem.from_uri(out)
        name = f"part-{context.partitionId():05d}.warc.gz"
        part = f"{root}/.{name}-{context.taskAttemptId()}"
        records = 0
        store.create_dir(root, recursive=True)
        with store.open_output_stream(part, compression=None) as f:
            for batch in _records(batches):
                for head, payload in zip(*(batch.column(c).to_pylist() for c in range(2)), strict=True):
                    f.write(gzip.compress(warc_bytes(head, payload), mtime=0))
                    records += 1
        if not records:
            store.delete_file(part)
            return
        size = store.get_file_info(part).size
        store.move(part, f"{root}/{name}")
        yield pa.RecordBatch.from_pydict({"file": [name], "records": [records], "bytes": [size]})

    return stored(_joined(spark, path, salt_rows).mapInArrow(run, "file string, records long, bytes long"), "warc-files")


def _page(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {f.name: [] for f in _REPORT}
        for head, payload in zip(*(batch.column(c).to_pylist() for c in range(2)), strict=True):
            fields = parse_head(head)
            out["page_id"].append(_page(fields["WARC-Record-ID"]))
            out["payload_bytes"].append(len(payload))
            out["payload_digest"].append(hashlib.sha1(payload).hexdigest())
            out["record_type"].append(fields["WARC-Type"])
            out["refers_to"].append(_page(fields.get("WARC-Refers-To")))
        yield pa.RecordBatch.from_pydict(out, schema=_REPORT)


_REPORT = pa.schema(
    [
        ("page_id", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
    ]
)


def report(pages: DataFrame, **options) -> DataFrame:
    """Archive pages in the shared folder, read all records back, and say what each holds."""
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write_archive(pages, path, **options)
    return read_facts(spark, path)


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes,
    max(page_id) OVER (PARTITION BY coalesce(html, '')) AS keeper
  FROM pages)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN keeper END AS refers_to
FROM p
"""
