"""A deterministic sharded WARC writer, and its reader.

Records are sorted by ranges of their key, so that a task writes one run of
keys. It rolls to a new file when the compressed size passes a limit; every
record is a gzip member of its own. Headers and digests are made anew from key,
URL and payload, with a fixed date, so a rerun writes the same bytes. Files are
written under temporary names, and renamed when whole; those in the manifest,
which Spark writes last, are the archive. A retried task writes the same files
again, under the same names.

Of records with equal payloads of at least FEWEST_BYTES that with the largest key
is the response; the others are revisit records without payload. Null html is an
empty payload; a record of a null or empty url has no WARC-Target-URI. A record with a null key is no other's
original unless all keys of its payload are null; rows that repeat the largest
key are responses all. An empty table gives an archive without files and an empty
result; other columns are never read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from songframe.llm.common import BROADCAST_ROWS, new_path, partitions, small_batches, staged, table, with_group
from songframe.llm.files import NewFile, drop_leftovers, make_dir, opened

FEWEST_BYTES = 1000
#: Compressed bytes after which a file is closed.
ROLL_BYTES = 64 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, records long, bytes long, sha1 string"
RECORD = "id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record_id(key: int | None, digest: str) -> str:
    return f"<urn:x-page:{'' if key is None else key}:{digest}>"


def key_of(record: str) -> int | None:
    found = re.match(r"<urn:x-page:(-?\d+):", record)
    return int(found[1]) if found else None


def _base32(digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()


def record(key: int | None, url: str, payload: bytes, size: int, digest: str, original: int | None) -> bytes:
    """One gzip member. original: the response's key, of a revisit record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if original is None else b"")
    kind = "response" if original is None else "revisit"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(key, digest)}", f"WARC-Date: {DATE}"]
    if url:
        head.append(f"WARC-Target-URI: {re.sub(r'[\r\n]+', ' ', url)}")
    head.append(f"WARC-Payload-Digest: {_base32(digest)}")
    if original is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(original, digest)}"]
    head += [f"WARC-Block-Digest: {_base32(hashlib.sha1(block).hexdigest())}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def with_types(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = FEWEST_BYTES, bound: int = BROADCAST_ROWS) -> DataFrame:
    """id, url, payload, size, digest and original of every row, and marks.

    Which record is a payload's response is decided on ids and digests, grouped map-side
    first. If few payloads repeat, the decision is broadcast, and revisits lose their
    payload at once. Otherwise revisits are rows of their own (mark is true, no payload)
    that the writer meets just before the record of their id and digest: payloads are
    never grouped by digest, and move once, by ranges of ids."""
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(url), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("size", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1("payload"))
    slim = rows.where(F.col("size") >= least).select("id", "digest")
    groups = staged(slim.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last")).where("n > 1").withColumnRenamed("digest", "of"), "payloads")
    original = F.when(F.col("last").isNotNull() & ~F.col("last").eqNullSafe(F.col("id")), F.col("last"))
    if groups.count() <= bound:
        rows = rows.join(F.broadcast(groups.drop("n")), F.col("digest") == F.col("of"), "left").withColumn("original", original)
        return rows.select("id", "url", F.when(F.col("original").isNull(), F.col("payload")).alias("payload"), "size", "digest", "original", F.lit(False).alias("mark"))
    marks = with_group(slim, groups, "digest", "of", 0).select("id", "digest", original.alias("original")).where(F.col("original").isNotNull()).distinct()
    marks = marks.select("id", F.lit("").alias("url"), F.lit(None).cast("binary").alias("payload"), F.lit(0).cast("long").alias("size"), "digest", "original", F.lit(True).alias("mark"))
    return rows.select("id", "url", "payload", "size", "digest", F.lit(None).cast("long").alias("original"), F.lit(False).alias("mark")).unionByName(marks)


def write_archive(records: DataFrame, folder: str, roll: int = ROLL_BYTES) -> DataFrame:
    """Write the records of with_types(); the manifest, as a table."""
    spark = records.sparkSession
    make_dir(folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, n, made, file, digest, rows, marked = TaskContext.get().partitionId(), 0, [], None, None, 0, (None, None, None)
        try:
            for x in batches:
                for key, url, payload, size, sha1, original, mark in x.itertuples(index=False, name=None):
                    if mark:
                        marked = key, sha1, original
                        continue
                    if marked[:2] == (key, sha1):
                        original = marked[2]
                    if file is None:
                        file, digest, rows = NewFile(folder, f"pages-{part:05d}-{n:05d}.warc.gz"), hashlib.sha1(), 0
                    member = record(None if pd.isna(key) else int(key), url, payload or b"", size, sha1, None if pd.isna(original) else int(original))
                    file.write(member)
                    digest.update(member)
                    rows += 1
                    if file.size >= roll:
                        file.commit()
                        made.append((file.name, rows, file.size, digest.hexdigest()))
                        file, n = None, n + 1
            if file is not None:
                file.commit()
                made.append((file.name, rows, file.size, digest.hexdigest()))
                file = None
        finally:
            if file is not None:
                file.drop()
        yield pd.DataFrame(made, columns=["file", "records", "bytes", "sha1"])

    small_batches(spark)
    # ids as decimals of text keep their nulls and all 64 bits on the way through pandas
    rows = records.select("id", "url", "payload", "size", "digest", "original", "mark")
    rows = rows.repartitionByRange(partitions(spark), "id", "digest").sortWithinPartitions("id", "digest", F.desc("mark"), "url")
    rows = rows.withColumn("id", F.col("id").cast("string")).withColumn("original", F.col("original").cast("string"))
    manifest = rows.mapInPandas(run, MANIFEST)
    manifest.write.json(f"{folder}/manifest")
    drop_leftovers(folder)
    return spark.read.schema(MANIFEST).json(f"{folder}/manifest")


def members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a file, one by one."""
    unpack, out = zlib.decompressobj(31), io.BytesIO()
    while data := stream.read(chunk):
        while data:
            out.write(unpack.decompress(data))
            data = unpack.unused_data
            if unpack.eof:
                yield out.getvalue()
                unpack, out = zlib.decompressobj(31), io.BytesIO()
    if out.tell():
        raise ValueError("a file ends within a record")


def parse(member: bytes) -> tuple:
    """A row of RECORD; digests and lengths are checked against the content."""
    head, _, rest = member.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n" or _base32(hashlib.sha1(block).hexdigest()) != fields["WARC-Block-Digest"]:
        raise ValueError(f"bad record {fields['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != size):
        raise ValueError(f"bad payload {fields['WARC-Record-ID']}")
    return key_of(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI", ""), size, digest, kind, key_of(fields.get("WARC-Refers-To", ""))


def read_archive(manifest: DataFrame, folder: str) -> DataFrame:
    """RECORD rows of the files that the manifest lists, a task for a few files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for name, records in zip(x["file"], x["records"], strict=True):
                with opened(folder, name) as f:
                    rows = []
                    for member in members(f):
                        rows.append(parse(member))
                        records -= 1
                        if len(rows) == 2000:
                            yield _frame(rows)
                            rows = []
                    yield _frame(rows)
                if records:
                    raise ValueError(f"{name}: records are missing")

    files = manifest.select("file", "records").repartition(partitions(manifest.sparkSession), "file")
    return files.mapInPandas(run, RECORD)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])
    return out.astype({"id": "Int64", "refers_to": "Int64"})


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    manifest = write_archive(with_types(table(spark, sf_dir, "pages")), folder)
    rows = read_archive(manifest, folder)
    return rows.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest FROM p),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS last FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN last <> page_id THEN last END AS refers_to FROM m
"""
