"""WARC archives with an index first: write, select in the index, read only the selected byte ranges.

Each task streams its rows into one archive of gzip members (a member per record) and returns, per record, file, offset,
length, URL and digest; these rows are the index, written as a table. A task writes under a name of its own
attempt, so that a lost executor leaves at most an archive that no index row names. Reading takes index rows, deals them out by file
and 16 MB block, sorts them by offset, and fetches neighbouring ranges in one read.

Of rows with equal payloads of at least ``least_bytes`` bytes the one with the smallest page id is a response and the others
are revisits without payload, with its record id in WARC-Refers-To; readers take size and digest from that record.

Defined cases: a null payload is empty; a null url is an empty target; a null page id ranks above all others; rows that
repeat the smallest id of a group are all responses; an empty table gives an empty index; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyvane.llm.work import Work, arrow_fs, qualified

INDEX = "page_id long, url string, digest string, record_type string, refers_to long, file string, offset long, length long"
RECORD = "page_id long, url string, record_type string, refers_to long, declared_digest string, payload_digest string, payload_bytes long, payload string"
BLOCK, GAP, MOST = 16 << 20, 64 << 10, 8 << 20


def _record(page: int | None, url: str, payload: bytes, digest: str, kind: str, refers: int | None) -> bytes:
    body = b"" if kind == "revisit" else payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x-page:{page}>", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha256:{digest}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{refers}>"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _page(uri: str) -> int | None:
    name = uri.strip("<>").rpartition(":")[2]
    return None if name == "None" else int(name)


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one gzip member; the block's length is checked."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    size = int(headers["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError(f"bad record {headers.get('WARC-Record-ID')}")
    return headers, rest[:size]


def write_warc(pages: DataFrame, path: str, least_bytes: int = 100, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write archives and the index under ``path``; returns the index. Clean-up of stray archives is the caller's.

    A path without a scheme is in Hadoop's default file system, for the executors' archives as for the index.
    """
    path = qualified(pages.sparkSession, path)
    body = F.coalesce(F.col(html), F.lit(""))
    clean = F.regexp_replace(F.coalesce(F.col(url), F.lit("")), r"[\r\n]", "")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), clean.alias("url"), body.alias("html"), F.unhex(F.sha2(body, 256)).alias("digest"))
    # only small rows are grouped; the groups of two and more that come out are what the pages are joined with
    groups = rows.where(F.octet_length("html") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    work = Work(pages.sparkSession, "warc")
    groups = work.table(groups.select("digest", "first"), "groups")
    rows = rows.join(groups, "digest", "left").withColumn("revisit", F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))
    # a revisit has no payload: it is dropped before the rows go to the writers
    rows = rows.select("page_id", "url", F.when(F.col("revisit"), "").otherwise(F.col("html")).alias("html"), F.lower(F.hex("digest")).alias("digest"),
                       F.when(F.col("revisit"), "revisit").otherwise("response").alias("record_type"),
                       F.when(F.col("revisit"), F.col("first")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = name = fs = None
        at = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                name = f"{path}/archive/{uuid.uuid4().hex}.warc.gz"
                fs, local = arrow_fs(name)
                fs.create_dir(os.path.dirname(local), recursive=True)
                out = fs.open_output_stream(local, compression=None)
            place, size = [], []
            for page, target, text, digest, kind, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                z = zlib.compressobj(1, zlib.DEFLATED, 31)
                member = z.compress(_record(page, target, text.encode(), digest, kind, refers)) + z.flush()
                out.write(member)
                place.append(at)
                size.append(len(member))
                at += len(member)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), batch.column(4), batch.column(5), pa.array([name] * len(place)), pa.array(place, pa.int64()), pa.array(size, pa.int64())],
                                             ["page_id", "url", "digest", "record_type", "refers_to", "file", "offset", "length"])
        if out is not None:
            out.close()

    index = rows.mapInArrow(write, INDEX)
    index.write.parquet(f"{path}/index")
    return pages.sparkSession.read.schema(index.schema).parquet(f"{path}/index")


def read_warc(index: DataFrame, payload: bool = True) -> DataFrame:
    """Records of the selected index rows, payload digest and size computed from what is read (null for revisits)."""
    files = index.select("file", "offset", "length").withColumn("block", F.floor(F.col("offset") / BLOCK))
    dealt = files.repartition("file", "block").sortWithinPartitions("file", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = stream = None
        for batch in batches:
            file, place, size = (batch.column(k).to_pylist() for k in range(3))
            a = 0
            while a < len(file):
                b, end = a + 1, place[a] + size[a]
                while b < len(file) and file[b] == file[a] and 0 <= place[b] - end <= GAP and place[b] + size[b] - place[a] <= MOST:
                    end, b = place[b] + size[b], b + 1
                if file[a] != name:
                    if stream is not None:
                        stream.close()
                    name = file[a]
                    fs, local = arrow_fs(name)
                    stream = fs.open_input_file(local)
                data = stream.read_at(end - place[a], place[a])
                found = []
                for k in range(a, b):
                    headers, body = parse_record(data[place[k] - place[a]:place[k] - place[a] + size[k]])
                    back, kind = headers.get("WARC-Refers-To"), headers["WARC-Type"]
                    full = kind == "response"
                    found.append((_page(headers["WARC-Record-ID"]), headers["WARC-Target-URI"], kind, _page(back) if back else None, headers["WARC-Payload-Digest"].removeprefix("sha256:"),
                                  hashlib.sha256(body).hexdigest() if full else None, len(body) if full else None, body.decode() if full and payload else None))
                schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("declared_digest", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.string())])
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)
                a = b
        if stream is not None:
            stream.close()

    return dealt.mapInArrow(read, RECORD)


def resolve(records: DataFrame) -> DataFrame:
    """Records with size and digest of the full payload, revisits' from the response they refer to; a response whose bytes
    don't have the digest declared, or a revisit without its response, is an error."""
    bad = F.raise_error(F.lit("payload digest differs from the one declared")).cast("string")
    rows = records.where("record_type = 'response'").withColumn("payload_digest", F.when(F.col("payload_digest") == F.col("declared_digest"), F.col("payload_digest")).otherwise(bad))
    first = rows.groupBy(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("declared_digest")).agg(F.max("payload_bytes").alias("size"))
    again = records.where("record_type = 'revisit'").join(first, ["refers_to", "declared_digest"], "left")
    lost = F.raise_error(F.lit("a revisit has no response")).cast("long")
    return rows.select("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to").unionByName(again.select(
        "page_id", "url", F.coalesce("size", lost).alias("payload_bytes"), F.col("declared_digest").alias("payload_digest"), "record_type", "refers_to"))
