"""WARC archives with an index first.

Writing: every record becomes a WARC/1.1 record, a gzip member of its own, in an archive of its task, and an index row
(path, offset, length, url, digest) is kept for it.  The index is a table of its own; whatever selects
records works on it alone.  Reading: the selected index rows are brought together by archive, sorted by
offset, and neighbouring byte ranges are read at once.

Records of one payload (from ``min_bytes`` on) share one response: that with the smallest id; the others
are revisits that hold headers only and refer to it.

Defined cases: a null payload is empty; a null URL is written as an empty target; with repeated ids one
row of the smallest id is the response and its repeats revisit it; very long payloads are records like others
(one is read at once); an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.staging import materialize, new_path, numbered
from gridloom.llm.files import fresh_name, open_store

#: Byte ranges closer than this are read in one request.
GAP = 1 << 16
#: Most bytes read in one request, unless one record is longer.
READ = 8 << 20
SALTS = 32
#: An archive is closed once it holds this many bytes.
ARCHIVE = 256 << 20
#: Bytes of archives that a reading task takes, about; ranges of CHUNK stay together.
TASK, CHUNK = 32 << 20, 4 << 20
INDEX = "page_id long, path string, offset long, length long, url string, digest string, record_type string, refers_to long, payload_bytes long"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(kind: str, page_id: int, url: str, digest: str, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has no block."""
    block = b"" if kind == "revisit" else payload
    url = url.replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Target-URI: {url}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def pack(record: bytes) -> bytes:
    """The record as a gzip member."""
    z = zlib.compressobj(level=3, wbits=31)
    return z.compress(record) + z.flush()


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record; raises if it is cut or damaged."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("the record's length is wrong")
    return fields, rest[:n]


def write_warc(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write a record per row and return the index table."""
    spark = pages.sparkSession
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"),
        F.coalesce(F.col(url), F.lit("")).alias("url"),
        F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"),
    )
    rows = numbered(rows, "row")
    # Ids and digests only.  SHA-1 and the length decide equality.
    sums = rows.select("page_id", "row", F.sha1("payload").alias("sha"), F.length("payload").cast("long").alias("bytes"))
    sums = materialize(sums, "warc-sums")
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")
    first = sums.where(F.col("bytes") >= min_bytes).groupBy("sha", "bytes").agg(F.min(order).alias("head"), F.count(F.lit(1)).alias("n"))
    # Rows of a repeated payload are dealt over SALTS keys, so one that holds a third of all rows is split.
    again = first.where("n > 1").select("sha", "bytes", "head").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = sums.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    revisits = salted.join(again, ["sha", "bytes", "salt"]).where("row <> head.row")
    revisits = materialize(revisits.select("row", F.col("head.page_id").alias("refers_to"), F.lit(True).alias("again")), "warc-revisits")
    told = rows.join(revisits, "row", "left").select("page_id", "url", "payload", "refers_to", F.coalesce("again", F.lit(False)).alias("again"))
    folder = new_path(spark, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_store(folder)
        fs.create_dir(root, recursive=True)
        rows = (x for batch in batches for x in batch.to_pylist())
        x = next(rows, None)
        while x is not None:  # an archive per round; its index rows follow once it is closed
            path, at = fresh_name(root, ".warc.gz"), 0
            index: list[tuple] = []
            with fs.open_output_stream(path, compression=None) as out:
                while x is not None and at < ARCHIVE:
                    digest, kind = base32_sha1(x["payload"]), "revisit" if x["again"] else "response"
                    data = pack(record_bytes(kind, x["page_id"], x["url"], digest, x["payload"], x["refers_to"]))
                    out.write(data)
                    index.append((x["page_id"], path, at, len(data), x["url"], digest, kind, x["refers_to"], len(x["payload"])))
                    at, x = at + len(data), next(rows, None)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*index, strict=True), _ARROW, strict=True)], schema=_ARROW)

    return materialize(told.mapInArrow(write, INDEX), "warc-index")


_ARROW = pa.schema(
    [("page_id", pa.int64()), ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64())]
)


def read_warc(index: DataFrame, folder_of: str | None = None) -> DataFrame:
    """``(page_id, url, digest, record_type, refers_to, payload_bytes, payload)`` of the index rows.

    Everything but the place of a record comes from the archive itself; a revisit's payload is empty.
    """
    spark = index.sparkSession
    store = folder_of or new_path(spark, "warc")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = open_store(store)
        for batch in batches:
            rows = sorted(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            i = 0
            while i < len(rows):
                path, start, length = rows[i]
                end, j = start + length, i + 1
                while j < len(rows) and rows[j][0] == path and rows[j][1] <= end + GAP and rows[j][1] + rows[j][2] - start <= READ:
                    end, j = max(end, rows[j][1] + rows[j][2]), j + 1
                with fs.open_input_file(path) as f:
                    data = f.read_at(end - start, start)
                got = [parse_record(zlib.decompress(data[o - start : o - start + n], wbits=31)) for _, o, n in rows[i:j]]
                yield pa.RecordBatch.from_pydict(
                    {
                        "page_id": [int(h["WARC-Record-ID"][len("<urn:page:") : -1]) if "None" not in h["WARC-Record-ID"] else None for h, _ in got],
                        "url": [h["WARC-Target-URI"] for h, _ in got],
                        "digest": [h["WARC-Payload-Digest"].removeprefix("sha1:") for h, _ in got],
                        "record_type": [h["WARC-Type"] for h, _ in got],
                        "refers_to": [int(h["WARC-Refers-To"][len("<urn:page:") : -1]) if "WARC-Refers-To" in h else None for h, _ in got],
                        "payload_bytes": [int(h["X-Payload-Length"]) for h, _ in got],
                        "payload": [b for _, b in got],
                    },
                    schema=_READ,
                )
                i = j

    # The index rows are few bytes, so the number of tasks comes from what they point to.
    size = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(spark.sparkContext.defaultParallelism, -(-size // TASK))
    places = index.select("path", "offset", "length").repartition(tasks, "path", F.floor(F.col("offset") / CHUNK))
    places = places.sortWithinPartitions("path", "offset")
    return places.mapInArrow(read, "page_id long, url string, digest string, record_type string, refers_to long, payload_bytes long, payload binary")


_READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
