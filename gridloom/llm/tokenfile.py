"""Token files: ids of whole documents, entropy coded in independent checksummed blocks.

File: the magic, the number of distinct ids, blocks and documents; the distinct ids by falling frequency; the
counts of their classes that every block starts from; a row per block (tokens, bytes, CRC-32 of the ids); a row
per document (doc_id, tokens); the blocks' codes.  All numbers are little-endian.  A block can be decoded with
the head and its own bytes alone; a wrong checksum raises.  One file holds one range of the documents in ascending order.

Defined cases: a null text is empty and leaves only the end id; a null doc_id is written as a flag and
comes first; documents with equal ids are ordered by a hash of their text; an empty table gives no file
and an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.staging import materialize, new_path
from gridloom.llm.files import fresh_name, open_store
from gridloom.llm.rangecoder import class_counts, decode_blocks, encode_blocks
from gridloom.llm.tokens import TOGETHER, encoder

MAGIC = b"GLTK2\n"
BLOCK = 2048
#: Most blocks coded side by side, which bounds the coder's memory.
LANES = 3072
#: Most tokens of one file; a task with more starts another.
FILE_TOKENS = 6_000_000
#: Ids are below this number, which bounds the table of their frequencies.
LARGEST = 1 << 24


def pack_file(ids: np.ndarray, doc_ids: list[int | None], doc_tokens: list[int]) -> bytes:
    if len(ids) and int(ids.max()) >= LARGEST:
        raise ValueError(f"ids must be below {LARGEST}")
    often = np.bincount(ids, minlength=1)
    distinct = np.flatnonzero(often)
    distinct = distinct[np.argsort(-often[distinct], kind="stable")]
    place = np.zeros(len(often), dtype=np.int32)
    place[distinct] = np.arange(len(distinct), dtype=np.int32)
    dense, prior = place[ids], class_counts(often[distinct])
    blocks, codes = [dense[i : i + BLOCK] for i in range(0, len(dense), BLOCK)], []
    for i in range(0, len(blocks), LANES):
        codes += encode_blocks(blocks[i : i + LANES], len(distinct), prior)
    rows = [struct.pack("<III", len(b), len(c), zlib.crc32(ids[i * BLOCK : i * BLOCK + len(b)].astype("<u4").tobytes())) for i, (b, c) in enumerate(zip(blocks, codes, strict=True))]
    docs = np.zeros(len(doc_ids), dtype=[("none", "<u1"), ("id", "<i8"), ("n", "<u8")])
    docs["none"] = [x is None for x in doc_ids]
    docs["id"] = [x or 0 for x in doc_ids]
    docs["n"] = doc_tokens
    head = struct.pack("<III", len(distinct), len(blocks), len(doc_ids))
    return MAGIC + head + distinct.astype("<u4").tobytes() + prior.astype("<u2").tobytes() + b"".join(rows) + docs.tobytes() + b"".join(codes)


def unpack_file(data: bytes) -> tuple[np.ndarray, list[int | None], np.ndarray]:
    """Ids, doc_ids and token counts; every block's checksum is verified."""
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token file")
    at = len(MAGIC)
    n_ids, n_blocks, n_docs = struct.unpack_from("<III", data, at)
    at += 12
    distinct = np.frombuffer(data, dtype="<u4", count=n_ids, offset=at)
    at += 4 * n_ids
    prior = np.frombuffer(data, dtype="<u2", count=max(1, n_ids.bit_length()), offset=at)
    at += prior.nbytes
    rows = np.frombuffer(data, dtype="<u4", count=3 * n_blocks, offset=at).reshape(-1, 3)
    at += 12 * n_blocks
    docs = np.frombuffer(data, dtype=[("none", "<u1"), ("id", "<i8"), ("n", "<u8")], count=n_docs, offset=at)
    at += docs.nbytes
    starts = at + np.concatenate([[0], np.cumsum(rows[:, 1], dtype=np.int64)])
    parts = []
    for i in range(0, n_blocks, LANES):
        j = min(n_blocks, i + LANES)
        dense = decode_blocks([data[starts[k] : starts[k + 1]] for k in range(i, j)], [int(x) for x in rows[i:j, 0]], n_ids, prior)
        for k, d in zip(range(i, j), dense, strict=True):
            ids = distinct[d]
            if zlib.crc32(ids.tobytes()) != rows[k, 2]:
                raise ValueError(f"block {k} is damaged")
            parts.append(ids)
    ids = np.concatenate(parts) if parts else np.zeros(0, dtype="<u4")
    return ids, [None if d["none"] else int(d["id"]) for d in docs], docs["n"]


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 1, drops_space: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the files and return their index: ``(part, seq, path, n_docs, n_tokens, n_bytes)``.

    Texts are dealt by ranges of (doc_id, text hash), so file order is document order.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("tie"), F.col(text).cast("binary").alias("text"))
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
    folder = new_path(spark, "tokens")
    end = struct.pack("<I", end_id)
    schema = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer, drops_space), TaskContext.get().partitionId()
        fs, root = open_store(folder)
        fs.create_dir(root, recursive=True)
        got: list[bytes] = []
        ids: list[int | None] = []
        held, seq = 0, 0

        def flush() -> pa.RecordBatch:
            path = fresh_name(root, ".tok")
            data = pack_file(np.frombuffer(b"".join(got), dtype="<u4"), ids, [len(x) // 4 for x in got])
            with fs.open_output_stream(path, compression=None) as f:
                f.write(data)
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "path": path, "n_docs": len(ids), "n_tokens": held, "n_bytes": len(data)}], schema=schema)

        for batch in batches:
            for k in range(0, batch.num_rows, TOGETHER):
                part_rows = batch.slice(k, TOGETHER)
                for d, raw in zip(part_rows.column(0).to_pylist(), enc.encode_all(part_rows.column(1).to_pylist(), end), strict=True):
                    got.append(raw)
                    ids.append(d)
                    held += len(raw) // 4
                    if held >= FILE_TOKENS:
                        yield flush()
                        got, ids, held, seq = [], [], 0, seq + 1
        if ids:
            yield flush()

    index = rows.select("doc_id", "text").mapInArrow(write, "part long, seq long, path string, n_docs long, n_tokens long, n_bytes long")
    return materialize(index, "tokens-index")


def read_token_files(index: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, decoded from the files."""
    order = Window.orderBy("part", "seq")  # one row per file
    before = F.coalesce(F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = materialize(index.select("path", before.cast("long").alias("first")), "tokens-starts")
    n = max(1, index.count())
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs = None
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs = fs or open_store(folder)[0]
                with fs.open_input_file(path) as f:
                    ids, doc_ids, counts = unpack_file(f.read())
                ends = np.cumsum(counts, dtype=np.int64)
                raw = memoryview(np.ascontiguousarray(ids, dtype="<u4").tobytes())
                starts = ends - counts.astype(np.int64)
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": doc_ids, "start": first + starts, "n_tokens": counts.astype(np.int64), "ids_crc32": crc}, schema=schema)

    folder = new_path(index.sparkSession, "tokens")
    return files.repartition(n, "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
