"""Token ids as length-delimited binary records, with masked checksums and an offset index of their own.

A record is: length of the data (8 bytes, little-endian), masked CRC-32C of these 8 bytes (4), the data, masked CRC-32C of
the data (4). The data of one document are its ids as unsigned 32-bit little-endian integers, or 16-bit ones where the
writer is told that the vocabulary allows it; the index says which. Files follow each other in ascending id order.

Defined results: a null or empty text gives a record that holds the end id only; rows with equal ids are records of
their own, in the order of a hash of their texts; a null id sorts first; an empty table gives no record; other columns of the
input are not written, whatever their names; a text of any length is one record, tokenized whole by one task.
"""

from __future__ import annotations

import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rangegrid.llm.common import encode_column, new_path, text_batches, tokenizer_path

END_ID, BLOCK = 2, 64

# ---- CRC-32C over many records at once ----


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0x82F63B78), t >> 1)
    return t


_TABLE = _byte_table()


def _skip_tables(n: int) -> np.ndarray:
    """Four tables that carry a CRC register over n zero bytes, by its bytes."""
    reg = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    for _ in range(n):
        reg = _TABLE[reg & 255] ^ (reg >> 8)
    return reg


_SKIP = _skip_tables(BLOCK)


def crc32c(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32C of each data[start : start + size] (uint8), all records at a time.

    Whole blocks are run in step, one byte of each per step; the registers of a record's blocks are then chained by
    tables for a block of zeros, and the bytes after the last whole block follow.
    """
    starts, sizes = np.asarray(starts, np.int64), np.asarray(sizes, np.int64)
    whole = sizes // BLOCK
    first = np.cumsum(whole) - whole
    at = np.repeat(starts, whole) + (np.arange(whole.sum()) - np.repeat(first, whole)) * BLOCK
    reg = np.zeros(len(at), np.uint32)
    for i in range(BLOCK):
        reg = _TABLE[(reg ^ data[at + i]) & 255] ^ (reg >> 8)
    out = np.full(len(sizes), 0xFFFFFFFF, np.uint32)
    order = np.argsort(-whole, kind="stable")
    left = np.searchsorted(-whole[order], -np.arange(1, (whole.max() if len(whole) else 0) + 1), "right")
    for k, n in enumerate(left):
        who = order[:n]
        r = out[who]
        out[who] = _SKIP[0][r & 255] ^ _SKIP[1][(r >> 8) & 255] ^ _SKIP[2][(r >> 16) & 255] ^ _SKIP[3][r >> 24] ^ reg[first[who] + k]
    rest, tail = sizes - whole * BLOCK, starts + whole * BLOCK
    for i in range(BLOCK - 1):
        who = np.flatnonzero(rest > i)
        if not len(who):
            break
        r = out[who]
        out[who] = _TABLE[(r ^ data[tail[who] + i]) & 255] ^ (r >> 8)
    return out ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    """The stored form of a checksum: rotated by 15 bits, plus a constant."""
    crc = crc.astype(np.uint32)
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(0xA282EAD8)


def frame(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all records, where each begins) for data whose records have the given sizes in bytes."""
    sizes = np.asarray(sizes, np.int64)
    starts = np.cumsum(sizes) - sizes
    begin = np.concatenate([[0], np.cumsum(sizes + 16)]).astype(np.int64)
    out = np.zeros(begin[-1], np.uint8)
    heads = np.ascontiguousarray(sizes.astype("<u8")).view(np.uint8)
    head_crc = masked(crc32c(heads, np.arange(len(sizes)) * 8, np.full(len(sizes), 8)))
    crc = masked(crc32c(data, starts, sizes))
    b = begin[:-1]
    out[(b[:, None] + np.arange(8)).ravel()] = heads
    out[(b[:, None] + np.arange(8, 12)).ravel()] = np.ascontiguousarray(head_crc.astype("<u4")).view(np.uint8)
    body = np.repeat(b + 12 - starts, sizes) + np.arange(len(data)) if len(sizes) else np.zeros(0, np.int64)
    out[body] = data
    out[((b + 12 + sizes)[:, None] + np.arange(4)).ravel()] = np.ascontiguousarray(crc.astype("<u4")).view(np.uint8)
    return out, begin


def unframe(raw: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, sizes) of the data of the records that begin at these places; raises if a checksum differs."""
    begin = np.asarray(begin, np.int64)
    if not len(begin):
        return begin, begin
    take = lambda at, n, kind: np.ascontiguousarray(raw[(at[:, None] + np.arange(n)).ravel()]).view(kind)
    sizes = take(begin, 8, "<u8").astype(np.int64)
    if not (take(begin + 8, 4, "<u4") == masked(crc32c(raw, begin, np.full(len(begin), 8)))).all():
        raise ValueError("a record's length doesn't match its checksum")
    if not (take(begin + 12 + sizes, 4, "<u4") == masked(crc32c(raw, begin + 12, sizes))).all():
        raise ValueError("a record's data don't match their checksum")
    return begin + 12, sizes


# ---- writing and reading ----


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1) if uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


def write_records(docs: DataFrame, out: str, text: str = "text", path: str | None = None, end_id: int = END_ID, width: int = 2) -> DataFrame:
    """Write docs' ids below ``out`` (a folder all executors reach) and return the index that was committed.

    Documents are dealt by id into ranges, a task writes its range to one file under a name of its own attempt, and the
    index, written by Spark's committer, names the files that count: a task that is run again leaves no trace in it.
    Index: doc_id, file, part (order of files), place (order in the file), offset, size (of the record), n_tokens, width.
    """
    path = path or tokenizer_path()
    kind = docs.schema["doc_id"].dataType.simpleString()
    dtype = {2: "<u2", 4: "<u4"}[width]
    spark = docs.sparkSession

    def write(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        name = f"{out}/records-{part:06d}-{uuid.uuid4().hex}.bin"
        sink, at, place = None, 0, 0
        try:
            for b in text_batches(batches):
                if sink is None:
                    system, where = _open(name)
                    system.create_dir(os.path.dirname(where), recursive=True)
                    sink = system.open_output_stream(where)
                ids, offsets = encode_column(b.column(b.schema.get_field_index("text")), path)
                n = np.diff(offsets) + 1
                ends = np.cumsum(n) - 1
                full = np.full(int(n.sum()), end_id, np.uint32)
                full[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n - 1)] = ids
                if width == 2 and len(full) and full.max() > 0xFFFF:
                    raise ValueError("ids of this vocabulary need width=4")
                framed, begin = frame(np.ascontiguousarray(full.astype(dtype)).view(np.uint8), n * width)
                sink.write(memoryview(framed))
                rows = len(ends)
                yield pa.RecordBatch.from_arrays(
                    [b.column(b.schema.get_field_index("doc_id")), pa.array([name] * rows), pa.array(np.full(rows, part, np.int32)), pa.array(np.arange(place, place + rows)), pa.array(at + begin[:-1]), pa.array(np.diff(begin)), pa.array(n.astype(np.int64)), pa.array(np.full(rows, width, np.int32))],
                    names=["doc_id", "file", "part", "place", "offset", "size", "n_tokens", "width"],
                )
                at, place = at + int(begin[-1]), place + rows
        finally:
            if sink is not None:
                sink.close()

    schema = f"doc_id {kind}, file string, part int, place bigint, offset bigint, size bigint, n_tokens bigint, width int"
    # a hash beside the id, so that rows that share an id can lie in more than one range
    rows = docs.select("doc_id", F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    dealt = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    dealt.mapInArrow(write, schema).write.parquet(f"{out}/index")
    return spark.read.schema(schema).parquet(f"{out}/index")


def read_records(index: DataFrame, most_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, part, place, within, n_tokens, ids_crc32) of records, read from their files by the index and checked.

    ``within`` counts the ids of the same file before the record, by the index's own counts; ids_crc32 is of what the file holds.
    """
    kind = index.schema["doc_id"].dataType.simpleString()

    def read(batches):
        source, opened = None, None
        for b in batches:
            get = lambda k, b=b: b.column(b.schema.get_field_index(k))
            files, offset, size, width = get("file").to_pylist(), np.asarray(get("offset")), np.asarray(get("size")), np.asarray(get("width"))
            at = 0
            while at < len(files):
                # records that follow each other in a file are fetched at once
                to = at + 1
                while to < len(files) and files[to] == files[at] and width[to] == width[at] and offset[to] == offset[to - 1] + size[to - 1] and offset[to] + size[to] - offset[at] <= most_bytes:
                    to += 1
                if opened != files[at]:
                    if source is not None:
                        source.close()
                    system, where = _open(files[at])
                    source, opened = system.open_input_file(where), files[at]
                raw = np.frombuffer(source.read_at(int(offset[to - 1] + size[to - 1] - offset[at]), int(offset[at])), np.uint8)
                starts, sizes = unframe(raw, offset[at:to] - offset[at])
                kind_of = "<u2" if width[at] == 2 else "<u4"
                crc = [zlib.crc32(np.frombuffer(raw[s : s + n].tobytes(), kind_of).astype("<u4").tobytes()) for s, n in zip(starts, sizes, strict=True)]
                own = b.slice(at, to - at)
                part = lambda k, own=own: own.column(own.schema.get_field_index(k))
                yield pa.RecordBatch.from_arrays(
                    [part("doc_id"), part("part"), part("place"), part("within"), pa.array((sizes // int(width[at])).astype(np.int64)), pa.array(np.array(crc, np.int64))],
                    names=["doc_id", "part", "place", "within", "n_tokens", "ids_crc32"],
                )
                at = to
        if source is not None:
            source.close()

    # a file is what one task wrote, so that its records fit a window; shuffled reads pass an index in another order
    own = W.partitionBy("part", "file").orderBy("place")
    ordered = index.withColumn("within", F.sum("n_tokens").over(own) - F.col("n_tokens"))
    return ordered.mapInArrow(read, f"doc_id {kind}, part int, place bigint, within bigint, n_tokens bigint, ids_crc32 bigint")


def starts(index: DataFrame) -> DataFrame:
    """(part, before): ids of all files before each; one row a file."""
    totals = index.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    return totals.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    index = write_records(docs, new_path(spark, "records"))
    got = read_records(index)
    return got.join(starts(index), "part").select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
