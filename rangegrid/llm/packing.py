"""Best-fit packing, planned on a histogram of lengths.

Defined results: a null text is an empty one and still ends with the end id; repeated rows are pieces of their own; an
empty table gives an empty table; columns of the input other than the id are not carried; a text of any length is cut
into full pieces and a rest.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rangegrid.functions.names import constant_array
from rangegrid.llm.common import CACHE_BYTES, encode_column, text_batches, tokenizer_path, written

#: Tokens of a sequence; the id that ends a document; bytes of text that are tokenized at once.
MOST, END_ID, AT_ONCE = 2048, 0, 8 << 20
#: Pieces of one length that a task ranks; how many parts that may make.
PIECES_A_PART, MOST_PARTS = 500, 20_000


def pieces(docs: DataFrame, text: str = "text", path: str | None = None, most: int = MOST, end_id: int = END_ID, with_ids: bool = False, at_once: int = AT_ONCE, cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32 [, ids]): every document's ids and the end id, cut only if longer than ``most``.

    A worker tokenizes about ``at_once`` bytes of text at a time and keeps words of ``cache_bytes``.
    """
    path = path or tokenizer_path()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        for b in text_batches(batches, "text", limit=at_once):
            ids, offsets = encode_column(b.column(b.schema.get_field_index("text")), path, cache_bytes)
            n = np.diff(offsets) + 1
            count = (n + most - 1) // most
            doc = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            length = np.minimum(most, n[doc] - piece * most)
            crc, flat = np.empty(len(doc), np.int64), []
            end = np.array([end_id], np.uint32)
            at = 0
            for d in range(len(n)):
                own = np.concatenate([ids[offsets[d] : offsets[d + 1]], end])
                for k in range(count[d]):
                    part = own[k * most : (k + 1) * most]
                    crc[at] = zlib.crc32(part.astype("<u4").tobytes())
                    at += 1
                    if with_ids:
                        flat.append(part)
            out = [b.column(b.schema.get_field_index("doc_id")).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(piece.astype(np.int64) * most), pa.array(length.astype(np.int64)), pa.array(crc)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                values = np.concatenate(flat).astype(np.int32) if flat else np.zeros(0, np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), pa.array(values)))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names=names)

    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(cut, schema)


def plan(counts: dict[int, int], most: int = MOST) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit by decreasing length over counts: rows (length, first rank, end rank, first sequence, pieces a sequence, offset).

    Sequences that look alike are one group, kept by the room left in them. Pieces of a length go to the group with the
    least room that holds them, as many to each of its sequences as fit; what no group holds opens new sequences. A
    group is split only where a length runs out, so that the plan follows the number of lengths, not of documents.
    """
    rows, room, heap = [], defaultdict(list), []  # room -> [(first sequence, sequences)]
    made = 0

    def put(left: int, first: int, n: int) -> None:
        if left > 0 and n > 0:
            if not room[left]:
                heappush(heap, left)
            room[left].append((first, n))

    for length in sorted((k for k, v in counts.items() if v > 0), reverse=True):
        rank, todo = 0, counts[length]
        held = []  # rooms below length: none of the lengths to come is longer, so they wait
        while todo and heap:
            left = heap[0]
            if not room[left]:
                heappop(heap)
                continue
            if left < length:
                held.append(heappop(heap))
                continue
            first, n = room[left].pop()
            each = left // length
            full = min(n, todo // each)
            offset = most - left
            if full:
                rows.append((length, rank, rank + full * each, first, each, offset))
                rank, todo = rank + full * each, todo - full * each
                put(left - each * length, first, full)
            if full < n:
                if todo:  # fewer than one sequence's share remains
                    rows.append((length, rank, rank + todo, first + full, todo, offset))
                    put(left - todo * length, first + full, 1)
                    rank, todo, full = rank + todo, 0, full + 1
                put(left, first + full, n - full)
        for left in held:
            heappush(heap, left)
        if todo:
            each = most // length
            full = todo // each
            if full:
                rows.append((length, rank, rank + full * each, made, each, 0))
                put(most - each * length, made, full)
                rank, todo, made = rank + full * each, todo - full * each, made + full
            if todo:
                rows.append((length, rank, rank + todo, made, todo, 0))
                put(most - todo * length, made, 1)
                made += 1
    return rows


def pack(cut: DataFrame, most: int = MOST, pieces_a_part: int = PIECES_A_PART) -> DataFrame:
    """cut (of ``pieces``; must not change when computed again) with sequence_id and offset.

    The histogram has at most ``most`` rows and is all that the driver sees. Ranks within a length come from counts of
    (length, part); a length has as many parts as its count asks for, so that one that a third of all pieces have is
    ranked in many tasks. Full pieces need no rank: each is a sequence of its own, numbered after the planned ones.
    """
    spark = cut.sparkSession
    counts = {r[0]: r[1] for r in cut.where(F.col("length") < most).groupBy("length").count().collect()}
    slots = plan(counts, most)
    used = max((first - -(to - start) // each for _, start, to, first, each, _ in slots), default=0)
    full = cut.where(F.col("length") >= most).select(*cut.columns, (F.monotonically_increasing_id() + used).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    # a row or two a length and split of a group: bounded by the number of lengths, checked before it is broadcast
    if len(slots) > 64 * most + 64:
        raise AssertionError(f"{len(slots)} rows in the plan for lengths up to {most}")
    table = spark.createDataFrame(slots or [(0, 0, 0, 0, 1, 0)], "_length bigint, _from bigint, _to bigint, _first bigint, _each bigint, _offset bigint")
    parts = [max(1, min(MOST_PARTS, -(-counts.get(n, 0) // pieces_a_part))) for n in range(most)]
    of = F.get(constant_array(parts, "int"), F.col("length").cast("int"))
    # a row a length and part: 20,000 parts of the commonest lengths at most
    dealt = cut.where(F.col("length") < most).withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), of))
    sizes = dealt.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    base = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(W.partitionBy("length").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("length", "_part", "_base")
    ranked = dealt.withColumn("_local", F.row_number().over(W.partitionBy("length", "_part").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(base, ["length", "_part"]).withColumn("_rank", F.col("_base") + F.col("_local"))
    placed = ranked.join(F.broadcast(table), (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    at = F.col("_rank") - F.col("_from")
    short = placed.select(*cut.columns, (F.col("_first") + F.floor(at / F.col("_each"))).cast("long").alias("sequence_id"), (F.col("_offset") + at % F.col("_each") * F.col("length")).cast("long").alias("offset"))
    return full.unionByName(short)


def pack_documents(docs: DataFrame, text: str = "text", path: str | None = None, with_ids: bool = False, at_once: int = AT_ONCE, cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """docs' pieces with the places that the plan gives them; with ``with_ids`` their token ids too."""
    # batches of rows that hold about as much text as is tokenized at once
    return pack(written(pieces(docs, text, path, with_ids=with_ids, at_once=at_once, cache_bytes=cache_bytes), "pieces", max(1000, at_once >> 10)))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
