"""Token ids in files of fixed-width bit-packed blocks.

Ids are stored in the fewest bits the vocabulary needs. A dataset is a Parquet folder whose
rows are blocks: ``shard, block, bits, n_ids, doc_ids, ends, payload``. A block holds whole
documents in ascending id order up to about ``block`` ids; ``ends`` are the places in it where
its documents end, ``payload`` the packed ids, first id in the lowest bits. Any stretch of ids
is read with ``unpack(payload, bits, start, stop)`` without touching the rest, and the running
sums of ``n_ids`` say in which block an id of the whole dataset lies. Files are written through
Spark's committer, so a lost task leaves nothing behind, on any file system Spark writes to.

A null text counts as empty and stores the end id alone. Null ids come first, equal ids in the
order of their texts' hashes; every row is stored, repeated ones too. Only the named columns
are read. An empty table gives an empty dataset.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamlog.llm.common import in_slices, offsets_before
from loamlog.llm.tokens import encoded, encoder

BLOCK = 1 << 16
_SLAB = 1 << 13  # a multiple of 8, so that slabs begin at whole bytes


def schema(id_type: str) -> str:
    return (
        f"shard int, block int, bits int, n_ids long, doc_ids array<{id_type}>, "
        "ends array<bigint>, payload binary"
    )


def width(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids below 2**bits, lowest bits first."""
    parts = []
    for low in range(0, len(ids), _SLAB):
        slab = np.ascontiguousarray(ids[low : low + _SLAB], "<u4").view(np.uint8).reshape(-1, 4)
        own = np.unpackbits(slab, axis=1, bitorder="little")[:, :bits]
        parts.append(np.packbits(own, axis=None, bitorder="little").tobytes())
    return b"".join(parts)


def unpack(payload: bytes, bits: int, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` up to ``stop`` of a block, reading only their bytes."""
    parts = [np.zeros(0, "<u4")]
    for low in range(start, stop, _SLAB):
        n = min(_SLAB, stop - low)
        first, skip = divmod(low * bits, 8)
        raw = np.frombuffer(payload, np.uint8, (skip + n * bits + 7) // 8, first)
        own = np.zeros((n, 32), np.uint8)
        own[:, :bits] = np.unpackbits(raw, bitorder="little")[skip : skip + n * bits].reshape(n, bits)
        parts.append(np.packbits(own, axis=1, bitorder="little").view("<u4").ravel())
    return np.concatenate(parts)


def write_ids(
    documents: DataFrame,
    path: str,
    tokenizer: str,
    end: int,
    doc_id: str = "doc_id",
    text: str = "text",
    block: int = BLOCK,
) -> None:
    """Encode the documents and write the dataset; shards ascend with the ids."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number = TaskContext.get().partitionId(), 0
        bits = width(max(encoder(tokenizer).vocabulary, end + 1))
        names: list = []
        held: list[np.ndarray] = []
        size = 0
        kind = None

        def leave() -> pa.RecordBatch:
            ends = np.cumsum([len(h) for h in held])
            row = [shard, number, bits, size, names, ends.tolist(), pack(np.concatenate(held), bits)]
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(kind), pa.list_(pa.int64()), pa.binary()]
            fields = ["shard", "block", "bits", "n_ids", "doc_ids", "ends", "payload"]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], fields)

        for batch in found:
            kind = batch.schema.field("id").type
            texts = encoded(batch.column("text"), tokenizer, end)
            for name, ids in zip(batch.column("id").to_pylist(), texts):
                names.append(name)
                held.append(ids)
                size += len(ids)
                if size >= block:
                    yield leave()
                    names, held, size, number = [], [], 0, number + 1
        if held:
            yield leave()

    rows = documents.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    order = [F.col("id"), F.xxhash64("text")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    kind = rows.schema["id"].dataType.simpleString()
    ordered.mapInArrow(in_slices(batches), schema(kind)).write.parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with ``start``, the ids of the dataset before them."""
    blocks = spark.read.parquet(path)
    sizes = blocks.select("shard", "block", "n_ids")
    shards = offsets_before(sizes.groupBy("shard").agg(F.sum("n_ids").alias("n")), "shard", "n", "earlier")
    within = offsets_before(sizes, "block", "n_ids", "inside", "shard").drop("n_ids")
    starts = within.join(shards.drop("n"), "shard")
    starts = starts.select("shard", "block", (F.col("earlier") + F.col("inside")).alias("start"))
    return blocks.join(starts, ["shard", "block"])


def documents_of(blocks: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` (little-endian unsigned 32-bit) of every document."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for row in batch.to_pylist():
                ends = np.array(row["ends"], np.int64)
                begins = np.append(0, ends[:-1])
                ids = [unpack(row["payload"], row["bits"], a, b).tobytes() for a, b in zip(begins, ends)]
                columns = [
                    pa.array(row["doc_ids"], batch.schema.field("doc_ids").type.value_type),
                    pa.array(row["start"] + begins),
                    pa.array(ends - begins),
                    pa.array(ids, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids"])

    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    blocks = blocks.select("bits", "doc_ids", "ends", "payload", "start")
    return blocks.mapInArrow(in_slices(batches), f"doc_id {kind}, start long, n_tokens long, ids binary")
