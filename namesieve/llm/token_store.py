"""Token ids in fixed-width bit-packed blocks.

A store is a folder of Parquet files whose rows are blocks. A block holds the ids of whole documents, each id in the
fewest bits that the vocabulary needs (least significant bit first), some 65,536 ids or one longer document; beside
the packed ids it has its shard, its number, its offset (ids of the shard before it) and the ids and lengths of its
documents. Blocks unpack with numpy without a loop over ids, and any range of a block can be unpacked alone, so a
position of the corpus is found by its block's offset.

Shards are ranges of document ids in ascending order. Offsets are kept within a shard, so every shard is written in
one pass; shards' totals (one small row each) give the place in the whole corpus on reading. Spark writes the files,
so a task that is lost is simply run again.

Defined results: a null or empty text is the end id alone; null document ids come first; repeated rows are stored
again, side by side; rows with one id are ordered by their text's hash; an empty table gives an empty store; other
columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from namesieve.llm.tokens import encoder

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
BLOCK_IDS = 65_536
BLOCKS = (
    "shard int, block int, offset long, n_ids long, width int, "
    "doc_ids array<long>, doc_lengths array<long>, payload binary"
)


def width_of(vocabulary: int) -> int:
    """The bits that the largest id needs."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids as ``width`` bits each, least significant bit first."""
    data = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if width % 8 == 0:
        return data[:, : width // 8].tobytes()
    bits = np.unpackbits(data, axis=1, bitorder="little")[:, :width]
    return np.packbits(bits.ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, width: int, start: int, stop: int) -> np.ndarray:
    """The ids from ``start`` to ``stop`` of a block; only their bytes are touched."""
    first = start * width // 8
    data = np.frombuffer(payload, np.uint8)[first : (stop * width + 7) // 8]
    out = np.zeros((stop - start, 4), np.uint8)
    if width % 8 == 0:
        out[:, : width // 8] = data.reshape(-1, width // 8)
        return out.view("<u4").ravel()
    skip = start * width - first * 8
    bits = np.unpackbits(data, bitorder="little")[skip : skip + (stop - start) * width]
    wide = np.zeros((stop - start, 32), np.uint8)
    wide[:, :width] = bits.reshape(-1, width)
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


def crc32_of(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").data)


def _blocks(tokenizer: str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        width = width_of(max(encode.size, end_id + 1))
        end = np.array([end_id], "<u4")
        shard = TaskContext.get().partitionId()
        block = offset = size = 0
        docs: list[int | None] = []
        parts: list[np.ndarray] = []

        def flushed() -> dict:
            ids = np.concatenate(parts)
            return {
                "shard": shard, "block": block, "offset": offset, "n_ids": len(ids), "width": width,
                "doc_ids": list(docs), "doc_lengths": [len(p) for p in parts], "payload": pack(ids, width),
            }

        schema = pa.schema(
            {
                "shard": pa.int32(), "block": pa.int32(), "offset": pa.int64(), "n_ids": pa.int64(),
                "width": pa.int32(), "doc_ids": pa.list_(pa.int64()), "doc_lengths": pa.list_(pa.int64()),
                "payload": pa.binary(),
            }
        )
        for batch in batches:
            rows: list[dict] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                docs.append(doc)
                parts.append(np.concatenate([encode.ids(text.as_py()).astype("<u4"), end]))
                size += len(parts[-1])
                if size >= BLOCK_IDS:
                    rows.append(flushed())
                    block, offset, size = block + 1, offset + size, 0
                    docs.clear()
                    parts.clear()
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)
        if docs:
            yield pa.RecordBatch.from_pylist([flushed()], schema)

    return run


def write(
    docs: DataFrame,
    folder: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = TOKENIZER,
    end_id: int = END_ID,
) -> None:
    """Encode ``docs`` and write them to ``folder`` in ascending order of their ids."""
    tie = F.xxhash64("text")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    ordered = rows.repartitionByRange("id", tie).sortWithinPartitions("id", tie)
    ordered.mapInArrow(_blocks(tokenizer, end_id), BLOCKS).write.parquet(folder)


def placed_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The blocks with ``start``: the ids of the whole corpus before each."""
    blocks = spark.read.schema(BLOCKS).parquet(folder)
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("total"))
    # One row per shard, that is per file: the only thing that is ordered as a whole.
    before = F.sum("total").over(Window.orderBy("shard")) - F.col("total")
    places = totals.select(F.col("shard").alias("of_shard"), before.alias("before"))
    # 16 bytes a shard, so bounded by the number of files: broadcast, or the payloads would be shuffled for it.
    joined = blocks.join(F.broadcast(places), F.col("shard") == F.col("of_shard"))
    return joined.withColumn("start", F.col("before") + F.col("offset")).drop("of_shard", "before")


def _documents(ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                stops = np.cumsum(row["doc_lengths"])
                starts = stops - row["doc_lengths"]
                found = [unpack(row["payload"], row["width"], a, b) for a, b in zip(starts.tolist(), stops.tolist())]
                columns = [
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(row["start"] + starts, pa.int64()),
                    pa.array(row["doc_lengths"], pa.int64()),
                    pa.array([crc32_of(x) for x in found], pa.int64()),
                ]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if ids:
                    columns.append(pa.array([x.astype(np.int32) for x in found], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


DIGEST = "doc_id long, start long, n_tokens long, ids_crc32 long"


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """Per stored document its place, its length and a checksum of its ids, from the files."""
    blocks = placed_blocks(spark, folder).select("start", "width", "doc_ids", "doc_lengths", "payload")
    return blocks.mapInArrow(_documents(False), DIGEST)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The stored documents with their ids."""
    blocks = placed_blocks(spark, folder).select("start", "width", "doc_ids", "doc_lengths", "payload")
    return blocks.mapInArrow(_documents(True), f"{DIGEST}, ids array<int>")


def span(spark: SparkSession, folder: str, start: int, stop: int) -> np.ndarray:
    """The ids of the corpus from ``start`` to ``stop``; only the blocks that hold some of them are fetched."""
    hit = (F.col("start") < stop) & (F.col("start") + F.col("n_ids") > start)
    rows = placed_blocks(spark, folder).where(hit).orderBy("start").select("start", "n_ids", "width", "payload")
    parts = [
        unpack(r.payload, r.width, max(start - r.start, 0), min(stop - r.start, r.n_ids)) for r in rows.toLocalIterator()
    ]
    return np.concatenate(parts) if parts else np.empty(0, "<u4")
