"""Token ids in Arrow files of fixed-size-list batches.

A shard is a pair of files. ``NNNNNNNN.arrow`` holds rows ``ids:
fixed_size_list<uint>[sequence_length]`` and ``mask: fixed_size_list<bool>``:
the ids of the shard's documents one after another, cut into rows of equal
length, the last row filled with zeros that the mask leaves out.
``NNNNNNNN.index.arrow`` says where each document lies. Both are IPC files, so a
reader maps a file and gets any row without copying. Shards follow each other
in ascending order of the document id.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs, ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrill.llm.store import materialise, scratch, shuffle_parts, spare_name
from quadrill.llm.tokens import crc32_of_ids, encoder

ROWS_A_BATCH = 256
#: Bytes of text of a shard, about; a small table has a shard a shuffle partition.
SHARD_MB = 128
SHARDS = "shard long, n_ids long, n_docs long"
DOCS = "doc_id long, start long, n_tokens long, ids_crc32 long"


class ShardWriter:
    """Writes one shard, under other names until it is whole."""

    def __init__(self, folder: str, shard: int, sequence_length: int, dtype: np.dtype):
        self.fs, self.folder = fs.FileSystem.from_uri(folder)
        self.name, self.length, self.dtype = f"{self.folder}/{shard:08d}", sequence_length, dtype
        self.fs.create_dir(self.folder, recursive=True)
        unit = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(unit, sequence_length)), ("mask", pa.list_(pa.bool_(), sequence_length))])
        self.index_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.tried = uuid.uuid4().hex
        self.out = self.fs.open_output_stream(f"{self.name}.{self.tried}.part")
        self.index_out = self.fs.open_output_stream(f"{self.name}.{self.tried}.index.part")
        self.file = ipc.new_file(self.out, self.schema)
        self.index = ipc.new_file(self.index_out, self.index_schema)
        self.open: list[bytes] = []
        self.open_ids = self.n_ids = self.n_docs = 0

    def add(self, doc_ids: list[int | None], encoded: list[bytes]) -> None:
        lengths = np.fromiter((len(x) // self.dtype.itemsize for x in encoded), dtype=np.int64, count=len(encoded))
        starts = self.n_ids + np.cumsum(lengths) - lengths
        self.index.write_batch(pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(starts), pa.array(lengths)], schema=self.index_schema))
        self.n_ids += int(lengths.sum())
        self.n_docs += len(encoded)
        for one in encoded:
            self.open.append(one)
            self.open_ids += len(one) // self.dtype.itemsize
            if self.open_ids >= ROWS_A_BATCH * self.length:
                self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.open), dtype=self.dtype)
        at, step = 0, ROWS_A_BATCH * self.length
        while len(ids) - at >= step or last and at < len(ids):
            part = ids[at : at + step]
            rows = -(-len(part) // self.length)
            full = np.zeros(rows * self.length, dtype=self.dtype)
            full[: len(part)] = part
            mask = np.arange(rows * self.length) < len(part)
            self.file.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (full, mask)], schema=self.schema))
            at += len(part)
        self.open, self.open_ids = [ids[at:].tobytes()], len(ids) - at

    def close(self) -> None:
        self._flush(True)
        for one in (self.file, self.index, self.out, self.index_out):
            one.close()
        self.fs.move(f"{self.name}.{self.tried}.part", f"{self.name}.arrow")
        self.fs.move(f"{self.name}.{self.tried}.index.part", f"{self.name}.index.arrow")


class ShardReader:
    """Random access to a shard's rows and documents."""

    def __init__(self, folder: str, shard: int):
        self.fs, folder = fs.FileSystem.from_uri(folder)
        self.ids_file = ipc.open_file(self._open(f"{folder}/{shard:08d}.arrow"))
        self.index_file = ipc.open_file(self._open(f"{folder}/{shard:08d}.index.arrow"))
        self.length = self.ids_file.schema.field("ids").type.list_size
        self.at, self.held = -1, None

    def _open(self, path: str) -> pa.NativeFile:
        return pa.memory_map(path) if isinstance(self.fs, fs.LocalFileSystem) else self.fs.open_input_file(path)

    def _batch(self, k: int) -> np.ndarray:
        if k != self.at:
            ids = self.ids_file.get_batch(k).column("ids")
            self.at, self.held = k, ids.values.to_numpy(zero_copy_only=True)
        return self.held

    def ids(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from ``start`` in the shard: a view where they lie in one batch."""
        step, parts = ROWS_A_BATCH * self.length, []
        while n > 0:
            k, at = divmod(start, step)
            part = self._batch(k)[at : at + n]
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, "<u2")

    def rows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids and the mask of batch ``k``, one row a sequence."""
        batch = self.ids_file.get_batch(k)
        mask = batch.column("mask").values.to_numpy(zero_copy_only=False)
        return self._batch(k).reshape(-1, self.length), mask.reshape(-1, self.length)


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int = 0, sequence_length: int = 1024, shards: int | None = None
) -> DataFrame:
    """Write ``docs`` to ``folder``; returns one row a shard: shard, n_ids, n_docs.

    Rows are dealt by ranges of (doc_id, a row number), so rows that repeat an
    id still spread over shards. A null id comes before all others, a null text
    is an empty one, and rows that repeat an id each stay. Every document ends
    with ``end_id``. An empty table writes no shard. Unless ``shards`` says how
    many there are, their number follows from the bytes of all texts.
    """
    spark = docs.sparkSession
    kept = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    row = spare_name(kept, "row")
    kept = kept.withColumn(row, F.monotonically_increasing_id())
    if shards is None:
        size = kept.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(shuffle_parts(spark), -(-size // (SHARD_MB * 1_000_000)))
    dealt = kept.repartitionByRange(shards, F.col("doc_id").asc_nulls_first(), row).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), row)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer)
        end, shard, out = np.array([end_id], dtype=code.dtype).tobytes(), TaskContext.get().partitionId(), None
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for at in range(0, len(ids), 512):
                if out is None:
                    out = ShardWriter(folder, shard, sequence_length, code.dtype)
                out.add(ids[at : at + 512], [x + end for x in code.encode(texts[at : at + 512].to_pylist())])
        if out is not None:
            out.close()
            yield pa.record_batch({"shard": [shard], "n_ids": [out.n_ids], "n_docs": [out.n_docs]})

    return materialise(dealt.select("doc_id", "text").mapInArrow(write, SHARDS), "token-shards")


def read_token_files(shards: DataFrame, folder: str) -> DataFrame:
    """One row a document, from the files: doc_id, start (over all shards), n_tokens, ids_crc32."""
    based = shards.withColumn("base", F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_ids"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, base in zip(batch.column("shard").to_pylist(), batch.column("base").to_pylist(), strict=True):
                from_files = ShardReader(folder, shard)
                for k in range(from_files.index_file.num_record_batches):
                    index = from_files.index_file.get_batch(k)
                    starts, lengths = index.column("start").to_numpy(), index.column("n_tokens").to_numpy()
                    sums = [crc32_of_ids(from_files.ids(s, n)) for s, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
                    yield pa.record_batch({"doc_id": index.column("doc_id"), "start": pa.array(starts + base), "n_tokens": index.column("n_tokens"), "ids_crc32": pa.array(sums, pa.int64())})

    return based.select("shard", "base").repartition(shuffle_parts(shards.sparkSession), "shard").mapInArrow(read, DOCS)


def token_files(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write ``docs`` to new files in the shared folder and read them back."""
    spark: SparkSession = docs.sparkSession
    folder = scratch(spark, "token-files")
    return read_token_files(write_token_files(docs, folder, tokenizer, **options), folder)
