"""Vector best-fit packing of documents into sequences."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrill.llm.store import materialise
from quadrill.llm.tokens import MOST_KEPT, crc32_of_ids, encoder
from quadrill.llm.words import sliced


@dataclass(frozen=True)
class Capacity:
    """What a sequence can hold, and how its three residuals weigh.

    ``attention`` bounds the sum of squared piece lengths (block-diagonal
    attention). The default for ``documents`` is what ``tokens`` alone allows,
    so only a lower value binds; ``attention`` must allow one full piece, and so
    binds by the side of ``tokens`` never, but weighs: of bins with equal room
    it tells many short pieces from few long ones. Residuals are shares of
    their capacity and weigh alike by default. ``select`` is "residual" (least
    weighted norm of what stays free) or "product" (greatest weighted dot
    product of the piece with what is free).
    """

    tokens: int = 1024
    documents: int = 1024
    attention: int = 1024 * 1024
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0)
    select: str = "residual"

    def __post_init__(self):
        if min(self.tokens, self.documents) < 1 or self.attention < self.tokens**2 or self.select not in ("residual", "product"):
            raise ValueError("a sequence must hold one full piece; select is residual or product")


def pack(lengths: np.ndarray, cap: Capacity) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bin and the offset of each piece, and the tokens in each bin.

    Pieces go in order of falling length to the open bin that ``cap.select``
    rates best among those that have room in all three dimensions.
    """
    top = np.array([cap.tokens, cap.documents, cap.attention], dtype=np.float64)
    weights = np.array(cap.weights) / top**2
    order = np.argsort(-lengths, kind="stable")
    free = np.empty((3, len(lengths)))
    bins, offsets, n = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    closed = 0  # bins before this one are full
    for i in order.tolist():
        size = int(lengths[i])
        if size < cap.tokens:
            room = free[:, closed:n]
            fits = np.flatnonzero((room[0] >= size) & (room[1] >= 1) & (room[2] >= size * size))
        else:
            fits = ()
        if len(fits):
            left = room[:, fits]
            need = np.array([size, 1.0, float(size) * size])
            if cap.select == "residual":
                best = int(np.argmin(weights @ (left - need[:, None]) ** 2))
            else:
                best = int(np.argmax((weights * need) @ left))
            at = closed + int(fits[best])
        else:
            at, n = n, n + 1
            free[:, at] = top
        bins[i], offsets[i] = at, cap.tokens - int(free[0, at])
        free[:, at] -= (size, 1.0, float(size) * size)
        while closed < n and free[0, closed] <= 0:
            closed += 1
    return bins, offsets, cap.tokens - free[0, :n].astype(np.int64)


def cut(n: int, most: int) -> Iterator[tuple[int, int]]:
    """Start and length of each piece of ``n`` ids; a short piece comes first."""
    at, size = 0, n % most or min(n, most)
    while at < n:
        yield at, size
        at, size = at + size, most


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, filled long"
#: A group of pieces is packed in one go; its bins are searched for each piece.
MOST_IN_A_GROUP = 8192
#: Pieces with their ids are packed in smaller groups, so that a task holds no more bytes.
MOST_WITH_IDS = 2048
#: Sequences with less than this share of tokens are packed again with others.
WELL_FILLED = 0.995


def _place(rows: list[tuple], cap: Capacity, base: int, sign: int) -> tuple[pa.RecordBatch, int]:
    """The rows with their places, and the number of sequences; ids run from ``base`` in steps of ``sign``."""
    doc, piece, start, length, crc, *ids = zip(*rows, strict=True)
    lengths = pa.array(length, pa.int64())
    bins, offsets, filled = pack(lengths.to_numpy(), cap)
    columns = {
        "doc_id": pa.array(doc, pa.int64()),
        "piece": pa.array(piece, pa.int32()),
        "start": pa.array(start, pa.int64()),
        "length": lengths,
        "ids_crc32": pa.array(crc, pa.int64()),
        "sequence_id": pa.array(base + sign * bins),
        "offset": pa.array(offsets),
        "filled": pa.array(filled[bins]),
    }
    if ids:
        flat = np.concatenate([np.asarray(x) for x in ids[0]]).astype(np.int32)
        columns["input_ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths.to_numpy())]), pa.int32()), pa.array(flat))
    return pa.record_batch(columns), len(filled)


def pack_documents(docs: DataFrame, tokenizer: str, *, capacity: Capacity | None = None, end_id: int = 2, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False, most_kept: int = MOST_KEPT) -> DataFrame:
    """Pieces of all documents and their places, one row a piece.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and
    ``input_ids`` if ``with_ids``.

    ``most_kept`` bounds the words whose ids a Python worker keeps.

    Each task encodes and packs what it reads, without a shuffle; the sequences
    that stay less than well filled give their pieces (some numbers a piece, no
    text) to a second round over groups dealt at random, so that only the last
    few sequences of a group are not full. A null text is an empty one: its only
    id is ``end_id``. Rows with a null or repeated doc_id are packed like any
    other; rows of one id cannot be told apart in the result. An empty table has
    no pieces.
    """
    cap = capacity or Capacity()
    kept = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = PIECES + ", input_ids array<int>" * with_ids
    most = MOST_WITH_IDS if with_ids else MOST_IN_A_GROUP

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer, most_kept)
        end = np.array([end_id], dtype=code.dtype).tobytes()
        base, rows = TaskContext.get().partitionId() << 33, []
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for at in range(0, len(ids), 256):
                for one, found in zip(ids[at : at + 256], code.encode(texts[at : at + 256].to_pylist()), strict=True):
                    all_ids = np.frombuffer(found + end, dtype=code.dtype)
                    for k, (s, n) in enumerate(cut(len(all_ids), cap.tokens)):
                        own = all_ids[s : s + n]
                        rows.append((one, k, s, n, crc32_of_ids(own), own) if with_ids else (one, k, s, n, crc32_of_ids(own)))
                if len(rows) >= most:
                    out, n_bins = _place(rows, cap, base, 1)
                    yield out
                    base, rows = base + n_bins, []
        if rows:
            yield _place(rows, cap, base, 1)[0]

    packed = materialise(kept.mapInArrow(first, schema), "packed")
    full = F.col("filled") >= int(WELL_FILLED * cap.tokens)
    rest = packed.where(~full)
    groups = max(1, -(-rest.count() // most))
    # Dealt in turn, not by a key: rows that repeat an id spread like any other.
    dealt = rest.drop("sequence_id", "offset", "filled").repartition(groups)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, rows = -1 - (TaskContext.get().partitionId() << 33), []
        for batch in sliced(batches):
            rows += zip(*(([x.values.to_numpy() for x in batch.column(c)] if c == "input_ids" else batch.column(c).to_pylist()) for c in batch.schema.names), strict=True)
            while len(rows) >= 2 * most:
                out, n_bins = _place(rows[:most], cap, base, -1)
                yield out
                base, rows = base - n_bins, rows[most:]
        if rows:
            yield _place(rows, cap, base, -1)[0]

    return packed.where(full).unionByName(dealt.mapInArrow(second, schema)).drop("filled")
