"""Stupid-backoff scores of documents against the n-gram counts of all others."""

from __future__ import annotations

import zlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrill.llm.words import batches, hashed_words, mix

ORDER = 3
BACKOFF = 0.4
#: Characters of a segment of documents, and n-grams of a bucket of the count
#: table: what a task holds at once. Larger values move fewer bytes.
SEGMENT_CHARS, BUCKET_NGRAMS = 6_000_000, 1_500_000
#: n-grams of an order that a character makes at most, to size buckets before anything is counted.
NGRAMS_A_CHAR = 0.15

BLOCKS = "order int, bucket int, seg long, n long, hashes binary, counts binary"
ANSWERS = "seg long, order int, bucket int, known binary, totals binary"
SCORES = "doc_id long, n_words long, log_score double, score double"


def planes(values: np.ndarray) -> bytes:
    """Unsigned integers by bytes of equal weight: high zero bytes left out, uneven ones in Huffman code.

    First the number of planes and of coded ones (the highest), then the coded
    ones' sizes, the coded planes, and the others as they are.
    """
    if not len(values):
        return b""
    wide = np.ascontiguousarray(values, dtype="<u8")
    width = max(1, (int(wide.max()).bit_length() + 7) // 8)
    raw, coded = wide.view(np.uint8).reshape(-1, 8)[:, :width].T, []
    for plane in raw[::-1]:
        coder = zlib.compressobj(1, strategy=zlib.Z_HUFFMAN_ONLY)
        short = coder.compress(plane.tobytes()) + coder.flush()
        if len(short) > 0.95 * len(plane):
            break
        coded.append(short)
    sizes = np.array([len(x) for x in coded], dtype="<u4").tobytes()
    return bytes([width, len(coded)]) + sizes + b"".join(coded) + raw[: width - len(coded)].tobytes()


def from_planes(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), dtype=np.uint8)
    if n:
        width, coded = data[0], data[1]
        at = 2 + 4 * coded
        for k, size in enumerate(np.frombuffer(data, "<u4", coded, 2).tolist()):
            out[:, width - 1 - k] = np.frombuffer(zlib.decompress(data[at : at + size]), np.uint8)
            at += size
        out[:, : width - coded] = np.frombuffer(data, np.uint8, offset=at).reshape(-1, n).T
    return out.reshape(-1).view("<u8")


class Level:
    """The n-grams of one order in a segment: sorted distinct hashes, and where each occurrence ends."""

    def __init__(self, hashes: np.ndarray, ends: np.ndarray, bits: int):
        self.ends = ends
        self.hashes, self.which, self.counts = np.unique(hashes, return_inverse=True, return_counts=True)
        self.totals = self.counts.astype(np.int64)  # until others' counts are known
        # Buckets are the high bits, so each is one slice. Only those that the segment has are listed.
        bucket = self.hashes >> np.uint64(64 - bits) if bits else np.zeros(len(self.hashes), np.uint64)
        edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)] if len(bucket) else []
        self.slices = {int(bucket[i]): (i, j) for i, j in pairwise(edges)}

    def answer(self, bucket: int, known: bytes, totals: bytes) -> None:
        a, b = self.slices[bucket]
        some = np.flatnonzero(np.unpackbits(np.frombuffer(known, np.uint8), count=b - a))
        self.totals[a + some] = from_planes(totals, len(some)).astype(np.int64)


class Segment:
    """The words of some documents and the n-grams of them that matter."""

    def __init__(self, texts: list[str | None], bits: int):
        hashes, docs, lengths = [], [], []
        for part in batches(texts):
            found = hashed_words(texts[part])
            n = np.diff(found.offsets)
            docs.append(np.repeat(np.arange(part.start, part.stop), n))
            hashes.append(found.hashes)
            lengths.append(n)
        self.words = np.concatenate([np.empty(0, np.uint64), *hashes])
        self.doc = np.concatenate([np.empty(0, np.int64), *docs])
        self.lengths = np.concatenate([np.empty(0, np.int64), *lengths])
        self.place = np.arange(len(self.words)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        self.bits, self.levels, self.others = bits, [], []

    def add(self, order: int) -> Level:
        """The next order: those n-grams that other documents may have.

        A document that has an n-gram has both of its (n-1)-grams: where others
        lack one, they lack it, and it need not be counted at all.
        """
        ends = np.flatnonzero(self.place >= order - 1)
        if order > 2:
            shorter = self.others[order - 2]
            ends = ends[(shorter[ends] > 0) & (shorter[ends - 1] > 0)]
        grams = self.words[ends - order + 1].copy()
        for k in range(order - 2, -1, -1):
            grams = mix(grams * np.uint64(0x9E3779B97F4A7C15) + self.words[ends - k])
        level = Level(mix(grams + np.uint64(order)), ends, self.bits)
        self.levels.append(level)
        return level

    def settle(self) -> None:
        """How many times other documents have the n-gram of the next order that ends at each word."""
        level = self.levels[len(self.others)]
        _, pair, own = np.unique(self.doc[level.ends] * (len(level.hashes) + 1) + level.which, return_inverse=True, return_counts=True)
        row = np.zeros(len(self.words))
        row[level.ends] = level.totals[level.which] - own[pair]
        self.others.append(row)

    def scores(self, n_corpus: int) -> np.ndarray:
        """Sum of log scores of each document, by counts of all other documents."""
        rest = n_corpus - self.lengths[self.doc]
        # A word that no other document has counts once among one more.
        found = np.log(np.maximum(self.others[0], 1.0)) - np.log(np.where(self.others[0] > 0, rest, rest + 1.0))
        used = np.zeros(len(self.words))
        for n in range(1, len(self.others)):
            seen = np.flatnonzero(self.others[n] > 0)
            found[seen] = np.log(self.others[n][seen]) - np.log(self.others[n - 1][seen - 1])
            used[seen] = n
        found += np.log(BACKOFF) * (np.minimum(self.place, len(self.others) - 1) - used)
        return np.bincount(self.doc, weights=found, minlength=len(self.lengths))


def _table(schema: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.table({name: pa.array(c, kind) for (name, kind), c in zip(schema, columns, strict=True)})


BLOCK_TYPES = [("order", pa.int32()), ("bucket", pa.int32()), ("seg", pa.int64()), ("n", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())]
ANSWER_TYPES = [("seg", pa.int64()), ("order", pa.int32()), ("bucket", pa.int32()), ("known", pa.binary()), ("totals", pa.binary())]


def _answered(texts: list[str | None], answers: pa.Table, order: int, bits: int) -> tuple[Segment, int]:
    """The segment with the counts of orders up to ``order``, and the number of words of the corpus."""
    segment, by_order, n_corpus = Segment(texts, bits), {}, 0
    for row in zip(*(answers.column(c).to_pylist() for c in ("order", "bucket", "known", "totals")), strict=True):
        if row[0] == 0:
            n_corpus = int(from_planes(row[3], 1)[0])
        else:
            by_order.setdefault(row[0], []).append(row[1:])
    for n in range(1, order + 1):
        level = segment.add(n)
        for bucket, known, totals in by_order.get(n, ()):
            level.answer(bucket, known, totals)
        segment.settle()
    return segment, n_corpus or len(segment.words)


def _blocks_of(level: Level, order: int, seg: int) -> list[tuple]:
    out = []
    for bucket, (a, b) in level.slices.items():
        out.append((order, bucket, seg, b - a, planes(np.diff(level.hashes[a:b], prepend=np.uint64(0))), planes(level.counts[a:b])))
    return out


def _count(rows: pa.Table) -> pa.Table:
    """Adds up one bucket: answers each segment with the totals of what others have too."""
    order, bucket = rows.column("order")[0].as_py(), rows.column("bucket")[0].as_py()
    segs, sizes = rows.column("seg").to_pylist(), rows.column("n").to_pylist()
    if order == 0:  # the number of all words
        return _table(ANSWER_TYPES, [(s, 0, bucket, b"", planes(np.array([sum(sizes)]))) for s in segs])
    # Deltas wrap around at 2 ** 64, and so does their sum.
    hashes = np.concatenate([np.cumsum(from_planes(h.as_py(), n), dtype=np.uint64) for h, n in zip(rows.column("hashes"), sizes, strict=True)])
    counts = np.concatenate([from_planes(c.as_py(), n).astype(np.int64) for c, n in zip(rows.column("counts"), sizes, strict=True)])
    _, which = np.unique(hashes, return_inverse=True)
    del hashes
    total = np.bincount(which, weights=counts).astype(np.int64)[which]
    out, at = [], 0
    for seg, n in zip(segs, sizes, strict=True):
        some = total[at : at + n] > counts[at : at + n]
        if some.any():
            out.append((seg, order, bucket, np.packbits(some).tobytes(), planes(total[at : at + n][some])))
        at += n
    return _table(ANSWER_TYPES, out)


def score(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", order: int = ORDER, segment_chars: int = SEGMENT_CHARS, bucket_ngrams: int = BUCKET_NGRAMS) -> DataFrame:
    """doc_id, n_words, log_score (sum over words), score (its mean): one row a document row.

    S(w | c) = count(c w) / count(c) if count(c w) > 0, else 0.4 * S(w | c less
    its first word); a single word scores count(w) over the number of words, an
    unseen one 1 over that number and one. Counts are those of all documents but
    the one scored, else every n-gram would be seen. Words are lower-cased,
    punctuation parts them. A null or empty text has no word, log_score 0 and a
    null score. Rows that repeat an id are documents of their own.

    Documents are dealt into segments. A segment counts its n-grams and sends
    each bucket of the count table (high bits of the hash) its sorted hashes;
    the bucket adds the counts of all segments up and answers each with the
    totals of those n-grams that others have too; the segment, read once more,
    sums its documents. Words and pairs go first; longer n-grams follow, an
    order a round, where others have both of the shorter ones. A frequent
    n-gram is one entry a segment, so no bucket is hot, and no count is dropped
    or capped. A segment lists the buckets that it has n-grams in, so blocks are
    never more than n-grams.
    """
    chars = docs.agg(F.sum(F.length(text))).first()[0] or 0
    n_segments = max(1, -(-chars // segment_chars))
    bits = max(0, int(chars * NGRAMS_A_CHAR / bucket_ngrams).bit_length())
    # By the row's number too: rows that repeat each other spread over segments.
    dealt = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("seg", F.pmod(F.xxhash64("doc_id", "text", F.monotonically_increasing_id()), F.lit(n_segments)))
    first = min(2, order)

    def blocks(rows: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _table(BLOCK_TYPES, [])
        segment, seg = Segment(rows.column("text").to_pylist(), bits), rows.column("seg")[0].as_py()
        out = [(0, 0, seg, len(segment.words), b"", b"")]
        for n in range(1, first + 1):
            out += _blocks_of(segment.add(n), n, seg)
        return _table(BLOCK_TYPES, out)

    def longer(n: int):
        def of(rows: pa.Table, answers: pa.Table) -> pa.Table:
            if not rows.num_rows:
                return _table(BLOCK_TYPES, [])
            segment, _ = _answered(rows.column("text").to_pylist(), answers, n - 1, bits)
            return _table(BLOCK_TYPES, _blocks_of(segment.add(n), n, rows.column("seg")[0].as_py()))

        return of

    def sums(rows: pa.Table, answers: pa.Table) -> pa.Table:
        types = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("log_score", pa.float64()), ("score", pa.float64())]
        if not rows.num_rows:
            return _table(types, [])
        segment, n_corpus = _answered(rows.column("text").to_pylist(), answers, order, bits)
        logs, n_words = segment.scores(n_corpus), segment.lengths.astype(np.int64)
        mean = np.divide(logs, n_words, out=np.zeros(len(logs)), where=n_words > 0)
        return pa.table({"doc_id": rows.column("doc_id"), "n_words": pa.array(n_words), "log_score": pa.array(logs), "score": pa.array(mean, mask=n_words == 0)})

    def counted(asked: DataFrame) -> DataFrame:
        return asked.groupBy("order", "bucket").applyInArrow(_count, ANSWERS)

    # One plan: the shuffle of the texts and those of the blocks are reused by every round.

    answers = counted(dealt.groupBy("seg").applyInArrow(blocks, BLOCKS))
    for n in range(first + 1, order + 1):
        to = answers.withColumnRenamed("seg", "to_seg")
        answers = answers.unionByName(counted(dealt.groupBy("seg").cogroup(to.groupBy("to_seg")).applyInArrow(longer(n), BLOCKS)))
    return dealt.groupBy("seg").cogroup(answers.withColumnRenamed("seg", "to_seg").groupBy("to_seg")).applyInArrow(sums, SCORES)
