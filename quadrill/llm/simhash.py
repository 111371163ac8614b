"""SimHash fingerprints and near-duplicate links by Golay-code fuzzy hashing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrill.llm.components import components
from quadrill.llm.store import materialise, shuffle_parts

SEED = 42
#: Bits of a fingerprint in each of its three segments, and where they start.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
MOST_APART = 3
#: Fingerprints of a key are compared in blocks of about this many.
BLOCK = 4096
FINGERPRINTS_A_TASK = 500_000


def fingerprint(text: str | None, words_a_shingle: int = 3) -> int:
    """The 64-bit fingerprint of a whole text; 0 if it has no word."""
    import xxhash

    hashed = xxhash.xxh64_intdigest
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # both of ASCII only
    if not words:
        return 0
    if len(words) < words_a_shingle:
        shingles = iter([tuple(words)])
        n = 1
    else:
        shingles = zip(*(words[k:] for k in range(words_a_shingle)), strict=False)
        n = len(words) - words_a_shingle + 1
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 32768):
        some = min(32768, n - at)
        h = np.fromiter((hashed(b" ".join(x), SEED) for x, _ in zip(shingles, range(some))), dtype="<u8", count=some)  # noqa: B905
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the fingerprint's bits as a signed long, one row a document."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py()) for t in batch.column("text")), dtype=np.uint64, count=batch.num_rows)
            yield pa.record_batch([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(of, "doc_id long, fp long")


class Golay:
    """The perfect binary Golay code of length 23: each word is within 3 bits of one codeword."""

    GENERATOR = 0b110001110101  # fixed value: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1

    def __init__(self):
        by_bit = []
        for bit in range(23):
            rest = 1 << bit
            for k in range(bit, 10, -1):
                if rest >> k & 1:
                    rest ^= self.GENERATOR << (k - 11)
            by_bit.append(rest)
        self.syndromes = np.zeros((3, 256), dtype=np.int32)
        for byte in range(3):
            for value in range(256):
                for bit in range(8):
                    if value >> bit & 1 and 8 * byte + bit < 23:
                        self.syndromes[byte, value] ^= by_bit[8 * byte + bit]
        self.errors = np.zeros(2048, dtype=np.int32)
        for weight in (1, 2, 3):
            for bits in combinations(range(23), weight):
                s = 0
                for b in bits:
                    s ^= by_bit[b]
                self.errors[s] = sum(1 << b for b in bits)

    def index(self, words: np.ndarray) -> np.ndarray:
        """The 12-bit index of each word's codeword."""
        s = self.syndromes
        error = self.errors[s[0, words & 255] ^ s[1, words >> 8 & 255] ^ s[2, words >> 16]]
        return (words ^ error) >> 11

    def near(self, words: np.ndarray, bits: int) -> np.ndarray:
        """The indices of each word and of all words one of ``bits`` away, a row a word; repeats are -1."""
        flips = np.concatenate([[0], 1 << np.arange(bits)]).astype(np.int32)
        found = np.sort(self.index(words[:, None] ^ flips), axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        return found


@lru_cache
def golay() -> Golay:
    return Golay()


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, side and row of each fingerprint's keys.

    At most 3 bits differ over three segments. So either some segment i has
    none of them and another, j, at most one, or each segment has just one.
    A segment with at most one: a's codeword is among those near b's segment,
    and b's among those near a's. Side 0 of b and side 1 of a meet in
    (class, segment i, codeword of j), where side 0 gives j's own codeword and
    side 1 each near one; or in (class, three codewords), where side 0 gives the
    near ones of the first and third segment and side 1 those of the second.
    Some 70 keys a fingerprint in all, each of 34 bits or more, so that few
    fingerprints meet by chance.
    """
    code, u = golay(), fps.view(np.uint64)
    whole, own, near = [], [], []
    for start, bits in SEGMENTS:
        words = ((u >> np.uint64(start)) & np.uint64((1 << bits) - 1)).astype(np.int32)
        whole.append(words.astype(np.int64))
        own.append(code.index(words).astype(np.int64))
        near.append(code.near(words, bits).astype(np.int64))
    out = []

    def give(key: np.ndarray, side: int, row: np.ndarray) -> None:
        out.append((key, np.full(len(row), side, np.int8), row))

    every = np.arange(len(fps))
    for k, (i, j) in enumerate(permutations(range(3), 2)):
        head = (k << 40) | (whole[i] << 12)
        give(head | own[j], 0, every)
        row, at = np.nonzero(near[j] >= 0)
        give(head[row] | near[j][row, at], 1, row)
    row, at = np.nonzero(near[0] >= 0)
    both, again = np.nonzero(near[2][row] >= 0)
    row, at = row[both], at[both]
    give((6 << 40) | (near[0][row, at] << 24) | (own[1][row] << 12) | near[2][row, again], 0, row)
    row, at = np.nonzero(near[1] >= 0)
    give((6 << 40) | (own[0][row] << 24) | (near[1][row, at] << 12) | own[2][row], 1, row)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _keyed(fps: DataFrame) -> DataFrame:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_fps = batch.column("fp").to_numpy()
            for at in range(0, len(all_fps), 4096):
                some = all_fps[at : at + 4096]
                key, side, row = keys(some)
                yield pa.record_batch([pa.array(key), pa.array(side), pa.array(some[row])], names=["key", "side", "fp"])

    return fps.select("fp").mapInArrow(of, "key long, side byte, fp long")


def _forest(left: np.ndarray, right: np.ndarray) -> tuple[list[int], list[int]]:
    """Links that join whatever is linked between two blocks, one less than the nodes they join at most."""
    label, us, vs = np.arange(len(right)), [], []
    for a in left:
        near = np.flatnonzero(np.bitwise_count(right ^ a) <= MOST_APART)
        if len(near):
            joined, first = np.unique(label[near], return_index=True)
            us += [a] * len(joined)
            vs += right[near[first]].tolist()
            if len(joined) > 1:
                label[np.isin(label, joined)] = joined[0]
    return us, vs


def _verified(blocks: DataFrame) -> DataFrame:
    """Links of 3 bits or fewer between the two sides of each row's block."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for name in ("lefts", "rights"):
                column = batch.column(name)
                offsets = column.offsets.to_numpy().astype(np.int64)
                sides.append((column.values.to_numpy(), offsets[:-1], np.diff(offsets)))
            (lv, lo, ln), (rv, ro, rn) = sides
            small = ln * rn <= 256
            size = np.where(small, ln * rn, 0)
            group = np.repeat(np.arange(len(ln)), size)
            at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            u, v = lv[lo[group] + at // rn[group]], rv[ro[group] + at % rn[group]]
            near = np.bitwise_count((u ^ v).view(np.uint64)) <= MOST_APART
            us, vs = [u[near]], [v[near]]
            for g in np.flatnonzero(~small):
                a, b = _forest(lv[lo[g] : lo[g] + ln[g]].view(np.uint64), rv[ro[g] : ro[g] + rn[g]].view(np.uint64))
                us.append(np.array(a, dtype=np.uint64).view(np.int64))
                vs.append(np.array(b, dtype=np.uint64).view(np.int64))
            u, v = np.concatenate(us), np.concatenate(vs)
            yield pa.record_batch([pa.array(u[u != v]), pa.array(v[u != v])], names=["u", "v"])

    return blocks.mapInArrow(of, "u long, v long")


def links(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """(u, v): links between distinct fingerprints that join all that are 3 bits or fewer apart.

    Only keys that two fingerprints meet in go on. A key with many is split into
    blocks of about ``block`` a side, and each pair of blocks is compared by
    itself: no group meets in one task, and what comes out of a pair of blocks
    is a forest, not all pairs.
    """
    # A fingerprint takes few bytes and has some 70 keys: dealt out first, or few tasks would make them all.
    parts = max(shuffle_parts(fps.sparkSession), -(-fps.count() // FINGERPRINTS_A_TASK))
    keyed = materialise(_keyed(fps.select("fp").repartition(parts)), "keys")
    met = keyed.groupBy("key").agg(F.count_if(F.col("side") == 0).alias("nl"), F.count_if(F.col("side") == 1).alias("nr"), F.min("fp").alias("a"), F.max("fp").alias("b"))
    met = met.where("nl > 0 and nr > 0 and a <> b").select("key", F.ceil(F.col("nl") / block).cast("int").alias("bl"), F.ceil(F.col("nr") / block).cast("int").alias("br"))
    own = F.when(F.col("side") == 0, F.pmod(F.xxhash64("fp"), "bl")).otherwise(F.pmod(F.xxhash64("fp"), "br")).cast("int")
    other = F.explode(F.when(F.col("side") == 0, F.sequence(F.lit(0), F.col("br") - 1)).otherwise(F.sequence(F.lit(0), F.col("bl") - 1)))
    dealt = keyed.join(met, "key").select("key", "side", "fp", own.alias("own"), other.alias("other"))
    at = dealt.select("key", "side", "fp", F.when(F.col("side") == 0, F.col("own")).otherwise(F.col("other")).alias("l"), F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("own")).alias("r"))
    sides = [F.collect_list(F.when(F.col("side") == k, F.col("fp"))).alias(name) for k, name in enumerate(("lefts", "rights"))]
    return _verified(at.groupBy("key", "l", "r").agg(*sides).select("lefts", "rights"))


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row a document.

    Fingerprints of 3-word shingles of the lower-cased (A-Z) text link at 3 or
    fewer differing bits; component_id is the smallest doc_id that links reach.
    Null and empty texts have fingerprint zero and link like any other. Exact
    copies meet in one fingerprint before any join. Rows that repeat a doc_id
    each stay; a null doc_id counts only where a component has no other (then
    component_id is null). An empty table gives no rows.
    """
    fps = materialise(fingerprints(docs, doc_id, text), "fingerprints")
    distinct = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = components(links(distinct)).withColumnRenamed("node", "fp")
    joined = distinct.join(roots, "fp")
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = joined.join(least, "root").select("fp", "component_id")
    # Few fingerprints have links; the others' component is their own least id.
    # It is written, as only a join of two plain shuffles can be split where many documents share a fingerprint.
    whole = materialise(distinct.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "whole")
    return fps.join(whole, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
