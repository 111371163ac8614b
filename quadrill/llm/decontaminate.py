"""Benchmark decontamination: rare word pairs as seeds, then Smith-Waterman alignment."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrill.llm.store import materialise, spare_name
from quadrill.llm.words import batches, hashed_words, mix, sliced

#: A seed is two words next to each other or with one between them.
APART = (1, 2)
PAIR = np.uint64(0x9E3779B97F4A7C15)
#: Shorter items have too few words to align: only a document of just their words is a copy.
LEAST_WORDS = 3
MATCH, MISMATCH, GAP = 2, -1, -1
#: A copy aligns with this share of the item's greatest score or more.
SCORE = 0.5
#: Bytes of items that tasks hold at once; more items go in further rounds.
MOST_ITEMS_MB = 32


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """Greatest local alignment score, and the words from and to (exclusive) where it lies."""

    def run(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
        steps = np.arange(len(b)) * -GAP
        row, best, end = np.zeros(len(b) + 1, dtype=np.int64), 0, 0
        for w in a:
            now = np.maximum(row[:-1] + np.where(b == w, MATCH, MISMATCH), row[1:] + GAP)
            np.maximum(now, 0, out=now)
            now = np.maximum.accumulate(now + steps) - steps  # gaps in the item
            at = int(np.argmax(now))
            if now[at] > best:
                best, end = int(now[at]), at + 1
            row[1:] = now
        return best, end

    if not len(item) or not len(words):
        return 0, 0, 0
    best, end = run(item, words)
    back = words[:end][::-1]
    return best, end - run(item[::-1], back)[1] if best else end, end


def pairs(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every two words that are next to each other or one apart, and where the first one is."""
    grams = [mix(words[: max(0, len(words) - k)] * PAIR + words[k:]) for k in APART]
    return np.concatenate(grams), np.concatenate([np.arange(len(g)) for g in grams])


@dataclass
class Items:
    """Test items and where each seed occurs in them."""

    ids: list[int]
    words: list[np.ndarray]
    seeds: np.ndarray
    first: np.ndarray
    item: np.ndarray
    at: np.ndarray
    short: dict[tuple[int, ...], list[int]]

    @classmethod
    def of(cls, ids: list[int], words: list[np.ndarray], counts: dict[int, int] | None = None, least: float = SCORE) -> Items:
        """``counts``: of pairs in the corpus; without it every pair is a seed.

        An alignment of M matches and X other steps scores 2 M - X. Of its M - 1
        pairs of successive matches those with two or more steps between them
        are X / 2 at most; the others have their words in both texts next to
        each other or one apart. So a score of ``least`` or more, 2 M - X >=
        2 least m for m words, has such pairs at M - 1 - X / 2 >= least m - 1
        places of the item. All but one of so many places may be without seeds,
        and the alignment still meets one: these are the most frequent places.
        """
        keys, items, ats = [], [], []
        for k, w in enumerate(words):
            grams, at = pairs(w) if len(w) >= LEAST_WORDS else pairs(w[:0])
            if counts is not None and len(grams):
                often = np.bincount(at, [counts.get(int(g), 0) for g in grams])
                spare = max(0, math.ceil(least * len(w) - 1 - 1e-6) - 1)
                kept = np.ones(len(often), dtype=bool)
                kept[np.argsort(-often, kind="stable")[:spare]] = False
                grams, at = grams[kept[at]], at[kept[at]]
            keys.append(grams)
            items.append(np.full(len(at), k))
            ats.append(at)
        key, item, at = (np.concatenate([np.empty(0, t), *x]) for t, x in ((np.uint64, keys), (np.int64, items), (np.int64, ats)))
        order = np.argsort(key, kind="stable")
        seeds, first = np.unique(key[order], return_index=True)
        short: dict[tuple[int, ...], list[int]] = {}
        for k, w in enumerate(words):
            if 0 < len(w) < LEAST_WORDS:
                short.setdefault(tuple(w.tolist()), []).append(k)
        return cls(ids, words, seeds, np.append(first, len(key)), item[order].astype(np.int64), at[order].astype(np.int64), short)

    def filter(self) -> np.ndarray:
        """A table by the low bits of a hash that tells most n-grams of a text from seeds."""
        bits = max(16, int(len(self.seeds) * 64).bit_length())
        table = np.zeros(1 << min(bits, 26), dtype=bool)
        table[self.seeds & np.uint64(len(table) - 1)] = True
        return table

    def hits(self, grams: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of ``grams`` that are seeds, and which."""
        if not len(self.seeds):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.flatnonzero(table[grams & np.uint64(len(table) - 1)])
        which = np.searchsorted(self.seeds, grams[at])
        which[which == len(self.seeds)] = 0
        same = self.seeds[which] == grams[at]
        return at[same], which[same]


def _hit_words(texts: list[str | None], items: Items, table: np.ndarray):
    """For a batch: word hashes, offsets of texts, and the hits that lie within one text."""
    found = hashed_words(texts)
    grams, starts = pairs(found.hashes)
    at, which = items.hits(grams, table)
    span = np.where(at < len(found.hashes) - 1, *APART)
    at = starts[at]
    doc = np.searchsorted(found.offsets, at, side="right") - 1
    inside = at + span < found.offsets[doc + 1]
    return found.hashes, found.offsets, at[inside], which[inside], doc[inside]


def corpus_counts(texts: DataFrame, items: Items) -> dict[int, int]:
    """How often each pair of the items occurs in all texts; as many rows as the items have."""
    sent = texts.sparkSession.sparkContext.broadcast(items)

    def of(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        table, counts = held.filter(), np.zeros(len(held.seeds), np.int64)
        for batch in sliced(chunks):
            all_texts = batch.column("text").to_pylist()
            for part in batches(all_texts):
                counts += np.bincount(_hit_words(all_texts[part], held, table)[3], minlength=len(counts))
        some = np.flatnonzero(counts)
        yield pa.record_batch({"seed": pa.array(held.seeds[some].view(np.int64)), "n": pa.array(counts[some])})

    rows = texts.select("text").mapInArrow(of, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).toArrow()
    return dict(zip(rows.column("seed").to_numpy().view(np.uint64).tolist(), rows.column("n").to_pylist(), strict=True))


FOUND = "doc_id long, item_id long, score double, from_word long, to_word long"


def matches_in(words: np.ndarray, item: np.ndarray, starts: np.ndarray, least: float) -> tuple[float, int, int] | None:
    """The best alignment of the item near where its seeds would have it start."""
    starts, m, best = np.unique(starts), len(item), None
    # As many words as an alignment of ``least`` can have between those of the item.
    slack = max(0, math.ceil(MATCH * m * (1 - least)))
    for group in np.split(starts, np.flatnonzero(np.diff(starts) > m) + 1):
        low, high = max(0, int(group[0]) - slack), min(len(words), int(group[-1]) + m + slack)
        # With fewer common words than this no alignment reaches the score.
        if np.count_nonzero(np.isin(item, words[low:high])) < least * m - 1e-6:
            continue
        got, start, end = align(item, words[low:high])
        score = got / (MATCH * m)
        if score >= least and (best is None or score > best[0]):
            best = score, low + start, low + end
    return best


def _find(texts: DataFrame, items: Items, least: float) -> DataFrame:
    sent = texts.sparkSession.sparkContext.broadcast(items)

    def of(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        table = held.filter()
        for batch in sliced(chunks):
            ids, all_texts, out = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), []
            for part in batches(all_texts):
                words, offsets, at, which, doc = _hit_words(all_texts[part], held, table)
                times = held.first[which + 1] - held.first[which]
                rows = np.repeat(held.first[which], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                doc, item, start = np.repeat(doc, times), held.item[rows], np.repeat(at, times) - held.at[rows]
                order = np.lexsort((item, doc))
                doc, item, start = doc[order], item[order], start[order]
                cuts = np.flatnonzero((np.diff(doc) != 0) | (np.diff(item) != 0)) + 1
                for a, b in zip([0, *cuts], [*cuts, len(doc)], strict=True):
                    if a == b:
                        continue
                    d, k = int(doc[a]), int(item[a])
                    one = matches_in(words[offsets[d] : offsets[d + 1]], held.words[k], start[a:b] - offsets[d], least)
                    if one:
                        out.append((ids[part.start + d], held.ids[k], *one))
                sizes = np.diff(offsets)
                for d in np.flatnonzero((sizes > 0) & (sizes < LEAST_WORDS)).tolist() if held.short else ():
                    for k in held.short.get(tuple(words[offsets[d] : offsets[d + 1]].tolist()), ()):
                        out.append((ids[part.start + d], held.ids[k], 1.0, 0, int(sizes[d])))
            yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "item_id", "score", "from_word", "to_word"), r, strict=True)) for r in out], schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("from_word", pa.int64()), ("to_word", pa.int64())])
    return texts.mapInArrow(of, FOUND)


def contaminated(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", least: float = SCORE, most_items_mb: float = MOST_ITEMS_MB) -> DataFrame:
    """doc_id, item_id, score, from_word, to_word: where a document holds a copy of an item.

    Words are lower-cased, punctuation parts them. Every pair of an item's
    words, next to each other or one apart, is counted over all texts; the seeds
    are those at the rarer places, as many as it takes for every alignment of
    ``least`` or more to meet one. A text with a seed is aligned with the item around it (match 2, mismatch and gap
    -1): score is the share of the greatest score that the item can have. One
    row a document row and item with a score of ``least`` or more, its best
    place; documents without a match give none. An item of one or two words
    matches a document that has just these words. Null texts match nothing, nor
    do items without an id or a word. Rows that repeat an id
    each give theirs; an item repeated with the same text is one item.

    Tasks hold the items, whose size is measured first: beyond
    ``most_items_mb`` they go in several rounds over the texts.
    """
    items = benchmark.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).cast("long").alias("id"), F.col(item_text).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rounds = max(1, int(-(-size // (most_items_mb * 1e6))))
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = None
    for k in range(rounds):
        part = items if rounds == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(rounds)) == k)
        rows = sorted({(r["id"], r["text"]) for r in part.collect()})
        found = hashed_words([t for _, t in rows])
        words = [found.hashes[a:b] for a, b in zip(found.offsets[:-1], found.offsets[1:], strict=True)]
        ids = [i for i, _ in rows]
        chosen = Items.of(ids, words, corpus_counts(texts, Items.of(ids, words)), least)
        one = _find(texts, chosen, least)
        if rounds > 1:  # one after another, so that the driver and the tasks hold the items of one
            one = materialise(one, f"round-{k}")
        out = one if out is None else out.unionByName(one)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no copy of an item, with all their columns."""
    row = spare_name(docs, "row")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    numbered = materialise(numbered, "numbered")
    found = contaminated(numbered, benchmark, doc_id=row, text=text, **options)
    return numbered.join(found.select(F.col("doc_id").alias(row)).distinct(), row, "left_anti").drop(row)
