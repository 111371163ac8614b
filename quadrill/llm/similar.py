"""Near-duplicate documents by word shingles: wide SimHash, Golay keys of segments, exact Jaccard similarity.

SimHash joins what is very near. What it may miss at the threshold is found by
a second join that misses nothing: two sets of so much in common share one of
their first shingles in any one order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrill.llm.components import components
from quadrill.llm.simhash import golay
from quadrill.llm.store import bucketed, materialise, shuffle_parts
from quadrill.llm.words import batches, hashed_words, mix, ngrams, sliced

#: Words of a shingle, and the least share of shingles that near-duplicates have in common.
WORDS, SIMILARITY = 5, 0.8
#: A fingerprint is so many words of 64 bits; its first 16 * 23 bits are the segments, two a key.
WIDTH, SEGMENT, TABLES = 6, 23, 8
#: Tables that are looked at: near copies nearly always meet in one, and the rest is left to the exact join.
USED_TABLES = 2
#: The most codewords near a segment: its own, or its own and five others.
NEAR = 6
#: Standard deviations beyond which a distance of fingerprints settles what the similarity is.
SURE = 5.0
#: In the exact join more of them, and texts of fewer shingles are always compared.
CERTAIN, SHORT = 8.0, 64
#: Words of a fingerprint that go with a key, for a first comparison.
FIRST = 2
#: Up to FEW fingerprints of a key are compared pair by pair; more are joined by nearest links, BLOCK at a time.
FEW, BLOCK = 32, 2048
#: One fingerprint in PILOT shows which keys are frequent, and more than HEAVY rows of one are dealt out.
PILOT, HEAVY = 64, 4096
#: A shingle in so many texts of the pilot is a common one; at most MOST_COMMON are known as such.
COMMON, MOST_COMMON = 3, 100_000


def shingles(texts: list[str | None], words_a_shingle: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the shingles of each text, and the text of each; fewer words are one shingle, none is none."""
    found = hashed_words(texts)
    n_words = np.diff(found.offsets)
    grams = ngrams(found.hashes, words_a_shingle)
    text = np.repeat(np.arange(len(texts)), n_words)
    whole = text[: len(grams)] == text[len(found.hashes) - len(grams) :]
    hashes, of = [grams[whole]], [text[: len(grams)][whole]]
    for k in np.flatnonzero((n_words > 0) & (n_words < words_a_shingle)).tolist():
        hashes.append(ngrams(found.hashes[found.offsets[k] : found.offsets[k + 1]], int(n_words[k])))
        of.append(np.array([k]))
    h, t = np.concatenate(hashes), np.concatenate(of)
    order = np.lexsort((h, t))
    h, t = h[order], t[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    return h[new], t[new]


def fingerprints(texts: list[str | None], words_a_shingle: int = WORDS) -> np.ndarray:
    """``WIDTH`` words of 64 bits a text: a bit is set if over half of the distinct shingles set it; zeros for no words."""
    return described(texts, words_a_shingle)[:, :WIDTH]


def described(texts: list[str | None], words_a_shingle: int = WORDS) -> np.ndarray:
    """Of each text its fingerprint, 128 bits that tell sets of shingles apart, and the number of distinct shingles."""
    h, of = shingles(texts, words_a_shingle)
    out = np.zeros((len(texts), WIDTH + 3), dtype=np.uint64)
    if len(h):
        first = np.flatnonzero(np.diff(of, prepend=-1))
        n = np.diff([*first, len(of)])
        for k in range(WIDTH):
            bits = np.unpackbits(mix(h + np.uint64(0x9E3779B97F4A7C15 * (k + 1) % 2**64)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            votes = np.add.reduceat(bits, first, axis=0, dtype=np.int64)
            out[of[first], k] = np.packbits(2 * votes > n[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
        for k in (WIDTH, WIDTH + 1):
            out[of[first], k] = np.add.reduceat(mix(h + np.uint64(0x9E3779B97F4A7C15 * (k + 1) % 2**64)), first)
        out[of[first], WIDTH + 2] = n
    return out


def keys(fps: np.ndarray, tables: int = TABLES) -> tuple[np.ndarray, np.ndarray]:
    """Key and row of each fingerprint's keys.

    A segment goes to the index of its codeword and of those that it reaches
    with one more error; two segments that differ in two bits or fewer always
    have one in common, and often with more. A key is (table, a codeword near
    its first segment, one near its second): similar texts need a codeword in
    common in both segments of one of the (eight) tables.
    """
    bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(len(fps), -1), axis=1, bitorder="little")[:, : 2 * tables * SEGMENT]
    weights = 1 << np.arange(SEGMENT, dtype=np.int32)
    segments = (bits.reshape(len(fps), 2 * tables, SEGMENT).astype(np.int32) * weights).sum(axis=2).astype(np.int32)
    near = np.sort(golay().near(segments.reshape(-1), SEGMENT), axis=1)[:, : -NEAR - 1 : -1].reshape(len(fps), tables, 2, NEAR)
    a, b = near[:, :, 0, :, None].astype(np.int64), near[:, :, 1, None, :].astype(np.int64)
    key = (np.arange(tables)[None, :, None, None] << 24) | (a << 12) | b
    row, *rest = np.nonzero((a >= 0) & (b >= 0))
    return key[(row, *rest)], row


def _share(similarity: float) -> float:
    """The share of bits in which fingerprints of this similarity differ; sets of unlike sizes differ in fewer."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def bounds(similarity: float, bits: int, sure: float = SURE) -> tuple[int, int]:
    """Up to the first distance texts are surely this similar; beyond the second surely not."""
    p = _share(similarity)
    spread = sure * math.sqrt(bits * p * (1 - p))
    return max(0, math.floor(bits * p - spread)), math.ceil(bits * p + spread)


def _apart(words: np.ndarray, a, b) -> np.ndarray:
    """Bits in which the fingerprints ``a`` and ``b`` of the columns of ``words`` differ."""
    return np.bitwise_count(words[:, a] ^ words[:, b]).sum(axis=0, dtype=np.uint8)


def _tree(words: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links between columns at most ``most`` bits apart that join all such columns, nearest first, and one of each tree."""
    n = words.shape[1]
    far = np.full(n, 255, dtype=np.uint8)
    parent, done = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
    us, vs, roots, at = [], [], [], 0
    for _ in range(n):
        if far[at] <= most:
            us.append(parent[at])
            vs.append(at)
        else:
            roots.append(at)
        done[at] = True
        d = _apart(words, slice(None), slice(at, at + 1))
        closer = (d < far) & ~done
        far[closer], parent[closer] = d[closer], at
        far[done] = 255
        at = int(np.argmin(far)) if far.min() < 255 else int(np.argmin(done))
    return np.array(us, dtype=np.int64), np.array(vs, dtype=np.int64), np.array(roots, dtype=np.int64)


def _near(of: np.ndarray, words: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of columns of one group (groups follow each other) at most ``most`` bits apart."""
    us, vs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for step in range(1, len(of)):
        same = np.flatnonzero(of[step:] == of[:-step])
        if not len(same):
            break
        near = same[_apart(words, same, same + step) <= most]
        us.append(near)
        vs.append(near + step)
    return np.concatenate(us), np.concatenate(vs)


PARTS = [f"p{k}" for k in range(FIRST)]
FOUND = ", ".join(["u long, v long, key int", *(f"{x} long" for x in PARTS)])


def _compared(keyed: DataFrame, most: int) -> DataFrame:
    """Links (u, v) within each group of rows with one (key, deal), which follow each other.

    Where ``deals`` is above 0 a group is part of a key: a row of each of its
    trees comes too, as (node, node, key, its words). What is held is a batch and the
    trees of one group.
    """
    columns = ["key", "deal", "deals", "node", *PARTS]

    def of(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((len(columns), 0), dtype=np.int64)

        def rows(new: np.ndarray, ended: bool) -> tuple[np.ndarray, list, list]:
            """Links and trees of all groups but the last, which goes on unless ``ended``."""
            turn = np.ones(new.shape[1], dtype=bool)
            turn[1:] = (new[0, 1:] != new[0, :-1]) | (new[1, 1:] != new[1, :-1])
            starts = np.append(np.flatnonzero(turn), new.shape[1])
            sizes, words = np.diff(starts), np.ascontiguousarray(new[4:]).view(np.uint64)
            whole = np.ones(len(sizes), dtype=bool)
            whole[-1:] = ended
            few = whole & (sizes <= FEW) & ((new[2, starts[:-1]] == 0) if len(sizes) else True)
            some = np.flatnonzero(np.repeat(few & (sizes > 1), sizes))
            u, v = _near(np.repeat(np.arange(len(sizes)), sizes)[some], words[:, some], most)
            links, trees, left = [(new[3, some[u]], new[3, some[v]])], [], new[:, :0]
            for k in np.flatnonzero(~few).tolist():
                own = new[:, starts[k] : starts[k + 1]]
                if whole[k] or own.shape[1] >= BLOCK:
                    u, v, roots = _tree(words[:, starts[k] : starts[k + 1]], most)
                    links.append((own[3, u], own[3, v]))
                    own = own[:, roots]
                if not whole[k]:
                    left = own
                elif own[2, 0]:
                    trees.append(own)
            return left, links, trees

        for batch in chunks:
            for at in range(0, batch.num_rows, 4 * BLOCK):
                part = batch.slice(at, 4 * BLOCK)
                new = np.stack([part.column(c).to_numpy().astype(np.int64) for c in columns])
                held, links, trees = rows(np.concatenate([held, new], axis=1), False)
                yield _out(links, trees)
        yield _out(*rows(held, True)[1:])

    def _out(links: list, trees: list) -> pa.RecordBatch:
        u, v = (np.concatenate([x[k] for x in links]) for k in (0, 1))
        pairs = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)]), axis=1)
        tree = np.concatenate([np.empty((len(columns), 0), np.int64), *trees], axis=1)
        link = np.arange(pairs.shape[1] + tree.shape[1]) < pairs.shape[1]
        empty = np.zeros(pairs.shape[1], dtype=np.int64)
        both = lambda a, k: np.concatenate([a, tree[k]])
        return pa.record_batch(
            {
                "u": pa.array(both(pairs[0], 3)),
                "v": pa.array(both(pairs[1], 3)),
                "key": pa.array(both(empty, 0).astype(np.int32), mask=link),
            }
            | {x: pa.array(both(empty, 4 + k), mask=link) for k, x in enumerate(PARTS)}
        )

    return keyed.select(*columns).mapInArrow(of, FOUND)


def candidates(nodes: DataFrame, similarity: float) -> DataFrame:
    """(u, v): distinct pairs of nodes that meet in a key and whose first words are near enough."""

    def keyed(some: DataFrame) -> DataFrame:
        def of(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(chunks, 512):
                fps = np.stack([batch.column(f"w{k}").to_numpy() for k in range(WIDTH)], axis=1)
                key, row = keys(fps, USED_TABLES)
                yield pa.record_batch({"key": pa.array(key.astype(np.int32)), "node": pa.array(batch.column("node").to_numpy()[row])} | {x: pa.array(fps[row, k]) for k, x in enumerate(PARTS)})

        return some.mapInArrow(of, ", ".join(["key int, node long", *(f"{x} long" for x in PARTS)]))

    spark, most = nodes.sparkSession, bounds(similarity, 64 * FIRST)[1]
    rows, parts = keyed(nodes), shuffle_parts(spark)
    pilot = keyed(nodes.where(F.pmod(F.xxhash64("node"), F.lit(PILOT)) == 0))
    heavy = pilot.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") * PILOT >= HEAVY)
    heavy = materialise(heavy.select("key", F.ceil(F.col("n") * PILOT / HEAVY).cast("int").alias("deals")), "heavy-keys")
    whole = {"deal": F.lit(0), "deals": F.lit(0)}

    def compared(some: DataFrame) -> DataFrame:
        return _compared(some.repartition(parts, "key", "deal").sortWithinPartitions("key", "deal"), most)

    if not heavy.take(1):
        return compared(rows.withColumns(whole)).select("u", "v").distinct()
    dealt = rows.join(heavy, "key", "left").withColumn("deals", F.coalesce("deals", F.lit(0)))
    dealt = dealt.withColumn("deal", F.when(F.col("deals") > 0, F.pmod(F.xxhash64("node"), F.col("deals"))).otherwise(0).cast("int"))
    first = materialise(compared(dealt), "dealt-links")
    # What the deals of a frequent key have in common shows between one row of each of their trees.
    trees = first.where("key IS NOT NULL").select("key", F.col("u").alias("node"), *PARTS)
    return first.where("key IS NULL").select("u", "v").unionByName(compared(trees.withColumns(whole)).select("u", "v")).distinct()


def jaccard(a: list[str | None], b: list[str | None], words_a_shingle: int = WORDS) -> np.ndarray:
    """The share of distinct shingles that each two texts have in common; 1 for two without words."""
    n = len(a)
    h, of = shingles([*a, *b], words_a_shingle)
    sizes = np.bincount(of, minlength=2 * n)
    order = np.lexsort((h, of % n))
    pair, hashes = (of % n)[order], h[order]
    both = np.bincount(pair[1:][(pair[1:] == pair[:-1]) & (hashes[1:] == hashes[:-1])], minlength=n)
    union = sizes[:n] + sizes[n:] - both
    return np.where(union > 0, both / np.maximum(union, 1), 1.0)


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, words_a_shingle: int, similarity: float, sure: float = SURE, short: int = 0) -> DataFrame:
    """The pairs of at least this similarity: by their fingerprints where these settle it, else by their texts.

    Texts of fewer than ``short`` shingles are compared whatever their fingerprints are.
    """
    low, high = bounds(similarity, 64 * WIDTH, sure)
    for side in ("u", "v"):
        pairs = pairs.join(nodes.select(F.col("node").alias(side), F.array(*(f"w{k}" for k in range(WIDTH))).alias(f"fp_{side}"), F.col("size").alias(f"n_{side}")), side)
    bits: Column = sum((F.bit_count(F.col("fp_u")[k].bitwiseXOR(F.col("fp_v")[k])) for k in range(WIDTH)), F.lit(0))
    some = pairs.select("u", "v", bits.alias("bits"), F.least("n_u", "n_v").alias("n"))
    near = materialise(some.where((F.col("bits") <= high) | (F.col("n") < short)).drop("n"), "near-pairs")
    open_pairs = near.where(F.col("bits") > low).select("u", "v")
    for side in ("u", "v"):
        text = texts.select("row", F.col("text").alias(f"text_{side}"))
        open_pairs = open_pairs.hint("shuffle_hash").join(text, F.col(side) == F.col("row")).drop("row")

    def exact(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(chunks, 256):
            a, b, keep = batch.column("text_u").to_pylist(), batch.column("text_v").to_pylist(), []
            for part in batches([(x or "") + (y or "") for x, y in zip(a, b, strict=True)]):
                keep += (jaccard(a[part], b[part], words_a_shingle) >= similarity - 1e-12).tolist()
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    checked = open_pairs.select("u", "v", "text_u", "text_v").mapInArrow(exact, "u long, v long")
    return near.where(F.col("bits") <= low).select("u", "v").unionByName(checked)


def prefixes(texts: list[str | None], similarity: float, common: tuple[np.ndarray, np.ndarray], words_a_shingle: int = WORDS) -> tuple[np.ndarray, ...]:
    """The first shingles of each text, common ones last: hash, text, place, number of the text's shingles, how common.

    Of n shingles so many come first that fewer than the least number in common
    are left: texts of this similarity share one of them. ``common`` has sorted
    hashes and their counts; what else is in it changes no result.
    """
    h, of = shingles(texts, words_a_shingle)
    known, counts = common
    c = np.zeros(len(h), dtype=np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        c = np.where(known[at] == h, counts[at], 0)
    order = np.lexsort((h, c, of))
    h, of, c = h[order], of[order], c[order]
    n = np.bincount(of, minlength=len(texts)).astype(np.int64)
    place = np.arange(len(h)) - (np.cumsum(n) - n)[of]
    first = place < (n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1)[of]
    return h[first], of[first], place[first], n[of[first]], c[first]


def _common(texts: DataFrame, words_a_shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, in order, and counts of the shingles that are in several texts of the pilot."""

    def of(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(chunks):
            all_texts = batch.column("text").to_pylist()
            for part in batches(all_texts):
                yield pa.record_batch([pa.array(shingles(all_texts[part], words_a_shingle)[0].view(np.int64))], names=["h"])

    pilot = texts.where(F.pmod(F.xxhash64("row"), F.lit(PILOT)) == 0).select("text").mapInArrow(of, "h long")
    found = pilot.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON).orderBy(F.desc("n"), "h").limit(MOST_COMMON).toArrow()
    h, n = found["h"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


POSTINGS = ["key", "root", "node", "size", "place"]


def _postings(some: DataFrame, similarity: float, common: tuple[np.ndarray, np.ndarray], words_a_shingle: int) -> DataFrame:
    """A row for each of the first shingles of (node, root, text).

    A very common shingle's nodes are dealt into blocks and go to a key for
    every pair of their block and another: no key has all of them.
    """

    def of(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(chunks):
            all_texts = batch.column("text").to_pylist()
            nodes, roots = batch.column("node").to_numpy(), batch.column("root").to_numpy()
            for part in batches(all_texts):
                h, text, place, n, c = prefixes(all_texts[part], similarity, common, words_a_shingle)
                blocks = np.maximum(1, -(-c * PILOT // HEAVY))
                row = np.repeat(np.arange(len(h)), blocks)
                other = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                node = nodes[part][text[row]]
                own = (mix(node.astype(np.uint64)) % blocks[row].astype(np.uint64)).astype(np.int64)
                pair = (np.minimum(own, other) << 24) + np.maximum(own, other)
                key = mix(h[row] + mix(pair.astype(np.uint64) + np.uint64(1))).view(np.int64).astype(np.int32)
                yield pa.record_batch([pa.array(key), pa.array(roots[part][text[row]]), pa.array(node), pa.array(n[row].astype(np.int32)), pa.array(place[row].astype(np.int32))], names=POSTINGS)

    return some.select("node", "root", "text").mapInArrow(of, "key int, root long, node long, size int, place int")


def _crossing(rows: np.ndarray, similarity: float) -> Iterator[np.ndarray]:
    """Pairs of nodes of one key and different roots that can be as similar, from whole keys in order.

    If a pair's first shingle in common is at these places, so many can follow
    at most; a pair is found where that is enough.
    """

    def able(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        (_, root, _, n, at), (_, roots, _, m, place) = a, b
        need = np.ceil(similarity / (1 + similarity) * (n + m) - 1e-9)
        return (root != roots) & (np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-9) & (np.minimum(n - at, m - place) >= need)

    if not rows.shape[1]:
        return
    starts = np.flatnonzero(np.diff(rows[0], prepend=rows[0, 0] - 1))
    sizes = np.diff([*starts, rows.shape[1]])
    mixed = np.minimum.reduceat(rows[1], starts) != np.maximum.reduceat(rows[1], starts)
    some = rows[:, np.repeat(mixed & (sizes <= FEW), sizes)]
    for step in range(1, some.shape[1]):
        same = np.flatnonzero(some[0, step:] == some[0, :-step])
        if not len(same):
            break
        same = same[able(some[:, same], some[:, same + step])]
        yield some[2][np.stack([same, same + step])]
    for k in np.flatnonzero(mixed & (sizes > FEW)).tolist():
        own = rows[:, starts[k] : starts[k] + sizes[k]]
        own = own[:, np.argsort(own[1], kind="stable")]
        ends = np.searchsorted(own[1], own[1], side="right")
        for i in range(own.shape[1]):
            after = own[:, ends[i] :]
            found = after[2, able(own[:, i : i + 1], after)]
            yield np.stack([np.full(len(found), own[2, i]), found])


def exact_candidates(nodes: DataFrame, texts: DataFrame, roots: DataFrame, similarity: float, words_a_shingle: int = WORDS) -> DataFrame:
    """(u, v): pairs of nodes under different roots, among them all of this similarity.

    ``roots`` (node, root) are of nodes that are linked already: of a large
    group of near copies no pairs are made, only those with other texts.
    """
    spark = nodes.sparkSession
    rooted = nodes.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    some = texts.join(rooted.hint("shuffle_hash"), F.col("row") == F.col("node")).select("node", "root", "text")
    postings = _postings(some, similarity, _common(texts, words_a_shingle), words_a_shingle)

    def of(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(pairs: list[np.ndarray]) -> pa.RecordBatch:
            both = np.concatenate([np.empty((2, 0), np.int64), *pairs], axis=1)
            both = np.unique(np.sort(both, axis=0), axis=1)
            return pa.record_batch([pa.array(both[0]), pa.array(both[1])], names=["u", "v"])

        def compared(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            held, n = [], 0
            for pairs in _crossing(np.concatenate([np.empty((len(POSTINGS), 0), np.int64), *parts], axis=1), similarity):
                held.append(pairs)
                n += pairs.shape[1]
                if n > 100_000:
                    yield out(held)
                    held, n = [], 0
            yield out(held)

        left: list[np.ndarray] = []  # rows of the last key, which may go on
        for batch in chunks:
            if not batch.num_rows:
                continue
            new = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in POSTINGS])
            last = int(np.searchsorted(new[0], new[0, -1]))
            if last or (left and left[0][0, 0] != new[0, 0]):
                yield from compared([*left, new[:, :last]])
                left = []
            left.append(new[:, last:])
        yield from compared(left)

    by_key = postings.repartition(shuffle_parts(spark), "key").sortWithinPartitions("key")
    return by_key.select(*POSTINGS).mapInArrow(of, "u long, v long").distinct()


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words_a_shingle: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` less all but one of each group of near-duplicates, with all their columns.

    Two texts are linked if they have ``similarity`` of their distinct shingles
    of five words in common (Jaccard); a group is what links reach. Words are
    lower-cased, punctuation parts them; a text of fewer words is one shingle,
    null and empty texts are alike. Texts that share a Golay key (see ``keys``)
    are compared first, which joins near copies; then all others that can be as
    similar (see ``exact_candidates``), so that no link is left out.

    Every row is a document of its own, whether it repeats an id or has none.
    The row with a group's smallest id stays (of rows that repeat it, or where
    no row has one, the first). An empty table gives no rows. Rows of equal
    sets of shingles meet in one node before any join. A key with very many nodes is
    dealt out, and nodes beyond ``FEW`` are joined by nearest links, not by all
    pairs: no group meets in one task or grows by its square.
    """
    names, fields = docs.columns, [*(f"w{k}" for k in range(WIDTH)), "d0", "d1", "size"]
    plain = docs.toDF(*(f"c{k}" for k in range(len(names))))
    numbered = bucketed(plain.withColumn("row", F.monotonically_increasing_id()), "row", "numbered")
    texts = numbered.select("row", F.col(f"c{names.index(text)}").alias("text"), F.col(f"c{names.index(doc_id)}").alias("id"))

    def of(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(chunks):
            all_texts, found = batch.column("text").to_pylist(), []
            for part in batches(all_texts):
                found.append(described(all_texts[part], words_a_shingle).view(np.int64))
            fps = np.concatenate([np.empty((0, len(fields)), np.int64), *found])
            yield pa.record_batch([batch.column("row"), *(pa.array(fps[:, k]) for k in range(len(fields)))], names=["row", *fields])

    fps = materialise(texts.select("row", "text").mapInArrow(of, ", ".join(["row long", *(f"{x} long" for x in fields)])), "fingerprints")
    nodes = materialise(fps.groupBy(*fields).agg(F.min("row").alias("node")), "nodes").repartition(shuffle_parts(docs.sparkSession))
    near = components(_verified(materialise(candidates(nodes, similarity), "candidates"), nodes, texts, words_a_shingle, similarity))
    near = materialise(near.where("node <> root"), "near-copies")
    more = materialise(exact_candidates(nodes, texts, near, similarity, words_a_shingle), "exact-candidates")
    more = _verified(more, nodes, texts, words_a_shingle, similarity, CERTAIN, SHORT)
    linked = components(near.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more))

    # The best row of each node, then of each group of nodes; few nodes have links.
    best = fps.join(texts.select("row", "id"), "row").groupBy(*fields).agg(F.min("row").alias("node"), F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("best"))
    stay = best.join(linked, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("best").alias("best")).select(F.col("best.row").alias("row"))
    return numbered.join(stay.hint("shuffle_hash"), "row", "left_semi").drop("row").toDF(*names)
