import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from quadrill.llm import simhash
from quadrill.llm.components import components


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(pairs):
    """pairs: (doc_id, fingerprint)."""
    label = {f: f for _, f in pairs}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in combinations(sorted(label), 2):
        if (a ^ b).bit_count() <= 3:
            label[root(a)] = root(b)
    least = {}
    for d, f in pairs:
        r = root(f)
        least[r] = d if least.get(r) is None else least[r] if d is None else min(least[r], d)
    return sorted((str(d), f"{f:016x}", least[root(f)]) for d, f in pairs)


def got(df):
    return sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in df.collect())


def test_golay():
    g = simhash.golay()
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 3000).astype(np.int32)
    index = g.index(words)
    assert index.min() >= 0 and index.max() < 4096
    assert (np.bincount(g.index(np.arange(1 << 23, dtype=np.int32))) == [2048] * 4096).all()
    near = g.near(words, 23)
    assert (near >= 0).sum(1).max() == 6
    for bit in range(23):
        assert (near == g.index(words ^ (1 << bit))[:, None]).any(1).all()


def test_keys_meet_whatever_three_bits_differ():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 400, dtype=np.int64) * 2 + 1
    b = a.copy()
    for k in range(len(a)):
        for bit in rng.choice(64, k % 4, replace=False):
            b[k] ^= np.int64(np.uint64(1 << int(bit)).astype(np.int64))

    def side(fps, s):
        key, of, row = simhash.keys(fps)
        out = [set() for _ in fps]
        for x, o, r in zip(key, of, row, strict=True):
            if o == s:
                out[r].add(int(x))
        return out

    assert all(x & y for x, y in zip(side(a, 0), side(b, 1), strict=True))


def test_components(spark):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(100, 160)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(250)] + [(5, 2000 + k) for k in range(50)] + [(7, 7)]
    out = {(r.node, r.root) for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    label = {x: x for e in edges for x in e}
    for _ in range(100):
        for u, v in edges:
            label[u] = label[v] = min(label[u], label[v])
    assert out == {(n, r) for n, r in label.items() if n != 7}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


@pytest.mark.parametrize("block", [8, 4096])
def test_links_of_near_groups(spark, block):
    rng = random.Random(4)
    fps = set()
    for _ in range(6):
        center = rng.getrandbits(64)
        for _ in range(60):
            x = center
            for _ in range(rng.randrange(0, 5)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(300)}
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    found = components(simhash.links(spark.createDataFrame(signed, "fp long"), block)).collect()
    root = {r.node & (2**64 - 1): r.root & (2**64 - 1) for r in found}
    want = slow_components([(k, x) for k, x in enumerate(sorted(fps))])
    number = {x: k for k, x in enumerate(sorted(fps))}
    groups = {}
    for x in fps:
        groups.setdefault(root.get(x, x), []).append(number[x])
    assert sorted(sorted(g) for g in groups.values()) == sorted(sorted(int(d) for d, _, c in want if c == one) for one in {c for *_, c in want})


def test_odd_rows(spark):
    long = " ".join(random.Random(6).choice(["aa", "Bb", "cÉ", "d"]) + str(k % 997) for k in range(70000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "one two"), (7, long), (8, long + " more"), (8, long), (None, "one"), (None, "alone here now"), (9, "É é  x")]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, fp int, u int")
    assert got(simhash.near_duplicates(df)) == slow_components([(i, slow_fingerprint(t)) for i, t in rows])
    assert simhash.near_duplicates(df.limit(0)).collect() == []


def test_query(spark):
    from quadrill.llm.queries import op5_simhash_near_dedup

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    want = slow_components([(r.doc_id, simhash.fingerprint(r.text)) for r in docs])
    assert got(op5_simhash_near_dedup(spark, "/root/testdata/sf0.01")) == want
    assert all(simhash.fingerprint(r.text) == slow_fingerprint(r.text) for r in docs[::40])
