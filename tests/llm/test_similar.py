import random

import numpy as np
import pytest

from quadrill.llm import similar


def shingle_set(text, n=5):
    words = "".join(c if c.isalnum() or ord(c) > 127 else " " for c in (text or "").lower()).split()
    return frozenset(tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))) if words else frozenset()


def share(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def groups(rows, similarity=0.8):
    """The least (id, place) of every group, by all pairs."""
    sets, root = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if share(sets[a], sets[b]) >= similarity:
                root[find(a)] = find(b)
    best = {}
    for k, (one, _) in enumerate(rows):
        g, key = find(k), (one is None, one or 0, k)
        best[g] = min(best.get(g, key), key)
    return {key[2] for key in best.values()}


def corpus(rng, n, edits):
    def text(size):
        return ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4))) for _ in range(size)]

    rows = []
    for _ in range(n):
        words = text(rng.randrange(30, 300))
        rows.append(" ".join(words))
        for _ in range(rng.randrange(0, 3)):
            again = list(words)
            for _ in range(max(1, int(len(words) * rng.choice(edits)))):
                again[rng.randrange(len(again))] = text(1)[0]
            rows.append(rng.choice([" ", "\n", ", "]).join(again).capitalize())
    rng.shuffle(rows)
    return list(enumerate(rows))


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, k, "a", 1, 0) for k, r in enumerate(rows)], "doc_id long, text string, place int, row string, node long, w0 int").coalesce(3)
    out = similar.keep_one(df, **options)
    assert out.columns == df.columns
    return {r.place for r in out.collect()}


def test_against_all_pairs(spark):
    rows = corpus(random.Random(4), 150, [0.0, 0.004, 0.01, 0.02, 0.2])
    want = groups(rows)
    got = run(spark, rows)
    assert got >= want and len(got - want) <= 2 and len(want) < len(rows) - 40


def test_recall_at_the_threshold():
    """Of texts that are 0.8 to 0.85 alike 0.95 or more share a key and pass the first filter."""
    rng, most, met, n = np.random.default_rng(3), similar.bounds(0.8, 64 * similar.FIRST)[1], 0, 400
    for _ in range(n):
        words = [f"w{x}" for x in rng.integers(0, 10**6, 400)]
        other = [w if k % 46 else w + "x" for k, w in enumerate(words)]
        assert 0.79 < share(shingle_set(" ".join(words)), shingle_set(" ".join(other))) < 0.83
        fps = similar.fingerprints([" ".join(words), " ".join(other)])
        key, row = similar.keys(fps)
        met += bool(np.intersect1d(key[row == 0], key[row == 1]).size) and int(np.bitwise_count(fps[0, : similar.FIRST] ^ fps[1, : similar.FIRST]).sum()) <= most
    assert met >= 0.95 * n


@pytest.mark.parametrize("few", [2, 32])
def test_no_link_is_left_out(spark, monkeypatch, few):
    """Texts of few and many shingles at the threshold itself, and chains of them."""
    monkeypatch.setattr(similar, "FEW", few)
    monkeypatch.setattr(similar, "PILOT", 2)
    monkeypatch.setattr(similar, "HEAVY", 16)
    rng, rows = random.Random(12), []
    for size in [8, 9, 13, 22, 40, 49, 94, 184, 364] * 24:
        words = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        rows.append(" ".join(words))
        for _ in range(2):  # of n shingles one in nine is new, at the end
            words = words[(size - 4) // 9 :] + [f"w{rng.randrange(10**6)}" for _ in range((size - 4) // 9)]
            rows.append(" ".join(words))
    words = [f"c{k}" for k in range(60)]
    rows += [" ".join([*words, *(f"t{k}x{i}" for i in range(n))]) for k in range(40) for n in (5, 14, 60)]
    rows = list(enumerate(rows))
    assert run(spark, rows) == groups(rows)


def test_odd_rows(spark):
    rows = [(5, None), (3, ""), (4, " \n"), (None, "..."), (7, "one two"), (7, "One  TWO!"), (6, "one two three"), (None, "x y z"), (1, "word " * 50000), (2, "word " * 40000), (8, "x y z")]
    assert run(spark, rows) == groups(rows) == {1, 4, 6, 8, 10}
    assert run(spark, []) == set()


@pytest.mark.parametrize("few", [2, 32])
def test_one_large_group_of_near_copies(spark, monkeypatch, few):
    monkeypatch.setattr(similar, "FEW", few)
    monkeypatch.setattr(similar, "BLOCK", 16)
    monkeypatch.setattr(similar, "PILOT", 1)
    monkeypatch.setattr(similar, "HEAVY", 40)
    rng = random.Random(8)
    words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows = corpus(rng, 60, [0.2])
    for k in range(250):
        again = list(words)
        again[rng.randrange(300)] = f"v{k}"
        rows.append((1000 + k, " ".join(again)))
    got, want = run(spark, rows), groups(rows)
    assert got == want and sum(k >= len(rows) - 250 for k in got) == 1


def test_jaccard_and_bounds():
    a, b = ["a b c d e f", None, "x", "same words here"], ["a b c d e g", "", "y", "Same, words - here"]
    assert similar.jaccard(a, b).tolist() == [pytest.approx(1 / 3), 1.0, 0.0, 1.0]
    low, high = similar.bounds(0.8, 384)
    assert 0 < low < 58 < high < 120


def test_tree_joins_what_is_near():
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 2**63, 5, dtype=np.uint64)
    words = np.array([[c ^ np.uint64(1 << int(rng.integers(0, 60))), c] for c in centres for _ in range(40)]).T
    u, v, roots = similar._tree(words, 6)
    assert len(roots) == 5 and len(u) == 195 and (similar._apart(words, u, v) <= 2).all()
