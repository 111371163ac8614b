import random

import numpy as np
import pytest

from quadrill.llm import decontaminate as d
from quadrill.llm.words import batches, hashed_words, ngrams


def slow_align(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_align():
    rng = random.Random(1)
    for _ in range(200):
        a = [rng.randrange(6) for _ in range(rng.randrange(0, 12))]
        b = [rng.randrange(6) for _ in range(rng.randrange(0, 20))]
        score, start, end = d.align(np.array(a, np.uint64), np.array(b, np.uint64))
        assert score == slow_align(a, b)
        assert slow_align(a, b[start:end]) == score and (score == 0 or b[start] in a and b[end - 1] in a)


def test_hashed_words():
    texts = ["One, two!\nthree", None, "", "  ", "É été one", "日本 x-ray " * 5, "ONE two three"]
    b = hashed_words(texts)
    words = [b.hashes[i:j].tolist() for i, j in zip(b.offsets[:-1], b.offsets[1:], strict=True)]
    assert [len(w) for w in words] == [3, 0, 0, 0, 3, 15, 3] and words[0] == words[6] and words[4][2] == words[0][0] and words[4][0] != words[4][1]
    assert len(ngrams(b.hashes[:2], 3)) == 0 and ngrams(b.hashes[:3], 3)[0] == ngrams(b.hashes[-3:], 3)[0]
    assert [len(texts[s]) for s in batches(texts, 10)] and sum(s.stop - s.start for s in batches(texts, 10)) == 7


def text_of(rng, n):
    return " ".join("".join(rng.choice("bcdfgh") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4))) for _ in range(n))


def edited(rng, text, share):
    return " ".join(w if rng.random() > share else text_of(rng, 1) for w in text.split())


def brute(docs, items, least):
    out = set()
    for i, t in docs:
        words = hashed_words([t]).hashes
        for k, x in {(k, x) for k, x in items if k is not None and x is not None}:
            item = hashed_words([x]).hashes
            if len(item) >= 3:
                score = d.align(item, words)[0] / (2 * len(item))
                if score >= least:
                    out.add((i, k))
    return out


@pytest.mark.parametrize("mb", [32, 0.0003])
def test_against_brute_force(spark, mb):
    rng = random.Random(2)
    items = [(k, text_of(rng, rng.randrange(3, 60))) for k in range(30)] + [(None, text_of(rng, 20)), (40, None), (41, "two words"), (0, text_of(rng, 30)), (42, "")]
    docs = [(k, text_of(rng, rng.randrange(0, 300))) for k in range(60)]
    for k in range(60, 110):
        item = items[k % 30][1]
        docs.append((k, f"{text_of(rng, 50)} {edited(rng, item, (k % 3) * 0.1).upper() if k % 2 else item.replace(' ', ', ')} {text_of(rng, k)}"))
    docs += [(110, None), (111, ""), (60, docs[60][1]), (None, items[3][1]), (112, text_of(rng, 30000) + " " + items[5][1])]
    df = spark.createDataFrame([(*r, 1, 2.0) for r in docs], "doc_id long, text string, item_id int, score double")
    bench = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc_id string")
    got = d.contaminated(df, bench, most_items_mb=mb).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute(docs, items, d.SCORE)
    clean = d.decontaminate(df, bench)
    assert clean.columns == df.columns
    dirty = {i for i, _ in brute(docs, items, d.SCORE)}
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(i) for i, _ in docs if i not in dirty)


def test_edited_copies(spark):
    rng = random.Random(7)
    items = [(k, text_of(rng, 40)) for k in range(20)]
    docs = [(k, f"{text_of(rng, 30)} {edited(rng, items[k % 20][1], 0.1 + 0.05 * (k % 5))} {text_of(rng, 30)}") for k in range(100)]
    docs += [(100 + k, items[k % 20][1]) for k in range(60)]
    words = items[0][1].split()
    docs += [(900, " ".join("zz" if n % 3 == 2 else w for n, w in enumerate(words))), (901, " zz ".join(words))]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items, d.SCORE)
    assert {(r.doc_id, r.item_id) for r in d.contaminated(df, bench).collect()} == want and {(900, 0), (901, 0)} <= want


def test_short_items_are_whole_documents(spark):
    items = [(1, "two words"), (2, "One."), (3, "three short words"), (4, "?!"), (5, "two words")]
    docs = [(1, "Two, words!"), (2, "one"), (3, "one two words"), (4, ""), (5, None), (6, "words two"), (7, "TWO WORDS"), (8, "three short words")]
    got = d.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.score) for r in got) == [(1, 1, 1.0), (1, 5, 1.0), (2, 2, 1.0), (7, 1, 1.0), (7, 5, 1.0), (8, 3, 1.0)]


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d")], "item_id long, text string")
    assert d.contaminated(df, bench.limit(0)).collect() == [] and d.contaminated(df.limit(0), bench).collect() == []
    assert d.decontaminate(df, bench.limit(0)).count() == 1


def test_query(spark):
    from quadrill.llm.queries import op10_decontaminate

    sf_dir = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id) for r in op10_decontaminate(spark, sf_dir).collect()}
    assert got == brute(docs, items, d.SCORE) and got
