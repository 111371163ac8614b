import math
import random
from collections import Counter

import numpy as np
import pytest

from quadrill.llm import lm_score
from quadrill.llm.words import hashed_words


def grams_of(words, order):
    return Counter(tuple(words[i : i + n]) for n in range(1, order + 1) for i in range(len(words) - n + 1))


def brute(rows, order=3):
    docs = [hashed_words([t]).hashes.tolist() for _, t in rows]
    own = [grams_of(w, order) for w in docs]
    total = sum(own, Counter())
    n_corpus, out = sum(map(len, docs)), []
    for (i, _), words, mine in zip(rows, docs, own, strict=True):
        rest, logs = n_corpus - len(words), 0.0
        for k in range(len(words)):
            most = min(k, order - 1)
            for n in range(most, -1, -1):
                g = tuple(words[k - n : k + 1])
                c = total[g] - mine[g]
                if c > 0:
                    s = c / (total[g[:-1]] - mine[g[:-1]] if n else rest)
                    break
            else:
                s = 1 / (rest + 1)
            logs += math.log(s * 0.4 ** (most - max(n, 0)))
        out.append((i, len(words), logs))
    return out


def same(got, want):
    def in_order(rows):
        return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2]))

    got = in_order([tuple(r) for r in got])
    assert len(got) == len(want)
    for (i, n, logs, mean), (j, m, right) in zip(got, in_order(want), strict=True):
        assert (i, n) == (j, m) and logs == pytest.approx(right, abs=2e-6)
        assert mean is None if n == 0 else mean == pytest.approx(right / n)


def test_planes():
    rng = np.random.default_rng(1)
    for values in (np.array([], np.uint64), np.array([0]), rng.integers(0, 1 << 63, 99, dtype=np.uint64) * np.uint64(2), np.array([1, 300, 70000])):
        assert lm_score.from_planes(lm_score.planes(values), len(values)).tolist() == values.tolist()


@pytest.mark.parametrize(("order", "chars", "bucket"), [(3, 6_000_000, 4_000_000), (3, 900, 100), (4, 900, 100), (2, 900, 100), (1, 3000, 1000)])
def test_against_brute_force(spark, order, chars, bucket):
    rng = random.Random(3)
    words = [a + b for a in "abcdefg" for b in "xyz"]
    rows = [(k, " ".join(rng.choice(words[: rng.randrange(3, 21)]) for _ in range(rng.randrange(0, 60)))) for k in range(120)]
    rows += [(5, rows[5][1]), (None, rows[7][1]), (200, None), (201, ""), (202, "alone Other words!"), (203, "ax, bx. " * 2000), (204, "..."), (205, "ax")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, seg int, bucket string")
    same(lm_score.score(df, order=order, segment_chars=chars, bucket_ngrams=bucket).collect(), brute(rows, order))


def test_empty_table(spark):
    assert lm_score.score(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query(spark):
    from quadrill.llm.queries import op6_lm_score

    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    same([(*r[:3], None if not r.n_words else r.log_score / r.n_words) for r in op6_lm_score(spark, "/root/testdata/sf0.001").collect()], brute(rows))
