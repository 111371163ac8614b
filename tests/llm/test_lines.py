import random
import re

import pytest
import xxhash

from quadrill.llm import lines

CUT = re.compile(r"(?<=\n)(?![\r\n])|(?<=[.!?] )(?=\S)")


def cut_lines(text):
    return CUT.split(text)


def bare(part):
    return part.rstrip(" \n\r\t")


def brute(rows):
    """rows: (id, text); the kept text and the number of removed lines of each row: of every two lines that have occurred before."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, k))
    seen, out = set(), {}
    for k in order:
        parts = cut_lines(rows[k][1] or "")
        words, gone = [bare(p) for p in parts], set()
        for i in range(len(parts) - 1):
            pair = (words[i], words[i + 1])
            if pair in seen:
                gone |= {i, i + 1}
            seen.add(pair)
        out[k] = "".join(p for i, p in enumerate(parts) if i not in gone), len(gone)
    return [out[k] for k in range(len(rows))]


def run(spark, rows, **options):
    """In the order of ``rows``, with columns of names that the operator might use itself."""
    schema = "doc_id long, text string, found string, gone int, `a.b` string, row int, c0 map<string,int>, h int, n_removed int"
    df = spark.createDataFrame([(*r, "a", 3, "x.y", k, {"k": k}, 4, 0) for k, r in enumerate(rows)], schema).coalesce(1)
    out = lines.dedup(df, **options)
    assert out.columns == [*df.columns, "n_removed_"]
    got = sorted(out.collect(), key=lambda r: r.row)
    assert [(r.doc_id, r.found, r.gone, r["a.b"], r.c0, r.n_removed) for r in got] == [(i, "a", 3, "x.y", {"k": k}, 0) for k, (i, _) in enumerate(rows)]
    return got


def sentence(rng):
    return " ".join("".join(rng.choice("bcdf") + rng.choice("aeiou") for _ in range(3)) for _ in range(rng.randrange(4, 10))).capitalize()


def corpus(rng):
    passages = ["\n".join(sentence(rng) + "." for _ in range(rng.randrange(5, 9))) for _ in range(4)]
    passages += [". ".join(sentence(rng) for _ in range(8)) + ".", "\n\n".join(sentence(rng) for _ in range(6))]
    rows = []
    for k in range(80):
        parts = [". ".join(sentence(rng) for _ in range(rng.randrange(1, 5))) + "." for _ in range(rng.randrange(1, 6))]
        if k % 3:
            parts.insert(rng.randrange(len(parts) + 1), passages[k % 6])
        rows.append((k, rng.choice("\n ").join(parts)))
    return rows


@pytest.mark.parametrize("divisor", [1, 2, 4, 1000])
def test_against_brute_force(spark, divisor):
    rows = corpus(random.Random(1))
    rows += [(100, rows[1][1]), (100, rows[1][1]), (101, None), (102, ""), (None, rows[2][1]), (103, "Same line here again and again.\n" * 3000), (104, "\n\n\n"), (104, rows[4][1] + "\n")]
    rows += [(105, "Cookie policy.\nAccept all."), (106, "Own line.\nCookie policy.\nAccept all.\nOther line."), (107, "x. y. z."), (108, "y. z. x. y."), (109, "\r\n\r\na\r\nb\r\n")]
    got = run(spark, rows, divisor=divisor)
    assert [(r.text or "", r.n_removed_) for r in got] == brute(rows)
    assert [r.text for r in got if r.doc_id == 101] == [None]


def test_repeats_go_and_the_rest_stays(spark):
    rng = random.Random(5)
    for n in (2, 3, 9):
        passage = " ".join(sentence(rng) + "." for _ in range(n))
        rows = [(k, f"{sentence(rng)} {sentence(rng)}. {passage} {sentence(rng)}.\n{sentence(rng)}.") for k in range(30)] + [(99, "\n".join(sentence(rng) for _ in range(20)))]
        got = run(spark, rows)
        assert [r.n_removed_ for r in got] == [0, *[n] * 29, 0]
        assert [r.text for r in got[1:30]] == [t.replace(passage + " ", "") for _, t in rows[1:30]]


def test_every_removed_line_stays_somewhere(spark):
    rows = corpus(random.Random(7))
    left = {bare(p) for r in run(spark, rows) for p in cut_lines(r.text)}
    assert left >= {bare(p) for _, t in rows for p in cut_lines(t)}


def test_boundaries_do_not_shift(spark):
    rng = random.Random(3)
    some = [sentence(rng) for _ in range(400)]
    texts = ["\n".join(some), "\n".join(some[:100] + ["a new line"] + some[100:]), "\n".join(some[7:])]
    rows = [(k, k, [xxhash.xxh64_intdigest(x) >> 1 for x in t.split("\n")]) for k, t in enumerate(texts)]
    found = lines.chunks(spark.createDataFrame(rows, "id long, row long, a array<long>")).collect()
    of = [{r.h for r in found if r.id == k} for k in range(3)]
    assert 50 < len(of[0]) < 150 and len(of[0] - of[1]) <= 3 and len(of[0] - of[2]) <= 4
    assert all(r.n >= 2 for r in found)


def test_two_texts_of_one_hash_are_told_apart(spark):
    texts = spark.createDataFrame([(k, t) for k, t in enumerate(["A a.\nB b.\n", "A a.\nB b.\n", "A a.\nC c.\n", "A a.\nC c.\n", "D d.\nE e."])], "row long, text string")
    found = spark.createDataFrame([(k, k, 0, 2, 7) for k in range(4)] + [(4, 4, 0, 2, 8)], "id long, row long, s int, n int, h long")
    assert [r.h for r in lines.unlike(lines.with_bytes(found, texts, "text", True)).collect()] == [7]
    assert sorted(tuple(r) for r in lines.later_by_bytes(found, texts, "text", True).collect()) == [(1, 0, 2), (3, 0, 2)]
    assert sorted(tuple(r) for r in lines.later(found).collect()) == [(1, 0, 2), (2, 0, 2), (3, 0, 2)]


def test_no_hot_chunk_is_bound_to_one_task(spark):
    """An exchange follows the join by hash, so that the adaptive planner may split a frequent one."""
    hashed = spark.createDataFrame([(1, 1, [1, 2, 3])], "id long, row long, a array<long>")
    plan = lines.repeated(lines.chunks(hashed))._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and plan.index("ShuffledHashJoin") < plan.index("Exchange")


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lines.dedup(df).collect() == []


def test_query(spark):
    from quadrill.llm.queries import op1_line_dedup

    docs = sorted(tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect())
    got = op1_line_dedup(spark, "/root/testdata/sf0.001").collect()
    assert sorted((r.doc_id, r.text, r.n_removed) for r in got) == [(i, *w) for (i, _), w in zip(docs, brute(docs), strict=True)]
