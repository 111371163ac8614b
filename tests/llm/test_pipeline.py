import pytest
from pyspark.sql import functions as F
from tests.llm import test_decontaminate, test_lines, test_similar, test_tokens

import corpus_pipeline as p
from quadrill.llm import decontaminate, packing, quality

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    now = docs
    for k, (name, stage) in enumerate(p.STAGES):
        before = now.collect()
        stage(spark, now, SF).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        got = rows_of(out)
        if name == "quality classifier":
            model = quality.learn(now, labels)
            want = [tuple(r) for r in before if model.forward(*quality.features([r.text]))["p"][0] >= 0.5]
            kept, known = {r[0] for r in want}, {r.doc_id: r.quality for r in labels.collect()}
            assert sum(i in kept for i, q in known.items() if q == 1) >= 0.98 * sum(known.values())
            assert sum(i in kept for i, q in known.items() if q == 0) <= 0.05 * len(known)
        elif name == "line dedup":
            before = sorted(before, key=lambda r: r.doc_id)
            new = test_lines.brute([(r.doc_id, r.text) for r in before])
            want = []
            for r, (text, removed) in zip(before, new, strict=True):
                if not removed or text.strip(" "):
                    want.append((r.doc_id, text, r.lang, r.source, len(text) if removed else r.n_chars))
        elif name == "SimHash near-dedup":
            stay = test_similar.groups([(r.doc_id, r.text) for r in before])
            want = [tuple(r) for k, r in enumerate(before) if k in stay]
        elif name == "benchmark decontamination":
            dirty = {i for i, _ in test_decontaminate.brute([(r.doc_id, r.text) for r in before], bench, decontaminate.SCORE)}
            want = [tuple(r) for r in before if r.doc_id not in dirty]
        else:
            test_tokens.check_packing(out.collect(), [(r.doc_id, r.text) for r in before], packing.Capacity(documents=64))
            continue
        assert out.columns == docs.columns and got == sorted(want)
        # Line dedup takes what copies have in common: what it leaves of them here is no near-duplicate.
        assert len(got) < len(before) or name == "SimHash near-dedup" and len(got) == len(before)
        now = out


def test_run_ends_as_the_stages_do(spark):
    out = p.run(spark, SF)
    n = out.select("doc_id").distinct().count()
    assert 0 < n < spark.read.parquet(f"{SF}/documents.parquet").count()
    assert len(p.STAGES) == 5 and p.ORACLE_SQL is None


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row string, found int, n_removed int, `a.b` int"


@pytest.mark.parametrize("k", range(5))
def test_odd_rows_of_every_stage(spark, k):
    """Null and empty texts, null and repeated ids, repeated rows, long texts and clashing names."""
    some = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60").collect()
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in some]
    rows += [(1000, None, None, None, None), (1001, "", "en", "s", 0), (None, "a null id here now", None, "s", 18), rows[3], rows[3], (rows[4][0], "the same id again", "en", "s", 17), (1002, "long words " * 30000, "en", "s", 330000)]
    docs = spark.createDataFrame([(*r, 0.1, "x", 1, 2, 3) for r in rows], SCHEMA)
    name, stage = p.STAGES[k]
    out = stage(spark, docs, SF)
    got = out.collect()
    if k < 4:
        assert out.columns == docs.columns and 0 < len(got) <= len(rows)
        assert all((r.score, r.row, r.found, r.n_removed, r["a.b"]) == (0.1, "x", 1, 2, 3) for r in got)
    else:
        assert sum(r.length for r in got) == sum(len(test_tokens.ids_of(r[1], 2)) for r in rows)
    if k == 3:
        assert any(r.doc_id is None for r in got) and any(r.text is None for r in got)
    empty = stage(spark, docs.limit(0), SF)
    assert empty.columns == out.columns and empty.collect() == []
