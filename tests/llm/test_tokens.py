import zlib
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")

from quadrill.llm import packing, token_files
from quadrill.llm.queries import byte_bpe
from quadrill.llm.tokens import encoder

TEXTS = ["", "Hello, world!", "  two  spaces\n\nand lines ", "Größe ñandú <|endoftext|>", "日本語 text", "a" * 5000, "word " * 3000, None, "Hello, world!"]


@lru_cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(byte_bpe())


def ids_of(text, end):
    return [*library().encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.one_of(st.text(max_size=40), st.sampled_from(["<|endoftext|>", "<|endof", "text|>", " <|endoftext|> ", "words of Größe"])), max_size=4).map("".join), max_size=5))
def test_encoder_is_the_library(texts):
    found = encoder(byte_bpe()).encode(texts)
    assert [np.frombuffer(x, "<u2").tolist() for x in found] == [ids_of(t, 0)[:-1] for t in texts]


def test_added_tokens_are_the_library_s():
    assert np.frombuffer(encoder(byte_bpe()).encode(["a <|endoftext|> b"])[0], "<u2").tolist() == [64, 220, 50256, 275]


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, start long, shard string")


def test_files_round_trip(spark, tmp_path):
    rows = [(7 * k % 11 if k != 4 else None, t, 0, "x") for k, t in enumerate(TEXTS)]
    folder = f"file://{tmp_path}/files"
    shards = token_files.write_token_files(table(spark, rows), folder, byte_bpe(), sequence_length=16, shards=3)
    got = token_files.read_token_files(shards, folder).collect()
    got.sort(key=lambda r: r.start)
    want, at = [], 0
    for one, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = ids_of(text, 0)
        want.append((one, at, len(ids), crc(ids)))
        at += len(ids)
    assert [tuple(r) for r in got] == want
    n = 0
    for r in shards.collect():
        reader = token_files.ShardReader(folder, r.shard)
        for k in range(reader.ids_file.num_record_batches):
            ids, mask = reader.rows(k)
            assert ids.shape == mask.shape and ids.shape[1] == 16 and not ids[~mask].any()
            n += int(mask.sum())
    assert n == at


def test_repeated_ids_and_empty_table(spark):
    got = token_files.token_files(table(spark, [(1, "a b", 0, "")] * 40), byte_bpe()).collect()
    assert len(got) == 40 and sorted(r.start for r in got) == [3 * k for k in range(40)]
    assert token_files.token_files(table(spark, []), byte_bpe()).collect() == []
    assert packing.pack_documents(table(spark, []), byte_bpe()).collect() == []


def check_packing(got, rows, cap):
    docs = {}
    for r in got:
        docs.setdefault(r.doc_id, []).append(r)
    for one, text, *_ in rows:
        ids, at = ids_of(text, 2), 0
        pieces = sorted(docs[one], key=lambda r: r.piece)
        for k, r in enumerate(pieces):
            assert (r.piece, r.start, r.ids_crc32) == (k, at, crc(ids[at : at + r.length]))
            assert k == 0 or r.length == cap.tokens
            if "input_ids" in r:
                assert list(r.input_ids) == ids[at : at + r.length]
            at += r.length
        assert at == len(ids) and (len(pieces) == 1 or len(ids) > cap.tokens)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= cap.tokens and len(places) <= cap.documents and sum(n * n for _, n in places) <= cap.attention
    return len(bins)


@pytest.mark.parametrize(
    "cap",
    [packing.Capacity(), packing.Capacity(select="product"), packing.Capacity(64, 2, 64 * 64), packing.Capacity(64, 64, 64 * 64, (1.0, 1.0, 1.0))],
)
def test_packing(spark, cap):
    rows = [(k, t, 0, "x") for k, t in enumerate([*TEXTS, *("some words " * (k % 37) for k in range(200))])]
    got = packing.pack_documents(table(spark, rows), byte_bpe(), capacity=cap, with_ids=True).collect()
    n = check_packing(got, rows, cap)
    if cap.documents >= 64:
        total = sum(len(ids_of(r[1], 2)) for r in rows)
        assert n <= -(-total // cap.tokens) * 1.05 + 1


def test_pack_is_best_fit():
    bins, offsets, filled = packing.pack(np.array([60, 40, 30, 34, 64, 4, 20]), packing.Capacity(64, 8, 64 * 64))
    assert sorted(filled.tolist()) == [60, 64, 64, 64] and bins[1] == bins[6] and bins[2] == bins[3]


def plain_pack(lengths, cap):
    """The same rule by plain loops: tokens, documents and attention left in each bin."""
    bins, at, tops = [], {}, (cap.tokens, cap.documents, cap.attention)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need, best = (lengths[i], 1, lengths[i] ** 2), None
        for k, left in enumerate(bins):
            if all(x >= n for x, n in zip(left, need, strict=True)):
                if cap.select == "residual":
                    rate = -sum(w * ((x - n) / t) ** 2 for w, x, n, t in zip(cap.weights, left, need, tops, strict=True))
                else:
                    rate = sum(w * (x / t) * (n / t) for w, x, n, t in zip(cap.weights, left, need, tops, strict=True))
                if best is None or rate > best[0] + 1e-12:
                    best = rate, k
        k = best[1] if best else len(bins)
        if best is None:
            bins.append(tops)
        bins[k] = tuple(x - n for x, n in zip(bins[k], need, strict=True))
        at[i] = k
    return [at[i] for i in range(len(lengths))]


@pytest.mark.parametrize("select", ["residual", "product"])
@pytest.mark.parametrize("documents", [3, 64])
@pytest.mark.parametrize("weights", [(1.0, 1.0, 1.0), (1.0, 0.2, 3.0)])
def test_pack_against_plain_loops(select, documents, weights):
    lengths = np.random.default_rng(documents).integers(1, 65 if documents > 3 else 20, 300)
    cap = packing.Capacity(64, documents, 64 * 64, weights, select)
    bins, _, filled = packing.pack(lengths, cap)
    want = plain_pack(lengths.tolist(), cap)
    assert len(set(want)) == len(filled) and bins.tolist() == want
    assert documents > 3 or max(np.bincount(bins)) == 3  # this limit binds


def test_repeated_ids_are_all_packed(spark):
    rows = [(5, "same id, same text", 0, "x")] * 3 + [(5, "other " * 2000, 0, "x"), (None, None, 0, "x")]
    got = packing.pack_documents(table(spark, rows), byte_bpe()).collect()
    total = sum(len(ids_of(r[1], 2)) for r in rows)
    assert sum(r.length for r in got) == total and sum(r.doc_id is None for r in got) == 1


def test_capacity_is_checked():
    with pytest.raises(ValueError):
        packing.Capacity(64, 1, 63)


def test_queries_over_whole_table(spark, sf_dir="/root/testdata/sf0.001"):
    from quadrill.llm.queries import op7_best_fit_packing, op9_token_files

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    rows = [tuple(r) for r in docs]
    total = sum(len(ids_of(t, 2)) for _, t in rows)
    assert check_packing(op7_best_fit_packing(spark, sf_dir).collect(), rows, packing.Capacity()) <= 1.02 * total / 1024 + 2
    at, want = 0, {}
    for one, t in sorted(rows):
        ids = ids_of(t, 0)
        want[one] = (at, len(ids), crc(ids))
        at += len(ids)
    assert {r.doc_id: tuple(r)[1:] for r in op9_token_files(spark, sf_dir).collect()} == want
