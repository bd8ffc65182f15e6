"""Directly addressable codes: exact round trips, random access, and global places against a loop."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tesserae.llm import token_codes as T
from tesserae.llm.common import stage

from .fixtures import documents, empty, long_text

SMALL = st.lists(st.one_of(st.integers(0, 50_256), st.integers(0, 3), st.integers(0, 2**32 - 1)), max_size=1500)


@settings(max_examples=60, deadline=None)
@given(SMALL, st.sampled_from([(10, 6, 16), (8, 8, 8, 8), (1, 3, 5, 7, 16), (32,), (3,) * 11]), st.data())
def test_codes_round_trip(ids, widths, data):
    codes = T.Codes(T.encode(np.array(ids, np.uint32), widths))
    assert len(codes) == len(ids) and codes.ids(0, len(ids)).tolist() == ids
    if ids:
        begin = data.draw(st.integers(0, len(ids)))
        end = data.draw(st.integers(begin, len(ids)))
        assert codes.ids(begin, end).tolist() == ids[begin:end]
        for k in data.draw(st.lists(st.integers(0, len(ids) - 1), max_size=30)):
            assert codes.id_at(k) == ids[k]


def test_long_streams_and_ranks():
    rng = np.random.default_rng(1)
    ids = np.where(rng.random(300_000) < 0.6, rng.integers(0, 1000, 300_000), rng.integers(0, 50_257, 300_000)).astype(np.uint32)
    data = T.encode(ids)
    codes = T.Codes(data)
    assert (codes.ids(0, len(ids)) == ids).all() and len(data) < 1.75 * len(ids)
    goes_on = np.cumsum(np.append(0, ids >= 1 << T.WIDTHS[0]))
    for k in rng.integers(0, len(ids), 500).tolist():
        assert codes.rank(0, k) == goes_on[k] and codes.id_at(k) == ids[k]
    with pytest.raises(IndexError):
        codes.id_at(len(ids))
    with pytest.raises(ValueError, match="bits"):
        T.encode(np.array([1 << 20], np.uint32), (10, 6))


def expected(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
    """(doc_id, n_tokens, crc) in order of document, from the library."""
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = []
    for doc, text in sorted(rows, key=key):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc, len(ids), zlib.crc32(ids.tobytes()), ids))
    return out


def test_documents_against_the_library(spark):
    df = documents(spark).repartition(5)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    segments = stage(T.token_segments(df), "codes-test")
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"], r["ids"]) for r in T.read_documents(segments, keep_ids=True).collect())
    want = expected(rows)
    assert [g[1] for g in got] == [w[0] for w in want]
    assert sorted(g[1:4] for g in got) == sorted(w[:3] for w in want)
    stream = []
    for start, _, n, _, raw in got:
        assert start == len(stream) and n == len(raw) // 4
        stream += np.frombuffer(raw, "<u4").tolist()
    places = random.Random(1).sample(range(len(stream)), 300)
    asked = spark.createDataFrame([(p,) for p in [*places, -5, len(stream), len(stream) + 10**9, places[0]]], "position long")
    found = sorted(tuple(r) for r in T.ids_at(segments, asked).collect())
    assert found == sorted((p, stream[p]) for p in [*places, places[0]])


def test_null_ids_repeats_and_long_texts(spark):
    rows = [(None, "none"), (None, None), (3, "b" * 10), (3, "a"), (3, "a"), (-2, ""), (2**60 + 1, "big id"), (9, long_text(120_000))]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, shard string, n string")
    got = sorted(T.read_documents(stage(T.token_segments(df), "codes-test")).collect(), key=lambda r: r["start"])
    want = expected(rows)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((str(w[0]), w[1], w[2]) for w in want)
    assert [r["doc_id"] for r in got] == [w[0] for w in want]
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()


def test_many_segments_in_a_shard(spark):
    rows = [(f"doc {k:05}", "many words in a row " * (k % 400)) for k in range(900)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    segments = stage(T.token_segments(df), "codes-test")
    assert segments.count() > segments.select("shard").distinct().count()
    got = sorted(T.read_documents(segments).collect(), key=lambda r: r["start"])
    assert [(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got] == [w[:3] for w in expected(rows, lambda r: r[0])]
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()


def test_empty_table(spark):
    segments = stage(T.token_segments(empty(spark)), "codes-test")
    assert T.read_documents(segments).count() == 0
    assert T.ids_at(segments, spark.range(3).withColumnRenamed("id", "position")).count() == 0


def test_query_covers_the_driver_table(spark):
    path = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in T.op12_direct_codes(spark, path).collect())
    want = expected(rows)
    starts = np.cumsum([0, *(w[1] for w in want)])[:-1].tolist()
    assert got == [(s, *w[:3]) for s, w in zip(starts, want, strict=True)]
