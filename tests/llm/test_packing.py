"""Packing: exact round trip of ids, capacity, little padding, differencing, awkward tables."""

import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from llm_cases import awkward, empty, prose
from tripcast.llm import packing as P

ENCODER = P.Encoder()
EXACT = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check(rows, got, capacity=1024):
    """Every id of every document lies in exactly one piece; sequences are gapless and within the capacity."""
    ids = {}
    for doc_id, text in rows:
        ids.setdefault(doc_id, []).append(EXACT.encode(text or "", add_special_tokens=False).ids + [0])
    by_doc = {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert set(by_doc) == set(ids)
    for doc_id, versions in ids.items():
        expect = sorted((len(v), a, zlib.crc32(np.array(v[a:a + n], "<u4").tobytes())) for v in versions
                        for a, n in pieces_of(by_doc[doc_id], len(v)))
        assert sum(r["length"] for r in by_doc[doc_id]) == sum(map(len, versions))
        for v in versions:
            mine = sorted({(r["start"], r["length"], r["ids_crc32"]) for r in by_doc[doc_id] if r["doc_tokens"] == len(v)})
            at = 0
            for a, n, crc in mine:
                assert a == at and crc == zlib.crc32(np.array(v[a:a + n], "<u4").tobytes())
                at += n
            assert at == len(v)
        assert expect
    seqs = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert 0 < at <= capacity
    return seqs


def pieces_of(rows, n):
    return {(r["start"], r["length"]) for r in rows if r["doc_tokens"] == n}


def test_round_trip_and_padding(spark):
    rows = [(i, prose(5 + 37 * i % 900, i)) for i in range(600)]
    got = P.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    seqs = check(rows, got)
    used = sum(n for parts in seqs.values() for _, n in parts)
    assert 1 - used / (1024 * len(seqs)) < 0.02


def test_awkward_rows(spark):
    df, rows = awkward(spark, [(20, "<|endoftext|> x"), (21, "漢字かな混じり " * 30)])
    got = P.pack_documents(df).collect()
    check(rows, got)
    assert P.pack_documents(empty(spark)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_ids_equal_the_tokenizer(text):
    assert ENCODER.ids(text) == EXACT.encode(text, add_special_tokens=False).ids


def test_differencing_is_near_equal_and_k_rises():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 257, 600)
    window = P.multiway_differencing(sizes, 80)
    sums = np.bincount(window, sizes, 80)
    assert sums.max() - sums.min() <= 8
    window = P.windows_for(np.array([600, 600, 600]), 1024)  # two would fit the sum, but not the items
    assert len(set(window.tolist())) == 3
