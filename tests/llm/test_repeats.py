"""Suffix arrays, and the two repeat removers against brute force."""

import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from llm_cases import awkward, empty, prose
from tripcast.llm import blocks as bl
from tripcast.llm import ngram_join as J
from tripcast.llm import quality as Q
from tripcast.llm import substring_dedup as W
from tripcast.llm import suffix_array as A
from tripcast.llm import suffix_dedup as D
from tripcast.llm import textbytes as tb


@settings(max_examples=300, deadline=None)
@given(st.binary(min_size=1, max_size=80), st.integers(1, 256))
def test_suffix_array_and_common_prefixes(data, symbols):
    s = np.frombuffer(bytes(b % symbols for b in data), np.uint8)
    b = s.tobytes()
    truth = sorted(range(len(b)), key=lambda i: b[i:])
    sa = A.induced_order(s, 256)
    assert sa.tolist() == truth
    shared = A.permuted_common_prefixes(s, sa, np.full(len(s), len(s)))
    for x, y in zip(truth, truth[1:]):
        n = 0
        while n < min(len(b) - x, len(b) - y) and b[x + n] == b[y + n]:
            n += 1
        assert shared[y] == n


def test_long_alphabets_end_in_doubling(monkeypatch):
    monkeypatch.setattr(A, "LOOP_SYMBOLS", 2)
    for seed in range(40):
        s = np.random.default_rng(seed).integers(0, 4, 500).astype(np.uint8)
        b = s.tobytes()
        assert A.induced_order(s, 256).tolist() == sorted(range(len(b)), key=lambda i: b[i:])


def thue_morse(n, a="a", b="b"):
    """Two words of 2**n letters that polynomials modulo a power of two cannot tell apart if n is 10 or more."""
    one, two = a, b
    for _ in range(n):
        one, two = one + two, two + one
    return one, two


def test_regular_words_have_hashes_of_their_own():
    for n in range(1, 14):
        words = [w.encode() for pair in (thue_morse(n), thue_morse(n, "x", "q"), thue_morse(n, "0", "1")) for w in pair]
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words])
        for which in (0, 1):
            starts = ends - len(words[0])
            found = tb.Prefix(raw, which).stretches(starts, ends)
            assert len(set(found.tolist())) == len(words)
            again = tb.Prefix(np.concatenate([raw[7:], raw]), which).stretches(starts + len(raw) - 7, ends + len(raw) - 7)
            assert again.tolist() == found.tolist()


def test_windows_of_regular_words_stay_apart(spark):
    """Documents that differ in one long regular word share no window, no shingle and no repeated line."""
    one, two = thue_morse(11)
    rest = " ".join(f"word{i}" for i in range(49))
    docs = spark.createDataFrame([(1, f"{one} {rest}"), (2, f"{two} {rest}"), (3, f"{one} {rest}")], "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in W.dedup_windows(docs).collect()}
    assert got == {1: 0, 2: 0, 3: 50}
    single = spark.createDataFrame([(1, one), (2, two), (3, f"{one} b c"), (4, f"{two} b c")], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in J.similar_documents(single).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}
    lines = [f"{one}\n{two}\n{one}{two}", f"p q r s {one} p q r s {two}"]
    found = {r["doc_id"]: (r["n_dup_lines"], r["n_repeat_words"]) for r in Q.score(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"), None).collect()}
    assert found == {0: (0, 0), 1: (0, 0)}


def brute_bytes(rows, size=50):
    starts = {}
    for i, t in rows:
        if i is not None:
            b = (t or "").encode()
            for k in range(len(b) - size + 1):
                w = b[k:k + size]
                starts[w] = min(starts.get(w, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - size + 1):
            if i is not None and starts[b[k:k + size]] < i:
                gone[k:k + size] = True
        runs = int(((gone[1:] > gone[:-1]).sum()) + (gone[0] if len(b) else 0))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def brute_words(rows, size=50):
    starts, split = {}, [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        if i is not None:
            for k in range(len(w) - size + 1):
                key = tuple(w[k:k + size])
                starts[key] = min(starts.get(key, i), i)
    out = []
    for i, w in split:
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - size + 1):
            if i is not None and starts[tuple(w[k:k + size])] < i:
                gone[k:k + size] = True
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def passages():
    rng = random.Random(3)
    shared = [prose(n, 100 + n) for n in (60, 12, 200, 55)]
    rows = []
    for i in range(30):
        parts = [prose(rng.randrange(5, 60), i)]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(shared)[rng.randrange(30):], prose(rng.randrange(1, 30), 1000 + i)]
        rows.append((100 + i, rng.choice([" ", "\n", "  "]).join(parts)))
    return rows + [(200, "ab" * 300), (201, "ab" * 200), (202, "x" * 400), (203, "x" * 49), (204, "x" * 50)]


def test_suffix_dedup_equals_brute_force(spark):
    df, rows = awkward(spark, passages())
    got = D.dedup_substrings(df)
    out = [tuple(r) for r in got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    assert order(out) == order(brute_bytes(rows))
    for r in got.collect():
        assert hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"]
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"] and len(r["spans"]) == r["n_spans"]
    assert D.dedup_substrings(empty(spark)).count() == 0


def test_suffix_dedup_small_shards(spark, monkeypatch):
    monkeypatch.setattr(D, "SHARD_BYTES", 300)
    monkeypatch.setattr(bl, "CHUNK_BYTES", 4_000)
    rows = passages()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = [tuple(r) for r in D.dedup_substrings(df, with_text=False).collect()]
    assert order(out) == order(brute_bytes(rows))


def test_substring_dedup_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(bl, "CHUNK_BYTES", 4_000)
    df, rows = awkward(spark, passages())
    got = W.dedup_windows(df)
    out = [tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    assert order(out) == order(brute_words(rows))
    for r in got.collect():
        if r["doc_id"] != 10:  # its zero bytes stay; the text form is the same
            assert hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"]
    assert W.dedup_windows(empty(spark)).count() == 0


def test_sketch_never_falls_short():
    rng = np.random.default_rng(1)
    cells = [np.unique(rng.integers(0, 5_000, 800)).astype(np.uint32) for _ in range(9)]
    truth = np.bincount(np.concatenate(cells), minlength=5_000)
    for c, est in zip(cells, W.sketch_estimates(cells, load=1)):
        assert (est >= truth[c]).all()
    wide = W.sketch_estimates(cells, load=64)
    assert np.mean(np.concatenate(wide) == truth[np.concatenate(cells)]) > 0.99


def test_anchors_put_equal_windows_under_equal_hashes():
    rng = np.random.default_rng(2)
    shared = rng.integers(0, 4, 90).astype(np.uint8)
    raw = np.concatenate([rng.integers(0, 4, 70).astype(np.uint8), shared, rng.integers(0, 4, 61).astype(np.uint8), shared])
    bounds = np.array([0, 160, len(raw)])
    a = bl.Anchors(tb.Prefix(raw), bounds, 50, 24)
    under = {}
    for first, n, h in zip(a.first.tolist(), a.windows.tolist(), a.hashes.tolist()):
        for k in range(first, first + n):
            under[k] = h
    assert set(under) == set(range(0, 111)) | set(range(160, len(raw) - 49))
    for k in range(41):
        assert under[70 + k] == under[221 + k]
