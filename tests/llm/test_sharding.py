"""Sharding: table fill against a plain turn-by-turn version, balance, small moves, awkward tables."""

import hashlib
from collections import Counter

import pytest

from llm_cases import awkward, empty
from tripcast.llm import sharding as S


def brute(names, size):
    dig = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:15], 16)
    pref = [[(dig("offset|" + n) % size + j * (dig("step|" + n) % (size - 1) + 1)) % size for j in range(size)] for n in names]
    table, turn = {}, 0
    while len(table) < size:
        i = turn % len(names)
        table[next(s for s in pref[i] if s not in table)] = i
        turn += 1
    return [table[s] for s in range(size)]


def test_table_equals_turn_by_turn():
    for n, size in [(1, 7), (3, 31), (5, 101)]:
        assert S.fill_table(S.shard_names(n), size) == brute(S.shard_names(n), size)


def test_even_and_few_moves():
    names = S.shard_names(16)
    full = S.fill_table(names)
    sizes = Counter(full)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    fewer = S.fill_table(names[:-1])
    moved = sum(a != b for a, b in zip(full, fewer) if a != 15)
    assert moved / len(full) < 0.1


def test_bad_tables_are_refused():
    with pytest.raises(ValueError):
        S.fill_table(["a"], 10)
    with pytest.raises(ValueError):
        S.fill_table(["a", "a"], 11)


def test_awkward_rows(spark, tmp_path):
    df, rows = awkward(spark)
    got = S.assign_shards(df).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in rows)
    table = S.fill_table(S.shard_names())
    for r in got:
        key = "" if r["doc_id"] is None else str(r["doc_id"])
        assert r["slot"] == int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % S.TABLE_SIZE and r["shard_id"] == table[r["slot"]]
    assert S.assign_shards(empty(spark)).count() == 0
    S.write_shards(df, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(rows) and set(df.columns) <= set(back.columns)
