"""Rows that share an id but not a text."""

import numpy as np
import pyarrow as pa

from lumenlake.llm import simhash

A = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree " * 3
B = "quarterly figures show rising demand for copper wire and steel plate in most northern harbours " * 3


def test_one_of_each_decides_by_row(spark):
    kept = lambda rows: sorted(map(tuple, simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()), key=repr)
    assert kept([(3, A, "x"), (6, A, "x"), (6, B, "y")]) == [(3, A, "x"), (6, B, "y")]
    assert kept([(3, B, "x"), (6, A, "x"), (6, B, "y")]) == [(3, B, "x"), (6, A, "x")]
    assert kept([(6, A, "b"), (6, A, "a"), (6, B, "c"), (None, A, "n")]) == sorted([(6, A, "a"), (6, B, "c"), (None, A, "n")], key=repr)


def test_columns_of_any_kind(spark):
    """Maps, names that the stage might use itself, and no other columns at all."""
    rows = [(1, A, {"k": 1}, 1, "p"), (2, A, {"k": 2}, 2, "q"), (3, B, None, 3, None), (2, B, {}, 4, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>, rid long, part string")
    out = simhash.one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.m, r.rid, r.part) for r in out.collect()) == [(1, {"k": 1}, 1, "p"), (2, {}, 4, "s")]
    assert sorted(r.doc_id for r in simhash.one_of_each(docs.select("doc_id", "text")).collect()) == [1, 2]


def test_large_keys_are_cut_in_blocks(spark, monkeypatch):
    """Links of a key that is cut into pairs of blocks span the same components."""
    draw = np.random.default_rng(5)
    base = draw.integers(0, 2**62, 12)
    fps = sorted({int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in draw.integers(0, 62, (60, 2))})
    key, value = np.zeros(len(fps), np.int64), np.array(fps, np.int64)
    monkeypatch.setattr(simhash, "HOT", 50)
    batches = [pa.RecordBatch.from_arrays([pa.array(key[i : i + 100]), pa.array(value[i : i + 100])], ["key", "fp"]) for i in range(0, len(fps), 100)]
    work = [(left[0], right[0]) for a, _, left, right in simhash._links(batches) if left[0] is not None]
    n = -(-len(fps) // 50)
    assert len(work) == n * (n + 1) // 2
    found = list(simhash._pairs([pa.RecordBatch.from_arrays([pa.array([x for x, _ in work]), pa.array([y for _, y in work])], ["left", "right"])]))
    root = {v: v for v in fps}

    def top(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in found:
        for x, y in zip(a.tolist(), b.tolist()):
            assert (x ^ y).bit_count() <= simhash.LINK
            root[top(x)] = top(y)
    linked = {(x, y) for i, x in enumerate(fps) for y in fps[i + 1 :] if (x ^ y).bit_count() <= simhash.LINK}
    assert all(top(x) == top(y) for x, y in linked)
