"""Near codes, near vectors and first-claim grouping at sizes and shapes where comparing all, or following chains, fails."""

import random

import numpy as np
import pytest

from lumenlake.operators import claims, grouping, neighbours


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def code_frame(spark, codes):
    return spark.createDataFrame([(signed(c),) for c in codes], "code long")


def flipped(draw, code, most):
    for b in draw.sample(range(64), draw.randint(1, most)):
        code ^= 1 << b
    return code


@pytest.mark.parametrize("together", [8192, 7])
@pytest.mark.parametrize("bits", [0, 1, 6, 12])
def test_code_pairs(spark, monkeypatch, bits, together):
    """Random codes, near copies, and a crowd that shares most blocks, with keys cut into parts or not."""
    monkeypatch.setattr(neighbours, "CODES", together)
    draw = random.Random(bits)
    codes = [draw.getrandbits(64) for _ in range(60)]
    codes += [flipped(draw, c, 14) for c in codes for _ in range(2)] + [0, (1 << 64) - 1] + [1 << i | 1 << j for i in range(0, 64, 5) for j in range(3)]
    got = sorted((r.x, r.y, r.bits) for r in neighbours.code_pairs(code_frame(spark, codes + codes[:20]), bits).collect())
    kinds = sorted({signed(c) for c in codes})
    want = [(a, b, ((a ^ b) & (1 << 64) - 1).bit_count()) for i, a in enumerate(kinds) for b in kinds[i + 1 :]]
    assert got == [w for w in want if w[2] <= bits]


def test_keys_lengthen_with_the_table():
    sizes = [neighbours.blocks_for(n, 6) for n in (10**3, 10**5, 10**7, 10**9)]
    assert sizes == sorted(sizes) and len(set(sizes)) == 4
    for n in (10**5, 10**7, 10**9):
        c = neighbours.blocks_for(n, 6)
        assert n / 2 ** (64 * c // (6 + c)) < 64  # codes that a key of random codes brings together; seven bands have n / 512


def test_many_codes(spark):
    """Every planted pair among 200,000 codes; bands of nine bits would make 270 million comparisons."""
    draw = random.Random(3)
    codes = [draw.getrandbits(64) for _ in range(200_000)]
    planted = {tuple(sorted((signed(c), signed(flipped(draw, c, 6))))) for c in codes[:500]}
    rows = spark.createDataFrame([(signed(c),) for c in codes] + [(x,) for p in planted for x in p], "code long")
    got = {(r.x, r.y) for r in neighbours.code_pairs(rows, 6).collect()}
    assert planted <= got and len(got) < len(planted) + 50


def unit_rows(vectors):
    v = np.asarray(vectors, float)
    return [(i, [float(x) for x in row]) for i, row in enumerate(v / np.linalg.norm(v, axis=1, keepdims=True))]


@pytest.mark.parametrize("together", [4096, 16])
@pytest.mark.parametrize("threshold", [0.95, 0.3, -0.2])
def test_vector_pairs_in_cells(spark, monkeypatch, threshold, together):
    monkeypatch.setattr(neighbours, "VECTORS", together)
    draw = np.random.default_rng(1)
    rows = unit_rows(np.concatenate([draw.normal(size=(8, 16)).repeat(15, axis=0) + 0.2 * draw.normal(size=(120, 16)), draw.normal(size=(60, 16))]))
    v = np.array([x for _, x in rows])
    want = {(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if v[i] @ v[j] >= threshold}
    df = spark.createDataFrame(rows, "seq long, vector array<double>")
    for cells in (1, 9):
        got = [(r.a, r.b) for r in neighbours.vector_pairs(df, threshold, cells).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_cells_are_skipped(spark):
    """Of clustered vectors most pairs are never compared, and none is lost."""
    draw = np.random.default_rng(2)
    rows = unit_rows(draw.normal(size=(40, 32)).repeat(50, axis=0) + 0.1 * draw.normal(size=(2000, 32)))
    df = spark.createDataFrame(rows, "seq long, vector array<double>")
    assert neighbours.compared_share(df, 0.95, 60) < 0.1
    v = np.array([x for _, x in rows])
    assert neighbours.vector_pairs(df, 0.95, 60).count() == (np.triu(v @ v.T, 1) >= 0.95).sum()


def folded(n, links):
    before = {}
    for a, b in links:
        before.setdefault(b, []).append(a)
    of = {}
    for i in range(n):
        of[i] = min((a for a in before.get(i, ()) if of[a] == a), default=i)
    return of


def links_of(n, kind):
    draw = random.Random(kind)
    if kind == "chain":
        return {(i, i + 1) for i in range(n - 1)}
    if kind == "star":
        return {(0, i) for i in range(1, n)} | {(i, n - 1) for i in range(n - 1)}
    return {tuple(sorted(draw.sample(range(n), 2))) for _ in range(n // 2 if kind == "parts" else 3 * n)}


@pytest.mark.parametrize("kind", ["chain", "star", "parts", "dense"])
def test_claims_in_components_and_ranges(spark, monkeypatch, kind):
    """All links in one fold; components folded one by one; components larger than a fold, range by range."""
    n = 120
    links = links_of(n, kind)
    df = spark.createDataFrame(sorted(links), "a long, b long").repartition(3)
    for most in (10**6, 100, 40):
        monkeypatch.setattr(claims, "FOLD", most)
        got = {r.seq: r.anchor for r in claims.anchors(spark.range(n).withColumnRenamed("id", "seq"), df).collect()}
        assert got == folded(n, links), most


def test_a_long_chain_needs_no_rounds(spark):
    n = 20_001
    got = grouping.anchors(spark.range(n).withColumnRenamed("id", "seq"), spark.range(n - 1).selectExpr("id AS a", "id + 1 AS b"))
    assert got.where("anchor <> seq - seq % 2").count() == 0


def test_hashes_in_capitals_and_copies(spark):
    rows = spark.createDataFrame([(1, "00000000000000FF"), (2, "00000000000000fe"), (3, "00000000000000ff"), (4, "ff00000000000000"), (5, "FF000000000000FF")], "seq long, hash string")
    assert sorted(map(tuple, grouping.hash_pairs(rows).collect())) == [(1, 2, 1), (1, 3, 0), (2, 3, 1)]
    assert [tuple(r) for r in grouping.near_hashes(rows).collect()] == [("00000000000000fe", "00000000000000ff", 1)]
    with pytest.raises(Exception, match="16 hex digits"):
        grouping.near_hashes(spark.createDataFrame([("12",)], "hash string")).collect()
