"""Many links are decided on in rounds, so that few of them are left for one task to fold."""

import random

from pyspark.sql import functions as F

from lumenlake.operators import claims


def brute(n, links):
    of = {}
    for k in range(n):
        of[k] = min((a for a, b in links if b == k and of[a] == a), default=k)
    return of


def test_dense_links_are_not_folded_by_one_task(spark, monkeypatch):
    draw = random.Random(5)
    dense = {(a, b) for a in range(60) for b in range(a + 1, 60) if draw.random() < 0.5}
    chain = {(a, a + 1) for a in range(59)}
    folded = []
    fold = claims._fold
    monkeypatch.setattr(claims, "_fold", lambda links: folded.append(links.count()) or fold(links))
    for links, fold_of, most in ((dense, 100, 100), (dense | chain, 100, 100), (chain, 20, 59)):
        monkeypatch.setattr(claims, "FOLD", fold_of)
        folded.clear()
        got = claims.anchors(spark.range(60).select(F.col("id").alias("seq")), spark.createDataFrame(sorted(links), "a long, b long"))
        assert {r.seq: r.anchor for r in got.collect()} == brute(60, links)
        assert max(folded, default=0) <= most
