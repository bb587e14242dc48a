"""Postings are made within each document, without a shuffle of all words."""

import random

from lumenlake.functions.text import query_tokens
from lumenlake.operators.text_index import postings


def test_postings_of_a_document_need_no_exchange(spark):
    draw = random.Random(7)
    words = ["a", "Boat", "boat", "número", "numero", "é", "éx", "İ", "9", "straße", "-", "日本", "z" * 40]
    docs = [(i, *[" ".join(draw.choices(words, k=draw.choice((0, 1, 5, 60)))) or draw.choice((None, "")) for _ in "tb"]) for i in range(40)]
    got = postings(spark.createDataFrame(docs, "id long, title string, body string"), ("title", "body"))
    want = {}
    for i, *texts in docs:
        for col, text in zip(("title", "body"), texts):
            for at, t in enumerate(query_tokens(text or "")):
                want.setdefault((t, i, col), []).append(at)
    rows = got.collect()
    assert len(rows) == len(want)
    assert {(r.token, r.id, r.col): r.pos for r in rows} == want
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
