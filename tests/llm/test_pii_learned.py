"""Spans that only the trees can add: they look like strict ones but lack what makes those strict."""

import random
import time

from lumenlake.llm import pii


def test_spans_without_the_mark_of_their_rule(spark):
    draw = random.Random(3)
    name = lambda: "".join(draw.choice("abcdefghij") for _ in range(6)) + str(draw.randint(10, 99))
    phone = lambda: f"1 ({draw.randint(100, 999)}) 555-{draw.randint(1000, 9999)}"
    rows = []
    for i in range(400):
        rows.append((i, f'mail {name()}@{"abcdef"[i % 6]}host.example.com, ring +{phone()} or token = "{draw.getrandbits(160):040x}" today'))
        rows.append((i + 1000, f"part {draw.getrandbits(64):016x}abc of {draw.randint(10**10, 10**11 - 1)} in a list @x{i} y@z"))
    odd = [(5000, f"mail {name()}@ahost today"), (5001, f"ring {phone()} today"), (5002, f"see {draw.getrandbits(160):040x} today"), (5003, "no token here 10.0.0.256 and y@z")]
    out = {r.doc_id: {x.split(":")[0] for x in r.spans.split(",") if x} for r in pii.personal_data(spark.createDataFrame(rows + odd, "doc_id long, text string")).collect()}
    assert [out[i] for i, _ in odd] == [{"email"}, {"phone"}, {"secret"}, set()]
    assert all(out[i] == ({"email", "phone", "secret"} if i < 1000 else set()) for i, _ in rows)
    # a cue is enough where there is too little to learn from
    few = spark.createDataFrame([(1, 'password: "correcthorse7battery" end')], "doc_id long, text string")
    assert [r.spans for r in pii.personal_data(few).collect()] == ["secret:11:31"]


def test_long_lists_and_other_columns(spark):
    """Texts of a megabyte with a hundred thousand matches; columns of any name and type come back."""
    phones = "; ".join(f"+1 (555) {i % 1000:03d}-{i % 9973:04d}" for i in range(50_000))
    rows = [(1, phones, {"a": 1}, "mine", "his"), (2, "12 x" * 300_000, None, None, None), (3, None, {}, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>, _text string, `all` string")
    began = time.perf_counter()
    found = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    assert (found[1].n_phone, found[2].n_phone, found[3].spans) == (50_000, 0, "")
    back = {r["doc_id"]: r for r in pii.redacted(docs).collect()}
    assert back[1]["text"] == "; ".join(["[PHONE]"] * 50_000) and back[2]["text"] == rows[1][1] and back[3]["text"] is None
    assert [(back[i]["m"], back[i]["_text"], back[i]["all"]) for i in (1, 2, 3)] == [r[2:] for r in rows]
    assert time.perf_counter() - began < 240
