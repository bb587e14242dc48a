"""Steps whose one group may hold most of a table: it does not land in one task."""

import random

from lumenlake.operators import edits


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_album_of_most_rows_is_numbered_in_parts(spark, monkeypatch):
    monkeypatch.setattr(edits, "BLOCK", 16, raising=False)
    members = spark.createDataFrame([(1, 3, 5), (2, 4, 0)], "collection_id long, photo_id long, position int")
    draw = random.Random(4)
    rows = [(draw.choice((1, 1, 1, 1, 2, 3, None)), draw.randrange(60), seq) for seq in range(300)]
    draw.shuffle(rows)
    added = edits.add_to_collection(members, spark.createDataFrame(rows, "collection_id long, photo_id long, seq int"))
    want = {(1, 3): 5, (2, 4): 0}
    after = {1: 6, 2: 1}
    for c in (1, 2, 3, None):
        for n, (_, photo, _) in enumerate(sorted((r for r in rows if r[0] == c), key=lambda r: r[2])):
            want.setdefault((c, photo), after.get(c, 0) + n)
    assert {(r.collection_id, r.photo_id): r.position for r in added.collect()} == want
    assert added.count() == len(want)
    assert "Window" not in plan(added)
