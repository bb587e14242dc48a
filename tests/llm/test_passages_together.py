"""Passages of several texts are looked up together, with what each text gives by itself."""

import random

import pytest

from lumenlake.llm import decontaminate


@pytest.mark.parametrize("laid", [1 << 18, 500])
def test_texts_are_looked_up_together(monkeypatch, laid):
    draw = random.Random(12)
    word = lambda: f"w{draw.randrange(400)}"
    items = [(i, " ".join(word() for _ in range(draw.choice((6, 12, 40)))), " ".join(word() for _ in range(3))) for i in range(60)]
    index = decontaminate.build(items)
    plain = lambda n: [word() for _ in range(n)]
    texts: list[str | None] = [None, "", "w1"]
    for n in (1, 30, 63, 64, 65, 127, 128, 129, 192, 300, 1000):
        for _ in range(6):
            own = plain(n)
            for _, q, a in draw.sample(items, draw.choice((0, 1, 3))):
                k = draw.randrange(len(own) + 1)
                own[k:k] = (q + " " + a).split()
            texts.append(" ".join(own))
    # items cut in two by the border of two texts are in neither
    q, a = items[5][1:]
    whole = (q + " " + a).split()
    texts += [" ".join(whole[: len(whole) // 2]), " ".join(whole[len(whole) // 2 :]), None, " ".join(whole)]
    alone = [decontaminate.matches(index, t) for t in texts]
    assert sum(map(len, alone)) > 40 and alone[-1] and not alone[-3] and not alone[-4]
    calls = []
    looked = decontaminate.retrieve
    monkeypatch.setattr(decontaminate, "retrieve", lambda *x: calls.append(1) or looked(*x))
    monkeypatch.setattr(decontaminate, "LAID", laid)
    assert list(decontaminate.matches_of(index, texts)) == alone
    assert len(calls) < len(texts) / (10 if laid > 500 else 1)
    monkeypatch.setattr(decontaminate, "retrieve", looked)
    together = decontaminate._together(index, [decontaminate.np.array([index.vocabulary.get(w, -1) for w in decontaminate.words(t)], "int64") for t in texts], index.window // 2)
    monkeypatch.setattr(decontaminate, "BATCH", 1)  # some batches have no passage to be looked at
    assert together == alone == decontaminate._together(index, [decontaminate.np.array([index.vocabulary.get(w, -1) for w in decontaminate.words(t)], "int64") for t in texts], index.window // 2)
