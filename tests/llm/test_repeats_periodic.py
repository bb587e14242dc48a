"""A line said over and over: a few pieces a run, not one for each of its windows."""

import random

import numpy as np
import pyarrow as pa
import pytest

from lumenlake.llm import repeats
from tests.llm.test_operators import brute_repeats, key

ASKS = pa.list_(pa.struct([("key", pa.int64()), ("alone", pa.bool_()), ("at", pa.int64()), ("n", pa.int64()), ("p", pa.int64())]))


def _word(draw, n):
    return "".join(draw.choice("abcdefgh ") for _ in range(n))


def _made(raw: bytes):
    """The longest run of a text that holds its string more than once: its windows, those that it repeats itself, its pieces."""
    keys, start, n, only = repeats.runs(np.frombuffer(raw, np.uint8))
    i = int(np.argmax(np.where(only < 0, n, 0)))
    at, size = int(start[i]), int(n[i])
    ask = {"key": int(keys.view(np.int64)[i]), "alone": True, "at": at, "n": size, "p": None}
    batch = pa.record_batch([pa.array([7]), pa.array([repeats.zstandard.compress(raw)]), pa.array([[ask]], ASKS)], names=["rid", "body", "asks"])
    rows = [row for columns in repeats._pieces(repeats.STEP, [batch]) for row in zip(*columns)]
    own = set((repeats.within(np.frombuffer(raw, np.uint8)[at : at + size + repeats.LENGTH - 1]) + at).tolist())
    return range(at, at + size), own, rows


def test_pieces_of_a_repeated_line_do_not_grow_with_its_number():
    draw = random.Random(5)
    before, after = _word(draw, 500), _word(draw, 500)
    counts = []
    for times in (150, 300, 600):
        windows, own, rows = _made((before + "Is onhe. " * times + after).encode())
        assert len(windows) > 9 * times - 400
        told = {w for *_, a, n, _ in rows for w in range(a, a + n)}
        text = (before + "Is onhe. " * times + after).encode()
        cut = lambda ws: {text[w : w + repeats.LENGTH] for w in ws}
        assert cut(told) == cut(windows)  # each different window is told
        assert {w for w in windows if w not in own} <= {w for _, _, alone, _, a, n, _ in rows if alone for w in range(a, a + n)}
        counts.append(len(rows))
    assert counts[0] == counts[1] == counts[2] <= 100


@pytest.mark.parametrize("line", ["z", "Is onhe. ", "A line of some sixty bytes that is often said again, as here. "])
def test_repeated_lines_in_many_surroundings(spark, line):
    draw = random.Random(6)
    rows = [(i, _word(draw, draw.randrange(500)) + line * draw.randrange(1, 1200 // len(line)) + _word(draw, draw.randrange(500))) for i in range(40)]
    rows += [(100 + i, _word(draw, 30) + (line * 500)[:395] + "ab"[i % 2] + _word(draw, 3) + line * 3) for i in range(6)]
    rows += [(200 + i, _word(draw, 40) + (line * 500)[i:400 + i] + _word(draw, 40)) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = repeats.without_repeats(df, repeats.Settings(largest=3000))
    assert key(tuple(r) for r in out.collect()) == brute_repeats(rows)
