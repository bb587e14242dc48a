"""The seam to models: per-item calls over Arrow batches with an error column, prompt tokens, masks.

Models are functions given by the caller; none are bundled. A failing item never fails its batch.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

#: Fixed values of the prompt tokenizer: start, end, and the longest prompt.
START, END, LONGEST = 49406, 49407, 77
MASK_SIDE = 160


def examine(items: DataFrame, key: str, inputs: list[str], work: Callable[..., str | None], load: Callable[[], object] | None = None) -> DataFrame:
    """key, payload, error for each item: work(model, *inputs) gives a payload, or None for nothing to say;
    an exception is the item's error. load makes the model once for each Python worker's task."""

    def run(batches):
        model = load() if load else None
        for batch in batches:
            payloads, errors = [], []
            for row in batch[inputs].itertuples(index=False):
                try:
                    payloads.append(work(model, *row))
                    errors.append(None)
                except Exception as e:  # an item's failure is data
                    payloads.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({key: batch[key], "payload": payloads, "error": errors})

    kind = items.schema[key].dataType.simpleString()
    return items.select(key, *[c for c in inputs if c != key]).mapInPandas(run, f"{key} {kind}, payload string, error string")


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def prompt_tokens(text: Column, path: str) -> Column:
    """Ids of a prompt between start and end, at most LONGEST of them, by a byte-level BPE file."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def ids(texts: pd.Series) -> pd.Series:
        encode = _tokenizer(path).encode
        return texts.map(lambda t: [START, *encode(t or "", add_special_tokens=False).ids[: LONGEST - 2], END])

    return ids(text)


def mask(prototypes: np.ndarray, weights: np.ndarray, box: tuple[float, float, float, float], size: int = MASK_SIDE) -> tuple[np.ndarray, float]:
    """A segment's mask in its box (x, y, w, h, in fractions), and the share of the box that it covers:
    the weighted prototypes, resized bilinearly to size x size, where the sigmoid passes one half."""
    plane = np.tensordot(weights, prototypes, 1)
    rows, columns = plane.shape
    x, y, w, h = box
    at = lambda start, length, n: np.clip((start + length * (np.arange(size) + 0.5) / size) * n - 0.5, 0, n - 1)
    r, c = at(y, h, rows), at(x, w, columns)
    r0, c0 = np.floor(r).astype(int), np.floor(c).astype(int)
    r1, c1 = np.minimum(r0 + 1, rows - 1), np.minimum(c0 + 1, columns - 1)
    fr, fc = (r - r0)[:, None], (c - c0)[None, :]
    value = (plane[np.ix_(r0, c0)] * (1 - fr) + plane[np.ix_(r1, c0)] * fr) * (1 - fc) + (plane[np.ix_(r0, c1)] * (1 - fr) + plane[np.ix_(r1, c1)] * fr) * fc
    out = value > 0  # the sigmoid passes one half where its argument is positive
    return out, float(out.mean())


def masks(segments: DataFrame, prototypes: DataFrame) -> DataFrame:
    """id, area: segments (id, photo_id, x, y, w, h, weights) with their photo's prototypes (photo_id,
    channels, side, plane: all values in one array)."""

    def run(batches):
        for b in batches:
            areas = [mask(np.asarray(r.plane, np.float64).reshape(r.channels, r.side, r.side), np.asarray(r.weights, np.float64), (r.x, r.y, r.w, r.h))[1] * r.w * r.h for r in b.itertuples()]
            yield pd.DataFrame({"id": b["id"], "area": areas})

    return segments.join(prototypes, "photo_id").select("id", "x", "y", "w", "h", "weights", "channels", "side", "plane").mapInPandas(run, "id long, area double")
