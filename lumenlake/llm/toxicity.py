"""Toxicity by a factorization machine over hashed terms.

A document is the set of its terms, hashed: runs of letters, lower-cased, and the first PREFIX letters
of longer ones, so that inflected and coined forms share a term with their stem. The score is
sigmoid(b + sum w_i + sum_{i<j} <v_i, v_j>) over the selected terms that it holds, so that a
pair of terms can weigh more, or less, than its two parts. Terms are selected by a chi-square
test on the labelled sample; all others weigh nothing, which keeps very long texts from
collecting noise. In training, each term of a document is left out now and then, so that a term
learns to stand alone and not just beside its usual company.

Edge cases: a null or empty text has no terms and gets sigmoid(b); a null doc_id is scored and
never trained on; repeated rows are scored each; labels with a null are ignored, and of several
labels of one document the largest counts; with no labels, or of one class only, the score is
the label's rate (0 when there is none). Other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.common import fold, mapped, stored, values

TERM = re.compile(r"[^\W\d_]+")
THRESHOLD = 0.7
PREFIX = 4
#: Documents whose terms are held at a time.
ROWS = 128


@dataclass(frozen=True)
class Settings:
    """max_rows bounds the labelled sample in documents, for the driver's memory only."""

    bits: int = 22
    factors: int = 4
    max_rows: int = 20_000
    min_documents: int = 4
    chi_square: float = 30.0
    epochs: int = 80
    left_out: float = 0.2
    rate: float = 0.1
    decay: float = 1e-4
    seed: int = 7


@dataclass(frozen=True)
class Machine:
    """terms: sorted hashes of the selected terms; w and v in their order."""

    bits: int
    bias: float
    terms: np.ndarray
    w: np.ndarray
    v: np.ndarray

    def logits(self, where: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """where: positions of the terms of all documents, one after the other; counts: terms of each."""
        return _forward(self.bias, self.w, self.v, where, counts)[0]


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of the given lengths, empty ones included."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def _forward(bias, w, v, where, counts):
    rows = v[where]
    s = _sums(rows, counts)
    pair = 0.5 * (s * s - _sums(rows * rows, counts)).sum(axis=1)
    return bias + _sums(w[where], counts) + pair, s


def hashes_of(text: str | None, bits: int, cache: dict) -> list[int]:
    """The distinct hashed terms of a whole text."""
    if len(cache) > 150_000:
        cache.clear()
    out: set[int] = set()
    for term in set(TERM.findall((text or "").lower())):
        h = cache.get(term)
        if h is None:
            h = (xxhash.xxh64_intdigest(term.encode(), 17) & ((1 << bits) - 1),)
            if len(term) > PREFIX:
                h += (xxhash.xxh64_intdigest(term[:PREFIX].encode(), 18) & ((1 << bits) - 1),)
            cache[term] = h
        out.update(h)
    return list(out)


def _terms(bits: int, batches):
    cache: dict = {}
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield [part.column(0), [np.sort(np.array(hashes_of(t, bits, cache), np.int32)) for t in values(part.column(1))]]


def _selected(chosen: np.ndarray, batches):
    """The rows with the chosen terms only; chosen is sorted."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            rows = [np.asarray(x.values) for x in part.column(1)]
            yield [part.column(0), [r[np.isin(r, chosen, assume_unique=True)] for r in rows], *part.columns[2:]]


def _scores(model: Machine, batches):
    cache: dict = {}
    known = {h: i for i, h in enumerate(model.terms.tolist())}
    for batch in batches:
        found = [sorted(known[h] for h in hashes_of(t, model.bits, cache) if h in known) for t in values(batch.column(1))]
        counts = np.array([len(x) for x in found], dtype=np.int64)
        where = np.array([i for x in found for i in x], dtype=np.int64)
        score = 1 / (1 + np.exp(-np.clip(model.logits(where, counts), -30, 30)))
        yield [batch.column(0), score, (score >= THRESHOLD).astype(np.int32)]


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Machine:
    """Learns from a bounded sample of labelled rows outside the held-out fold. The bound is
    settings.max_rows documents with the smallest id hashes."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(fold(F.col("doc_id"), 3) != 1)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("label"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.max_rows)
    texts = docs.select("doc_id", "text").where(fold(F.col("doc_id"), 3) != 1).join(F.broadcast(sample), "doc_id")
    found = mapped(texts.select("label", "text", "doc_id"), partial(_terms, settings.bits), "label int, terms array<int>")
    rows = stored(found.select("label", "terms", F.xxhash64("terms").alias("h"), F.monotonically_increasing_id().alias("i")), "labelled")
    # repeated rows of one id would break the bound: the rows are numbered, the smallest term hashes stay
    few = rows.select("h", "label", "i").orderBy("h", "label", "i").limit(settings.max_rows).select("i")
    rows = rows.join(F.broadcast(few), "i", "left_semi").select("label", "terms", "h", "i")
    n, positive = rows.agg(F.count("*"), F.count_if(F.col("label") > 0)).first()
    chosen = np.array(selection(rows, n, positive, settings) if 0 < positive < n else [], np.int32)
    seen = mapped(rows, partial(_selected, chosen), "label int, terms array<int>, h long, i long").orderBy("h", "label", "i").toArrow()
    y = (seen.column("label").to_numpy() > 0).astype(np.float64)
    lists = seen.column("terms").combine_chunks()
    counts = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    flat = lists.flatten().to_numpy()
    return train(y, flat, counts, settings)


def selection(rows: DataFrame, n: int, positive: int, settings: Settings) -> list[int]:
    """The terms that train() selects, in order, counted on the executors over all terms of the rows."""
    each = rows.select((F.col("label") > 0).cast("double").alias("y"), F.explode("terms").alias("t"))
    held = each.groupBy("t").agg(F.count("*").cast("double").alias("held"), F.sum("y").alias("hit")).where(F.col("held") >= settings.min_documents)
    rate = positive / n
    expected = F.col("held") * rate
    off = F.col("hit") - expected
    chi = off * off / F.greatest(expected * (1 - rate) * (1 - F.col("held") / n), F.lit(1e-9))
    return sorted(r[0] for r in held.where(chi >= settings.chi_square * (1 - 1e-9)).select("t").collect())  # train() has the last word


def train(y: np.ndarray, flat: np.ndarray, counts: np.ndarray, settings: Settings = Settings()) -> Machine:
    n, positive = len(y), y.sum()
    rate = positive / n if n else 0.0
    bias = float(np.log(max(rate, 1e-6) / max(1 - rate, 1e-6)))
    none = np.zeros(0)
    if not 0 < positive < n:
        return Machine(settings.bits, bias, none.astype(np.int64), none, np.zeros((0, settings.factors)))
    # selection: chi-square of holding the term against the label
    row = np.repeat(np.arange(n, dtype=np.int32), counts)
    size = int(flat.max(initial=0)) + 1
    held = np.bincount(flat, minlength=size).astype(float)
    hit = np.bincount(flat, weights=y[row], minlength=size)
    expected = held * rate
    chi = (hit - expected) ** 2 / np.maximum(expected * (1 - rate) * (1 - held / n), 1e-9)
    chosen = (held >= settings.min_documents) & (chi >= settings.chi_square)
    del held, hit, expected, chi
    place = np.cumsum(chosen) - 1
    keep = chosen[flat]
    where, owner = place[flat[keep]], row[keep]
    terms = np.flatnonzero(chosen)
    del place, keep, row
    counts = np.bincount(owner, minlength=n)
    k = len(terms)
    draw = np.random.default_rng(settings.seed)
    w, v = np.zeros(k), draw.normal(0, 0.05, (k, settings.factors))
    gb, gw, gv = 1e-8, np.full(k, 1e-8), np.full(v.shape, 1e-8)
    ends = np.cumsum(counts)
    for _ in range(settings.epochs):
        order = draw.permutation(n)
        for at in range(0, n, 1000):
            part = order[at : at + 1000]
            own = counts[part]
            first = np.repeat(ends[part] - own - (np.cumsum(own) - own), own)
            stays = draw.random(len(first)) >= settings.left_out
            idx = where[(first + np.arange(len(first)))[stays]]
            own = np.bincount(np.repeat(np.arange(len(part)), own)[stays], minlength=len(part))
            logit, s = _forward(bias, w, v, idx, own)
            g = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[part]) / len(part)
            each = np.repeat(g, own)
            dw = np.bincount(idx, weights=each, minlength=k) + settings.decay * w / n * 100
            dv = np.zeros_like(v)
            np.add.at(dv, idx, each[:, None] * (np.repeat(s, own, axis=0) - v[idx]))
            dv += settings.decay * v / n * 100
            gw += dw * dw
            gv += dv * dv
            gb += g.sum() ** 2
            w -= settings.rate * 5 * dw / np.sqrt(gw)
            v -= settings.rate * dv / np.sqrt(gv)
            bias -= settings.rate * 5 * g.sum() / np.sqrt(gb)
    return Machine(settings.bits, float(bias), terms, w, v)


def score(docs: DataFrame, model: Machine) -> DataFrame:
    """doc_id, score, predicted for every row; whole texts, one pass, no shuffle."""
    return mapped(docs.select("doc_id", "text"), partial(_scores, model), "doc_id long, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Learns from labels and scores every document: doc_id, held_out, score, predicted."""
    held = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    return score(docs, fit(docs, labels, settings)).select("doc_id", held.alias("held_out"), "score", "predicted")


def _kept(model: Machine, batches):
    cache: dict = {}
    known = {h: i for i, h in enumerate(model.terms.tolist())}
    for batch in batches:
        found = [sorted(known[h] for h in hashes_of(t, model.bits, cache) if h in known) for t in values(batch.column(batch.schema.get_field_index("text")))]
        counts = np.array([len(x) for x in found], dtype=np.int64)
        logit = model.logits(np.array([i for x in found for i in x], dtype=np.int64), counts)
        keep = pa.array(1 / (1 + np.exp(-np.clip(logit, -30, 30))) < THRESHOLD)
        yield batch.filter(keep).columns


def without_toxic(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns."""
    model = fit(docs, labels, settings)
    return mapped(docs, partial(_kept, model), docs.schema)
