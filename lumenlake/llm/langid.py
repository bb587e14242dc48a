"""Language identification by prediction by partial matching.

For each language a byte context tree of order 3 holds, for every context of 0 to 3 bytes, how
often each byte followed it in that language's training texts. With N symbols seen after a
context, d of them distinct (escape method C), a byte seen n times costs log2((N + d) / n)
bits; an unseen one costs log2((N + d) / d) and goes to the next shorter context, at last to a
uniform choice of 256. A context never seen costs nothing to leave. The statistics are frozen:
scoring never changes them. The code lengths of all (context, byte) pairs are tabulated once, in
1/256 bit, so a text's length in each language is an exact integer sum of its bytes' entries,
whatever the partitioning. The shortest code names the language.

Bytes that no training text holds share one class: they cost the same everywhere.

Training uses a bounded sample: about Settings.per_language documents of each language, chosen
by a hash of id and text; their n-grams are counted on the executors, where those of a language are put into one row of
eight bytes an n-gram. These rows are broadcast, so what is broadcast grows with the sample (languages times
per_language), not with the corpus. Where the code lengths of all pairs fit into Settings.table_bytes they are tabulated
for all languages at once (Trees); else each language keeps its sorted n-grams, and the different n-grams of some
megabytes of text are looked up in them (Sorted). Both give the same lengths, to the last unit; nothing is pruned or refused.

Edge cases: a null or empty text, or one without a letter, is `und` with score 0; rows with a
null lang or id are scored and never trained on; nothing to learn from makes every row `und`;
ties go to the language first in order; repeated rows are scored each.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.common import discard, fold, mapped, stored, values

ORDER = 3
UNIT = 256
UNKNOWN = "und"
#: Bytes scored at a time, for bounded memory.
CHUNK = 1 << 20


@dataclass(frozen=True)
class Settings:
    per_language: int = 1500
    seed: int = 11
    table_bytes: int = 256 << 20


@dataclass(frozen=True)
class Trees:
    """classes: of each byte; contexts: row of the table for each context of three classes;
    table: rows x classes x languages, code lengths in 1/256 bit."""

    languages: list[str]
    classes: np.ndarray
    contexts: np.ndarray
    table: np.ndarray

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code lengths, texts x languages, in 1/256 bit."""
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= CHUNK):
                size += len(texts[end]) + ORDER
                end += 1
            if end == at + 1 and size > CHUNK:
                out[at] = self._long(texts[at])
            else:
                out[at:end] = self._some(texts[at:end])
            at = end
        return out

    def _long(self, text: bytes) -> np.ndarray:
        """A text in pieces; each takes the three bytes before it as context."""
        total = np.zeros(len(self.languages), np.int64)
        for at in range(0, len(text), CHUNK):
            before = min(ORDER, at)
            total += self._costs(self.classes[np.frombuffer(text[at - before : at + CHUNK], np.uint8)], before)
        return total

    def _costs(self, c: np.ndarray, before: int) -> np.ndarray:
        c = np.concatenate([np.zeros(ORDER, c.dtype), c])
        return self._each(c)[before:].sum(axis=0, dtype=np.int64)

    def _each(self, c: np.ndarray) -> np.ndarray:
        n = self.table.shape[1]
        c = c.astype(np.int32)
        context = (c[:-3] * n + c[1:-2]) * n + c[2:-1]
        return self.table.reshape(-1, self.table.shape[2])[self.contexts[context] * n + c[3:]]

    def _some(self, texts: list[bytes]) -> np.ndarray:
        pad = b"\0" * ORDER
        sizes = np.array([len(t) for t in texts])
        buffer = np.frombuffer(pad + pad.join(texts), np.uint8)
        c = self.classes[buffer]
        starts = np.cumsum(np.r_[0, sizes[:-1] + ORDER])  # of the padding before each text
        c[(starts[:, None] + np.arange(ORDER)).ravel()] = 0
        cost = self._each(c)
        total = np.zeros((len(texts), len(self.languages)), np.int64)
        full = np.flatnonzero(sizes)
        if len(full):
            # cost[i] is of buffer[i + 3]; a text runs from its start and the next one's padding follows
            edges = np.stack([starts[full], starts[full] + sizes[full]], axis=1).ravel()
            edges = edges[:-1] if edges[-1] >= len(cost) else edges
            total[full] = np.add.reduceat(cost, edges, axis=0, dtype=np.int64)[::2]
        return total


#: A byte in a code of n-grams; START stands before a text's first byte and is in no language's n-grams.
BITS, START = 9, 256


class Sorted:
    """The same code lengths from each language's sorted n-grams. grams: for each language its four-byte strings, as
    numbers in order, and how often each was seen."""

    def __init__(self, languages: list[str], grams: list[tuple[np.ndarray, np.ndarray]]):
        self.languages, self.grams, self._orders = languages, grams, None

    def __getstate__(self):
        return self.languages, self.grams, None  # what follows from the n-grams is made again where it is used

    def __setstate__(self, state):
        self.languages, self.grams, self._orders = state

    def _of(self, k: int) -> list[tuple]:
        """For contexts of 0 to 3 bytes: codes seen with their counts, contexts with their totals and distinct bytes."""
        if self._orders is None:
            self._orders = [None] * len(self.languages)
        if self._orders[k] is None:
            gram, n = (x.astype(np.int64) for x in self.grams[k])
            wide = sum((gram >> 8 * i & 255) << BITS * i for i in range(ORDER + 1))
            self._orders[k] = []
            for order in range(ORDER + 1):
                code, at = np.unique(wide & (1 << BITS * (order + 1)) - 1, return_inverse=True)
                seen = np.bincount(at, weights=n, minlength=len(code))
                context, at, distinct = np.unique(code >> BITS, return_inverse=True, return_counts=True)
                self._orders[k].append((code, seen, context, np.bincount(at, weights=seen, minlength=len(context)), distinct))
        return self._orders[k]

    def _costs(self, levels: list[tuple], k: int) -> np.ndarray:
        """Cost in language k of each code of the longest order. levels: codes of each order, and the place of each in the order below."""
        p = np.full(1, 1 / 256)
        for (code, below), (known, seen, contexts, total, distinct) in zip(levels, self._of(k)):
            lower = p[below]
            if not len(known):
                p = lower
                continue
            n, context = _found(known, code, seen), code >> BITS
            whole, several = _found(contexts, context, total), _found(contexts, context, distinct)
            all_ = np.maximum(whole + several, 1)
            p = np.where(whole > 0, np.where(n > 0, n / all_, lower * several / all_), lower)
        return np.minimum(np.rint(-np.log2(p) * UNIT), 65535).astype(np.int64)

    def _levels(self, code: np.ndarray) -> tuple[list[tuple], np.ndarray]:
        code, at = np.unique(code, return_inverse=True)
        levels = [code]
        for order in range(ORDER - 1, -1, -1):
            levels.insert(0, np.unique(levels[0] & (1 << BITS * (order + 1)) - 1))
        below = [np.zeros(len(levels[0]), np.int64)]
        for order in range(1, ORDER + 1):
            below.append(np.searchsorted(levels[order - 1], levels[order] & (1 << BITS * order) - 1))
        return list(zip(levels, below)), at

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code lengths, texts x languages, in 1/256 bit."""
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        pieces = ((i, t[max(at - ORDER, 0) : at + CHUNK], at) for i, t in enumerate(texts) for at in range(0, len(t), CHUNK))
        owner, codes, size = [], [], 0
        for i, piece, at in pieces:
            b = np.r_[np.full(0 if at else ORDER, START), np.frombuffer(piece, np.uint8)].astype(np.int64)  # of a later piece three bytes are its context
            codes.append(b[:-3] << 3 * BITS | b[1:-2] << 2 * BITS | b[2:-1] << BITS | b[3:])
            owner.append(i)
            size += len(codes[-1])
            if size >= CHUNK:
                self._add(out, owner, codes)
                owner, codes, size = [], [], 0
        self._add(out, owner, codes)
        return out

    def _add(self, out: np.ndarray, owner: list[int], codes: list[np.ndarray]) -> None:
        if not codes:
            return
        levels, at = self._levels(np.concatenate(codes))
        starts = np.cumsum([0, *map(len, codes[:-1])])
        for k in range(len(self.languages)):
            np.add.at(out[:, k], owner, np.add.reduceat(self._costs(levels, k)[at], starts))


def _found(known: np.ndarray, asked: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The value of each code that is known, else 0."""
    at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
    return np.where(known[at] == asked, value[at], 0)


def _grams(batches):
    """Counts of the four-byte strings of each language: (lang, gram, n)."""
    for batch in batches:
        by: dict[str, list[bytes]] = {}
        for lang, text in zip(values(batch.column(0)), values(batch.column(1))):
            by.setdefault(lang, []).append(text.encode("utf-8", "surrogatepass"))
        for lang, texts in by.items():
            parts = [np.zeros(0, np.uint32)]
            for t in texts:
                b = np.frombuffer(t, np.uint8).astype(np.uint32)
                if len(b) > ORDER:
                    parts.append(b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:])
            gram, n = np.unique(np.concatenate(parts), return_counts=True)
            yield [[lang] * len(gram), gram.astype(np.int64), n]


def fit(docs: DataFrame, settings: Settings = Settings()) -> Trees:
    known = docs.where((fold(F.col("doc_id"), 5) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    share = F.pmod(F.xxhash64("doc_id", "text", F.lit(settings.seed)), F.lit(1_000_000))
    limit = F.lit(0)
    for lang, n in sorted(counts.items()):
        limit = F.when(F.col("lang") == lang, int(min(1.0, settings.per_language / n) * 1_000_000)).otherwise(limit)
    grams = mapped(known.select("lang", "text", "doc_id").where(share < limit).select("lang", "text"), _grams, "lang string, gram long, n long")
    summed = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rows = stored(summed.groupBy("lang").applyInArrow(_packed, "lang string, gram binary, n binary"), "grams")
    seen = {r["lang"]: (np.frombuffer(r["gram"], np.uint32), np.frombuffer(r["n"], np.uint32)) for r in rows.toLocalIterator()}
    discard(rows)
    none = (np.zeros(0, np.uint32),) * 2
    return build(sorted(counts), [seen.get(x, none) for x in sorted(counts)], settings.table_bytes)


def _packed(table: pa.Table) -> pa.Table:
    """One row for the n-grams of a language, in order. There are at most as many as bytes in its sampled texts."""
    gram, n = table.column("gram").to_numpy(), table.column("n").to_numpy()
    order = np.argsort(gram)
    both = (gram[order].astype(np.uint32).tobytes(), np.minimum(n[order], 2**32 - 1).astype(np.uint32).tobytes())
    return pa.table({"lang": table.column("lang").slice(0, 1), "gram": pa.array([both[0]], pa.binary()), "n": pa.array([both[1]], pa.binary())})


def build(languages: list[str], grams: list[tuple[np.ndarray, np.ndarray]], table_bytes: int = Settings.table_bytes) -> Trees | Sorted:
    """Tables of the code lengths, if they fit; grams: for each language its four-byte strings in order, and their counts."""
    used = np.zeros(256, bool)
    for gram, _ in grams:
        for shift in (24, 16, 8, 0):
            used[gram >> shift & 255] = True
    contexts = np.unique(np.concatenate([np.zeros(0, np.uint32), *[np.unique(gram >> 8) for gram, _ in grams]]))
    size = int(used.sum()) + 1
    if 2 * (len(contexts) + size * size + size) * size * len(languages) + 4 * size**3 > table_bytes:
        return Sorted(languages, grams)
    return tabulate(languages, grams, used)


def tabulate(languages: list[str], grams: list[tuple[np.ndarray, np.ndarray]], used: np.ndarray) -> Trees:
    """Tabulates the code lengths. The counts of shorter contexts are sums over the longer ones."""
    classes = np.zeros(256, np.int16)
    classes[used] = np.arange(1, used.sum() + 1)
    size = int(used.sum()) + 1
    each = []
    for gram, n in grams:
        a, b, c, d = (classes[gram >> s & 255].astype(np.int64) for s in (24, 16, 8, 0))
        each.append((c, b * size + c, (a * size + b) * size + c, d, n.astype(np.float64)))
    seen = np.unique(np.concatenate([np.zeros(0, np.int64), *[x[2] for x in each]]))
    # rows of the table: contexts of three bytes, of two, of one
    contexts = np.tile(np.arange(size * size, dtype=np.int32) + len(seen), size)
    contexts[seen] = np.arange(len(seen))
    table = np.zeros((len(seen) + size * size + size, size, len(languages)), np.uint16)
    for k, (c, pair, context, d, w) in enumerate(each):
        orders = [np.full((1, size), 1 / 256)]
        for key, rows in ((np.zeros(len(c), np.int64), 1), (c, size), (pair, size * size)):
            lower = orders[-1]
            orders.append(_blend(np.bincount(key * size + d, weights=w, minlength=rows * size).reshape(rows, size), np.tile(lower, (rows // len(lower), 1))))
        counts = np.bincount(np.searchsorted(seen, context) * size + d, weights=w, minlength=len(seen) * size).reshape(len(seen), size)
        full = _blend(counts, orders[3][seen % (size * size)])
        table[:, :, k] = np.minimum(np.rint(-np.log2(np.concatenate([full, orders[3], orders[2]])) * UNIT), 65535)
    return Trees(languages, classes, contexts, table)


def _blend(counts: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Probabilities after each context by escape method C, from those of the shorter context."""
    total = counts.sum(axis=1, keepdims=True)
    distinct = (counts > 0).sum(axis=1, keepdims=True)
    whole = np.maximum(total + distinct, 1)
    out = np.where(counts > 0, counts / whole, lower * distinct / whole)
    return np.where(total > 0, out, lower)


def predict(model: Trees | Sorted, texts: list[str | None]) -> tuple[list[str], list[float]]:
    lettered = [t is not None and any(map(str.isalpha, t)) and bool(model.languages) for t in texts]
    lengths = model.lengths([t.encode("utf-8", "surrogatepass") for t, ok in zip(texts, lettered) if ok])
    names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if len(lengths):
        best = lengths.argmin(axis=1)
        sure = 1 / np.exp2(np.maximum((lengths.min(axis=1, keepdims=True) - lengths) / UNIT, -1000)).sum(axis=1)
        for i, j, s in zip(np.flatnonzero(lettered), best, sure):
            names[i], scores[i] = model.languages[j], float(s)
    return names, scores


def _predictions(shared, batches):
    model = shared.value
    for batch in batches:
        texts, size, at = [], 0, 0
        for i, t in enumerate(values(batch.column(1))):
            texts.append(t)
            size += len(t or "")
            if size >= CHUNK or i + 1 == batch.num_rows:
                yield [batch.column(0).slice(at, len(texts)), *predict(model, texts)]
                texts, size, at = [], 0, i + 1


def languages(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, settings))
    held = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    found = mapped(docs.select("doc_id", "text"), partial(_predictions, model), "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")
