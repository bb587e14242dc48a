"""Sequence packing by non-negative least squares on the length histogram.

Each document becomes its token ids and one end id. What fills a whole window is cut off; the
rest, shorter than a window, is a piece. Piece lengths are counted in BIN-token steps (at most
WINDOW / BIN numbers, whatever the corpus). All combinations of up to DEPTH lengths that fill a
window are enumerated, and non-negative least squares solves how often to repeat each so that
together they use up the histogram. Pieces are dealt evenly over shards of about
Settings.shard pieces; each shard rounds its share of the repeat counts, fills the planned
sequences (the last place of each by the longest piece that still fits), and packs what remains
greedily, longest first. Only pieces (a few numbers each) are shuffled, never token ids, and the
shards are even by construction, so no document, length or source makes a large task.

A chunk between spaces is tokenized alone and cached, which is exact for a tokenizer whose
pre-tokenizer drops white space and never reaches over it, as this one's (a file whose ids of PROBE differ
is given whole texts instead); array("I") is
little-endian wherever Spark runs on x86 or ARM.

Edge cases: a null or empty text is its end id only; null and repeated ids are packed as rows of
their own; a text of any length is cut; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.common import mapped, stored, values

END = 2
BIN = 32
DEPTH = 3
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: Cached chunks are at most this long; this many chunks, and parts of them, are kept.
CHUNK, CACHE, PARTS = 64, 250_000, 500_000


@dataclass(frozen=True)
class Settings:
    window: int = 4096
    shard: int = 4000
    tokenizer: str = ""

    def path(self) -> str:
        if self.tokenizer:
            return self.tokenizer
        import public_tokenizers

        return public_tokenizers.path("word_bpe_49k.json")


#: Fixed values of the tokenizer: letters, numbers and white space up to U+024F, and its contractions.
_L, _N, _S = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be", "\t-\r \x85\xa0"
_PRE = re.compile(rf"'(?:[sStTmMdD]|[rR][eE]|[vV][eE]|[lL][lL])|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")
#: What the short way leaves to the tokenizer: other scripts and marks, a letter that lowers to two
#: characters, and special tokens.
_OTHER = re.compile("[^\\x00-\u024f]|\u0130|<\\|(?:start|end)oftext\\|>")


#: What a file must agree on with the short way: cases, contractions, digits, symbols, spaces, special tokens.
PROBE = "Don't THEY'LL re-do 3.14% of \u00c9t\u00e9?  naïve\tstraße\r\n\n  #tag_x (a+b)*c\xa0\u4e2d\u6587 <|endoftext|> x" + " it's 12 o'clock"


def byte_letters() -> list[str]:
    """The character for each byte in byte-level vocabularies: printable ones stand for themselves,
    the others for the characters from U+0100 on, in order."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b if b in kept else spare))
        spare += b not in kept
    return out


class Encoder:
    """Token ids of whole texts, as little-endian unsigned 32-bit bytes. Chunks between spaces, and
    within them the pre-tokenizer's parts, are looked up in caches; parts not seen yet go to the
    tokenizer's merge model, and texts beyond Latin letters to the whole tokenizer by chunk."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.letters = byte_letters()
        self.chunks: dict[str, bytes] = {"": b""}
        self.parts: dict[str, bytes] = {}
        self.short = True
        try:
            self.short = self.ids(PROBE) == self._whole(PROBE)
        except Exception:  # a model without merges of this kind
            self.short = False

    def _part(self, part: str) -> bytes:
        low = part.lower()
        found = self.parts.get(low)
        if found is None:
            spelled = low if low.isascii() and low.isalnum() else "".join([self.letters[b] for b in low.encode()])
            found = array("I", [t.id for t in self.merge(spelled)]).tobytes()
            if len(low) <= CHUNK:
                self.parts[low] = found
        return found

    def _whole(self, chunk: str) -> bytes:
        return array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()

    def ids(self, text: str) -> bytes:
        if not self.short:
            return self._whole(text)
        if len(self.chunks) > CACHE:
            self.chunks = {"": b""}
        if len(self.parts) > PARTS:
            self.parts = {}
        chunks, known = text.replace("\n", " ").split(" "), self.chunks
        fresh = [c for c in set(chunks) if c not in known]
        if not fresh:
            return b"".join([known[c] for c in chunks])
        if _OTHER.search(text):
            new = {c: self._whole(c) if _OTHER.search(c) else b"".join(map(self._part, _PRE.findall(c))) for c in fresh}
        else:
            new = {c: b"".join(map(self._part, _PRE.findall(c))) for c in fresh}
        if max(map(len, fresh)) <= CHUNK:
            known |= new
            return b"".join([known[c] for c in chunks])
        known.update((c, b) for c, b in new.items() if len(c) <= CHUNK)
        return b"".join([new[c] if c in new else known[c] for c in chunks])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _pieces(path: str, window: int, batches):
    encode = encoder(path).ids
    end = np.array([END], "<u4").tobytes()
    step = 4 * window
    for batch in batches:
        out: list[tuple] = []
        for doc_id, text in zip(values(batch.column(0)), values(batch.column(1))):
            data = (encode(text) if text else b"") + end
            n = len(data) // 4
            for at in range(0, len(data), step):
                part = data[at : at + step]
                out.append((doc_id, at // 4, len(part) // 4, zlib.crc32(part), n))
        yield [pa.array(x, pa.int64()) for x in zip(*out)] if out else [pa.array([], pa.int64())] * 5


def pieces(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    return mapped(docs.select("doc_id", "text"), partial(_pieces, settings.path(), settings.window), PIECES)


def combinations(bins: int, depth: int = DEPTH) -> np.ndarray:
    """All multisets of up to depth lengths 1..bins that sum to bins, one a row, as counts."""
    found: list[list[int]] = []

    def extend(parts: list[int], left: int):
        if left == 0:
            found.append(parts)
        elif len(parts) < depth:
            for x in range(parts[-1] if parts else 1, left + 1):
                if x == left or (len(parts) + 1 < depth and left - x >= x):
                    extend([*parts, x], left - x)

    extend([], bins)
    rows = np.zeros((len(found), bins + 1))
    for i, parts in enumerate(found):
        np.add.at(rows[i], parts, 1)
    return rows


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """argmin |a x - b| with x >= 0, by Lawson and Hanson's active sets."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    tolerance = 1e-9 * max(1.0, np.abs(b).max(initial=0.0))
    for _ in range(rounds):
        gradient = a.T @ (b - a @ x)
        gradient[active] = -np.inf
        j = int(gradient.argmax())
        if gradient[j] <= tolerance:
            break
        active[j] = True
        while True:
            s = np.zeros(n)
            s[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            if (s[active] > 0).all():
                x = s
                break
            bad = active & (s <= 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                x = x + np.min(x[bad] / (x[bad] - s[bad])) * (s - x)
            active &= x > tolerance
            x[~active] = 0
            if not active.any():
                return x
    return x


def plan(histogram: dict[int, int], window: int) -> list[tuple[list[int], float]]:
    """(lengths in bins, longest first; repeats for each piece of the corpus) of each combination used."""
    total = sum(histogram.values())
    bins = window // BIN
    counts = np.zeros(bins + 1)
    for length, n in histogram.items():
        counts[-(-length // BIN)] += n
    if not total:
        return []
    mix = combinations(bins)
    repeats = nnls(mix.T, counts / total)
    order = sorted(np.flatnonzero(repeats), key=lambda i: (-int(np.flatnonzero(mix[i])[-1]), i))
    return [([b for b in range(bins, 0, -1) for _ in range(int(mix[i, b]))], float(repeats[i])) for i in order]


def pack(lengths: np.ndarray, planned: list[tuple[list[int], float]], window: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece of a shard."""
    stock: list[list[int]] = [[] for _ in range(window + 1)]
    for i in np.argsort(lengths, kind="stable")[::-1].tolist():
        stock[lengths[i]].append(i)
    have = 0  # bit n: a piece of length n is left
    for n, x in enumerate(stock):
        have |= bool(x) << n
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    number = 0

    def longest(room: int) -> int:
        """The longest length left that fits; -1 if none."""
        return (have & ((2 << room) - 1)).bit_length() - 1

    def put(n: int, used: int) -> int:
        nonlocal have
        i = stock[n].pop()
        if not stock[n]:
            have &= ~(1 << n)
        sequence[i], offset[i] = number, used
        return used + n

    def fill(used: int):
        while used < window and (n := longest(window - used)) > 0:
            used = put(n, used)

    for parts, share in planned:
        for _ in range(round(share * len(lengths))):
            used = 0
            for b in parts[:-1] or parts:
                n = longest(min(b * BIN, window - used))
                if n <= (b - 1) * BIN:  # none left in this bin
                    break
                used = put(n, used)
            if not used:
                break
            fill(used)
            number += 1
    while have:
        fill(0)
        number += 1
    return sequence, offset


def _shard(planned, window: int, table: pa.Table) -> pa.Table:
    lengths = table.column("length").to_numpy()
    order = np.lexsort([table.column(c).to_numpy() for c in ("ids_crc32", "start")] + [table.column("doc_id").fill_null(-1).to_numpy()])
    sequence, offset = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
    sequence[order], offset[order] = pack(lengths[order], planned, window)
    shard = table.column("shard").to_numpy()
    out = table.drop_columns("shard").append_column("sequence_id", pa.array(shard << 32 | sequence))
    return out.append_column("offset", pa.array(offset))


def packed(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Every piece of every document, with its sequence and its offset there."""
    cut = stored(pieces(docs, settings).withColumn("deal", F.monotonically_increasing_id()), "pieces")
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most one row a length
    planned = plan(histogram, settings.window)
    shards = max(1, -(-sum(histogram.values()) // settings.shard))
    # the numbers that deal pieces are in the stored table, so a repeated task deals alike
    dealt = cut.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.pmod(F.xxhash64("deal"), F.lit(shards)).cast("long").alias("shard"))

    def shard(rows: pa.Table) -> pa.Table:
        return _shard(planned, settings.window, rows)

    return dealt.groupBy("shard").applyInArrow(shard, f"{PIECES}, sequence_id long, offset long")
