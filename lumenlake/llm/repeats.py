"""Exact removal of long repeated byte strings by run-length indexes.

A byte goes if a string of LENGTH bytes that covers it also starts anywhere else in the corpus.

1. Every LENGTH-byte window is keyed by the smallest hash of its KMER-byte strings. Equal windows
   have equal keys, and neighbouring windows mostly share one, so a text becomes runs of windows,
   about one for every 185 bytes: (key, place, windows, hash of the bytes they cover).
2. Runs of one key that cover identical bytes are repeats as they stand, however many there
   are: they are counted, never paired. A key with one run is no repeat (a run that repeats
   within itself is seen on the spot).
3. For keys whose runs differ, one run of each kind is asked for. A window holds the SIDE bytes
   before the key's string or the SIDE bytes after it, so each run is two parts, keyed by the
   string with either side, and a part that is alone with its key asks for nothing. Whole keys
   are put together to about CHUNK bytes, and a run-length index is built of them: suffix array, Burrows-Wheeler
   transform, its runs, and samples at the run ends only: the text place and the longest common
   prefix with the neighbour across the run's border. Elsewhere the prefix of a place is that of
   the place before it less one, so a single stream over the text gives each place's longest
   match elsewhere (its matching statistic), towards both neighbours. Places where it reaches
   LENGTH are starts of repeated strings. The texts that are streamed are those that the index is
   of; there is no backward search of other texts.
4. A key whose kinds have more than Settings.largest bytes, as those around a very common passage,
   is split before it is indexed: its windows by where they lie about the key's string (the first in the
   window, where it occurs more than once), STEP places together, each part keyed by the bytes that all of
   its windows share. Parts that a run itself repeats, as where a line is said over and over, are told
   once: their windows are known to repeat (1.). Within the passage the parts are
   identical and are counted (2.), outside they are alone; those across its ends are
   indexed, or, if they are too many again, split into single windows, which are either identical or
   different. So no index is larger than about Settings.largest bytes, and no key is one task's.
5. Starts are gathered by text and the bytes they cover removed.

Shuffled are runs (some forty bytes each) and the bytes of runs that differ. Texts stay where they
were first written, compressed, and what is asked of them, or removed, is brought to them. All
joins are planned as sort-merge joins, as every side grows with the corpus.

Hashes decide which strings are compared: 64 bits for a key with 64 of the bytes covered (128 bits
in all for identical runs and windows); where runs differ, bytes are compared.

Edge cases: null texts are empty; texts shorter than LENGTH lose nothing; a text that repeats
itself loses the repeats; repeated rows are each other's copies; null ids come back as null.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.common import beside, discard, mapped, stored, stored_in_parts, values

LENGTH = 400
KMER = 32
SPAN = LENGTH - KMER + 1
#: Every window holds this many bytes before its smallest string, or after it.
SIDE = (LENGTH - KMER) // 2
#: Windows hashed at a time; bytes in an index.
BLOCK, CHUNK = 1 << 18, 1 << 19
#: Places of windows that are taken together where a large key is split.
STEP = 24
#: Most symbols packed for the first sort of an index.
FIRST = 5
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@dataclass(frozen=True)
class Settings:
    """largest: bytes of one key that go into an index together."""

    largest: int = CHUNK


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (in place)."""
    x ^= x >> np.uint64(30)
    x *= _M2
    x ^= x >> np.uint64(27)
    x *= _M3
    x ^= x >> np.uint64(31)
    return x


def rolling(data: np.ndarray, size: int, base: np.uint64 = _M1) -> np.ndarray:
    """A hash of each substring of the given size, by doubling; hashes of different bases are independent."""
    n = len(data) - size + 1
    table = mix(np.arange(1, 257, dtype=np.uint64) * base)
    power, factor, width = table[data], base, 1
    done, out = 0, None
    left = size
    while left:
        if left & 1:
            if out is None:
                out, done = power.copy(), width
            else:
                m = len(data) - done - width + 1
                out = out[:m] * factor + power[done : done + m]
                done += width
        left >>= 1
        if left:
            m = len(power) - width
            power = power[:m] * factor + power[width:]
            factor = factor * factor
            width *= 2
    return out[:n]


def sliding(x: np.ndarray, span: int, f, pad) -> np.ndarray:
    """f over each full span of x, by prefixes and suffixes of blocks."""
    n = len(x) - span + 1
    rows = -(-len(x) // span)
    full = np.full(rows * span, pad, x.dtype)
    full[: len(x)] = x
    full = full.reshape(rows, span)
    ahead = f.accumulate(full, axis=1).ravel()
    back = f.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(back[:n], ahead[span - 1 : span - 1 + n])


def runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key, first window, windows, and the place of the key's string (-1 if it occurs more than once) of each run."""
    with np.errstate(over="ignore"):
        h = mix(rolling(data, KMER))
    low = sliding(h, SPAN, np.minimum, np.uint64(0xFFFFFFFFFFFFFFFF))
    start = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
    n = np.diff(np.r_[start, len(low)])
    key = low[start]
    # places whose hash is the smallest of some window
    padded = np.concatenate([np.zeros(SPAN - 1, np.uint64), low, np.zeros(SPAN - 1, np.uint64)])
    chosen = np.flatnonzero(sliding(padded, SPAN, np.maximum, np.uint64(0)) == h)
    a, b = np.searchsorted(chosen, start), np.searchsorted(chosen, start + n - 1 + SPAN)
    size = b - a
    owner = np.repeat(np.arange(len(start)), size)
    place = chosen[np.arange(len(owner)) + np.repeat(a - np.cumsum(size) + size, size)]
    hit = h[place] == key[owner]
    owner, place = owner[hit], place[hit]
    only = np.full(len(start), -1)
    only[owner] = place
    only[np.bincount(owner, minlength=len(start)) > 1] = -1
    return key, start, n, only


def within(data: np.ndarray) -> np.ndarray:
    """The windows of a short text that occur in it more than once: equal by 128 bits, two hashes of different bases."""
    with np.errstate(over="ignore"):
        h, g = mix(rolling(data, LENGTH)), rolling(data, LENGTH, _M3)
    order = np.lexsort([g, h])
    same = (h[order[1:]] == h[order[:-1]]) & (g[order[1:]] == g[order[:-1]])
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return np.flatnonzero(twice)


def ranges(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted places as (first, number) of consecutive ones."""
    if not len(places):
        return places, places
    start = np.flatnonzero(np.r_[True, np.diff(places) != 1])
    return places[start], np.diff(np.r_[start, len(places)])


RUNS = "rid long, h long, at long, n long, c long, p long, l int, r int"


def _packed(batches):
    """Texts as compressed UTF-8, for what is stored and shuffled."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        yield [batch.column(0), batch.column(1), [pack((t or "").encode("utf-8", "surrogatepass")) for t in values(batch.column(2))]]


def _unpack(body: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(body)


def _rows(batch: pa.RecordBatch):
    return (tuple(c[i].as_py() for c in batch.columns) for i in range(batch.num_rows))


def _part(raw: bytes, low: int, out: list[list]) -> None:
    """Adds the runs of the windows from low on, at most BLOCK of them, to the columns of RUNS."""
    digest = xxhash.xxh3_64_intdigest
    part = np.frombuffer(raw, np.uint8, min(BLOCK + LENGTH - 1, len(raw) - low), low)
    view = memoryview(part)
    key, start, n, only = runs(part)
    first, last = start.tolist(), (start + n - 1).tolist()
    for h, i, j, p in zip(key.view(np.int64).tolist(), first, last, only.tolist()):
        c = digest(view[i : j + LENGTH])
        out[0].append(h)
        out[1].append(i + low)
        out[2].append(j - i + 1)
        out[3].append(c - (1 << 64) if c >> 63 else c)
        single = p >= 0
        out[4].append(p + low if single else None)
        out[5].append(digest(view[p - SIDE : p + KMER]) & 0x7FFFFFFF if single and i <= p - SIDE else None)
        out[6].append(digest(view[p : p + KMER + SIDE], 1) & 0x7FFFFFFF if single and j > p - SIDE else None)
        if not single:  # it may repeat itself
            for a, m in zip(*map(np.ndarray.tolist, ranges(within(part[i : j + LENGTH])))):
                for column, x in zip(out, (0, a + i + low, m, None, None, None, None)):
                    column.append(x)


def _runs(batches):
    """Rows with a null c are windows that the text itself repeats."""
    for batch in batches:
        rids: list[int] = []
        out: list[list] = [[] for _ in range(7)]
        for rid, body in _rows(batch):
            raw = _unpack(body)
            for low in range(0, len(raw) - LENGTH + 1, BLOCK):
                _part(raw, low, out)
                rids += [rid] * (len(out[0]) - len(rids))
            if len(rids) > 50_000:
                yield [rids, *out]
                rids, out = [], [[] for _ in range(7)]
        yield [rids, *out]


@dataclass(frozen=True)
class RunLengthIndex:
    """The run-compressed transform of a text: characters and starts of the runs, and for each border
    between runs the text places on its two sides and their longest common prefix."""

    symbols: np.ndarray
    starts: np.ndarray
    before: np.ndarray
    after: np.ndarray
    common: np.ndarray
    size: int

    @classmethod
    def build(cls, text: np.ndarray) -> RunLengthIndex:
        """text: numbers from 0; separators should be larger and each its own."""
        n = len(text)
        # ranks of the first symbols, packed; a rank is the place of the first of its equals
        bits = int(text.max() + 1).bit_length()
        packed = min(FIRST, 62 // bits)
        code = np.zeros(n, np.int64)
        for k in range(packed):
            code <<= bits
            code[: max(n - k, 0)] += text[k:]
            code[: max(n - k, 0)] += 1
        order = np.argsort(code).astype(np.int32)
        code = code[order]
        levels, width = [], packed
        rank, open_ = cls._ranked(code, order, np.zeros(n, np.int32), np.zeros(n, np.int32))
        del code, order
        while True:
            levels.append(rank)
            if not len(open_):
                break
            # only suffixes that have equals so far are sorted on
            pair = rank[open_].astype(np.int64) * (n + 1)
            inside = open_ + width < n
            pair[inside] += rank[open_[inside] + width] + 1
            by = np.argsort(pair)
            place = open_[by]
            rank, open_ = cls._ranked(pair[by], place, rank[place], rank)
            width *= 2
        order = np.empty(n, np.int32)
        order[rank] = np.arange(n, dtype=np.int32)
        bwt = text[order - 1]
        head = np.flatnonzero(np.r_[True, bwt[1:] != bwt[:-1]])
        border = head[1:]
        a, b = order[border - 1], order[border]
        i, j, common = a.astype(np.int64), b.astype(np.int64), np.zeros(len(a), np.int64)
        for level, step in [(x, packed << k) for k, x in reversed(list(enumerate(levels)))] + [(text, 1)] * (packed - 1):
            inside = np.flatnonzero((i < n) & (j < n))
            same = inside[level[i[inside]] == level[j[inside]]]
            i[same] += step
            j[same] += step
            common[same] += step
        return cls(bwt[head], head, a, b, common, n)

    @staticmethod
    def _ranked(key: np.ndarray, place: np.ndarray, group: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks after sorting by key the suffixes at the places, all of whole groups of equals that begin
        at the ranks in group; and the places that still have equals."""
        n = len(key)
        new = np.r_[True, key[1:] != key[:-1]]
        first = np.flatnonzero(new)
        of_group = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        own = np.repeat(first.astype(np.int32), np.diff(np.r_[first, n]))
        own -= np.repeat(of_group.astype(np.int32), np.diff(np.r_[of_group, n]))
        rank = rank.copy()
        rank[place] = own + group
        alone = new & np.r_[new[1:], True]
        return rank, place[~alone]

    def statistics(self) -> np.ndarray:
        """For each place, the length of the longest string from there that also starts elsewhere."""
        best = np.zeros(self.size, np.int64)
        for place in (self.before, self.after):
            reach = np.zeros(self.size, np.int64)
            np.maximum.at(reach, place, self.common + place)
            best = np.maximum(best, np.maximum.accumulate(reach) - np.arange(self.size))
        return best


def marks(bodies: list[bytes]) -> list[np.ndarray]:
    """The windows of each body that start a string of LENGTH bytes found elsewhere in the bodies."""
    sizes = np.array([len(b) for b in bodies])
    ends = np.cumsum(sizes + 1) - 1
    text = np.empty(int(sizes.sum() + len(bodies)), np.int32)
    mask = np.ones(len(text), bool)
    mask[ends] = False
    text[mask] = np.frombuffer(b"".join(bodies), np.uint8)
    text[ends] = 256 + np.arange(len(bodies), dtype=np.int32)
    long = np.flatnonzero(RunLengthIndex.build(text).statistics() >= LENGTH)
    cut = np.searchsorted(long, np.r_[ends - sizes, len(text)])
    return [long[cut[i] : cut[i + 1]] - (ends[i] - sizes[i]) for i in range(len(bodies))]


def _bodies(batches):
    """Cuts the asked windows out of the texts: rid, body, asks -> key, alone, rid, at, bytes."""
    for batch in batches:
        out: list[tuple] = []
        for rid, body, asks in _rows(batch):
            raw = _unpack(body)
            out += [(x["key"], x["alone"], rid, x["at"], raw[x["at"] : x["at"] + x["n"] + LENGTH - 1]) for x in asks]
            if len(out) > 5000:
                yield [list(x) for x in zip(*out)]
                out = []
        if out:
            yield [list(x) for x in zip(*out)]


def anchors(data: np.ndarray, key: int) -> list[int]:
    """The places of the strings of KMER bytes whose hash is the key."""
    with np.errstate(over="ignore"):
        return np.flatnonzero(mix(rolling(data, KMER)).view(np.int64) == key).tolist()


def _placed(x: dict, view: memoryview):
    """An ask's windows as (first, end, place of the key's string): of the first one in each window."""
    at, end = x["at"], x["at"] + x["n"]
    if x["p"] is not None:
        yield at, end, x["p"]
        return
    low = at
    for p in anchors(np.frombuffer(view[at : end + LENGTH - 1], np.uint8), x["key"]):
        if low < end:
            yield low, min(end, p + at + 1), p + at
            low = p + at + 1


def _pieces(step: int, batches):
    """The asked windows in pieces of step places: rid, body, asks -> key, c, alone, rid, at, n, p. A piece's
    key is of the bytes that its windows share; one window's is of its bytes. Pieces that are equal within
    an ask make one row, which is not alone: the text is known to repeat their windows."""
    digest = xxhash.xxh3_64_intdigest
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    for batch in batches:
        out: list[list] = [[] for _ in range(7)]
        for rid, body, asks in _rows(batch):
            view = memoryview(_unpack(body))
            for x in asks:
                made: dict[tuple[int, int], list] = {}
                for at, end, p in _placed(x, view):
                    first = p - (SPAN - 1)
                    for low in range(first + (at - first) // step * step, end, step):
                        a, b = max(at, low), min(end, low + step)
                        key = digest(view[low + step - 1 : low + LENGTH], low - first if step > 1 else 0)
                        row = made.setdefault((key, digest(view[a : b - 1 + LENGTH], 1)), [x["alone"], rid, a, b - a, p])
                        if row[2] != a:
                            row[0] = False
                for (key, c), row in made.items():
                    for column, v in zip(out, (signed(key), signed(c), *row)):
                        column.append(v)
                if len(out[0]) > 20_000:
                    yield out
                    out = [[] for _ in range(7)]
        yield out


def _indexed(batches):
    """Rows sorted by key, in whole keys a partition -> marks of those that stand alone."""
    rows: list[tuple] = []
    size, key = 0, None

    def found():
        out: list[list] = [[], [], []]
        for (alone, rid, at, _), places in zip(rows, marks([r[3] for r in rows])):
            if alone:
                first, n = ranges(places)
                out[0] += [rid] * len(first)
                out[1] += (first + at).tolist()
                out[2] += n.tolist()
        return out

    for batch in batches:
        for h, *row in _rows(batch):
            if h != key and size >= CHUNK:
                yield found()
                rows, size = [], 0
            key = h
            rows.append(tuple(row))
            size += len(row[3])
    if rows:
        yield found()


def _removed(batches):
    for batch in batches:
        out: list[tuple] = []
        for doc_id, body, first, n in _rows(batch):
            raw = _unpack(body)
            spans: list[list[int]] = []
            for a, b in sorted((s, s + m - 1 + LENGTH) for s, m in zip(first or (), n or ())):
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], b)
                else:
                    spans.append([a, b])
            kept, at = hashlib.sha256(), 0
            for a, b in spans:
                kept.update(raw[at:a])
                at = b
            kept.update(raw[at:])
            out.append((doc_id, len(raw), sum(b - a for a, b in spans), len(spans), kept.hexdigest()))
        yield [list(x) for x in zip(*out)] if out else [[]] * 5


ASK = ("key", "alone", "at", "n", "p")
BODIES = "key long, alone boolean, rid long, at long, body binary"
PIECES = "key long, c long, alone boolean, rid long, at long, n long, p long"


def asked(kinds: DataFrame) -> DataFrame:
    """rid and ASK: the windows to compare, of runs whose key has different runs. kinds: a row for each h and
    c with their number k, one of them, and often, whether any run of the key has its string more than
    once (then the key is not split by sides)."""
    end, cut = F.col("at") + F.col("n"), F.col("p") - (SIDE - 1)
    no = F.lit(None).cast("long")
    whole = F.struct(F.col("h").alias("key"), F.col("at"), F.col("n"), no.alias("p"))
    low = F.struct(F.xxhash64("h", F.lit(0), "l").alias("key"), F.col("at"), (F.least(end, cut) - F.col("at")).alias("n"), F.col("p"))
    high = F.struct(F.xxhash64("h", F.lit(1), "r").alias("key"), F.greatest("at", cut).alias("at"), (end - F.greatest("at", cut)).alias("n"), F.col("p"))
    parts = F.when(F.col("often"), F.array(whole)).otherwise(F.filter(F.array(F.when(F.col("l").isNotNull(), low), F.when(F.col("r").isNotNull(), high)), lambda x: x.isNotNull()))
    flat = kinds.select("k", "often", "one.*", "h")
    return flat.select((F.col("k") == 1).alias("alone"), "rid", F.explode(parts).alias("x")).select("rid", "x.key", "alone", "x.at", "x.n", "x.p")


def _wanted(asks: DataFrame, met: DataFrame) -> DataFrame:
    return asks.join(met.hint("merge"), "key", "left_semi")


def _dealt(texts: DataFrame) -> DataFrame:
    """The repeats among the asked windows of texts, by one index after the other for each partition of keys."""
    bodies = mapped(texts.select("rid", "body", "asks"), _bodies, BODIES)
    return mapped(bodies.repartition("key").sortWithinPartitions("key"), _indexed, "rid long, at long, n long")


def compared(asks: DataFrame, rows: DataFrame, settings: Settings) -> list[DataFrame]:
    """rid, at, n of the asked windows that are alone but repeat, in stored tables. asks is used up."""
    out, step = [], STEP
    gather = F.collect_list(F.struct(*ASK))  # of one text
    while True:
        of_key = asks.groupBy("key").agg(F.count("*").alias("k"), F.max("alone").alias("any"), F.sum(F.col("n") + LENGTH - 1).alias("bytes"))
        met = stored(of_key.where("k > 1 AND any").select("key", (F.col("bytes") > settings.largest).alias("large")), "met")
        out.append(beside(rows, _wanted(asks, met.where("NOT large")), "inner", "repeats", _dealt, asks=gather))
        if not met.where("large").limit(1).count():
            discard(met, asks)
            return out
        cut = partial(_pieces, step)
        pieces = beside(rows, _wanted(asks, met.where("large")), "inner", "pieces", lambda j: mapped(j.select("rid", "body", "asks"), cut, PIECES), asks=gather)  # noqa: B023
        discard(met, asks)
        kinds = stored(pieces.groupBy("key", "c").agg(F.count("*").alias("k"), F.max("alone").alias("any"), F.min(F.struct("rid", "at", "n", "p")).alias("one")), "kinds")
        same = kinds.where("k > 1 AND any").select("key", "c")
        out.append(stored(pieces.where("alone").join(same.hint("merge"), ["key", "c"], "left_semi").select("rid", "at", "n"), "repeats"))
        if step == 1:
            discard(pieces, kinds)
            return out
        left = kinds.select("key", ((F.col("k") == 1) & F.col("any")).alias("alone"), "one.*").select("rid", *ASK)
        asks, step = stored(left, "asked"), 1
        discard(pieces, kinds)


def starts(rows: DataFrame, settings: Settings = Settings()) -> list[DataFrame]:
    """rid, at, n: the windows that are found elsewhere, as ranges, in stored tables. rows: rid and body."""
    found = stored(mapped(rows.select("rid", "body"), _runs, RUNS), "runs")
    keyed = found.where("c IS NOT NULL")
    out = [stored(found.where("c IS NULL").select("rid", "at", "n"), "repeats")]
    often = F.max(F.col("p").isNull()).alias("often")
    of_key = keyed.groupBy("h").agg(F.count("*").alias("k"), (F.min("c") != F.max("c")).alias("differ"), often)
    again = stored(of_key.where("k > 1").drop("k"), "again")
    shared = stored(keyed.join(again.hint("merge"), "h"), "shared")
    discard(found, again)
    alike, other = shared.where("NOT differ"), shared.where("differ")
    one = F.min(F.struct("rid", "at", "n", "p", "l", "r")).alias("one")
    kinds = stored(other.groupBy("h", "c").agg(F.count("*").alias("k"), F.max("often").alias("often"), one), "kinds")
    twice = kinds.where("k > 1").select("h", "c")
    out.append(stored(alike.select("rid", "at", "n").unionByName(other.join(twice.hint("merge"), ["h", "c"], "left_semi").select("rid", "at", "n")), "repeats"))
    asks = stored(asked(kinds).select("rid", *ASK), "asked")
    discard(shared, kinds)
    return out + compared(asks, rows, settings)


def without_repeats(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    rows = stored_in_parts(mapped(rows, _packed, "rid long, doc_id long, body binary"), "rows")
    tables = starts(rows, settings)
    every = tables[0]
    for more in tables[1:]:
        every = every.unionByName(more)
    columns = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    lists = {"first": F.collect_list("at"), "n": F.collect_list("n")}  # of one text
    out = beside(rows, every, "left", "result", lambda j: mapped(j.select("doc_id", "body", "first", "n"), _removed, columns), **lists)
    discard(rows, *tables)
    return out
