"""Exact Jaccard join of documents' shingle sets by partitioning the universe of shingles.

A document is the set of its distinct 3-word shingles (A-Z lower-cased). Two sets of a and b shingles that share
100 |x & y| >= 90 |x | y| differ in at most H = (a + b) // 19 shingles, and the larger has at most 10/9 of the smaller's.

Candidates. Sizes fall into bands. The shingles of a set are dealt by hash to as many segments as its band needs: one
more than the differences that a set of the band and any larger partner can have, so that at least one segment of
such a pair is equal (pigeonhole). A set is indexed by its segments in its own band, and asks there and, if it
is small enough for partners in the band below, there too. A segment's key is the sum of its shingles' hashes, so a segment
with one shingle left out is a subtraction away.

Allocation. Segments that many sets share (an empty one, one of boilerplate) cost as many comparisons. The larger set
of a pair may leave out as many segments as its own size leaves over, and may leave out one more for each other segment
that it asks with its one-deletion neighbourhood: sums over segments of 0 (left out), 1 (equal) or 2 (one shingle
more or less) must reach H + 1. Each set proposes such an exchange where the cheapest segments' cost and its own shingles
cost less than the segment left out; a segment is left out where half of its sets propose it. If an exchange alone finds
a pair, both have the segment left out (else they would differ in more than H), so only the sets that have it
index their one-deletion neighbourhoods.

Verification is of the shingles themselves, of whole texts, which are fetched for sets in candidates only. First each
set is compared with one other, the leader that it meets in most segments, and components are made; then
only candidates of different components are, and of those only such whose 256-bit parities allow H differences
(each difference flips one bit, so more flipped bits than H are a proof): of each set and key one, and when the components of
these are made, all that are left. Sets of exactly equal shingles are one set throughout,
and those of up to 8 shingles have no other partner.

Edge cases: null, empty and blank texts have no shingles and are linked with nothing: component_id is their own
doc_id. One or two words are one shingle. A null doc_id gets the component_id of its component's others (null if
there is none). Repeated rows come back as often as they came; an empty table gives an empty result; other columns
are not looked at.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import OrderedDict
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.common import discard, mapped, stored, values
from lumenlake.llm.simhash import components

SHINGLE = 3
#: The smallest set that can be linked with another one: 9 of 10.
LEAST = 9
#: Sets of a key that meet in one place, and comparisons that are made at a time.
HOT, STRIP = 4096, 1 << 19
#: Bits of the filter that tells which texts to fetch: 16 for each text, at most so many.
FETCH_BITS = 1 << 27


@dataclass(frozen=True)
class Settings:
    """costly: sets that share a segment from which on it may be left out; weight: comparisons that a key of a
    one-deletion neighbourhood is worth."""

    costly: int = 128
    weight: float = 1.0


_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def shingles(text: str | None) -> set[bytes]:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) < SHINGLE:
        return {b" ".join(words)} if words else set()
    return set(map(b" ".join, zip(words, words[1:], words[2:])))


def linked(x: set, y: set) -> bool:
    both = len(x & y)
    return 100 * both >= 90 * (len(x) + len(y) - both)


@lru_cache(maxsize=1)
def _bands() -> list[int]:
    """First sizes of the bands; each is over a third longer than the one below."""
    out = [LEAST]
    while out[-1] < 1 << 40:
        out.append(out[-1] * 1000 // 729 + 1)
    return out


def band(size: int) -> int:
    return bisect_right(_bands(), size) - 1


def segments(k: int) -> int:
    """Segments of band k: over the differences of its largest set and a partner of 10/9 of that."""
    return (_bands()[k + 1] - 1) // 9 + 1


def asks_below(size: int, k: int) -> bool:
    return k > 0 and 9 * size <= 10 * (_bands()[k] - 1)


def spare(size: int, k: int) -> int:
    """Segments of band k that a set may leave out when it asks for partners no larger than itself."""
    return segments(k) - ((size + min(size, _bands()[k + 1] - 1)) // 19 + 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    return x ^ (x >> np.uint64(27))


def _dealt(hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a set's hashes in band k: their segments, what each adds to its segment's sum, and the sums."""
    m = segments(k)
    at = ((hashes * _M1 >> np.uint64(33)) % np.uint64(m)).astype(np.int64)
    part = _mix(hashes + _M1)
    order = np.argsort(at, kind="stable")
    start = np.searchsorted(at[order], np.arange(m))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part[order], dtype=np.uint64)])
    ends = np.r_[start[1:], len(at)]
    return at, part, total[ends] - total[start]


def _key(k: int, at: np.ndarray, sums: np.ndarray, kind: int) -> np.ndarray:
    """Keys of contents of segments; kind 0: equal ones, 1: against those with one left out, 2: with one left out."""
    salt = np.uint64((k * 3 + kind) * 0x632BE59BD9B4E019 & (1 << 64) - 1)
    return _mix(_mix(sums + salt) + at.astype(np.uint64) * _M1).view(np.int64)


def hashes_of(found: set[bytes]) -> np.ndarray:
    digests = b"".join(map(xxhash.xxh3_64_digest, found))
    return np.sort(np.frombuffer(digests, ">u8").astype(np.uint64))


def _sets(batches):
    """doc_id, tid, n, sig (of the set), keys in the own band, keys in the band below, four words of parities."""
    for batch in batches:
        out = [[] for _ in range(5)]
        parity = np.zeros((batch.num_rows, 4), np.int64)
        for i, text in enumerate(values(batch.column(2))):
            found = shingles(text)
            n = len(found)
            h = hashes_of(found)
            own = below = None
            if n >= LEAST:
                k = band(n)
                own = _key(k, np.arange(segments(k)), _dealt(h, k)[2], 0)
                if asks_below(n, k):
                    below = _key(k - 1, np.arange(segments(k - 1)), _dealt(h, k - 1)[2], 0)
                parity[i] = np.packbits(np.bincount((h & np.uint64(255)).astype(np.int64), minlength=256) & 1).view(np.int64)
            for column, x in zip(out, (n, xxhash.xxh3_128_digest(h.tobytes()) if n else None, own, below, None)):
                column.append(x)
        lists = [pa.array(c, pa.list_(pa.int64())) for c in out[2:4]]
        yield [batch.column(0), batch.column(1), pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), *lists, *[pa.array(parity[:, j]) for j in range(4)]]


def _allocated(settings: Settings):
    """What each set proposes: rid, below, and the keys it would leave out."""

    def proposals(batches):
        for batch in batches:
            rid, n, below, listed = (c.to_pylist() for c in batch.columns)
            out = ([], [], [])
            for r, size, b, rows in zip(rid, n, below, listed):
                k = band(size) - b
                cost = sorted(((x["met"], x["key"], x["at"]) for x in rows), reverse=True)
                free = spare(size, k)
                single = segments(k) - len(cost)  # segments that no other set has
                cheap = [1] * single + [c for c, _, _ in reversed(cost)]
                gone = 0
                for met, key, _ in cost:
                    if met < settings.costly:
                        break
                    swaps = gone - free  # exchanges made so far, beyond what is spare
                    if swaps >= 0 and (gone + swaps + 2 > segments(k) or 2 * cheap[swaps] + settings.weight * size >= met):
                        break
                    gone += 1
                    for column, x in zip(out, (r, b, key)):
                        column.append(x)
            yield list(out)

    return proposals


def _neighbours(batches):
    """Rows (key, rid, asks, holds) of one-deletion neighbourhoods. Columns: rid, text, the segments that the
    set asks with their neighbourhoods in its own band and in the one below, and whether it has a segment left out."""
    for batch in batches:
        for rid, text, own, below in zip(*map(values, batch.columns)):
            h = hashes_of(shingles(zlib.decompress(text).decode("utf-8", "surrogatepass")))
            k = band(len(h))
            for b, wanted in ((0, own), (1, below)):
                if b and not wanted:
                    continue
                at, part, sums = _dealt(h, k - b)
                less = sums[at] - part
                out = []
                if not b:  # the own band's index: equal contents, and each with one left out
                    out += [(_key(k, np.arange(len(sums)), sums, 2), False), (_key(k, at, less, 1), False)]
                if wanted:
                    w = np.array(wanted, np.int64)
                    some = np.isin(at, w)
                    out += [(_key(k - b, w, sums[w], 1), True), (_key(k - b, at[some], less[some], 2), True)]
                for keys, asks in out:
                    yield [keys, np.full(len(keys), rid), np.full(len(keys), asks), np.full(len(keys), not asks)]


def _verified(batches):
    """Pairs (a, b) whose texts are linked."""
    last: OrderedDict[int, set] = OrderedDict()

    def of(rid, text):
        if rid in last:
            last.move_to_end(rid)
        else:
            last[rid] = shingles(zlib.decompress(text).decode("utf-8", "surrogatepass"))
            if len(last) > 32:
                last.popitem(last=False)
        return last[rid]

    for batch in batches:
        good = [(a, b) for a, b, x, y in zip(*map(values, batch.columns)) if linked(of(a, x), of(b, y))]
        yield [[a for a, _ in good], [b for _, b in good]]


class _Texts:
    """Fetches the compressed texts of sets from the documents."""

    def __init__(self, docs: DataFrame, sets: DataFrame):
        self.docs, self.sets = docs, sets

    def of(self, rids: DataFrame) -> DataFrame:
        """rid and text (compressed) of the given sets, stored. What is shuffled are the texts that pass a
        Bloom filter of bounded size over the wanted ones; the join decides."""
        wanted = stored(self.sets.join(rids.distinct(), "rid", "left_semi").select("rid", F.col("doc_id").alias("of_doc"), "tid"), "wanted")
        bits = min(FETCH_BITS, 1 << max(10, (16 * wanted.count()).bit_length()))
        place = F.explode(F.array(*[F.pmod(F.xxhash64("tid", F.lit(j)), F.lit(bits)) for j in range(4)])).alias("p")
        words = wanted.select(place).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b")).toArrow()  # bits / 64 rows at most
        table = np.zeros(bits // 64, np.uint64)
        table[np.asarray(words.column(0))] = np.asarray(words.column(1)).view(np.uint64)

        def passing(batches):
            for batch in batches:
                places = [np.asarray(c) for c in batch.columns[3:]]
                good = np.flatnonzero(np.all([table[p >> 6] >> (p & 63).astype(np.uint64) & np.uint64(1) for p in places], axis=0)) if batch.num_rows else []
                for i in range(0, len(good), 64):
                    part = batch.take(pa.array(good[i : i + 64], pa.int64()))
                    yield [part.column(0), part.column(1), [zlib.compress(t.encode("utf-8", "surrogatepass"), 1) for t in values(part.column(2))]]

        rows = self.docs.where("text IS NOT NULL").select("doc_id", _tid().alias("tid"), "text")
        rows = rows.select("*", *[F.pmod(F.xxhash64("tid", F.lit(j)), F.lit(bits)).alias(f"p{j}") for j in range(4)])
        found = mapped(rows, passing, "doc_id long, tid binary, text binary")
        same = (found.tid == wanted.tid) & found.doc_id.eqNullSafe(wanted.of_doc)
        out = stored(found.join(wanted, same).groupBy("rid").agg(F.first("text").alias("text")), "texts")
        discard(wanted)
        return out

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are linked, stored."""
        pairs = stored(pairs, "pairs")
        texts = self.of(pairs.select(F.explode(F.array("a", "b")).alias("rid")))
        x, y = (texts.select(F.col("rid").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
        both = pairs.join(x, "a").join(y, "b").select("a", "b", "text_a", "text_b")
        out = stored(mapped(both, _verified, "a long, b long"), "links")
        discard(pairs, texts)
        return out


def _tid():
    return F.unhex(F.md5("text"))


def _shared(rows: DataFrame) -> DataFrame:
    """rows (key, rid, asks, holds and more) of the keys that two sets or more have, of which one asks and another holds:
    with met, how many."""
    keys = rows.groupBy("key").agg(F.count("*").alias("met"), F.bool_or("asks").alias("any_asks"), F.bool_or("holds").alias("any_holds"))
    return rows.join(keys.where("met > 1 AND any_asks AND any_holds").select("key", "met"), "key")


def _exchanged(rows: DataFrame, sets: DataFrame, texts: _Texts, settings: Settings) -> DataFrame | None:
    """rows after cost-based allocation: left-out segments no longer ask, neighbourhoods are added; None where no
    segment is costly."""
    costly = rows.where(F.col("met") >= settings.costly)
    if not costly.limit(1).count():
        return None
    concerned = costly.select("rid", "below").distinct()
    each = rows.join(concerned, ["rid", "below"], "left_semi").groupBy("rid", "below").agg(F.collect_list(F.struct("met", "key", "at")).alias("listed"))  # a set's segments
    each = each.join(sets.select("rid", "n"), "rid").select("rid", "n", "below", "listed")
    proposed = stored(mapped(each, _allocated(settings), "rid long, below int, key long"), "proposed")
    votes = proposed.groupBy("key").agg(F.count("*").alias("votes"))
    out = stored(rows.select("key", "met").distinct().join(votes, "key").where("2 * votes >= met").select("key"), "out")
    gone = stored(proposed.join(out, "key", "left_semi"), "gone")
    discard(proposed)
    if not gone.limit(1).count():
        return None
    left = rows.join(gone.withColumn("gone", F.lit(True)), ["key", "rid", "below"], "left")
    plain = left.select("key", "rid", (F.col("asks") & F.col("gone").isNull()).alias("asks"), "holds")
    # each set's cheapest segments, as many as it leaves out beyond what it has spare
    members = rows.join(out, "key", "left_semi").select("rid").distinct()
    count = gone.groupBy("rid", "below").agg(F.count("*").alias("n_gone"))
    listed = left.where("gone IS NULL").groupBy("rid", "below").agg(F.collect_list(F.struct("met", "at")).alias("stay"))
    lost = left.where("gone").groupBy("rid", "below").agg(F.collect_list("at").alias("lost"))
    told = count.join(lost, ["rid", "below"]).join(listed, ["rid", "below"], "left").join(sets.select("rid", "n"), "rid").select("rid", "below", "n", "n_gone", "lost", "stay")

    def cheapest(batches):
        for batch in batches:
            out = ([], [], [])
            for rid, below, n, n_gone, lost, stay in zip(*(c.to_pylist() for c in batch.columns)):
                k = band(n) - below
                met = {x["at"]: x["met"] for x in stay or []}
                order = sorted((met.get(at, 1), at) for at in set(range(segments(k))) - set(lost))
                for column, x in zip(out, (rid, below, [at for _, at in order[: max(0, n_gone - spare(n, k))]])):
                    column.append(x)
            yield list(out)

    wanted = mapped(told, cheapest, "rid long, below int, wanted array<int>")
    wanted = wanted.groupBy("rid").agg(*[F.max(F.when(F.col("below") == b, F.col("wanted"))).alias(c) for b, c in ((0, "own"), (1, "lower"))])
    fetched = texts.of(members)
    near = mapped(fetched.join(wanted, "rid", "left").select("rid", "text", "own", "lower"), _neighbours, "key long, rid long, asks boolean, holds boolean")
    return stored(_shared(plain.unionByName(near)).select("key", "rid", "asks", "holds", "met"), "exchanged")


def _first_pairs(met: DataFrame) -> DataFrame:
    """For each set the leader that it meets in most keys. A key's leader is its set that meets most others in all its
    keys: of a family of edited copies the one that they are copies of, if it is there."""
    score = met.groupBy("rid").agg(F.sum("met").alias("score"))
    lead = met.join(score, "rid").groupBy("key").agg(F.max(F.struct("score", "rid"))["rid"].alias("lead"))
    tally = met.join(lead, "key").where("rid <> lead").groupBy("rid", "lead").agg(F.count("*").alias("keys"))
    return tally.groupBy(F.col("rid").alias("b")).agg(F.max_by("lead", F.struct("keys", "lead")).alias("a")).select("a", "b")


def _meeting(each: bool):
    """Candidate pairs within keys, whose rows come together and sorted; each: all of them, else of each set one. Columns:
    key, p, q, part, rid, root, n, asks, holds and the four words of parities; rows of part p meet those of part q."""

    def candidates(batches):
        kept = None
        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            kept = now if kept is None else [np.concatenate(x) for x in zip(kept, now)]
            if len(kept[0]) < 4096:
                continue
            last = np.flatnonzero(np.any([c[1:] != c[:-1] for c in kept[:3]], axis=0))
            if len(last):
                yield from found([c[: last[-1] + 1] for c in kept])
                kept = [c[last[-1] + 1 :] for c in kept]
        if kept is not None and len(kept[0]):
            yield from found(kept)

    def found(columns):
        key, p, q, part, rid, root, n, asks, holds, *words = columns
        words = [w.view(np.uint64) for w in words]
        start = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in columns[:3]], axis=0)])
        size = np.diff(np.r_[start, len(key)])

        def good(i, j):
            """Which of the rows i and j may be linked and lie in different components; the larger asks, of
            equal sizes either."""
            x, y = n[i], n[j]
            roles = ((x >= y) & asks[i] & holds[j]) | ((y >= x) & asks[j] & holds[i])
            some = roles & (root[i] != root[j]) & (9 * np.maximum(x, y) <= 10 * np.minimum(x, y))
            differ = sum(np.bitwise_count(w[i] ^ w[j]).astype(np.int64) for w in words)
            return some & (differ <= (x + y) // 19)

        two = start[(size == 2) & (p[start] == q[start])]
        two = two[good(two, two + 1)]
        pairs = [(rid[two], rid[two + 1])]
        for s, m in zip(start.tolist(), size.tolist()):
            if m == 1 or m == 2 and p[s] == q[s]:
                continue
            at = np.arange(s, s + m)
            left, right = (at, at) if p[s] == q[s] else (at[part[s : s + m] == p[s]], at[part[s : s + m] == q[s]])
            step = max(1, STRIP // max(1, len(right)))
            for k in range(0, len(left), step):
                i = left[k : k + step]
                near = good(i[:, None], right[None, :])
                if p[s] == q[s]:
                    near &= i[:, None] < right[None, :]
                if not each:
                    near &= near.cumsum(axis=1) == 1
                x, y = np.nonzero(near)
                pairs.append((rid[i[x]], rid[right[y]]))
        a, b = (np.concatenate(c) for c in zip(*pairs))
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
        yield [pairs[0], pairs[1]]

    return candidates


def _other_pairs(met: DataFrame, sets: DataFrame, roots: DataFrame, each: bool) -> DataFrame:
    """Candidates of different components, each once; with each unset at most one of each set and key. A key of more
    than HOT sets is dealt to parts, and each pair of parts is met by itself."""
    named = met.join(roots.select(F.col("node").alias("rid"), "root"), "rid", "left").select("key", "rid", "asks", "holds", F.coalesce("root", "rid").alias("root"))
    kinds = named.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.ceil(F.count("*") / HOT).cast("int").alias("parts")).where("x <> y").select("key", "parts")
    about = sets.select("rid", "n", *[f"s{j}" for j in range(4)])
    rows = named.join(kinds, "key").join(about, "rid").withColumn("part", F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("key", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "rid", "root", "n", "asks", "holds", "s0", "s1", "s2", "s3")
    dealt = rows.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
    return mapped(dealt, _meeting(each), "a long, b long").distinct()


def jaccard(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included)."""
    told = "doc_id long, tid binary, n long, sig binary, own array<long>, lower array<long>, s0 long, s1 long, s2 long, s3 long"
    rows = stored(mapped(docs.select("doc_id", _tid().alias("tid"), "text"), _sets, told), "rows")
    whole = F.struct("doc_id", "tid", "n", "own", "lower", "s0", "s1", "s2", "s3")
    one = rows.where(F.col("n") >= LEAST).groupBy("sig").agg(F.min_by(whole, F.struct("tid", "doc_id")).alias("r"))
    sets = stored(one.select(F.monotonically_increasing_id().alias("rid"), "sig", "r.*"), "sets")
    key = lambda c, below: sets.where(F.col(c).isNotNull()).select("rid", F.posexplode(c).alias("at", "key"), F.lit(below).alias("below"), F.lit(True).alias("asks"), F.lit(below == 0).alias("holds"))
    keys = key("own", 0).unionByName(key("lower", 1))
    met = stored(_shared(keys), "met")
    texts = _Texts(docs, sets)
    if (exchanged := _exchanged(met, sets, texts, settings or Settings())) is not None:
        discard(met)
        met = exchanged
    links = texts.links(_first_pairs(met))
    for each in (False, True):
        more = texts.links(_other_pairs(met, sets, components(links), each))
        used, links = links, stored(links.unionByName(more), "links")
        discard(used, more)
    roots = components(links)
    lows = rows.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("low"))
    nodes = lows.join(sets.select("sig", "rid"), "sig", "left").join(roots.select(F.col("node").alias("rid"), "root"), "rid", "left")
    nodes = nodes.select("sig", "low", F.coalesce("root", "rid").alias("root"))  # null: a set too small to be linked
    lowest = nodes.where("root IS NOT NULL").groupBy("root").agg(F.min("low").alias("lowest"))
    named = nodes.join(lowest, "root", "left").select("sig", F.when(F.col("root").isNotNull(), F.col("lowest")).otherwise(F.col("low")).alias("component_id"))
    full = rows.where("n > 0").select("doc_id", "n", "sig").join(named, "sig").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    none = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    out = stored(full.unionByName(none), "jaccard")
    discard(rows, sets, met, links)
    return out
