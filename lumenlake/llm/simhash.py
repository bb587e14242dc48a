"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint has 64 bits: bit b is set if over half of the XXH64 hashes (seed 42) of the
text's four-word shingles have it set. Fingerprints link at LINK or fewer differing bits.

Candidate search. The 64 bits are cut into five blocks; four errors leave at least one block
without error, so a key holds one block exactly. Of the other 51 or 52 bits, two segments of
23 bits share at most four errors, so at least one of them has two or fewer. Each segment is
decoded by the perfect binary Golay code (23, 12, 7): the word and its 23 neighbours fall into
the spheres of one or six codewords, and two words within two bits of each other share a
neighbour (or one is the other's), hence a codeword. Block, segment and codeword index make a
key of 25 free bits; every linked pair shares one. Only distinct fingerprints are keyed, so
copies of a text count once.

Within a key, links are followed by a breadth-first search that compares each reached
fingerprint with those not yet reached, and one edge is kept for each fingerprint reached: a
spanning forest, never all pairs. A key with more than HOT distinct fingerprints is not one task's work:
it is cut into blocks of HOT, and each pair of blocks becomes a row that any task can take. Large-star and
small-star rounds then join the forests.

Edge cases: null or blank texts have fingerprint zero and link like any other; a null doc_id
gets a component_id from the others of its component (null if there is none); repeated rows
come back as often as they came, but of copies one_of_each() keeps one row; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.common import beside, discard, mapped, stored, stored_in_parts, values

SHINGLE = 4
SEED = 42
LINK = 4
BLOCKS = (13, 13, 13, 13, 12)
SEGMENT = 23
#: Distinct fingerprints of one key that are searched together.
HOT = 1 << 14
#: Generator polynomial of the binary Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011


def fingerprint(text: str | None) -> int:
    """The unsigned fingerprint of a whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < SHINGLE:
        digests = xxhash.xxh64_digest(joined, SEED)
    else:
        size = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(size + 1) - 1
        digest = xxhash.xxh64_digest
        digests = b"".join([digest(joined[a:b], SEED) for a, b in zip((ends - size)[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist())])
    rows = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(rows), 1 << 14):
        ones += np.unpackbits(rows[at : at + (1 << 14)], axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(rows)).tobytes(), "big")


def _fingerprints(batches):
    for batch in batches:
        prints = np.array([fingerprint(t) for t in values(batch.column(1))], dtype=np.uint64)
        yield [batch.column(0), prints.view(np.int64)]


def _numbered(batches):
    for batch in batches:
        prints = np.array([fingerprint(t) for t in values(batch.column(2))], dtype=np.uint64)
        yield [batch.column(0), batch.column(1), batch.column(3), prints.view(np.int64)]


@lru_cache(maxsize=1)
def _golay() -> tuple[np.ndarray, list[np.ndarray]]:
    """The error pattern of each syndrome, and for each byte of a word its part of the syndrome."""

    def remainder(x: int) -> int:
        for bit in range(SEGMENT - 1, 10, -1):
            if x >> bit & 1:
                x ^= GENERATOR << (bit - 11)
        return x

    unit = [remainder(1 << i) for i in range(SEGMENT)]
    error = np.zeros(1 << 11, np.int64)
    for i in range(SEGMENT):
        error[unit[i]] = 1 << i
        for j in range(i):
            error[unit[i] ^ unit[j]] = 1 << i | 1 << j
            for k in range(j):
                error[unit[i] ^ unit[j] ^ unit[k]] = 1 << i | 1 << j | 1 << k
    parts = []
    for low in (0, 8, 16):
        table = np.zeros(256, np.int64)
        for i in range(low, min(low + 8, SEGMENT)):
            table[np.arange(256) >> (i - low) & 1 == 1] ^= unit[i]
        parts.append(table)
    return error, parts


def codeword(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the nearest codeword of each 23-bit word."""
    error, (a, b, c) = _golay()
    syndrome = a[words & 255] ^ b[words >> 8 & 255] ^ c[words >> 16]
    return (words ^ error[syndrome]) >> 11


def segment_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and codeword indices: those of each word and of its 23 neighbours, each once."""
    near = np.concatenate([np.zeros(1, np.int64), 1 << np.arange(SEGMENT)])
    found = np.sort(codeword(words[:, None] ^ near), axis=1)
    first = np.ones(found.shape, bool)
    first[:, 1:] = found[:, 1:] != found[:, :-1]
    row, column = np.nonzero(first)
    return row, found[row, column]


def keys(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of uint64 fingerprints: (position, key) pairs, about 53 for each."""
    rows, out, low = [], [], 0
    for j, size in enumerate(BLOCKS):
        block = (values >> np.uint64(low) & np.uint64((1 << size) - 1)).astype(np.int64)
        below = values & np.uint64((1 << low) - 1)
        above = values >> np.uint64(low + size) if low + size < 64 else np.zeros_like(values)
        rest = below | above << np.uint64(low)
        for half in range(2):
            words = (rest >> np.uint64(SEGMENT * half) & np.uint64((1 << SEGMENT) - 1)).astype(np.int64)
            row, index = segment_keys(words)
            rows.append(row)
            out.append((2 * j + half << 25) | block[row] << 12 | index)
        low += size
    return np.concatenate(rows), np.concatenate(out)


def _keyed(batches):
    for batch in batches:
        values = np.asarray(batch.column(0))
        for at in range(0, len(values), 4096):
            part = values[at : at + 4096]
            row, key = keys(part.view(np.uint64))
            yield [key, part[row]]


def forest(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (parent, child) of a spanning forest of the links among distinct fingerprints."""
    left = np.sort(values.view(np.int64)).view(np.uint64)
    parents, children = [], []
    while len(left) > 1:
        queue, left = left[:1], left[1:]
        while len(queue) and len(left):
            # a block of the queue against all that is not reached yet
            step = max(1, min(len(queue), 4_000_000 // len(left)))
            block, queue = queue[:step], queue[step:]
            near = np.bitwise_count(block[:, None] ^ left) <= LINK
            got = near.any(axis=0)
            if got.any():
                parents.append(block[near[:, got].argmax(axis=0)])
                children.append(left[got])
                queue = np.concatenate([queue, left[got]])
                left = left[~got]
    if not parents:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(parents), np.concatenate(children)


def _links(batches):
    """Batches come sorted by key; a key may go on in the next one. Yields links (a, b), and the pairs of blocks
    (left, right) of keys that are too large."""
    keys_, values_ = [], []

    def cut(all_):
        """A large key's work: each block with itself and with each later one."""
        blocks = [all_[i : i + HOT].tobytes() for i in range(0, len(all_), HOT)]
        for i, left in enumerate(blocks):
            for right in blocks[i:]:
                yield [[None], [None], [left], [right]]

    def within(key, value):
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[start, len(key)])
        two = start[size == 2]
        x, y = value[two], value[two + 1]
        near = np.bitwise_count((x ^ y).view(np.uint64)) <= LINK
        a, b = [x[near]], [y[near]]
        for s, n in zip(start[size > 2].tolist(), size[size > 2].tolist()):
            if n > HOT:
                yield from cut(value[s : s + n])
                continue
            p, c = forest(value[s : s + n].view(np.uint64))
            a.append(p.view(np.int64))
            b.append(c.view(np.int64))
        a, b = np.concatenate(a), np.concatenate(b)
        if len(a):
            yield [a, b, [None] * len(a), [None] * len(a)]

    for batch in batches:
        key, value = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        if not len(key):
            continue
        last = int(np.searchsorted(key, key[-1]))
        if last or (keys_ and keys_[-1][-1] != key[-1]):
            yield from within(np.concatenate([*keys_, key[:last]]), np.concatenate([*values_, value[:last]]))
            keys_, values_ = [], []
        keys_.append(key[last:])
        values_.append(value[last:])
    if keys_:
        yield from within(np.concatenate(keys_), np.concatenate(values_))


def _pairs(batches):
    """The links within and between two blocks of a large key."""
    for batch in batches:
        for left, right in zip(values(batch.column(0)), values(batch.column(1))):
            all_ = np.frombuffer(left if left == right else left + right, np.int64)
            p, c = forest(all_.view(np.uint64))
            yield [p.view(np.int64), c.view(np.int64)]


def links(distinct: DataFrame) -> DataFrame:
    """A spanning set of links (a, b) among the distinct fingerprints in column fp, stored."""
    keyed = mapped(distinct.select("fp"), _keyed, "key long, fp long")
    # the partitioning is by key, and a key holds distinct fingerprints only
    dealt = keyed.repartition("key").sortWithinPartitions("key")
    first = stored(mapped(dealt, _links, "a long, b long, left binary, right binary"), "links")
    large = first.where("left IS NOT NULL").select("left", "right")
    found = first.where("left IS NULL").select("a", "b")
    if large.limit(1).count():
        found = found.unionByName(mapped(large.repartition(F.xxhash64("left", "right")), _pairs, "a long, b long"))
    out = stored(found, "links")
    discard(first)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge (a, b); root is the smallest of its component.
    Large-star and small-star rounds, each written to the shared folder, until nothing changes."""
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        used, edges = edges, stored(small, "edges")
        discard(used)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def rooted(prints: DataFrame) -> DataFrame:
    """fp and root of each distinct fingerprint in prints; root is the smallest of its component."""
    distinct = prints.select("fp").distinct()
    pairs = links(distinct)
    found = components(pairs)
    discard(pairs)
    return distinct.join(found, distinct.fp == found.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    prints = stored(mapped(docs.select("doc_id", "text"), _fingerprints, "doc_id long, fp long"), "fingerprints")
    nodes = rooted(prints).join(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "fp")
    lowest = nodes.groupBy("root").agg(F.min("low").alias("component_id"))
    named = nodes.join(lowest, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of docs of each component: that of the smallest doc_id, then of the smallest fingerprint, then
    of the other columns as JSON, then the first in place. Rows are decided one by one, so different
    texts of one repeated id each count for their own component. Rows with a null doc_id have no place in that
    order and all stay. Texts are written once and not shuffled: the numbers of the chosen rows are brought to
    where they lie. All columns, of any type and name, come back."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    rows = stored_in_parts(rows, "rows")
    rest = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("doc_id", "text")]
    told = rows.select("rid", "row.doc_id", "row.text", F.to_json(F.struct(*rest)).alias("rest") if rest else F.lit("").alias("rest"))
    prints = stored(mapped(told, _numbered, "rid long, doc_id long, rest string, fp long"), "fingerprints")
    of_fp = prints.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min(F.struct("doc_id", "fp", "rest", "rid")).alias("c"))  # copies meet before their roots do
    chosen = of_fp.join(rooted(prints), "fp").groupBy("root").agg(F.min("c").alias("c")).select("c.rid")
    chosen = chosen.unionByName(prints.where("doc_id IS NULL").select("rid"))
    back = [F.col("row").getField(c).alias(c) for c in docs.columns]
    out = beside(rows, chosen, "inner", "chosen", lambda j: j.select(*back), n=F.count("*"))
    discard(rows, prints)
    return out
