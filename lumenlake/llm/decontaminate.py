"""Benchmark decontamination: a BM25 index of the test items, queried by every training passage.

Items are the indexed documents, split into a question and an answer; every window of
Index.window words of a training text is a query. An item's score is divided by the score that its
own words give, so 1 is a whole item and one threshold serves all. Items lie in blocks of BLOCK,
ordered by length, and each posting list keeps its largest impact in each block (block-max).

WAND, a batch of passages at a time. Words in many items are never enough to reach the threshold by
themselves; the lists of the others (essential words) propose blocks. Of a passage's essential lists, the
longest are set aside for as long as all their largest impacts together, and the most that any item gets from
the frequent words, stay below the threshold: no item can reach it without one of the remaining lists, so
those before this pivot propose nothing. A block that the remaining lists propose is skipped if their maxima in
it, all that the lists set aside can give, and the most that its items get from the frequent words stay below
the threshold; in the blocks that are left, and only there, the lists set aside are looked up and the bound is taken
again with their maxima in the block. The items of what then remains are scored in full. Only the postings read take
memory, at most about POSTINGS at a time. Everything at or above the threshold is retrieved, then verified: four fifths of the
item's five-word shingles stand in the passage, half of the question's, and half of the answer's words.

An index holds about MAX_WORDS words, counted on the executors; more items than that are dealt by a hash to
several indexes, and the corpus is read once for each. All of them weigh words by the same statistics, those of all items
(Whole), and cut the same passages, so the number of indexes changes no score and no match. Only the words of items are
shuffled, and only where there are several indexes. Items are kept as numbers of words.

Edge cases: null or empty texts match nothing; items without words are ignored, shorter ones than
a shingle must occur whole; null ids come back as null; repeated rows and items are each matched.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.common import discard, mapped, stored, values

WORD = re.compile(r"\w+")
K1, B = 1.2, 0.75
THRESHOLD = 0.6
OVERLAP = 0.8
QUESTION, ANSWER = 0.5, 0.5
SHINGLE = 5
BLOCK = 8
#: Words of an index: under 60 bytes each in a worker, and some 110 bytes for each different one.
MAX_WORDS = 4_000_000
#: Passages and postings scored at a time.
BATCH, POSTINGS = 512, 500_000
#: Words of texts, with the empty places between them, that are looked up together.
LAID = 1 << 18
MATCHES = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, n_passages long"


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def split_item(text: str | None) -> tuple[str, str]:
    """Question and answer of an item that has one text only: its last sentence is the answer."""
    parts = re.split(r"(?<=[.?!])\s+", (text or "").strip())
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else ("".join(parts), "")


@dataclass(frozen=True)
class Index:
    """CSR lists by term: blocks with their maxima (essential terms), and items with impacts (all)."""

    ids: list
    tokens: np.ndarray
    token_at: np.ndarray
    answer_at: np.ndarray
    vocabulary: dict[str, int]
    essential: np.ndarray
    block_at: np.ndarray
    block_id: np.ndarray
    block_max: np.ndarray
    block_key: np.ndarray
    item_at: np.ndarray
    item_id: np.ndarray
    impact: np.ndarray
    rest: np.ndarray
    most: np.ndarray
    window: int


@dataclass(frozen=True)
class Whole:
    """Statistics over the items of all indexes: how many have words, their mean and largest number of words, and
    in how many each word of this index occurs."""

    n: int
    mean: float
    longest: int
    df: dict[str, int]


def build(items: list[tuple], whole: Whole | None = None) -> Index:
    """Index of (item_id, question, answer) rows; whole: statistics of all items, where these are a part of them."""
    rows = [(i, q, a) for i, q, a in ((i, words(q), words(a)) for i, q, a in items) if q or a]
    rows.sort(key=lambda r: (len(r[1]) + len(r[2]), str(r[0])))
    n = len(rows)
    vocabulary: dict[str, int] = {}
    term, item, tf = [], [], []
    sizes = np.array([len(q) + len(a) for _, q, a in rows], float)
    for k, (_, q, a) in enumerate(rows):
        found: dict[int, int] = {}
        for w in q + a:
            t = vocabulary.setdefault(w, len(vocabulary))
            found[t] = found.get(t, 0) + 1
        term += found
        item += [k] * len(found)
        tf += found.values()
    term, item, tf = np.array(term, np.int64), np.array(item, np.int64), np.array(tf, float)
    if whole is None:
        df, total = np.bincount(term, minlength=len(vocabulary)).astype(float), n
        mean, longest = (float(sizes.mean()), int(sizes.max())) if n else (1.0, 1)
    else:
        df = np.array([whole.df[w] for w in vocabulary], float)
        total, mean, longest = whole.n, whole.mean, whole.longest
    idf = np.log(1 + (total - df + 0.5) / (df + 0.5))
    norm = K1 * (1 - B + B * sizes / max(mean, 1.0))
    raw = idf[term] * tf * (K1 + 1) / (tf + norm[item]) if n else np.zeros(0)
    own = np.bincount(item, weights=raw, minlength=n)
    impact = raw / own[item] if n else raw
    essential = df <= max(2, total / 20)
    # an item whose frequent words alone could reach the threshold makes them essential too
    while n:
        rest = np.bincount(item, weights=impact * ~essential[term], minlength=n)
        if not (poor := rest >= THRESHOLD - 0.1).any():
            break
        essential[term[poor[item]]] = True
    if not n:
        rest = np.zeros(0)
    order = np.lexsort([item, term])
    term, item, impact = term[order], item[order], impact[order]
    block = item // BLOCK
    first = np.r_[True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])] if len(term) else np.zeros(0, bool)
    starts = np.flatnonzero(first)
    best = np.maximum.reduceat(impact, starts) if len(starts) else np.zeros(0)
    blocks = -(-n // BLOCK)
    most_rest = np.zeros(blocks)
    np.maximum.at(most_rest, np.arange(n) // BLOCK, rest)
    at = lambda t: np.searchsorted(t, np.arange(len(vocabulary) + 1))
    most = np.zeros(len(vocabulary))
    np.maximum.at(most, term, impact)
    tokens = np.fromiter((vocabulary[w] for _, q, a in rows for w in q + a), np.int32, int(sizes.sum()))
    token_at = np.r_[0, np.cumsum(sizes)].astype(np.int64)
    answer_at = token_at[:-1] + np.array([len(q) for _, q, _ in rows], np.int64)
    return Index([r[0] for r in rows], tokens, token_at, answer_at, vocabulary, essential, at(term[starts]), block[starts], best, term[starts] * blocks + block[starts], at(term), item.astype(np.int32), impact, most_rest, most, max(128, 2 * longest))


def _expand(at: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all entries of the terms' lists, and which term each is of."""
    size = at[terms + 1] - at[terms]
    owner = np.repeat(np.arange(len(terms)), size)
    return np.arange(len(owner)) + np.repeat(at[terms] - np.cumsum(size) + size, size), owner


def retrieve(index: Index, ids: np.ndarray, step: int, valid: np.ndarray | None = None) -> list[tuple[int, int, float]]:
    """(passage, item, score) of all at the threshold or above. ids: term of each word, -1 for none;
    passage p has the words from p * step to p * step + 2 * step. valid: which passages are looked at, if not all."""
    passages = max(1, -(-len(ids) // step) - 1)
    blocks, least = len(index.rest), THRESHOLD - 1e-9
    out: list[tuple[int, int, float]] = []
    place = np.flatnonzero(ids >= 0)
    place = place[index.essential[ids[place]]]
    if not len(place) or not blocks:
        return out
    spare = float(index.rest.max())
    size = np.diff(index.block_at)
    for low in range(0, passages, BATCH):
        high = min(passages, low + BATCH)
        a, b = np.searchsorted(place, [low * step, (high + 1) * step])
        here = place[a:b]
        if not len(here):
            continue
        half = here // step
        pair = np.concatenate([half, half - 1])
        term = np.concatenate([ids[here], ids[here]])
        inside = (pair >= low) & (pair < high)
        if valid is not None:
            inside[inside] = valid[pair[inside]]
        if not inside.any():
            continue
        code = np.unique((pair[inside] - low) * len(index.vocabulary) + term[inside])
        passage, term = code // len(index.vocabulary), code % len(index.vocabulary)
        # the pivot of each passage: its longest lists that cannot reach the threshold together
        order = np.lexsort([-size[term], passage])
        passage, term = passage[order], term[order]
        first = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
        upto = np.cumsum(index.most[term])
        upto -= np.repeat(upto[first] - index.most[term[first]], np.diff(np.r_[first, len(passage)]))
        aside = upto + spare < least
        set_aside = np.zeros(high - low)
        np.maximum.at(set_aside, passage[aside], upto[aside])
        aside_at = np.searchsorted(passage[aside], np.arange(high - low + 1))
        aside_term = term[aside]
        passage, term = passage[~aside], term[~aside]
        # as many whole passages at a time as POSTINGS allows
        group = np.cumsum(size[term]) // POSTINGS
        edges = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) & (passage[1:] != passage[:-1])]) if len(term) else []
        for i, j in zip(edges, [*edges[1:], len(term)]):
            entry, owner = _expand(index.block_at, term[i:j])
            cell = passage[i:j][owner] * blocks + index.block_id[entry]
            if (high - low) * blocks <= POSTINGS:
                bound = np.bincount(cell, weights=index.block_max[entry])
                cell = np.flatnonzero(bound)
                bound = bound[cell]
            else:
                cell, at = np.unique(cell, return_inverse=True)
                bound = np.bincount(at, weights=index.block_max[entry])
            near = np.flatnonzero(bound + set_aside[cell // blocks] + index.rest[cell % blocks] >= least)
            p_of, k_of, bound = cell[near] // blocks, cell[near] % blocks, bound[near]
            bound += _probed(index, aside_term, aside_at, p_of, k_of)
            for c in np.flatnonzero(bound + index.rest[k_of] >= least):
                p, k = int(p_of[c]), int(k_of[c])
                own = ids[(low + p) * step : (low + p + 2) * step]
                entry, _ = _expand(index.item_at, np.unique(own[own >= 0]))
                entry = entry[index.item_id[entry] // BLOCK == k]
                score = np.bincount(index.item_id[entry] - k * BLOCK, weights=index.impact[entry], minlength=BLOCK)
                out += [(low + p, int(k * BLOCK + x), float(score[x])) for x in np.flatnonzero(score >= least)]
    return out


def _probed(index: Index, term: np.ndarray, at: np.ndarray, passage: np.ndarray, block: np.ndarray) -> np.ndarray:
    """What the terms that each passage has set aside (from at[p] on) can give in its block."""
    n = at[passage + 1] - at[passage]
    row = np.repeat(np.arange(len(passage)), n)
    asked = term[np.arange(len(row)) + np.repeat(at[passage] - np.cumsum(n) + n, n)] * len(index.rest) + block[row]
    place = np.minimum(np.searchsorted(index.block_key, asked), len(index.block_key) - 1)
    return np.bincount(row, weights=index.block_max[place] * (index.block_key[place] == asked), minlength=len(passage))


def shingles(tokens: list[int]) -> set[tuple[int, ...]]:
    return {tuple(tokens[i : i + SHINGLE]) for i in range(max(1, len(tokens) - SHINGLE + 1))} if tokens else set()


def verify(index: Index, item: int, passage: list[int]) -> tuple[bool, float, float]:
    """Whether the passage, words as numbers (-1: in no item), holds the item; overlap of the question's shingles and
    of the answer's words."""
    q = index.tokens[index.token_at[item] : index.answer_at[item]].tolist()
    a = index.tokens[index.answer_at[item] : index.token_at[item + 1]].tolist()
    whole = shingles(q + a)
    there = shingles(passage)
    for n in {len(next(iter(whole))), min(SHINGLE, len(q) or SHINGLE)} - {SHINGLE}:
        there |= {tuple(passage[i : i + n]) for i in range(len(passage) - n + 1)}
    both = len(whole & there) / len(whole)
    question = len(shingles(q) & there) / len(shingles(q)) if q else 1.0
    held = set(passage)
    answer = sum(w in held for w in a) / len(a) if a else 1.0
    return both >= OVERLAP and question >= QUESTION and answer >= ANSWER, question, answer


def matches(index: Index, text: str | None) -> dict[int, tuple[float, float, float, int]]:
    """Verified items of a whole text: best score, question and answer overlap, passages."""
    return next(matches_of(index, [text]))


def matches_of(index: Index, texts: Iterable[str | None]) -> Iterator[dict[int, tuple[float, float, float, int]]]:
    """matches() of each text. Texts of about BATCH passages, or LAID words, are looked up together."""
    get, step = index.vocabulary.get, index.window // 2
    held: list[np.ndarray] = []
    halves = 0
    for text in texts:
        tokens = words(text) if index.ids else []
        held.append(np.fromiter(map(get, tokens, repeat(-1)), np.int64, len(tokens)))
        halves += -(-len(tokens) // step) + 1
        if halves >= BATCH or halves * step >= LAID:
            yield from _together(index, held, step)
            held, halves = [], 0
    yield from _together(index, held, step)


def _together(index: Index, held: list[np.ndarray], step: int) -> list[dict[int, tuple[float, float, float, int]]]:
    """Texts are laid out one after the other, each in whole halves of passages and one empty half; passages that
    reach into that one are not looked at, unless the text has no other."""
    found: list[dict] = [{} for _ in held]
    size = np.array([-(-len(ids) // step) for ids in held], np.int64)
    at = np.cumsum(size + 1) - size - 1
    if not size.any():
        return found
    laid, valid = np.full(int((size + 1).sum()) * step, -1, np.int64), np.zeros(int((size + 1).sum()), bool)
    for ids, a, n in zip(held, at.tolist(), size.tolist()):
        laid[a * step : a * step + len(ids)] = ids
        valid[a : a + max(n - 1, min(n, 1))] = True
    for p, item, score in retrieve(index, laid, step, valid):
        k = int(np.searchsorted(at, p, "right")) - 1
        p -= int(at[k])
        ok, question, answer = verify(index, item, held[k][p * step : (p + 2) * step].tolist())
        if ok:
            best = found[k].get(item, (0.0, 0.0, 0.0, 0))
            found[k][item] = max((score, question, answer), best[:3]) + (best[3] + 1,)
    return found


def _matched(shared, batches):
    index = shared.value
    for batch in batches:
        out = [(d, index.ids[i], *x) for d, m in zip(values(batch.column(0)), matches_of(index, values(batch.column(1)))) for i, x in sorted(m.items())]
        yield [list(x) for x in zip(*out)] if out else [[]] * 6


def _clean(shared, batches):
    index = shared.value
    for batch in batches:
        texts = values(batch.column(batch.schema.get_field_index("text")))
        yield batch.filter(pa.array([not m for m in matches_of(index, texts)], pa.bool_())).columns


def _item_words(batches):
    """Distinct words of each item that has any, with its number of words on the first of them."""
    for batch in batches:
        part, word, size = [], [], []
        for p, *each in zip(*(values(c) for c in batch.columns)):
            own = [w for text in (each if len(each) == 2 else split_item(each[0])) for w in words(text)]
            found = dict.fromkeys(own)
            part += [p] * len(found)
            word += found
            size += [len(own) if i == 0 else None for i in range(len(found))]
        yield [part, word, size]


def indexes(items: DataFrame, most: int = MAX_WORDS) -> Iterator[Index]:
    """Indexes of at most about `most` words each. items: item_id and text, or item_id, question and answer."""
    columns = ["question", "answer"] if "question" in items.columns else ["text"]
    count = sum((F.coalesce(F.size(F.regexp_extract_all(F.col(c), F.lit(r"(?U)\w+"), F.lit(0))), F.lit(0)) for c in columns), F.lit(0))
    n = items.agg(F.sum(count.cast("long"))).first()[0] or 0
    parts = max(1, -(-n // most) if n <= most else -(-5 * n // (4 * most)))
    dealt = items.select("item_id", *columns, F.pmod(F.xxhash64(*columns), F.lit(parts)).alias("part"))
    if parts > 1:
        found = stored(mapped(dealt.select("part", *columns), _item_words, "part long, word string, size long"), "item-words")
        total, mean, longest = found.agg(F.count("size"), F.avg("size"), F.max("size")).first()
        df = stored(found.groupBy("word").agg(F.count("*").alias("df")), "item-words-df")
    for p in range(parts):
        rows = [tuple(r) for r in dealt.where(F.col("part") == p).select("item_id", *columns).collect()]
        own = dict(df.join(found.where(F.col("part") == p).select("word").distinct(), "word").collect()) if parts > 1 else {}
        yield build(rows if len(columns) == 2 else [(i, *split_item(t)) for i, t in rows], Whole(total, mean, longest, own) if parts > 1 else None)
    if parts > 1:
        discard(found, df)


def contaminated(docs: DataFrame, items: DataFrame, most: int = MAX_WORDS) -> DataFrame:
    """A row for each document and item found in it."""
    out = None
    for index in indexes(items, most):
        found = mapped(docs.select("doc_id", "text"), partial(_matched, docs.sparkSession.sparkContext.broadcast(index)), MATCHES)
        out = found if out is None else out.unionByName(found)
    return out


def without_contaminated(docs: DataFrame, items: DataFrame, most: int = MAX_WORDS) -> DataFrame:
    """The rows of docs that hold no item, with all their columns."""
    out = docs
    for index in indexes(items, most):
        out = mapped(out, partial(_clean, docs.sparkSession.sparkContext.broadcast(index)), docs.schema)
    return out
