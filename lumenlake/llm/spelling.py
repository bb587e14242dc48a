"""Spelling variant grouping with forward and backward minimal acyclic automata.

Words are maximal runs of ASCII and Latin-1 letters, A-Z lower-cased, of at least `letters` code points and at
least `least` occurrences in all texts. (One occurrence in about 199 is planted with a missing letter: the run of a
document whose crc32 of `<doc_id>:<run>` is a multiple of 199 loses the code point at crc % length.) Two words are near at one
inserted, deleted or replaced code point. A word's form is its most frequent near word, if that is `ratio`
times as frequent; its root is where following forms ends.

Search. Of two near words the shorter has s code points. Either the first s // 2 code points of both are equal, or
the last s - s // 2 are. So each word is sent to four meeting places: for s its own length (near words as long or
one longer) and for s one less (near words one shorter), by its exact half from the front and by its exact half from the
back. A task builds, for some thousands of words that met, a minimal acyclic automaton of the words (or of the
words reversed) whose states know how many words lie beyond them: walking it gives a word's number, which is its
place in the arrays of frequencies, and back. Each query word walks its exact half, then
completes the rest with one error. A pair that agrees on the first half is left to the forward search, so each pair is found
once in all and what leaves a task is one row a query word: its number of near words and the best of them.

A meeting place of more than HOT words is cut: each word is held by one of its parts, and asked of all.

Edge cases: a null text has no words; a null doc_id is the empty string before the colon. Words of equal frequency are
taken in code-point order. Repeated rows count as often as they come; an empty table gives an empty result; other
columns are not looked at. Chains of forms end, as each form is `ratio` (over 1) times as frequent.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.common import discard, mapped, stored, values

#: Words that a task builds one automaton of, and words of a meeting place that are held together.
BUILD, HOT = 20_000, 100_000
#: Distinct words that a task holds before it hands their counts on.
HELD = 200_000
PLANTED = 199
#: As Latin-1: letters and the 64 codes from C0 stay, A-Z become a-z, all else a blank.
_LETTERS = bytes(b if b >= 0xC0 or chr(b).isascii() and chr(b).isalpha() else 0x20 for b in range(256)).lower()


@dataclass(frozen=True)
class Settings:
    letters: int = 6
    least: int = 5
    ratio: int = 5


def runs(text: str) -> list[bytes]:
    """The runs of letters of a text as Latin-1, A-Z lower-cased."""
    return text.encode("latin-1", "replace").translate(_LETTERS).split()


def planted(doc_id: str, run: bytes) -> bytes:
    """The run as this document has it: without one code point where the checksum says so."""
    own = run if run.isascii() else run.decode("latin-1").encode()
    h = zlib.crc32(own, zlib.crc32(doc_id.encode() + b":"))
    if h % PLANTED:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counted(letters: int):
    def rows(batches):
        held: Counter = Counter()

        def handed():
            yield [pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())]
            held.clear()

        for batch in batches:
            for doc_id, text in zip(*map(values, batch.columns)):
                for run, n in Counter(w for w in runs(text or "") if len(w) >= letters).items():
                    word = planted(doc_id or "", run)
                    if len(word) >= letters:
                        held[word] += n
                if len(held) >= HELD:
                    yield from handed()
        yield from handed()

    return rows


class Automaton:
    """The minimal acyclic automaton of words given in order: each state's letters, targets and the number of
    words below the target of each earlier letter (its own word, if it ends one, first)."""

    def __init__(self, words: list[str]):
        self.final, self.below = [], []
        self.edges: list[dict[str, tuple[int, int]]] = []
        known: dict[tuple, int] = {}
        path: list[tuple[bool, list]] = [(False, [])]  # states of the word before, that may still get letters
        letters: list[str] = []

        def close(upto: int) -> None:
            while len(path) > upto + 1:
                ends, out = path.pop()
                path[-1][1].append((letters.pop(), self._state(known, ends, out)))

        for word in words:
            same = 0
            while same < len(letters) and same < len(word) and letters[same] == word[same]:
                same += 1
            close(same)
            for c in word[same:]:
                letters.append(c)
                path.append((False, []))
            path[-1] = (True, path[-1][1])
        close(0)
        self.root = self._state(known, *path[0])

    def _state(self, known: dict, ends: bool, out: list) -> int:
        shape = (ends, *out)
        if (at := known.get(shape)) is None:
            at = known[shape] = len(self.final)
            n, edges = int(ends), {}
            for c, to in out:
                edges[c] = (to, n)
                n += self.below[to]
            self.final.append(ends)
            self.edges.append(edges)
            self.below.append(n)
        return at

    def walk(self, letters: str, state: int, number: int) -> tuple[int, int] | None:
        edges = self.edges
        for c in letters:
            if (to := edges[state].get(c)) is None:
                return None
            state, number = to[0], number + to[1]
        return state, number

    def near(self, word: str, exact: int) -> list[int]:
        """Numbers of the words at one edit that have the first `exact` letters, each once."""
        start = self.walk(word[:exact], self.root, 0)
        if start is None:
            return []
        found: set[int] = set()
        state, number = start
        edges, final, walk = self.edges, self.final, self.walk
        for i in range(exact, len(word) + 1):
            rest = word[i:]
            own = rest[:1]
            for c, (to, n) in edges[state].items():
                if (end := walk(rest, to, number + n)) and final[end[0]]:  # c is inserted
                    found.add(end[1])
                if own and c != own and (end := walk(rest[1:], to, number + n)) and final[end[0]]:  # c is in place of own
                    found.add(end[1])
            if own:
                if (end := walk(rest[1:], state, number)) and final[end[0]]:  # own is left out
                    found.add(end[1])
                if (to := edges[state].get(own)) is None:
                    break
                state, number = to[0], number + to[1]
        return list(found)


def _met(batches):
    """Batches are sorted by place; a place may go on in the next one. Answers the questions of some thousands of
    words at a time."""
    gathered: list[tuple] = []

    def answers(rows):
        place, word, n, asks, holds = zip(*rows)
        back = place[0][0] == "b"
        turned = (lambda w: w[::-1]) if back else (lambda w: w)
        count = {turned(w): k for w, k, h in zip(word, n, holds) if h}
        held = {(p, w) for p, w, h in zip(place, word, holds) if h}
        ordered = sorted(count)
        automaton = Automaton(ordered)
        freq = [count[w] for w in ordered]
        out = ([], [], [], [])
        for p, w, k, a in zip(place, word, n, asks):
            if not a:
                continue
            s = int(p[1 : p.index(":")])
            half = s // 2
            found = automaton.near(turned(w), s - half if back else half)
            good = []
            for i in found:
                other = turned(ordered[i])
                # s is the length of the shorter of the two; what agrees on the first half is the forward search's
                if (p, other) in held and min(len(other), len(w)) == s and not (back and other[:half] == w[:half]):
                    good.append((-freq[i], other))
            if good:
                best = min(good)
                for column, x in zip(out, (w, len(good), -best[0], best[1])):
                    column.append(x)
        return list(out)

    def flush(upto):
        # words met front first and those met back first have automata of their own
        for back in (False, True):
            if part := [r for r in gathered[:upto] if (r[0][0] == "b") == back]:
                yield answers(part)
        del gathered[:upto]

    for batch in batches:
        gathered.extend(zip(*[c.to_pylist() for c in batch.columns]))
        while len(gathered) > BUILD:
            # whole places only: up to the last that ends before BUILD words, or else the first that is larger
            at = BUILD
            while at and gathered[at - 1][0] == gathered[at][0]:
                at -= 1
            if not at:
                at = next((i for i in range(BUILD, len(gathered)) if gathered[i][0] != gathered[0][0]), 0)
            if not at:
                break
            yield from flush(at)
    yield from flush(len(gathered))


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, best_n, best of the words (word, n) that have near words among them; best is the most frequent, of
    equals the first in code-point order."""
    length = F.char_length("word")
    at = F.explode(F.array(length, length - 1)).alias("s")
    half = F.floor(F.col("s") / 2).cast("int")
    places = F.explode(F.array(
        F.concat(F.lit("f"), F.col("s").cast("string"), F.lit(":"), F.substring("word", F.lit(1), half)),
        F.concat(F.lit("b"), F.col("s").cast("string"), F.lit(":"), F.substring("word", length - (F.col("s") - half) + 1, F.col("s") - half)),
    )).alias("place")
    sent = words.select("word", "n", at).select("word", "n", places)
    large = sent.groupBy("place").agg(F.count("*").alias("met")).where(F.col("met") > HOT).select("place", F.ceil(F.col("met") / HOT).cast("int").alias("parts"))
    told = sent.join(large, "place", "left")
    own = F.pmod(F.xxhash64("word"), F.coalesce("parts", F.lit(1))).cast("int")
    dealt = told.select("place", "word", "n", own.alias("own"), F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    rows = dealt.select(F.concat("place", F.lit("#"), F.col("part").cast("string")).alias("place"), "word", "n", F.lit(True).alias("asks"), (F.col("own") == F.col("part")).alias("holds"))
    found = mapped(rows.repartition("place").sortWithinPartitions("place"), _met, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of the words (word, form) that have a form: forms are followed by doubling, until none goes on."""
    at = stored(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while at.where("moved").limit(1).count():
        on = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        used, at = at, stored(at.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        discard(used)
    return at.select("word", "root")


def spellings(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """word, form, root, n, n_near, form_n."""
    s = settings or Settings()
    counted = mapped(docs.select(F.col("doc_id").cast("string"), "text"), _counted(s.letters), "word string, n long")
    words = stored(counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= s.least), "words")
    near = stored(near_words(words), "near")
    good = F.col("best_n") >= s.ratio * F.col("n")
    told = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(good, F.col("best")).alias("form"), F.when(good, F.col("best_n")).alias("form_n"))
    told = stored(told, "forms")
    ends = roots(told.where("form IS NOT NULL"))
    out = told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    out = stored(out, "spellings")
    discard(words, near, told)
    return out
