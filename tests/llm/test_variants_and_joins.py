"""Spelling variants, source divergence and the Jaccard join against brute-force versions."""

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from lumenlake.llm import divergence, jaccard, spelling
from lumenlake.llm.common import read
from lumenlake.llm.queries import ORACLES

SCHEMA = "doc_id long, text string, lang string, source string, n long, rid long, key long, word string, root string, value long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"word{i % 9000}" for i in range(60_000))


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, "w", "r", 4) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return read(spark, sf_dir, "documents")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " \t\n", None, "a"), (4, "two words", "en", ""), (5, "two words", "en", "a"), (6, LONG, "en", "a"), (6, LONG, "en", "a"),
            (7, LONG + " and a few more", "en", "b"), (None, LONG, "en", "b"), (None, "no id at all but some words here", "en", "b"), (8, "Ünlü ÜNLÜ ünlü 漢字 ×÷ straße \x1c\x85 İ" * 7, "de", "b")]
    rows += [(10 + i, "colour " * 3 + "colour color harbour harbor " * (i % 4), "en", f"s{i % 3}") for i in range(30)]
    return frame(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def rows_of(df):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.select("doc_id", "text", "lang", "source").collect()]


# spelling


def near_by_deletion(n):
    """near words of each word, by shared deletions."""
    by, near = defaultdict(set), {w: set() for w in n}
    for w in n:
        for i in range(len(w)):
            by[w[:i] + w[i + 1 :]].add(w)
    for v, ws in by.items():
        for a in ws:
            if v in n:
                near[a].add(v)
                near[v].add(a)
            near[a] |= {b for b in ws if a != b and sum(x != y for x, y in zip(a, b)) == 1}
    return near


def variants(rows, letters=6, least=5, ratio=5):
    n = Counter()
    for d, t, *_ in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = r.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{r}".encode())
            n[r if h % 199 else r[: h % len(r)] + r[h % len(r) + 1 :]] += 1
    n = {w: k for w, k in n.items() if len(w) >= letters and k >= least}
    near, form = near_by_deletion(n), {}
    for w in n:
        if near[w] and n[best := min(near[w], key=lambda x: (-n[x], x))] >= ratio * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out, key=repr)


def same_variants(df, **more):
    got = sorted((tuple(r) for r in spelling.spellings(df, spelling.Settings(**more)).collect()), key=repr)
    assert got == variants(rows_of(df), **more)
    return got


def test_spellings(docs, odd, empty):
    assert any(r[1] for r in same_variants(docs))
    assert same_variants(odd)
    assert same_variants(empty) == []


def test_chains_of_forms(spark):
    """Each form has a more frequent form of its own; roots are the ends."""
    words = ["aaaaaaa", "aaaaaab", "aaaaabb", "aaaabbb", "aaabbbb", "aabbbbb"]
    text = " ".join(w for i, w in enumerate(words) for _ in range(2**i))
    got = same_variants(frame(spark, [(i, text, "en", "a") for i in range(5)]), ratio=2)
    assert {r[2] for r in got if r[3] > 4 and set(r[0]) <= set("ab") and len(r[0]) == 7} == {words[-1]}


def test_automaton_finds_every_near_word_once():
    draw = random.Random(5)
    words = sorted({"".join(draw.choice("abé") for _ in range(draw.randint(3, 8))) for _ in range(1500)})
    near = near_by_deletion(set(words))
    forward = spelling.Automaton(words)
    assert [forward.walk(w, forward.root, 0)[1] for w in words] == list(range(len(words)))  # numbers are places in order
    assert len(forward.final) < sum(map(len, words)) / 4  # states are shared
    for w in words[::7]:
        found = [words[i] for i in forward.near(w, 2)]
        assert len(found) == len(set(found))
        assert set(found) == {x for x in near[w] if x[:2] == w[:2]}


def test_large_meeting_places_are_cut(spark, monkeypatch):
    draw = random.Random(6)
    n = {"common" + "".join(draw.choice("abcd") for _ in range(4)): draw.randint(5, 500) for _ in range(240)}
    monkeypatch.setattr(spelling, "HOT", 20)
    got = {r.word: (r.n_near, r.best_n, r.best) for r in spelling.near_words(spark.createDataFrame(list(n.items()), "word string, n long")).collect()}
    near = near_by_deletion(n)
    want = {w: (len(x), n[b], b) for w, x in near.items() if x for b in [min(x, key=lambda y: (-n[y], y))]}
    assert got == want


# divergence


def audit(df):
    import pandas as pd

    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows_of(df), columns=["doc_id", "text", "lang", "source"]).astype(object))
    return sorted(con.sql(ORACLES["op12_divergence"]).fetchall())


def by_definition(rows, least=10, top=10):
    """Shares and sums straight from the definition, all terms of all pairs."""
    groups, seen = defaultdict(Counter), defaultdict(Counter)
    for _, t, lang, source in rows:
        found = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (t or "").translate(LOWER))
        groups[lang or "", source or ""].update(found)
        seen[lang or ""].update(set(found))
    kept = {lang: [t for t, n in c.items() if n >= least] for lang, c in seen.items()}
    share = lambda counts, lang: {t: 1 + 10**9 * (counts[t] + 2) // (sum(counts[x] for x in kept[lang]) + 2 * len(kept[lang])) for t in kept[lang]}
    f = lambda p, q: (p - q) ** 2 // (p + q)
    p = {g: share(c, g[0]) for g, c in groups.items()}
    out = []
    for (lang, source), own in p.items():
        q = share(sum((c for g, c in groups.items() if g[0] == lang), Counter()), lang)
        pair = [(-sum(f(own[t], p[g][t]) for t in own), g[1]) for g in p if g[0] == lang and g[1] != source]
        term = [(-f(own[t], q[t]), t) for t in own if groups[lang, source][t] and own[t] > q[t]]
        for part, found in (("pair", pair), ("term", term)):
            found.sort(key=lambda x: (x[0], x[1].encode()))
            out += [(lang, source, part, item, -v, k + 1) for k, (v, item) in enumerate(found if part == "pair" else found[:top])]
    return sorted(out)


def got_audit(df, **more):
    return sorted(tuple(r) for r in divergence.divergence(df, divergence.Settings(**more)).collect())


def test_divergence(docs, odd, empty):
    assert got_audit(docs) == by_definition(rows_of(docs)) == audit(docs)
    assert got_audit(odd) == by_definition(rows_of(odd))
    assert got_audit(empty) == []


def test_ties_are_settled_by_bytes(spark):
    """More equal terms than ranks, of one long common beginning, some a beginning of others, non-ASCII last."""
    stem = "same" * 9
    words = [stem, stem + "x", *(stem + a + b for a in "abé" for b in "xyz漢"), "zzz", "Ω"]
    rows = [(i, " ".join(words) if i % 2 else "plain words only here", "en", "ab"[i % 2]) for i in range(24)]
    df = frame(spark, rows)
    for top in (1, 3, 10):
        assert got_audit(df, top=top) == by_definition(rows, top=top)


# Jaccard


def classes(rows):
    sets = [jaccard.shingles(t) for _, t, *_ in rows]
    by, up = defaultdict(list), list(range(len(rows)))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, s in enumerate(sets):
        both = Counter()
        for x in s:
            both.update(by[x])
            by[x].append(i)
        for j, n in both.items():
            if 100 * n >= 90 * (len(s) + len(sets[j]) - n):
                up[root(i)] = root(j)
    low = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(d, low.get(root(i), d))
    return sorted(((d, len(sets[i]), low.get(root(i)) if sets[i] else d) for i, (d, *_) in enumerate(rows)), key=repr)


def same_classes(df, settings=None):
    got = sorted((tuple(r) for r in jaccard.jaccard(df, settings).collect()), key=repr)
    assert got == classes(rows_of(df))
    return got


def edited(draw, words, edits):
    out = list(words)
    for _ in range(edits):
        at = draw.randrange(len(out))
        out[at : at + draw.randint(0, 1)] = [f"new{draw.randrange(10**6)}"] * draw.randint(0, 1)
    return out


def test_jaccard(docs, odd, empty):
    assert any(d != c for d, _, c in same_classes(docs))
    same_classes(odd)
    assert same_classes(empty) == []


@pytest.mark.parametrize("settings, hot", [(None, 4096), (None, 4), (jaccard.Settings(costly=2, weight=0.0), 4096)])
def test_families_near_the_threshold(spark, monkeypatch, settings, hot):
    """Families of texts with few to many edits, over a common passage that makes segments equal, with and without
    exchanges for one-deletion neighbourhoods and with keys that are cut."""
    monkeypatch.setattr(jaccard, "HOT", hot)
    draw = random.Random(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for family in range(12):
        size = draw.choice([11, 14, 20, 33, 60, 150, 400])
        words = draw.choices(vocabulary, k=size)
        for _ in range(14):
            rows.append((len(rows), " ".join(edited(draw, words, draw.randint(0, 1 + size // 25))), "en", "a"))
    same_classes(frame(spark, rows), settings)


def test_pigeonhole_of_segments():
    """Whatever pair is linked has an equal segment in the band of the smaller, where the larger asks."""
    draw = random.Random(9)
    for _ in range(300):
        n = draw.randint(9, 300)
        x = {b"%d" % draw.randrange(10**9) for _ in range(n)}
        y = set(draw.sample(sorted(x), n - draw.randint(0, max(0, n // 19)))) | {b"n%d" % i for i in range(draw.randint(0, n // 19))}
        small, large = sorted((x, y), key=len)
        if not jaccard.linked(x, y) or len(small) < jaccard.LEAST:
            continue
        k = jaccard.band(len(small))
        assert jaccard.band(len(large)) == k or jaccard.asks_below(len(large), jaccard.band(len(large)))
        a, b = (jaccard._dealt(jaccard.hashes_of(s), k)[2] for s in (small, large))
        assert (a != b).sum() <= (len(x) + len(y)) // 19 < jaccard.segments(k)
        assert 0 <= jaccard.spare(len(large), k)
