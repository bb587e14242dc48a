"""Each operator against a brute-force version, on awkward rows and on the smallest tables."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lumenlake.llm import decontaminate, langid, licences, packing, pii, quality, repeats, simhash, toxicity, urls
from lumenlake.llm.common import read

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, length long, h long, label int"
LONG = "word " * 3000 + "x" * 5000 + "\n" + "another passage of some length, " * 200
ROWS = [
    (1, None, None, None), (2, "", "en", "a"), (3, " \t\n", "en", None), (4, "One two three.", None, "a"),
    (5, LONG, "en", "a"), (6, LONG, "en", "a"), (6, LONG, "en", "a"), (7, "mail a.b@c-d.example.com or a@b..c.d@e.f", "en", "b"),
    (None, "no id here, call +1 (555) 010-1234 now", "en", "b"), (8, "ÀÉ ñandú 漢字 😀 \x1c \x85 ﬁ İ <|endoftext|>", "es", "b"),
    (9, "4111 1111 1111 1111 and 4111-1111-1111-1112 and 10.0.0.256 and 10.1.2.3.4 and 1" + " 1" * 3000, "en", "b"),
    (10, "Licensed under the Apache License, Version 2.0.\nthen other words", "en", "c"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 0, 0.5, 1, 2, 3, 1) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").cache()
    yield rows
    rows.unpersist()  # or later plans over documents would read the cached rows


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def key(rows):
    return sorted(map(repr, rows))


# 1


def check_pieces(df, out, window=4096):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.Settings().path())
    want = Counter()
    whole = {}
    for d, t in texts(df):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [packing.END], "<u4")
        whole.setdefault(d, []).append(ids)
        want[d] += len(ids)
    rows = out.collect()
    have = Counter()
    for r in rows:
        have[r.doc_id] += r.length
        assert any(r.doc_tokens == len(x) and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in whole[r.doc_id])
    assert have == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    return sum(want.values()) / (len(by) * window)


def test_packing(odd, docs, empty):
    check_pieces(odd, packing.packed(odd))
    assert check_pieces(docs, packing.packed(docs)) > 0.97
    assert packing.packed(empty).count() == 0


def test_encoder_equals_tokenizer():
    encoder = packing.Encoder(packing.Settings().path())
    draw = random.Random(3)
    letters = "aAzZéÉßİıſΣσςǅȺ0٣²½ '\"!#_\t\n\r\x0b\x1c\x1f\x85\xa0́é漢字😀<|>ªº'sS'Ll'RE'm\x00ﬁ"
    for _ in range(3000):
        s = "".join(draw.choice(letters) for _ in range(draw.randint(0, 25))) + draw.choice(["", "", "<|endoftext|>x", "y" * 90])
        assert np.array(encoder.tokenizer.encode(s, add_special_tokens=False).ids, "<u4").tobytes() == encoder.ids(s), repr(s)


def test_other_tokenizer_files():
    """A file with other rules is used as it is: its own ids, not those of this one's short way."""
    from pathlib import Path

    assert packing.Encoder(packing.Settings().path()).short
    other = Path(packing.Settings().path()).with_name("byte_bpe_50k.json")
    encoder = packing.Encoder(str(other))
    for s in ("Some  text, with\nlines and Caps", "x", " it's"):
        assert encoder.ids(s) == np.array(encoder.tokenizer.encode(s, add_special_tokens=False).ids, "<u4").tobytes()


def test_nnls():
    draw = np.random.default_rng(0)
    for _ in range(5):
        a, b = draw.random((8, 12)), draw.random(8)
        x = packing.nnls(a, b)
        gradient = a.T @ (a @ x - b)
        assert (x >= 0).all() and (gradient > -1e-6).all() and abs(gradient @ x) < 1e-6  # the conditions of an optimum


# 2


def test_licences(spark, empty):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License"), (2, "a/b/x.py", "code"), (3, "a/b/y.py", "# Licensed under the Apache License, Version 2.0. Rest."),
        (4, "c/z.py", None), (5, None, ""), (6, "a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        (7, "ab/q", "the licence of a poet is to write what no licence allows and be read"), (2, "a/b/x.py", "code"),
    ]
    files = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = {r.doc_id: (r.licence, r.origin, r.licence_dir) for r in licences.licences(files).collect()}
    assert got == {
        1: ("MIT", "own", None), 2: ("GPL-3.0", "inherited", "a/b"), 3: ("Apache-2.0", "own", None), 4: (None, "none", None),
        5: (None, "none", None), 6: ("GPL-3.0", "own", None), 7: (None, "none", None),
    }
    assert licences.licences(files).count() == len(rows)
    assert licences.licences(licences.document_paths(empty), named=False).count() == 0


def test_licence_cosine(spark):
    square, other = licences.weights()
    lines = ["released under the mit license", "this file, licensed under terms of the mozilla license 2.0 only", "license license foo"]
    df = spark.createDataFrame([(x,) for x in lines], "text string").select("text", licences.best(F.col("text")).alias("b"))
    for r in df.collect():
        mine = licences.terms(r.text)
        norm = sum(k * k * square[w] if w in square else k * other for w, k in mine.items())
        cos = lambda t: sum(k * t[w] * square[w] for w, k in mine.items() if w in t) / (norm * sum(k * k * square[w] for w, k in t.items())) ** 0.5
        assert r.b.score == pytest.approx(max(cos(licences.terms(t)) for _, t in licences.TEMPLATES), abs=1e-8)
    named = spark.createDataFrame([("a/LICENSE", "Released under the MIT License", 1, "x", {"k": 1}), ("a/b", "code", 2, "y", None)], "path string, text string, dir long, best string, `row` map<string,int>")
    out = licences.licences(named.withColumn("score", F.lit("mine")))
    assert sorted((r.path, r.dir, r.best, r.licence, r.score) for r in out.collect()) == [("a/LICENSE", 1, "x", "MIT", 1.0), ("a/b", 2, "y", "MIT", 0.0)]


# 3


def test_decontamination(spark, sf_dir, docs, odd, empty):
    items = read(spark, sf_dir, "benchmark")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()}
    want = {(d, i) for d, t in texts(docs) for i, x in [(r.item_id, r.text) for r in items.collect()] if x in (t or "")}
    assert want and want <= got
    assert decontaminate.contaminated(odd, items).count() == 0 and decontaminate.contaminated(empty, items).count() == 0
    kept = decontaminate.without_contaminated(docs, items)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, _ in texts(docs)} - {d for d, _ in got}
    # several indexes find the same
    few = items.agg(F.sum(F.size(F.split("text", " ")))).first()[0] // 3
    assert len(list(decontaminate.indexes(items, few))) > 2
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items, few).collect()} == got
    assert decontaminate.without_contaminated(docs, items, few).count() == kept.count()


def test_several_indexes_are_one(spark):
    """Items that passages hold in part: scores, overlaps and numbers of passages are those of a single index."""
    draw = random.Random(9)
    vocabulary = [f"w{i}" for i in range(300)]
    some = lambda n: draw.choices(vocabulary, weights=[1 / (i + 1) for i in range(300)], k=n)
    items = [(i, some(draw.randint(6, 90)), some(draw.randint(1, 6))) for i in range(120)]
    texts_ = []
    for d in range(150):
        tokens = some(draw.randint(0, 500))
        for _ in range(2):
            _, q, a = items[draw.randrange(120)]
            q = [w if draw.random() > 0.04 else "changed" for w in q]
            at = draw.randint(0, len(tokens))
            tokens[at:at] = q + a
        texts_.append((d, " ".join(tokens)))
    docs = spark.createDataFrame(texts_, "doc_id long, text string")
    table = spark.createDataFrame([(i, " ".join(q), " ".join(a)) for i, q, a in items] + [(500, None, None), (501, "", "")], "item_id long, question string, answer string")
    rows = lambda most: sorted((r.doc_id, r.item_id, round(r.score, 9), r.question_overlap, r.answer_overlap, r.n_passages) for r in decontaminate.contaminated(docs, table, most).collect())
    one = rows(10**6)
    assert any(decontaminate.THRESHOLD <= r[2] < 0.97 for r in one)
    assert len(list(decontaminate.indexes(table, 600))) > 6
    assert rows(600) == one == rows(2000)


def test_overlaps_decide():
    """A passage must hold most of the item, half of its question and half of its answer's words."""
    question, answer = "which river runs through the old town of the northern province where the copper bridge stands", "the winding green water"
    index = decontaminate.build([(1, question, answer), (2, "other words entirely for another item of the index", "none of them")])
    found = lambda t: set(decontaminate.matches(index, t))
    assert found(f"before that {question}? {answer}. and after") == {1}
    assert found(f"before that {question}? nobody could tell") == set()  # no answer
    assert found(f"so it was {answer} and nothing else") == set()  # no question
    words = question.split()
    assert found(" ".join(words[::-1]) + " " + answer) == set()  # the words, but no shingles
    index = decontaminate.build([(1, "who won", "the long list of people who came first in every race that the town has held")])
    assert set(decontaminate.matches(index, "the long list of people who came first in every race that the town has held")) == set()


def test_retrieval_is_exhaustive():
    """Block-max pruning returns all that scoring every item against every passage returns."""
    draw = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(draw.choices(vocabulary, k=draw.randint(4, 30))), " ".join(draw.choices(vocabulary, k=3))) for i in range(50)]
    index = decontaminate.build([*items, (99, None, ""), (98, None, None)])
    step = index.window // 2
    for _ in range(20):
        tokens = draw.choices(vocabulary + ["other"], k=draw.randint(1, 400))
        tokens[5:5] = decontaminate.words(items[draw.randrange(50)][1])
        ids = np.array([index.vocabulary.get(w, -1) for w in tokens])
        want = set()
        for p in range(max(1, -(-len(ids) // step) - 1)):
            own = set(ids[p * step : (p + 2) * step].tolist()) - {-1}
            score = np.zeros(len(index.ids))
            for t in own:
                score[index.item_id[index.item_at[t] : index.item_at[t + 1]]] += index.impact[index.item_at[t] : index.item_at[t + 1]]
            want |= {(p, int(i)) for i in np.flatnonzero(score >= decontaminate.THRESHOLD)}
        assert want <= {(p, i) for p, i, _ in decontaminate.retrieve(index, ids, step)}


# 4


def brute_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    lines = text.split("\n")
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def test_quality(docs, odd, empty):
    for df in (docs, odd):
        got = quality.quality(df).collect()
        assert key((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == key((d, *brute_quality(t)) for d, t in texts(df))
        assert not any(r.kept and r.base_failed for r in got)
    assert quality.quality(empty).count() == 0


def test_sketches_merge_and_bound_quantiles(spark):
    values = [random.Random(1).randrange(10**6) for _ in range(5000)]
    df = spark.createDataFrame([("en", f"s{i % 3}", v, 10**6) for i, v in enumerate(values)], "lang string, source string, n_symbols long, word_chars long")
    df = df.withColumns({c: F.lit(0).cast("long") for c in ("n_other", "n_upper", "n_repeat_words", "n_words")})
    sketch = quality.sketches(df).where("rule = 'symbols'")
    assert sketch.groupBy("level").agg(F.sum("n").alias("n")).where("n <> 5000").count() == 0
    fence = quality.fences(sketch).where("level = 2").first()["symbols_max"]
    q = np.quantile(values, [0.25, 0.75])
    assert fence == pytest.approx(q[1] + 6 * (q[1] - q[0]), rel=0.06)


def test_fences_follow_the_sketches(spark):
    """The same value is kept in a source where it is common and rejected in one where it is not; the floor acts in a
    constant source only; documents that fail the base rules are in no sketch; words too short are rejected too."""
    rng = random.Random(4)

    def text(size, marks):
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(size - 1, size + 1))) for _ in range(100)]
        for i in rng.sample(range(100), marks):
            words[i] = words[i][:-1] + "#"
        return " ".join(words)

    rows = [(i, text(6, rng.randint(5, 15)), "en", "code") for i in range(300)] + [(1000 + i, text(6, 0), "en", "prose") for i in range(300)]
    rows += [(5000, text(6, 14), "en", "code"), (5001, text(6, 14), "en", "prose"), (5002, text(6, 4), "en", "prose"), (5003, text(2, 0), "en", "prose")]
    rows += [(9000 + i, "# " * 60, "en", "prose") for i in range(2000)]
    got = {r.doc_id: r.kept for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i in range(300)) and all(got[1000 + i] for i in range(300))
    assert got[5000] and not got[5001] and got[5002] and not got[5003]
    assert not any(got[9000 + i] for i in range(2000))


# 5


def test_toxicity(spark, sf_dir, docs, odd, empty):
    labels = read(spark, sf_dir, "labels")
    out = toxicity.toxicity(docs, labels).collect()
    assert len(out) == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    model = toxicity.fit(docs, labels)
    assert toxicity.score(odd, model).count() == len(ROWS) and toxicity.score(empty, model).count() == 0
    assert {r.score for r in toxicity.toxicity(odd, labels.limit(0)).collect()}.pop() < 0.01
    kept = {r.doc_id for r in toxicity.without_toxic(docs, labels).collect()}
    assert kept == {r.doc_id for r in out if r.score < 0.7}


def test_toxicity_scores_by_definition(spark, sf_dir, docs):
    """sigmoid(b + sum of weights + sum of products of all pairs of factors), summed pair by pair."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    place = {int(t): i for i, t in enumerate(model.terms)}
    text = dict(texts(docs))
    for r in toxicity.score(docs, model).collect():
        held = sorted({place[h] for h in toxicity.hashes_of(text[r.doc_id], model.bits, {}) if h in place})
        z = model.bias + sum(model.w[i] for i in held) + sum(float(model.v[i] @ model.v[j]) for n, i in enumerate(held) for j in held[:n])
        assert r.score == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))), abs=1e-9)


def test_labels_with_nulls_and_several(spark, docs):
    """Null labels and ids teach nothing; of several labels of one document the largest counts."""
    ids = [r.doc_id for r in docs.select("doc_id").collect()]
    plain = [(i, int(i % 3 == 0)) for i in ids]
    messy = plain + [(i, 0) for i in ids if i % 6 == 0] + [(i, None) for i in ids] + [(None, 1), (None, None)]
    fitted = [toxicity.fit(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (plain, messy)]
    assert (fitted[0].terms == fitted[1].terms).all() and fitted[0].bias == fitted[1].bias and (fitted[0].w == fitted[1].w).all()


def test_factorization_machine_learns_a_pair():
    """Neither term alone is toxic; both together are: no linear weights can say that."""
    draw = np.random.default_rng(2)
    has = draw.random((4000, 2)) < 0.5
    y = (has.all(axis=1)).astype(float)
    lists = [[1] * a + [2] * b for a, b in has.astype(int)]
    flat, counts = np.array([i for x in lists for i in x]), np.array([len(x) for x in lists])
    model = toxicity.train(y, flat, counts, toxicity.Settings(epochs=80))
    logit = lambda terms: model.logits(np.searchsorted(model.terms, terms), np.array([len(terms)]))[0]
    assert logit([1, 2]) > 1 and logit([1]) < -1 and logit([2]) < -1


def test_held_out_toxicity_at_scale(spark):
    d = "/root/testdata/sf0.1"
    labels = read(spark, d, "labels")
    scored = toxicity.toxicity(read(spark, d, "documents"), labels).where("held_out").join(labels, "doc_id")
    rows = scored.select("toxic", "predicted").collect()
    found = sum(r.predicted for r in rows if r.toxic) / sum(r.toxic for r in rows)
    wrong = sum(r.predicted for r in rows if not r.toxic) / len(rows)
    assert found > 0.7 and wrong < 0.005


# 6


def test_urls(spark, sf_dir):
    extra = [(None, None), (-1, "no scheme"), (-2, "http://COM/"), (-3, "x://a.b.NET/fr/z?q"), (-4, "http://notnet/fr/"), (-5, "http://example.com/en"), (-6, "a://"), (-6, "http://www.example.com/en/#x/de/"), (-7, "http://net/es/" + "a" * 5000)]
    pages = read(spark, sf_dir, "pages").select("page_id", "url", F.lit("x").alias("host")).unionByName(spark.createDataFrame([(*r, "y") for r in extra], "page_id long, url string, host string"))
    want = []
    for r in pages.collect():
        rest = r.url.split("://", 1)[1] if r.url and "://" in r.url else ""
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [(len(h + p), h + p, a) for a, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want.append((r.page_id, host, path, *(max(fits)[1:] if fits else (None, "allow"))))
    assert key(tuple(r) for r in urls.verdicts(pages).collect()) == key(want)
    assert urls.verdicts(pages, rules=()).where("rule IS NOT NULL").count() == 0
    # rules from a table, with a list that is cut into parts
    hosts = pages.where("url IS NOT NULL").select("url").limit(30).collect()
    rules = [("block", re.sub("[/?#].*", "", r.url.split("://")[-1]).upper(), "/") for r in hosts] + list(urls.RULES) + [("allow", None, "/")]
    given = spark.createDataFrame(rules, "action string, host string, path string")
    whole, cut = urls.verdicts(pages, given), urls.verdicts(pages, given, urls.Settings(max_bits=128))
    assert key(map(tuple, whole.collect())) == key(map(tuple, cut.collect())) and whole.where("verdict = 'block'").count() >= 20
    assert urls.verdicts(pages.limit(0)).count() == 0


def test_cascade_is_exact(spark):
    universe = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where("xxhash64(key, 5) % 7 = 0")
    levels = urls.cascade(listed, universe, urls.Settings(bits_per_key=4, hashes=3))
    assert len(levels) > 2
    answer = universe.withColumns({f"w{i}": x.words.scalar() for i, x in enumerate(levels)})
    answer = answer.select("key", urls.member(levels, F.col("key"), [F.col(f"w{i}") for i in range(len(levels))]).alias("m"))
    assert answer.where("m <> (xxhash64(key, 5) % 7 = 0)").count() == 0


# 7


def brute_repeats(rows, length=repeats.LENGTH):
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for (d, _), b in zip(rows, raw):
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length if i + length < len(gone) else -1] -= 1
        covered = np.cumsum(gone[:-1]) > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~covered])
        out.append((d, len(b), int(covered.sum()), int((np.diff(np.r_[0, covered.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return key(out)


@pytest.mark.parametrize("largest", [24 << 20, 2000])
def test_repeats(spark, odd, empty, largest):
    draw = random.Random(1)
    base = "".join(draw.choice("abcdé fgh") for _ in range(4000))
    rows = [(i, base[(a := draw.randrange(2500)) : a + draw.randrange(300, 1400)] + str(i)) for i in range(30)]
    rows += [(100, base[:390] * 3), (101, "z" * 3000), (102, "z" * 399), (103, base), (104, base), (103, base)]
    df = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    out = repeats.without_repeats(df, repeats.Settings(largest=largest))
    assert key(tuple(r) for r in out.collect()) == brute_repeats(texts(df))
    assert repeats.without_repeats(empty).count() == 0


def test_common_passage_is_split(spark):
    """A passage in many different surroundings: its key is split by place, and by window, and stays exact."""
    draw = random.Random(3)
    word = lambda n: "".join(draw.choice("abcdefgh ") for _ in range(n))
    passage, twice = word(900), word(450)
    rows = [(i, word(draw.randrange(40)) + passage[draw.randrange(9) :] + word(draw.randrange(60))) for i in range(60)]
    rows += [(100 + i, (twice[:60] * 12) + word(i) + twice) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = repeats.without_repeats(df, repeats.Settings(largest=3000))
    assert key(tuple(r) for r in out.collect()) == brute_repeats(rows)


def test_run_length_index():
    draw = random.Random(4)
    for n in (1, 2, 50, 300):
        text = np.array([draw.randrange(3) for _ in range(n)] + [300])
        got = repeats.RunLengthIndex.build(text).statistics()
        for i in range(len(text)):
            best = 0
            for j in range(len(text)):
                k = 0
                while j != i and max(i, j) + k < len(text) and text[i + k] == text[j + k]:
                    k += 1
                best = max(best, k)
            assert got[i] == best


# 8


def counted(texts):
    """A language's four-byte strings in order, and their counts."""
    found = Counter(t[i : i + 4] for t in texts for i in range(len(t) - 3))
    order = sorted(found)
    return np.array([int.from_bytes(g, "big") for g in order], np.uint32), np.array([found[g] for g in order], np.uint32)


def test_language_code_lengths():
    """The tables give what walking the context trees byte by byte gives."""
    train = {"a": [b"abracadabra abracadabra", b"banana band"], "b": [b"xyzzy abba", b"zzz"]}
    rows = []
    for lang, ts in train.items():
        grams = Counter(t[i : i + 4] for t in ts for i in range(len(t) - 3))
        rows += [(lang, int.from_bytes(g, "big"), n) for g, n in grams.items()]
    grams = [counted(train[x]) for x in "ab"]
    model = langid.build(["a", "b"], grams)

    def walk(lang, text):
        grams = {int(g).to_bytes(4, "big"): n for x, g, n in rows if x == lang}
        total = 0
        for i, c in enumerate(text):
            p = 1.0
            for order in (3, 2, 1, 0):
                if order > i:
                    continue
                after = Counter()
                for g, n in grams.items():
                    if g[3 - order : 3] == text[i - order : i]:
                        after[g[3]] += n
                if not after:
                    continue
                whole = sum(after.values()) + len(after)
                if after[c]:
                    p *= after[c] / whole
                    break
                p *= len(after) / whole
            else:
                p /= 256
            total += round(-np.log2(p) * langid.UNIT)
        return total

    probes = [b"abracadabra", b"", b"z", b"zzzz\xff\xfe q", b"band xyzzy" * 5]
    got = model.lengths(probes)
    assert np.abs(got - np.array([[walk(x, t) for x in "ab"] for t in probes])).max() <= max(map(len, probes))
    assert (model.lengths([probes[4]] * 3) == got[4]).all() and (model._long(probes[4]) == got[4]).all()
    assert isinstance(model, langid.Trees) and (langid.Sorted(["a", "b"], grams).lengths(probes) == got).all()


@pytest.fixture(scope="module")
def many_languages():
    """200 languages with alphabets of their own among all bytes, and texts of each."""
    draw = np.random.default_rng(2)
    names = [f"l{i:03d}" for i in range(200)]
    letters = {x: draw.permutation(np.arange(1, 256))[:60] for x in names}
    make = lambda x, k: bytes(letters[x][(draw.integers(0, 60, k) * draw.random(k)).astype(int)].astype(np.uint8))
    return names, make, [counted([make(x, 10_000)]) for x in names]


def test_many_languages_lose_nothing(many_languages):
    """Where tables of all languages are too large, sorted n-grams give the same lengths, and every language is told."""
    names, make, grams = many_languages
    sorted_ = langid.build(names, grams)
    assert isinstance(sorted_, langid.Sorted)
    assert sum(g.nbytes + n.nbytes for g, n in sorted_.grams) < 32 << 20
    texts = [make(x, 150) for x in names]
    got = sorted_.lengths(texts)
    assert [names[i] for i in got.argmin(axis=1)] == names
    few = langid.build(names[:2], grams[:2], 1 << 40)
    assert isinstance(few, langid.Trees)
    # a language's lengths do not depend on which others there are, nor on the form
    assert (few.lengths(texts[:20]) == got[:20, :2]).all()
    long = (texts[0] + texts[7] + b"\0\xff") * 7000
    assert len(long) > 2 * langid.CHUNK
    assert (few.lengths([b"", long, b"ab"]) == langid.Sorted(names[:2], grams[:2]).lengths([b"", long, b"ab"])).all()


def test_language_forms_agree_on_documents(docs):
    """Predictions and scores are the same by tables and by sorted n-grams."""
    by = lambda n: key((r.doc_id, r.held_out, r.lang_pred, r.score) for r in langid.languages(docs, langid.Settings(table_bytes=n)).collect())
    assert by(256 << 20) == by(0)


def test_languages(docs, odd, empty):
    out = langid.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97
    model = langid.languages(odd).collect()
    assert {r.doc_id: r.lang_pred for r in model if r.doc_id in (1, 2, 3)} == {1: "und", 2: "und", 3: "und"} and len(model) == len(ROWS)
    assert langid.languages(empty).count() == 0


# 9


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(values):
    left, out = dict(enumerate(values)), {}
    while left:
        i, _ = left.popitem()
        group, queue = [i], [values[i]]
        while queue:
            x = queue.pop()
            for j in [j for j, y in left.items() if (x ^ y).bit_count() <= 4]:
                group.append(j)
                queue.append(left.pop(j))
        for j in group:
            out[j] = sorted(group)
    return out


def test_simhash(docs, odd, empty):
    df = docs.select("doc_id", "text").unionByName(odd.select(F.col("doc_id") + 10_000, "text").toDF("doc_id", "text"))
    rows = texts(df)
    values = [brute_fingerprint(t) for _, t in rows]
    groups = brute_components(values)
    low = lambda g: min((rows[j][0] for j in g if rows[j][0] is not None), default=None)
    want = [(d, f"{values[i]:016x}", low(groups[i])) for i, (d, _) in enumerate(rows)]
    assert key(tuple(r) for r in simhash.near_duplicates(df).collect()) == key(want)
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {low(g) for g in brute_components([brute_fingerprint(t) for _, t in texts(docs)]).values()}


def test_keys_meet_within_four_bits():
    draw = random.Random(9)
    for _ in range(400):
        x = draw.getrandbits(64)
        y = x
        for b in draw.sample(range(64), draw.randint(0, 4)):
            y ^= 1 << b
        row, found = simhash.keys(np.array([x, y], np.uint64))
        assert set(found[row == 0]) & set(found[row == 1])


def test_golay_code_is_perfect():
    """Each of the 4096 codewords has the 2048 words within three bits of it, and no other."""
    words = np.arange(1 << 23)
    index = simhash.codeword(words)
    assert (np.bincount(index) == 2048).all() and len(np.bincount(index)) == 4096
    error, (a, b, c) = simhash._golay()
    errors = error[a[words & 255] ^ b[words >> 8 & 255] ^ c[words >> 16]]
    assert np.bitwise_count(errors).max() == 3 and (simhash.codeword(words ^ errors) == index).all()


def test_hot_component(spark):
    """Thousands of fingerprints in a chain of near ones, and copies: one component."""
    draw = np.random.default_rng(3)
    base = int(draw.integers(0, 2**62))
    values = {base}
    while len(values) < 3000:
        values.add(base ^ sum(1 << int(b) for b in draw.choice(63, 2, replace=False)) ^ (1 << int(draw.integers(0, 40))))
    df = spark.createDataFrame([(int(v) if v < 2**63 else int(v) - 2**64,) for v in values], "fp long")
    found = simhash.components(simhash.links(df))
    assert found.select("root").distinct().count() == 1


# 10

KINDS = ["email", "ip", "card", "phone"]
PLAIN = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def luhn(digits):
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(digits)))) % 10 == 0


def brute_pii(text):
    out = []
    for k, pattern in enumerate(PLAIN):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = [True, k == 1 and all(int(x) <= 255 for x in m[0].split(".")), 14 <= len(digits) <= 19 and luhn(digits), 10 <= len(digits) <= 15][k]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii(spark, docs, odd, empty):
    draw = random.Random(8)
    noise = [(1000 + i, "".join(draw.choice(["a", "@", ".", "..", "-", "_", "b.c", " ", "1", "22", "+1", "(", ")", "4111111111111111", "10.0.0.1", "é", "😀", "\n", "\ue000", "@x.y", "0000255."]) for _ in range(draw.randint(1, 40)))) for i in range(400)]
    noise += [(2000, "a@" + "b." * 20000 + "c"), (2001, "1" * 50000), (2002, "x" * 100000), (2003, "1-" * 30000 + "1"), (2004, "+1" + " " * 20000)]
    df = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text")).unionByName(spark.createDataFrame(noise, "doc_id long, text string"))
    want, got = [], []
    for d, t in texts(df):
        found = brute_pii(t)
        listed = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)
        want.append((d, *[sum(x[1] == k for x in found) for k in range(4)], hashlib.sha256(listed.encode()).hexdigest()))
    out = pii.personal_data(df).collect()
    for r in out:
        got.append((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256))
        base = [x for x in r.spans.split(",") if x and x.split(":")[0] in KINDS]
        assert len(base) >= r.n_email + r.n_ip + r.n_card + r.n_phone
    assert key(got) == key(want)
    assert pii.personal_data(empty).count() == 0


def test_redaction(spark, docs, odd):
    out = pii.redacted(docs.unionByName(odd.select(docs.columns)))
    assert out.columns == docs.columns and out.count() == docs.count() + len(ROWS)
    assert not any(brute_pii(r.text) for r in out.collect())
    one = spark.createDataFrame([(1, "é a@b.co, +1 (555) 010-1234 end")], "doc_id long, text string")
    assert pii.redacted(one).first()["text"] == "é [EMAIL], [PHONE] end"


def test_trees_learn_secrets(spark):
    draw = random.Random(2)
    rows = [(i, f'words token = "{draw.getrandbits(160):040x}" more') for i in range(200)] + [(i, f"part {draw.getrandbits(64):016x}abc of a list") for i in range(200, 400)]
    out = pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(("secret" in r.spans) == (r.doc_id < 200) for r in out)
    assert json.dumps(pii.fit([]).trees) == "[]"


# the queries and the pipeline


def test_registered_queries(spark, sf_dir):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {re.match(r"op(\d+)_", n)[1] for n in names if n.startswith("op")} == {str(i) for i in range(1, 14)}
    for name in (n for n in names if re.match(r"op\d+_", n)):
        assert names[name](spark, sf_dir).columns


def test_pipeline_stage_by_stage(spark, sf_dir):
    import corpus_pipeline

    docs = read(spark, sf_dir, "documents")
    columns, seen = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], sf_dir).cache())
    ids = [{r.doc_id for r in x.select("doc_id").collect()} for x in seen]
    assert all(x.columns == columns for x in seen[:-1])
    labels = read(spark, sf_dir, "labels")
    assert ids[1] == {r.doc_id for r in toxicity.toxicity(docs, labels).where("predicted = 0").collect()}
    groups = brute_components([brute_fingerprint(t) for _, t in texts(seen[1])])
    order = [d for d, _ in texts(seen[1])]
    assert ids[2] == {min(order[j] for j in g) for g in groups.values()}
    items = [r.text for r in read(spark, sf_dir, "benchmark").collect()]
    assert ids[3] == {d for d, t in texts(seen[2]) if not any(x in t for x in items)}
    assert ids[4] == ids[3] and not any(brute_pii(t) for _, t in texts(seen[4]))
    check_pieces(seen[4], seen[5])
    for x in seen[1:]:
        x.unpersist()


@pytest.mark.parametrize("which", ["odd", "empty"])
def test_pipeline_on_awkward_rows(spark, sf_dir, request, which):
    """Every stage takes null, empty, long and repeated rows, other columns, and no rows at all."""
    import corpus_pipeline

    docs = request.getfixturevalue(which)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        rows = out.count()
        assert (rows > 0) == (which == "odd")
        if out.columns == docs.columns:
            docs = out
    kept = {r.doc_id for r in docs.collect()}
    assert which == "empty" or (5 in kept and 6 not in kept and None in kept)  # 5 and 6 are copies
