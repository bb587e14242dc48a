r"""Personal data: strict rules, and gradient-boosted trees over the spans that wide generators propose.

Everything is Spark SQL expressions; nothing is shuffled but a table of counts.

Strict spans (they always stay), leftmost and non-overlapping for each kind:
email, ip (parts at most 255), card (14 to 19 digits, Luhn), phone (+, 10 to 15 digits).

The method adds spans. Generators of high recall propose candidates that may overlap: addresses
up to the first dot of their domain, dotted quads of any size, runs of digits with separators, and
unbroken letter-and-digit strings. Each has features of format (length, share of digits, digit
groups, character classes, Luhn) and of context (an assignment sign or a cue word before it).
Features are small integers, so the training set is a table of counts for each combination, at
most some thousand rows however large the corpus, and all of the corpus counts. Labels are weak:
a candidate is positive if a strict span of its kind overlaps it, or, for the kind `secret`, if
an explicit `token =` or the like stands before it. What makes a span strict is masked in its
features, in training as in use: the dotted domain of an address, the plus of a phone, the
separators of a card, all that stands before a secret. So the trees learn how such spans look without it
and add `user@localhost`, phones without a plus, cards with odd separators and secrets without a cue.
Quads with a part over 255 are no addresses; nothing of an ip is masked.

Trees are fitted on four fifths of the documents; on the other fifth each kind's threshold is set to
the lowest score from which at least Settings.precision of the candidates, masked like the rest, are
positive (no such score: none is added). Candidates outside the strict rules have no labels and count
as negatives there, so a look that is common without the rule's mark is not added. Secrets with a cue
are always added.

Positions count code points. A match is found by splitting the text at the pattern, so that
gaps and matches alternate and running sums of lengths give offsets. The patterns are equal to the plain ones in
the comments but have no repeated groups, which overflow the regex engine's stack in long texts,
and no start inside a run that has failed, which would take quadratic time. Running sums are made in
as many passes as the number of matches has bits, overlaps are found by binary search, and texts are
read in pieces of CHUNK code points, so the time for a text of n matches grows as n log n.

Edge cases: null texts are empty; rows with null ids are treated like others, in the fitted part;
repeated rows count each time; no candidates at all gives no trees and adds nothing; other columns,
whatever their names and types, come back from redacted() as they were.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.common import fold, stored

#: In the order in which spans with one start are listed.
KINDS = ("email", "ip", "card", "phone", "secret")
SPAN = "struct<s:bigint,e:bigint,m:string,b:string,a:string>"
CANDIDATE = "struct<s:bigint,e:bigint,k:int,label:int,f:array<int>>"
#: Stands for a dot between two label characters; the text's own is replaced by the next one.
DOT, OWN_DOT = "\ue000", "\ue001"
LOCAL = rf"[A-Za-z0-9._%+{DOT}-]"
#: email: [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
EMAIL = rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++{DOT}[A-Za-z0-9{DOT}-]+"
#: ip: [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: card: [0-9]([\x20-]?[0-9])+ where no two separators are adjacent any more
CARD = r"[0-9][0-9\x20-]*[0-9]"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: The generators: (kind, pattern, what the text must hold).
GENERATORS = (
    (0, rf"(?<!{LOCAL}){LOCAL}++@[A-Za-z0-9-]++", "@"),
    (1, r"(?<![0-9.])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    (2, r"(?<![0-9A-Za-z])[0-9][0-9\x20-]{11,40}[0-9](?![0-9A-Za-z])", ""),
    (3, r"(?<![0-9A-Za-z])[+(]?[0-9][0-9\x20().-]{7,24}[0-9](?![0-9A-Za-z])", ""),
    (4, r"(?<![0-9A-Za-z])(?=[A-Za-z]{0,200}[0-9])[0-9A-Za-z]{12,}+", ""),
)
CUE = r"(?i)(?:token|password|passwd|pwd|secret|api[_-]?key|credential)[\"']?\s{0,3}[=:]\s{0,3}[\"']?$"
SIGN = r"[=:]\s{0,3}[\"']?$"
#: Code points before a candidate that are looked at; code points of a text that are read together.
BEFORE, CHUNK = 24, 4096
FEATURES = ("kind", "length", "digits", "groups", "classes", "luhn", "context", "closed")


@dataclass(frozen=True)
class Settings:
    trees: int = 24
    rate: float = 0.4
    precision: float = 0.95
    least: int = 5


@dataclass(frozen=True)
class Model:
    """trees: (feature, cut, left, right) with nested tuples or leaf values; thresholds by kind."""

    bias: float
    trees: tuple
    thresholds: tuple


def let(value: Column, then) -> Column:
    """then(value), with the value made once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def bits_of(n: Column) -> Column:
    return F.ceil(F.log2(F.greatest(n, F.lit(2)))).cast("int")


def running(numbers: Column, f) -> Column:
    """f over each element and all before it, by doubling."""
    steps = F.transform(F.sequence(F.lit(0), bits_of(F.size(numbers))), lambda k: F.pow(F.lit(2), k).cast("int"))
    joined = lambda a, far: F.transform(a, lambda x, i: F.when(i >= far, f(x, F.get(a, i - far))).otherwise(x)).cast("array<bigint>")
    return F.aggregate(steps, numbers.cast("array<bigint>"), joined)


def spans(text: Column, pattern: str) -> Column:
    """All matches of a pattern as array<struct<s, e, m, b, a>>: start and end in code points, the match,
    what stands before it and the character after it."""
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"))

    def placed(x):
        ends = running(F.transform(x["m"], lambda m, i: F.char_length(m) + F.char_length(F.get(x["g"], i))), lambda p, q: p + q)

        def span(end):
            def one(m, i):
                near = F.right(F.concat(F.coalesce(F.get(x["m"], i - 1), F.lit("")), F.get(x["g"], i)), F.lit(BEFORE))
                e = F.get(end, i)
                return F.struct((e - F.char_length(m)).alias("s"), e.alias("e"), m.alias("m"), near.alias("b"), F.left(F.get(x["g"], i + 1), F.lit(1)).alias("a"))

            return F.transform(x["m"], one).cast(f"array<{SPAN}>")

        return F.when(F.size(x["m"]) > 0, let(ends, span)).otherwise(F.array().cast(f"array<{SPAN}>"))

    return let(both, placed)


def overlapped(base: Column, x: Column) -> Column:
    """Whether a span of base, which are in order and apart, overlaps x."""

    def last(at, step):
        return F.when((at + step <= F.size(base)) & (F.get(base, at + step - 1)["s"] < x["e"]), at + step).otherwise(at)

    steps = F.transform(F.sequence(bits_of(F.size(base)), F.lit(0)), lambda k: F.pow(F.lit(2), k).cast("int"))
    found = F.aggregate(steps, F.lit(0), last, lambda at: F.coalesce((at > 0) & (F.get(base, at - 1)["e"] > x["s"]), F.lit(False)))
    return F.when(F.size(base) > 0, found).otherwise(False)


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(s: Column) -> Column:
    """Whether the last 19 digits or fewer of s pass Luhn's check."""
    back = F.reverse(digits(s))
    each = F.transform(F.sequence(F.lit(1), F.length(back)), lambda i: F.when(i % 2 == 0, F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), F.substring(back, i, F.lit(1)).cast("int") + 1)).otherwise(F.substring(back, i, F.lit(1)).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _octets(m: Column) -> Column:
    def small(part):
        bare = F.ltrim(part, F.lit("0"))
        return F.when(F.length(bare) <= 3, F.coalesce(bare.try_cast("int"), F.lit(0)) <= 255).otherwise(False)

    return F.forall(F.split(m, r"\."), small)


def dotted(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, DOT, OWN_DOT), r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", DOT)


def strict(text: Column) -> list[Column]:
    """The strict spans of each of the four kinds."""
    none = F.array().cast(f"array<{SPAN}>")
    count = lambda m: F.length(digits(m))
    single = F.regexp_replace(text, r"[\x20-](?=[\x20-])|(?<=[\x20-])[\x20-]", "_")
    some = text.rlike("[0-9]")
    return [
        F.when(text.contains("@"), spans(dotted(text), EMAIL)).otherwise(none),
        F.when(some & text.rlike(r"[0-9]\.[0-9]"), F.filter(spans(text, IP), lambda x: _octets(x["m"]))).otherwise(none),
        F.when(some, F.filter(spans(single, CARD), lambda x: F.when(count(x["m"]).between(14, 19), luhn(x["m"])).otherwise(False))).otherwise(none),
        F.when(text.contains("+") & some, F.filter(spans(text, PHONE), lambda x: count(x["m"]).between(10, 15))).otherwise(none),
    ]


def _bin(value: Column, cuts: tuple) -> Column:
    out = F.lit(len(cuts))
    for i in reversed(range(len(cuts))):
        out = F.when(value < cuts[i], i).otherwise(out)
    return out


def candidates(text: Column, base: list[Column]) -> Column:
    """All generators' candidates with label and features, array<struct<s, e, k, label, f>>."""

    def shaper(kind: int):
        def shaped(x):
            m = x["m"]
            shown = digits(m) if kind == 2 else F.ltrim(m, F.lit("+")) if kind == 3 else m  # the rest is masked
            n, d = F.char_length(shown), F.length(digits(m))
            before, after = x["b"], x["a"]
            label = before.rlike(CUE) if kind == 4 else overlapped(base[kind], x)
            f = F.array(
                F.lit(kind),
                _bin(n, (10, 13, 15, 17, 20, 24, 32, 41)),
                _bin(d * 100 / n, (10, 35, 60, 85, 100)),
                _bin(F.length(F.regexp_replace(shown, "[0-9]++", "")), (1, 2, 4, 7, 12)),
                m.rlike("[a-z]").cast("int") + m.rlike("[A-Z]").cast("int") + m.rlike("[g-zG-Z]").cast("int"),
                F.when(d.between(14, 19), luhn(m)).otherwise(False).cast("int"),
                F.lit(0) if kind == 4 else F.when(before.rlike(CUE), 2).when(before.rlike(SIGN), 1).otherwise(0),
                F.lit(0) if kind == 0 else after.rlike("[\"'\\s.,;)|]").cast("int"),
            )
            return F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(kind).alias("k"), label.cast("int").alias("label"), f.alias("f"))

        return shaped

    parts = []
    none = F.array().cast(f"array<{CANDIDATE}>")
    for kind, pattern, needs in GENERATORS:
        source = dotted(text) if kind == 0 else text
        when = text.rlike("[0-9]") & (text.contains(needs) if needs else F.lit(True)) if kind else text.contains("@")
        parts.append(F.when(when, F.transform(spans(source, pattern), shaper(kind)).cast(f"array<{CANDIDATE}>")).otherwise(none))
    return F.concat(*parts)


def found(docs: DataFrame) -> DataFrame:
    """The rows of docs as a struct `row`, their texts, the strict spans (email, ip, card, phone) and the candidates."""
    out = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    bare = lambda spans_: F.transform(spans_, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
    out = out.withColumns({k: bare(c) for k, c in zip(KINDS, strict(F.col("text")))})
    return out.withColumn("candidates", candidates(F.col("text"), [F.col(k) for k in KINDS[:4]]))


def cells(rows: DataFrame) -> DataFrame:
    """The training table: label, held (held-out document), features, n."""
    held = F.coalesce(fold(F.col("row.doc_id"), 5) == 0, F.lit(False))
    one = rows.where(F.size("candidates") > 0).select(held.alias("held"), F.explode("candidates").alias("c"))
    return one.groupBy("held", F.col("c.label").alias("label"), F.col("c.f").alias("f")).agg(F.count("*").alias("n"))


def fit(table: list, settings: Settings = Settings()) -> Model:
    """Boosted trees of depth two on (held, label, f, n) rows, and a threshold for each kind."""
    if not table:
        return Model(0.0, (), (None,) * len(KINDS))
    held = np.array([r[0] for r in table])
    y, w = np.array([float(r[1]) for r in table]), np.array([float(r[3]) for r in table])
    x = np.array([r[2] for r in table])
    own = np.where(held, 0.0, w)
    rate = min(max((own * y).sum() / max(own.sum(), 1.0), 1e-3), 1 - 1e-3)
    bias = float(np.log(rate / (1 - rate)))
    score = np.full(len(y), bias)
    trees = []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
        value = lambda r: float(settings.rate * g[r].sum() / (h[r].sum() + 1.0))
        best = None
        if depth:
            worth = lambda r: g[r].sum() ** 2 / (h[r].sum() + 1.0)
            for j in range(x.shape[1]):
                for cut in np.unique(x[rows, j])[1:].tolist():
                    left, right = rows & (x[:, j] < cut), rows & (x[:, j] >= cut)
                    gain = worth(left) + worth(right) - worth(rows)
                    if gain > 1e-6 and (best is None or gain > best[0]):
                        best = (gain, j, cut, left, right)
        if best is None:
            return value(rows)
        return best[1], best[2], grow(best[3], g, h, depth - 1), grow(best[4], g, h, depth - 1)

    def apply(tree, out, rows):
        if not isinstance(tree, tuple):
            out[rows] += tree
            return
        low = x[:, tree[0]] < tree[1]
        apply(tree[2], out, rows & low)
        apply(tree[3], out, rows & ~low)

    everything = np.ones(len(y), bool)
    for _ in range(settings.trees):
        p = 1 / (1 + np.exp(-score))
        tree = grow(everything, own * (y - p), own * p * (1 - p), 2)
        apply(tree, score, everything)
        trees.append(tree)
    thresholds = []
    for k in range(len(KINDS)):
        mine = np.flatnonzero((x[:, 0] == k) & held)
        order = mine[np.argsort(-score[mine], kind="stable")]
        good, total = np.cumsum((w * y)[order]), np.cumsum(w[order])
        last = np.r_[score[order][1:] != score[order][:-1], True] if len(order) else np.zeros(0, bool)
        ok = np.flatnonzero(last & (good >= settings.precision * total) & (total >= settings.least))
        thresholds.append(float(score[order][ok[-1]]) if len(ok) else None)
    return Model(bias, tuple(trees), tuple(thresholds))


def train(rows: DataFrame, settings: Settings = Settings()) -> Model:
    """rows: of found()."""
    return fit([tuple(r) for r in cells(rows).collect()], settings)  # at most the combinations of features


def _logit(model: Model, f: Column) -> Column:
    def branch(tree) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(tree)
        return F.when(F.get(f, F.lit(tree[0])) < tree[1], branch(tree[2])).otherwise(branch(tree[3]))

    total = F.lit(model.bias)
    for tree in model.trees:
        total = total + branch(tree)
    return total


def added(model: Model, base: list[Column]) -> Column:
    """The candidates that the trees select and that overlap no strict span of their kind, and the
    secrets with a cue."""
    cued = len(KINDS) - 1

    def selected(k: int, least: float | None):
        if least is None:
            return lambda c: (c["k"] == k) & (c["label"] == 1)
        good = lambda c: _logit(model, c["f"]) >= least - 1e-9
        return lambda c: (c["k"] == k) & (((c["label"] == 1) | good(c)) if k == cued else good(c))

    def apart(k: int):
        return lambda c: ~overlapped(base[k], c)

    out = F.array().cast("array<struct<s:bigint,k:int,e:bigint>>")
    for k, least in enumerate(model.thresholds):
        if least is not None or k == cued:
            chosen = F.filter("candidates", selected(k, least))
            chosen = F.filter(chosen, apart(k)) if k < len(base) else chosen
            out = F.concat(out, F.transform(chosen, lambda c: F.struct(c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e"))))
    return out


def marked(rows: DataFrame, model: Model) -> DataFrame:
    """Adds base and all, sorted arrays of struct<s, k, e>; those added are apart from the strict ones of their kind."""
    base = [F.col(k) for k in KINDS[:4]]

    def tagged(k: int):
        return lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"))

    flat = F.concat(*[F.transform(b, tagged(k)) for k, b in enumerate(base)])
    out = rows.withColumn("base", F.sort_array(flat))
    return out.withColumn("all", F.sort_array(F.concat(F.col("base"), added(model, base))))


def listed(array: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(array, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def personal_data(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Counts of strict spans, their digest, and all spans, for every row of docs."""
    ids = found(docs.select("doc_id", "text")).withColumn("row", F.struct("row.doc_id"))
    rows = stored(ids.drop("text"), "pii")
    out = marked(rows, train(rows, settings))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:4]]
    return out.select("row.doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("all")).alias("spans"))


def replaced(text: Column, all_: Column) -> Column:
    """The text with every span's kind in brackets for it; overlapping spans by the first of them."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    both = F.struct(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)).alias("c"), running(F.transform(all_, lambda x: x["e"]), F.greatest).alias("e"))

    def cut(chunks: Column, a: Column, b: Column) -> Column:
        first = F.floor(a / CHUNK).cast("int")
        few = F.array_join(F.slice(chunks, first + 1, F.floor(b / CHUNK).cast("int") - first + 1), "")
        return F.substring(few, (a % CHUNK + 1).cast("int"), (b - a).cast("int"))

    def joined(x):
        def part(span, i):
            return let(F.coalesce(F.get(x["e"], i - 1), F.lit(0).cast("long")), lambda at: F.when(span["s"] >= at, F.concat(cut(x["c"], at, span["s"]), F.get(names, span["k"]))).otherwise(""))

        last = F.get(x["e"], F.size(x["e"]) - 1)
        return F.concat(F.array_join(F.transform(all_, part), ""), cut(x["c"], last, F.greatest(F.char_length(text).cast("long"), last)))

    return F.when(F.size(all_) > 0, let(both, joined)).otherwise(text)


def redacted(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """docs with every span replaced by its kind in brackets. The texts are matched once; rows and spans are kept
    in the shared folder."""
    rows = stored(found(docs), "pii")
    out = marked(rows, train(rows, settings))
    text = F.when(F.size("all") > 0, replaced(F.col("text"), F.col("all"))).otherwise(F.col("row.text"))
    return out.select(*[text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])
