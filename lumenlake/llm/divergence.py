"""Source divergence audit: how each source's use of terms differs from its language's other sources.

Terms are maximal runs of ASCII letters and non-ASCII characters, A-Z lower-cased. A language keeps the terms
that are in at least `least` of its documents (V of them). A group is a (language, source) that occurs, or a
whole language. With `count` a kept term's occurrences in a group and N their sum, the group's share of the term
is p = 1 + floor(10^9 (count + 2) / (N + 2 V)), an exact integer; two shares differ by f = floor((p - q)^2 / (p + q)).

Pairs. The divergence of two sources is the sum of f over all V terms, most of which neither source has. It is
taken from what is there: V times the f of two absent terms (the baseline), plus for each source a correction per
distinct count (its share against the other's absent share), plus a correction per term that both sources have.
Only the last needs the terms themselves: a term's sources meet in rows of one value of (language, term), and
each unordered pair is made once and summed map-side.

Terms. A group's terms with p above the language's q are ranked by f, the first `top` returned. The k-th value of
every group is found by radix selection: histograms over the value's bits, RADIX bits at a time from the highest,
each keyed by group and digit and so summed map-side; the digit in which the k-th falls narrows the group to the
rows below it. Rows above the threshold are taken; of those equal to it the first by UTF-8 bytes are, by the
same selection over the bytes of the term, two at a time. No group is sorted or gathered: what is ranked in the end is
`top` rows a group.

Edge cases: null text, lang and source are ''. A group without any kept term still has its pairs; a language
without kept terms has pairs of value 0. Equal values rank by the item's UTF-8 bytes. Repeated rows and ids count as
often as they come; an empty table gives an empty result; other columns are not looked at. Counts are longs and products
are decimals of 38 digits, so shares are exact up to 10^18 occurrences.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenlake.llm.common import discard, mapped, stored, values

SHARE = 1_000_000_000
#: Bits of a digit of the radix selection, and bits of a value (f is at most SHARE + 1).
RADIX, BITS = 10, 30
#: Distinct terms that a task holds before it hands their counts on.
HELD = 200_000
#: What is no term becomes a blank, A-Z become a-z; bytes of other characters stay.
_LETTERS = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256)).lower()


@dataclass(frozen=True)
class Settings:
    least: int = 10
    top: int = 10


def terms(text: str) -> list[bytes]:
    """The terms of a text as UTF-8, in order."""
    return text.encode("utf-8", "surrogatepass").translate(_LETTERS).split()


def _counted(batches):
    """Rows (lang, source, term, n, docs) of what each task has read, and a row without a term for each group."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def handed():
        for (lang, source), (often, docs) in held.items():
            words = [None, *often]
            yield [pa.array([lang] * len(words), pa.string()), pa.array([source] * len(words), pa.string()), pa.array([w and w.decode("utf-8", "replace") for w in words], pa.string()), pa.array([0, *often.values()], pa.int64()), pa.array([0, *map(docs.__getitem__, often)], pa.int64())]
        held.clear()

    for batch in batches:
        for text, lang, source in zip(*map(values, batch.columns)):
            own = held.setdefault((lang or "", source or ""), (Counter(), Counter()))
            before = len(own[0])
            found = terms(text or "")
            own[0].update(found)
            own[1].update(set(found))
            size += len(own[0]) - before
            if size >= HELD:
                yield from handed()
                size = 0
    yield from handed()


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SHARE (count + 2) / (total + 2 kept)), exactly."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.call_function("div", (wide(count) + 2) * F.lit(SHARE), wide(total + 2 * kept)) + 1


def difference(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); both are at most SHARE + 1, so a long holds the square."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _kept_terms(counts: DataFrame, least: int) -> DataFrame:
    return counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= least).select("lang", "term", "lang_n")


def _first_by_radix(rows: DataFrame, group: list[str], top: int) -> DataFrame:
    """The rows (group, value, term) of the first `top` of each group by value descending, then term: all rows
    above the group's threshold and the first equal ones. Stored tables are used up."""
    state = rows.groupBy(*group).agg(F.count("*").alias("n")).select(*group, F.least("n", F.lit(top)).alias("open"), F.lit(0).cast("long").alias("prefix"))
    for low in range(BITS - RADIX, -1, -RADIX):
        # of each group the rows whose higher bits are the prefix, by their next digit
        inside = rows.join(state, group).where(F.shiftright("value", low + RADIX) == F.col("prefix"))
        bins = inside.groupBy(*group, "open", F.shiftright("value", low).alias("digit")).agg(F.count("*").alias("n"))
        above = F.sum("n").over(W.partitionBy(*group).orderBy(F.desc("digit"))) - F.col("n")  # at most 2^RADIX rows a group
        found = bins.withColumn("above", above).where((F.col("above") < F.col("open")) & (F.col("open") <= F.col("above") + F.col("n")))
        state = stored(found.select(*group, (F.col("open") - F.col("above")).alias("open"), F.col("digit").alias("prefix")), "radix")
    told = rows.join(state, group)
    over = told.where(F.col("value") > F.col("prefix")).select(*group, "term", "value")
    equal = told.where(F.col("value") == F.col("prefix")).select(*group, "term", "value", "open", F.hex(F.col("term").cast("binary")).alias("bytes"))
    return over.unionByName(_first_by_bytes(stored(equal, "equal"), group).select(*group, "term", "value"))


def _first_by_bytes(rows: DataFrame, group: list[str]) -> DataFrame:
    """Of rows (group, open, bytes in hex, term, value) the first `open` of each group by bytes. Each round looks at the
    next bytes of the groups that are not decided: those below the deciding bytes are taken, those above go."""
    taken = None
    at = 0
    while True:
        size = rows.groupBy(*group).agg(F.count("*").alias("n"))
        told = rows.join(size, group)
        whole = told.where(F.col("n") <= F.col("open")).drop("n")
        taken = whole if taken is None else taken.unionByName(whole)
        rest = stored(told.where(F.col("n") > F.col("open")).drop("n"), "ties")
        # bytes that all rows of every undecided group share need no round
        ends = rest.groupBy(*group).agg(F.min("bytes").alias("a"), F.max("bytes").alias("b"))
        same = ends.select(F.coalesce(F.expr("aggregate(sequence(1, least(length(a), length(b))), 0, (k, i) -> if(k = i - 1 and substr(a, i, 1) = substr(b, i, 1), i, k))"), F.lit(0)).alias("k"))
        shared = same.agg(F.min("k")).first()[0]  # one number
        if shared is None:
            return taken
        at = max(at, shared)
        digit = F.substring("bytes", at + 1, 4)  # two bytes; a term that ends here comes first
        bins = rest.groupBy(*group, "open", digit.alias("digit")).agg(F.count("*").alias("n"))
        before = F.sum("n").over(W.partitionBy(*group).orderBy("digit")) - F.col("n")
        found = bins.withColumn("before", before).where((F.col("before") < F.col("open")) & (F.col("open") <= F.col("before") + F.col("n")))
        found = found.select(*group, F.col("digit").alias("at_digit"), (F.col("open") - F.col("before")).alias("still"))
        split = rest.join(found, group)
        taken = taken.unionByName(split.where(digit < F.col("at_digit")).select(*rest.columns))
        rows = stored(split.where(digit == F.col("at_digit")).withColumn("open", F.col("still")).select(*rest.columns), "ties")
        at += 4


def divergence(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    s = settings or Settings()
    read = mapped(docs.select("text", "lang", "source"), _counted, "lang string, source string, term string, n long, docs long")
    counts = stored(read.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    kept = stored(_kept_terms(counts, s.least), "terms")
    langs = kept.groupBy("lang").agg(F.count("*").alias("V"), F.sum("lang_n").alias("lang_total"))
    own = stored(counts.where("term IS NOT NULL").join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "own")
    totals = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    groups = counts.where("term IS NULL").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", zero("total"), zero("V"), zero("lang_total"))
    absent = F.when(F.col("V") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("V"))).otherwise(F.lit(0).cast("long"))
    groups = stored(groups.withColumn("p0", absent), "groups")

    shares = own.join(groups, ["lang", "source"]).select("lang", "source", "term", "n", "p0", "lang_n", "lang_total", "V", share(F.col("n"), F.col("total"), F.col("V")).alias("p"))
    shares = stored(shares, "shares")
    out = _pairs(shares, groups).unionByName(_terms(shares, s.top))
    out = stored(out, "divergence")
    discard(counts, kept, own, groups, shares)
    return out


def _pairs(shares: DataFrame, groups: DataFrame) -> DataFrame:
    side = lambda df, a, *cs: df.select("lang", *[F.col(c).alias(f"{a}_{c}") for c in ("source", *cs)])
    own, other = side(groups, "a", "p0", "V"), side(groups, "b", "p0")
    couples = own.join(other, "lang").where("a_source < b_source")  # the result has these rows twice
    base = F.when(F.col("a_V") > 0, F.col("a_V") * difference(F.col("a_p0"), F.col("b_p0"))).otherwise(F.lit(0).cast("long"))
    # a source's terms by their distinct shares, each against the other's absent share
    steps = shares.groupBy("lang", "source", "p0", "p").agg(F.count("*").alias("often"))
    alone = steps.join(other, "lang").where("source <> b_source")
    fix = F.sum(F.col("often") * (difference(F.col("p"), F.col("b_p0")) - difference(F.col("p0"), F.col("b_p0"))))
    alone = alone.select(F.least("source", "b_source").alias("a_source"), F.greatest("source", "b_source").alias("b_source"), "lang", "often", "p", "p0", "b_p0").groupBy("lang", "a_source", "b_source").agg(fix.alias("fix"))
    # terms of both: the true difference in place of both corrections
    both = side(shares, "a", "p", "p0", "term").withColumnRenamed("a_term", "term").join(side(shares, "b", "p", "p0", "term").withColumnRenamed("b_term", "term"), ["lang", "term"]).where("a_source < b_source")
    p, q, p0, q0 = (F.col(c) for c in ("a_p", "b_p", "a_p0", "b_p0"))
    shared = both.groupBy("lang", "a_source", "b_source").agg(F.sum(difference(p, q) - difference(p, q0) - difference(p0, q) + difference(p0, q0)).alias("fix"))
    fixes = alone.unionByName(shared).groupBy("lang", "a_source", "b_source").agg(F.sum("fix").alias("fix"))
    one = couples.withColumn("base", base).join(fixes, ["lang", "a_source", "b_source"], "left")
    one = one.select("lang", "a_source", "b_source", (F.col("base") + F.coalesce("fix", F.lit(0))).cast("long").alias("value"))
    named = lambda a, b: one.select("lang", F.col(a).alias("source"), F.lit("pair").alias("part"), F.col(b).alias("item"), "value")
    each = named("a_source", "b_source").unionByName(named("b_source", "a_source"))
    return each.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))  # a row for each other source


def _terms(shares: DataFrame, top: int) -> DataFrame:
    q = share(F.col("lang_n"), F.col("lang_total"), F.col("V"))
    above = shares.withColumn("q", q).where(F.col("p") > F.col("q")).select("lang", "source", "term", difference(F.col("p"), F.col("q")).alias("value"))
    above = stored(above, "above")
    first = _first_by_radix(above, ["lang", "source"], top)
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "term"))  # `top` rows a group
    return first.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", rank.alias("rank"))
