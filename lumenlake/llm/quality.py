"""Quality rules whose thresholds come from mergeable quantile sketches.

One pass counts, for every whole text, words and what the rules look at. Each rule is a share in
millionths. Its distribution for each language and source is kept in a log-linear sketch: a
value keeps its seven leading bits, and the sketch is the count of each kept value, so sketches
of any two parts of the corpus merge by adding, in any order, to the same sketch, and quantiles
are within 1/64 of their value. Sketches are of the documents that pass the base rules. A rule rejects
what lies above the fence high + max(spread x (high - low), floor) of its language and source, where high and
low are two quantiles of the sketch; the floor acts only where these two are (nearly) one. A rule of both
sides also rejects what lies below low - max(spread x (high - low), floor). Groups with fewer than
Settings.least such documents use their language's merged sketch, small languages the whole corpus'.

Only the sketches are shuffled (a few hundred rows for a group, combined before the shuffle), so
a source with a third of all rows weighs no more than another.

Edge cases: a null text has no words and fails the base rules; null lang and source are groups
of their own; repeated rows are counted and judged each; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumenlake.llm.common import mapped, stored, values

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]+")
_LETTERS = re.compile(r"[^\W\d_]+")
BITS = 7

COUNTS = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_other long, n_upper long"


@dataclass(frozen=True)
class Rule:
    """numerator / denominator, in millionths, within the fences. low and high are percentiles."""

    numerator: str
    denominator: str
    spread: int
    floor: int
    low: int = 25
    high: int = 75
    both: bool = False


#: The adaptive rules. Repeats have most of their mass at 0, so their spread is taken further up.
RULES = {
    "symbols": Rule("n_symbols", "word_chars", 6, 10_000),
    "other": Rule("n_other", "word_chars", 12, 10_000),
    "upper": Rule("n_upper", "word_chars", 6, 10_000),
    "repeats": Rule("n_repeat_words", "n_words", 12, 100_000, 50, 90),
    "length": Rule("word_chars", "n_words", 6, 500_000, both=True),
}
FENCES = [n for k, r in RULES.items() for n in ([f"{k}_min"] if r.both else []) + [f"{k}_max"]]


@dataclass(frozen=True)
class Settings:
    least: int = 200


def counts(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_other, n_upper of a whole text.
    n_other: characters in words that are no letters; n_upper: upper-case letters."""
    if not text:
        return (0,) * 7
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    blank = sum(map(raw.count, b" \t\n\v\f\r"))
    chars = len(text) - blank
    symbols = sum(map(raw.count, (c.encode() for c in SYMBOLS)))
    seen: set[bytes] = set()
    repeated_lines = 0
    for line in raw.split(b"\n"):
        if line in seen:
            repeated_lines += bool(line.split())
        else:
            seen.add(line)
    letters = sum(map(len, _LETTERS.findall(text)))
    upper = sum(map(len, _UPPER.findall(text)))
    return n, chars, symbols, repeated_lines, repeat_words(words), chars - letters, upper


def repeat_words(words: list[bytes]) -> int:
    """Words in windows of three that occur twice or more, the first included."""
    n = len(words)
    if n < 4:
        return 0
    if n < 64:
        windows = list(zip(words, words[1:], words[2:]))
        often = Counter(windows)
        if len(often) == len(windows):
            return 0
        twice = np.array([often[w] > 1 for w in windows])
    else:
        ids: dict[bytes, int] = {}
        take = ids.setdefault
        x = np.array([take(w, len(ids)) for w in words], np.uint64)
        m = np.uint64(len(ids))
        if len(ids) < 2_600_000:
            code = (x[:-2] * m + x[1:-1]) * m + x[2:]
        else:  # exact beyond 64 bits too: pairs first
            _, pair = np.unique(x[:-1] * m + x[1:], return_inverse=True)
            code = pair[:-1].astype(np.uint64) * m + x[2:]
        order = np.argsort(code, kind="stable")
        same = code[order[1:]] == code[order[:-1]]
        if not same.any():
            return 0
        twice = np.zeros(len(code), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def _counted(batches):
    for batch in batches:
        found = np.array([counts(t) for t in values(batch.column(3))], np.int64).reshape(-1, 7)
        yield [batch.column(0), batch.column(1), batch.column(2), *found.T]


def measured(docs: DataFrame) -> DataFrame:
    return mapped(docs.select("doc_id", "lang", "source", "text"), _counted, COUNTS)


def value(rule: Rule):
    """The rule's share in millionths; 0 where the denominator is."""
    den = F.col(rule.denominator)
    return F.when(den > 0, F.expr(f"({rule.numerator} * 1000000) DIV {rule.denominator}")).otherwise(0).cast("long")


def sketches(rows: DataFrame) -> DataFrame:
    """The sketch of each rule for lang and source, for lang (source_all), and for all (lang_all):
    lang, source, level, rule, at, n."""
    values = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), value(r).alias("v")) for k, r in RULES.items()]))
    one = rows.select("lang", "source", values.alias("x")).select("lang", "source", "x.rule", "x.v")
    kept = one.select("lang", "source", "rule", F.expr(f"v - v % shiftleft(1L, greatest(length(bin(v)) - {BITS}, 0))").alias("at"))
    fine = kept.groupBy("lang", "source", "rule", "at").agg(F.count("*").alias("n"))
    mid = fine.groupBy("lang", "rule", "at").agg(F.sum("n").alias("n"))
    top = mid.groupBy("rule", "at").agg(F.sum("n").alias("n"))
    columns = ["lang", "source", "level", "rule", "at", "n"]
    return (
        fine.withColumn("level", F.lit(0)).select(columns)
        .unionByName(mid.withColumns({"source": F.lit(None).cast("string"), "level": F.lit(1)}).select(columns))
        .unionByName(top.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string"), "level": F.lit(2)}).select(columns))
    )


def fences(sketch: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """lang, source, level and the columns FENCES for each group with enough documents."""
    group = ["level", "lang", "source", "rule"]
    w = W.partitionBy(*group)
    running = sketch.withColumns({"upto": F.sum("n").over(w.orderBy("at")), "total": F.sum("n").over(w)})
    of = lambda name: F.element_at(F.create_map(*[x for k, r in RULES.items() for x in (F.lit(k), F.lit(getattr(r, name)))]), F.col("rule"))
    quantile = lambda name: F.min(F.when(100 * F.col("upto") >= of(name) * F.col("total"), F.col("at"))).alias(name)
    found = running.groupBy(*group).agg(quantile("low"), quantile("high"), F.max("total").alias("total"))
    away = F.greatest(of("spread") * (F.col("high") - F.col("low")), of("floor"))
    found = found.where((F.col("level") == 2) | (F.col("total") >= settings.least)).withColumns({"min": F.col("low") - away, "max": F.col("high") + away})
    one = lambda name: F.max(F.when(F.col("rule") == name[:-4], F.col(name[-3:]))).alias(name)
    return found.groupBy("level", "lang", "source").agg(*[one(n) for n in FENCES])


def quality(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Counts, base_failed and kept for every row of docs, with the fences that applied."""
    rows = stored(measured(docs), "quality")
    failed = F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")
    found = stored(fences(sketches(rows.where(~failed)), settings), "fences")
    names = FENCES
    level = lambda k: found.where(F.col("level") == k)
    fine = level(0).select(F.col("lang").alias("f_lang"), F.col("source").alias("f_source"), *[F.col(n).alias(f"f_{n}") for n in names])
    mid = level(1).select(F.col("lang").alias("m_lang"), *[F.col(n).alias(f"m_{n}") for n in names])
    top = level(2).select(*names).first()  # one row, none where no document passes the base rules
    joined = rows.join(fine, F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source")), "left")
    joined = joined.join(mid, F.col("lang").eqNullSafe(F.col("m_lang")), "left")
    joined = joined.withColumns({n: F.coalesce(f"f_{n}", f"m_{n}", F.lit(top[n] if top else None).cast("long")) for n in names})
    good = ~failed
    for k, rule in RULES.items():
        good = good & (value(rule) <= F.col(f"{k}_max"))
        if rule.both:
            good = good & (value(rule) >= F.col(f"{k}_min"))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), good.alias("kept"))
