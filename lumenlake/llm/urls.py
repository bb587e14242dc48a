"""URL verdicts by a Bloom filter cascade; everything is Spark SQL expressions.

A rule is a host and a path; it fits that host and its subdomains where the url's path starts with
the rule's, and the longest fitting rule wins. A url therefore asks for a few keys: each suffix
of its host with the beginning of its path, cut at each length that rules have. Whether a key is
listed is answered by a cascade of Bloom filters, exactly and without a join.

Level 1 encodes the listed keys. Of all keys that the corpus can ask for (the key universe), those
that level 1 holds by mistake are encoded by level 2; the listed keys that level 2 holds by mistake
by level 3; and so on until a level makes no mistake. A key's answer is the parity of the first level
that does not hold it. Every key of the universe is put through the levels when they are built,
so answers for the corpus are exact. Level 1 grows with the list, not with the corpus, and each
further one is about a hundredth of what it corrects.

A filter is an array of longs, made by an aggregation and read by the plan as a scalar
subquery, which each task holds once and no row copies: keys are tested one to a row, and the rows of a url
are put together again where they lie, without a shuffle. A list whose filter would have more than
Settings.max_bits is cut into parts by a hash of the key, each with a cascade of its own, and a key asks
that of its part. The universe is made once for both lists.

Edge cases: a null url or one without :// has an empty host and path and fits no rule; hosts are
lower-cased in A-Z only; a key listed for both actions blocks; rules with a null are ignored; repeated rows
are judged each; with no rules everything gets the default.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.llm.common import discard, stored, stored_in_parts

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALLOW, BLOCK = "allow", "block"

#: The registered query's rules.
RULES = (
    (ALLOW, "com", "/"),
    (BLOCK, "example.com", "/en/"),
    (ALLOW, "www.example.com", "/en/"),
    (BLOCK, "net", "/es/"),
    (BLOCK, "net", "/fr/"),
)


@dataclass(frozen=True)
class Settings:
    bits_per_key: int = 10
    hashes: int = 7
    max_bits: int = 1 << 27
    default: str = ALLOW


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """The keys that a url asks for, longest first; a path shorter than a length has none of it."""
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.char_length(path)), lambda n: F.substring(path, F.lit(1), n))
    pairs = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    ordered = F.sort_array(F.transform(pairs, lambda k: F.struct(F.char_length(k).alias("n"), k.alias("k"))), asc=False)
    return F.when(host != "", F.transform(ordered, lambda x: x["k"])).otherwise(F.array().cast("array<string>"))


@dataclass(frozen=True)
class Level:
    number: int
    bits: int
    hashes: int
    words: DataFrame

    def places(self, key: Column) -> list[Column]:
        return [F.xxhash64(key, F.lit(64 * self.number + j)).bitwiseAND(F.lit(self.bits - 1)) for j in range(self.hashes)]

    def holds(self, key: Column, words: Column | None = None) -> Column:
        """words: the filter as a column, where a subquery cannot stand (in lambdas)."""
        words = self.words.scalar() if words is None else words
        tests = [F.getbit(F.get(words, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1 for p in self.places(key)]
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out


def level(number: int, members: DataFrame, count: int, settings: Settings) -> Level:
    """A Bloom filter of the keys in members."""
    bits = 64
    while bits < count * settings.bits_per_key:
        bits *= 2
    blank = Level(number, bits, settings.hashes, members)
    places = members.select(F.explode(F.array(*blank.places(F.col("key")))).alias("p"))
    set_ = places.select(F.shiftright("p", 6).alias("i"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("w"))
    zero = members.sparkSession.range(bits // 64).select(F.col("id").alias("i"), F.lit(0).cast("long").alias("w"))
    words = set_.unionByName(zero).groupBy("i").agg(F.bit_or("w").alias("w"))
    dense = words.agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "w"))), lambda x: x["w"]).alias("words"))
    return Level(number, bits, settings.hashes, stored(dense, f"filter{number}"))


def cascade(listed: DataFrame, universe: DataFrame, settings: Settings = Settings()) -> list[Level]:
    """Levels for the keys in listed, exact for all keys in universe (both have a column key)."""
    both = listed.select("key", F.lit(True).alias("in")).unionByName(universe.select("key", F.lit(False).alias("in")))
    known = stored(both.groupBy("key").agg(F.max("in").alias("in")), "universe")
    return corrected(known.where("in").select("key"), known.where("NOT in").select("key"), settings)


def corrected(inside: DataFrame, outside: DataFrame, settings: Settings) -> list[Level]:
    """Levels that hold the distinct keys inside and, in the end, none of those outside."""
    levels: list[Level] = []
    used = []
    while count := inside.count():
        made = level(len(levels) + 1, inside, count, settings)
        levels.append(made)
        wrong = stored(outside.where(made.holds(F.col("key"))), "wrong")
        used.append(wrong)
        inside, outside = wrong, inside
    discard(*used)
    return levels


def _part(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(parts))


def cascades(known: DataFrame, listed: str, settings: Settings) -> list[list[Level]]:
    """A cascade for each part of the keys in known where the column listed is true, so that no filter needs
    more than settings.max_bits."""
    n = known.where(listed).count()
    parts = max(1, -(-2 * n * settings.bits_per_key // settings.max_bits))
    inside, outside = known.where(listed).select("key"), known.where(f"NOT {listed}").select("key")
    return [corrected(inside.where(_part(F.col("key"), parts) == p), outside.where(_part(F.col("key"), parts) == p), settings) for p in range(parts)]


def member(levels: list[Level], key: Column, words: list[Column] | None = None) -> Column:
    """The cascade's answer for a key of its universe. words: the levels' filters, where they are columns."""
    out = F.lit(len(levels) % 2 == 1)
    for i in reversed(range(len(levels))):
        out = F.when(~levels[i].holds(key, words and words[i]), F.lit(i % 2 == 1)).otherwise(out)
    return out


def rule_rows(spark: SparkSession, rules: tuple) -> DataFrame:
    """(action, host, path) tuples as a table."""
    each = [F.struct(F.lit(a).alias("action"), F.lit(h).alias("host"), F.lit(p).alias("path")) for a, h, p in rules]
    none = F.struct(*[F.lit(None).cast("string").alias(k) for k in ("action", "host", "path")])
    return spark.range(1).select(F.explode(F.array(*each or [none])).alias("r")).select("r.*")


def verdicts(pages: DataFrame, rules: DataFrame | tuple = RULES, settings: Settings = Settings()) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of pages. rules: a table of action (allow or block),
    host and path, or tuples of these."""
    spark = pages.sparkSession
    rules = rule_rows(spark, rules) if isinstance(rules, tuple) else rules
    given = rules.where("action IS NOT NULL AND host IS NOT NULL AND path IS NOT NULL")
    lengths = [r[0] for r in given.select(F.char_length("path").alias("n")).distinct().orderBy("n").collect()]  # of paths
    if not lengths:
        host, path = host_and_path(F.col("url"))
        return pages.select("page_id", host.alias("host"), path.alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(settings.default).alias("verdict"))
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.monotonically_increasing_id().alias("rid"), "page_id", host.alias("host"), path.alias("path"))
    rows = stored_in_parts(rows, "urls")
    listed = keys(F.col("host"), F.col("path"), lengths)
    no = F.lit(False)
    own = given.select(F.concat(F.translate("host", UPPER, LOWER), "path").alias("key"), *[(F.col("action") == a).alias(a) for a in (ALLOW, BLOCK)])
    universe = rows.select(F.explode(listed).alias("key")).select("key", no.alias(ALLOW), no.alias(BLOCK)).unionByName(own)
    known = stored(universe.groupBy("key").agg(F.max(ALLOW).alias(ALLOW), F.max(BLOCK).alias(BLOCK)), "universe")
    found = {a: cascades(known, a, settings) for a in (ALLOW, BLOCK)}

    def holds(a: str) -> Column:
        out = F.lit(False)
        for p, levels in enumerate(found[a]):
            out = F.when(_part(F.col("key"), len(found[a])) == p, member(levels, F.col("key"))).otherwise(out)
        return out

    each = rows.select("part", "rid", "page_id", "host", "path", F.posexplode_outer(listed).alias("at", "key"))
    # where the longest key of each list stands
    urls = each.groupBy("part", "rid", "page_id", "host", "path").agg(*[F.min(F.when(holds(a), F.col("at"))).alias(a) for a in (ALLOW, BLOCK)])
    rule = F.get(listed, F.least(ALLOW, BLOCK))
    verdict = F.when(F.col(BLOCK) <= F.coalesce(ALLOW, BLOCK), BLOCK).when(F.col(ALLOW).isNotNull(), ALLOW).otherwise(settings.default)
    out = stored(urls.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict")), "verdicts")
    discard(rows, known, *[x.words for parts in found.values() for levels in parts for x in levels])
    return out
