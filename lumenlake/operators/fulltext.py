"""Full-text search: fixed tokenizer, AND of words, phrases, and a prefix on the last word.

There is no relevance: matches are ids, ordered by whatever the query asks for. matches() tests the
documents as they are read, without a shuffle. For many queries on one corpus, write index() as a
table sorted by token and use lookup(), which reads only the tokens asked for.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.functions.text import query_tokens, tokens

COLUMNS = ("title", "caption", "description", "tags", "file_name", "camera")


@dataclass(frozen=True)
class Term:
    """A phrase of one or more tokens; with prefix the last one may go on."""

    tokens: tuple[str, ...]
    prefix: bool


def compile_query(text: str) -> list[Term] | None:
    """Terms to be found, all of them. None: nothing can match (no words, or one without a token)."""
    words = [w.strip("\"'()*-^") for w in re.split(r"[ \t\r\n,;]", text)]
    words = [w for w in words if w]
    terms = [Term(tuple(query_tokens(w)), i == len(words) - 1) for i, w in enumerate(words)]
    return terms if terms and all(t.tokens for t in terms) else None


def _joined(photos: DataFrame, tags: DataFrame | None) -> tuple[DataFrame, dict[str, Column]]:
    """photos with their tags in one string, and the expression of each text column. Columns that photos
    lacks count as empty."""
    have = set(photos.columns)
    part = lambda c: F.coalesce(c, F.lit("")) if c in have else F.lit("")
    if tags is not None:
        own = tags.groupBy(F.col("photo_id").alias("id")).agg(F.array_join(F.sort_array(F.collect_list("tag")), " ").alias("_tags"))
        photos = photos.join(own, "id", "left")
    camera = [part(c) for c in ("camera_make", "camera_model", "lens", "place_city", "place_country")]
    return photos, {
        "title": part("user_title"), "caption": part("ai_caption"), "description": F.concat(part("ai_description"), F.lit(" "), part("user_notes")),
        "tags": F.coalesce("_tags", F.lit("")) if tags is not None else F.lit(""), "file_name": part("file_name"), "camera": F.trim(F.concat_ws(" ", *camera)),
    }


def documents(photos: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """id and the six text columns of each photo."""
    rows, columns = _joined(photos, tags)
    return rows.select("id", *[c.alias(n) for n, c in columns.items()])


def matching(photos: DataFrame, tags: DataFrame | None, text: str) -> DataFrame:
    """The photos whose document holds every term: a filter; only tags, if any, are joined."""
    terms = compile_query(text)
    if terms is None:
        return photos.limit(0)
    rows, columns = _joined(photos, tags)
    return rows.where(_passes(terms, columns)).select(*photos.columns)


def holds(term: Term, found: Column) -> Column:
    """Whether a token array holds the term."""
    n = len(term.tokens)
    if n == 1:
        return F.exists(found, lambda t: t.startswith(term.tokens[0])) if term.prefix else F.array_contains(found, term.tokens[0])

    def at(i):
        same = F.lit(True)
        for k, t in enumerate(term.tokens):
            own = F.get(found, i + k)
            same = same & (own.startswith(t) if term.prefix and k == n - 1 else own == t)
        return F.coalesce(same, F.lit(False))

    return F.when(F.size(found) >= n, F.exists(F.sequence(F.lit(0), F.size(found) - n), at)).otherwise(False)


def _passes(terms: list[Term], columns: dict[str, Column]) -> Column:
    """Whether every term is held by some column."""

    def all_of(found):
        out = F.lit(True)
        for term in terms:
            either = F.lit(False)
            for c in columns:
                either = either | holds(term, found[c])
            out = out & either
        return out

    # a lambda's argument is evaluated once for a row, however many terms look at it
    return F.exists(F.array(F.struct(*[tokens(c).alias(n) for n, c in columns.items()])), all_of)


def matches(docs: DataFrame, text: str, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """ids of the documents that hold every term, each within one column."""
    terms = compile_query(text)
    if terms is None:
        return docs.select("id").limit(0)
    return docs.where(_passes(terms, {c: F.col(c) for c in columns})).select("id")


def index(docs: DataFrame, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """The inverted index: token, id, col, pos. Write it range-partitioned and sorted by token."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), tokens(F.col(c)).alias("t")) for c in columns])).alias("x")
    return docs.select("id", each).select("id", "x.col", F.posexplode("x.t").alias("pos", "token")).select("token", "id", "col", "pos")


def lookup(postings: DataFrame, text: str) -> DataFrame:
    """ids from the inverted index; only the asked tokens are read."""
    terms = compile_query(text)
    if terms is None:
        return postings.select("id").limit(0)
    out = None
    for term in terms:
        place = None
        for k, t in enumerate(term.tokens):
            last = term.prefix and k == len(term.tokens) - 1
            own = postings.where(F.col("token").startswith(t) if last else F.col("token") == t)
            own = own.select("id", "col", (F.col("pos") - k).alias("pos"))
            place = own if place is None else place.join(own, ["id", "col", "pos"], "left_semi")
        hit = place.select("id").distinct()
        out = hit if out is None else out.join(hit, "id", "left_semi")
    return out


def reindex(postings: DataFrame, docs: DataFrame, changed: DataFrame) -> DataFrame:
    """The index with the rows of the changed ids made anew."""
    return postings.join(changed.select("id"), "id", "left_anti").unionByName(index(docs.join(changed.select("id"), "id", "left_semi")))
