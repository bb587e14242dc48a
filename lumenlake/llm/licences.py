r"""Licences of files: TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Everything is Spark SQL expressions. Each sentence of a whole text that has a licence word is
compared with every template: terms are runs of [a-z0-9.+-] in lower case, and a term weighs the
number of times it occurs times its inverse frequency among the templates. Each occurrence of a term of no
template counts as a term of its own that weighs as much as the rarest, so that prose about licences stays far
from all templates. A file's own licence is
the template of its best sentence, if the cosine reaches Settings.own. Before that come exact forms, which
score 1: an SPDX line (the first identifier of its expression, also one without a template), then the
standard headers and licence-file texts of MARKS, looked for in the whole text without line breaks,
comment signs and punctuation.

A directory has a licence if a licence file lies in it (by name, or, where the caller has no
names, a file whose licence sentence reaches Settings.file); the commonest of several, ties to the
first by name. Files without a licence of their own take that of the nearest ancestor directory
that has one. Directories, not files, are joined: each distinct directory is expanded to all of its
ancestors, so a directory with a third of all files costs a row an ancestor.

Edge cases: null texts have no licence of their own; null paths are the root; repeated rows are
each answered; equal scores go to the first template by name; other columns come back as they were, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenlake.llm.common import stored

#: The notices to recognise, by SPDX identifier.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("BSD-2-Clause", "Licensed under the 2-clause BSD License"),
    ("BSD-3-Clause", "Licensed under the 3-clause BSD License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "Licensed under CC0 1.0 public domain dedication"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MPL-2.0", "This file is subject to the terms of the Mozilla Public License, version 2.0"),
    ("Unlicense", "Released under the Unlicense into the public domain"),
)
#: Words of standard headers and licence files, by SPDX identifier: all of a row must occur, the first such row counts.
_GRANT = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"
_BSD = "redistributions of source code must retain the above copyright notice"
_GNU = "public license as published by the free software foundation either version"
MARKS = (
    ("Apache-2.0", ("you may not use this file except in compliance with the license", "apache org licenses license 2 0")),
    ("Apache-2.0", ("apache license version 2 0 january 2004",)),
    ("MIT", (_GRANT, "the above copyright notice and this permission notice shall be included in all")),
    ("MIT-0", (_GRANT,)),
    ("BSD-4-Clause", (_BSD, "all advertising materials mentioning features or use of this software")),
    ("BSD-3-Clause", (_BSD, "to endorse or promote products derived from this software")),
    ("BSD-2-Clause", (_BSD,)),
    ("BSD-3-Clause", ("use of this source code is governed by a bsd style license",)),
    ("AGPL-3.0", (f"gnu affero general {_GNU} 3",)),
    ("AGPL-3.0", ("gnu affero general public license version 3 19 november 2007",)),
    ("LGPL-3.0", (f"gnu lesser general {_GNU} 3",)),
    ("LGPL-3.0", ("gnu lesser general public license version 3 29 june 2007",)),
    ("LGPL-2.1", (f"gnu lesser general {_GNU} 2 1",)),
    ("LGPL-2.1", ("gnu lesser general public license version 2 1 february 1999",)),
    ("GPL-3.0", (f"gnu general {_GNU} 3",)),
    ("GPL-3.0", ("gnu general public license version 3 29 june 2007",)),
    ("GPL-2.0", (f"gnu general {_GNU} 2",)),
    ("GPL-2.0", ("gnu general public license version 2 as published by the free software foundation",)),
    ("GPL-2.0", ("gnu general public license version 2 june 1991",)),
    ("MPL-2.0", ("subject to the terms of the mozilla public license v 2 0",)),
    ("MPL-2.0", ("mozilla public license version 2 0 1 definitions",)),
    ("CC-BY-4.0", ("creative commons attribution 4 0 international",)),
    ("CC-BY-SA-4.0", ("creative commons attribution sharealike 4 0 international",)),
    ("CC-BY-ND-4.0", ("creative commons attribution noderivatives 4 0 international",)),
    ("CC-BY-NC-4.0", ("creative commons attribution noncommercial 4 0 international",)),
    ("CC-BY-NC-SA-4.0", ("creative commons attribution noncommercial sharealike 4 0 international",)),
    ("CC-BY-NC-ND-4.0", ("creative commons attribution noncommercial noderivatives 4 0 international",)),
    ("CC0-1.0", ("cc0 1 0 universal",)),
    ("Unlicense", ("this is free and unencumbered software released into the public domain",)),
)
SPDX = r"(?i)spdx-license-identifier:\s*\(*\s*([a-z0-9.+-]*[a-z0-9+])"
CUE = "licen[cs]|copyright|spdx"
TERM = "[a-z0-9+-]+(?:[.][0-9]+)*"
NAMES = "(?i)(^|/)(licen[cs]e|copying|notice|unlicense)([.-][^/]*)?$"


@dataclass(frozen=True)
class Settings:
    own: float = 0.6
    file: float = 0.8


def terms(text: str) -> Counter[str]:
    return Counter(re.findall(TERM, text.lower()))


def weights() -> tuple[dict[str, float], float]:
    """Squared inverse frequencies of the templates' terms, and that of any other term."""
    held = [terms(t) for _, t in TEMPLATES]
    n = len(held)
    idf = lambda k: (1 + math.log((1 + n) / (1 + k))) ** 2
    return {w: idf(sum(w in h for h in held)) for w in sorted(set().union(*held))}, idf(1)


def exact(text: Column) -> Column:
    """The identifier of a text's SPDX line, else of the first of MARKS that it holds; null if there is none."""
    told = F.regexp_extract(text, SPDX, 1)
    plain = F.regexp_replace(told, r"(?i)(-only|-or-later|\+)$", "")
    known = {n.lower(): n for n in [n for n, _ in TEMPLATES] + [n for n, _ in MARKS]}
    names = F.create_map(*[F.lit(x) for pair in sorted(known.items()) for x in pair])
    spdx = F.when(~F.lower(told).isin("", "none", "noassertion"), F.coalesce(F.element_at(names, F.lower(plain)), plain))
    flat = F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")
    # one array, so that the text is made flat once
    held = F.filter(F.transform(F.array(flat), lambda t: F.coalesce(*[F.when(F.forall(F.array(*map(F.lit, words)), lambda w: t.contains(w)), F.lit(name)) for name, words in MARKS])), lambda n: n.isNotNull())
    return F.when(F.lower(text).rlike(f"{CUE}|creative commons|cc0|unencumbered"), F.coalesce(spdx, F.get(held, F.lit(0))))


def best(text: Column) -> Column:
    """struct<score, name> of an exact form, else of the best template over all sentences of a text; null if none
    has a licence word."""
    square, other = weights()
    row = lambda f: F.array(*[F.lit(float(f(w))) for w in square])
    total = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    def scored(sentence):
        found = F.regexp_extract_all(sentence, F.lit(TERM), F.lit(0))

        def best_of(x):
            often, n = x["often"], x["n"]
            own = F.aggregate(often, F.lit(0.0), lambda s, k: s + k)
            norm = total(F.transform(often, lambda k: k * k), row(lambda w: square[w])) + (n - own) * F.lit(other)
            each = []
            for name, template in TEMPLATES:
                held = terms(template)
                size = sum(k * k * square[w] for w, k in sorted(held.items()))
                dot = total(often, row(lambda w: held[w] * square[w]))  # noqa: B023
                each.append(F.struct(F.round(-dot / F.sqrt(norm * F.lit(size)), 9).alias("score"), F.lit(name).alias("name")))
            return F.array_min(F.array(*each))

        # how often each term of the templates occurs
        counted = F.transform(F.array(found), lambda f: F.struct(F.transform(F.array(*map(F.lit, square)), lambda w: (F.size(f) - F.size(F.array_remove(f, w))).cast("double")).alias("often"), F.size(f).alias("n")))
        return F.get(F.transform(counted, best_of), F.lit(0))

    # a dot ends a sentence only before white space, so version numbers stay whole
    sentences = F.filter(F.split(F.lower(text), r"\n|(?<=[.!?])\s+", -1), lambda s: s.rlike(CUE))
    low = F.array_min(F.transform(sentences, scored))
    near = F.when(F.lower(text).rlike(CUE), F.struct((-low["score"]).alias("score"), low["name"].alias("name")))
    return F.coalesce(F.transform(F.array(exact(text)), lambda n: F.when(n.isNotNull(), F.struct(F.lit(1.0).alias("score"), n.alias("name"))))[0], near)


def directory(path: Column) -> Column:
    return F.regexp_replace(F.coalesce(path, F.lit("")), "/?[^/]*$", "")


def ancestors(dir_: Column) -> Column:
    """The directory and those above it, nearest first, the root last."""
    parts = F.filter(F.split(dir_, "/"), lambda p: p != "")
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(0), n), lambda i: F.array_join(F.slice(parts, 1, n - i), "/"))


OUT = ("licence", "score", "origin", "licence_dir")


def licences(files: DataFrame, named: bool = True, settings: Settings = Settings()) -> DataFrame:
    """Adds licence, score, origin (own, inherited, none) and licence_dir to files (path, text, ...), in place of columns
    that have these names. named: licence files are known by their names; else by their text."""
    keep = [c for c in files.columns if c != "text" and c.lower() not in OUT]
    rows = files.select(F.struct(*[files[c] for c in keep]).alias("row"), files["path"], best(files["text"]).alias("best"), directory(files["path"]).alias("dir"))
    own = F.when(F.col("best.score") >= settings.own, F.col("best.name"))
    file = F.col("path").rlike(NAMES) if named else F.col("best.score") >= settings.file
    # the votes and the result read the scores of each text from where they were written once
    rows = stored(rows.withColumns({"own": own, "file": F.coalesce(file, F.lit(False))}), "licences")
    votes = rows.where("file AND own IS NOT NULL").groupBy("dir", "own").agg(F.count("*").alias("n"))
    first = F.row_number().over(W.partitionBy("dir").orderBy(F.desc("n"), "own"))  # at most one row a template
    licensed = votes.withColumn("r", first).where("r = 1").select(F.col("dir").alias("at"), F.col("own").alias("given"))
    dirs = rows.select("dir").distinct()
    up = dirs.select("dir", F.posexplode(ancestors(F.col("dir"))).alias("far", "at"))
    near = up.join(licensed, "at").groupBy("dir").agg(F.min(F.struct("far", "at", "given")).alias("near"))
    out = rows.join(near, "dir", "left")
    origin = F.when(F.col("own").isNotNull(), "own").when(F.col("near").isNotNull(), "inherited").otherwise("none")
    back = [F.col("row").getField(c).alias(c) for c in keep]
    return out.select(*back, F.coalesce("own", "near.given").alias("licence"), F.coalesce("best.score", F.lit(0.0)).alias("score"), origin.alias("origin"), F.when(F.col("own").isNull(), F.col("near.at")).alias("licence_dir"))


def document_paths(docs: DataFrame) -> DataFrame:
    """documents have no paths: the query takes source/lang/id, an id divisible by 100 one level up."""
    id_ = F.col("doc_id")
    low = F.when(id_ % 100 == 0, F.concat_ws("/", "source", id_.cast("string"))).otherwise(F.concat_ws("/", "source", "lang", id_.cast("string")))
    return docs.select("doc_id", low.alias("path"), "text")
