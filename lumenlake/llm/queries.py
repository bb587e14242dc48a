"""The registered query of each training-data operator, and SQL for those it can express."""

from __future__ import annotations

from lumenlake.llm import decontaminate, divergence, jaccard, langid, licences, packing, pii, quality, repeats, simhash, spelling, toxicity, urls
from lumenlake.llm.common import read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op5_toxicity(spark, sf_dir):
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op9_simhash(spark, sf_dir):
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


@query
def op8_language_id(spark, sf_dir):
    return langid.languages(read(spark, sf_dir, "documents"))


@query
def op4_quality_rules(spark, sf_dir):
    return quality.quality(read(spark, sf_dir, "documents"))


@query
def op1_packing(spark, sf_dir):
    return packing.packed(read(spark, sf_dir, "documents"))


@query
def op3_decontamination(spark, sf_dir):
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query
def op10_pii(spark, sf_dir):
    return pii.personal_data(read(spark, sf_dir, "documents"))


@query
def op6_url_filter(spark, sf_dir):
    return urls.verdicts(read(spark, sf_dir, "pages"))


@query
def op2_licences(spark, sf_dir):
    return licences.licences(licences.document_paths(read(spark, sf_dir, "documents")), named=False)


@query
def op7_repeats(spark, sf_dir):
    return repeats.without_repeats(read(spark, sf_dir, "documents"))


@query
def op11_spelling(spark, sf_dir):
    return spelling.spellings(read(spark, sf_dir, "documents"))


@query
def op12_divergence(spark, sf_dir):
    return divergence.divergence(read(spark, sf_dir, "documents"))


@query
def op13_jaccard(spark, sf_dir):
    return jaccard.jaccard(read(spark, sf_dir, "documents"))


#: The rules of the query, as SQL: longest first.
ORACLES["op6_url_filter"] = r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS raw, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM h),
r AS (SELECT * FROM (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')) AS t(action, rhost, rpath)),
f AS (SELECT page_id, rhost || rpath AS rule, action, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC) AS k
  FROM p JOIN r ON (host = rhost OR suffix(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT p.page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM p LEFT JOIN f ON f.page_id = p.page_id AND k = 1
"""

#: The counts, sketches and fences of the quality rules with their production parameters.
ORACLES["op4_quality_rules"] = r"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
c AS (SELECT doc_id, lang, source, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines,
  coalesce(covered.n, 0) AS n_repeat_words, length(regexp_replace(array_to_string(ws, ''), '[\p{L}\p{Nl}\p{No}]', '', 'g')) AS n_other, length(regexp_replace(t, '[^A-ZÀ-ÖØ-Þ]', '', 'g')) AS n_upper
  FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN lines USING (doc_id)),
v AS (SELECT doc_id, lang, source, failed, rule, CASE WHEN den > 0 THEN num * 1000000 // den ELSE 0 END AS v FROM (
  SELECT doc_id, lang, source, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS failed, unnest([{'rule': 'symbols', 'num': n_symbols, 'den': word_chars}, {'rule': 'other', 'num': n_other, 'den': word_chars},
    {'rule': 'upper', 'num': n_upper, 'den': word_chars}, {'rule': 'repeats', 'num': n_repeat_words, 'den': n_words}, {'rule': 'length', 'num': word_chars, 'den': n_words}], recursive := true) FROM c)),
rules AS (SELECT * FROM (VALUES ('symbols', 6, 10000, 25, 75, false), ('other', 12, 10000, 25, 75, false), ('upper', 6, 10000, 25, 75, false), ('repeats', 12, 100000, 50, 90, false), ('length', 6, 500000, 25, 75, true)) AS t(rule, spread, least, lo, hi, both_sides)),
k AS (SELECT *, v - v % CAST(pow(2, greatest(length(bin(v)) - 7, 0)) AS BIGINT) AS bin_at FROM v WHERE NOT failed),
s AS (SELECT 0 AS level, lang, source, rule, bin_at, count(*) AS n FROM k GROUP BY ALL UNION ALL SELECT 1, lang, NULL, rule, bin_at, count(*) FROM k GROUP BY ALL UNION ALL SELECT 2, NULL, NULL, rule, bin_at, count(*) FROM k GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, rule ORDER BY bin_at) AS upto, sum(n) OVER (PARTITION BY level, lang, source, rule) AS total FROM s JOIN rules USING (rule)),
q AS (SELECT level, lang, source, rule, both_sides, spread, least, max(total) AS total, min(bin_at) FILTER (100 * upto >= lo * total) AS low, min(bin_at) FILTER (100 * upto >= hi * total) AS high FROM r GROUP BY ALL),
f AS (SELECT level, lang, source, rule, high + greatest(spread * (high - low), least) AS top, CASE WHEN both_sides THEN low - greatest(spread * (high - low), least) ELSE 0 END AS bottom FROM q WHERE level = 2 OR total >= 200),
j AS (SELECT v.doc_id, bool_and(v.v BETWEEN coalesce(a.bottom, b.bottom, o.bottom) AND coalesce(a.top, b.top, o.top)) AS good FROM v
  LEFT JOIN f a ON a.level = 0 AND a.lang IS NOT DISTINCT FROM v.lang AND a.source IS NOT DISTINCT FROM v.source AND a.rule = v.rule
  LEFT JOIN f b ON b.level = 1 AND b.lang IS NOT DISTINCT FROM v.lang AND b.rule = v.rule LEFT JOIN f o ON o.level = 2 AND o.rule = v.rule GROUP BY v.doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND good AS kept FROM c JOIN j USING (doc_id)
"""

#: Templates, weights, cosines and inheritance of the licence query.
ORACLES["op2_licences"] = r"""
WITH templates AS (SELECT * FROM (VALUES ('Apache-2.0', 'Licensed under the Apache License, Version 2.0'), ('BSD-2-Clause', 'Licensed under the 2-clause BSD License'), ('BSD-3-Clause', 'Licensed under the 3-clause BSD License'),
  ('CC-BY-4.0', 'Licensed under CC BY 4.0'), ('CC-BY-NC-4.0', 'Licensed under CC BY-NC 4.0'), ('CC-BY-SA-4.0', 'Licensed under CC BY-SA 4.0'), ('CC0-1.0', 'Licensed under CC0 1.0 public domain dedication'),
  ('GPL-2.0', 'This work is licensed under the GNU General Public License, version 2'), ('GPL-3.0', 'This work is licensed under the GNU General Public License, version 3'),
  ('LGPL-3.0', 'This work is licensed under the GNU Lesser General Public License, version 3'), ('MIT', 'Released under the MIT License'),
  ('MPL-2.0', 'This file is subject to the terms of the Mozilla Public License, version 2.0'), ('Unlicense', 'Released under the Unlicense into the public domain')) AS t(name, t)),
tt AS (SELECT name, term, count(*) AS often FROM (SELECT name, unnest(regexp_extract_all(lower(t), '[a-z0-9+-]+(?:[.][0-9]+)*')) AS term FROM templates) GROUP BY ALL),
idf AS (SELECT term, pow(1 + ln(14.0 / (1 + count(*))), 2) AS s FROM tt GROUP BY term),
size AS (SELECT name, sum(often * often * s) AS size FROM tt JOIN idf USING (term) GROUP BY name),
files AS (SELECT doc_id, text, CASE WHEN doc_id % 100 = 0 THEN source || '/' || doc_id ELSE source || '/' || lang || '/' || doc_id END AS path, CASE WHEN doc_id % 100 = 0 THEN source ELSE source || '/' || lang END AS dir FROM documents),
lines AS (SELECT doc_id, row_number() OVER () AS line, l FROM (SELECT doc_id, unnest(string_split(regexp_replace(lower(text), '([.!?])\s+', '\1' || chr(10), 'g'), chr(10))) AS l FROM files) WHERE regexp_matches(l, 'licen[cs]|copyright|spdx')),
lt AS (SELECT doc_id, line, term, count(*) AS often FROM (SELECT doc_id, line, unnest(regexp_extract_all(l, '[a-z0-9+-]+(?:[.][0-9]+)*')) AS term FROM lines) GROUP BY ALL),
norm AS (SELECT line, sum(CASE WHEN s IS NULL THEN lt.often * pow(1 + ln(14.0 / 2), 2) ELSE lt.often * lt.often * s END) AS norm FROM lt LEFT JOIN idf USING (term) GROUP BY line),
dots AS (SELECT doc_id, line, name, sum(lt.often * tt.often * s) AS dot FROM lt JOIN tt USING (term) JOIN idf USING (term) GROUP BY ALL),
best AS (SELECT doc_id, name, round(dot / sqrt(norm * size), 9) AS score FROM dots JOIN norm USING (line) JOIN size USING (name) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(dot / sqrt(norm * size), 9) DESC, name) = 1),
own AS (SELECT f.*, coalesce(score, 0) AS score, CASE WHEN score >= 0.6 THEN name END AS own FROM files f LEFT JOIN best USING (doc_id)),
dirs AS (SELECT dir, own AS given FROM own WHERE score >= 0.8 GROUP BY dir, own QUALIFY row_number() OVER (PARTITION BY dir ORDER BY count(*) DESC, own) = 1),
up AS (SELECT dir, 0 AS far, dir AS at_dir FROM own UNION SELECT dir, 1, CASE WHEN contains(dir, '/') THEN string_split(dir, '/')[1] ELSE '' END FROM own UNION SELECT dir, 2, '' FROM own WHERE contains(dir, '/')),
near AS (SELECT up.dir, at_dir, given FROM up JOIN dirs ON dirs.dir = at_dir QUALIFY row_number() OVER (PARTITION BY up.dir ORDER BY far) = 1)
SELECT doc_id, path, coalesce(own, given) AS licence, score, CASE WHEN own IS NOT NULL THEN 'own' WHEN given IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin, CASE WHEN own IS NULL THEN at_dir END AS licence_dir FROM own LEFT JOIN near USING (dir)
"""

#: Shares over all kept terms of every group, all pairs term by term, and the ranks.
ORACLES["op12_divergence"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
o AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
dt AS (SELECT r, lang, source, term, count(*) AS n FROM o GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS lang_n FROM dt GROUP BY lang, term HAVING count(*) >= 10),
langs AS (SELECT lang, count(*) AS V, sum(lang_n) AS total FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
own AS (SELECT lang, source, term, sum(n) AS n FROM dt JOIN kept USING (lang, term) GROUP BY ALL),
dense AS (SELECT g.lang, g.source, k.term, k.lang_n, CAST(coalesce(o.n, 0) AS HUGEINT) AS n FROM groups g JOIN kept k USING (lang) LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
tot AS (SELECT lang, source, sum(n) AS N FROM dense GROUP BY ALL),
p AS (SELECT dense.lang, dense.source, term, dense.n, CAST(1 + (1000000000 * (dense.n + 2)) // (tot.N + 2 * V) AS BIGINT) AS p, CAST(1 + (1000000000 * (CAST(lang_n AS HUGEINT) + 2)) // (total + 2 * V) AS BIGINT) AS q FROM dense JOIN tot USING (lang, source) JOIN langs USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
allpairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM allpairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
