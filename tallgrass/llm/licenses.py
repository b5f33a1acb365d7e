"""License scans: normalised text against licence templates by the Dice coefficient over word bigrams.

Text is normalised to words (A-Z lower-cased; `[0-9a-z]` and non-ASCII characters), line ends and marks apart, so that a
notice within a line, over several lines or over paragraphs is read alike. A template of m words is held against windows of
m words (fewer at the text's end), each by its set of word bigrams; those that begin with one of the template's bigrams are
enough, for the others hold no more of them. Of each template the best window counts (the first of equal ones), if it
reaches `THRESHOLD`; of templates whose windows overlap the one of higher Dice stays, of equal ones the first by name.

Sizes prune before any window is made. A set reaches the threshold only within size bounds, 2 min(a, b) / (a + b) >= threshold,
and so with a least number of common bigrams: a text without any of a few words, of which every match has one (`gate`),
matches nothing; a template is dropped where text and template share fewer bigrams than that; a window is dropped where the
hits in it are fewer.

Everything is one projection over the scan: DataFrame expressions, no shuffle, no Python.

Null and empty texts, and those of fewer than two words, match nothing: n_matches 0, null licence. A very long text is split
to words once if it passes the gate; windows are made only around hits. Rows are independent: repeated rows repeat, a null
doc_id stays, an empty table gives an empty result, and further columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.llm.common import LOWER, UPPER, documents
from tallgrass.llm.license_texts import TEMPLATES

THRESHOLD = 0.85

BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str) -> list[str]:
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return "".join(c if c in "0123456789abcdefghijklmnopqrstuvwxyz" or c >= "\x80" else " " for c in low).split()


def bigrams(text: str) -> list[str]:
    words = words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})  # noqa: B905


def size_bounds(size: int, threshold: float) -> tuple[int, int]:
    """The set sizes that can reach the threshold against a set of this size."""
    fits = [n for n in range(1, int(size * 2 / threshold) + 2) if 2 * min(n, size) >= threshold * (n + size)]
    return min(fits), max(fits)


def least_common(size: int, threshold: float) -> int:
    """How many bigrams of a template of this size any match has at least."""
    return math.ceil(threshold * (size_bounds(size, threshold)[0] + size) / 2 - 1e-9)


def gate(grams: list[str], threshold: float) -> set[str]:
    """Words of which every match has one: they stand in more of the bigrams than a match can lack. Long ones first."""
    open_, chosen = set(grams), set()
    lacking = len(grams) - least_common(len(grams), threshold)
    while len(grams) - len(open_) <= lacking:
        words = sorted({w for g in open_ for w in g.split()})
        best = max(words, key=lambda w: (min(len(w), 6), sum(w in g.split() for g in open_)))
        chosen.add(best)
        open_ = {g for g in open_ if best not in g.split()}
    return chosen


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _array(values) -> str:
    return f"array({', '.join(map(_quoted, values))})"


def _best_window(name: str, words: int, grams: list[str], threshold: float) -> str:
    """SQL: of the bigrams b of a text, the template's best window: (dice, minus its start, its end), or null."""
    lo, hi = size_bounds(len(grams), threshold)
    least, t = least_common(len(grams), threshold), _array(grams)
    dice = f"2 * size(array_intersect(s.set, {t})) / cast(size(s.set) + {len(grams)} as double)"
    hits = f"filter(sequence(0, size(b) - 1), i -> array_contains({t}, b[i]))"
    dense = f"filter(transform(p, (i, k) -> if(k + {least} <= size(p) and p[k + {least - 1}] - i <= {words - 2}, i, null)), i -> i is not null)"
    sets = f"filter(transform(q, i -> named_struct('at', i, 'set', array_distinct(slice(b, i + 1, {words - 1})))), s -> size(s.set) between {lo} and {hi})"
    scored = f"transform({sets}, s -> named_struct('dice', {dice}, 'start', -1 * s.at, 'end', least(s.at + {words}, size(b) + 1)))"
    best = f"array_max(filter({scored}, x -> x.dice >= {threshold}D))"
    return f"if(size(array_intersect(u, {t})) < {least}, null, transform(array({hits}), p -> transform(array({dense}), q -> {best})[0])[0])"


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, *keep: str) -> DataFrame:
    """keep, n_matches (templates found), the best licence with its dice, and all licences found, sorted."""
    templates = templates or TEMPLATES
    keep = keep or ("doc_id",)
    sets = {k: bigrams(templates[k]) for k in sorted(templates)}
    words = set().union(*(gate(g, threshold) for g in sets.values()))
    words = [w for w in sorted(words) if not any(v != w and v in w for v in words)]
    every = sorted(set().union(*sets.values()))
    text = F.coalesce(F.col("text"), F.lit(""))
    low = F.lower(text)  # of other letters than A-Z too, which lets some more texts pass
    passes = F.lit(False)
    for w in words:
        passes = passes | low.contains(w)
    split = F.filter(F.split(F.translate(text, UPPER, LOWER), BREAK), lambda w: w != "")
    df = docs.select(*keep, F.when(passes, split).otherwise(F.array().cast("array<string>")).alias("words"))
    pairs = F.zip_with(F.slice("words", 1, F.size("words") - 1), F.slice("words", 2, F.size("words")), lambda a, b: F.concat(a, F.lit(" "), b))
    df = df.select(*keep, F.when(F.size("words") > 1, pairs).otherwise(F.array().cast("array<string>")).alias("b"))
    df = df.select(*keep, "b", F.expr(f"array_intersect(b, {_array(every)})").alias("u"))
    found = ", ".join(f"named_struct('license', {_quoted(k)}, 'place', {i}, 'w', {_best_window(k, len(words_of(templates[k])), g, threshold)})" for i, (k, g) in enumerate(sets.items()))
    df = df.select(*keep, F.expr(f"if(size(u) = 0, null, filter(array({found}), x -> x.w is not null))").alias("m"))
    beaten = "exists(m, y -> y.place != x.place and y.w.end > -x.w.start and -y.w.start < x.w.end and (y.w.dice > x.w.dice or (y.w.dice = x.w.dice and y.place < x.place)))"
    df = df.select(*keep, F.expr(f"filter(m, x -> not {beaten})").alias("m"))
    best: Column = F.array_max(F.transform("m", lambda x: F.struct(x["w"]["dice"].alias("dice"), (-x["place"]).alias("place"), x["license"].alias("license"))))
    names = F.array_join(F.transform("m", lambda x: x["license"]), ",")
    return df.select(*keep, F.coalesce(F.size("m"), F.lit(0)).cast("long").alias("n_matches"), best["license"].alias("license"), best["dice"].alias("dice"), F.coalesce(names, F.lit("")).alias("licenses"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir, "doc_id", "text"))


def _sql() -> str:
    listed = lambda v: "[" + ", ".join("'" + b.replace("'", "''") + "'" for b in v) + "]"
    rows = ", ".join(f"('{k}', {len(words_of(v))}, {listed(bigrams(v))})" for k, v in sorted(TEMPLATES.items()))
    return rf"""
WITH t(license, m, grams) AS (VALUES {rows}),
d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT r, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS b FROM d WHERE len(w) >= 2),
p AS (SELECT r, b, unnest(b) AS gram, generate_subscripts(b, 1) AS i FROM b),
g AS (SELECT license, m, grams, unnest(grams) AS gram FROM t),
h AS (SELECT r, license, m, grams, i, list_distinct(b[i:i + m - 2]) AS s, least(i + m, len(b) + 2) AS e FROM p JOIN g USING (gram)),
s AS (SELECT r, license, i, e, 2 * len(list_intersect(s, grams)) / CAST(len(s) + len(grams) AS DOUBLE) AS dice FROM h),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r, license ORDER BY dice DESC, i) AS k FROM s WHERE dice >= {THRESHOLD}) WHERE k = 1),
kept AS (SELECT * FROM top x WHERE NOT EXISTS (
  SELECT 1 FROM top y WHERE y.r = x.r AND y.license <> x.license AND y.e > x.i AND y.i < x.e AND (y.dice > x.dice OR (y.dice = x.dice AND y.license < x.license)))),
best AS (SELECT r, count(*) AS n_matches, max(dice) AS dice, string_agg(license, ',' ORDER BY license) AS licenses FROM kept GROUP BY r),
name AS (SELECT r, min(license) AS license FROM kept JOIN best USING (r, dice) GROUP BY r)
SELECT doc_id, coalesce(n_matches, 0) AS n_matches, license, dice, coalesce(licenses, '') AS licenses
FROM d LEFT JOIN best USING (r) LEFT JOIN name USING (r)"""


SQL = _sql()
