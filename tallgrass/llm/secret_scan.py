"""Secret scans: known key shapes, and sliding-window Shannon entropy over candidate strings.

Three shapes are matched, leftmost and non-overlapping each: `assign` (a keyword, `:` or `=`, and a value of 6 characters
or more), `access` (AKIA and capitals or digits, 20 characters or more) and `hex` (24 or more of 0-9a-f).

Candidates for entropy are runs of 20 or more of `[A-Za-z0-9+/_=-]`. What the allow list finds within one (placeholders,
counting strings, dates) is cut out; the allow list's whole shapes (UUIDs, paths of plain words), and what it knows from the
text before (public digests), suppress a candidate altogether. The remaining pieces of 20 characters or more with a letter
and a digit are scanned. Their characters decide the class (hex, alnum, base64), each with a threshold of its own. A window
of `WINDOW` characters moves over a piece; the counts of its characters (5 bits each, packed in longs) and the sum of
c log2 c change with the character that enters and the one that leaves, and are never made anew. From the first window at or
over the threshold to the last one is a span of kind entropy_<class>, unless it meets one of the shapes' spans. Sums are whole
numbers (millionths), so that reruns agree.

Positions come from splitting the text at the matches and adding up lengths, in code points. Everything is one
projection over the scan: DataFrame expressions, no shuffle, no Python.

Null and empty texts have no spans. A very long text is read whole, in time near its length; of what stands before a match
only 24 characters are kept. Rows are independent: repeated rows repeat, a null doc_id stays, an empty table gives
an empty result, and further columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.llm.common import documents

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # the same as all runs of which those of fewer characters are dropped
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_alnum", "entropy_base64")
WINDOW = 20
#: By class: bits a character that a window must reach.
THRESHOLDS = {"hex": 3.0, "alnum": 3.6, "base64": 3.7}
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"
#: Candidates that are no secrets: UUIDs and paths of plain words.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^(?!.*[-_/]{2})[a-z][a-z/_-]*\d{0,4}$",  # no repeated group: Java's matcher recurses for each turn of one
)
#: Parts of candidates that are no secrets: placeholders, one character again and again, counting strings, dates.
ALLOWED_PARTS = (
    r"(?i:example|sample|placeholder|changeme|dummy|lorem|your[_-])",
    r"([A-Za-z0-9+/_=-])\1{7,}",
    r"0123456789|abcdefghij|ABCDEFGHIJ",
    r"\d{4}-\d{2}-\d{2}",
)
#: What may stand before a public digest.
ALLOWED_BEFORE = r"(?i)(?:sha-?\d+|md5|commit|digest|checksum|etag|integrity|revision)[\"']?[\x20:=-]*$"


def _scaled(c: int) -> int:
    return round(1e6 * c * math.log2(c)) if c else 0


def window_limit(threshold: float, window: int = WINDOW) -> int:
    """Entropy is at least the threshold where the sum of c log2 c is at most this."""
    return math.floor(1e6 * window * (math.log2(window) - threshold))


def prefix_sums(values: str) -> str:
    """SQL: for each element of an array of numbers the sum of those before it, in time near its length."""
    return (
        f"transform(array(named_struct('v', {values})), w -> transform(array(aggregate(transform(sequence(0, size(w.v) div 64), c -> aggregate(slice(w.v, c * 64 + 1, 64), 0L, (a, x) -> a + x)),"
        " array(0L), (a, x) -> concat(a, array(element_at(a, -1) + x)))), o ->"
        " transform(w.v, (x, i) -> o[i div 64] + aggregate(slice(w.v, (i div 64) * 64 + 1, i % 64), 0L, (a, y) -> a + y))))[0][0]"
    )


def located(df: DataFrame, name: str, pattern: str, group: int | None = None) -> DataFrame:
    """df (with body) and column name: start, end, value and the 24 characters before, for each match; value is of a group."""
    pat = F.lit(pattern)
    has = F.col("body").rlike(pattern)
    none = F.array().cast("array<string>")
    hits, pieces, value = f"{name}_hits", f"{name}_pieces", f"{name}_value"
    df = df.withColumns({hits: F.when(has, F.regexp_extract_all("body", pat, F.lit(0))).otherwise(none)})
    df = df.withColumns({pieces: F.when(F.size(hits) > 0, F.split("body", pattern, -1)).otherwise(none), value: F.col(hits) if group is None else F.when(F.size(hits) > 0, F.regexp_extract_all("body", pat, F.lit(group))).otherwise(none)})
    lengths = f"transform(slice({pieces}, 1, size({hits})), (p, i) -> cast(length(p) + length({hits}[i]) as bigint))"
    made = f"if(size({hits}) = 0, array(), transform({prefix_sums(lengths)}, (b, i) -> struct(b + length({pieces}[i]) as start, b + length({pieces}[i]) + length({hits}[i]) as end, {value}[i] as value, substring({pieces}[i], -24, 24) as before)))"
    return df.withColumn(name, F.expr(made)).drop(hits, pieces, value)


def _class(value: Column) -> Column:
    mixed = value.rlike("[a-z]") & value.rlike("[A-Z]") & value.rlike("[0-9]")
    return F.when(value.rlike("^[0-9a-fA-F]+$"), F.lit("hex")).when(mixed | value.rlike("[^A-Za-z0-9]"), F.lit("base64")).otherwise(F.lit("alnum"))


#: Counts of 5 bits in a long.
_PACKED = 12


def entropy_span(value: str, limit: str, window: int = WINDOW) -> str:
    """SQL: struct(first, last): the start of the first window at the limit and the end of the last one, or -1."""
    assert 0 < window < 32, "counts have 5 bits"
    table = f"array({', '.join(f'{_scaled(c)}L' for c in range(window + 2))})"
    codes = f"transform(split({value}, ''), c -> instr('{ALPHABET}', c) - 1)"
    start = f"named_struct('n', array_repeat(0L, {-(-len(ALPHABET) // _PACKED)}), 's', 0L, 'first', -1, 'last', -1)"
    enter, leave = "w.c[i]", f"if(i >= {window}, w.c[i - {window}], -1)"
    count = lambda x: f"cast(shiftrightunsigned(a.n[cast({x} div {_PACKED} as int)], 5 * ({x} % {_PACKED})) & 31L as int)"
    one = lambda x: f"if({x} >= 0 and k = {x} div {_PACKED}, shiftleft(1L, 5 * ({x} % {_PACKED})), 0L)"
    change = f"if(e = l, 0L, w.x[{count('e')} + 1] - w.x[{count('e')}] + if(l >= 0, w.x[{count('l')} - 1] - w.x[{count('l')}], 0L))"
    step = (
        f"transform(array({enter}), e -> transform(array({leave}), l -> transform(array(a.s + {change}), s -> named_struct("
        f"'n', if(e = l, a.n, transform(a.n, (v, k) -> v + {one('e')} - {one('l')})), 's', s,"
        f" 'first', if(a.first < 0 and i >= {window - 1} and s <= w.m, i - {window - 1}, a.first),"
        f" 'last', if(i >= {window - 1} and s <= w.m, i + 1, a.last)))[0])[0])[0]"
    )
    return f"transform(array(named_struct('c', {codes}, 'x', {table}, 'm', {limit})), w -> aggregate(sequence(0, size(w.c) - 1), {start}, (a, i) -> {step}, a -> named_struct('first', a.first, 'last', a.last)))[0]"


def _pieces(parts: str) -> str:
    """SQL: for each candidate the pieces (start, value) between the matches of parts, in time near its length."""
    pattern = parts.replace("\\", "\\\\").replace("'", "\\'")
    lengths = "transform(c.between, (p, k) -> cast(length(p) + coalesce(length(get(c.hits, k)), 0) as bigint))"
    cut = f"named_struct('hits', regexp_extract_all(m.value, '{pattern}', 0), 'between', split(m.value, '{pattern}', -1))"
    placed = f"transform({prefix_sums(lengths)}, (b, k) -> named_struct('start', m.start + b, 'value', c.between[k]))"
    return f"transform(candidate, m -> if(m.value rlike '{pattern}', transform(array({cut}), c -> {placed})[0], array(named_struct('start', m.start, 'value', m.value))))"


def scan_secrets(docs: DataFrame, *keep: str, thresholds: dict[str, float] = THRESHOLDS, allowed=ALLOWED, allowed_parts=ALLOWED_PARTS, window: int = WINDOW) -> DataFrame:
    """keep and spans: an array of (start, kind number of KINDS, end), sorted; those of kind 0 to 2 are the shapes'."""
    keep = keep or ("doc_id",)
    df = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("body"))
    for name, pattern, group in (("assign", ASSIGN, 2), ("access", ACCESS, None), ("hex", HEX, None), ("candidate", CANDIDATE, None)):
        df = located(df, name, pattern, group)
    least = {"assign": 6, "access": 20, "hex": 24}

    def shaped(k: int, name: str) -> Column:
        return F.transform(F.filter(name, lambda m: F.length(m["value"]) >= least[name]), lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), m["end"].alias("end")))

    df = df.withColumn("base", F.array_sort(F.concat(*[shaped(k, n) for k, n in enumerate(KINDS[:3])])))

    def wanted(m: Column) -> Column:
        v = m["value"]
        ok = v.rlike("[0-9]") & v.rlike("[A-Za-z]") & ~m["before"].rlike(ALLOWED_BEFORE)
        for a in allowed:
            ok = ok & ~v.rlike(a)
        return ok

    order = list(thresholds)
    limit = "case k " + " ".join(f"when '{c}' then {window_limit(t, window)}L" for c, t in thresholds.items()) + " end"
    df = df.withColumn("candidate", F.filter("candidate", wanted))
    parts = "|".join(allowed_parts)
    df = df.withColumn("candidate", F.flatten(F.expr(_pieces(parts)))) if parts else df
    df = df.withColumn("candidate", F.filter("candidate", lambda m: (F.length(m["value"]) >= window) & m["value"].rlike("[0-9]") & m["value"].rlike("[A-Za-z]")))
    df = df.withColumn("candidate", F.transform("candidate", lambda m: F.struct(m["start"].alias("start"), m["value"].alias("value"), _class(m["value"]).alias("class"))))
    kind = "case m.class " + " ".join(f"when '{c}' then {KINDS.index(f'entropy_{c}')}" for c in order) + " end"
    windows = f"transform(candidate, m -> struct(m.start as start, {kind} as kind, {entropy_span('m.value', limit.replace('case k', 'case m.class'), window)} as at))"
    df = df.withColumn("windows", F.expr(windows))
    added = "transform(filter(windows, x -> x.at.first >= 0 and not exists(base, b -> b.start < x.start + x.at.last and x.start + x.at.first < b.end)), x -> struct(x.start + x.at.first as start, x.kind as kind, x.start + x.at.last as end))"
    return df.select(*keep, "base", F.expr(f"array_sort(concat(base, {added}))").alias("spans"))


def spelled(spans: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(documents(spark, sf_dir, "doc_id", "text"), "doc_id")

    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")

    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(spelled(F.col("base")), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"))
