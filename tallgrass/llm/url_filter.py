"""URL filters: a weighted vocabulary found with one Aho-Corasick automaton, behind explicit site rules.

The automaton reads each URL once, A-Z lower-cased. A term counts only where the characters on both sides are not ASCII
letters or digits (or are the URL's ends). Terms count once each. A URL is rejected for one strict term, or for
`soft_terms` or more different soft terms whose weights come to `soft_weight` or more (so two of weight 1 don't reject, and no
number of times one term does). The terms below are a small general set; `read_terms` takes a vocabulary of up to
`MOST_TERMS` terms from a table. Each worker process builds its automaton once. Site rules come before that: the
longest fitting rule decides, among equally long ones the smallest.

A null URL, an empty one and one without `://` have empty host and path, fit no rule, and are judged by their terms
alone. A very long URL is read once, in time near its length. Rows are independent: repeated rows repeat, no row is lost, an empty table gives an empty result, and further
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.llm.common import ascii_lower

#: (verdict, host, path)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
STRICT = ("cheap-pills", "keygen", "malware", "phishing", "porn", "porno", "pornography", "ransomware", "spam-farm", "viagra", "warez", "xxx")
#: Soft terms with their weights.
SOFT = {
    "adult": 2, "affiliate": 1, "bet": 1, "betting": 2, "bonus": 1, "camgirl": 2, "casino": 2, "cheap": 1, "coupon": 1, "crack": 2, "cracked": 2, "deal": 1, "escort": 2,
    "erotic": 2, "free": 1, "gambling": 2, "hack": 1, "hookup": 2, "jackpot": 2, "loan": 1, "lottery": 2, "nude": 2, "payday": 2, "pharmacy": 1, "pills": 2, "poker": 2,
    "promo": 1, "ref": 1, "replica": 1, "serial": 1, "sex": 2, "slots": 2, "spam": 2, "torrent": 2, "win": 1,
}
#: Terms that a vocabulary may have: about 300 bytes each in the automaton of each worker.
MOST_TERMS = 1_000_000
SOFT_TERMS = 2
SOFT_WEIGHT = 3

SCHEMA = "page_id long, host string, path string, rule string, verdict string, n_strict int, n_soft int, soft_weight int"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased) and path (then up to `?`, `#` or the end)."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def read_terms(terms: DataFrame, most: int = MOST_TERMS) -> tuple[tuple[str, ...], dict[str, int]]:
    """Strict and soft terms from rows (term, weight): weight 0 is strict, a null or empty term is none, of equal terms the strict or heaviest one counts."""
    low = terms.select(ascii_lower(F.col("term")).alias("term"), F.col("weight").cast("int").alias("weight")).where("term != '' and weight >= 0")
    each = low.groupBy("term").agg(F.min("weight").alias("least"), F.max("weight").alias("weight"))
    rows = each.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} terms")
    strict = sorted(r["term"] for r in rows if not r["least"])
    return tuple(strict), {r["term"]: r["weight"] for r in sorted(rows, key=lambda r: r["term"]) if r["least"]}


_built: dict = {}


def automaton(strict, soft):
    """This process's automaton for the terms; it keeps one."""
    key = (tuple(strict), tuple(sorted(soft.items())))
    if key not in _built:
        _built.clear()
        _built[key] = _automaton(*key)
    return _built[key]


def _automaton(strict, soft):
    import ahocorasick

    a = ahocorasick.Automaton()
    for t in strict:
        a.add_word(t, (t, 0))
    for t, w in soft:
        if t not in strict:
            a.add_word(t, (t, w))
    if len(a):
        a.make_automaton()
    return a


_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def term_hits(a, url: str) -> tuple[set, dict]:
    """The strict terms, and the soft terms with weights, that stand in url between boundaries."""
    strict, soft = set(), {}
    if len(a):
        for end, (t, w) in a.iter(url):
            start = end + 1 - len(t)
            if (start == 0 or url[start - 1] not in _WORD) and (end + 1 == len(url) or url[end + 1] not in _WORD):
                if w:
                    soft[t] = w
                else:
                    strict.add(t)
    return strict, soft


def rule_index(rules) -> dict[str, list[tuple[str, str, str]]]:
    """By host: (path, rule, verdict), the longest first."""
    by: dict[str, list] = {}
    for verdict, host, path in rules:
        by.setdefault(host, []).append((path, host + path, verdict))
    for v in by.values():
        v.sort(key=lambda r: (-len(r[1]), r[1]))
    return by


def fitting_rule(index: dict, host: str, path: str) -> tuple[str | None, str | None]:
    best: tuple | None = None
    at = 0
    while at >= 0 and host:
        for p, rule, verdict in index.get(host[at:], ()):
            if path.startswith(p):
                if best is None or (-len(rule), rule) < best[:2]:
                    best = (-len(rule), rule, verdict)
                break
        at = host.find(".", at) + 1 or -1
    return (best[1], best[2]) if best else (None, None)


def judge_urls(pages: DataFrame, rules=RULES, strict=STRICT, soft=SOFT, soft_terms=SOFT_TERMS, soft_weight=SOFT_WEIGHT) -> DataFrame:
    """One row for each row of pages (page_id, url): host, path, fitting rule, verdict and the terms counted."""
    host, path = url_parts(F.col("url"))
    df = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"), ascii_lower(F.coalesce("url", F.lit(""))).alias("low"))
    shared = pages.sparkSession.sparkContext.broadcast((tuple(rules), tuple(strict), dict(soft)))  # terms and rules: bounded by MOST_TERMS and what the caller lists

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, strict, soft = shared.value
        a, index = automaton(strict, soft), rule_index(rules)
        for b in batches:
            hosts, paths, out = b.column(1).to_pylist(), b.column(2).to_pylist(), []
            for h, p, u in zip(hosts, paths, b.column(3).to_pylist(), strict=True):
                rule, verdict = fitting_rule(index, h, p)
                hit, weak = term_hits(a, u)
                weight = sum(weak.values())
                bad = bool(hit) or (len(weak) >= soft_terms and weight >= soft_weight)
                out.append((rule, verdict or ("block" if bad else "allow"), len(hit), len(weak), weight))
            cols = list(zip(*out, strict=True)) or [()] * 5
            types = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft", "soft_weight"])

    return df.mapInArrow(judged, SCHEMA)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))


def _sql() -> str:
    rest = "CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END"
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ordered = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for _, h, p in ordered]
    rule = " ".join(f"{w} THEN '{h}{p}'" for w, (_, h, p) in zip(fits, ordered, strict=True))
    says = " ".join(f"WHEN '{h}{p}' THEN '{v}'" for v, h, p in ordered)
    has = "CAST(regexp_matches(low, '(^|[^a-z0-9]){}([^a-z0-9]|$)') AS INT)"
    n_strict = " + ".join(has.format(t) for t in STRICT)
    n_soft = " + ".join(has.format(t) for t in SOFT)
    weight = " + ".join(f"{w} * {has.format(t)}" for t, w in SOFT.items())
    return f"""
WITH parts AS (
  SELECT page_id, coalesce({rest}, '') AS rest, {low.format("coalesce(url, '')")} AS low FROM pages),
split AS (
  SELECT page_id, low, {low.format("regexp_extract(rest, '^[^/?#]*', 0)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
judged AS (
  SELECT page_id, host, path, CASE {rule} ELSE NULL END AS rule, CAST({n_strict} AS INT) AS n_strict, CAST({n_soft} AS INT) AS n_soft, CAST({weight} AS INT) AS soft_weight FROM split)
SELECT page_id, host, path, rule, n_strict, n_soft, soft_weight,
  CASE rule {says} ELSE CASE WHEN n_strict > 0 OR (n_soft >= {SOFT_TERMS} AND soft_weight >= {SOFT_WEIGHT}) THEN 'block' ELSE 'allow' END END AS verdict
FROM judged"""


SQL = _sql()
