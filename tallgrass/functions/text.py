"""Column functions over lines and paths, all evaluated in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode classes, so that letters and digits beyond ASCII count.
U = "(?U)"


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def lines(content: Column) -> Column:
    """Lines without their ends: none for an empty text, and none after a last newline."""
    body = F.regexp_replace(content, r"\n\z", "")
    split = F.transform(F.split(body, "\n"), lambda x: F.regexp_replace(x, r"\r\z", ""))
    return F.when(F.coalesce(content, F.lit("")) == "", F.array().cast("array<string>")).otherwise(split)


def found(line: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match; null where there is none or it is empty."""
    got = F.regexp_extract(line, pattern, group)
    return F.when(got != "", got)


def stripped(line: Column, pattern: str, group: int = 1) -> Column:
    got = strip(F.regexp_extract(line, pattern, group))
    return F.when(got != "", got)


def any_of(c: Column, *parts: str) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | c.contains(p)
    return out


def starts_with_any(c: Column, *parts: str) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | c.startswith(p)
    return out


def ends_with_any(c: Column, *parts: str) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | c.endswith(p)
    return out


def first_case(cases: list[tuple[Column, object]], default: object = None) -> Column:
    """The value of the first condition that holds."""
    out: Column | None = None
    for condition, value in cases:
        v = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, v) if out is None else out.when(condition, v)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def extension(name: Column) -> Column:
    """Lower-cased, without the dot; empty for a name without one, or with one in front alone."""
    return F.lower(F.regexp_extract(name, r"^.+\.([^.]*)$", 1))


def ahead(all_lines: Column, index: Column, count: int, skip: int = 0) -> Column:
    """`count` lines from the line of this index (from 0) on, or from `skip` lines after it."""
    return F.slice(all_lines, index + 1 + skip, count)


def first_ahead(all_lines: Column, index: Column, count: int, pattern: str, skip: int = 1) -> Column:
    """The first capture among the lines after this one."""
    near = F.transform(ahead(all_lines, index, count, skip), lambda x: F.regexp_extract(x, pattern, 1))
    return F.get(F.filter(near, lambda x: x != ""), F.lit(0))


def word_bounded(text: Column, word: Column | str) -> Column:
    """word stands in text and touches no letter, digit or underscore (an end of the text is a boundary). Literal, not a pattern."""
    quoted = F.lit(_quote(word)) if isinstance(word, str) else F.concat(F.lit(r"\Q"), word, F.lit(r"\E"))
    return F.regexp_like(text, F.concat(F.lit(r"(?U)(?<![\w])"), quoted, F.lit(r"(?![\w])")))


def _quote(s: str) -> str:
    return r"\Q" + s + r"\E"


def folded_like(c: Column, pattern: str) -> Column:
    """SQL LIKE that folds A-Z alone."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(c, upper, upper.lower()).like("".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in pattern))


def split_list(c: Column, each: Callable[[Column], Column] = strip) -> Column:
    """Comma-separated parts, each treated, without the empty ones."""
    return F.filter(F.transform(F.split(c, ","), each), lambda x: x != "")


def version_parts(v: Column) -> Column:
    """The first three dot-separated numbers; what is missing or no number counts as 0."""
    at = F.split(F.regexp_replace(v, "^v", ""), r"\.")
    return F.array(*[F.coalesce(F.try_to_number(F.get(at, F.lit(k)), F.lit("999999999")).cast("long"), F.lit(0).cast("long")) for k in range(3)])


def is_newer_version(candidate: Column, current: Column) -> Column:
    return version_parts(candidate) > version_parts(current)


def stable_id(*parts: Column) -> Column:
    """A reproducible id of what a row is."""
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def repository_name(url: Column) -> Column:
    """The last path segment of a URL or path, without `.git`."""
    return F.regexp_replace(F.regexp_extract(F.regexp_replace(url, "/+$", ""), r"[^/:]*$", 0), r"\.git$", "")


def is_local_path(url: Column) -> Column:
    return starts_with_any(url, "/", "./", "../", "~", "file://") | url.rlike(r"^[A-Za-z]:[\\/]") | ~(url.contains("://") | url.rlike(r"^[^/]+@[^/]+:"))


def grams(name: str, sizes: Sequence[int] = (1, 2, 3)) -> Column:
    """The parts of a text of so many characters: of one to three, one that it holds begins with one of them."""
    return F.expr(f"array_distinct(flatten(transform(filter(array({', '.join(map(str, sizes))}), n -> n <= length({name})), n -> transform(sequence(1, length({name}) - n + 1), i -> substring({name}, i, n)))))")
