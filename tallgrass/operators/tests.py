"""Test cases: framework from the file, suite from the last suite line above, assertions from the lines after.

Everything is read off the file's own array of lines: the suite is the last of the suite names among the lines above,
looked up by position, and the lines ahead are a slice.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallgrass.functions.text import ahead, any_of, ends_with_any, first_case, found, stable_id, starts_with_any, strip
from tallgrass.sources.corpus import minified, skipped

TEST = "array<struct<name:string,line:int,suite:string,assertions:array<string>,setup:array<string>,teardown:array<string>>>"
QUOTED = r"""^[^'"`]*(?:'([^']*)'|"([^"]*)"|`([^`]*)`)"""


def is_test_file() -> Column:
    """By the file's name, or a folder of its path within the repository."""
    n, p = F.col("low_name"), F.col("low_path")
    named = ends_with_any(n, "_test.py", "_test.go", "_test.rs") | any_of(n, "test", "spec")
    return named | p.rlike("/(__tests__|spec|specs|tests?[^/]*)/")


def quoted_name(x: Column) -> Column:
    return F.coalesce(*[found(x, QUOTED, k) for k in (1, 2, 3)])


@dataclass(frozen=True)
class Style:
    """How a language writes tests: all columns of a stripped line."""

    test: Any
    name: Any
    suite: Any = None
    window: int = 50
    asserts: tuple[str, ...] = ()
    setup: tuple[str, ...] = ()
    teardown: tuple[str, ...] = ()


def styles() -> dict[str, Style]:
    js = ("it(", "test(", "it.skip(", "test.skip(", "it.only(", "test.only(")
    describe = lambda x: F.when(starts_with_any(x, "describe(", "describe.skip(", "describe.only("), quoted_name(x))
    py_suite = lambda x: F.when(x.startswith("class ") & x.contains("Test"), found(x, r"class ([^:(]*)[:(]"))
    java_suite = lambda x: F.when(x.contains("class ") & x.contains("Test"), found(x, r"(?U)class ([^\s<{]+)"))
    swift_suite = lambda x: F.when(x.contains("class ") & any_of(x, "Tests", "TestCase"), found(x, r"(?U)class ([^\s:{]+)"))
    own = lambda pattern: lambda x, lines, i: found(x, pattern)

    def within(shape: str, pattern: str):
        """The name in the first of five lines, this one first, that has the shape."""
        return lambda x, lines, i: found(F.get(F.filter(ahead(lines, i, 5), lambda y: y.rlike(shape)), F.lit(0)), pattern)

    return {
        "javascript": Style(lambda x: starts_with_any(x, *js), lambda x, lines, i: quoted_name(x), describe, 20, ("expect(", "assert(")),
        "python": Style(lambda x: x.startswith("def test"), own(r"def ([^(]*)\("), py_suite, 30, ("assert ", "self.assert"), ("setUp",), ("tearDown",)),
        "rust": Style(lambda x: x.contains("#[test]"), within("fn ", r"fn ([^<(]*)[<(]"), None, 50, ("assert!", "assert_eq!")),
        "go": Style(lambda x: x.startswith("func Test"), own(r"func ([^(]*)\("), None, 50, ("t.Error", "t.Fatal", "assert.", "require.")),
        "java": Style(lambda x: x.contains("@Test"), within("public (static )?void", r"void\s+([^(\s]+)\s*\("), java_suite, 50, ("assert", "Assert."), ("@BeforeEach", "@BeforeAll"), ("@AfterEach", "@AfterAll")),
        "swift": Style(lambda x: x.startswith("func test"), own(r"func ([^(]*)\("), swift_suite, 50, ("XCTAssert", "expect("), ("setUp()",), ("tearDown()",)),
    }


def framework(language: Column, c: Column) -> Column:
    return first_case(
        [
            ((language == "javascript") & c.contains("jest"), "jest"),
            ((language == "javascript") & c.contains("mocha"), "mocha"),
            ((language == "javascript") & c.contains("vitest"), "vitest"),
            ((language == "javascript") & any_of(c, "describe", "it(", "test("), "jest"),
            ((language == "python") & any_of(c, "import unittest", "from unittest"), "unittest"),
            ((language == "python") & any_of(c, "import pytest", "from pytest"), "pytest"),
            ((language == "python") & any_of(c, "import nose", "from nose"), "nose"),
            (language == "rust", "cargo_test"),
            (language == "go", "go_test"),
            ((language == "java") & c.contains("@Test") & c.contains("org.junit"), "junit"),
            ((language == "java") & c.contains("@Test") & c.contains("org.testng"), "testng"),
            ((language == "swift") & c.contains("import XCTest"), "xctest"),
            ((language == "swift") & any_of(c, "import Quick", "import Nimble"), "quick"),
        ],
        "unknown",
    )


def tests_of(lines: Column, style: Style, js: bool) -> Column:
    """Test structs of one file's lines."""
    bare = F.transform(lines, strip)
    none = F.lit(None).cast("string")
    suites = F.filter(F.transform(bare, lambda x, i: F.struct(i.alias("i"), (style.suite(x) if style.suite else none).alias("s"))), lambda e: e["s"].isNotNull())

    def each(x: Column, i: Column) -> Column:
        near = ahead(lines, i, style.window)
        suite = F.try_element_at(F.filter(suites, lambda e: e["i"] <= i), F.lit(-1))["s"] if style.suite else none
        hook = lambda *w: F.transform(F.filter(near, lambda y: any_of(y, *w)), lambda y: F.lit(w[0]))
        fixed = lambda names: F.array(*map(F.lit, names)).cast("array<string>")
        made = F.struct(
            style.name(x, lines, i).alias("name"),
            (i + 1).alias("line"),
            suite.alias("suite"),
            F.transform(F.filter(near, lambda y: any_of(y, *style.asserts)), strip).alias("assertions"),
            (hook("beforeEach", "beforeAll") if js else fixed(style.setup)).alias("setup"),
            (hook("afterEach", "afterAll") if js else fixed(style.teardown)).alias("teardown"),
        )
        return F.when(style.test(x) & style.name(x, lines, i).isNotNull(), made)

    return F.array_compact(F.transform(bare, each))


def detect_tests(files: DataFrame) -> DataFrame:
    """Rows of the tests table."""
    used = files.where(~skipped() & is_test_file() & F.col("language").isNotNull() & ~minified())
    family = F.when(F.col("language") == "typescript", F.lit("javascript")).otherwise(F.col("language"))
    df = used.withColumn("family", family)
    cases = [(F.col("family") == name, tests_of(F.col("lines"), style, name == "javascript")) for name, style in styles().items()]
    kind = framework(F.col("family"), F.col("content"))
    rows = df.select("repository_id", F.col("path").alias("file_path"), "language", kind.alias("test_framework"), F.explode(first_case(cases, F.array().cast(TEST))).alias("t"))
    return rows.select(
        stable_id(F.lit("test"), F.col("repository_id"), F.col("file_path"), F.col("t.line"), F.col("t.name")).alias("id"),
        "repository_id",
        F.col("t.name").alias("name"),
        "test_framework",
        "file_path",
        F.col("t.line").alias("line_number"),
        "language",
        F.lit("unit").alias("test_type"),
        F.col("t.suite").alias("suite_name"),
        F.col("t.assertions").alias("assertions"),
        F.col("t.setup").alias("setup_methods"),
        F.col("t.teardown").alias("teardown_methods"),
    )
