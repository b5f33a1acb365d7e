"""Scored relationships between code elements and the services and dependencies of their repository.

Elements and candidates can be many on both sides, so they never meet in a cross join, and no text is cut out for each
element. A positional index has a row for each word of each line of a file, made once whatever the file's elements. A
candidate's probes (name, provider, SDK words, URL, import shapes) are looked up there by their longest word: distinct
words and distinct stems of a repository meet by an equi-join on the stem's rarest gram, the lines that hold such a word are
tested for the probe itself. For each probe and bin of `BIN` lines the first and the last line that hold it are kept; an element's
window is as long as a bin, so it takes the end of one bin and the start of the next, and these two numbers say whether the
probe stands in it. Scoring reads the numbers of the parts found. Probes are looked for line by line: one with a line break is
in no line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallgrass.functions.text import first_case, grams, stable_id, word_bounded
from tallgrass.operators.aggregates import evidence
from tallgrass.operators.packages import saved

BEFORE, AFTER = 50, 200
#: Lines in a bin: as many as in a window.
BIN = BEFORE + AFTER
LEAST = 0.3
# Words that show a provider's SDK in code; for other providers it is the service's own name.
SDK_WORDS = {
    "firebase": ("firebase", "@firebase/", "firebase/app", "firebase/auth", "firebase/firestore", "firebase/storage"),
    "aws": ("aws-sdk", "@aws-sdk/"),
    "stripe": ("stripe",),
    "clerk": ("@clerk/", "clerk"),
    "vercel": ("@vercel/",),
    "openai": ("openai", "@openai/"),
    "anthropic": ("anthropic", "@anthropic-ai/"),
}
#: Lengths of grams by which words are looked up: a stem's are the longest that it has, so that few words share its rarest one, however many words there are.
SIZES = (1, 2, 3, 6, 12)
URL_KEYS = ("endpoint", "api_url", "url", "base_url")
WORD = r"(?U)[^\p{Alnum}_]+"


def config_url(config: Column) -> Column:
    return F.coalesce(*[F.try_element_at(config, F.lit(k)) for k in URL_KEYS])


def words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, WORD), lambda w: w != ""))


def longest_word(name: Column) -> Column:
    """The longest word of a name, of equal ones the first; the name itself where it has none."""
    w = F.filter(F.split(name, WORD), lambda x: x != "")
    best = F.array_max(F.transform(w, lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("i"), x.alias("w"))))
    return F.coalesce(best["w"], name)


def lines_of(files: DataFrame) -> DataFrame:
    """repository_id, file_path, line (from 1) and its lower-cased text."""
    each = files.select("repository_id", F.col("path").alias("file_path"), F.posexplode("lines").alias("at", "line_text"))
    return each.select("repository_id", "file_path", (F.col("at") + 1).alias("line"), F.lower("line_text").alias("line_text"))


def word_index(files: DataFrame) -> DataFrame:
    """The positional index of files: repository_id, file_path, line, word; written."""
    return saved(lines_of(files).select("repository_id", "file_path", "line", F.explode(words(F.col("line_text"))).alias("word")))


def held_stems(index: DataFrame, stems: DataFrame) -> DataFrame:
    """(repository_id, word, stem): words of a repository's files that hold a stem. A stem need not stand at a word's start (`stripe` in `mystripe`)."""
    long = F.expr(f"array_max(filter(array({', '.join(map(str, SIZES))}), n -> n <= length(stem)))")
    stems = saved(stems.withColumn("size", long))
    sizes = sorted(r["size"] for r in stems.select("size").distinct().collect())  # of SIZES
    vocabulary = index.select("repository_id", "word").distinct().select("repository_id", "word", F.explode(grams("word", sizes or SIZES[:1])).alias("gram"))
    vocabulary = saved(vocabulary)
    parts = stems.select("repository_id", "stem", F.explode(F.filter(grams("stem", sizes or SIZES[:1]), lambda g: F.length(g) == F.col("size"))).alias("gram"))
    # the stem's gram that fewest words hold; one that no word holds says that no word holds the stem
    counts = vocabulary.groupBy("repository_id", "gram").agg(F.count("*").alias("n"))
    rarest = parts.join(counts, ["repository_id", "gram"], "left").groupBy("repository_id", "stem").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    return vocabulary.join(rarest, ["repository_id", "gram"]).where(F.contains("word", "stem")).select("repository_id", "word", "stem")


def probe_spans(index: DataFrame, files: DataFrame, probes: DataFrame) -> DataFrame:
    """repository_id, file_path, bin, probe, whole, first and last: the lines of a bin that hold a probe. probes: repository_id, root, probe, whole (not within a word)."""
    distinct = probes.withColumn("stem", longest_word(F.col("root"))).where("stem != ''").select("repository_id", "stem", "probe", "whole").distinct()
    held = held_stems(index, distinct.select("repository_id", "stem").distinct())
    near = index.join(held, ["repository_id", "word"]).select("repository_id", "file_path", "line", "stem").distinct()
    tried = near.join(lines_of(files), ["repository_id", "file_path", "line"]).join(distinct, ["repository_id", "stem"])
    hits = tried.where(F.when(F.col("whole"), word_bounded(F.col("line_text"), F.col("probe"))).otherwise(F.contains("line_text", "probe")))
    by = hits.groupBy("repository_id", "file_path", F.expr(f"(line - 1) div {BIN}").alias("bin"), "probe", "whole")
    return by.agg(F.min("line").alias("first"), F.max("line").alias("last"))


def in_windows(elements: DataFrame, spans: DataFrame) -> DataFrame:
    """(repository_id, code_element_id, probe, whole): the probes in each element's window, from 50 lines before it to 200 after its start."""
    begin = F.greatest(F.col("line_number") - BEFORE, F.lit(1))
    e = elements_of(elements).withColumns({"begin": begin, "end": F.col("line_number") + AFTER - 1})
    bins = F.array_distinct(F.array(F.expr(f"(begin - 1) div {BIN}"), F.expr(f"(end - 1) div {BIN}")))
    e = e.where("end >= begin").withColumn("bin", F.explode(bins))
    # a window that begins within a bin goes beyond its end; another begins with the bin
    held = F.when(F.col("begin") - 1 > F.col("bin") * BIN, F.col("last") >= F.col("begin")).otherwise(F.col("first") <= F.col("end"))
    return e.join(spans, ["repository_id", "file_path", "bin"]).where(held).select("repository_id", "code_element_id", "probe", "whole").distinct()


def elements_of(elements: DataFrame) -> DataFrame:
    return elements.select("repository_id", F.col("id").alias("code_element_id"), "file_path", "line_number")


def listed_parts(candidates: DataFrame, *parts: tuple[int, Column, bool]) -> DataFrame:
    """(repository_id, target_id, part, probe, whole) of candidates' probes that there are."""
    each = F.array(*[F.struct(F.lit(k).alias("part"), probe.alias("probe"), F.lit(whole).alias("whole")) for k, probe, whole in parts])
    return candidates.select("repository_id", "target_id", F.explode(F.filter(each, lambda p: p["probe"] != "")).alias("p")).select("repository_id", "target_id", "p.*")


def sdk_words(provider: Column, name: Column) -> Column:
    low = F.lower(provider)
    return first_case([(low == p, F.array(*map(F.lit, w))) for p, w in SDK_WORDS.items()], F.array(F.lower(name)))


#: An element may be tied to a service by at most so many SDK words, to a dependency by so many parts of a scoped name.
PLACES = 6
#: What stands before and after a dependency's name where it is imported; the first that fits counts.
SHAPES = (("import ", ""), ("from '", ""), ('from "', '"'), ("require('", ""), ('require("', '"'), ("use ", ""), ("extern crate ", ""))


def service_relationships(elements: DataFrame, files: DataFrame, services: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """Name 0.3, provider 0.2, each SDK word 0.4, URL 0.5, variable 0.3; kept from 0.3, at most 1."""
    has_config = "configuration" in services.columns
    config = F.col("configuration") if has_config else F.create_map().cast("map<string,string>")
    s = services.select("repository_id", F.col("id").alias("target_id"), "name", "provider", config_url(config).alias("url"), F.try_element_at(config, F.lit("env_var")).alias("env_var"))
    s = s.withColumn("sdk", sdk_words(F.col("provider"), F.col("name")))
    word = lambda k: F.get("sdk", F.lit(k))
    probes = listed_parts(s, (0, F.lower("name"), False), (1, F.lower("provider"), False), *[(2 + k, word(k), True) for k in range(PLACES)], (8, F.lower("url"), False), (9, F.lower("env_var"), False))
    index = word_index(files) if index is None else index
    found = saved(in_windows(elements, probe_spans(index, files, probes.withColumn("root", F.col("probe")))))
    has = lambda k: F.array_contains("parts", k)
    parts = [
        (has(0), 0.3, F.concat(F.lit("Service name '"), "name", F.lit("' found in code"))),
        (has(1), 0.2, F.concat(F.lit("Provider '"), "provider", F.lit("' found in code"))),
        *[(has(2 + k), 0.4, F.concat(F.lit("SDK pattern '"), word(k), F.lit("' detected"))) for k in range(PLACES)],
        (has(8), 0.5, F.concat(F.lit("API endpoint '"), "url", F.lit("' detected"))),
        (has(9), 0.3, F.concat(F.lit("Environment variable '"), "env_var", F.lit("' used"))),
    ]
    # a provider by itself doesn't reach LEAST and is shared by many services: it is added to the pairs that have more
    strong = _with_parts(found, probes.where("part != 1"))
    provided = found.where("not whole").join(probes.where("part = 1").select("repository_id", "probe").distinct(), ["repository_id", "probe"]).select("repository_id", "code_element_id", F.col("probe").alias("low_provider"), F.lit(1).alias("provided"))
    pairs = strong.join(s, ["repository_id", "target_id"]).withColumn("low_provider", F.lower("provider")).join(provided, ["repository_id", "code_element_id", "low_provider"], "left")
    pairs = pairs.withColumn("parts", F.when(F.col("provided").isNotNull(), F.array_append("parts", F.lit(1))).otherwise(F.col("parts")))
    return _scored(pairs, parts, "service", "uses")


def dependency_relationships(elements: DataFrame, files: DataFrame, dependencies: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """An import in the file 0.6 (the first shape that fits), the name as a word 0.4, each part of a scoped name 0.3."""
    d = dependencies.select("repository_id", F.col("id").alias("target_id"), "name").withColumn("low", F.lower("name"))
    scoped = lambda k: F.when(F.col("low").contains("/"), F.get(F.split("low", "/"), F.lit(k)))
    shaped = lambda k: F.concat(F.lit(SHAPES[k][0]), "low", F.lit(SHAPES[k][1]))
    named = listed_parts(d, (0, F.col("low"), True), *[(1 + k, scoped(k), True) for k in range(PLACES)])
    imports = listed_parts(d.where("low != ''"), *[(10 + k, shaped(k), False) for k in range(len(SHAPES))])
    roots = imports.join(d.select("repository_id", "target_id", F.col("low").alias("root")), ["repository_id", "target_id"])
    index = word_index(files) if index is None else index
    spans = saved(probe_spans(index, files, named.withColumn("root", F.col("probe")).unionByName(roots)))
    found = saved(in_windows(elements, spans.where("whole")))
    near = found.join(named.where("part != 1"), ["repository_id", "probe", "whole"]).select("repository_id", "code_element_id", "target_id", "part")
    # imports: by file, not by element
    by_file = spans.where("not whole").select("repository_id", "file_path", "probe").distinct().join(imports, ["repository_id", "probe"])
    by_file = by_file.groupBy("repository_id", "file_path", "target_id").agg(F.min("part").alias("part"))
    imported = elements_of(elements).join(by_file, ["repository_id", "file_path"]).select("repository_id", "code_element_id", "target_id", "part")
    own = near.unionByName(imported).groupBy("repository_id", "code_element_id", "target_id").agg(F.collect_set("part").alias("parts"))
    own = own.join(d, ["repository_id", "target_id"])
    # A scope is shared by many dependencies, and an element near it is tied to each: these pairs are made last and not moved, less those that have more.
    scopes = named.where("part = 1").select("repository_id", F.col("probe").alias("scope"), "target_id").distinct()
    within = found.withColumnRenamed("probe", "scope").join(scopes.select("repository_id", "scope").distinct(), ["repository_id", "scope"], "left_semi").select("repository_id", "code_element_id", "scope")
    own = own.withColumn("scope", scoped(0)).join(within.withColumn("inside", F.lit(1)), ["repository_id", "code_element_id", "scope"], "left")
    own = saved(own.withColumn("parts", F.when(F.col("inside").isNotNull(), F.array_append("parts", F.lit(1))).otherwise(F.col("parts"))))
    more = own.where("inside is not null").groupBy("repository_id", "code_element_id", "scope").agg(F.collect_set("target_id").alias("more"))  # of one window or file
    has = lambda k: F.array_contains("parts", k)
    shape = F.array_max("parts")
    text = first_case([(shape == 10 + k, shaped(k)) for k in range(len(SHAPES))], F.lit(None).cast("string"))
    parts = [
        (shape >= 10, 0.6, F.concat(F.lit("Import statement found: "), text)),
        (has(0), 0.4, F.concat(F.lit("Package '"), "name", F.lit("' used in code"))),
        *[(has(1 + k), 0.3, F.concat(F.lit("Scoped package part '"), F.get(F.split("name", "/"), F.lit(k)), F.lit("' found"))) for k in range(PLACES)],
    ]
    # what is said of such a pair is the same for all elements: once for each dependency
    members = _rated(scopes.join(d, ["repository_id", "target_id"]).withColumn("parts", F.array(F.lit(1))), parts).select("repository_id", "scope", "target_id", "confidence", "evidence")
    rest = within.join(more, ["repository_id", "code_element_id", "scope"], "left").join(members, ["repository_id", "scope"])
    rest = rest.where(~F.coalesce(F.array_contains("more", F.col("target_id")), F.lit(False)))
    return _scored(own, parts, "dependency", "imports").unionByName(_related(rest, "dependency", "imports"))


def _with_parts(found: DataFrame, probes: DataFrame) -> DataFrame:
    """(repository_id, code_element_id, target_id, parts) from the probes found by element: at most as many as a candidate has."""
    parts = found.join(probes, ["repository_id", "probe", "whole"])
    return parts.groupBy("repository_id", "code_element_id", "target_id").agg(F.collect_set("part").alias("parts"))


def _rated(found: DataFrame, parts) -> DataFrame:
    score, text = evidence(parts, LEAST)
    return found.withColumns({"confidence": score, "evidence": text}).where(F.col("confidence").isNotNull())


def _scored(found: DataFrame, parts, target: str, kind: str) -> DataFrame:
    return _related(_rated(found, parts), target, kind)


def _related(rated: DataFrame, target: str, kind: str) -> DataFrame:
    rows = rated.select("repository_id", "code_element_id", F.lit(target).alias("target_type"), "target_id", F.lit(kind).alias("relationship_type"), "confidence", "evidence")
    return rows.select(stable_id(F.lit(target), F.col("code_element_id"), F.col("target_id")).alias("id"), "*")
