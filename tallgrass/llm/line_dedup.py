"""Line dedup by content-defined chunks of lines.

Each line is hashed. A cyclic-polynomial hash rolls over the line hashes: with each line it is turned by a bit, takes in the
line and lets out the one `ROLL` lines before. A line ends a chunk if the hash of a full window is below `CUTS` modulo `OF`, so
that boundaries depend on `ROLL` lines alone: lines put in or taken out elsewhere leave them in place. A chunk is at most as
long as its document: a maximum would make boundaries depend on where a document starts.

What occurs more than once in the whole table, by hash: chunks of two or more lines, and boundaries (the window of lines that
makes one). Only the texts of these and of the chunks beside them are looked at further, each against the first of its hash (smallest
doc_id, then place), which stays. Bytes are compared, so that one whose hash is the same by chance stays too. Another
chunk goes whole (one that is no more than its boundary's window is left to that); at another boundary its window goes, and with it the lines of the chunks on both sides (and the
`ROLL - 1` lines before, where boundaries still depend on lines outside) as far as they are, byte for byte, those around the
first one. A repeated passage thus goes up to its very ends if it has a boundary
within: of two lines with probability CUTS / OF, of k lines with 1 - (1 - CUTS / OF)^(k - 1). Measured on sf0.1 of the
repeated passages of over 50 words: README. Every line that goes has an equal one at an earlier place, which stays or has
an earlier one in turn, so that no line's last copy goes.

Everything is DataFrame functions. Hashes and line numbers alone are shuffled to find what repeats and where; texts are looked at again
only in documents that hold such a place, which they meet in a sort-merge join at every size (texts move once), and lines are cut out for these
places alone. The hashes that repeat and at the end the spans that go are broadcast while they are at most `BROADCAST_ROWS`, counted
in the written table, and joined by a shuffle beyond: then hashes move once more. Spans of a document are merged in a
window over that document.

Null texts stay null, empty ones empty; a text of one line has nothing of several lines and stays. A very long text is split
once; boundaries are found in blocks of lines, each rolled in anew, in time near its length. A null doc_id comes after all
others. Rows that repeat with the same doc_id are copies like any other: their repeated lines are taken out of all but the
first by digest; wholly equal rows (doc_id and text) count as one row and are treated alike. Empty tables give an empty
result. Further columns are kept by `dedup_lines`, whose own are named with a leading underscore where docs has the name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallgrass.llm.common import bounded, documents, fresh, materialise, row_digest

ROLL = 2
CUTS, OF = 2, 3
LEAST_LINES = 2
#: Lines whose boundaries are found in one pass.
BLOCK = 256


def _let(name: str, value: str, body: str) -> str:
    """SQL that evaluates value once and names it in body."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _turned(x: str, by: int) -> str:
    return f"(shiftleft({x}, {by}) | shiftrightunsigned({x}, {64 - by}))"


def boundaries(hashes: str, roll: int = ROLL, cuts: int = CUTS, of: int = OF) -> str:
    """SQL: the places (from 0) of the lines that end a chunk by the rolling hash, in order."""
    first = f"greatest(c * {BLOCK} - {roll - 1}, 0)"
    entered = f"{_turned('a.r', 1)} ^ if(i - {roll} >= {first}, {_turned(f'{hashes}[i - {roll}]', roll)}, 0L) ^ {hashes}[i]"
    step = _let("r", f"coalesce({entered}, 0L)", f"named_struct('r', r, 'e', if(i >= greatest(c * {BLOCK}, {roll - 1}) and pmod(r, {of}L) < {cuts}, concat(a.e, array(i)), a.e))")
    block = f"aggregate(sequence({first}, least(c * {BLOCK} + {BLOCK - 1}, size({hashes}) - 1)), named_struct('r', 0L, 'e', cast(array() as array<int>)), (a, i) -> {step}, a -> a.e)"
    return f"flatten(transform(sequence(0, cast((size({hashes}) - 1) div {BLOCK} as int)), c -> {block}))"


def marks(text: str = "text") -> Column:
    """What may repeat in a text: (kind 0, hash, at) for a boundary after line at, (kind 1, hash, at) for a chunk from line at; and as line numbers `lo` to
    `mid` what stands before a boundary, or the whole chunk, and `mid` to `hi` the chunk after a boundary."""
    chunk = "if(k = 0, 0, b[k - 1] + 1)"
    window = f"x - {ROLL - 1}"
    cuts = (
        f"transform(b, (x, k) -> struct(0 as kind, xxhash64(0, slice(h, {window} + 1, {ROLL})) as hash, x as at,"
        f" greatest(least({chunk}, {window}) - {ROLL - 1}, 0) as lo, x + 1 as mid, if(k = size(b) - 1, size(h), b[k + 1] + 1) as hi))"
    )
    ends = "if(size(b) > 0 and b[size(b) - 1] = size(h) - 1, b, concat(b, array(size(h) - 1)))"
    spans = f"filter(transform({ends}, (x, k) -> named_struct('first', {chunk}, 'end', x + 1, 'last', k = size(b))), s -> s.end - s.first > if(s.last, {LEAST_LINES - 1}, {ROLL}))"
    several = f"transform({spans}, s -> struct(1 as kind, xxhash64(1, slice(h, s.first + 1, s.end - s.first)) as hash, s.first as at, s.first as lo, s.end as mid, s.end as hi))"
    return F.expr(_let("h", f"transform(split({text}, '\n'), x -> xxhash64(x))", _let("b", boundaries("h"), f"concat({cuts}, {several})")))


#: SQL: the lines lo to mid and mid to hi of each place.
_BODIES = _let("l", "split(text, '\n')", "transform(places, p -> struct(p.kind as kind, p.hash as hash, p.at as at, p.earliest as earliest, slice(l, p.lo + 1, p.mid - p.lo) as back, slice(l, p.mid + 1, p.hi - p.mid) as fore))")


def _shared(a: str, b: str) -> str:
    """SQL: how many first elements of two arrays agree."""
    return f"transform(array(zip_with({a}, {b}, (x, y) -> coalesce(x = y, false))), z -> if(array_contains(z, false), array_position(z, false) - 1, size(z)))[0]"


def repeated_lines(docs: DataFrame, *keys: str) -> DataFrame:
    """keys, first and end of the runs of lines that go, of each document disjoint; written."""
    used = docs.where(F.instr("text", "\n") > 0)
    names = [*keys, "at"]
    narrow = used.select(*keys, F.explode(marks()).alias("m")).select(*keys, "m.*")
    first = F.min(F.struct(*names)).alias("f")
    twice = narrow.groupBy("hash").agg(F.count("*").alias("n"), first).where("n > 1")
    twice = materialise(twice.select("hash", *[F.col(f"f.{c}").alias(f"f_{c}") for c in names]), "twice")
    earliest = F.struct(*[F.col(c) for c in names]) == F.struct(*[F.col(f"f_{c}").alias(c) for c in names])
    places = narrow.join(bounded(twice), "hash").withColumn("earliest", earliest)
    places = places.groupBy(*keys).agg(F.collect_set(F.struct("kind", "hash", "at", "lo", "mid", "hi", "earliest")).alias("places"))  # of one document
    places = materialise(places, "places")
    # bodies come last: only from documents that hold something repeated, once for each of its places
    found = used.join(places.hint("merge"), list(keys)).select(*keys, F.explode(F.expr(_BODIES)).alias("m")).select(*keys, "m.*")
    found = materialise(found, "marks")  # few are left, and the first of each hash and the others are read from here
    firsts = found.where("earliest").select("hash", F.col("kind").alias("f_kind"), F.col("back").alias("f_back"), F.col("fore").alias("f_fore")).dropDuplicates(["hash"])
    firsts = materialise(firsts, "firsts")
    same = found.where("not earliest").join(firsts, "hash").where("kind = f_kind")
    same = same.where(F.when(F.col("kind") == 1, F.col("back") == F.col("f_back")).otherwise(F.slice("back", -ROLL, ROLL) == F.slice("f_back", -ROLL, ROLL)))
    before, after = F.expr(_shared("reverse(back)", "reverse(f_back)")), F.expr(_shared("fore", "f_fore"))
    begin = F.when(F.col("kind") == 1, F.col("at")).otherwise(F.col("at") + 1 - before)
    end = F.when(F.col("kind") == 1, F.col("at") + F.size("back")).otherwise(F.col("at") + 1 + after)
    spans = same.select(*keys, begin.alias("first"), end.alias("end")).distinct()
    own = W.partitionBy(*keys).orderBy("first", "end")
    reached = F.max("end").over(own.rowsBetween(W.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.coalesce(F.col("first") > reached, F.lit(True)).cast("int"))
    spans = spans.withColumn("run", F.sum("new").over(own.rowsBetween(W.unboundedPreceding, 0)))
    runs = spans.groupBy(*keys, "run").agg(F.min("first").alias("first"), F.max("end").alias("end"))
    return materialise(runs.select(*keys, "first", "end"), "repeated-lines")


def dedup_lines(docs: DataFrame, n_lines: str = "n_lines", n_removed: str = "n_removed") -> DataFrame:
    """docs with text less its repeated lines, and how many lines it had and lost."""
    none, number, digest = fresh(docs, "key_none"), fresh(docs, "key_number"), fresh(docs, "key_digest")
    runs, n_lines, n_removed = fresh(docs, "gone_runs"), fresh(docs, n_lines), fresh(docs, n_removed)
    keys = {none: F.col("doc_id").isNull(), number: F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")), digest: row_digest("doc_id", "text")}
    marked = docs.withColumns(keys)
    names = list(keys)
    found = repeated_lines(marked.select("text", *names), *names)
    gone = found.groupBy(*names).agg(F.array_sort(F.collect_list(F.struct("first", "end"))).alias(runs))  # runs of one document
    out = marked.join(bounded(gone, found), names, "left")
    lost = F.aggregate(runs, F.lit(0).cast("long"), lambda n, c: n + c["end"] - c["first"])
    total = F.when(F.coalesce(F.col("text"), F.lit("")) == "", F.lit(0)).otherwise(F.size(F.split("text", "\n")))
    begin = f"if(k = 0, 0, {runs}[k - 1].end)"
    kept = f"flatten(transform(sequence(0, size({runs})), k -> slice(l, {begin} + 1, if(k = size({runs}), size(l), {runs}[k].first) - {begin})))"
    between = F.expr(_let("l", "split(text, '\\n')", f"array_join({kept}, '\\n')"))
    out = out.withColumns({n_lines: total.cast("long"), n_removed: F.coalesce(lost, F.lit(0).cast("long"))})
    return out.withColumn("text", F.when(F.col(runs).isNull(), F.col("text")).otherwise(between)).select(*docs.columns, n_lines, n_removed)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(documents(spark, sf_dir, "doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", "text")
