"""SimHash near-duplicates: 64-bit fingerprints of 3-word shingles, compared bit plane by bit plane.

A-Z are lower-cased, words are `[^\\x20\\x09-\\x0D]+`, shingles three words joined by spaces, repeats included (a text of
fewer words is one shingle; of none, its fingerprint is zero). A bit is set if it is in over half the XXH64 values (seed
42) of the shingles. Fingerprints at `RADIUS` or fewer differing bits are linked, and documents are grouped by what they
reach over links.

Only distinct fingerprints are compared. The 64 bits are cut into `BLOCKS` parts; two fingerprints within the radius
agree in at least BLOCKS - RADIUS of them, so each fingerprint is filed once for every choice of so many parts, and only
those filed together are compared. In a file of more than `GROUP` the rows within the radius of its smallest fingerprint
are linked to that and meet the others alone, and the others meet all, in pieces by hash with a task for every two; tasks
give a spanning forest of their links, never the pairs. So a file that is one dense group costs in proportion to its rows;
the rows away from its smallest one enter by their number squared over `GROUP`. Inside a task the fingerprints' bits stand in vertical planes of 64 lanes; carry-save counters add up a lane's differing bits for 64
fingerprints at once, and a word of lanes is given up as soon as all its lanes are beyond the radius.

Groups are found by large-star and small-star steps over the links until nothing changes, each step written to the
shared folder.

Null and empty texts have fingerprint zero and form a group. A null doc_id stays null and its row's group is that of its
text. A very long text is read whole where it stands and leaves 8 bytes. Rows that share a doc_id are judged each by its text. Empty tables give an empty result. Further columns are not
read by `near_duplicates` and are kept by `without_near_duplicates`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.llm.common import BROADCAST_ROWS, bounded, counted, documents, fresh, materialise, partitions, release, row_digest, shuffled, small_batches, written

RADIUS = 3
BLOCKS = 5
GROUP = 2048
SEED = 42
#: Words of 64 lanes compared at once.
TASKS = 1 << 17


def fingerprint(text: bytes) -> int:
    """As a signed 64-bit integer."""
    from xxhash import xxh64_digest as digest

    w = text.lower().split()
    if not w:
        return 0
    shingles = map(b" ".join, zip(w, w[1:], w[2:])) if len(w) > 2 else [b" ".join(w)]  # noqa: B905
    n, counts, part = max(1, len(w) - 2), np.zeros(64, np.int64), []
    for s in shingles:
        part.append(digest(s, SEED))
        if len(part) == 1 << 14:
            counts += _bit_counts(part)
            part = []
    if part:
        counts += _bit_counts(part)
    return int(np.packbits(2 * counts > n).view(">i8")[0])


def _bit_counts(digests: list[bytes]) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 8), axis=1)
    full = len(bits) // 255 * 255
    out = bits[full:].sum(axis=0, dtype=np.int64)
    if full:
        out += np.add.reduce(bits[:full].reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return out


def fingerprints(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep` and fp."""
    from pyspark.sql.types import LongType, StructField, StructType

    small_batches(docs.sparkSession)
    keep = keep or ("doc_id",)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [fingerprint(t.as_py() or b"") for t in b.column(0).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(fp, pa.int64())], names=[*keep, "fp"])

    schema = StructType([docs.schema[c] for c in keep] + [StructField("fp", LongType())])
    return docs.select("text", *keep).mapInArrow(hashed, schema)


def planes(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bit planes of fingerprints of one 64-bit word, or of a row of words: by bit and word of 64 lanes; and the bits by bit and row."""
    n = len(fps)
    words = fps[:, None] if fps.ndim == 1 else fps
    raw = words.astype(">u8").view(np.uint8).reshape(n, 8 * words.shape[1])
    bits = np.ascontiguousarray(np.unpackbits(raw, axis=1).T)
    wide = np.zeros((len(bits), -(-n // 64) * 64), np.uint8)
    wide[:, :n] = bits
    return np.packbits(wide, axis=1, bitorder="little").view("<u8"), bits


def links(fps: np.ndarray, low: np.ndarray, high: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row, other) with other in [low, high) of its row, at radius or fewer differing bits; in portions."""
    plane, bits = planes(fps)
    low, high = low.astype(np.int64), high.astype(np.int64)
    first, words = low // 64, np.where(high > low, (high - 1) // 64 - low // 64 + 1, 0)
    ends, total = np.cumsum(words), int(words.sum())
    digits = max(1, int(radius).bit_length())
    spare = (1 << digits) - 1 - radius
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    for begin in range(0, total, TASKS):
        task = np.arange(begin, min(total, begin + TASKS))
        row = np.searchsorted(ends, task, side="right")
        word = first[row] + task - (ends[row] - words[row])
        from_lane, to_lane = np.maximum(low[row] - word * 64, 0), np.minimum(high[row] - word * 64, 64)
        mask = (full << from_lane.astype(np.uint64)) & (full >> (64 - to_lane).astype(np.uint64))
        counter = [np.full(len(task), full if spare >> k & 1 else np.uint64(0)) for k in range(digits)]
        over = ~mask
        for p in range(len(plane)):
            carry = plane[p][word] ^ (np.uint64(0) - bits[p][row].astype(np.uint64))
            for k in range(digits):
                counter[k], carry = counter[k] ^ carry, counter[k] & carry
            over |= carry
            if p % 8 == 7:
                live = np.flatnonzero(over != full)
                if len(live) < 0.7 * len(over):
                    row, word, over, counter = row[live], word[live], over[live], [c[live] for c in counter]
            if not len(row):
                break
        near = np.flatnonzero(over != full)
        for part in np.array_split(near, max(1, -(-len(near) // 8192))):
            hit = np.unpackbits((~over[part]).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            t, lane = np.nonzero(hit)
            if len(t):
                yield row[part][t], word[part][t] * 64 + lane


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n rows the smallest row that it reaches."""
    label = np.arange(n)
    for a, b in pairs:
        while True:
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (label[label] != label).any():
                label = label[label]
    return label


def block_masks(blocks: int, radius: int) -> list[tuple[int]]:
    """For each choice of blocks - radius of the parts of 64 bits, the mask of their bits."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    part = [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [(sum(part[i] for i in chosen),) for chosen in combinations(range(blocks), blocks - radius)]


def file_keys(masks: list[tuple], bits: tuple[str, ...]) -> list[Column]:
    """A key for each mask over the columns bits: the mask's number and the bits that it lets through, mixed to one long."""
    signed = lambda m: F.lit(m - (1 << 64) if m >> 63 else m).cast("long")
    return [F.xxhash64(F.lit(k), *[F.col(c).bitwiseAND(signed(m)) for c, m in zip(bits, mask, strict=True)]) for k, mask in enumerate(masks)]


def dealt(rows: DataFrame, files: DataFrame, file: str, near: Column, heads: DataFrame, *payload: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows (file, fp, load, payload) dealt to tasks (file, a, b) in which every two rows that may be linked meet; and links (a, b) found on the way.

    files (file, load) has the sums of load; a file of a load of up to 1 is one task. In a larger one each row is first held
    against the file's head, a row of heads (file, h_fp and what `near` reads). The rows near it are linked to it, so that they
    need not meet each other: they meet the others only, and the others meet all, piece by piece. Rows may come from an explode,
    so that their size is not known: they and their files are joined by a shuffle, at every size. Of a file that is one dense
    group each row is thus sent once or twice, however large it is; only the others' number enters by its square.
    """
    spark = rows.sparkSession
    zero = F.lit(0).cast("long")
    alone = rows.join(shuffled(files.where("load <= 1").select(file)), file).select(file, zero.alias("a"), zero.alias("b"), zero.alias("own"), "fp", *payload)
    big = materialise(files.where("load > 1").select(file), "big-files")
    found = None
    if not big.isEmpty():
        hot = rows.join(bounded(big), file).join(heads, file).withColumn("ball", near)
        hot = materialise(hot.select(file, "fp", "h_fp", "load", "ball", *payload), "hot-files")
        found = hot.where("ball and fp != h_fp").select(F.col("fp").alias("a"), F.col("h_fp").alias("b"))
        part = lambda c: F.ceil(F.coalesce(F.sum(F.when(c, F.col("load"))), F.lit(0.0)))
        sizes = hot.groupBy(file).agg(part(F.col("ball")).alias("balls"), part(~F.col("ball")).alias("others")).where("others > 0")
        own = F.when(F.col("ball"), F.pmod(F.xxhash64("fp"), "balls")).otherwise(F.col("balls") + F.pmod(F.xxhash64("fp"), "others"))
        meets = F.sequence(F.when(F.col("ball"), F.col("balls")).otherwise(zero), F.col("balls") + F.col("others") - 1)
        pieces = hot.join(sizes, file).withColumn("own", own).withColumn("other", F.explode(meets))
        pieces = pieces.select(file, F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "fp", *payload)
        alone = alone.union(pieces)
    return alone.repartition(partitions(spark), file, "a", "b").sortWithinPartitions(file, "a", "b", "own"), found


def tasks_of(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Portions of whole tasks of dealt rows: their columns, each task's first row and length, and each row's partners [low, high)."""
    for cols in _whole_groups(batches, most):
        file, a, b, own = cols[:4]
        n = len(file)
        edge = np.flatnonzero(np.concatenate(([True], (file[1:] != file[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        size = np.diff(np.concatenate((edge, [n])))
        first = np.bincount(np.repeat(np.arange(len(edge)), size), weights=own == a).astype(np.int64)
        same, mine = a == b, own == a
        low = np.where(same, np.arange(n) + 1, np.repeat(edge + first, size))
        high = np.where(same | mine, np.repeat(edge + size, size), low)
        yield cols, edge, size, low, high


def candidate_links(reps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, group: int = GROUP, masks: list[tuple] | None = None, bits: tuple[str, ...] = ("fp",)) -> DataFrame:
    """Links (a, b) among the distinct fp of reps, whose columns bits hold the fingerprints' words: a spanning forest for each two pieces of a file."""
    masks = block_masks(blocks, radius) if masks is None else masks
    more = [c for c in bits if c != "fp"]
    filed = reps.select("fp", *more, F.lit(1.0 / group).alias("load"), F.explode(F.array(*file_keys(masks, bits))).alias("key"))
    files = filed.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("h_fp")).where("n > 1").withColumn("load", F.col("n") / F.lit(float(group)))
    heads = files.where("load > 1").select("key", "h_fp").join(reps.select(F.col("fp").alias("h_fp"), *[F.col(c).alias(f"h_{c}") for c in more]), "h_fp")
    near = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"h_{c}"))) for c in bits), F.lit(0)) <= radius
    rows, found = dealt(filed, files, "key", near, heads, *more)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, _, _, low, high in tasks_of(batches, 1 << 14):
            fp = cols[4]
            words = np.stack(cols[5:] or [fp], axis=1).view(np.uint64)
            root = forest(len(fp), links(words, low, high, radius))
            child = np.flatnonzero(root != np.arange(len(fp)))
            yield pa.RecordBatch.from_arrays([pa.array(fp[child]), pa.array(fp[root[child]])], names=["a", "b"])

    out = rows.mapInArrow(compared, "a long, b long")
    return (out if found is None else out.union(found)).distinct()


def _whole_groups(batches: Iterator[pa.RecordBatch], most: int = 1 << 14) -> Iterator[list[np.ndarray]]:
    """Columns of sorted batches in portions of about `most` rows that end where the first three columns change."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
        if sum(len(x[0]) for x in held) < most:
            continue
        cols = [np.concatenate(x) for x in zip(*held, strict=True)]
        last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]) | (cols[2] != cols[2][-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield [c[:cut] for c in cols]
        held = [[c[cut:] for c in cols]]
    if held and sum(len(x[0]) for x in held):
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def components(edges: DataFrame) -> DataFrame:
    """For each node of edges (a, b) other than its group's smallest: node, root (the smallest node that it reaches)."""
    spark = edges.sparkSession

    def once(links: DataFrame, few: bool) -> DataFrame:
        """Each link once. Where the minima were too many to broadcast, links lie by one node, and are spread again first."""
        return (links if few else links.repartition(partitions(spark), "u", "v")).distinct()

    now, path = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "links")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        least, p1, found = counted(least, "least")  # written, so that Spark can split the rows of a node with many links
        few = found["n"] <= BROADCAST_ROWS
        large = both.where("v > u").join(F.broadcast(least) if few else shuffled(least), "u")
        large, p2 = written(once(large.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v"), few), "large")
        lower, p3, found = counted(large.groupBy("u").agg(F.min("v").alias("m")), "lower")
        few = found["n"] <= BROADCAST_ROWS
        small = large.join(F.broadcast(lower) if few else shuffled(lower), "u")
        step = once(small.select("u", F.col("m").alias("v")).union(small.select("v", "m").where("v > m")), few)
        before = (path, p1, p2, p3)
        now, path, seen = counted(step, "links", h=F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
        release(spark, *before)
        if seen == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = seen


def near_duplicates(docs: DataFrame, *keep: str, radius: int = RADIUS, blocks: int = BLOCKS, group: int = GROUP) -> DataFrame:
    """The columns `keep` (doc_id among them), fp, and component_id: the smallest doc_id that the row's text reaches."""
    fps = materialise(fingerprints(docs, *keep), "fingerprints")
    reps = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    tree = components(candidate_links(reps, radius, blocks, group))
    roots = tree.select(F.col("node").alias("fp"), "root").union(tree.select(F.col("root").alias("fp"), "root").distinct())
    known = materialise(reps.join(roots, "fp").select("fp", "root", "rep"), "known")
    of_root = materialise(known.groupBy("root").agg(F.min("rep").alias("component")), "roots")
    grouped = known.join(bounded(of_root), "root").select("fp", "root", "component")
    per = reps.join(grouped, "fp", "left").select("fp", F.coalesce("component", "rep").alias("component_id"), F.coalesce("root", "fp").alias("root"))
    per = materialise(per, "components")  # a join of two written tables, whose hot fingerprints Spark can split
    return fps.join(bounded(per), "fp").select(*(keep or ("doc_id",)), "fp", "component_id", "root")


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each group: one of the smallest doc_id there, null last, and of such rows the one of smallest digest."""
    number, digest = fresh(docs, "key_number"), fresh(docs, "key_digest")
    marked = docs.withColumns({number: F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")), digest: row_digest("doc_id", "text")})
    groups = near_duplicates(marked, "doc_id", number, digest)
    best = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), number, digest)).alias("best"))
    kept = best.select(f"best.{number}", f"best.{digest}").hint("shuffle_hash")
    return marked.join(kept, [number, digest], "left_semi").dropDuplicates([number, digest]).select(*docs.columns)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir, "doc_id", "text"), "doc_id")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
