"""Toxicity by compression distance: zstandard dictionaries of ordinary and of toxic text, and how much shorter windows get.

A text's bytes, A-Z lower-cased, between two spaces, are cut into windows of `WINDOW` bytes, one every `STEP`. Each is compressed twice: with the
dictionary of ordinary text, and with that of toxic text, which stands before the same ordinary text. What the second saves is
0 for text that the toxic dictionary doesn't know, whatever its language, and several bytes where a window holds what toxic
texts say and ordinary ones don't.

Dictionaries are trained by zstandard. The ordinary one's samples are windows of texts labelled 0. The toxic one's are the
parts of texts labelled 1 whose byte n-grams stand in `RATIO` times as many contexts there as in texts labelled 0, and in enough
of them; contexts are counted once, so that copies of one text don't make its words toxic. A window at or over a threshold is
a hit; the threshold is the least that a share of at most `FALSE_HITS` of ordinary calibration windows reaches. A text's figures
(bytes saved a window, the most, the three highest, hits and their share, windows) go into a logistic regression, fitted on
calibration texts that no dictionary has seen and weighed to the labels' own share of 1: score is its probability.

Labels are learned from a bounded sample of labelled rows whose crc32(doc_id as text) modulo `FOLDS` is not 0: at most `ROWS` of
each label, chosen by the hash of doc_id, of which a third calibrate and the others give at most `PIECES` pieces of `PIECE` characters for each
label to one training task. Labels never score a row, nor do lang, source and doc_id. All rows' whole texts are scored in
one scan with the broadcast dictionaries, which have a fixed size.

A null or empty text counts as one window that saves nothing. A very long text is compressed some windows at a time; only their
savings are kept. Rows that repeat are scored alike. A row without doc_id is scored, and is not held out. A doc_id with both
labels has label 1. Where one of the labels is missing from the sample, every score is the share of label 1 (0 without
labels). Empty tables give an empty result. Further columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.llm.common import documents, materialise, small_batches

WINDOW, STEP = 64, 48
LEVEL = 5
ORDINARY_BYTES, TOXIC_BYTES = 8192, 2048
#: Bytes of the n-grams that tell toxic from ordinary text, and of what stands on each side of them as context.
GRAM, CONTEXT = 5, 8
RATIO = 15
#: Contexts of toxic text that an n-gram must stand in: so many, and this share of the toxic pieces.
SUPPORT, SUPPORT_SHARE = 4, 0.01
FALSE_HITS = 0.002
FOLDS = 5
ROWS = 9000
PIECE, PIECES = 2000, 6000
#: Windows compressed in one call.
CALL = 100_000
RIDGE = 1.0

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def folded(text: bytes) -> bytes:
    return text.translate(_FOLD)


class Savings:
    """Compresses windows with both dictionaries."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        size = len(ordinary) + len(toxic)

        def compressor(content: bytes) -> zstandard.ZstdCompressor:
            plain = {"write_content_size": False, "write_dict_id": False, "write_checksum": False, "format": zstandard.FORMAT_ZSTD1_MAGICLESS}
            how = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=WINDOW, dict_size=size, min_match=4, **plain)
            return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how)

        self.both = compressor(ordinary), compressor(toxic + ordinary)

    def __call__(self, text: bytes) -> np.ndarray:
        """The bytes that the toxic dictionary saves in each window of a text."""
        if not text:
            return np.zeros(1, np.int64)
        text = b" " + folded(text) + b" "
        starts = np.arange(0, max(1, len(text) - WINDOW + STEP), STEP, dtype=np.uint64)
        cuts = np.stack([starts, np.minimum(WINDOW, len(text) - starts.astype(np.int64)).astype(np.uint64)], axis=1)
        saved = []
        for at in range(0, len(cuts), CALL):
            windows = zstandard.BufferWithSegments(text, cuts[at : at + CALL].tobytes())
            sizes = [np.fromiter(map(len, c.multi_compress_to_buffer(windows)), np.int64, len(windows)) for c in self.both]
            saved.append(sizes[0] - sizes[1])
        return np.concatenate(saved)


def figures(saved: np.ndarray, threshold: int) -> list[float]:
    mean, top = float(np.maximum(saved, 0).mean()), np.sort(saved)[-3:]
    hits = int((saved >= threshold).sum())
    share = hits / len(saved)
    return [mean, float(top[-1]), float(top.mean()), share, math.log1p(hits), math.log(len(saved)), math.log(mean + 0.01), math.log(share + 0.003)]


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    threshold: int
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def score(self, saved: np.ndarray) -> float:
        z = self.weights[0] + float(((np.array(figures(saved, self.threshold)) - self.centre) / self.scale) @ self.weights[1:])
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def contexts(texts: list[bytes], n: int = GRAM, around: int = CONTEXT) -> tuple[np.ndarray, np.ndarray]:
    """The texts' n-grams of bytes, and in how many different contexts each stands."""
    found = []
    for t in texts:
        grams = codes(t, n)
        if len(grams):
            padded = np.frombuffer(b" " * around + t + b" " * around, np.uint8).astype(np.uint64)
            h = np.zeros(len(grams), np.uint64)
            for k in [*range(around), *range(around + n, 2 * around + n)]:
                h = h * np.uint64(0x9E3779B97F4A7C15) + padded[k : k + len(grams)]
            found.append(np.unique((grams << np.uint64(24)) | (h * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(40))))
    both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
    return np.unique(both >> np.uint64(24), return_counts=True)


def codes(text: bytes, n: int = GRAM) -> np.ndarray:
    """A number for the n-gram (n at most 5) at each place."""
    b = np.frombuffer(text, np.uint8).astype(np.uint64)
    out = np.zeros(max(0, len(b) - n + 1), np.uint64)
    for k in range(n):
        out = (out << np.uint64(8)) | b[k : k + len(out)]
    return out


def telling(ordinary: list[bytes], toxic: list[bytes]) -> np.ndarray:
    """The n-grams that tell toxic text, sorted."""
    grams, here = contexts(toxic)
    others, there = contexts(ordinary)
    at = np.minimum(np.searchsorted(others, grams), max(0, len(others) - 1))
    known = np.where(others[at] == grams, there[at], 0) if len(others) else np.zeros(len(grams), np.int64)
    enough = here >= max(SUPPORT, math.ceil(SUPPORT_SHARE * len(toxic)))
    return grams[enough & (here / max(1, len(toxic)) >= RATIO * (known + 1) / max(1, len(ordinary)))]


def parts(text: bytes, grams: np.ndarray) -> list[bytes]:
    """The runs of a text that these n-grams cover."""
    hit = np.isin(codes(text), grams)
    if not hit.any():
        return []
    covered = np.zeros(len(text) + 2, np.int8)
    for k in range(GRAM):
        covered[k + 1 : k + 1 + len(hit)] |= hit
    edge = np.flatnonzero(np.diff(covered))
    return [text[a:b] for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]


def trained(samples: list[bytes], size: int, **how: int) -> bytes:
    """A dictionary's bytes; of samples too few to train on, the samples themselves."""
    samples = [s for s in samples if len(s) >= 8]
    try:
        return zstandard.train_dictionary(size, samples, **how).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(dict.fromkeys(samples))[-size:]


def dictionaries(ordinary: list[bytes], toxic: list[bytes]) -> tuple[bytes, bytes]:
    ordinary, toxic = ([b" " + folded(t) + b" " for t in texts] for texts in (ordinary, toxic))
    grams = telling(ordinary, toxic)
    plain = trained([t[k : k + WINDOW] for t in ordinary for k in range(0, len(t), STEP)], ORDINARY_BYTES)
    return plain, trained([b"\0".join(p) for t in toxic if (p := parts(t, grams))], TOXIC_BYTES, k=32, d=6)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    z, w = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
    pull = np.array([1e-6, *[ridge] * x.shape[1]])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(pull), z.T @ (weight * (p - y)) + pull * w)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def held_out(doc_id: Column = None) -> Column:
    return F.coalesce(F.crc32((F.col("doc_id") if doc_id is None else doc_id).cast("string")) % FOLDS == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> tuple[DataFrame, float]:
    """doc_id, text, label and calibrate of at most `rows` rows of each label outside the held-out fold; and the share of label 1 there."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    known = materialise(known.where(~held_out()).withColumn("h", F.xxhash64("doc_id")), "labels")
    n = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    most = lambda df: df.where("label = 0").orderBy("h", "doc_id").limit(rows).union(df.where("label = 1").orderBy("h", "doc_id").limit(rows))
    chosen = F.broadcast(materialise(most(known), "labels").withColumn("calibrate", F.pmod("h", F.lit(3)) == 0))  # two times rows at most
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(chosen, "doc_id").dropDuplicates(["doc_id", "text"])
    return materialise(most(texts), "sample"), n.get(1, 0) / max(1, sum(n.values()))


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Model:
    """The dictionaries and the calibrated regression, from a bounded sample of the labelled rows."""
    spark = docs.sparkSession
    small_batches(spark)
    some, prior = sample(docs, labels, rows)
    cut = F.expr(f"transform(sequence(0, cast((length(text) - 1) div {PIECE} as int)), k -> substring(text, k * {PIECE} + 1, {PIECE}))")
    pieces = some.where("not calibrate and text <> ''").select("label", F.explode(cut).alias("piece")).withColumn("h", F.xxhash64("piece"))
    few = lambda label: pieces.where(F.col("label") == label).orderBy("h", "piece").limit(PIECES)

    def train(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts: list[list[bytes]] = [[], []]
        for f in frames:
            for label, piece in zip(f["label"], f["piece"], strict=True):
                texts[label].append(piece.encode())
        if all(texts):
            plain, toxic = dictionaries(*map(sorted, texts))
            yield pd.DataFrame({"ordinary": [plain], "toxic": [toxic]})

    bounded_pieces = few(0).union(few(1)).select("label", "piece").coalesce(1)  # at most two times PIECES
    got = bounded_pieces.mapInPandas(train, "ordinary binary, toxic binary").first()
    none = np.zeros(len(figures(np.zeros(1), 1)))
    constant = Model(b"", b"", 1, none, none + 1, np.array([math.log(max(prior, 1e-9) / max(1 - prior, 1e-9)), *none]), prior)
    if got is None:
        return constant
    ordinary, toxic = bytes(got["ordinary"]), bytes(got["toxic"])
    shared = spark.sparkContext.broadcast((ordinary, toxic))

    def saved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = Savings(*shared.value)
        for b in batches:
            texts = [both(t.as_py()) for t in b.column(1).cast(pa.binary())]
            counts = [np.bincount(np.clip(x, 0, WINDOW), minlength=WINDOW + 1).tolist() for x in texts]  # windows by bytes saved: of one size for any text
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.list_(pa.int64()))], names=["label", "saved"])

    seen = materialise(some.where("calibrate").select("label", "text").mapInArrow(saved, "label int, saved array<bigint>"), "calibration")
    held = seen.toPandas()  # at most two times `rows`, of WINDOW + 1 numbers each
    y = held["label"].to_numpy(float)
    if not 0 < y.sum() < len(y):
        return constant
    counts = np.array(held["saved"].tolist(), np.int64)
    plain = counts[y == 0].sum(axis=0)
    reach = np.cumsum(plain[::-1])[::-1] / plain.sum()
    threshold = max(1, int(np.argmax(reach <= FALSE_HITS)) if (reach <= FALSE_HITS).any() else WINDOW)
    order = np.lexsort((*counts.T, y))  # rows come in no fixed order
    x, y = np.array([figures(np.repeat(np.arange(WINDOW + 1), c), threshold) for c in counts[order]]), y[order]
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    share = y.mean()
    weight = np.where(y == 1, prior / share, (1 - prior) / (1 - share))
    return Model(ordinary, toxic, threshold, centre, scale, logistic((x - centre) / scale, y, weight), prior)


def scored(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """keep and score of each row's whole text."""
    spark = docs.sparkSession
    small_batches(spark)
    shared, keep = spark.sparkContext.broadcast(model), keep or ("doc_id",)
    own = docs.select(*keep)
    kept = [f"keep_{k}" for k in range(len(keep))]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        both = Savings(m.ordinary, m.toxic) if m.ordinary or m.toxic else lambda text: np.zeros(1, np.int64)
        for b in batches:
            scores = [m.score(np.clip(both(t.as_py() or b""), 0, WINDOW)) for t in b.column(len(kept)).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(scores, pa.float64())], names=[*kept, "score"])

    schema = ", ".join(f"{k} {f.dataType.simpleString()}" for k, f in zip(kept, own.schema.fields, strict=True))
    given = docs.select(*[F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)], F.col("text").alias("body"))
    out = given.mapInArrow(score, f"{schema}, score double")
    return out.select(*[F.col(k).alias(c) for c, k in zip(keep, kept, strict=True)], F.round("score", 8).alias("score"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    return scored(docs, model, "doc_id").select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
