"""Quality rules: robust multivariate outliers by the minimum covariance determinant, for each language and source.

Base rules come first: a document fails with fewer than `MIN_WORDS` words, or if over half of its words stand in 3-word
windows found twice or more. The others are judged by a vector of four transformed statistics, each on a fixed grid:

    log2 of characters a word; log2(1 + 256 x symbols per character); square roots of the shares of repeated lines and words.

For each (lang, source) the MCD finds the mean and covariance of those `SHARE` of its documents whose covariance has the
smallest determinant (concentration steps from fixed starts, then one reweighting step). An estimate from few documents
says little, so that each is drawn towards that of its language, as if `PRIOR` documents of the language stood beside its
own, and each language's in the same way towards that of all documents. There is no size at which this sets in or ends;
every document is judged by the same formula. Documents beyond the `CUTOFF` quantile of chi-square are rejected. `SCALE`
adds a floor to each variance, since most documents share the same value of some statistics: about 3 % of symbols, or half
of the lines repeated, are too far from a source that has none.

A group's documents are counted by grid cell before anything is shuffled, so that its fit reads at most the grid's cells
(about 5 million by the statistics' ranges, some hundreds in practice) whatever the group's size, and every document
counts. The fit is exact for the gridded vectors: a cell on the border of the chosen share counts in part. Statistics are
not clipped.

Null and empty texts have no words and fail. A very long text is measured whole, in memory of a few times its size. A null
lang or source is a group like any other. Repeated rows count as often as they occur. Empty tables give an empty result.
Further columns are not read by `judged` and are kept by `without_outliers`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

from tallgrass.llm.common import documents, fresh, materialise, row_digest, small_batches

MIN_WORDS = 50
#: Documents of the wider group that stand beside a group's own in its estimate.
PRIOR = 100
SHARE = 0.75
CUTOFF = 0.9999
#: By statistic: grid step, and the standard deviation added in quadrature.
STEP = np.array([0.125, 0.25, 1 / 32, 1 / 32])
SCALE = np.array([0.25, 0.6, 0.15, 0.15])
#: Random starts of the concentration steps, besides three robust ones.
STARTS = 8
CELL = ("q0", "q1", "q2", "q3")
COUNTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_SYMBOLS = b"#*$%&|<>"
_CONTINUED = bytes(range(0x80, 0xC0))
_SPACES = b" \t\n\r\x0b\x0c"


def measured(text: bytes) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text, and its lines with a word."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip(_SPACES)]
    chars = len(text.translate(None, _SPACES + _CONTINUED))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    return len(words), chars, symbols, len(lines) - len(set(lines)), _repeated(words), len(lines)


def _repeated(words: list[bytes]) -> int:
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    pair = ids[:-1] * len(number) + ids[1:]
    if len(number) > 1 << 20:  # numbers of pairs, so that three words fit 64 bits
        pair = np.unique(pair, return_inverse=True)[1]
    triple = pair[:-1] * len(number) + ids[2:]
    order = np.argsort(triple, kind="stable")
    same = triple[order][1:] == triple[order][:-1]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[k : n - 2 + k] |= twice
    return int(hit.sum())


def cells(counts: np.ndarray) -> np.ndarray:
    """Grid cells of rows of what `measured` gives."""
    words, chars, symbols, dup, repeat, lines = counts.astype(float).T
    n, c = np.maximum(words, 1), np.maximum(chars, 1)
    stats = np.stack([np.log2(c / n), np.log2(1 + 256 * symbols / c), np.sqrt(dup / np.maximum(lines, 1)), np.sqrt(repeat / n)], axis=1)
    return np.floor(stats / STEP).astype(np.int32)


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep`, the counts, base_failed and the grid cell of each document."""
    small_batches(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.array([measured(t.as_py() or b"") for t in b.column(0).cast(pa.binary())], np.int64).reshape(-1, len(COUNTED) + 1)
            failed = (rows[:, 0] < MIN_WORDS) | (100 * rows[:, 4] > 50 * rows[:, 0])
            cols = [*b.columns[1:], *(pa.array(c) for c in rows.T[: len(COUNTED)]), pa.array(failed), *(pa.array(c) for c in cells(rows).T)]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, *COUNTED, "base_failed", *CELL])

    schema = StructType([docs.schema[c] for c in keep] + [StructField(c, LongType()) for c in COUNTED] + [StructField("base_failed", BooleanType())] + [StructField(c, IntegerType()) for c in CELL])
    return docs.select("text", *keep).mapInArrow(counted, schema)


def chi2_cdf(x: float, df: int) -> float:
    """For even degrees of freedom."""
    term, total = 1.0, 1.0
    for k in range(1, df // 2):
        term *= x / 2 / k
        total += term
    return 1 - math.exp(-x / 2) * total


def chi2_quantile(p: float, df: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, df) < p else (lo, mid)
    return hi


def _consistent(share: float, d: int) -> float:
    return share / chi2_cdf(chi2_quantile(share, d), d + 2)


def _moments(x: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mean = w @ x / w.sum()
    z = x - mean
    return mean, (z * w[:, None]).T @ z / w.sum()


def _distances(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    z = x - mean
    return np.einsum("ij,ij->i", z @ np.linalg.inv(cov), z)


def _weighted_median(x: np.ndarray, w: np.ndarray) -> float:
    o = np.argsort(x, kind="stable")
    return float(x[o][np.searchsorted(np.cumsum(w[o]), w.sum() / 2)])


def concentrated(x: np.ndarray, w: np.ndarray, floor: np.ndarray, share: float = SHARE, starts: int = STARTS) -> tuple[float, np.ndarray, np.ndarray]:
    """Determinant, mean and covariance (made consistent, with the floor variances) of the share of weighted rows whose determinant is smallest."""
    d, want = x.shape[1], math.ceil(share * w.sum())
    ridge = np.diag(floor**2)
    middle = np.array([_weighted_median(c, w) for c in x.T])
    spread = np.array([1.4826 * _weighted_median(np.abs(c - m), w) for c, m in zip(x.T, middle, strict=True)])
    whole, cov = _moments(x, w)
    unit = (x - middle) / np.hypot(spread, floor)
    length = np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-9)
    _, signs = _moments(unit / np.maximum(length, 1), w)
    first = [((x - middle) ** 2 / (spread**2 + floor**2)).sum(axis=1), _distances(x, whole, cov + ridge), _distances(unit, np.zeros(d), signs + np.eye(d) * 1e-2)]
    rng = np.random.default_rng(0)
    for _ in range(starts if len(x) > d else 0):
        few = x[rng.choice(len(x), d + 1, replace=False, p=w / w.sum())]
        first.append(_distances(x, few.mean(axis=0), np.cov(few.T, bias=True) + ridge))
    best: tuple | None = None
    for dist in first:
        last: tuple = (math.inf, None, None)
        for _ in range(100):
            order = np.argsort(dist, kind="stable")
            part = np.clip(want - (np.cumsum(w[order]) - w[order]), 0, w[order])
            mean, cov = _moments(x[order], part)
            cov = _consistent(share, d) * cov + ridge
            det = float(np.linalg.det(cov))
            if det >= last[0] * (1 - 1e-9):
                break
            last, dist = (det, mean, cov), _distances(x, mean, cov)
        if best is None or last[0] < best[0]:
            best = last
    return best


def mcd(x: np.ndarray, w: np.ndarray, floor: np.ndarray, share: float = SHARE) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance (with the floor variances) of weighted rows by the MCD and one reweighting step."""
    d = x.shape[1]
    _, mean, cov = concentrated(x, w, floor, share)
    inner = w * (_distances(x, mean, cov) <= chi2_quantile(0.975, d))
    if inner.sum() < math.ceil(share * w.sum()) / 2:
        return mean, cov
    mean, cov = _moments(x, inner)
    return mean, _consistent(0.975, d) * cov + np.diag(floor**2)


def estimates(stats: DataFrame) -> DataFrame:
    """lang, source, mean and inverse (row by row): by what each group's documents are judged."""
    import pandas as pd

    group = ("lang", "source")
    counted = stats.where(~F.col("base_failed")).groupBy(*group, *CELL).agg(F.count("*").alias("n"))
    counted = materialise(counted, "cells")
    none = [F.lit(None).cast(stats.schema[c].dataType).alias(c) for c in group]
    pools = [("lang", "source"), ("lang", none[1]), (none[0], none[1])]
    of = F.array(*[F.struct(F.lit(k).alias("level"), *[F.col(c) if isinstance(c, str) else c for c in x]) for k, x in enumerate(pools)])
    pooled = counted.select(F.explode(of).alias("p"), *CELL, "n").groupBy("p.level", "p.lang", "p.source", *CELL).agg(F.sum("n").alias("n"))

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(CELL))
        w = pdf["n"].to_numpy(float)
        mean, cov = mcd((pdf[list(CELL)].to_numpy(float) + 0.5) * STEP, w, SCALE)
        return pdf.iloc[:1][["level", *group]].assign(w=w.sum(), mean=[mean.tolist()], cov=[cov.ravel().tolist()])

    numbers = [StructField("mean", ArrayType(DoubleType())), StructField("cov", ArrayType(DoubleType()))]
    schema = StructType([StructField("level", IntegerType()), *[stats.schema[c] for c in group], StructField("w", DoubleType()), *numbers])
    fits = materialise(pooled.groupBy("level", *group).applyInPandas(fitted, schema), "fits")
    top = fits.where("level = 2").select("mean", "cov").first()  # one row of 20 numbers, none where no document is left
    if top is None:
        top = {"mean": [0.0] * len(STEP), "cov": np.eye(len(STEP)).ravel().tolist()}
    whole = (np.array(top["mean"]), np.array(top["cov"]))
    wide = fits.where("level = 1").select(F.col("lang").alias("w_lang"), F.col("w").alias("w_w"), F.col("mean").alias("w_mean"), F.col("cov").alias("w_cov"))
    rows = fits.where("level = 0").drop("level").join(wide, F.col("lang").eqNullSafe(F.col("w_lang"))).drop("w_lang")

    def drawn(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mixed = lambda n, own, prior: (n * np.array(own) + PRIOR * prior) / (n + PRIOR)
        for pdf in pdfs:
            mean, inverse = [], []
            for r in pdf.itertuples():
                at = mixed(r.w, r.mean, mixed(r.w_w, r.w_mean, whole[0]))
                cov = mixed(r.w, r.cov, mixed(r.w_w, r.w_cov, whole[1]))
                mean.append(at.tolist())
                inverse.append(np.linalg.inv(cov.reshape(len(STEP), -1)).ravel().tolist())
            yield pdf[list(group)].assign(mean=mean, inverse=inverse)

    arrays = [StructField("mean", ArrayType(DoubleType())), StructField("inverse", ArrayType(DoubleType()))]
    return rows.mapInPandas(drawn, StructType([*[stats.schema[c] for c in group], *arrays]))


def judged(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep`, the counts, base_failed and kept, a row for each of docs (text, lang, source and keep)."""
    wanted = list(dict.fromkeys(["lang", "source", *keep]))
    stats = materialise(statistics(docs, *wanted), "statistics")
    e = materialise(estimates(stats), "estimates").select(F.col("lang").alias("e_lang"), F.col("source").alias("e_source"), F.col("mean").alias("e_mean"), F.col("inverse").alias("e_inverse"))
    z = [(F.col(c) + F.lit(0.5)) * F.lit(float(step)) - F.col("e_mean")[k] for k, (c, step) in enumerate(zip(CELL, STEP, strict=True))]
    distance = sum((z[i] * z[j] * F.col("e_inverse")[i * len(z) + j] for i in range(len(z)) for j in range(len(z))), F.lit(0.0))
    kept = ~F.col("base_failed") & (distance <= F.lit(chi2_quantile(CUTOFF, len(STEP))))
    on = [F.col(c).eqNullSafe(F.col(f"e_{c}")) for c in ("lang", "source")]
    return stats.join(e, on, "left").select(*keep, *COUNTED, "base_failed", F.coalesce(kept, F.lit(False)).alias("kept"))


def without_outliers(docs: DataFrame) -> DataFrame:
    """docs without the documents rejected; the others stay as they are."""
    number, digest = fresh(docs, "key_number"), fresh(docs, "key_digest")
    marked = docs.withColumns({number: F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")), digest: row_digest("doc_id", "text", "lang", "source")})
    gone = judged(marked, number, digest).where(~F.col("kept")).select(number, digest).distinct()
    return marked.join(gone, [number, digest], "left_anti").select(*docs.columns)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(documents(spark, sf_dir, "doc_id", "text", "lang", "source"), "doc_id")
