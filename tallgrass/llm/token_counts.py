"""Token counts by section, from one encoding of the whole document.

A document is encoded once, as a whole: encoding its sections apart would give other tokens. Each token's byte span comes
from the lengths of its vocabulary entry, its character span from there (a token that covers part of a character spans
that character). Token spans and section spans, both in order, are joined as intervals. A token within one section counts
there; a token that crosses a boundary counts for the section that holds most of its characters, of equal shares for the
earlier one. The counts of a document's sections come to its tokens.

`line_counts` takes lines as sections (the newline belongs to the line that it ends; an empty last line is a section),
`field_counts` the fields of a row, joined by newlines.

A null text is an empty one: one empty section, no tokens; null fields are empty. A very long text is encoded whole, one row by itself in an Arrow
batch, in memory of a few times its size. Rows are independent: repeated rows
repeat, a null doc_id stays, empty tables give empty results, and further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.llm.common import documents, small_batches
from tallgrass.llm.tokens import encoder, tokenizer_path

RESULT = ", n_tokens long, n_sections long, n_crossing long, section_tokens array<long>"


def token_spans(text: bytes, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and end of each token."""
    ends = np.cumsum(lengths[ids])
    begun = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))  # characters begun before a byte
    return begun[np.minimum(ends - lengths[ids] + 1, len(text))] - 1, begun[ends]


def attributed(first: np.ndarray, end: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, int]:
    """Tokens of each section, which begin at the characters `starts`, and how many cross a boundary."""
    section = np.searchsorted(starts, first, side="right") - 1
    last = np.searchsorted(starts, end - 1, side="right") - 1
    crossing = np.flatnonzero(last > section)
    for k in crossing:
        edges = np.concatenate(([first[k]], starts[section[k] + 1 : last[k] + 1], [end[k]]))
        section[k] += int(np.argmax(np.diff(edges)))  # the first of the largest
    return np.bincount(section, minlength=len(starts)), len(crossing)


def section_counts(rows: DataFrame, key: str, text: Column, lengths: Column | None = None, tokenizer: str | None = None) -> DataFrame:
    """key, n_tokens, n_sections, n_crossing, section_tokens. lengths: the characters of each section; lines where None."""
    small_batches(rows.sparkSession)
    path = tokenizer or tokenizer_path()
    df = rows.select(F.col(key), F.coalesce(text, F.lit("")).alias("body"), *([lengths.alias("lengths")] if lengths is not None else []))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        size = coder.byte_lengths
        for b in batches:
            texts, totals, sections, crossings, counts = b.column(1).to_pylist(), [], [], [], []
            cuts = b.column(2).to_pylist() if b.num_columns > 2 else [None] * len(texts)
            for t, cut in zip(texts, cuts, strict=True):
                raw, ids = t.encode(), np.frombuffer(coder.encode([t])[0], np.uint32)
                if cut is None:
                    cut = [len(x) + 1 for x in t.split("\n")]
                starts = np.cumsum(cut) - cut
                got, crossing = attributed(*token_spans(raw, ids, size), starts) if len(ids) else (np.zeros(len(starts), np.int64), 0)
                totals.append(len(ids))
                sections.append(len(starts))
                crossings.append(crossing)
                counts.append(got)
            ends = np.concatenate(([0], np.cumsum(sections))).astype(np.int32)
            each = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64), pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (totals, sections, crossings)), each], names=[key, "n_tokens", "n_sections", "n_crossing", "section_tokens"])

    return df.mapInArrow(counted, f"`{key}` {df.schema[key].dataType.simpleString()}{RESULT}")


def line_counts(docs: DataFrame, key: str = "doc_id", tokenizer: str | None = None) -> DataFrame:
    return section_counts(docs, key, F.col("text"), None, tokenizer)


def field_counts(rows: DataFrame, key: str, fields: list[str], tokenizer: str | None = None) -> DataFrame:
    """Sections are the fields, in order; each but the last takes the newline that follows it."""
    parts = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    lengths = [F.length(p) + F.lit(int(k + 1 < len(parts))) for k, p in enumerate(parts)]
    return section_counts(rows, key, F.concat_ws("\n", *parts), F.array(*[x.cast("long") for x in lengths]), tokenizer)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_counts(documents(spark, sf_dir, "doc_id", "text"))
