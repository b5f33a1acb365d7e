import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallgrass.llm import simple8b, token_counts, token_files
from tallgrass.llm.tokens import Encoder, tokenizer_path
from tests.llm import brute

ODD = ["a  b", " lead", "trail ", "a\n\nb", "x\t y", "it's  ok\n", "", "\n", " ", "a  b", "<|endoftext|> x y", "a <|endoftext|>b", "don't 'll we've\nit's", "a \nb", "a\n b", "word　word x", "x., y,. z...", "a,\nb.\n", "été, ça.\nÀ", "1,2.3 4, 5.", "日本 語, 문\nx", "Ⅷ ½ ²", ", x", ".", "a\x85b c", "a​ b"]


@pytest.fixture(scope="module")
def coder():
    return Encoder(tokenizer_path())


def test_memo_gives_the_librarys_ids(coder):
    assert coder.encode(ODD) == coder.library(ODD)
    assert coder.encode(ODD[::-1]) == coder.library(ODD[::-1])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab,. \n'sé1$<|\t—", max_size=30), max_size=5))
def test_memo_on_any_text(coder, texts):
    assert coder.encode(texts) == coder.library(texts)


def test_long_texts_and_a_full_memo():
    small = Encoder(tokenizer_path(), memo=3)
    big = "ab c\n" * 20000 + "  " + "xy z " * 40000
    texts = [big, "one two three four, five. six seven", "two three"]
    assert small.encode(texts) == small.library(texts)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1300), st.integers(0, 64)), max_size=5), st.integers(0, 2**32))
def test_simple8b_round_trip(shape, seed):
    rng = np.random.default_rng(seed)
    sizes = np.array([n for n, _ in shape], np.int64)
    ids = np.concatenate([np.zeros(0, np.uint64), *[(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)) >> np.uint64(b) if b < 64 else np.zeros(n, np.uint64) for n, b in shape]])
    words, by_doc, offsets, blocks = simple8b.encode(ids, sizes)
    assert by_doc.sum() == len(words) and blocks.sum() == len(offsets)
    assert (simple8b.decode(words, by_doc, offsets, sizes) == ids).all()


def test_simple8b_packs_and_escapes():
    words, *_ = simple8b.encode(np.array([1 << 63], np.uint64), np.array([1]))
    assert len(words) == 2 and int(words[0]) >> 60 == simple8b.ESCAPE and words[1] == 1 << 63
    words, *_ = simple8b.encode(np.ones(60, np.uint64), np.array([60]))
    assert len(words) == 1 and int(words[0]) == 2 << 60 | (1 << 60) - 1


def test_files_hold_documents_in_order(spark):
    rows = [(7, "b c, d", "x"), (3, None, None), (None, "null id", "y"), (7, "another", "z"), (7, "b c, d", "x"), (1, "", ""), (9, "é\n" * 3000, "q"), (2, "  odd \t", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    path = token_files.shared_path(spark, "test-tokens")
    token_files.write_token_files(docs, path, tokenizer_path())
    got = token_files.read_token_files(spark, path, with_ids=True).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted([r[0] for r in rows], key=lambda x: (x is not None, x))
    coder, at = Encoder(tokenizer_path()), 0
    texts = {t or "" for _, t, _ in rows}
    whole = {tuple([*np.frombuffer(coder.library([t])[0], np.uint32).tolist(), 2]): t for t in texts}
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == brute.crc(r.ids) and tuple(r.ids) in whole
        at += r.n_tokens
    again = token_files.tokenised(spark, docs.repartition(3)).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.ids_crc32) for r in again] == [(r.doc_id, r.start, r.ids_crc32) for r in got]
    assert token_files.tokenised(spark, docs.limit(0)).count() == 0


def test_token_spans_are_the_librarys(coder):
    lengths = coder.byte_lengths
    for t in [*ODD, "naïve façade\nélan – 日本語 𝒳 x"]:
        e = coder.tokenizer.encode(t, add_special_tokens=False)
        first, end = token_counts.token_spans(t.encode(), np.array(e.ids, np.int64), lengths)
        assert list(zip(first.tolist(), end.tolist(), strict=True)) == e.offsets


def test_crossing_tokens_go_where_most_characters_are():
    got, crossing = token_counts.attributed(np.array([0, 2, 6, 9]), np.array([2, 6, 9, 10]), np.array([0, 3, 7, 8]))
    # [2, 6) has one character in the first section and three in the second; [6, 9) one in each of three: the earliest
    assert got.tolist() == [1, 2, 0, 1] and crossing == 2


def test_section_counts(spark, coder):
    rows = [(1, "one two\nthree", "a"), (2, None, None), (3, "", ""), (4, "a\n\n\n\nb", "c"), (None, "x", "y"), (1, "one two\nthree", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(token_counts.line_counts(df).collect(), key=str)
    assert len(got) == len(rows)
    for r in got:
        assert sum(r.section_tokens) == r.n_tokens and len(r.section_tokens) == r.n_sections
    by = {r.doc_id: r for r in got}
    assert by[1].section_tokens == [len(coder.tokenizer.encode("one two\n").ids), 1] and by[2].section_tokens == [0] and by[4].n_sections == 5
    fields = {r.doc_id: r for r in token_counts.field_counts(df, "doc_id", ["n_tokens", "text"]).collect()}
    assert fields[1].n_sections == 2 and sum(fields[1].section_tokens) == len(coder.tokenizer.encode("a\none two\nthree").ids)
    assert token_counts.line_counts(df.limit(0)).count() == 0


def plain_sections(coder, sections):
    """Tokens of each section and crossing ones, from the library's own offsets, character by character."""
    text = "".join(sections)
    owner = [k for k, x in enumerate(sections) for _ in x]
    counts, crossing = [0] * len(sections), 0
    for a, b in coder.tokenizer.encode(text, add_special_tokens=False).offsets:
        inside = owner[a:b]
        counts[max(sorted(set(inside)), key=inside.count)] += 1  # the earliest of those with most characters
        crossing += len(set(inside)) > 1
    return sum(counts), counts, crossing


def test_counts_by_brute_force(spark, coder):
    import random

    rng = random.Random(31)
    pieces = ["word", " two", "\n", "\n\n", "  ", "é", "日本", "!!!\n", "\t", "it's", " 123", "🎉", "a\nb", "<|endoftext|>"]
    texts = [None, "", *ODD, *("".join(rng.choice(pieces) for _ in range(rng.randint(1, 40))) for _ in range(40)), "long line of words " * 20_000 + "\n" + "x\n" * 5_000]
    rows = [(k, t, rng.choice(texts[:-1]), "own") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lengths string, section_tokens string")
    got = {r.doc_id: r for r in token_counts.line_counts(df).collect()}
    fields = {r.doc_id: r for r in token_counts.field_counts(df, "doc_id", ["lengths", "text"]).collect()}
    for k, t, other, _ in rows:
        lines = (t or "").split("\n")
        n, counts, crossing = plain_sections(coder, [x + "\n" * (i + 1 < len(lines)) for i, x in enumerate(lines)])
        assert (got[k].n_tokens, got[k].section_tokens, got[k].n_crossing, got[k].n_sections) == (n, counts, crossing, len(lines)), k
        n, counts, crossing = plain_sections(coder, [(other or "") + "\n", t or ""])
        assert (fields[k].n_tokens, fields[k].section_tokens, fields[k].n_crossing) == (n, counts, crossing), k
