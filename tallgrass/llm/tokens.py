"""Whole texts to token ids with the tokenizers library, each frequent piece encoded by it once per worker process.

Byte-level BPE splits a text into pre-tokens and encodes each by itself. Before a single space between two characters
that are not white space there is always such a split, and on both sides of a single newline between two such
characters. Texts are cut there, and the library's ids of each piece are kept in a bounded memo of two generations: when
the newer is full it becomes the older, and what is asked for again comes back from there, so that frequent pieces stay
(a piece of letters alone is one pre-token and goes straight to the library's model; ASCII marks after a letter or digit,
before white space, are one pre-token too). `encoder` keeps one encoder per tokenizer in a worker process, for all of its
tasks. A text with any other white space pattern (runs, tabs, white space at an end) or a special
token's string is encoded whole by the library, or, when long, in pieces cut at such single spaces only. Ids are the same
as those of encoding the whole text, which the tests assert.
"""

from __future__ import annotations

import re
from array import array
from functools import cache, cached_property

import numpy as np

#: Entries of each of the memo's two generations, about 200 bytes each.
MEMO = 300_000
#: Longer pieces are not kept.
PIECE = 48
#: Texts longer than this are cut, where a single space parts two words, before the library encodes them.
LONG = 1 << 16

_CUT = re.compile(r"(?<=[0-9A-Za-z]) (?=[0-9A-Za-z])")
#: Characters that some versions of Unicode count as white space.
_DOUBTFUL = frozenset("\u180e\u200b\u200c\u200d\u2060\ufeff")


#: ASCII marks: none of them is a letter, a digit or white space.
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Characters below this are letters, or not, in every version of Unicode.
_PLAIN = "\u0250"


def _visible() -> dict[int, str]:
    """Byte-level vocabularies write the printable bytes as themselves and the others, in order, from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


_VISIBLE = _visible()
_SPACE = _VISIBLE[32]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _solid(c: str) -> bool:
    return not c.isspace() and c not in _DOUBTFUL


class Encoder:
    def __init__(self, path: str, memo: int = MEMO):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.special = self.tokenizer.model, [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.limit, self.memo, self.older = memo, {}, {}
        self.newline, self.marks = self.library(["\n"])[0], {}

    def library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint32).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def whole(self, text: str) -> bytes:
        """A text with white space of any kind."""
        pieces, last = [], 0
        while len(text) - last > LONG and (m := _CUT.search(text, last + LONG)):
            pieces.append(text[last : m.start()])
            last = m.start()
        return b"".join(x for p in [*pieces, text[last:]] for x in self.library([p]))

    def word(self, text: str) -> bytes:
        """The ids of one pre-token: letters, with a space before them or not."""
        raw = text if text.isascii() else text.encode().decode("latin-1").translate(_VISIBLE)
        return array("I", [t.id for t in self.model.tokenize(raw.replace(" ", _SPACE))]).tobytes()

    def learn(self, p: str) -> bytes | None:
        """The ids of a part that the newer memo lacks; None for one whose neighbourhood is irregular."""
        ids = self.older.get(p) or self._made(p)
        if ids and len(p) <= PIECE:
            if len(self.memo) >= self.limit:
                self.older = dict(self.memo)
                self.memo.clear()  # the same object, which encode() reads
            self.memo[p] = ids
        return ids

    def _made(self, p: str) -> bytes | None:
        core = p.rstrip(_MARKS)
        if core != p and core[-1:].isalnum():  # marks after a letter or digit and before white space are one pre-token
            ids, marks = self.memo.get(core) or self.learn(core), p[len(core) :]
            return ids and ids + (self.marks.get(marks) or self._mark(marks))
        line = p[:1] == "\n"
        body = p[1:] if line else p
        if not body or not _solid(body[0]) or not _solid(body[-1]):
            return None
        if body.isalpha() and (body.isascii() or max(body) < _PLAIN):
            return self.newline + self.word(body) if line else self.word(f" {body}")
        return self.library([p if line else f" {p}"])[0]

    def _mark(self, marks: str) -> bytes:
        ids = self.library([marks])[0]
        if len(marks) <= 8:
            if len(self.marks) >= 10_000:
                self.marks.clear()
            self.marks[marks] = ids
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out, get, learn = [], self.memo.get, self.learn
        for t in texts:
            parts = t.replace("\n", " \n").split(" ")
            head = parts[0]
            if not t:
                out.append(b"")
            elif not (head and _solid(head[0]) and _solid(head[-1])) or any(x in t for x in self.special):
                out.append(self.whole(t))
            else:
                ids = [get(p) or learn(p) for p in parts]
                if None in ids:
                    out.append(self.whole(t))
                else:
                    ids[0] = self.word(head) if head.isalpha() and max(head) < _PLAIN else self.library([head])[0]
                    out.append(b"".join(ids))
        return out

    @cached_property
    def byte_lengths(self) -> np.ndarray:
        """By id, how many bytes of text a token covers: byte-level vocabularies write each byte as one character."""
        out = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            out[i] = len(token)
        for i, token in self.tokenizer.get_added_tokens_decoder().items():
            out[i] = len(token.content.encode())
        return out


@cache
def encoder(path: str) -> Encoder:
    """This process's encoder for the tokenizer at path: Python workers outlive tasks, and so does the memo."""
    return Encoder(path)
