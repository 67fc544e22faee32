"""Token ids of texts by a public byte-level BPE file."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import numpy as np

# White space by every definition of it, and all that some definition counts as white space.
SPACE = " \t\n\r\x0b\x0c"
DOUBTFUL = "\x1c-\x1f\x85\xa0 ᠎ -​    ⁠　﻿"
#: A word of letters with the blank before it, where no other letter or mark can follow; else white space and what follows
#: it up to the next. No pre-token of the byte-level rule goes on over the ends of these, so the ids of a text are those of
#: its words, one after another: letters end a pre-token at any ASCII character but a letter, as does all else at white space.
WORD = re.compile(f" ?[A-Za-zÀ-ÖØ-öø-ſ]++(?![^\x00-\x7f])|[{SPACE}]*[^{SPACE}]+(?:(?<=[{DOUBTFUL}])[{SPACE}]+[^{SPACE}]*)*|[{SPACE}]+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def words(text: str, span: int) -> Iterator[list[str]]:
    """All words of a text in order, a list for each `span` characters or so."""
    at, n, wide = 0, len(text), span
    while at < n:
        found = WORD.findall(text, at, at + wide)
        if at + wide < n:
            found.pop()  # it may go on
        if not found:
            wide *= 2
            continue
        yield found
        at, wide = at + sum(map(len, found)), span


class Encoder:
    """Ids as `tokenizers` gives them for the file at path, special tokens' strings being ordinary text.

    Each distinct word of a run of texts goes through the tokenizer once; up to `keep` words of up to 64 characters are
    remembered by a worker. Memory is bounded by a run of texts, by the longest word and by a text's ids."""

    def __init__(self, path: str, keep: int = 300_000, span: int = 1 << 22):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.known: dict[str, bytes] = {}
        self.keep, self.span = keep, span

    def encode(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        lists: list[list[str]] = []
        held = 0
        for t in texts:
            if len(t) > self.span:
                yield from self._joined(lists)
                lists, held = [], 0
                yield np.frombuffer(b"".join(self._bytes([x])[0] for x in words(t, self.span)), "<u4")
                continue
            lists.append(WORD.findall(t))
            held += len(t)
            if held >= self.span:
                yield from self._joined(lists)
                lists, held = [], 0
        yield from self._joined(lists)

    def _bytes(self, lists: list[list[str]]) -> list[bytes]:
        known = self.known
        new = list(set().union(*lists).difference(known))
        coded = self.tokenizer.encode_batch_fast(new, add_special_tokens=False)
        known.update(zip(new, [np.array(e.ids, "<u4").tobytes() for e in coded], strict=True))
        out = [b"".join([*map(known.__getitem__, x)]) for x in lists]
        room = self.keep - (len(known) - len(new))
        for i, w in enumerate(new):
            if i >= room or len(w) > 64:
                del known[w]
        return out

    def _joined(self, lists: list[list[str]]) -> Iterator[np.ndarray]:
        return (np.frombuffer(b, "<u4") for b in self._bytes(lists))

    def ids(self, text: str) -> list[int]:
        return next(self.encode([text])).tolist()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for a worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
