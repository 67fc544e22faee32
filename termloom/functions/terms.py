"""Terms of whole texts and their counts, by Arrow batches: a text is analysed alone, so nothing is shuffled or joined to count it.

A slice of texts is cut, numbered and counted in numpy and Arrow at once; only its distinct terms become Python strings, and they for stems alone."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from ..config import IndexConfig
from .porter import stem
from .text import STOP_WORDS

#: Bytes of text that are analysed at once, unless a single text has more.
BYTES = 8 << 20
#: Stems that a task remembers in each of two generations.
STEMS = 300_000
_LOWER = bytes(c if chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(128)) + b" " * 128


def slices(texts) -> Iterator[tuple[int, int]]:
    """(start, stop) of runs of an Arrow array of strings with about BYTES bytes each."""
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        done = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + BYTES, side="right")))
        yield start, stop
        start = stop


def _edges(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of the terms of all texts, where each term begins among them, number of each text's terms)."""
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths)
    raw = np.frombuffer(_joined(texts, int(lengths.sum())).translate(_LOWER), np.uint8)
    at = np.flatnonzero(raw != 32)
    first = np.ones(len(at), bool)
    np.greater(at[1:] - at[:-1], 1, out=first[1:])
    heads = np.searchsorted(at, ends - lengths)
    first[heads[heads < len(at)]] = True
    begins = np.flatnonzero(first)
    return raw[at], begins, np.diff(np.searchsorted(begins, np.searchsorted(at, ends)), prepend=0)


def cut(texts):
    """(terms of all texts as an Arrow array, number of the text of each): text.tokens() of their UTF-8 bytes, those of other
    characters than ASCII letters and digits being blanks. A text without terms has one empty term, a null none."""
    import pyarrow as pa
    import pyarrow.compute as pc

    data, begins, many = _edges(texts)
    words = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(np.append(begins, len(data)).astype(np.int64)), pa.py_buffer(data))
    owner = np.repeat(np.arange(len(many)), many)
    empty = np.flatnonzero((many == 0) & pc.is_valid(texts).to_numpy(zero_copy_only=False))
    if len(empty):
        words = pa.concat_arrays([words, pa.array([""] * len(empty), pa.large_string())])
        owner = np.concatenate([owner, empty])
    return words, owner


def _joined(texts, size: int) -> bytes:
    """The bytes of all texts, one after another."""
    import pyarrow as pa

    if not size:
        return b""
    texts = texts.cast(pa.large_string()) if texts.type != pa.large_string() else texts
    if texts.null_count:
        texts = texts.drop_null()
    _, offsets, data = texts.buffers()
    edges = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return data[int(edges[0]) : int(edges[-1])].to_pybytes()


class Analyser:
    """Texts to terms by an index's rules; stems are remembered, and those of frequent terms stay so."""

    def __init__(self, config: IndexConfig):
        import pyarrow as pa

        self.stem, self.stop = config.stem, None if config.keep_stop else pa.array(STOP_WORDS, pa.large_string())
        self.known: dict[str, str] = {}
        self.before: dict[str, str] = {}

    def lengths(self, texts) -> np.ndarray:
        """Number of terms of each text of an Arrow array."""
        import pyarrow.compute as pc

        if self.stop is None:
            return np.maximum(_edges(texts)[2], pc.is_valid(texts).to_numpy(zero_copy_only=False)).astype(np.int32)
        words, owner = cut(texts)
        owner = owner[~pc.is_in(words, self.stop).to_numpy(zero_copy_only=False)]
        return np.bincount(owner, minlength=len(texts)).astype(np.int32)

    def counts(self, texts):
        """(terms, number of the text, count, number of all terms of that text) of each term of each text, by term, then text."""
        import pyarrow as pa

        names, term, text, many, n = self.numbered(texts)
        return names.take(pa.array(term)), text, many, n

    def numbered(self, texts):
        """The ascending terms, and of counts() the number of each term among them and all else."""
        import pyarrow as pa
        import pyarrow.compute as pc

        words, owner = cut(texts)
        coded = words.dictionary_encode()
        names, codes = coded.dictionary, coded.indices.to_numpy()
        if self.stop is not None:
            keep = ~pc.is_in(names, self.stop).to_numpy(zero_copy_only=False)[codes]
            codes, owner = codes[keep], owner[keep]
        lens = np.bincount(owner, minlength=len(texts)).astype(np.int32)
        if self.stem:
            coded = pa.array(self._stems(names.to_pylist()), pa.large_string()).dictionary_encode()
            names, codes = coded.dictionary, coded.indices.to_numpy()[codes]
        order = pc.sort_indices(names).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        key, many = np.unique(rank[codes] * max(1, len(texts)) + owner, return_counts=True)
        term, text = np.divmod(key, max(1, len(texts)))
        return names.take(pa.array(order)), term, text, many.astype(np.int32), lens[text]

    def _stems(self, words: list[str]) -> list[str]:
        out = []
        for word in words:
            if (s := self.known.get(word)) is None:
                if len(self.known) >= STEMS:
                    self.known, self.before = {}, self.known
                s = self.known[word] = self.before.get(word) or stem(word)
            out.append(s)
        return out


def parts_of(names, term: np.ndarray, docid: np.ndarray, edges: list[tuple[str, int]]) -> np.ndarray:
    """Number of the ascending edges (tok, docid) that are at or before each posting; the postings come by term, a number among names."""
    toks, docids = [t for t, _ in edges], np.array([d for _, d in edges], np.int64)
    value = lambda s: s.as_py()
    # Of each term, the edges of smaller terms; those of its own are told apart by docid.
    out = np.searchsorted(np.array([bisect_right(names, t, key=value) for t in toks]), np.arange(len(names)), side="right").astype(np.int32)[term]
    for t in dict.fromkeys(toks):
        i = bisect_left(names, t, key=value)
        if i < len(names) and value(names[i]) == t:
            a, b = np.searchsorted(term, [i, i + 1])
            out[a:b] += np.searchsorted(docids[bisect_left(toks, t) : bisect_right(toks, t)], docid[a:b], side="right").astype(np.int32)
    return out


def count_terms(rows: DataFrame, config: IndexConfig) -> DataFrame:
    """(tok, docid, tf, len) of each row of rows(docid, text)."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        analyse = Analyser(config)
        for b in batches:
            docids = b.column("docid")
            for start, stop in slices(b.column("text")):
                tok, text, tf, n = analyse.counts(b.column("text")[start:stop])
                columns = {"tok": tok.cast(pa.string()), "docid": docids[start:stop].take(pa.array(text)), "tf": pa.array(tf), "len": pa.array(n)}
                yield pa.RecordBatch.from_pydict(columns)

    return rows.select("docid", "text").mapInArrow(run, "tok string, docid long, tf int, len int")


def term_lists(rows: DataFrame, config: IndexConfig, edges: list[tuple[str, int]]) -> DataFrame:
    """(part, tok, first, docids, weighed): count_terms() as lists, one for each term of a slice of rows and each part between the edges that
    its postings belong to, by docid, of which first is the least; weighed: tf in the upper 32 bits, len in the lower. A list is one row
    to ship and sort, with its term once."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        analyse = Analyser(config)
        for b in batches:
            docids = b.column("docid").to_numpy()
            for start, stop in slices(b.column("text")):
                texts, ids = b.column("text")[start:stop], docids[start:stop]
                if np.any(ids[1:] < ids[:-1]):
                    order = np.argsort(ids, kind="stable")
                    texts, ids = texts.take(pa.array(order)), ids[order]
                names, term, text, tf, n = analyse.numbered(texts)
                ids = ids[text]
                part = parts_of(names, term, ids, edges)
                starts = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (part[1:] != part[:-1])))[: len(term)]
                ends = pa.array(np.append(starts, len(term)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (ids, tf.astype(np.int64) << 32 | n)]
                tok = names.take(pa.array(term[starts])).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(part[starts]), tok, pa.array(ids[starts]), *lists], ["part", "tok", "first", "docids", "weighed"])

    return rows.select("docid", "text").mapInArrow(run, "part int, tok string, first long, docids array<long>, weighed array<long>")


def term_lengths(rows: DataFrame, config: IndexConfig) -> DataFrame:
    """(docid, docno, len): the number of terms of each row of rows(docid, docno, text)."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        analyse = Analyser(IndexConfig(keep_stop=config.keep_stop))
        for b in batches:
            lens = [analyse.lengths(b.column("text")[start:stop]) for start, stop in slices(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("docid"), b.column("docno"), pa.array(np.concatenate([np.zeros(0, np.int32), *lens]))], ["docid", "docno", "len"])

    return rows.select("docid", "docno", "text").mapInArrow(run, "docid long, docno long, len int")
