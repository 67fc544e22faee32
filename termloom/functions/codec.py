"""Integer codes of posting lists: gaps, unary, Elias gamma, bit packing. Bits of single numbers are Column expressions;
lists are coded and decoded by Arrow batches in numpy.

Gaps of a list start at first docid + 1, so that docid 0 has a code and decoding returns what was encoded.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import CODECS


def unary(n: Column) -> Column:
    return F.concat(F.repeat(F.lit("1"), (n - 1).cast("int")), F.lit("0"))


def gamma(n: Column) -> Column:
    bits = F.bin(n)
    return F.concat(F.repeat(F.lit("1"), F.length(bits) - 1), F.lit("0"), F.substr(bits, F.lit(2)))


def _valid(codec: str) -> str:
    if codec not in CODECS[1:]:
        raise ValueError(f"codec must be one of {', '.join(CODECS[1:])}; got {codec!r}")
    return codec


def pack_values(values: np.ndarray, sizes: np.ndarray, codec: str) -> list[bytes]:
    """The bits of lists of positive integers, one list after another with `sizes` values each, packed with the first bit
    highest and the last byte filled with ones. All lists are coded together, a bit position at a time."""
    values, sizes = values.astype(np.int64), sizes.astype(np.int64)
    if _valid(codec) == "unary":
        head, low = values - 1, np.zeros(len(values), np.int64)
    else:
        head = low = np.maximum(0, np.floor(np.log2(np.maximum(values, 1))).astype(np.int64))
        head = low = low - (values < (1 << low)) + (values >= (1 << (low + 1)))
    length = head + 1 + low
    ends = np.cumsum(sizes)
    total = np.concatenate([[0], np.cumsum(length)])
    bits = total[ends] - total[ends - sizes]
    room = -(-bits // 8)
    start = np.concatenate([[0], np.cumsum(room)[:-1]]) if len(room) else room
    owner = np.repeat(np.arange(len(sizes)), sizes)
    at = total[:-1] - total[(ends - sizes)[owner]] + 8 * start[owner]
    out = np.ones(8 * int(room.sum()), np.uint8)
    out[at + head] = 0
    for k in range(int(low.max(initial=0))):
        some = low > k
        out[at[some] + head[some] + 1 + k] = (values[some] >> (low[some] - 1 - k)) & 1
    data = np.packbits(out).tobytes()
    return [data[a : a + n] for a, n in zip(start.tolist(), room.tolist(), strict=True)]


def unpack_values(data: list[bytes], codec: str) -> tuple[np.ndarray, np.ndarray]:
    """(values of all lists, number of each list's): what pack_values packed; ones that end a last byte belong to none."""
    _valid(codec)
    room = np.array([len(d) for d in data], np.int64)
    bits = np.unpackbits(np.frombuffer(b"".join(data), np.uint8))
    edge = np.concatenate([[0], 8 * np.cumsum(room)])
    zeros = np.flatnonzero(bits == 0)
    if codec == "unary":
        owner = np.searchsorted(edge, zeros, side="right") - 1
        before = np.concatenate([[-1], zeros[:-1]]) if len(zeros) else zeros
        return zeros - np.maximum(before, edge[owner] - 1), np.bincount(owner, minlength=len(data))
    # Where the code that may start at a bit has its zero; the next one starts as many bits after it as the zero comes after its start.
    edges = np.append(zeros, len(bits))
    after = np.repeat(edges, np.diff(edges, prepend=-1))
    ends, starts, many = memoryview(after), [], []
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        n = len(starts)
        while a < b and (zero := ends[a]) < b:
            starts.append(a)
            a = 2 * zero - a + 1
        many.append(len(starts) - n)
    start = np.array(starts, np.int64)
    zero = after[start] if len(start) else start
    low, values = zero - start, np.ones(len(start), np.int64)
    for k in range(int(low.max(initial=0))):
        some = low > k
        values[some] = 2 * values[some] + bits[zero[some] + 1 + k]
    return values, np.array(many, np.int64)


def pack_udf(codec: str):
    """Column function: array of positive integers to binary."""
    _valid(codec)

    @F.pandas_udf("binary")
    def packed(lists: pd.Series) -> pd.Series:
        sizes = np.array([len(x) for x in lists], np.int64)
        return pd.Series(pack_values(np.concatenate(list(lists)) if len(lists) else np.zeros(0), sizes, codec))

    return packed


def decode_udf(codec: str):
    """Column function: binary to array<bigint>."""
    _valid(codec)

    @F.pandas_udf("array<bigint>")
    def decoded(data: pd.Series) -> pd.Series:
        values, many = unpack_values([bytes(x) if x is not None else b"" for x in data], codec)
        lists = pd.Series(np.split(values, np.cumsum(many)[:-1]), dtype=object)
        return lists.where(data.notna().to_numpy(), None)

    return decoded


def gaps(docids: Column) -> Column:
    """Of an ascending array: first + 1, then differences."""
    return F.transform(docids, lambda d, i: d - F.coalesce(F.get(docids, i - 1), F.lit(-1)))


def from_gaps_udf():
    """Column function: running sums of an array, less 1."""

    @F.pandas_udf("array<bigint>")
    def summed(lists: pd.Series) -> pd.Series:
        return lists.map(lambda x: None if x is None else np.cumsum(x) - 1)

    return summed


def coded_values(docids: np.ndarray, freqs: np.ndarray, sizes: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Of lists one after another, `sizes` postings each: the gaps of a list, the first one from its start, then its frequencies."""
    ends = np.cumsum(sizes)
    first, at = np.repeat(ends - sizes, sizes), np.arange(len(docids))
    gap = np.diff(docids, prepend=0)
    heads = (ends - sizes)[sizes > 0]
    gap[heads] = docids[heads] - start[sizes > 0] + 1
    out = np.empty(2 * len(docids), np.int64)
    out[first + at] = gap
    out[first + at + np.repeat(sizes, sizes)] = freqs
    return out


def encode_blocks(codec: str):
    """Column function of docids, freqs and a block's start: binary of the gaps, the first one from the start, then the frequencies."""
    _valid(codec)

    @F.pandas_udf("binary")
    def coded(docids: pd.Series, freqs: pd.Series, start: pd.Series) -> pd.Series:
        sizes = np.array([len(x) for x in docids], np.int64)
        whole = [np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (docids, freqs)]
        return pd.Series(pack_values(coded_values(*whole, sizes, start.to_numpy(np.int64)), 2 * sizes, codec))

    return coded


def decode_blocks(codec: str):
    """Column function of encode_blocks' binary and the start: struct(docids, freqs)."""
    _valid(codec)

    @F.pandas_udf("struct<docids: array<bigint>, freqs: array<int>>")
    def decoded(data: pd.Series, start: pd.Series) -> pd.DataFrame:
        values, many = unpack_values([bytes(x) for x in data], codec)
        half, ends = many // 2, np.cumsum(many)
        at = np.arange(half.sum()) + np.repeat(ends - many - np.cumsum(half) + half, half)
        sums = np.cumsum(values[at])
        edges = np.cumsum(half)
        before = np.concatenate([[0], sums])[edges - half]
        docids = sums + np.repeat(start.to_numpy(np.int64) - 1 - before, half)
        freqs = values[at + np.repeat(half, half)].astype(np.int32)
        return pd.DataFrame({"docids": np.split(docids, edges[:-1]) if len(many) else [], "freqs": np.split(freqs, edges[:-1]) if len(many) else []})

    return decoded
