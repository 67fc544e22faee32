"""Removal of byte strings that occur more than once, found by suffix order.

Every string of `length` bytes holds anchors, fixed by content: the k-gram of the least hash in it. Equal strings have
equal anchors, so only strings around anchors that occur twice can repeat, and the strings of one anchor can be
compared apart from all others: that splits the corpus into shards whose suffixes need never be compared with another
shard's. In a shard, the bytes around anchors are put in suffix order by induced sorting.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .induced import suffix_order
from .neardup import BYTE_P, BYTE_Q, U64, mix, powers
from .support import Cut

POSITION_BITS = U64(24)
#: Bytes looked at together; longer texts are taken in pieces that overlap by one string less a byte.
PIECE = 1 << 20


def anchors(data: np.ndarray, ends: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """For each run of strings with one anchor: its text's index, start of its first string, number of strings, the
    anchor's distance from that start, the anchor's hash, and a hash of the run's bytes and shape.

    data: the bytes of texts one after another, ending at ends."""
    n, window = len(data), length - k + 1
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, U64, U64))
    if n < length:
        return none
    total = np.zeros(n + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * powers(BYTE_P, n), out=total[1:])
    inverse = powers(BYTE_Q, n)
    m = n - k + 1
    grams = mix((total[k:] - total[:m]) * inverse[:m])
    value = (grams & ~((U64(1) << POSITION_BITS) - U64(1))) | np.arange(m, dtype=U64)
    # Least value of every window, from running minima of blocks to both sides.
    blocks = np.concatenate([value, np.full(-m % window, 2**64 - 1, U64)]).reshape(-1, window)
    left = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    right = np.minimum.accumulate(blocks, axis=1).ravel()
    s = np.arange(n - length + 1)
    at = (np.minimum(left[s], right[s + window - 1]) & ((U64(1) << POSITION_BITS) - U64(1))).astype(np.int64)
    owner = np.searchsorted(ends, s, side="right")
    inside = s + length <= ends[owner]
    new = inside.copy()
    new[1:] &= (at[1:] != at[:-1]) | ~inside[:-1] | (owner[1:] != owner[:-1])
    start = np.flatnonzero(new)
    if not len(start):
        return none
    count = np.bincount((np.cumsum(new) - 1)[inside], minlength=len(start))
    size = count + length - 1
    shift = at[start] - start
    print_ = mix((total[start + size] - total[start]) * inverse[start]) ^ mix((shift * 1024 + count).astype(U64))
    return owner[start], start, count, shift, grams[at[start]], mix(print_)


def _texts(batch, column: int, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    """(bytes, ends, row of each piece, offset of each piece in its text) of runs of rows; long texts come in pieces."""
    import pyarrow as pa

    texts = batch.column(column).cast(pa.binary())
    parts, rows, offsets, held = [], [], [], 0
    for i, raw in enumerate(texts):
        raw = raw.as_py() or b""
        step = PIECE
        for a in range(0, max(1, len(raw)), step):
            piece = raw[a : a + step + length - 1] if len(raw) > step else raw
            parts.append(piece)
            rows.append(i)
            offsets.append(a)
            held += len(piece)
            if held >= PIECE:
                yield np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts]), np.array(rows), np.array(offsets)
                parts, rows, offsets, held = [], [], [], 0
    if parts:
        yield np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts]), np.array(rows), np.array(offsets)


RUNS = "doc_id long, key long, anchor long, print long, place long, shape int, n int"


def _runs(length: int, k: int):
    """Runs of each batch. Runs met twice in a batch are known to repeat: all become removed places (anchor null), and
    one goes on to stand for them, so a passage that most texts share is one row a batch."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            cols: list[list[np.ndarray]] = [[] for _ in range(6)]
            for data, ends, rows, offsets in _texts(batch, 2, length):
                owner, start, count, shift, gram, print_ = anchors(data, ends, length, k)
                begin = start - np.concatenate([[0], ends])[owner] + offsets[owner]
                for c, x in zip(cols, (rows[owner], begin, count, shift, gram, print_), strict=True):
                    c.append(x)
            if not cols[0]:
                continue
            row, begin, count, shift, gram, print_ = (np.concatenate(c) for c in cols)
            if not len(row):
                continue
            ids, keys = batch.column(0), batch.column(1)
            order = np.lexsort((print_, gram))
            same = (gram[order][1:] == gram[order][:-1]) & (print_[order][1:] == print_[order][:-1])
            first = np.append(True, ~same)
            met = np.bincount(np.cumsum(first) - 1)
            keep = order[first]
            gone = order[np.repeat(met > 1, met)]
            pick = np.concatenate([keep, gone])
            null = np.zeros(len(pick), bool)
            null[len(keep) :] = True
            n = np.concatenate([np.minimum(met, 2), np.full(len(gone), 2)])
            at = pa.array(row[pick])
            yield pa.RecordBatch.from_arrays(
                [ids.take(at), keys.take(at), pa.array(gram[pick].view(np.int64), mask=null), pa.array(print_[pick].view(np.int64), mask=null), pa.array(begin[pick]), pa.array((shift * 1024 + count)[pick].astype(np.int32)), pa.array(n.astype(np.int32))],
                names=["doc_id", "key", "anchor", "print", "place", "shape", "n"],
            )

    return run


CONTEXTS = "doc_id long, key long, anchor long, place long, shape int, n int, bytes binary, print long"
#: Base of the second hash of single strings.
SECOND_P = 0xC2B2AE3D27D4EB4F
SECOND_Q = pow(SECOND_P, -1, 1 << 64)


def single_strings(parts: list[bytes], counts: np.ndarray, shifts: np.ndarray, grams: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """For each string of each part: its part, its start there, and two hashes of its bytes and its place at the anchor."""
    data = np.frombuffer(b"".join(parts), np.uint8).astype(U64) + U64(1)
    begin = np.cumsum([0, *(len(p) for p in parts)])[:-1]
    owner = np.repeat(np.arange(len(parts)), counts)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = begin[owner] + at
    out = []
    for p, q in ((BYTE_P, BYTE_Q), (SECOND_P, SECOND_Q)):
        total = np.zeros(len(data) + 1, U64)
        np.cumsum(data * powers(p, len(data)), out=total[1:])
        out.append(mix((total[start + length] - total[start]) * powers(q, len(data))[start]))
    place = mix(grams[owner] + (shifts[owner] - at).astype(U64))
    return owner, at, mix(out[0] ^ place), mix(out[1] + place)


def _contexts(length: int):
    """Of each wanted run of a text, its bytes; or, if its anchor has many runs, two hashes of each of its strings, of
    which those met twice in a batch are known to repeat (anchor null), one going on to stand for them."""

    def run(batches):
        import pyarrow as pa

        def table(cols: list):
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64()]
            return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in CONTEXTS.split(", ")])

        def strings(many: list[tuple]):
            shape = np.array([w[3] for w in many])
            owner, at, one, two = single_strings([w[5] for w in many], shape % 1024, shape // 1024, np.array([w[2] for w in many], np.int64).view(U64), length)
            order = np.lexsort((two, one))
            first = np.append(True, (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1]))
            met = np.bincount(np.cumsum(first) - 1)
            keep = order[first]
            pick = np.concatenate([keep, order[np.repeat(met > 1, met)]])
            null = np.arange(len(pick)) >= len(keep)
            n = np.concatenate([np.maximum(met, np.array([w[4] for w in many])[owner[keep]]), np.full(len(pick) - len(keep), 2)])
            docs, keys, places = (np.array([w[i] for w in many], np.int64)[owner[pick]] for i in (0, 1, 6))
            nothing = np.ones(len(pick), bool)
            return table([pa.array(docs), pa.array(keys), pa.array(one[pick].view(np.int64), mask=null), pa.array(places + at[pick]), pa.array(np.zeros(len(pick), np.int32), mask=nothing), pa.array(np.minimum(n, 2).astype(np.int32)), pa.nulls(len(pick), pa.binary()), pa.array(two[pick].view(np.int64), mask=null)])

        for batch in batches:
            out: list[tuple] = []
            many: list[tuple] = []
            raws = batch.column(2).cast(pa.binary())
            for i in range(len(batch)):
                raw = raws[i].as_py()
                doc, key = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                for w in batch.column(3)[i].as_py():
                    part = raw[w["place"] : w["place"] + w["shape"] % 1024 + length - 1]
                    if w["many"]:
                        many.append((doc, key, w["anchor"], w["shape"], w["n"], part, w["place"]))
                    else:
                        out.append((doc, key, w["anchor"], w["place"], w["shape"], w["n"], part, None))
                if len(out) >= 20_000:
                    yield table(list(zip(*out, strict=True)))
                    out = []
                if len(many) >= 4_000:
                    yield strings(many)
                    many = []
            if out:
                yield table(list(zip(*out, strict=True)))
            if many:
                yield strings(many)

    return run


def matched(parts: list[bytes], groups: np.ndarray, length: int, memory: int = 1 << 18) -> list[np.ndarray]:
    """For each part, which of its strings of `length` bytes also start elsewhere in a part of the same group.

    Parts are joined, each ended by a 0, the bytes of UTF-8 being raised by 1. memory: tuples that queues hold."""
    sizes = np.array([len(p) for p in parts])
    data = np.frombuffer(b"\x00".join(parts) + b"\x00", np.uint8) + np.uint8(1)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    data[begin + sizes] = 0
    order, common = suffix_order(data, memory)
    owner = np.repeat(np.arange(len(parts), dtype=np.int32), sizes + 1)[order]
    inside = order - begin[owner] + length <= sizes[owner]
    # What lies between two suffixes with a common string has it too: neighbours with one in common are inside both.
    order, owner, equal = order[inside], owner[inside], common[inside] >= length
    group = groups[owner]
    runs = np.cumsum(~equal)
    # Within a run of equal strings, those of one group need not be neighbours.
    by = np.lexsort((group, runs))
    same = np.append(False, (runs[by][1:] == runs[by][:-1]) & (group[by][1:] == group[by][:-1]))
    hit = np.zeros(len(order), bool)
    hit[by] = same
    hit[by[:-1][same[1:]]] = True
    flags = np.zeros(len(data), bool)
    flags[order[hit]] = True
    return [flags[b : b + max(0, s - length + 1)] for b, s in zip(begin, sizes, strict=True)]


def _sorted_shards(length: int, shard: int, memory: int):
    """Batches sorted by anchor: shards of whole groups of about `shard` bytes are put in suffix order."""

    def run(batches):
        import pyarrow as pa

        def solve(rows: list[tuple]) -> Iterator:
            parts, anchor = [r[6] for r in rows], np.array([r[2] for r in rows], np.int64)
            out = []
            for r, hit in zip(rows, matched(parts, anchor, length, memory), strict=True):
                if r[5] > 1:
                    continue  # known to repeat; it is here for others
                edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
                out += [(r[0], r[1], r[3] + int(a), r[3] + int(b) + length - 1) for a, b in zip(edge[::2], edge[1::2], strict=True)]
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "key", "start", "end"])

        rows, held, group, last = [], 0, [], None
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r[2] != last:
                    rows += group
                    group, last = [], r[2]
                    if held >= shard:
                        yield from solve(rows)
                        rows, held = [], 0
                group.append(r)
                held += len(r[6]) + 1
        rows += group
        if rows:
            yield from solve(rows)

    return run


OUT = "doc_id long, key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _result(batches):
    import pyarrow as pa

    for batch in batches:
        out = []
        raws = batch.column(2).cast(pa.binary())
        for i in range(len(batch)):
            raw = raws[i].as_py() or b""
            gone, spans, at, removed, digest = batch.column(3)[i].as_py() or [], 0, 0, 0, hashlib.sha256()
            stop = None
            for s, e in sorted((g["start"], g["end"]) for g in gone):
                if stop is None or s > stop:
                    if stop is not None:
                        at = stop
                    digest.update(raw[at:s])
                    spans += 1
                    removed += e - s
                    stop = e
                elif e > stop:
                    removed += e - stop
                    stop = e
            digest.update(raw[stop if stop is not None else 0 :])
            out.append((batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), len(raw), removed, spans, digest.hexdigest()))
        if out:
            kinds = [pa.int64()] * 5 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in OUT.split(", ")])


def spans(spark: SparkSession, docs: DataFrame, cut: Cut, length: int = 200, k: int = 64, shard: int = 1 << 20, memory: int = 1 << 18) -> tuple[DataFrame, DataFrame]:
    """(docs as doc_id, key, text), and (doc_id, key, gone), the removed [start, end) byte ranges of each text that has some.

    Anchors are gathered in shards of `shard` bytes or so, put in suffix order with queues of at most `memory` tuples in memory. An anchor
    whose different runs are more than a shard is no task's: its strings are counted by two 64-bit hashes each, in part before the
    shuffle. Runs are counted by anchor and print before they are gathered by anchor, so copies weigh nothing there."""
    group = max(1, shard // (length + (length - k + 1) // 2))  # runs of half the longest
    # The key tells apart texts of one doc_id; where ids are unique it is 0 and costs nothing.
    ids = docs.groupBy(docs["doc_id"]).agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
    key = F.lit(0).cast("long") if ids.isEmpty() else F.xxhash64(docs["text"])
    base = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(-(2**63) + 1)).alias("doc_id"), key.alias("key"), docs["text"].alias("text"))
    runs = cut(base.mapInArrow(_runs(length, k), RUNS))
    known = runs.where("anchor is null").select("doc_id", "key", F.col("place").alias("start"), (F.col("place") + F.col("shape") % 1024 + length - 1).alias("end"))
    mine = runs.where("anchor is not null")
    # Anchors met once go first; all counts are taken in part before a shuffle.
    met = mine.groupBy("anchor").agg(F.sum("n").alias("met"), F.min("print").alias("lo"), F.max("print").alias("hi")).where("met > 1")
    mine = cut(mine.join(met.select("anchor", (F.col("lo") != F.col("hi")).alias("several")), "anchor"))
    prints = cut(mine.groupBy("anchor", "print").agg(F.sum("n").alias("copies"), F.min(F.struct("doc_id", "key", "place")).alias("at")))
    many = prints.groupBy("anchor").agg(F.count("*").alias("runs")).where(F.col("runs") > group).select("anchor", F.lit(True).alias("many"))
    held = mine.join(prints, ["anchor", "print"]).join(many, "anchor", "left").where("copies > 1 or several")
    first = F.when(F.struct("doc_id", "key", "place") == F.col("at"), 1).otherwise(2).alias("first")
    held = cut(held.select("doc_id", "key", "anchor", "place", "shape", "copies", first, "several", F.coalesce("many", F.lit(False)).alias("many")))
    whole = held.where("copies > 1").select("doc_id", "key", F.col("place").alias("start"), (F.col("place") + F.col("shape") % 1024 + length - 1).alias("end"))
    wanted = held.where("several and first = 1").groupBy("doc_id", "key").agg(F.collect_list(F.struct("anchor", "place", "shape", F.least(F.col("copies"), F.lit(2)).cast("int").alias("n"), "many")).alias("wanted"))
    contexts = base.join(wanted, ["doc_id", "key"]).dropDuplicates(["doc_id", "key"]) if not ids.isEmpty() else base.join(wanted, ["doc_id", "key"])
    contexts = cut(contexts.select("doc_id", "key", "text", "wanted").mapInArrow(_contexts(length), CONTEXTS))
    parts = contexts.where("bytes is not null").select("doc_id", "key", "anchor", "place", "shape", "n", "bytes")
    found = parts.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_sorted_shards(length, shard, memory), "doc_id long, key long, start long, end long")
    # Of anchors with many runs, strings are told apart by their hashes: counted in part before the shuffle.
    strings = contexts.where("bytes is null and anchor is not null").select("doc_id", "key", "anchor", "print", "place", "n")
    repeated = strings.groupBy("anchor", "print").agg(F.sum("n").alias("total")).where("total > 1").select("anchor", "print")
    single = strings.join(repeated, ["anchor", "print"]).union(contexts.where("bytes is null and anchor is null").select("anchor", "print", "doc_id", "key", "place", "n"))
    single = single.select("doc_id", "key", F.col("place").alias("start"), (F.col("place") + length).alias("end"))
    every = known.union(whole).union(cut(found)).union(single)
    return base, every.groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "end")).alias("gone"))


def remove(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row of docs(doc_id, text): its UTF-8 bytes without
    those covered by a string of `length` bytes that starts anywhere else too, in it or another row.

    Strings are judged on the input; overlapping occurrences count; matches don't cross rows. Null text counts as
    empty; equal rows are two places for each other; null doc_id comes back null; an empty table gives an empty result;
    other columns are not looked at.
    """
    cut = Cut(spark)
    base, gone = spans(spark, docs, cut, **options)
    out = base.join(gone, ["doc_id", "key"], "left").select("doc_id", "key", "text", "gone").mapInArrow(_result, OUT)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != -(2**63) + 1, F.col("doc_id"))).drop("key")
