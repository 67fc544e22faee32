"""Packing of tokenized documents into sequences by linear grouping and best fit.

The number of pieces of each length is a table of at most `capacity` rows, whatever the input's size; the packing is
planned on that table, and each piece finds its place from its length and its rank among the pieces of that length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .support import Cut
from .tokens import default_path, encoder

END = 2


def cutting_patterns(sizes: list[int], demand: list[int], capacity: int, rounds: int = 400) -> list[tuple[list[int], float]]:
    """(copies of each size, times used) of the fractional optimum of cutting stock, by column generation: a revised
    simplex whose entering pattern is a knapsack over the duals."""
    k = len(sizes)
    basis = [[capacity // s if i == j else 0 for i in range(k)] for j, s in enumerate(sizes)]
    inverse = np.diag([1.0 / (capacity // s) for s in sizes])
    x = inverse @ np.array(demand, float)
    for _ in range(rounds):
        duals = inverse.sum(axis=0)  # every pattern costs one sequence
        best = np.zeros(capacity + 1)
        take = np.full(capacity + 1, -1)
        for c in range(1, capacity + 1):
            best[c], take[c] = best[c - 1], -1
            for i, s in enumerate(sizes):
                if s <= c and best[c - s] + duals[i] > best[c] + 1e-12:
                    best[c], take[c] = best[c - s] + duals[i], i
        if best[capacity] <= 1 + 1e-7:
            break
        pattern, c = [0] * k, capacity
        while c > 0:
            if take[c] < 0:
                c -= 1
            else:
                pattern[take[c]] += 1
                c -= sizes[take[c]]
        d = inverse @ np.array(pattern, float)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(d > 1e-9, x / d, np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        step = ratio[out]
        x = x - step * d
        x[out] = step
        row = inverse[out] / d[out]
        inverse = inverse - np.outer(d, row)
        inverse[out] = row
        basis[out] = pattern
    return [(p, float(max(0.0, v))) for p, v in zip(basis, x, strict=True)]


class Plan:
    """segments: (length, first rank, count, sequence, offset): the pieces of that length with these ranks go to
    consecutive sequences from `sequence` on, each at `offset`. n: number of sequences."""

    def __init__(self, counts: dict[int, int], capacity: int, groups: int = 16, small: int = 64):
        self.capacity, self.n, self.segments = capacity, 0, []
        left = Counter({s: c for s, c in counts.items() if c > 0})
        used: Counter = Counter()
        gaps: dict[int, list[list[int]]] = {}  # free room: [first sequence, count], the place being capacity - room
        rooms: list[int] = []

        def open_gap(room: int, first: int, count: int) -> None:
            if room > 0:
                if room not in gaps:
                    gaps[room] = []
                    insort(rooms, room)
                gaps[room].append([first, count])

        def put(length: int, first: int, count: int, offset: int) -> None:
            self.segments.append((length, used[length], count, first, offset))
            used[length] += count
            left[length] -= count

        whole = left.get(capacity, 0)
        if whole:
            put(capacity, 0, whole, 0)
            self.n = whole
        large = sorted((s for s in left if small < s < capacity and left[s]), reverse=True)
        total = sum(left[s] for s in large)
        if total:
            # Groups of equal cardinality, as far as one length isn't more than that; each is rounded up to its largest.
            members: list[list[int]] = []
            filled = 0
            for s in large:
                if not members or filled >= total / groups:
                    members.append([])
                    filled = 0
                members[-1].append(s)
                filled += left[s]
            group = {m[0]: m for m in members}
            tops = list(group)
            for pattern, times in cutting_patterns(tops, [sum(left[s] for s in m) for m in members], capacity):
                slots = [t for t, n in zip(tops, pattern, strict=True) for _ in range(n)]
                times = int(times + 1e-6)
                while times and slots:
                    # Actual lengths take their group's places, in runs of as many sequences as the lengths last; being
                    # shorter than rounded, they leave more room to the last place: the longest piece that fits it.
                    chosen: list[int] = []
                    have: Counter = Counter()
                    for k, t in enumerate(slots):
                        room = capacity - sum(chosen)
                        pool = group[t] if k < len(slots) - 1 else large
                        s = next((x for x in pool if x <= room and left[x] > have[x]), None)
                        if s is None:
                            break
                        chosen.append(s)
                        have[s] += 1
                    if len(chosen) < len(slots):
                        break
                    run = min([times, *(left[x] // n for x, n in have.items())])
                    at = 0
                    for s in chosen:
                        put(s, self.n, run, at)
                        at += s
                    open_gap(capacity - at, self.n, run)
                    self.n += run
                    times -= run
        # What the optimum's fractions left, and all small pieces: largest first, each into the tightest gap.
        for s in sorted((s for s in left if left[s] > 0), reverse=True):
            while left[s] > 0:
                i = bisect_left(rooms, s)
                if i == len(rooms):
                    room, first, count = capacity, self.n, -(-left[s] // (capacity // s))
                    self.n += count
                else:
                    room = rooms[i]
                    first, count = gaps[room].pop()
                    if not gaps[room]:
                        del gaps[room], rooms[i]
                fit = min(room // s, left[s])
                n = min(count, left[s] // fit)
                if n < count:
                    open_gap(room, first + n, count - n)
                for j in range(fit):
                    put(s, first, n, capacity - room + j * s)
                open_gap(room - fit * s, first, n)


def best_plan(counts: dict[int, int], capacity: int, groups: tuple[int, ...]) -> Plan:
    """Of several numbers of groups and bounds between large and small, what packs best; a plan takes under a second."""
    return min((Plan(counts, capacity, g, capacity // d) for g in groups for d in (64, 16, 8, 4)), key=lambda x: x.n)


def pieces(docs: DataFrame, capacity: int, tokenizer: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of docs(doc_id, text)."""

    def cut_up(batches):
        import pyarrow as pa

        coder = encoder(tokenizer)
        for batch in batches:
            out: list[tuple] = []
            texts = (t.as_py() or "" for t in batch.column(1))
            for doc, found in zip(batch.column(0).to_pylist(), coder.encode(texts), strict=True):
                ids = np.append(found, np.array([END], "<u4"))
                first = (len(ids) - 1) % capacity + 1
                for k, end in enumerate(range(first, len(ids) + 1, capacity)):
                    at = max(0, end - capacity)
                    part = ids[at:end]
                    out.append((doc, k, at, len(part), zlib.crc32(part.tobytes())))
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(cut_up, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(
    spark: SparkSession,
    docs: DataFrame,
    capacity: int = 1024,
    tokenizer: str | None = None,
    groups: tuple[int, ...] = (16, 24),
    rows_per_bucket: int = 500,
    buckets_per_run: int = 500,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece of docs(doc_id, text).

    A document is its token ids and the end id 2; longer ones are cut into pieces of `capacity` tokens, but for a
    shorter first one. Large lengths are rounded up within groups of equal cardinality, the few sizes are packed by a cutting-
    stock optimum, actual pieces take the rounded places, and the rest go into the tightest gaps.

    Null text counts as empty, which is one piece of the end id; equal rows are separate pieces; null doc_id is kept;
    an empty table gives an empty result. Other columns of docs are not looked at.
    """
    cut = Cut(spark)
    made = pieces(docs, capacity, tokenizer or default_path())
    made = cut(made.withColumn("salt", F.abs(F.xxhash64("doc_id", "piece"))))
    counts = {int(r["length"]): int(r["n"]) for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = best_plan(counts, capacity, groups)
    buckets = max(1, -(-max(counts.values(), default=1) // rows_per_bucket))
    made = made.withColumn("bucket", F.col("salt") % buckets)
    # Prefix sums in two levels: of the buckets within runs of buckets, and of the runs, so no task has one length's all.
    sums = cut(made.groupBy("length", "bucket").agg(F.count("*").alias("n")).withColumn("run", F.floor(F.col("bucket") / buckets_per_run)))
    before = lambda *by: F.coalesce(F.sum("n").over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sums.groupBy("length", "run").agg(F.sum("n").alias("n")).select("length", "run", before("length", "run").alias("base"))
    sums = sums.withColumn("more", before("length", "run", "bucket")).join(bases, ["length", "run"])
    sums = sums.select(F.col("length").alias("len_"), F.col("bucket").alias("bucket_"), (F.col("base") + F.col("more")).alias("base"))
    inner = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = made.withColumn("at", F.row_number().over(inner) - 1)
    ranked = ranked.join(sums, (ranked.length == sums.len_) & (ranked.bucket == sums.bucket_)).withColumn("rank", F.col("base") + F.col("at"))
    segments = np.array(sorted(plan.segments), dtype=np.int64).reshape(-1, 5)
    held = spark.sparkContext.broadcast(segments)  # bounded by the plan: lengths times patterns, not rows

    def place(batches):
        import pyarrow as pa

        table = held.value
        wide = int(table[:, 1].max(initial=0)) + 1
        keys = table[:, 0].astype(object) * wide + table[:, 1] if wide > 2**50 else table[:, 0] * wide + table[:, 1]
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            i = np.searchsorted(keys, length * wide + np.minimum(rank, wide - 1), side="right") - 1
            seg = table[i]
            more = [pa.array(seg[:, 3] + rank - seg[:, 1]), pa.array(seg[:, 4])]
            yield pa.RecordBatch.from_arrays([*(b.column(j) for j in range(5)), *more], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
