"""Approximate nearest neighbours by cross-polytope hashing with fast Hadamard pseudo-rotations."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .neardup import U64, mix
from .support import Cut

FINITE = "{0} is not null and size({0}) > 0 and forall({0}, x -> x is not null and not isnan(x) and abs(x) < 'Infinity'::double) and exists({0}, x -> x <> 0)"
#: Rotated coordinates that count as axes: wider vectors are hashed by so many of them.
MOST_AXES = 64
#: More than the error of a product of unit vectors in single precision.
SLACK = 1e-4


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of the rows, whose length is a power of two, by log2 steps of sums and differences."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / math.sqrt(n)


def rotated(unit: np.ndarray, table: int, seed: int) -> np.ndarray:
    """Pseudo-rotation of a table: three rounds of random signs and a Hadamard transform."""
    n = 1 << max(1, (unit.shape[1] - 1).bit_length())
    x = np.zeros((len(unit), n))
    x[:, : unit.shape[1]] = unit
    r = np.random.default_rng([seed, table, n])
    for _ in range(3):
        x = hadamard(x * r.choice([-1.0, 1.0], n))
    return x


def signed(unit: np.ndarray, table: int, seed: int) -> np.ndarray:
    """Each row's coordinate along each signed axis: 2 i for axis i, 2 i + 1 for its opposite."""
    x = rotated(unit, table, seed)[:, :MOST_AXES]
    return np.stack([x, -x], axis=2).reshape(len(x), -1)


def axes(unit: np.ndarray, table: int, seed: int, probes: int) -> np.ndarray:
    """The `probes` nearest signed axes of each row, nearest first."""
    return np.argsort(-signed(unit, table, seed), axis=1, kind="stable")[:, :probes]


def n_codes(width: int) -> int:
    """Buckets of a table: pairs of signed axes."""
    return (2 * min(MOST_AXES, 1 << max(1, (width - 1).bit_length()))) ** 2


def buckets(unit: np.ndarray, table: int, seed: int) -> np.ndarray:
    """The bucket of each row in a table: its nearest signed axes under two rotations."""
    first, second = (signed(unit, 2 * table + h, seed) for h in (0, 1))
    return first.argmax(axis=1) * first.shape[1] + second.argmax(axis=1)


def probed(unit: np.ndarray, table: int, seed: int, count: int) -> np.ndarray:
    """The `count` buckets of each row that it misses least, by the sum of squared distances to both largest coordinates;
    in no order. Only axes near enough to matter are combined, some four times the root of count under each rotation."""
    found = []
    for h in (0, 1):
        x = signed(unit, 2 * table + h, seed)
        reach = min(x.shape[1], math.ceil(4 * math.sqrt(count)))
        best = np.argsort(-x, axis=1, kind="stable")[:, :reach]
        value = np.take_along_axis(x, best, axis=1)
        found.append((best, (value[:, :1] - value) ** 2))
    (a, ga), (b, gb) = found
    miss = (ga[:, :, None] + gb[:, None, :]).reshape(len(unit), -1)
    pick = np.argpartition(miss, count - 1, axis=1)[:, :count] if count < miss.shape[1] else np.broadcast_to(np.arange(miss.shape[1]), miss.shape)
    wide = b.shape[1]
    return np.take_along_axis(a, pick // wide, axis=1) * math.isqrt(n_codes(unit.shape[1])) + np.take_along_axis(b, pick % wide, axis=1)


def share_of(n: int, share: float) -> float:
    """The share of a table's buckets that a query looks into: `share` for a million vectors, more for fewer, less for more."""
    return min(1.0, share * (1e6 / max(n, 1)) ** 0.25)


def search(
    spark: SparkSession,
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    tables: int = 2,
    share: float = 0.1,
    seed: int = 11,
    block: int = 1 << 24,
    sample: int = 4096,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries(vec_id, embedding) its k nearest of vectors(vec_id,
    embedding) by cosine in double precision, its own id left out; ties to the smaller vec_id.

    Each table turns all unit vectors by two pseudo-rotations of its own and puts each under its pair of nearest signed
    axes; a query looks into the buckets that it misses least, share_of(n) of each table's. Neighbouring buckets form
    regions of about `block` numbers, one task's; a region with more is split by a hash of the vector and its queries are
    sent to each part. In a task the queries of a bucket meet its vectors in one product, what may be among the nearest
    is ranked by exact cosines, and k + 1 vectors a query and region go on. Vectors are shuffled once a table and in their own
    precision; pairs never carry them. Up to `sample` vectors (4 million numbers) give each query a lower bound of its k-th cosine.

    Equal vectors are compared once, for the k + 1 smallest of their ids; a query that meets fewer than k vectors is
    compared with all. Vectors that are null, zero, or hold nulls or non-finite components take no
    part; rows equal in vec_id and embedding count once, of an id with several vectors the nearest; vectors of different
    lengths are not compared; empty tables give an empty result. Other columns are not looked at.
    """
    cut = Cut(spark)
    kind = vectors.schema["embedding"].dataType.elementType.typeName()
    kind = "float" if kind == "float" and queries.schema["embedding"].dataType.elementType.typeName() == "float" else "double"

    def clean(df: DataFrame) -> DataFrame:
        out = df.select(df["vec_id"].cast("long").alias("vec_id"), df["embedding"].cast(f"array<{kind}>").alias("embedding"))
        return out.where("vec_id is not null").where(FINITE.format("embedding"))

    base, asked = clean(vectors), clean(queries)
    n, width = base.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    few = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(k + 1, min(sample, (1 << 22) // width))).dropDuplicates(["vec_id"]).collect()
    known: dict[int, list] = {}
    for r in few:
        known.setdefault(len(r["embedding"]), []).append(r["embedding"])
    held = spark.sparkContext.broadcast({w: _unit(np.array(v, np.float64)) for w, v in known.items()})
    job = _Job(k, tables, max(1, -(-n * width // block)), seed, share_of(n, share), kind)
    sizes = base.mapInArrow(job.vectors(False), "region long, vectors long").groupBy("region").agg(F.sum("vectors").alias("n"))
    parts = cut(sizes.select("region", F.ceil(F.col("n") * width / block).cast("int").alias("parts")))
    found = cut(_nearest(base.mapInArrow(job.vectors(True), job.schema), asked.mapInArrow(job.queries(held), job.schema), parts, job, block))
    enough = found.groupBy("query_id").agg(F.count_distinct("vec_id").alias("n")).where(F.col("n") >= k).select("query_id")
    few = cut(asked.join(enough, asked.vec_id == enough.query_id, "left_anti"))
    if not few.isEmpty():
        one = job.once()
        found = found.union(_nearest(base.mapInArrow(one.vectors(True), job.schema), few.mapInArrow(one.queries(None), job.schema), parts, job, block))
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _by_width(batch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors as rows) of runs of rows with vectors of one length."""
    import pyarrow as pa
    import pyarrow.compute as pc

    ids, vectors = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
    widths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    for w in np.unique(widths):
        at = np.flatnonzero(widths == w)
        yield ids[at], vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, w)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _prints(x: np.ndarray) -> np.ndarray:
    """64-bit hashes of rows; 0.0 and -0.0 are one."""
    bits = (x.astype(np.float64) + 0.0).view(U64)
    out = np.zeros(len(x), U64)
    for i in range(bits.shape[1]):
        out = mix(out * U64(3) + bits[:, i] + U64(i))
    return out


def _least_ids(group: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The `most` smallest different ids of each group 0, 1, 2, ..., one after another, and each group's number."""
    order = np.lexsort((ids, group))
    group, ids = group[order], ids[order]
    new = np.append(True, (group[1:] != group[:-1]) | (ids[1:] != ids[:-1]))[: len(group)]
    group, ids = group[new], ids[new]
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1])[: len(group)])
    place = np.arange(len(group)) - first[group]
    keep = place < most
    return ids[keep], np.bincount(group[keep])


class _Job:
    """The rows of both sides. A region is a run of codes of a table, for one length of vectors."""

    def __init__(self, k: int, tables: int, slots: int, seed: int, share: float, kind: str):
        self.k, self.tables, self.slots, self.seed, self.share = k, range(tables), slots, seed, share
        self.schema = f"region long, side int, code int, print long, ids array<long>, embedding array<{kind}>, codes binary, bound double"

    def once(self) -> _Job:
        """The same with one table, in which all is looked into."""
        return _Job(self.k, 1, self.slots, self.seed, 1.0, self.schema.rpartition("embedding array<")[2].partition(">")[0])

    def region(self, width: int, table: int, codes: np.ndarray) -> np.ndarray:
        return (width << 40) + (table << 32) + codes.astype(np.int64) * self.slots // n_codes(width)

    def vectors(self, whole: bool, step: int = 2048):
        """Vectors under their bucket of each table, equal ones of a batch once; or just the number of a region."""

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                for ids, x in _by_width(batch):
                    prints, at, group = np.unique(_prints(x), return_index=True, return_inverse=True)
                    least, many = _least_ids(group, ids, self.k + 1)
                    ends = np.concatenate([[0], np.cumsum(many)])
                    x = x[at]
                    for i in range(0, len(x), step):
                        part = x[i : i + step]
                        unit, n = _unit(part), len(part)
                        names = pa.ListArray.from_arrays(pa.array((ends[i : i + n + 1] - ends[i]).astype(np.int32)), pa.array(least[ends[i] : ends[i + n]]))
                        for t in self.tables:
                            codes = buckets(unit, t, self.seed)
                            region = self.region(x.shape[1], t, codes)
                            if not whole:
                                where, count = np.unique(region, return_counts=True)
                                yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(count)], names=["region", "vectors"])
                                continue
                            yield self._rows(region, 0, codes, prints[i : i + n].view(np.int64), names, part, [b""] * n, np.zeros(n))

        return run

    def queries(self, held, step: int = 128):
        """Each query under each region that it looks into, with its buckets there (none named: all)."""

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                for ids, x in _by_width(batch):
                    codes_all = n_codes(x.shape[1])
                    count = max(1, math.ceil(codes_all * self.share))
                    known = held.value.get(x.shape[1]) if held is not None else None
                    for i in range(0, len(x), step):
                        part, unit = x[i : i + step], _unit(x[i : i + step])
                        bound = np.full(len(part), -2.0)
                        if known is not None and len(known) > self.k:
                            bound = np.partition(unit @ known.T, -self.k - 1, axis=1)[:, -self.k - 1]
                        for t in self.tables:
                            who, region, codes = [], [], []
                            if held is None:
                                slots = np.unique(np.arange(codes_all) * self.slots // codes_all)
                                who = np.repeat(np.arange(len(part)), len(slots))
                                region = np.tile((x.shape[1] << 40) + (t << 32) + slots, len(part))
                                codes = [b""] * len(who)
                            else:
                                for j, mine in enumerate(np.sort(probed(unit, t, self.seed, count), axis=1)):
                                    where = self.region(x.shape[1], t, mine)
                                    edge = np.flatnonzero(np.append(True, where[1:] != where[:-1]))
                                    who += [j] * len(edge)
                                    region += where[edge].tolist()
                                    codes += [c.astype("<u4").tobytes() for c in np.split(mine, edge[1:])]
                            who = np.array(who)
                            names = pa.ListArray.from_arrays(pa.array(np.arange(len(who) + 1, dtype=np.int32)), pa.array(ids[i : i + step][who]))
                            yield self._rows(np.array(region), 1, np.zeros(len(who)), np.zeros(len(who), np.int64), names, part[who], codes, bound[who])

        return run

    def _rows(self, region, side, code, print_, names, x, codes, bound):
        import pyarrow as pa

        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(np.ascontiguousarray(x).ravel()))
        cols = [pa.array(region), pa.array(np.full(len(x), side, np.int32)), pa.array(code.astype(np.int32)), pa.array(print_), names, lists, pa.array(codes, pa.binary()), pa.array(bound)]
        return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in self.schema.split(", ")])


def _nearest(vectors: DataFrame, queries: DataFrame, parts: DataFrame, job: _Job, block: int) -> DataFrame:
    """(query_id, vec_id, score): each query's k + 1 nearest in each part of each region."""
    left = vectors.join(parts, "region").withColumn("part", F.pmod(F.xxhash64("print"), "parts").cast("int"))
    right = queries.join(parts, "region").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    both = left.drop("parts").unionByName(right.drop("parts")).select("region", "part", "side", "code", "print", "ids", "embedding", "codes", "bound")
    both = both.repartition("region", "part").sortWithinPartitions("region", "part", "side", "code", "print")
    return both.mapInArrow(_compare(job.k), "query_id long, vec_id long, score double")


class _Part:
    """The vectors of one part of a region, by bucket."""

    def __init__(self, codes: list, prints: list, ids: list, vectors: list, most: int):
        code, print_, x = np.concatenate(codes), np.concatenate(prints), np.concatenate(vectors)
        new = np.append(True, (code[1:] != code[:-1]) | (print_[1:] != print_[:-1]))
        group = np.cumsum(new) - 1
        self.ids, many = _least_ids(np.repeat(group, np.concatenate([n for _, n in ids])), np.concatenate([i for i, _ in ids]), most)
        self.first = np.concatenate([[0], np.cumsum(many)])
        self.x, code = x[new], code[new]
        self.unit = _unit(self.x).astype(np.float32) if len(self.x) < 4096 else np.concatenate([_unit(self.x[i : i + 4096]).astype(np.float32) for i in range(0, len(self.x), 4096)])
        self.start = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        self.code, self.end = code[self.start], np.append(self.start[1:], len(code))

    def answers(self, q: np.ndarray, codes: list[np.ndarray], bound: np.ndarray, k: int, area: int = 1 << 22) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, vector, cosine) of each query's k + 1 nearest in the buckets it looks into."""
        unit = _unit(q).astype(np.float32)
        floor = (bound - SLACK).astype(np.float32)
        every = np.concatenate(codes)
        who = np.repeat(np.arange(len(q)), [len(c) for c in codes])
        order = np.argsort(every, kind="stable")
        every, who = every[order], who[order]
        at = np.searchsorted(every, self.code)
        stop = np.searchsorted(every, self.code, side="right")
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        hits: list[tuple] = []
        held = 0
        for b in np.flatnonzero(stop > at):
            s, e = int(self.start[b]), int(self.end[b])
            mine = who[at[b] : stop[b]]
            step = max(1, area // (e - s))
            for i in range(0, len(mine), step):
                some = mine[i : i + step]
                near = unit[some] @ self.unit[s:e].T
                qi, vi = np.nonzero(near >= floor[some][:, None])
                hits.append((some[qi], vi + s))
                held += len(qi)
                if held >= area // 4:
                    best, hits, held = self._ranked(q, best, hits, k), [], 0
        return self._ranked(q, best, hits, k)

    def _ranked(self, q: np.ndarray, best: tuple, hits: list, k: int, step: int = 1 << 15) -> tuple:
        qi = np.concatenate([h[0] for h in hits] or [np.zeros(0, np.int64)])
        vi = np.concatenate([h[1] for h in hits] or [np.zeros(0, np.int64)])
        score = [cosine(q[qi[i : i + step]].astype(np.float64), self.x[vi[i : i + step]].astype(np.float64)) for i in range(0, len(qi), step)]
        qi, vi, score = np.concatenate([best[0], qi]), np.concatenate([best[1], vi]), np.concatenate([best[2], *score])
        order = np.lexsort((self.ids[self.first[vi]], -score, qi))
        qi, vi, score = qi[order], vi[order], score[order]
        first = np.flatnonzero(np.append(True, qi[1:] != qi[:-1])[: len(qi)])
        place = np.arange(len(qi)) - np.repeat(first, np.diff(np.append(first, len(qi))))
        keep = place <= k
        return qi[keep], vi[keep], score[keep]


def _compare(k: int, step: int = 4096):
    """Batches sorted by region, part and side: the vectors of a part, by bucket, then its queries, some at a time."""

    def run(batches):
        import pyarrow as pa

        def solve(part: _Part, names: list, rows: list, codes: list, bound: list):
            q, name = np.concatenate(rows), np.concatenate(names)
            qi, vi, score = part.answers(q, codes, np.concatenate(bound), k)
            many = part.first[vi + 1] - part.first[vi]
            who, s = np.repeat(name[qi], many), np.repeat(score, many)
            ids = part.ids[np.repeat(part.first[vi] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())] if len(vi) else np.zeros(0, np.int64)
            other = ids != who
            if other.any():
                yield pa.RecordBatch.from_arrays([pa.array(who[other]), pa.array(ids[other]), pa.array(s[other])], names=["query_id", "vec_id", "score"])

        key, part, held, asked = None, None, ([], [], [], []), ([], [], [], [])
        for batch in batches:
            if not len(batch):
                continue
            marks = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)], axis=1)
            change = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *change], [*change, len(marks)], strict=True):
                if (marks[a][0], marks[a][1]) != key:
                    if asked[0]:
                        yield from solve(part, *asked)
                    key, part, held, asked = (marks[a][0], marks[a][1]), None, ([], [], [], []), ([], [], [], [])
                rows = batch.slice(a, b - a)
                x = rows.column(6).flatten().to_numpy(zero_copy_only=False).reshape(b - a, -1)
                ids = rows.column(5)
                if marks[a][2] == 0:
                    new = rows.column(3).to_numpy(), rows.column(4).to_numpy(), (ids.flatten().to_numpy(), ids.value_lengths().to_numpy()), x.copy()
                    for h, v in zip(held, new, strict=True):
                        h.append(v)
                    continue
                if not held[0] and part is None:
                    continue  # no vectors here
                if part is None:
                    part, held = _Part(*held, k + 1), ([], [], [], [])
                for i in range(0, b - a, step):
                    codes = [np.frombuffer(c, "<u4") if len(c) else part.code for c in rows.column(7).slice(i, step).to_pylist()]
                    asked[0].append(ids.slice(i, step).flatten().to_numpy())
                    asked[1].append(x[i : i + step].copy())
                    asked[2].extend(codes)
                    asked[3].append(rows.column(8).slice(i, step).to_numpy())
                    if len(asked[2]) >= step:
                        yield from solve(part, *asked)
                        asked = ([], [], [], [])
        if asked[0]:
            yield from solve(part, *asked)

    return run


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; scaled first only where squares would leave its range."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore", divide="ignore"):
        out = (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
    size = np.concatenate([np.abs(a).max(axis=1), np.abs(b).max(axis=1)]) if len(a) else np.zeros(0)
    if len(size) and (size.max() > 1e100 or size.min() < 1e-100):
        out = (_unit(a) * _unit(b)).sum(axis=1)
    return out
