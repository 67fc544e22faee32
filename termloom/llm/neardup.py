"""Near-duplicate classes by ProbMinHash signatures of weighted word shingles, banding and exact verification."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .support import Cut, components, packed

U64 = np.uint64
#: Odd multiplier of the byte polynomial, and its inverse modulo 2**64.
BYTE_P = 0x9E3779B97F4A7C15
BYTE_Q = pow(BYTE_P, -1, 1 << 64)
PUNCTUATION = re.compile("[\u00a0-\u00bf\u2000-\u206f\u3000-\u303f]+")
#: Letters of scripts that are written without blanks, each of which counts as a word.
UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])")
WORD_BYTE = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (splitmix64's finalizer)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_POWERS: dict[int, np.ndarray] = {}
#: Powers that a worker keeps, and bytes whose words are hashed together.
KEPT = PIECE = 1 << 20


def powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n - 1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base % 2**64, U64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 2 * KEPT:
            _POWERS[base] = have
    return have[:n]


def _word_hashes(data: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of bytes that end outside a word."""
    edge = np.diff(is_word.astype(np.int8), prepend=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * powers(BYTE_P, len(data)), out=total[1:])
    return start, mix((total[end] - total[start]) * powers(BYTE_Q, len(data))[start])


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the first word's place of each text, with the number of words at the end. Bytes are taken
    in pieces that end between words, so a long text costs eight bytes a word, not tens a byte."""
    raws = []
    for t in texts:
        t = t.lower()
        if not t.isascii():
            t = UNSPACED.sub(r" \1 ", PUNCTUATION.sub(" ", t))
        raws.append(t.encode("utf-8", "replace") + b" ")
    data = np.frombuffer(b"".join(raws), np.uint8)
    ends = np.cumsum([len(r) for r in raws])
    is_word = WORD_BYTE[data]
    starts, hashes, at = [], [], 0
    while at < len(data):
        stop = min(len(data), at + PIECE)
        if stop < len(data):
            gaps = np.flatnonzero(~is_word[at:stop])
            stop = at + int(gaps[-1]) + 1 if len(gaps) else stop + int(np.argmin(is_word[stop:])) + 1
        start, h = _word_hashes(data[at:stop], is_word[at:stop])
        starts.append(start + at)
        hashes.append(h)
        at = stop
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return np.concatenate(hashes) if hashes else np.zeros(0, U64), np.searchsorted(start, np.concatenate([[0], ends]))


def shingles(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text index, hash, weight) of the distinct shingles of texts, sorted, and 128-bit prints of their word sequences.

    A shingle is `size` words in sequence, or all words of a text that has fewer; its weight is its number."""
    w, first = words(texts)
    count = np.diff(first)
    owner = np.repeat(np.arange(len(texts)), count)
    inner = np.arange(len(w)) - first[owner]
    prints = np.zeros((len(texts), 2), U64)
    has = np.flatnonzero(count)
    if len(has):
        for j, base in enumerate((0xD6E8FEB86659FD93, 0xA0761D6478BD642F)):
            prints[has, j] = np.add.reduceat(mix(w + U64(j + 1)) * powers(base, int(count.max()))[inner], first[has])
    full = inner <= count[owner] - size
    at = np.flatnonzero(full)
    h = np.zeros(len(at), U64)
    for j in range(size):
        h += w[at + j] * U64((0xC2B2AE3D27D4EB4F * (2 * j + 1) + 2 * j) % 2**64 | 1)
    short = np.flatnonzero((count > 0) & (count < size))
    h = mix(np.concatenate([h, prints[short, 0] + U64(5)]))
    who = np.concatenate([owner[at], short])
    order = np.lexsort((h, who))
    h, who = h[order], who[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (who[1:] != who[:-1])
    place = np.flatnonzero(new)
    weight = np.diff(np.append(place, len(h)))
    return who[place], h[place], weight, prints


def signatures(who: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int, registers: int) -> np.ndarray:
    """ProbMinHash: each element's arrivals are a Poisson process of its weight's rate, each at a random register; a
    register keeps its earliest arrival's element. An element ends once its arrivals come later than every register of
    its text, so its cost doesn't depend on the number of registers for long."""
    best, sig = np.full((n, registers), np.inf), np.zeros((n, registers), U64)
    t, k = np.zeros(len(h)), 0
    flat_best, flat_sig = best.ravel(), sig.ravel()
    while len(h):
        k += 1
        r = mix(h + U64((k * 0x9E3779B97F4A7C15) % 2**64))
        u = ((r >> U64(11)).astype(np.float64) + 1.0) * 2.0**-53
        t = t - np.log(u) / weight
        place = who * registers + (mix(r) % U64(registers)).astype(np.int64)
        old = flat_best[place]
        soon = t < old
        p, ts = place[soon], t[soon]
        np.minimum.at(flat_best, p, ts)
        won = flat_best[p] == ts
        flat_sig[p[won]] = h[soon][won]
        go = t < best.max(axis=1)[who]
        who, h, weight, t = who[go], h[go], weight[go], t[go]
    return sig


def similarity(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Probability Jaccard of two weighted sets (sorted hashes and weights): the sum, over common elements d, of
    1 / sum over all elements e of max(x_e / x_d, y_e / y_d)."""
    if len(x) == 0 or len(y) == 0:
        return 0.0
    common, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if len(common) == 0:
        return 0.0
    u, v = x[i].astype(float), y[j].astype(float)
    ratio = u / v
    order = np.argsort(-ratio, kind="stable")
    u, v, ratio = u[order], v[order], ratio[order]
    # Elements of one set alone have an infinite or zero ratio; equal ratios count on x's side.
    above = (x.sum() - u.sum()) + np.cumsum(u)
    last = np.searchsorted(-ratio, -ratio, side="right") - 1
    below = (y.sum() - v.sum()) + (v.sum() - np.cumsum(v)[last])
    return float((1 / (above[last] / u + below / v)).sum())


def runs(texts, bound: int = 1 << 20):
    """Slices of a column of texts of at most about `bound` bytes together."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > bound:
            yield start, i
            start, held = i, 0
        held += int(n) + 1
    if start < len(sizes):
        yield start, len(sizes)


def _signed(x: np.ndarray):
    import pyarrow as pa

    return pa.array(np.ascontiguousarray(x).view(np.int64))


def classes(
    spark: SparkSession,
    docs: DataFrame,
    words_: int = 5,
    threshold: float = 0.8,
    bands: int = 25,
    rows: int = 5,
    block: int = 2048,
    most: int = 4_000_000,
    broadcast_rows: int = 500_000,
) -> DataFrame:
    """(doc_id, key, class_id, class_key) for each row of docs(doc_id, text), key being xxhash64(text): the smallest
    (doc_id, key) of the documents that are linked to it by a chain of probability Jaccard `threshold` or more.

    Texts alike but for case and punctuation are one class from the start, and only one of them goes on. Signatures of
    bands * rows registers are cut into bands; texts that share a band are candidates (a pair at 0.8 is missed once in
    20,000). They are verified exactly: first each text with the smallest text of its buckets. Buckets that then still
    hold several classes are gathered by their smallest class, and each text outside its gathering's largest class is
    compared with all others of other classes at once, through an index of shingles. A task holds at most some `block` texts
    and `most` shingles: of larger gatherings, texts without a rare shingle in common with another class go, by an exact
    bound, and the rest meet in a grid of blocks, part i against part j. The number of stages doesn't depend on sizes, every
    pair in a bucket is verified, ruled out by the bound or inside one class, and no group of copies is expanded into its pairs.

    A word is a run of letters and digits; of scripts without blanks, a letter. Null, empty and wordless texts are classes of
    their own for each doc_id and text; rows equal in both fall in one
    class; null doc_id counts as the smallest; an empty table gives an empty result; other columns are not looked at.
    """
    cut = Cut(spark)
    rows_ = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).alias("key"), docs["text"].alias("text"))

    def sign(batches):
        import pyarrow as pa

        for batch in batches:
            for a, b in runs(batch.column(2)):
                part = batch.slice(a, b - a)
                who, h, weight, prints = shingles([t or "" for t in part.column(2).to_pylist()], words_)
                sig = signatures(who, h, weight, len(part), bands * rows).reshape(len(part), bands, rows)
                code = np.zeros((len(part), bands), U64)
                for j in range(rows):
                    code = mix(code * U64(3) + sig[:, :, j])
                code = mix(code + np.arange(1, bands + 1, dtype=U64))
                n = np.bincount(who, minlength=len(part))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, code.size + 1, bands, dtype=np.int32)), _signed(code.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), _signed(prints[:, 0]), _signed(prints[:, 1]), pa.array(n.astype(np.int32)), flat], names=["doc_id", "key", "p1", "p2", "n", "bands"])

    signed = rows_.mapInArrow(sign, "doc_id long, key long, p1 long, p2 long, n int, bands array<long>")
    signed = cut(signed.withColumn("node", F.when(F.col("n") > 0, F.concat(F.unhex(F.lpad(F.hex("p1"), 16, "0")), F.unhex(F.lpad(F.hex("p2"), 16, "0"))))).drop("p1", "p2"))
    # One text of each print: the rest are its copies.
    reps = signed.where("node is not null").groupBy("node").agg(F.min(F.struct("doc_id", "key")).alias("at"), F.first("bands").alias("bands"), F.max("n").alias("n"))
    live = reps.select("node", F.explode("bands").alias("bucket"))
    leaders = live.groupBy("bucket").agg(F.min("node").alias("lead"), F.count("*").alias("n")).where("n > 1")
    live = cut(live.join(leaders, "bucket").select("bucket", "node", "lead"))
    some = live.select("node").distinct()
    wanted = cut(reps.join(some, "node", "left_semi").select("node", "at.doc_id", "at.key", "n"))
    many = wanted.count()
    features = _features(cut, rows_, wanted, words_, many <= broadcast_rows)
    edges = cut(_verified(live.where("node <> lead").groupBy("node").agg(F.min("lead").alias("lead")), features, threshold))
    roots = components(cut, edges)
    placed = live.select("bucket", "node").join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("class"))
    open_ = placed.groupBy("bucket").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi").select("bucket", "lo")
    placed = cut(placed.join(open_, "bucket").join(wanted.select("node", "n"), "node").select("bucket", "lo", "node", "class", "n"))
    if not placed.isEmpty():
        edges = edges.union(cut(_linked(spark, cut, placed, features, threshold, block, most)))
        roots = components(cut, edges)
    named = signed.select("doc_id", "key", "node").join(roots.select("node", "root"), "node", "left")
    named = named.withColumn("group", F.coalesce("root", "node", F.concat(F.lit(b"\x00"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"), F.lit(b"/"), F.col("key").cast("string").cast("binary"))))
    named = cut(named.select("doc_id", "key", "group"))
    first = named.groupBy("group").agg(F.min(F.struct("doc_id", "key")).alias("first"))
    return named.join(first, "group").select("doc_id", "key", F.col("first.doc_id").alias("class_id"), F.col("first.key").alias("class_key"))


def _features(cut: Cut, rows: DataFrame, wanted: DataFrame, size: int, small: bool) -> DataFrame:
    """(node, hashes, weights) of the wanted texts; their table is broadcast only where its counted rows are few."""
    wanted = wanted.select(F.col("node"), F.col("doc_id").alias("id"), F.col("key").alias("k"))
    wanted = F.broadcast(wanted) if small else wanted
    found = rows.join(wanted, rows.doc_id.eqNullSafe(wanted.id) & (rows.key == wanted.k)).select("node", "text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for a, b in runs(batch.column(1)):
                part = batch.slice(a, b - a)
                who, h, weight, _ = shingles(part.column(1).to_pylist(), size)
                bounds = pa.array(np.searchsorted(who, np.arange(len(part) + 1)).astype(np.int32))
                cols = [part.column(0), pa.ListArray.from_arrays(bounds, _signed(h)), pa.ListArray.from_arrays(bounds, pa.array(weight.astype(np.int32)))]
                yield pa.RecordBatch.from_arrays(cols, names=["node", "hashes", "weights"])

    found = found.mapInArrow(run, "node binary, hashes array<long>, weights array<int>")
    return cut(found.dropDuplicates(["node"]))


def _verified(pairs: DataFrame, features: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of the pairs (node, lead) whose similarity is at least threshold."""
    left = features.select(F.col("node").alias("a"), F.col("hashes").alias("ah"), F.col("weights").alias("aw"))
    right = features.select(F.col("node").alias("b"), F.col("hashes").alias("bh"), F.col("weights").alias("bw"))
    both = pairs.join(left, pairs.node == left.a).join(right, pairs.lead == right.b).select("a", "b", "ah", "aw", "bh", "bw")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            lists = []
            for c in range(2, 6):
                col = batch.column(c)
                lists.append((col.values.to_numpy(zero_copy_only=False), col.offsets.to_numpy(zero_copy_only=False)))
            keep = []
            for i in range(len(batch)):
                a, x, b, y = (v[o[i] : o[i + 1]] for v, o in lists)
                keep.append(similarity(a.view(U64), x, b.view(U64), y) >= threshold)
            out = batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
            if len(out):
                yield out

    return both.mapInArrow(run, "a binary, b binary")


def links(classes_: list[bytes], hashes: list[np.ndarray], weights: list[np.ndarray], threshold: float, parts: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs of texts of different classes with similarity `threshold` or more, enough of them to join what is alike; if
    parts are given, pairs of different parts alone."""
    up = list(range(len(classes_)))

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    first: dict[bytes, int] = {}
    for i, c in enumerate(classes_):
        up[i] = find(first.setdefault(c, i))
    size = np.array([len(h) for h in hashes])
    total = np.array([w.sum() for w in weights], np.float64)
    flat, flat_w, owner = np.concatenate(hashes), np.concatenate(weights).astype(np.float64), np.repeat(np.arange(len(size)), size)
    _, ids = np.unique(flat, return_inverse=True)
    order = np.argsort(ids, kind="stable")
    ends = np.cumsum(np.bincount(ids))
    bounds = np.concatenate([[0], np.cumsum(size)])
    root = np.array([find(i) for i in range(len(up))])
    largest = np.bincount(root).argmax()
    out = []
    for x in np.flatnonzero(root != largest):
        mine = ids[bounds[x] : bounds[x + 1]]
        lo = np.where(mine > 0, ends[mine - 1], 0)
        many = ends[mine] - lo
        at = order[np.repeat(lo - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())]
        who, y, own = owner[at], flat_w[at], np.repeat(flat_w[bounds[x] : bounds[x + 1]], many)
        rest = total - np.bincount(who, weights=y, minlength=len(size))
        # An upper bound of the similarity, and its value if all weights are 1.
        bound = np.bincount(who, weights=1 / (total[x] / own + rest[who] / y), minlength=len(size))
        able = bound >= threshold - 1e-9
        for j in np.flatnonzero(able if parts is None else able & (parts != parts[x])):
            if find(x) != find(j) and similarity(np.sort(hashes[x]), weights[x][np.argsort(hashes[x])], np.sort(hashes[j]), weights[j][np.argsort(hashes[j])]) >= threshold:
                up[find(x)] = find(j)
                out.append((int(x), int(j)))
    return out


#: Cells in which shingles are counted to tell rare ones; any order of shingles gives exact results.
CELLS = 1 << 20


def _cells(h: np.ndarray) -> np.ndarray:
    return (h.view(U64) >> U64(44)).astype(np.int64)


def prefix(h: np.ndarray, weight: np.ndarray, counts: np.ndarray, threshold: float) -> np.ndarray:
    """Indices of a text's rarest shingles that hold more than 1 - threshold of its weight. The similarity of two texts is at most
    the sum of the lesser shares of each shingle, so without a prefix shingle in common it is below threshold."""
    order = np.lexsort((h, counts[_cells(h)]))
    share = np.cumsum(weight[order]) / weight.sum()
    return order[: int(np.searchsorted(share, 1 - threshold + 1e-9, side="right")) + 1]


def _lists(batch, columns: tuple) -> list:
    return [(batch.column(c).values.to_numpy(zero_copy_only=False), batch.column(c).offsets.to_numpy(zero_copy_only=False)) for c in columns]


def _able(spark: SparkSession, cut: Cut, members: DataFrame, features: DataFrame, threshold: float) -> DataFrame:
    """The rows of members(group, node, class, n) with a prefix shingle that another class of their group has in its prefix too."""

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            cells, n = np.unique(_cells(batch.column(0).flatten().to_numpy(zero_copy_only=False)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(n)], names=["cell", "n"])

    texts = features.join(members.select("node").distinct(), "node", "left_semi")
    found = texts.select("hashes").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(CELLS, np.int64)
    counts[found["cell"]] = found["n"]
    held = spark.sparkContext.broadcast(counts)  # CELLS numbers, whatever the input

    def rare(batches):
        import pyarrow as pa

        for batch in batches:
            lists, at, out = _lists(batch, (4, 5)), [], []
            for i in range(len(batch)):
                h, w = (v[o[i] : o[i + 1]] for v, o in lists)
                mine = h[prefix(h, w, held.value, threshold)]
                mine = mine[held.value[_cells(mine)] > 1]  # what one text alone has can't be shared
                at.append(np.full(len(mine), i))
                out.append(mine)
            if out:
                at = pa.array(np.concatenate(at))
                cols = [batch.column(c).take(at) for c in range(4)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.concatenate(out))], names=["group", "node", "class", "n", "shingle"])

    full = members.join(features, "node").select("group", "node", "class", "n", "hashes", "weights")
    rows = cut(full.mapInArrow(rare, "group binary, node binary, class binary, n int, shingle long"))
    shared = rows.groupBy("group", "shingle").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi").select("group", "shingle")
    return rows.join(shared, ["group", "shingle"]).select("group", "node", "class", "n").distinct()


def _linked(spark: SparkSession, cut: Cut, placed: DataFrame, features: DataFrame, threshold: float, block: int, most: int) -> DataFrame:
    """(a, b): links between classes within buckets (bucket, lo, node, class, n). Buckets with one smallest class are one
    group if that fits a task, else a group each; groups that don't fit are split by a grid."""
    sized = lambda df, by: df.groupBy(by).agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / most)).cast("int").alias("blocks"))
    large = cut(sized(placed.select("lo", "node", "n").distinct(), "lo").where("blocks > 1").select("lo", "blocks"))
    keyed = placed.join(large, "lo", "left")
    keyed = keyed.withColumn("group", F.when(F.col("blocks").isNotNull(), F.concat("lo", F.col("bucket").cast("string").cast("binary"))).otherwise(F.col("lo")))
    keyed = cut(keyed.select("group", "node", "class", "n").distinct())
    large = cut(sized(keyed, "group").where("blocks > 1").select("group"))
    zero = F.lit(0).alias
    if large.isEmpty():
        units = keyed.select("group", "node", "class", zero("i"), zero("j"), zero("part"))
    else:
        units = keyed.join(large, "group", "left_anti").select("group", "node", "class", zero("i"), zero("j"), zero("part"))
        able = cut(_able(spark, cut, keyed.join(large, "group", "left_semi"), features, threshold))
        split = able.join(cut(sized(able, "group")), "group").withColumn("part", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
        split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        units = units.union(split.select("group", "node", "class", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part"))
    full = units.join(features, "node").select("group", "i", "j", "part", "node", "class", "hashes", "weights")

    def run(batches):
        import pyarrow as pa

        def solve(unit: tuple, rows: list) -> list:
            parts = np.array([r[0] for r in rows]) if unit[1] != unit[2] else None
            found = links([r[2] for r in rows], [r[3] for r in rows], [r[4] for r in rows], threshold, parts)
            return [(rows[i][1], rows[j][1]) for i, j in found]

        unit, rows = None, []
        for batch in batches:
            out: list = []
            lists = _lists(batch, (6, 7))
            keys = zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True)
            for at, (group, i, j, *own) in enumerate(keys):
                if (group, i, j) != unit:
                    out += solve(unit, rows) if rows else []
                    unit, rows = (group, i, j), []
                rows.append((*own, *(v[o[at] : o[at + 1]].copy() for v, o in lists)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out, strict=True)], names=["a", "b"])
        out = solve(unit, rows) if rows else []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out, strict=True)], names=["a", "b"])

    return full.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j").mapInArrow(run, "a binary, b binary")


def deduplicate(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that are the first of their class, by doc_id, with all their columns; of equal rows one stays.

    See classes() for nulls, empty texts and ties."""
    cut = Cut(spark)
    named = cut(classes(spark, docs, **options))
    first = named.where(F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("key") == F.col("class_key")))
    kept = cut(first.groupBy("doc_id", "key").agg(F.count("*").alias("copies")))
    own = packed(docs, id=docs["doc_id"].cast("long"), text_key=F.xxhash64(docs["text"]))
    out = own.join(kept, own.id.eqNullSafe(kept.doc_id) & (own.text_key == kept.key))
    if kept.where("copies > 1").isEmpty():
        return out.select("row.*")
    equal = out.where("copies > 1").dropDuplicates(["id", "text_key"])
    return out.where("copies = 1").select("row").union(equal.select("row")).select("row.*")
