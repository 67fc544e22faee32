import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from termloom.llm import induced, line_chunks, mixing, neardup, packing, pseudonyms, repeats, tokens
from termloom.llm.support import Cut, components

from conftest_llm import prose, table


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)]
    up = {n: n for e in edges for n in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    got = dict(map(tuple, components(Cut(spark), spark.createDataFrame(edges, "a long, b long")).distinct().collect()))
    assert got == {n: find(n) for e in edges if e[0] != e[1] for n in e}
    assert components(Cut(spark), spark.createDataFrame([], "a long, b long")).count() == 0


# ---- pseudonyms ----
def test_pseudonyms_keep_formats_and_links(spark):
    text = "card 4111 1111 1111 1111 ssn 123-45-6789 on 1984-02-29 call +1 (212) 555-0100 from 10.0.0.1 by ab.c9@ex.org GB82 WEST 1234 5698 7654 32"
    out = table(spark, [(1, text, "a"), (2, "again 4111 1111 1111 1111", "a"), (3, "bad 4111 1111 1111 1112 and 999.1.1.1 and 2021-02-30 and 000-12-3456", "a")])
    got = {r["doc_id"]: r for r in pseudonyms.pseudonymize(out, "demo-key").collect()}
    new = got[1]["text"]
    assert re.sub("[0-9]", "9", re.sub("[A-Za-z]", "a", new.replace("+1", ""))).startswith("aaaa 9999 9999 9999 9999 aaa 999-99-9999 aa 9999-99-99 aaaa  (999) 999-9999")
    assert got[1]["n_pseudonyms"] == 7
    card = re.search(r"card ([0-9 ]{19})", new)[1]
    assert card != "4111 1111 1111 1111" and card in got[2]["text"]
    digits = [int(d) for d in card if d != " "]
    assert sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10 == 0
    assert got[3]["text"] == "bad 4111 1111 1111 1112 and 999.1.1.1 and 2021-02-30 and 000-12-3456" and got[3]["n_pseudonyms"] == 0
    iban = re.search(r"GB[0-9]{2}(?: \w{4}){4} \w\w$", new)[0].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1 and "@ex.org" in new


def test_feistel_is_a_bijection(spark):
    for radices in ([7, 5], [3, 4, 5], [10, 10], [8]):
        n = int(np.prod(radices))
        values = [[int(x) for x in np.unravel_index(i, radices)] for i in range(n)]
        df = spark.createDataFrame([(v,) for v in values], "v array<long>")
        out = df.select(pseudonyms.feistel(F.col("v"), F.array(*[F.lit(r).cast("long") for r in radices]), "key", F.lit("t")).alias("w")).collect()
        assert len({tuple(r["w"]) for r in out}) == n
        assert all(0 <= x < m for r in out for x, m in zip(r["w"], radices, strict=True))


def test_pseudonyms_of_odd_rows(spark, awkward, nothing):
    out = pseudonyms.pseudonymize(awkward, "demo-key")
    assert set(awkward.columns) | {"n_pseudonyms"} == set(out.columns)
    key = lambda df: sorted((str(r["doc_id"]), str(r["text"])) for r in df.collect())
    assert key(out) == key(awkward)
    assert pseudonyms.pseudonymize(nothing, "demo-key").count() == 0


# ---- line chunks ----
def brute_lines(rows, divisor=3, min_lines=2):
    def chunks(text):
        ls = text.split("\n")
        h = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in ls]
        starts = [i for i in range(len(ls)) if i == 0 or (i >= 2 and (h[i - 2] * 8191 + h[i - 1]) % divisor == 0)]
        return ls, [(s, e, "\n".join(ls[s:e])) for s, e in zip(starts, [*starts[1:], len(ls)], strict=True)]

    seen, keyed = defaultdict(set), {(d if d is not None else -(2**63) + 1, t) for d, t in rows if t is not None}
    for d, t in keyed:
        for s, e, c in chunks(t)[1]:
            if e - s >= min_lines:
                seen[c].add((d, t, s))
    first = {c: min((d, s) for d, _, s in at) for c, at in seen.items()}
    out = []
    for d, t in rows:
        if t is None:
            out.append((d, None))
            continue
        ls, cs = chunks(t)
        k = d if d is not None else -(2**63) + 1
        keep = []
        for s, e, c in cs:
            gone = e - s >= min_lines and rows_with(c, rows, chunks) > 1 and first[c] != (k, s)
            keep += [] if gone else ls[s:e]
        out.append((d, "\n".join(keep)))
    return out


def rows_with(chunk, rows, chunks):
    return sum(c == chunk for _, t in rows if t is not None for _, _, c in chunks(t)[1])


def test_line_chunks_equal_brute_force(spark, awkward, nothing):
    r = random.Random(5)
    lines = [prose(i, 10) for i in range(12)]
    rows = [(i, "\n".join(r.choice(lines) for _ in range(r.randint(1, 30)))) for i in range(40)]
    passage = "\n".join(prose(500 + i, 9) for i in range(12))
    rows += [(100 + i, prose(700 + i, 9) + "\n" + passage + "\n" + prose(800 + i, 9)) for i in range(5)]
    rows += [(x["doc_id"], x["text"]) for x in awkward.collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    rows += [(200, "a\nb\n\nc"), (201, "a\nb\n\nc")]  # short lines
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for digits in (2, 32):  # with short fingerprints, which many chunks share, and whole ones
        got = [(x["row"]["doc_id"], x["text"]) for x in line_chunks.deduplicate(spark, df, digits=digits).collect()]
        assert Counter(got) == Counter(brute_lines(rows))
    # The shared passage is gone but for ends that chunks of neighbours hold.
    assert all(len(t) < len(dict(rows)[d]) for d, t in got if d is not None and 100 < d < 200)
    assert line_chunks.deduplicate(spark, nothing).count() == 0


# ---- near-duplicates ----
def brute_classes(rows, threshold=0.8):
    def weights(text):
        w = re.findall(r"\w+", (text or "").lower())
        return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])

    def jp(a, b):
        return sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in a | b) for d in a if d in b)

    every = [(d, t, weights(t)) for d, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, (d, t, a) in enumerate(every):
        for j in range(i):
            e, u, b = every[j]
            if (a and b and jp(a, b) >= threshold) or (d, t) == (e, u):
                x, y = sorted((find(i), find(j)))
                up[y] = x
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("block, most", [(2048, 4_000_000), (4, 4_000_000), (2048, 300), (3, 200)])
def test_classes_equal_brute_force(spark, block, most):
    r = random.Random(8)
    rows = []
    for g in range(6):
        base = prose(100 + g, 60).split()
        for _ in range(8):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 5])):
                w[r.randrange(len(w))] = prose(r.randrange(10**6), 1)
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows), "a b c d e f " * 6), (len(rows) + 1, "a b c d e f " * 12), (len(rows) + 2, None), (len(rows) + 3, ""), (len(rows) + 4, "??"), (len(rows) + 5, "two words"), (len(rows) + 6, "Two, words!")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = defaultdict(set)
    for x in neardup.classes(spark, df, block=block, most=most).collect():
        got[x["class_id"]].add(x["doc_id"])
    assert {frozenset(g) for g in got.values()} == brute_classes(rows)
    assert all(c == min(g) for c, g in got.items())


def jobs_of(spark, rows, **options):
    group = f"jobs-{len(rows)}-{random.random()}"
    spark.sparkContext.setJobGroup(group, group)
    found = neardup.classes(spark, spark.createDataFrame(rows, "doc_id long, text string"), **options).collect()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len({x["class_id"] for x in found}), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_stages_do_not_grow_with_a_template(spark):
    """Texts of three quarters template and a quarter of their own, no pair at 0.8: no round a leader."""
    template = prose(4242, 120)
    rows = [(i, f"{template} {prose(9000 + i, 40)}") for i in range(400)]
    few, many = (jobs_of(spark, rows[:n], block=8) for n in (50, 400))
    assert few[0] == 50 and many[0] == 400
    assert abs(few[1] - many[1]) <= 12  # adaptive execution splits or joins a few jobs, none is a round


def test_prefixes_rule_out_no_similar_pair():
    r = random.Random(12)
    met = 0
    for _ in range(3000):
        base = Counter(r.randrange(40) for _ in range(r.randint(1, 60)))
        other = base.copy()
        for _ in range(r.choice([0, 1, 2, 8])):
            other[r.randrange(60)] += r.choice([1, 1, 5])
        pair = []
        for x in (base, other):
            h = np.sort(neardup.mix(np.array(sorted(x), np.uint64)))
            back = {int(neardup.mix(np.array([k], np.uint64))[0]): n for k, n in x.items()}
            pair.append((h, np.array([back[int(k)] for k in h])))
        counts = np.random.default_rng(r.randrange(99)).integers(1, 4, neardup.CELLS) if met % 500 == 0 else counts
        near = [set(h[neardup.prefix(h.view(np.int64), w, counts, 0.8)].tolist()) for h, w in pair]
        if neardup.similarity(*pair[0], *pair[1]) >= 0.8:
            met += 1
            assert near[0] & near[1]
    assert met > 1000


def test_words_of_long_texts_and_unspaced_scripts(monkeypatch):
    texts = [prose(7, 500), "", "x" * 400, "漢字かな กขค", "a  b", "é" * 50]
    want = neardup.words(texts)
    for piece in (1, 16, 100):
        monkeypatch.setattr(neardup, "PIECE", piece)
        got = neardup.words(texts)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
    assert np.diff(want[1]).tolist() == [500, 0, 1, 7, 2, 1]


def test_similarity_is_the_definition():
    r = random.Random(1)
    for _ in range(100):
        a, b = (Counter(r.randrange(12) for _ in range(r.randint(1, 30))) for _ in range(2))
        want = sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in a | b) for d in a if d in b)
        arrays = [(np.array(sorted(x), np.uint64), np.array([x[k] for k in sorted(x)])) for x in (a, b)]
        assert abs(neardup.similarity(*arrays[0], *arrays[1]) - want) < 1e-9


def test_signatures_estimate_similarity():
    h = neardup.mix(np.arange(80, dtype=np.uint64))
    w = np.arange(80) % 3 + 1
    found = []
    for seed in range(20):
        a = neardup.mix(h[:60] + np.uint64(seed)), w[:60]
        b = neardup.mix(h[10:70] + np.uint64(seed)), w[10:70]
        sig = neardup.signatures(np.repeat([0, 1], 60), np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]]), 2, 128)
        oa, ob = np.argsort(a[0]), np.argsort(b[0])
        found.append((np.mean(sig[0] == sig[1]), neardup.similarity(a[0][oa], a[1][oa], b[0][ob], b[1][ob])))
    assert abs(np.mean([x for x, _ in found]) - np.mean([y for _, y in found])) < 0.04


def test_near_duplicates_of_odd_rows(spark, awkward, nothing):
    out = neardup.deduplicate(spark, awkward)
    assert out.columns == awkward.columns
    got = Counter((r["doc_id"], hash(r["text"])) for r in out.collect())
    assert max(got.values()) == 1
    ids = Counter(d for d, _ in got)
    assert ids[1] == 1 and ids[2] == 0 and ids[3] == 1  # the copies of 1 go, in whatever case
    assert all(ids[d] == 1 for d in (4, 5, 6, 7, 8, 9, 10)) and ids[None] == 2
    assert neardup.deduplicate(spark, nothing).count() == 0 and neardup.classes(spark, nothing).count() == 0


# ---- mixing ----
def test_mixing_meets_targets(spark):
    r = random.Random(2)
    rows = [(i, prose(i, r.randint(1, 40)), f"s{min(r.randrange(12), 5)}") for i in range(1500)] + [(5000 + i, prose(i, 20), None) for i in range(40)]
    out = mixing.mix(spark, table(spark, rows), rows_per_bucket=100).collect()
    assert len(out) == len(rows) and all(x["taken"] in (0, x["size"], 2 * x["size"], 3 * x["size"]) for x in out)
    total, sources = sum(x["size"] for x in out), defaultdict(lambda: [0, 0, 0.0])
    for x in out:
        s = sources[x["source"]]
        s[0], s[1], s[2] = s[0] + x["size"], s[1] + x["taken"], x["target"]
    # targets by the iteration that the closed form stands for
    names = sorted(sources, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    want, open_, left = {}, set(names), float(total)
    while True:
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sources[s][0]}
        if not over:
            want |= share
            break
        for s in over:
            want[s] = 3.0 * sources[s][0]
            left -= want[s]
        open_ -= over
    for s in names:
        assert abs(sources[s][2] - want[s]) < 1e-6 * total
        assert abs(sources[s][1] - want[s]) <= 60
    assert abs(sum(x["taken"] for x in out) - total) <= 60
    again = mixing.mix(spark, table(spark, rows[::-1]), rows_per_bucket=700).collect()
    key = lambda rs: sorted((x["doc_id"], x["size"], x["taken"]) for x in rs)
    assert key(out) == key(again)


def test_mixed_rows(spark, awkward, nothing):
    taken = mixing.mix(spark, awkward)
    rows = mixing.mixed(spark, awkward)
    assert rows.columns == awkward.columns
    want = taken.where("size > 0").agg(F.sum("taken")).first()[0]
    assert rows.select(F.sum(mixing.word_count(F.col("text")))).first()[0] == want
    assert taken.count() == awkward.count() and mixing.mix(spark, nothing).count() == 0 and mixing.mixed(spark, nothing).count() == 0
    assert mixing.mix(spark, awkward.where("text is null or trim(text) = ''")).agg(F.sum("taken")).first()[0] == 0


# ---- packing ----
def check_packed(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("capacity", [1024, 16])
def test_packing_places_every_token(spark, awkward, nothing, capacity):
    rows = packing.pack(spark, awkward, capacity, rows_per_bucket=5, buckets_per_run=2).collect()
    ids = tokens.encoder(tokens.default_path())
    want = Counter()
    for r in awkward.collect():
        x = [*ids.tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        first = (len(x) - 1) % capacity + 1
        for k, end in enumerate(range(first, len(x) + 1, capacity)):
            at = max(0, end - capacity)
            want[r["doc_id"], k, at, end - at, zlib.crc32(np.array(x[at:end], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    assert check_packed(rows, capacity) <= -(-sum(r["length"] for r in rows) // capacity) + 2
    assert packing.pack(spark, nothing).count() == 0


def test_plans_are_near_the_bound():
    r = np.random.default_rng(4)
    for lengths in (np.minimum(1023, r.lognormal(5.8, 1, 20_000).astype(int) + 1), np.r_[np.full(7000, 300), r.integers(1, 1024, 14_000)], np.array([1024, 1, 1023, 512, 512])):
        sizes, counts = np.unique(lengths, return_counts=True)
        plan = packing.best_plan(dict(zip(sizes.tolist(), counts.tolist(), strict=True)), 1024, (16, 24))
        used, placed = np.zeros(plan.n, int), Counter()
        for length, _, n, sequence, _ in plan.segments:
            used[sequence : sequence + n] += length
            placed[length] += n
        assert used.max() <= 1024 and placed == dict(zip(sizes.tolist(), counts.tolist(), strict=True))
        assert plan.n <= 1.04 * -(-lengths.sum() // 1024) + 1


@pytest.mark.parametrize("span, keep", [(1 << 20, 300_000), (7, 3)])
def test_ids_are_those_of_whole_texts(span, keep):
    e = tokens.Encoder(tokens.default_path(), keep, span)
    r = random.Random(6)
    odd = [chr(c) for c in [*range(0x530), 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF, 0x4E00, 0x1F642, 0x301, 0x663]]
    pool = odd + list(" \t\n\r'stllabcXYZ019.,!?-éß") * 8 + ["  ", "'ll", " the", "<|endoftext|>"]
    texts = odd + [f"a{c}b {c}{c} 1{c}" for c in odd] + ["".join(r.choice(pool) for _ in range(r.randint(1, 60))) for _ in range(3000)] + ["<|endoftext|> x", "  \n\n a\t b  ", "漢字 🙂", ""]
    for t, got in zip(texts, e.encode(texts), strict=True):
        assert got.tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)
    assert len(e.known) <= keep


def test_long_blank_runs_are_packed(spark):
    rows = [(1, " " * 2_000_000 + "x"), (2, "\n" * 2_000_000 + "x"), (3, "x" * 1_000_000), (4, "a \u3000" * 100_000)]
    got = defaultdict(list)
    for r in packing.pack(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"]))
    slow = tokens.encoder(tokens.default_path()).tokenizer
    for d, t in rows:
        ids = np.array([*slow.encode(t, add_special_tokens=False).ids, 2], "<u4")
        assert sorted(got[d]) == [(a, n, zlib.crc32(ids[a : a + n].tobytes())) for a, n, _ in sorted(got[d])] and sum(n for _, n, _ in got[d]) == len(ids)


# ---- repeated strings ----
def brute_repeats(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        out.append((len(t), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + (gone[0])), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("alphabet", ["ab", "abcdefghijklmnop"])
def test_repeats_equal_brute_force(spark, alphabet, monkeypatch):
    r = random.Random(len(alphabet))
    letters = lambda n: "".join(r.choice(alphabet) for _ in range(n))
    shared = [letters(n) for n in (29, 30, 31, 60, 200)]
    rows = [(i, letters(r.randint(0, 50)) + "".join(r.choice(shared) + letters(r.randint(0, 5)) for _ in range(r.randint(0, 4)))) for i in range(60)]
    rows += [(70, letters(1) * 500), (71, None), (72, ""), (73, shared[4]), (73, shared[4]), (None, shared[3] + "é" * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for piece, shard, memory in ((repeats.PIECE, 1 << 20, 1 << 18), (64, 4000, 20), (repeats.PIECE, 80, 5)):
        monkeypatch.setattr(repeats, "PIECE", piece)
        got = repeats.remove(spark, df, length=30, k=12, shard=shard, memory=memory).collect()
        want = Counter((d, *x) for (d, _), x in zip(rows, brute_repeats([(t or "").encode() for _, t in rows], 30), strict=True))
        assert Counter((x["doc_id"], x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in got) == want


def test_repeats_of_odd_rows(spark, awkward, nothing):
    got = Counter((x["doc_id"], x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in repeats.remove(spark, awkward).collect())
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in awkward.collect()]
    assert got == Counter((d, *x) for (d, _), x in zip(rows, brute_repeats([t for _, t in rows], 200), strict=True))
    assert repeats.remove(spark, nothing).count() == 0


def plain_suffixes(t):
    order = sorted(range(len(t)), key=lambda i: t[i:].tolist())
    common = [0]
    for a, b in zip(order, order[1:], strict=False):
        x, y = t[a:].tolist(), t[b:].tolist()
        common.append(next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y))))
    return order, common


@pytest.mark.parametrize("queues", [512, 3])
@pytest.mark.parametrize("memory", [2, 7, 1 << 19])
def test_suffix_order(memory, queues, monkeypatch):
    """Orders and carried common prefixes; with few tuples in memory queues go to files and the recursion to its end."""
    monkeypatch.setattr(induced, "QUEUES", queues)
    before = induced.SPILLED
    r = np.random.default_rng(memory)
    for n in (1, 2, 3, 7, 40, 150):
        for a in (1, 2, 3, 30, 250):
            for kind in range(4):
                t = r.integers(0, a, n)
                t = np.tile(t[: max(1, n // 5)], 6)[:n] if kind == 1 else np.repeat(t, 3)[:n] if kind == 2 else t
                order, common = induced.suffix_order(t.astype(np.uint8) if kind % 2 else t, memory)
                assert (order.tolist(), common.tolist()) == plain_suffixes(t)
    assert (induced.SPILLED > before) == (memory < 100)


def test_production_shards_go_through_files():
    """A shard of the registered query's size has more tuples than its queues hold."""
    r = np.random.default_rng(2)
    words = [bytes(r.integers(97, 123, r.integers(2, 9)).astype(np.uint8)) for _ in range(3000)]
    text = b" ".join(words[i] for i in r.integers(0, 3000, 260_000))[: 1 << 20]
    before = induced.SPILLED
    order, common = induced.suffix_order(np.frombuffer(text, np.uint8))
    assert induced.SPILLED > before and (np.bincount(order, minlength=len(text)) == 1).all()
    for i in r.integers(1, len(text), 500):
        a, b, n = int(order[i - 1]), int(order[i]), int(common[i])
        assert text[a : a + n] == text[b : b + n] and text[a + n : a + n + 1] < text[b + n : b + n + 1]
