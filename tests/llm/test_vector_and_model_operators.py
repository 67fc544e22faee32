import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from conftest_llm import prose, table
from pyspark.sql import functions as F

from termloom.llm import ann, bytecnn, jpeg, sampling, toxicity


# ---- media ----
@pytest.mark.parametrize("make", [lambda n: bytes(n), lambda n: bytes([255]) * n, lambda n: (b"\x00\xff" * n)[:n], lambda n: np.random.default_rng(n).integers(0, 256, n).astype(np.uint8).tobytes()])
def test_payloads_come_back(make):
    payloads = [make(n) for n in (64, 640, 64 * 300)] + [make(64 * (jpeg.MAX_ROWS + 5))]
    for p, s, (width, height, _, thumb) in zip(payloads, streams := jpeg.encode(payloads), jpeg.features(streams), strict=True):
        assert thumb.tobytes() == p and (width, height) == (512, len(p) // 8)
        assert s.startswith(b"\xff\xd8") and s.endswith(b"\xff\xd9")


def test_color_and_ac_values():
    """An image of another layout, written bit by bit: three components, the first sampled 2 x 2, AC values, no restarts."""
    r = random.Random(3)
    dc_sizes, ac_sizes = {k: 4 for k in range(12)}, {0x00: 2, 0x01: 2, 0x02: 3, 0x11: 4, 0xF0: 5}
    dc_counts, dc_symbols, dc_codes = jpeg.canonical(dc_sizes)
    ac_counts, ac_symbols, ac_codes = jpeg.canonical(ac_sizes)
    bits, luma, last = [], [], [0, 0, 0]

    def put(v, n):
        bits.extend((v >> (n - 1 - i)) & 1 for i in range(n))

    def extra(v):
        n = abs(v).bit_length()
        put(v if v >= 0 else v + (1 << n) - 1, n)

    for _ in range(3 * 2):
        for c in (0, 0, 0, 0, 1, 2):
            v = r.randint(-60, 60)
            if c == 0:
                luma.append(v)
            put(*dc_codes[abs(v - last[c]).bit_length()])
            extra(v - last[c])
            last[c] = v
            k = 1
            for _ in range(r.randint(0, 4)):
                s = r.choice([0x01, 0x02, 0x11, 0xF0])
                put(*ac_codes[s])
                if s & 15:
                    extra(r.choice([1, -1]) if s & 15 == 1 else r.choice([2, 3, -2, -3]))
                k += (s >> 4) + 1
            if k < 64:
                put(*ac_codes[0])
    bits += [1] * (-len(bits) % 8)
    scan = bytes(int("".join(map(str, bits[i : i + 8])), 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    seg = jpeg._segment
    data = b"\xff\xd8" + seg(0xFE, b"note") + seg(0xDB, bytes([0]) + bytes([16] * 64)) + seg(0xDB, bytes([1]) + bytes([3] * 64))
    data += seg(0xC0, bytes([8, 0, 30, 0, 44, 3, 1, 0x22, 0, 2, 0x11, 1, 3, 0x11, 1]))
    data += seg(0xC4, bytes([0, *dc_counts, *dc_symbols, 0x10, *ac_counts, *ac_symbols])) + seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + scan + b"\xff\xd9"
    (width, height, print_, thumb), = jpeg.features([data])
    assert (width, height, thumb.shape, len(print_)) == (44, 30, (4, 6), 16)
    want = np.zeros((4, 6))
    for i, v in enumerate(luma):
        mcu, b = divmod(i, 4)
        want[mcu // 3 * 2 + b // 2, mcu % 3 * 2 + b % 2] = np.clip((v * 16 + 1028) >> 3, 0, 255)
    assert (thumb == want).all()
    for bad in (b"x", b"\xff\xd8" + seg(0xC2, bytes(15)), b"\xff\xd8\x00"):
        with pytest.raises((ValueError, IndexError, Exception)):
            jpeg.Image(bad)


def test_media_rows(spark, awkward, nothing):
    rows = jpeg.media(awkward, chunk=5000).collect()
    assert len(rows) == awkward.count()
    by = {(r["doc_id"], r["n_bytes"]): r for r in rows}
    import hashlib

    for r in awkward.collect():
        raw = (r["text"] or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        got = by[r["doc_id"], len(raw)]
        assert (got["payload_bytes"], got["payload_sha256"], got["tail_crc32"]) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert by[4, 0]["media_sha256"] == by[5, 0]["media_sha256"] and by[4, 0]["feature"] == by[5, 0]["feature"]
    assert jpeg.media(nothing).count() == 0


# ---- nearest neighbours ----
def exact(rows, queries, k):
    out = {}
    ok = lambda v: v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)
    rows = sorted({(i, tuple(v)) for i, v in rows if i is not None and ok(v)})
    for q, v in {(i, tuple(v)) for i, v in queries if i is not None and ok(v)}:
        found = defaultdict(lambda: -9.0)
        for i, w in rows:
            if i != q and len(w) == len(v):
                found[i] = max(found[i], float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)))
        out[q] = sorted(found.items(), key=lambda x: (-round(x[1], 12), x[0]))[:k]
    return out


@pytest.mark.parametrize("options", [{}, {"block": 1000}, {"block": 300, "sample": 7, "tables": 4}])
def test_neighbours(spark, options):
    r = np.random.default_rng(9)
    base = r.standard_normal((400, 24))
    near = base[:80] + 0.3 * r.standard_normal((80, 24))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.concatenate([base, near]).astype(np.float32))]
    rows += [(1000 + i, rows[3][1]) for i in range(30)]  # one vector many times
    rows += [(2000, None), (2001, [0.0] * 24), (2002, [float("nan")] + [1.0] * 23), (2003, [None] + [1.0] * 23), (2004, []), (None, rows[0][1]), (2005, [1.0, 2.0]), (2006, [1.0, 2.5]), (5, rows[5][1])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, ids string")
    asked = df.where("vec_id % 10 = 0 or vec_id in (2005, 2001)")
    got = defaultdict(list)
    for x in ann.search(spark, df, asked, **options).orderBy("query_id", "rank").collect():
        got[x["query_id"]].append((x["vec_id"], x["score"], x["rank"]))
    want = exact(rows, [(i, v) for i, v in rows if i is not None and (i % 10 == 0 or i in (2005, 2001))], 5)
    assert set(got) == set(want) and 2001 not in got and [v for v, *_ in got[2005]] == [2006]
    hits = sum(len({v for v, *_ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    for q, found in got.items():
        assert [k for *_, k in found] == list(range(1, len(found) + 1)) and q not in [v for v, *_ in found]
        assert len(found) == len(want[q])
    assert ann.search(spark, df.where("vec_id < 0"), asked).count() == 0
    assert ann.search(spark, df, asked.where("vec_id < 0")).count() == 0


def test_few_vectors_are_all_found(spark):
    df = spark.createDataFrame([(i, [float(i == j) for j in range(8)]) for i in range(8)], "vec_id long, embedding array<double>")
    got = ann.search(spark, df, df.where("vec_id = 0"), tables=1, share=1e-9).orderBy("rank").collect()
    assert [(x["vec_id"], x["score"]) for x in got] == [(i, 0.0) for i in range(1, 6)]


def test_rotation_keeps_lengths_and_hashes_follow_nearness():
    r = np.random.default_rng(1)
    x = r.standard_normal((50, 30))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = ann.rotated(x, 3, 7)
    assert np.allclose(y @ y.T, x @ x.T)
    assert (ann.axes(x, 0, 1, 2)[:, 0] != ann.axes(x, 0, 1, 2)[:, 1]).all()
    assert (ann.axes(-x, 0, 1, 1) == ann.axes(x, 0, 1, 1) ^ 1).all()


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_query_over_embeddings(spark, size):
    from termloom.llm.queries import QUERIES

    folder = f"/root/testdata/{size}"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()]
    ids = np.array([i for i, v in rows])
    x = np.array([v for _, v in rows], np.float64)
    got = defaultdict(list)
    for r in QUERIES["op7_cross_polytope_neighbours"](spark, folder).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    asked = [i for i in ids if i % 50 == 0]
    assert sorted(got) == sorted(asked)
    hits = 0
    for q in asked:
        v = x[ids == q][0]
        score = (x * v).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((v * v).sum()))
        score[ids == q] = -9
        best = set(ids[np.lexsort((ids, -score))[:5]])
        hits += len(best & {i for i, _ in got[q]})
        assert len(got[q]) == 5 and all(abs(s - score[ids == i][0]) < 1e-12 for i, s in got[q])
    assert hits >= 0.9 * 5 * len(asked)


def test_recall_of_the_setting_for_a_million():
    """The buckets that production's setting looks into for a million vectors, against brute force over a million random ones,
    which have no structure that would make them easy to find."""
    n, w = 1_000_000, 64
    x = np.random.default_rng(5).standard_normal((n, w), dtype=np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    asked = np.arange(0, n, n // 60)
    near = x[asked] @ x.T
    near[np.arange(len(asked)), asked] = -9
    top = np.argpartition(-near, 5, axis=1)[:, :5]
    count = int(np.ceil(ann.n_codes(w) * ann.share_of(n, 0.1)))
    met = np.zeros(top.shape, bool)
    for t in range(2):
        codes = ann.buckets(x[top.ravel()].astype(float), t, 11).reshape(top.shape)
        for i, mine in enumerate(ann.probed(x[asked].astype(float), t, 11, count)):
            met[i] |= np.isin(codes[i], mine)
    assert met.mean() >= 0.9, met.mean()


# ---- classifiers ----
def corpus(n, seed):
    """(rows, labels): a tenth toxic by words, a fifth junk."""
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = prose(seed * 100_000 + i, r.randint(20, 80)).split()
        toxic, junk = r.random() < 0.15, r.random() < 0.25
        if toxic:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(["moron", "idiot", "zorgfel", "zorgfin"]))
        if junk:
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words), "a"))
        labels.append((i, int(not junk), int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def labelled_corpus(spark):
    rows, labels = corpus(900, 4)
    return table(spark, rows).cache(), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: (q, t) for i, q, t in labels}


@pytest.mark.parametrize("module, place", [(toxicity, 1), (bytecnn, 0)])
def test_held_out_accuracy(spark, labelled_corpus, module, place):
    docs, labels, truth = labelled_corpus
    out = [x for x in module.classify(spark, docs, labels).select("row.doc_id", "score", "held_out", "predicted").collect()]
    assert len(out) == 900 and all(0 <= x["score"] <= 1 for x in out)
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 4 == 2) for x in out)
    right = [x["predicted"] == truth[x["doc_id"]][place] for x in out if x["held_out"]]
    assert len(right) > 150 and np.mean(right) > 0.95


@pytest.mark.parametrize("module", [toxicity, bytecnn])
def test_models_on_odd_rows(spark, labelled_corpus, awkward, nothing, module):
    docs, labels, _ = labelled_corpus
    out = module.classify(spark, awkward, labels)
    rows = out.collect()
    assert len(rows) == awkward.count() and set(rows[0]["row"].asDict()) == set(awkward.columns)
    scores = defaultdict(set)
    for x in rows:
        scores[x["row"]["text"] or ""].add(x["score"])
    assert all(len(s) == 1 for s in scores.values())
    assert module.classify(spark, nothing, labels).count() == 0
    # without labels, or with none outside the held-out fold, there still are scores
    for none in (labels.where(F.lit(False)), labels.where(sampling.held_out(F.col("doc_id")))):
        assert all(0 <= x["score"] <= 1 for x in module.classify(spark, docs.limit(20), none).collect())


def test_held_out_labels_are_never_read(spark, labelled_corpus):
    docs, labels, _ = labelled_corpus
    turned = labels.withColumn("toxic", F.when(sampling.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sampling.labelled(docs, x, "toxic", 1000, 10_000) for x in (labels, turned))
    assert a.equals(b) and len(a) > 300 and len(sampling.labelled(docs, labels, "toxic", 50, 10_000)) == 50


def test_label_model_ranks_voters():
    r = np.random.default_rng(5)
    y = r.random(4000) < 0.2
    voter = lambda hit, wrong: np.where(r.random(4000) < np.where(y, hit, wrong), 1, 0)
    good, fair, chance = voter(0.7, 0.01), voter(0.5, 0.05), voter(0.1, 0.1)
    quiet = np.where((good + fair) == 0, -1, 0)
    v = np.stack([good, fair, chance, good, quiet], axis=1).astype(np.int8)
    model = toxicity.LabelModel.fit(v, 0.2)
    odds = np.log(model.rates[1, :, 2] / model.rates[0, :, 2])
    assert min(odds[0], odds[1]) > odds[2] and model.alike[0, 3] > 0.5
    assert np.mean((model.posterior(v) > 0.5) == y) > 0.85


def test_network_reads_whole_texts():
    net = bytecnn.Net.fresh()
    text = "a" * 5000
    assert len(bytecnn.chunks(text.encode())) == -(-(5000 - 64) // 320) and len(bytecnn.chunks(b"")) == 1
    covered = np.zeros(5000, bool)
    for i in range(len(bytecnn.chunks(text.encode()))):
        covered[i * 320 : i * 320 + 384] = True
    assert covered.all()
    assert net.predict([text])[0] != net.predict([text[:-1] + "\x01"])[0]
    assert np.allclose(net.predict(["x y", text, ""], bound=3), [net.predict([t])[0] for t in ("x y", text, "")], atol=1e-5)


def test_scores_depend_on_the_text_alone():
    """To the last bit, in any batch, at any place in it, and however long texts are cut."""
    r = random.Random(3)
    net = bytecnn.train([prose(i, 30) if i % 2 else prose(i, 30).upper() for i in range(40)], np.arange(40) % 2, epochs=1, budget=20)
    texts = ["", "x", "é漢🙂" * 40, prose(1, 20_000)] + [prose(100 + i, r.randint(1, 900)) for i in range(60)]
    alone = [net.predict([t])[0] for t in texts]
    for bound in (1, 3, 100, 4096):
        assert net.predict(texts, bound).tolist() == alone
    assert net.predict(texts[::-1] + texts[:7]).tolist() == alone[::-1] + alone[:7]


def test_rounded_network_follows_the_learnt_one():
    net = bytecnn.train([prose(i, 30) if i % 2 else prose(i, 30).upper() for i in range(40)], np.arange(40) % 2, epochs=1, budget=60)
    for t in (prose(5, 50), prose(6, 400).upper(), "aB1 " * 100):
        c = bytecnn.chunks(t.encode())
        plain = net.head(net.pooled(c)[0], np.zeros(len(c), int), 1)[0][0]
        assert abs(plain - net.predict([t])[0]) < 0.05


def test_long_texts_are_sampled_all_over(spark):
    text = "".join(chr(0x4E00 + i) for i in range(10_000))
    df = spark.createDataFrame([(text,), ("short",), (None,), ("y" * 100,)], "text string")
    got = [x[0] for x in df.select(sampling.spread(F.col("text"), 100, 5)).collect()]
    assert got[1:] == ["short", None, "y" * 100]
    parts = got[0].split("\n")
    assert parts == [text[i : i + 20] for i in (0, 2495, 4990, 7485, 9980)]


def test_repeated_ids_give_one_row_of_training(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (5, None), (None, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (5, 1), (None, 1)], "doc_id long, toxic int")
    assert sampling.labelled(docs, labels, "toxic", 10, 50).values.tolist() == [[1, "a", 1]]


def test_voters_without_labels():
    texts = ["you are such an idiot", "what an idi0t he is", "iiidiot", "a m0r0n", "du bist ein trottel!", "calm words only", "idiot x idiot y idiot"]
    v = toxicity.votes([toxicity.terms(t) for t in texts], texts, [])
    names = [*toxicity.LEXICONS, *toxicity.PATTERNS]
    says = [{n for n, x in zip(names, row, strict=True) if x == toxicity.FOR} for row in v]
    assert {"english", "addressed"} <= says[0] and "disguised" in says[1] and "disguised" in says[2] and "disguised" in says[3]
    assert {"german", "addressed", "exclaimed"} <= says[4] and not says[5] and v[5, -1] == toxicity.AGAINST and "repeated" in says[6]
    assert "abcd**" in toxicity.terms("abcdx abcdy z") and "abcd**" not in toxicity.terms("abcdx efghy z")
