import gzip
import io
import random
import tarfile
from itertools import groupby

import duckdb
import pytest
from pyspark.sql import functions as F

from termloom.catalog import Catalog
from termloom.cli import main
from termloom.config import IndexConfig, QueryConfig, rebuild_needed
from termloom.functions.charts import heat_table
from termloom.functions.codec import decode_blocks, pack_values, unpack_values
from termloom.operators import index as ix
from termloom.operators import evaluate, lookup, merge, metrics
from termloom.operators.order import ordinals
from termloom.operators.search import pruned_search, search, search_one
from termloom.operators.timing import Stages
from termloom.plans import registry
from termloom.sources import collections
from termloom.sources.pairs import read_pairs
from termloom.streaming.incremental import follow

TOY = [(0, 0, "a a b"), (1, 1, "a c"), (2, 2, "c")]
WANT = {
    "TFIDF": [(0, 1.785124), (1, 0.405465)],
    "BM25": [(0, 0.636743), (1, 0.184302)],
    "BM11": [(0, 0.605764), (1, 0.184302)],
    "BM15": [(0, 1.253398), (1, 0.337888)],
}


@pytest.fixture(scope="module")
def toy(spark, tmp_path_factory):
    rows = spark.createDataFrame(TOY, "docid long, docno long, text string")
    return ix.build(spark, rows, IndexConfig("toy"), str(tmp_path_factory.mktemp("toy")))


@pytest.mark.parametrize("scoring", list(WANT))
@pytest.mark.parametrize("method", ["conjunctive", "disjunctive"])
def test_toy_scores(spark, toy, scoring, method):
    got = [(r["docid"], r["score"]) for r in search_one(spark, toy, "a b", QueryConfig(method, scoring)).orderBy("rank").collect()]
    want = list(WANT[scoring])
    if method == "conjunctive":
        want[1] = (1, 0.0)  # padding
    assert got == want
    many = search(toy, spark.createDataFrame([(5, "a b"), (6, "zz a"), (7, "b a a b")], "qid long, query string"), QueryConfig(method, scoring)).orderBy("qid", "rank").collect()
    assert [(r["docid"], r["score"]) for r in many if r["qid"] == 5] == want
    assert [r["docid"] for r in many if r["qid"] == 6] == ([] if method == "conjunctive" else [0, 1])


def test_edges_of_queries(spark, toy, tmp_path):
    none = QueryConfig("conjunctive", "TFIDF")
    assert search_one(spark, toy, "a zz", none).count() == 0
    assert search_one(spark, toy, "", none).count() == 0
    empty = spark.createDataFrame([(0, 0, "?!"), (1, 1, "x")], "docid long, docno long, text string")
    built = ix.build(spark, empty, IndexConfig("e"), str(tmp_path / "e"))
    assert [r["docid"] for r in search_one(spark, built, "", QueryConfig()).collect()] == [0]
    assert search_one(spark, built, "c", QueryConfig(textbook_bm15=True, scoring="BM15")).count() == 0
    nothing = ix.build(spark, empty.limit(0), IndexConfig("n"), str(tmp_path / "n"))
    assert nothing.average == 0.0 and search_one(spark, nothing, "x", QueryConfig()).count() == 0


def test_stop_words_and_stems(spark, tmp_path):
    rows = spark.createDataFrame([(0, 0, "The hopping cats"), (1, 1, "a cat of hope"), (2, 2, "the of")], "docid long, docno long, text string")
    built = ix.build(spark, rows, IndexConfig("s", stem=True, keep_stop=False), str(tmp_path / "s"))
    assert {(r["tok"], r["docid"]) for r in built.postings.collect()} == {("hop", 0), ("cat", 0), ("cat", 1), ("hope", 1)}
    assert {r["docid"]: r["len"] for r in built.docs.collect()} == {0: 2, 1: 2, 2: 0}
    assert {r["docid"] for r in search_one(spark, built, "hops", QueryConfig()).collect()} == {0}
    assert search_one(spark, built, "the of", QueryConfig()).count() == 0


def test_pruning_changes_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(i, i, "common " * (1 + i % 5) + ("rare " * (i % 3) if i % 17 == 0 else "") + f"w{i % 7}") for i in range(200)], "docid long, docno long, text string")
    built = ix.build(spark, rows, IndexConfig("p"), str(tmp_path / "p"))
    for scoring in WANT:
        config = QueryConfig("disjunctive", scoring, 5)
        for text in ("common rare", "rare w3 common", "zz", "w1 w2 w3"):
            full, cut = (x.orderBy("rank").collect() for x in (search_one(spark, built, text, config), pruned_search(spark, built, text, config, worth=0)))
            assert full == cut


def test_ranges(spark):
    ids = spark.createDataFrame([(i,) for i in (5, 6, 7, 5, 10, 9, 8, 20)], "docno long")
    ranges = ix.content_ranges(ids)
    assert sorted(map(tuple, ranges.collect())) == [(5, 10), (20, 20)]
    assert [r[0] for r in ix.missing_ids(ids, spark).orderBy("docno").collect()] == [*range(5), *range(11, 20)]
    assert ix.covered(9, ranges) and not ix.covered(11, ranges)
    text = ix.ranges_to_text([(5, 10), (20, 20)])
    assert text == "5,10;20,20" and ix.ranges_from_text(text) == [(5, 10), (20, 20)]
    assert ix.ranges_to_text([]) == "empty" and ix.ranges_from_text("empty") == []
    for edge in (99_990, 65_530, (1 << 32) - 10, -15):  # over the edges of blocks
        wide = spark.createDataFrame([(edge + i,) for i in range(30)] + [(edge + 40,)], "docno long")
        assert sorted(map(tuple, ix.content_ranges(wide).collect())) == [(edge, edge + 29), (edge + 40, edge + 40)]
    many = sorted({r.randrange(-300_000, 300_000) for r in [random.Random(1)] for _ in range(2000)} | set(range(60_000, 140_000)))
    want = [(g[0], g[-1]) for g in [[v for _, v in g] for _, g in groupby(enumerate(many), lambda x: x[1] - x[0])]]
    assert sorted(map(tuple, ix.content_ranges(spark.createDataFrame([(v,) for v in many], "docno long")).collect())) == want


def test_ordinals_in_blocks(spark):
    keys = [*range(65_500, 65_600), 5, (1 << 16) * 3 + 1, (1 << 33) + 7, (1 << 50), -4]
    df = spark.createDataFrame([(k, i % 2) for i, k in enumerate(keys)], "k long, g int")
    got = {r["k"]: r["o"] for r in ordinals(df, "k", "o").collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}
    got = {r["k"]: r["o"] for r in ordinals(df, "k", "o", by=("g",)).collect()}
    assert got == {k: i for g in (0, 1) for i, k in enumerate(sorted(keys[g::2]))}


def test_gaps_over_blocks(spark):
    ids = [0, 3, 65_535, 65_536, 65_540, 200_000, 1 << 20]
    df = spark.createDataFrame([("a", d, 1) for d in ids] + [("b", 70_000, 2)], "tok string, docid long, tf int")
    gapped = ix.posting_gaps(df)
    assert [r["gap"] for r in gapped.where("tok = 'a'").orderBy("docid").collect()] == [b - a for a, b in zip([0, *ids], ids, strict=False)]
    back = ix.gap_decode(gapped.withColumnRenamed("docid", "at"))
    assert back.where("at <> docid").count() == 0 and back.count() == 8
    coded = ix.posting_blocks(df, "gamma").withColumn("back", decode_blocks("gamma")(F.col("code"), F.shiftleft("block", 16)))
    assert sorted(d for r in coded.where("tok = 'a'").collect() for d in r["back"]["docids"]) == ids


def test_partitions_merge_to_the_whole(spark, toy):
    rows = spark.createDataFrame([(d, n, f"t{d % 3} x{d}") for d, n in enumerate(range(10, 40))], "docid long, docno long, text string")
    docs, posts = merge.partitioned(rows, IndexConfig(), 3)
    assert docs.select("part_id").distinct().count() == 3
    all_docs, all_posts, all_lex = merge.merged(docs, posts)
    want = rows.select(F.col("docno").alias("docid"), "docno", "text")
    assert set(map(tuple, all_posts.collect())) == set(map(tuple, ix.term_counts(want, IndexConfig()).collect()))
    assert {r["global_id"] for r in merge.renumber(docs).collect()} == set(range(30))
    with pytest.raises(ValueError):
        merge.same_options([IndexConfig(), IndexConfig(stem=True)])


def test_metrics(spark):
    run = spark.createDataFrame([(1, d, d) for d in range(1, 11)] + [(2, 1, 1)], "qid long, docid long, rank int")
    qrels = spark.createDataFrame([(1, d, 1) for d in (1, 2, 3, 4)] + [(1, 100 + d, 1) for d in range(17)] + [(2, 1, 2)] + [(2, 200 + d, 3) for d in range(159)], "qid long, docid long, rel int")
    got = {r["qid"]: r for r in metrics.per_topic(run, qrels).collect()}
    a, b = got[1], got[2]
    assert abs(a["map"] - 4 / 21) < 1e-12 and abs(a["Rprec"] - 4 / 21) < 1e-12 and a["recip_rank"] == 1
    assert (a["P@5"], a["P@10"]) == (0.8, 0.4) and abs(a["P@30"] - 4 / 30) < 1e-12
    assert abs(b["map"] - 1 / 160) < 1e-12 and abs(b["NDCG@5"] - 0.226107) < 1e-6
    topics = spark.createDataFrame([(1,), (2,), (3,)], "qid long")
    rec = metrics.records(topics, metrics.per_topic(run, qrels), "r")
    assert {r["qid"]: r["empty"] for r in rec.collect()} == {1: False, 2: False, 3: True}
    assert metrics.pivoted(rec, "map", [1, 3]).first()["3"] == 0
    grid = topics.withColumn("name", F.lit("r"))
    assert metrics.pending(grid, rec.where("qid = 1")).count() == 2


def test_sources(spark, tmp_path):
    body = "0\thello world\n1\tsecond doc\nbadline\n3\tfourth\textra\n4\tlast\n"
    (tmp_path / "c.tsv").write_text(body)
    (tmp_path / "c.tsv.gz").write_bytes(gzip.compress(body.encode()))
    with tarfile.open(tmp_path / "c.tar.gz", "w:gz") as tar:
        info = tarfile.TarInfo("collection.tsv")
        info.size = len(body)
        tar.addfile(info, io.BytesIO(body.encode()))
    for name in ("c.tsv", "c.tsv.gz", "c.tar.gz"):
        rows, bad = collections.read_collection(spark, str(tmp_path / name))
        assert sorted((r["docid"], r["docno"]) for r in rows.collect()) == [(0, 0), (1, 1), (4, 4)], name
        assert sorted(r["docid"] for r in bad.collect()) == [2, 3]
        assert collections.read_collection(spark, str(tmp_path / name), 2)[0].count() == 2
    (tmp_path / "many").mkdir()
    for i in range(3):
        (tmp_path / "many" / f"{i}.tsv").write_text("".join(f"{i * 1000 + j}\tt{j}\n" for j in range(1000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        many = collections.read_collection(spark, str(tmp_path / "many"))[0]
        got = sorted((r["docid"], r["docno"]) for r in many.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [d for d, _ in got] == list(range(3000)) and {n for _, n in got} == set(range(3000))
    rows = collections.read_collection(spark, str(tmp_path / "c.tsv"))[0]
    assert collections.fetch(rows, 1).first()["text"] == "second doc" and collections.fetch(rows, 1, 5).count() == 2
    dup = spark.createDataFrame([(3, 7, "late"), (1, 7, "early")], "docid long, docno long, text string")
    assert collections.first_by_docno(dup).first()["text"] == "early"
    (tmp_path / "t").write_text("4\tone two\tthree\n")
    assert tuple(collections.topics(spark, str(tmp_path / "t")).first()) == (4, "one two three")
    (tmp_path / "q").write_text("4 0 1 2\n")
    assert tuple(collections.qrels(spark, str(tmp_path / "q")).first()) == (4, 1, 2)
    (tmp_path / "p").write_text("a,1,2\n\nb,3,4\na,5,6\n")
    assert {tuple(r) for r in read_pairs(spark, str(tmp_path / "p")).collect()} == {("a", 5, 6), ("b", 3, 4)}


def test_catalog(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "base"))
    assert catalog.load("x") is None and catalog.names() == []
    rows = spark.createDataFrame(TOY, "docid long, docno long, text string")
    catalog.build(rows, IndexConfig("x", codec="gamma"), QueryConfig("conjunctive", "BM11", 20))
    built, config = catalog.load("x")
    assert built.n_docs == 3 and config == QueryConfig("conjunctive", "BM11", 20)
    meta = catalog.metadata("x")
    assert (meta["content"], meta["n_terms"], meta["n_postings"]) == ("0,2", 3, 5)
    assert catalog.append("x", spark.createDataFrame([(9, 2, "dup"), (10, 10, "a d")], "docid long, docno long, text string")) == 1
    assert catalog.append("x", spark.createDataFrame([(10, 10, "a d")], "docid long, docno long, text string")) == 0
    assert catalog.load("x")[0].n_docs == 4
    assert {r["docid"] for r in catalog.load("x")[0].docs.collect()} == {0, 1, 2, 3}
    assert [r["docno"] for r in search_one(spark, catalog.load("x")[0], "d", QueryConfig()).collect()] == [10]
    catalog.rename("x", "y")
    assert catalog.names() == ["y"] and catalog.load("y")[0].lexicon.where("tok = 'a'").first()["df"] == 3
    other = spark.createDataFrame([(0, 2, "other"), (1, 50, "b")], "docid long, docno long, text string")
    catalog.build(other, IndexConfig("z"))
    both = catalog.merge(["y", "z"], IndexConfig("both"))
    assert both.n_docs == 5 and both.postings.where("tok = 'other'").count() == 0
    assert catalog.get_or_build(other, IndexConfig("z")).n_docs == 2
    assert catalog.delete("y") and not catalog.exists("y")
    with pytest.raises(ValueError):
        catalog.rename("nope", "w")


def test_follow(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "base"))
    catalog.build(spark.createDataFrame(TOY, "docid long, docno long, text string"), IndexConfig("s"))
    inbox = str(tmp_path / "in")
    spark.createDataFrame([(7, "new text"), (1, "again")], "doc_id long, text string").write.parquet(inbox)
    for _ in range(2):
        follow(spark, inbox, "doc_id long, text string", catalog, "s", str(tmp_path / "cp")).awaitTermination()
        assert catalog.load("s")[0].n_docs == 4


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "c.tsv").write_text("0\ta a b\n1\ta c\n2\tc\n")
    base = ["--base", str(tmp_path / "b")]
    assert main([*base, "build", "toy", str(tmp_path / "c.tsv")], spark) == 0
    assert main([*base, "query", "toy", "a b", "--scoring", "TFIDF"], spark) == 0
    assert "1\t0\t0\t1.785124" in capsys.readouterr().out
    assert main([*base, "query", "none", "a"], spark) == 1
    assert main([*base, "update", "toy", "--scoring", "TFIDF", "--method", "conjunctive", "-k", "1"], spark) == 0
    capsys.readouterr()
    assert main([*base, "query", "toy", "a b"], spark) == 0
    assert capsys.readouterr().out == "1\t0\t0\t1.785124\n"
    assert main([*base, "update", "toy", "--no-stem"], spark) == 1 and main([*base, "update", "toy", "--no-stem", "--path", str(tmp_path / "c.tsv")], spark) == 0
    (tmp_path / "d.tsv").write_text("7\tdd a\n")
    assert main([*base, "append", "toy", str(tmp_path / "d.tsv")], spark) == 0
    (tmp_path / "t").write_text("1\ta b\n")
    (tmp_path / "q").write_text("1 0 0 1\n")
    assert main([*base, "evaluate", "toy", str(tmp_path / "t"), str(tmp_path / "q")], spark) == 0
    for command in (["list"], ["merge", "m", "toy"], ["rename", "m", "n"], ["delete", "n"]):
        assert main([*base, *command], spark) == 0


def test_lookups(spark, toy):
    assert lookup.next_geq(toy.lexicon, "tok", "b").first()["tok"] == "b"
    assert lookup.next_geq(toy.lexicon, "tok", "bb").first()["tok"] == "c"
    assert lookup.next_geq(toy.lexicon, "tok", "d").first() is None
    assert lookup.last_row(toy.lexicon, "tok").first()["tok"] == "c"
    assert lookup.equal(toy.lexicon, "tok", "a").first()["df"] == 2
    arrays = spark.createDataFrame([([1, 4, 9],)], "d array<long>")
    assert [arrays.select(lookup.posting_next_geq(F.col("d"), x)).first()[0] for x in (0, 4, 5, 10)] == [1, 4, 9, None]


def test_grid_is_resumed(spark, toy, tmp_path):
    topics = spark.createDataFrame([(1, "a b"), (2, "zz")], "qid long, query string")
    qrels = spark.createDataFrame([(1, 0, 2), (1, 2, 1), (2, 0, 1)], "qid long, docid long, rel int")
    configs = evaluate.grid(scorings=("TFIDF", "BM15"), ks=(10,))
    path = str(tmp_path / "results")
    assert evaluate.evaluate_grid(spark, toy, topics.where("qid = 1"), qrels, configs[:3], path) == 3
    assert evaluate.evaluate_grid(spark, toy, topics, qrels, configs, path) == 2 * 8 - 3
    assert evaluate.evaluate_grid(spark, toy, topics, qrels, configs, path) == 0
    got = spark.read.parquet(path)
    assert got.count() == 16 and got.where("empty").select("qid").distinct().first()[0] == 2
    assert got.where("qid = 1 and name like '%conjunctive%'").select("recip_rank").distinct().first()[0] == 1.0
    assert heat_table(got, "map", [1, 2]).count() == 8
    assert rebuild_needed(IndexConfig(), IndexConfig(stem=True)) and not rebuild_needed(IndexConfig("a"), IndexConfig("b"))
    toy.persist().unpersist()


def test_append_numbers_documents_anew(spark, tmp_path):
    """Two files whose lines are both numbered from 0."""
    catalog = Catalog(spark, str(tmp_path / "base"), compact=3)
    for i, words in enumerate((["apple pie", "banana"], ["cherry", "date apple"], ["elder", "fig apple"], ["grape"])):
        (tmp_path / f"{i}.tsv").write_text("".join(f"{100 * (i + 1) + j}\t{w}\n" for j, w in enumerate(words)))
        rows = collections.read_collection(spark, str(tmp_path / f"{i}.tsv"))[0]
        catalog.append("x", rows) if i else catalog.build(rows, IndexConfig("x", codec="unary"))
    built, _ = catalog.load("x")
    assert sorted((r["docid"], r["docno"]) for r in built.docs.collect()) == list(enumerate([100, 101, 200, 201, 300, 301, 400]))
    assert [r["docno"] for r in search_one(spark, built, "cherry", QueryConfig()).collect()] == [200]
    assert {r["docno"] for r in search_one(spark, built, "apple", QueryConfig()).collect()} == {100, 201, 301}
    assert built.lexicon.where("tok = 'apple'").first()["df"] == 3 and len(catalog.metadata("x")["lexicons"]) == 2
    assert catalog.metadata("x")["content"] == "100,101;200,201;300,301;400,400" and catalog.metadata("x")["n_terms"] == 8


def test_a_failed_change_is_not_seen(spark, tmp_path, monkeypatch):
    catalog = Catalog(spark, str(tmp_path / "base"))
    catalog.build(spark.createDataFrame(TOY, "docid long, docno long, text string"), IndexConfig("x"))
    more = spark.createDataFrame([(0, 9, "a z")], "docid long, docno long, text string")
    with monkeypatch.context() as m:
        m.setattr(Catalog, "_commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            catalog.append("x", more)
    assert catalog.load("x")[0].n_docs == 3 and catalog.load("x")[0].lexicon.where("tok = 'a'").first()["cf"] == 3
    assert catalog.append("x", more) == 1 and catalog.append("x", more) == 0
    assert catalog.load("x")[0].lexicon.where("tok = 'a'").first()["cf"] == 4
    assert len([p for p in (tmp_path / "base" / "x").iterdir() if p.name.startswith("batch")]) == 2


def test_stored_options(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "base"))
    rows = spark.createDataFrame([(0, 0, "cats cat"), (1, 1, "dog")], "docid long, docno long, text string")
    catalog.build(rows, IndexConfig("x"))
    catalog.update("x", QueryConfig("conjunctive", "BM11", 7, "skipping"))
    assert catalog.load("x")[1] == QueryConfig("conjunctive", "BM11", 7, "skipping")
    with pytest.raises(ValueError):
        catalog.update("x", config=IndexConfig("x", stem=True))
    catalog.update("x", config=IndexConfig("x", stem=True), rows=rows)
    built, query = catalog.load("x", keep=True)
    assert built.config.stem and query.k == 7 and {r["tok"] for r in built.lexicon.collect()} == {"cat", "dog"}
    assert built.lexicon.is_cached
    catalog.flush()
    assert not built.lexicon.is_cached
    with pytest.raises(ValueError):
        catalog.update("nope")


def test_limit_counts_rows(spark):
    df = spark.createDataFrame([(1000 + i, "t" if i % 4 else "") for i in range(20)], "doc_id long, text string")
    rows, bad = collections.from_table(df, 5)
    assert sorted(r["docid"] for r in rows.collect()) == [1001, 1002, 1003] and sorted(r["docid"] for r in bad.collect()) == [1000, 1004]


def test_archives_are_streamed(spark, tmp_path):
    with tarfile.open(tmp_path / "c.tar.gz", "w:gz") as tar:
        for name, body in (("other.txt", "0\tno\n"), ("collection.tsv", "".join(f"{i}\tw{i}\n" for i in range(25_000)))):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body.encode()))
    got = collections.read_collection(spark, str(tmp_path / "c.tar.gz"))[0]
    assert got.where("docid = docno and text = concat('w', docno)").count() == 25_000
    assert collections.read_collection(spark, str(tmp_path / "c.tar.gz"), 12_345)[0].count() == 12_345
    with pytest.raises(Exception, match="no member"):
        collections.archived(spark, str(tmp_path / "c.tar.gz"), member="x").count()


def test_packed_lists_of_large_numbers():
    lists = [[1], [], [8_000_000, 1, 2], [3] * 9, [2**40, 5]]
    import numpy as np

    for codec, some in (("gamma", lists), ("unary", lists[:4])):
        flat = np.array([v for x in some for v in x])
        data = pack_values(flat, np.array([len(x) for x in some]), codec)
        values, many = unpack_values(data, codec)
        assert values.tolist() == flat.tolist() and many.tolist() == [len(x) for x in some]
    assert len(pack_values(np.array([8_000_000]), np.array([1]), "unary")[0]) == 1_000_000


def test_stages_are_timed(spark, toy):
    stages = Stages()
    search_one(spark, toy, "a b", QueryConfig(), stages).collect()
    assert list(stages.seconds) == ["analyse", "lexicon", "plan"] and "lexicon" in str(stages)


def test_rejected_lines_show_their_number_alone(spark, tmp_path):
    texts = ["a b", "", " \n\t", "c", None, "\x0b d \r"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(registry.ORACLES["rejected_lines"]).fetchall())
    assert sorted(map(tuple, registry.QUERIES["rejected_lines"](spark, str(tmp_path)).collect())) == want == [(1, "1"), (2, "2")]


def test_ties_go_by_docno_after_an_append(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path))
    rows = lambda *nos: spark.createDataFrame([(n, n, "same words" if n < 90 else "other") for n in nos], "docid long, docno long, text string")
    catalog.build(rows(3, 5, 9, 90), IndexConfig("x"))
    catalog.append("x", rows(1, 4, 8, 91))
    built = catalog.load("x")[0]
    for method in ("disjunctive", "conjunctive"):
        config = QueryConfig(method, k=4)
        assert [r["docno"] for r in search_one(spark, built, "words", config).orderBy("rank").collect()] == [1, 3, 4, 5]
        asked = spark.createDataFrame([(7, "words same")], "qid long, query string")
        assert [r["docno"] for r in search(built, asked, config).orderBy("rank").collect()] == [1, 3, 4, 5]
    assert [r["docno"] for r in pruned_search(spark, built, "same words", QueryConfig(k=4), worth=0).orderBy("rank").collect()] == [1, 3, 4, 5]


def test_batches_of_queries_in_slices_and_ranges(spark, tmp_path, monkeypatch):
    from termloom.operators import search as module

    rng = random.Random(3)
    rows = spark.createDataFrame([(d, d, " ".join(f"w{min(rng.randrange(9), rng.randrange(40))}" for _ in range(rng.randrange(1, 30)))) for d in range(0, 90_000, 300)], "docid long, docno long, text string")
    built = ix.build(spark, rows, IndexConfig("r"), str(tmp_path / "r"))
    texts = [" ".join(f"w{rng.randrange(45)}" for _ in range(rng.randrange(1, 5))) for _ in range(12)]
    monkeypatch.setattr(module, "BATCH", 9)
    for method in ("disjunctive", "conjunctive"):
        config = QueryConfig(method, "TFIDF", 7)
        got = search(built, spark.createDataFrame(list(enumerate(texts)), "qid long, query string"), config).collect()
        for i, text in enumerate(texts):
            want = [(r["rank"], r["docid"], r["score"]) for r in search_one(spark, built, text, config).orderBy("rank").collect()]
            assert sorted((r["rank"], r["docid"], r["score"]) for r in got if r["qid"] == i) == want


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_counting_shuffles_nothing(spark):
    rows = spark.createDataFrame([(i, i, "The hopping cats, the cat") for i in range(9)], "docid long, docno long, text string")
    for config in (IndexConfig(), IndexConfig(stem=True, keep_stop=False)):
        assert "Exchange" not in _plan(ix.weighed_counts(rows, config))
    assert "Exchange" not in _plan(collections.each_docno(rows))
    assert {(r["tok"], r["tf"]) for r in ix.term_counts(rows, IndexConfig(stem=True)).collect()} == {("the", 2), ("hop", 1), ("cat", 2)}


def test_rows_of_one_docid_are_one_document(spark, tmp_path):
    rows = spark.createDataFrame([(5, 5, "a b"), (5, 5, "b \u00c9b"), (6, 6, "?")], "docid long, docno long, text string")
    built = ix.build(spark, rows, IndexConfig("d"), str(tmp_path))
    assert sorted(map(tuple, built.docs.collect())) == [(5, 5, 4), (6, 6, 1)]
    assert sorted(map(tuple, built.postings.collect())) == [("", 6, 1, 1), ("a", 5, 1, 4), ("b", 5, 3, 4)]


def test_lists_over_the_edges_of_arrow_batches(spark):
    ids = {"a": range(0, 75_000, 3), "b": range(65_530, 65_545), "c": range(25_000), "d": [70_000]}
    df = spark.createDataFrame([(t, d, 1 + d % 7) for t, of in ids.items() for d in of], "tok string, docid long, tf int")
    assert "collect_list" not in _plan(ix.posting_blocks(df))
    want = {(t, b): [d for d in of if d >> 16 == b] for t, of in ids.items() for b in {d >> 16 for d in of}}
    assert {(r["tok"], r["block"]): r["docids"] for r in ix.posting_blocks(df).collect()} == want
    coded = ix.posting_blocks(df, "gamma").withColumn("back", decode_blocks("gamma")(F.col("code"), F.shiftleft("block", 16))).collect()
    assert {(r["tok"], r["block"]): r["back"]["docids"] for r in coded} == want
    assert all(r["n"] == len(r["back"]["freqs"]) and r["back"]["freqs"] == [1 + d % 7 for d in r["back"]["docids"]] for r in coded)


def test_batches_meet_by_documents_not_by_terms(spark, toy):
    plan = _plan(search(toy, spark.createDataFrame([(5, "a b")], "qid long, query string"), QueryConfig()))
    assert "hashpartitioning(tok" not in plan and "SortMergeJoin" not in plan


def test_a_build_reads_texts_twice(spark, tmp_path):
    """For lengths and for postings, not for ranges of terms besides."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text

    rows = spark.createDataFrame([(i, i, f"a b{i} c{i % 7}") for i in range(200)], "docid long, docno long, text string").withColumn("text", seen("text"))
    built = ix.build(spark, rows, IndexConfig("once"), str(tmp_path))
    assert read.value == 400
    assert built.postings.count() == 600 and built.lexicon.count() == 208


def test_parts_are_ranges_of_sorted_postings(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ix, "PART", 100)
    monkeypatch.setattr(ix, "SAMPLED", 40)
    rows = spark.createDataFrame([(i, i, f"the the b{i % 9} é{i}") for i in range(300)], "docid long, docno long, text string")
    postings = ix.build(spark, rows, IndexConfig("parts"), str(tmp_path)).postings
    got = postings.select("tok", "docid", "tf", "len", F.input_file_name().alias("file")).collect()
    files = {}
    for r in got:
        files.setdefault(r["file"], []).append((r["tok"], r["docid"]))
    assert len(files) > 4 and all(x == sorted(x) for x in files.values())
    ranges = sorted((x[0], x[-1]) for x in files.values())
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:], strict=False))
    want = {(t, i, n, 4) for i in range(300) for t, n in (("the", 2), (f"b{i % 9}", 1), (str(i), 1))}
    assert {tuple(r)[:4] for r in got} == want and len(got) == len(want)


def test_stems_of_frequent_terms_are_remembered(monkeypatch):
    import pyarrow as pa

    from termloom.functions import terms

    asked = []
    monkeypatch.setattr(terms, "STEMS", 5)
    monkeypatch.setattr(terms, "stem", lambda w: asked.append(w) or w)
    analyse = terms.Analyser(IndexConfig(stem=True))
    for i in range(0, 40, 2):
        tok, text, tf, n = analyse.counts(pa.array([f"hop w{i}", None, "hop hop", f"w{i + 1}"]))
        assert tok.to_pylist() == ["hop", "hop", f"w{i}", f"w{i + 1}"] and text.tolist() == [0, 2, 0, 3]
        assert tf.tolist() == [1, 2, 1, 1] and n.tolist() == [2, 2, 2, 1]
    assert asked.count("hop") == 1 and len(asked) == 41


def test_slices_of_texts(monkeypatch):
    import pyarrow as pa

    from termloom.functions import terms

    monkeypatch.setattr(terms, "BYTES", 6)
    texts = pa.array(["skip", "ab", None, "cd", "", "a text longer than all", "é", "x"])[1:]
    assert list(terms.slices(texts)) == [(0, 4), (4, 5), (5, 7)]
    words, owner = terms.cut(texts)
    assert words.to_pylist() == ["ab", "cd", *"a text longer than all".split(), "x", "", ""] and owner.tolist() == [0, 2, 4, 4, 4, 4, 4, 6, 3, 5]
    assert terms.Analyser(IndexConfig()).lengths(texts).tolist() == [1, 0, 1, 1, 5, 1, 1]


def test_terms_are_shipped_as_lists(spark):
    """A row a term of a slice of texts, not a row a posting, cut where parts end; docids that descend within and over slices end in order."""
    from termloom.functions import terms

    rows = spark.createDataFrame([(300 - i, f"the the b{i % 3}") for i in range(300)], "docid long, text string").coalesce(1)
    lists = terms.term_lists(rows, IndexConfig(), [("b1", 0), ("the", 100)]).collect()
    assert [(r["part"], r["tok"], r["first"], len(r["docids"])) for r in lists] == [(0, "b0", 3, 100), (1, "b1", 2, 100), (1, "b2", 1, 100), (1, "the", 1, 99), (2, "the", 100, 201)]
    assert lists[-1]["docids"] == list(range(100, 301)) and set(lists[-1]["weighed"]) == {2 << 32 | 3}
    docs = ix.document_table(rows.withColumn("docno", F.col("docid")), IndexConfig())
    counts = ix.sorted_terms(rows.repartition(3), docs, IndexConfig(parts=1))
    assert "Generate" in _plan(counts)
    got = [tuple(r) for r in counts.collect()]
    assert got == sorted((t, 300 - i, n, 3) for i in range(300) for t, n in (("the", 2), (f"b{i % 3}", 1)))
    assert term_of_none(spark, terms) == []


def term_of_none(spark, terms):
    none = spark.createDataFrame([(1, "the"), (2, None)], "docid long, text string")
    return terms.term_lists(none, IndexConfig(keep_stop=False), [("a", 1)]).collect()


@pytest.mark.parametrize("few", [0, 100])
def test_an_append_matches_numbers_not_texts(spark, tmp_path, monkeypatch, few):
    """Which documents are new is found over lengths: texts are shuffled to their numbers at most, by large batches, and never sorted."""
    from termloom import catalog as module

    plans = []
    monkeypatch.setattr(module, "FEW", few)
    real = ix.sorted_terms
    monkeypatch.setattr(ix, "sorted_terms", lambda rows, *more: plans.append(_plan(rows)) or real(rows, *more))
    rows = lambda a, b: spark.createDataFrame([(i, i, f"a b{i % 4}") for i in range(a, b)], "docid long, docno long, text string")
    catalog = module.Catalog(spark, str(tmp_path))
    catalog.build(rows(0, 10), IndexConfig("x"))
    plans.clear()
    assert catalog.append("x", rows(5, 30)) == 20 and catalog.append("x", rows(5, 30)) == 0
    (plan,) = plans
    assert "LeftAnti" not in plan and "SortMergeJoin" not in plan and ("BroadcastHashJoin" if few else "ShuffledHashJoin") in plan
    built, _ = catalog.load("x")
    assert sorted(map(tuple, built.docs.collect())) == [(i, i, 2) for i in range(30)]
    assert sorted(tuple(r)[:2] for r in built.postings.collect()) == sorted((t, i) for i in range(30) for t in ("a", f"b{i % 4}"))
