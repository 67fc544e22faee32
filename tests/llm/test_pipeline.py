from collections import Counter

import corpus_pipeline
import __spark_entry__
from conftest_llm import prose, table
from pyspark.sql import functions as F

from termloom.llm import line_chunks, packing


def test_names():
    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "packing"]


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages_keep_columns_and_take_effect(spark, awkward, nothing, tmp_path):
    labels = spark.createDataFrame([(1000 + i, 1, i % 2) for i in range(200)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    own = table(spark, [(1000 + i, prose(i, 40) + (" moron idiot" if i % 2 else ""), "a") for i in range(200)])
    docs = awkward.union(own)
    for name in ("toxicity", "line_dedup", "near_dedup", "mixing"):
        out = stage(name)(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        docs = out.cache()
        assert stage(name)(spark, nothing, str(tmp_path)).count() == 0
        if name == "toxicity":
            assert docs.where("text like '%moron%'").count() == 0 and docs.count() == awkward.count() + 100
        if name == "line_dedup":
            assert docs.where("length(text) <> n_chars").count() == 0
        if name == "near_dedup":
            assert max(Counter((r["doc_id"], r["text"]) for r in docs.collect()).values()) == 1
    rows = stage("packing")(spark, docs, str(tmp_path)).collect()
    assert len({r["doc_id"] for r in rows}) == docs.select("doc_id").distinct().count()


def test_copies_without_lines_of_their_own_go(spark):
    passage = "\n".join(prose(i, 12) for i in range(10))
    df = table(spark, [(1, passage, "a"), (2, passage, "a"), (3, "", "a"), (4, None, "a")])
    kept = stage("line_dedup")(spark, df, "").collect()
    gone = line_chunks.remove_repeats(spark, df).where("row.doc_id = 2").first()
    assert not gone["text"].strip() and {r["doc_id"] for r in kept} == {1, 3, 4}


def test_run_equals_stages_one_by_one(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, f in corpus_pipeline.STAGES[:-1]:
        docs = f(spark, docs, sf).cache()
    want = packing.pack(spark, docs)
    key = lambda df: Counter(tuple(r) for r in df.select("doc_id", "piece", "start", "length", "ids_crc32").collect())
    got = corpus_pipeline.run(spark, sf)
    assert key(got) == key(want)
    assert got.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0
