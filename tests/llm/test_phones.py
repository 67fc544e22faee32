"""Phones of any ten digits in a phone's layout."""

import re

from conftest_llm import table
from pyspark.sql import functions as F

from termloom.llm import pseudonyms as ps

LAYOUT = re.compile(r"(?<!\d)\+1 \(\d{3}\) \d{3}-\d{4}(?!\d)")


def test_no_phone_of_the_layout_is_left(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where(F.col("text").rlike(r"\(\d{3}\) ")).select("doc_id", "text")
    rows = docs.collect()
    new = {r["doc_id"]: r for r in ps.pseudonymize(docs, "demo-key").collect()}
    pairs = [p for r in rows for p in zip(LAYOUT.findall(r["text"]), LAYOUT.findall(new[r["doc_id"]]["text"]), strict=True)]
    assert len(pairs) > 150 and not [a for a, b in pairs if a == b]
    assert sum(a[4] in "01" for a, _ in pairs) > 30
    # One to one: as many pseudonyms as numbers.
    assert len(set(pairs)) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_every_class_is_permuted_within_itself(spark):
    texts = ["(017) 555-7713", "(817) 555-7713", "132.055.1352", "932-155-1352", "+1 (171) 155-2028", "1-071-955-2028"]
    got = ps.pseudonymize(table(spark, [(i, t, "a") for i, t in enumerate(texts)]), "demo-key").orderBy("doc_id").collect()
    for t, r in zip(texts, got, strict=True):
        assert r["n_pseudonyms"] == 1 and r["text"] != t and re.sub(r"\d", "9", r["text"]) == re.sub(r"\d", "9", t)
        before, after = (re.sub(r"\D", "", x)[-10:] for x in (t, r["text"]))
        assert all((before[i] in "01") == (after[i] in "01") for i in (0, 3))
    assert len({r["text"] for r in got}) == len(texts)
