"""The pipeline's removal of repeated lines against all runs of lines."""

import random
from collections import Counter

import corpus_pipeline
from conftest_llm import prose, table

from termloom.llm import line_chunks


def brute(rows, min_lines=2, min_chars=80):
    """rows with different ids; every run of lines of every length is looked at."""
    first, out = {}, []
    for d, t in sorted(rows):
        ls = t.split("\n")
        for s in range(len(ls)):
            for e in range(s + min_lines, len(ls) + 1):
                first.setdefault(tuple(ls[s:e]), (d, s))
    for d, t in rows:
        ls, gone = t.split("\n"), set()
        for s in range(len(ls)):
            for e in range(s + min_lines, len(ls) + 1):
                fd, fs = first[tuple(ls[s:e])]
                if len("\n".join(ls[s:e])) >= min_chars and (fd != d or s >= fs + e - s):
                    gone.update(range(s, e))
        out.append((d, "\n".join(x for i, x in enumerate(ls) if i not in gone), len(gone)))
    return out


def test_all_repeated_runs_go(spark):
    r = random.Random(8)
    lines = [prose(i, n) for i, n in enumerate([1, 2, 3, 5, 9, 14, 20, 30])] + ["", "", " "]
    rows = [(i, "\n".join(r.choice(lines) for _ in range(r.randint(1, 14)))) for i in range(25)]
    rows += [(50, "\n".join([prose(99, 14)] * 5)), (51, ""), (52, prose(3, 200))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_chunks.remove_repeats(spark, df).select("row.doc_id", "text", "n_removed").collect()
    assert Counter(map(tuple, got)) == Counter(brute(rows)) and sum(x[2] for x in got) > 50


def test_a_passage_goes_whole(spark):
    passage = "\n".join(prose(500 + i, 9) for i in range(7))  # 63 words
    own = lambda i: (prose(700 + i, 9), prose(800 + i, 9))
    df = table(spark, [(i, "\n".join([own(i)[0], passage, own(i)[1]]), "a") for i in range(5)] + [(9, passage, "a"), (10, None, "a"), (None, passage, "a")])
    got = {x["doc_id"]: x["text"] for x in corpus_pipeline.drop_repeated_lines(spark, df, "").collect()}
    assert got == {None: passage, 10: None} | {i: "\n".join(own(i)) for i in range(5)}


def test_odd_rows(spark, awkward, nothing):
    rows = line_chunks.remove_repeats(spark, awkward).collect()
    assert len(rows) == awkward.count() and line_chunks.remove_repeats(spark, nothing).count() == 0
    assert {x["text"] for x in rows if x["row"]["doc_id"] == 12} == {prose(90, 12)}
    assert all(x["text"] == x["row"]["text"] and x["n_removed"] == 0 for x in rows if x["row"]["doc_id"] != 12)
