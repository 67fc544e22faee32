"""Which labelled rows the toxicity model learns from."""

import itertools
import random

import numpy as np
from conftest_llm import prose

from termloom.llm import toxicity


def test_texts_that_share_a_long_word_are_no_copies():
    texts = [prose(i, 40) + " internationalization zzzzzzzzzzzz aaaaaaaaaaaa" for i in range(300)]
    assert toxicity.originals(texts) == list(range(300))
    assert toxicity.Model.train(texts, np.arange(300) % 2, 300, 4).learnt == 300


def test_copies_are_left_out():
    base = prose(1, 100)
    words = base.split()
    near = " ".join([*words[:50], "other", *words[51:]])  # 5 of 96 shingles differ
    far = " ".join([*words[:60], *prose(2, 40).split()])
    texts = [base, base.upper(), base.replace(" ", " - "), near, far, "one two", "One, two!", "one three", "", "", "?"]
    assert toxicity.originals(texts) == [0, 4, 5, 7, 8, 10]


def test_copies_equal_brute_force():
    r = random.Random(3)
    texts = []
    for i in range(40):
        words = prose(i % 12, 60).split()
        for _ in range(r.randint(0, 4)):
            words[r.randrange(60)] = "changed"
        texts.append(" ".join(words[: r.randint(45, 60)]))
    sets = [set(zip(*[t.split()[j:] for j in range(5)], strict=False)) for t in texts]
    want = []
    for i, a in enumerate(sets):
        if not any(len(a & sets[j]) >= 0.8 * len(a | sets[j]) for j in want):
            want.append(i)
    assert 12 < len(want) < 40 and toxicity.originals(texts) == want


def test_8000_rows_are_learnt_from(spark):
    rows = [(i, prose(i, 12), i % 2) for i in range(11_500)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    assert toxicity.fit(docs, labels).learnt == 8000
