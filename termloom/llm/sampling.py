"""A bounded, repeatable sample of labelled documents for training."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows whose crc32 of doc_id as text leaves this remainder by 4 are held out from training.
FOLDS, HELD_OUT = 4, 2


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def spread(text: Column, chars: int, pieces: int = 20) -> Column:
    """The text, or of one of over `chars` characters `pieces` slices at equal distances from its start to its end, of
    about `chars` characters together, a line each."""
    size, n = max(1, chars // pieces), F.length(text)
    at = lambda i: (F.floor((n - size) * i / (pieces - 1)) + 1).cast("int")
    slices = F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), lambda i: F.substr(text, at(i), F.lit(size)))
    return F.when(n > chars, F.array_join(slices, "\n")).otherwise(text)


def labelled(docs: DataFrame, labels: DataFrame, column: str, rows: int, chars: int) -> pd.DataFrame:
    """(doc_id, text, label) of at most `rows` labelled documents outside the held-out fold, the first by a hash of doc_id;
    of long texts, slices as spread() takes them. Null texts and ids are left out; of texts of one id, the least counts."""
    picked = labels.select(labels["doc_id"].alias("id"), labels[column].alias("label")).where("id is not null and label is not null")
    picked = picked.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("label").alias("label"))
    picked = picked.orderBy(F.xxhash64("id"), "id").limit(rows)
    found = docs.select(docs["doc_id"], docs["text"]).where("text is not null")
    found = found.join(F.broadcast(picked), found["doc_id"] == F.col("id")).select("doc_id", "label", spread(F.col("text"), chars).alias("text"))
    found = found.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return found.select("doc_id", "text", "label").toPandas().sort_values("doc_id").reset_index(drop=True)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
