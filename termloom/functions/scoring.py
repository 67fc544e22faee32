"""Term weights. A term that a document lacks, or a document of length 0 where length counts, weighs 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import QueryConfig


def needs_length(scoring: str) -> bool:
    return scoring in ("BM25", "BM11")


def idf(n_docs: Column, df: Column) -> Column:
    return F.log(n_docs.cast("double") / df)


def weight(config: QueryConfig, idf_: Column, tf: Column, length: Column, average: Column) -> Column:
    k1, b = config.k1, config.b
    if config.scoring == "TFIDF":
        out = (1 + F.log(tf.cast("double"))) * idf_
    elif config.scoring == "BM15":
        # Without the textbook form, the term count cancels out.
        out = idf_ * tf / (tf + k1) if config.textbook_bm15 else idf_ / F.lit(k1)
    else:
        norm = (1 - b) + b * length / average if config.scoring == "BM25" else length / average
        out = F.when(length == 0, F.lit(0.0)).otherwise(idf_ * tf / (tf + k1 * norm))
    return F.when(tf == 0, F.lit(0.0)).otherwise(out)
