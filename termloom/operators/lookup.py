"""Point and order lookups in sorted tables: predicates that Parquet statistics prune."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def equal(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(F.col(key) == F.lit(value))


def any_of(df: DataFrame, key: str, values: list) -> DataFrame:
    return df.where(F.col(key).isin(values))


def next_geq(df: DataFrame, key: str, value) -> DataFrame:
    """The first row whose key is value or more."""
    return df.where(F.col(key) >= F.lit(value)).orderBy(key).limit(1)


def last_row(df: DataFrame, key: str) -> DataFrame:
    return df.orderBy(F.desc(key)).limit(1)


def posting_next_geq(docids: Column, docid: Column | int) -> Column:
    """Of an ascending array, the first docid that is `docid` or more; null if there is none."""
    return F.get(F.filter(docids, lambda d: d >= docid), F.lit(0))


def next_posting(postings: DataFrame, docid: int) -> DataFrame:
    """(tok, docid): each term's first docid that is `docid` or more; statistics of docid prune row groups, and no list is gathered."""
    return postings.where(F.col("docid") >= docid).groupBy("tok").agg(F.min("docid").alias("docid"))


def document_lengths(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(docid, len) of the wanted docids of positive length."""
    return docs.join(wanted.select("docid").distinct(), "docid", "left_semi").where("len > 0").select("docid", "len")


def cursor(docids: Column, freqs: Column, at: Column | int) -> Column:
    """struct(docid, freq, next) of a posting list's place `at`, from 0: null past its end, next being the place that follows or null."""
    at = at if isinstance(at, Column) else F.lit(at)
    return F.when(at < F.size(docids), F.struct(F.get(docids, at).alias("docid"), F.get(freqs, at).cast("int").alias("freq"), F.when(at + 1 < F.size(docids), at + 1).alias("next")))
