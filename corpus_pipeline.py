"""The pipeline from documents to packed training sequences: five stages over the operators of termloom.llm.

Stages but the last return the columns of documents, for the rows and texts that they keep:

- toxicity: documents with a score of 0.3 or more go. The classifier learns from labels outside the held-out fold.
- line_dedup: repeated runs of two or more lines, of 80 characters or more, leave all texts but the first; a document of which nothing but white space
  is left goes, and n_chars follows the text.
- near_dedup: one document of each class of near-duplicates stays, the one with the smallest doc_id.
- mixing: a document comes as often as the mix takes it, up to three times; n_chars and all other columns are kept.
- packing: the token pieces of all documents, placed in sequences of at most 1024 tokens.

Nulls, empty texts, ties, equal rows and empty tables are treated as each operator's docstring says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm import line_chunks, mixing, neardup, packing, toxicity
from termloom.llm.support import Cut, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.classify(spark, docs, table(spark, sf_dir, "labels")).where("predicted = 0").select("row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_chunks.remove_repeats(spark, docs).where("n_removed = 0 or text rlike '[^ \\\\t\\\\r\\\\n]'")
    changed = F.col("n_removed") > 0
    new = {"text": F.col("text"), "n_chars": F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return out.select(*[new[c].alias(c) if new.get(c) is not None else F.col(f"row.{c}").alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.deduplicate(spark, docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(spark, docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(spark, docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL expresses neither the classifier nor the signatures; tests/llm hold the stages' operators against brute force and run()
#: against its stages one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Each stage is written to the shared folder and read back for the next."""
    cut = Cut(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
