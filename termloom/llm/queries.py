"""The queries of this subpackage, opN_<name>, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import ann, bytecnn, jpeg, line_chunks, mixing, neardup, packing, pseudonyms, repeats, toxicity
from .support import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


#: The setting that names the pseudonyms' key.
KEY = "spark.termloom.pseudonym.key"


def pseudonym_key(spark: SparkSession) -> str:
    """The key that the session names; where it names none, a secret one of this session, which nobody can turn back later."""
    if spark.conf.get(KEY, None) is None:
        spark.conf.set(KEY, secrets.token_hex(32))
    return spark.conf.get(KEY)


@query
def op1_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), pseudonym_key(spark)).select("doc_id", "text", "n_pseudonyms")


@query
def op2_probminhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(spark, table(spark, sf_dir, "documents")).select("doc_id", "class_id")


@query
def op3_linear_grouping_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, table(spark, sf_dir, "documents"))


@query
def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark, table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLES["op4_source_mixing"] = mixing.ORACLE


@query
def op5_induced_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove(spark, table(spark, sf_dir, "documents"))


@query
def op8_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_chunks.deduplicate(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_lines", "n_removed", F.md5("text").alias("kept_md5"))


ORACLES["op8_line_chunks"] = line_chunks.ORACLE


@query
def op6_baseline_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.media(table(spark, sf_dir, "documents"))


@query
def op10_weak_supervision_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.classify(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("row.doc_id", "held_out", "score", "predicted")


@query
def op9_byte_cnn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bytecnn.classify(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("row.doc_id", "held_out", "score", "predicted")


@query
def op7_cross_polytope_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(spark, vectors, vectors.where("vec_id % 50 = 0"))
