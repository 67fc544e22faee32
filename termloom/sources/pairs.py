"""Three-column delimited files as key to two values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import typed_key


def read_pairs(spark: SparkSession, path: str, key: str = "key", types: str = "long", sep: str = ",") -> DataFrame:
    """(key, a, b) of `key sep a sep b` lines: blank lines are skipped, of equal keys the last line counts. The lines'
    order is their place in the files."""
    parts = F.split("value", sep, -1)
    lines = spark.read.text(path).where(F.trim("value") != "")
    rows = lines.select(F.get(parts, 0).alias(key), typed_key(F.get(parts, 1), types).alias("a"), typed_key(F.get(parts, 2), types).alias("b"), F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("i")).alias("at"))
    return rows.groupBy(key).agg(F.max_by(F.struct("a", "b"), "at").alias("v")).select(key, "v.a", "v.b")
