"""Ordinals and prefix sums over integer keys without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bits of a key that one window covers; four windows cover a key.
BITS = 16


def bases(rows: DataFrame, key: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., block, base): the number of rows of the group whose key lies in an earlier block of 2 ** BITS keys.

    Counts are summed block by block, then over blocks of blocks, so that no window holds more than 2 ** BITS rows."""
    up = lambda c: F.shiftright(c, BITS)
    levels = [rows.groupBy(*by, up(F.col(key)).alias("b1")).agg(F.count("*").alias("n"))]
    for i in (2, 3):
        levels.append(levels[-1].groupBy(*by, up(F.col(f"b{i - 1}")).alias(f"b{i}")).agg(F.sum("n").alias("n")))
    out = None
    for i, counts in reversed(list(enumerate(levels, 1))):
        inside = Window.partitionBy(*by, *([up(F.col(f"b{i}"))] if i < 3 else [])).orderBy(f"b{i}").rowsBetween(Window.unboundedPreceding, -1)
        own = counts.select(*by, f"b{i}", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("own"))
        if out is None:
            out = own.withColumnRenamed("own", "base")
        else:
            out = own.withColumn(f"b{i + 1}", up(F.col(f"b{i}"))).join(out, [*by, f"b{i + 1}"]).select(*by, f"b{i}", (F.col("own") + F.col("base")).alias("base"))
    return out.withColumnRenamed("b1", "block")


def ordinals(rows: DataFrame, key: str, name: str = "ordinal", by: tuple[str, ...] = (), ties: tuple[str, ...] = ()) -> DataFrame:
    """rows with their place from 0 in the order of an integer key, in each group of `by`. Keep rows narrow: they are shuffled."""
    block = F.shiftright(F.col(key), BITS)
    place = F.row_number().over(Window.partitionBy(*by, "block").orderBy(key, *ties)) - 1
    placed = rows.withColumn("block", block).withColumn("place", place)
    return placed.join(bases(rows, key, by), [*by, "block"]).withColumn(name, (F.col("base") + F.col("place")).cast("long")).select(*rows.columns, name)
