"""Colors that tell many lines of a chart apart, and tables that charts are drawn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.metrics import pivoted

# Hues, where saturation and value start, what a round takes off, and the least of both.
HUES, START, FADE, FLOOR = 12, 0.9, 0.05, 0.5


def distinct_color(index: Column) -> Column:
    """struct(r, g, b), each 0 to 1: hues around the wheel, paler after each round, darker after every second one."""
    hue = (index % HUES) / HUES
    saturation = F.greatest(F.lit(FLOOR), F.lit(START) - FADE * F.floor(index / HUES))
    value = F.greatest(F.lit(FLOOR), F.lit(START) - FADE * F.floor(index / (2 * HUES)))

    def channel(shift: int) -> Column:
        # How far the hue is from the channel's own part of the wheel, as a share of full strength.
        at = (shift + hue * 6) % 6
        return value - value * saturation * F.greatest(F.lit(0.0), F.least(at, 4 - at, F.lit(1.0)))

    return F.struct(channel(5).alias("r"), channel(3).alias("g"), channel(1).alias("b"))


def heat_table(records: DataFrame, metric: str, qids: list[int]) -> DataFrame:
    """A row a run, a column a topic, ordered by run; null where a run lacks a topic."""
    return pivoted(records, metric, qids).orderBy("name")
