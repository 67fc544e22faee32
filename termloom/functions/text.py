"""Text to terms, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The English stop words without an apostrophe.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself "
    "they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having "
    "do does did doing a an the and but if or because as until while of at by for with about against between into through during before "
    "after above below to from up down in out on off over under again further then once here there when where why how all any both each "
    "few more most other some such no nor not only own same so than too very s t can will just don should now d ll m o re ve y ain aren "
    "couldn didn doesn hadn hasn haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn"
).split()


def clean(text: Column) -> Column:
    """Lower-case ASCII letters and digits, all else one blank, none at the ends."""
    return F.trim(F.lower(F.regexp_replace(text, "[^a-zA-Z0-9]+", " ")))


def tokens(text: Column, keep_stop: bool = True) -> Column:
    """Terms in order. A text that cleans to nothing has one empty term, unless stop words are removed and it is one."""
    out = F.split(clean(text), " ")
    if keep_stop:
        return out
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(out, lambda t: ~F.array_contains(stop, t))


def terms_of(text: str, keep_stop: bool = True) -> list[str]:
    """tokens() of one short text on the driver, as a query is."""
    out = re.sub("[^a-zA-Z0-9]+", " ", text).lower().strip(" ").split(" ")
    return out if keep_stop else [t for t in out if t not in STOP_WORDS]


def typed_key(value: Column, kind: str = "long") -> Column:
    """A key read from text: as it is, or a whole number, the empty string being 0 and what is no number null."""
    if kind == "string":
        return value
    return F.when(F.trim(value) == "", F.lit(0).cast("long")).otherwise(F.trim(value).try_cast("long"))
