"""The index: document table, postings and lexicon as DataFrames; the text is analysed once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import IndexConfig
from ..functions.codec import coded_values, pack_values
from ..functions.terms import count_terms, term_lengths, term_lists
from .order import BITS


#: Terms of the texts whose postings one part holds, and the least worth a part.
PART, LEAST = 2_000_000, 100_000
#: Documents, and postings of theirs, that the edges of parts are taken from.
SAMPLED, EDGED = 1_000, 200_000


@dataclass(frozen=True)
class Index:
    """docs(docid, docno, len), postings(tok, docid, tf, len) sorted by tok, lexicon(tok, df, cf, max_tf, min_len), and totals.

    A posting carries its document's length, so that weights need no join; max_tf and min_len bound a term's weights."""

    config: IndexConfig
    docs: DataFrame
    postings: DataFrame
    lexicon: DataFrame
    n_docs: int
    total_len: int
    #: Whether docid is docno everywhere, so that the order of docids is that of docnos.
    same_ids: bool = False

    @property
    def average(self) -> float:
        return self.total_len / self.n_docs if self.n_docs else 0.0

    def persist(self) -> Index:
        """Keep the tables on the executors; Spark evicts what is least recently used."""
        for df in (self.docs, self.postings, self.lexicon):
            df.persist()
        return self

    def unpersist(self) -> None:
        for df in (self.docs, self.postings, self.lexicon):
            df.unpersist()

    def with_name(self, name: str) -> Index:
        return replace(self, config=replace(self.config, name=name))


def document_table(rows: DataFrame, config: IndexConfig) -> DataFrame:
    """(docid, docno, len): len is the number of terms after stop words, a lone empty term included."""
    return term_lengths(rows, config)


def distinct_ids(rows: DataFrame) -> bool:
    """Whether no docid comes twice; text is not shuffled for it."""
    return rows.groupBy("docid").count().where("count > 1").isEmpty()


def weighed_counts(rows: DataFrame, config: IndexConfig, distinct: bool | None = None) -> DataFrame:
    """(tok, docid, tf, len), counted within each text. Rows that share a docid are one document; they alone need a shuffle,
    so whether there are any is found first, unless `distinct` says it."""
    out = count_terms(rows, config)
    if distinct if distinct is not None else distinct_ids(rows):
        return out
    lengths = document_table(rows, config).groupBy("docid").agg(F.sum("len").cast("int").alias("len"))
    return out.groupBy("tok", "docid").agg(F.sum("tf").cast("int").alias("tf")).join(lengths, "docid").select("tok", "docid", "tf", "len")


def term_counts(rows: DataFrame, config: IndexConfig, distinct: bool | None = None) -> DataFrame:
    """(tok, docid, tf)."""
    return weighed_counts(rows, config, distinct).select("tok", "docid", "tf")


def lexicon(postings: DataFrame) -> DataFrame:
    """(tok, df, cf), and the largest tf and least length where postings have lengths."""
    more = [F.max("tf").alias("max_tf"), F.min("len").alias("min_len")] if "len" in postings.columns else []
    return postings.groupBy("tok").agg(F.count("*").alias("df"), F.sum("tf").cast("long").alias("cf"), *more)


def joined_lexicon(deltas: DataFrame) -> DataFrame:
    """One lexicon of those of several batches of documents."""
    return deltas.groupBy("tok").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"), F.max("max_tf").alias("max_tf"), F.min("min_len").alias("min_len"))


def statistics(docs: DataFrame, lexicon_: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("len"), F.lit(0)).cast("long").alias("total_len"), F.avg("len").alias("avg_len")).crossJoin(lexicon_.agg(F.count("*").alias("n_terms")))


def sorted_counts(counts: DataFrame, config: IndexConfig) -> DataFrame:
    """counts(tok, docid, tf, len) range-partitioned and sorted by term, so that a query's terms prune files and row groups. They are made
    twice, as ranges come of a sample of them."""
    parts = (config.parts,) if config.parts else ()
    return counts.select("tok", "docid", "tf", "len").repartitionByRange(*parts, "tok", "docid").sortWithinPartitions("tok", "docid")


def sorted_terms(rows: DataFrame, docs: DataFrame, config: IndexConfig, some: Callable[[float], DataFrame] | None = None) -> DataFrame:
    """sorted_counts() of rows(docid, text), one document a row, with lengths docs(docid, docno, len): all texts are analysed once, as
    ranges come of the terms of a few documents, and terms are shipped as lists. Their number follows the number of terms, so that no part grows.

    some: rows of about a fraction of the documents, where they are had for less than by a sample of rows."""
    n, total = docs.agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
    parts = config.parts or max(1, -(-total // PART), min(rows.sparkSession.sparkContext.defaultParallelism, total // LEAST))
    edges: list[tuple[str, int]] = []
    if parts > 1:
        few = min(1.0, SAMPLED / n)
        found = count_terms(some(few) if some else rows.sample(few, 1), config).select("tok", "docid")
        found = found.sample(min(1.0, EDGED / max(1.0, few * total)), 1)
        at = sorted(map(tuple, found.collect()))
        edges = [at[len(at) * i // parts] for i in range(1, parts)] if at else []
    lists = term_lists(rows, config, edges).repartitionById(parts, "part").sortWithinPartitions("tok", "first")
    each = lists.select("tok", F.posexplode("docids").alias("at", "docid"), "weighed").withColumn("w", F.get("weighed", "at"))
    # Lists overlap where slices' docids do; otherwise the rows are in order already and this sort only passes over them.
    return each.select("tok", "docid", F.shiftright("w", 32).cast("int").alias("tf"), F.col("w").bitwiseAND(2**32 - 1).cast("int").alias("len")).sortWithinPartitions("tok", "docid")


def write(spark: SparkSession, counts: DataFrame, docs: DataFrame, config: IndexConfig, path: str) -> None:
    """The tables of sorted postings counts(tok, docid, tf, len) and of all documents docs(docid, docno, len) under path."""
    counts.write.mode("overwrite").parquet(f"{path}/postings")
    postings = spark.read.parquet(f"{path}/postings")
    docs.select("docid", "docno", "len").repartitionByRange("docid").sortWithinPartitions("docid").write.mode("overwrite").parquet(f"{path}/docs")
    lexicon(postings).repartitionByRange("tok").sortWithinPartitions("tok").write.mode("overwrite").parquet(f"{path}/lexicon")
    if config.codec != "no":
        posting_blocks(postings, config.codec).write.mode("overwrite").parquet(f"{path}/lists")


def build(spark: SparkSession, rows: DataFrame, config: IndexConfig, path: str) -> Index:
    """Write the tables of rows(docid, docno, text) under path and read them back: later queries scan no text."""
    document_table(rows, config).write.mode("overwrite").parquet(f"{path}/lengths")
    docs = spark.read.parquet(f"{path}/lengths")
    if distinct_ids(docs):
        counts = sorted_terms(rows, docs, config)
    else:
        docs = docs.groupBy("docid").agg(F.min("docno").alias("docno"), F.sum("len").cast("int").alias("len"))
        counts = sorted_counts(weighed_counts(rows, config, False), config)
    write(spark, counts, docs, config, path)
    return load(spark, config, [path])


def load(spark: SparkSession, config: IndexConfig, paths: list[str], lexicons: list[str] | None = None) -> Index:
    """The index of batches of documents, each with its tables under a path; lexicons: where the batches' terms are."""
    docs = spark.read.parquet(*[f"{p}/docs" for p in paths])
    n, total, differs = docs.agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0)), F.max(~F.col("docid").eqNullSafe(F.col("docno")))).first()
    lexicons = lexicons or [f"{p}/lexicon" for p in paths]
    terms = spark.read.parquet(*lexicons)
    return Index(config, docs, spark.read.parquet(*[f"{p}/postings" for p in paths]), terms if len(lexicons) == 1 else joined_lexicon(terms), int(n), int(total), not differs)


def posting_blocks(postings: DataFrame, codec: str = "no") -> DataFrame:
    """(tok, block, docids, freqs), or (tok, block, n, code) with a codec: a term's postings, ascending, in rows of one block of
    2 ** BITS document ids each, so that a frequent term is many bounded rows. A block's first id is coded from its start.

    Sorted rows are cut into lists as they stream by; a task holds an Arrow batch and one unfinished list."""
    rows = postings.select("tok", F.shiftright("docid", BITS).alias("block"), "docid", "tf").repartition("tok", "block").sortWithinPartitions("tok", "block", "docid")

    def lists(tok, block, docid, tf, starts):
        import pyarrow as pa

        sizes = np.diff(starts, append=len(tf))
        first = [tok.take(pa.array(starts)), pa.array(block[starts])]
        if codec == "no":
            edges = pa.array(np.append(starts, len(tf)).astype(np.int32))
            return pa.RecordBatch.from_arrays([*first, pa.ListArray.from_arrays(edges, pa.array(docid)), pa.ListArray.from_arrays(edges, pa.array(tf))], ["tok", "block", "docids", "freqs"])
        code = pack_values(coded_values(docid, tf, sizes, block[starts] << BITS), 2 * sizes, codec)
        return pa.RecordBatch.from_arrays([*first, pa.array(sizes.astype(np.int32)), pa.array(code, pa.binary())], ["tok", "block", "n", "code"])

    def run(batches) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        held = []
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            if held[0] is not b and b.column("tok")[-1] == held[0].column("tok")[0] and b.column("block")[-1] == held[0].column("block")[0]:
                continue  # the list goes on
            all_ = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            tok, block = all_.column("tok"), all_.column("block").to_numpy()
            new = (np.diff(block) != 0) | pc.not_equal(tok[1:], tok[:-1]).to_numpy(zero_copy_only=False)
            starts = np.append(0, np.flatnonzero(new) + 1)
            last = int(starts[-1])
            if last:
                yield lists(tok[:last], block[:last], all_.column("docid").to_numpy()[:last], all_.column("tf").to_numpy()[:last], starts[:-1])
            held = [all_.slice(last)]
        if held:
            all_ = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            yield lists(all_.column("tok"), all_.column("block").to_numpy(), all_.column("docid").to_numpy(), all_.column("tf").to_numpy(), np.array([0]))

    return rows.mapInArrow(run, "tok string, block long, " + ("docids array<bigint>, freqs array<int>" if codec == "no" else "n int, code binary"))


def posting_gaps(postings: DataFrame, before_first: int = 0) -> DataFrame:
    """(tok, docid, gap) and all else postings have: difference to the docid before, the first one's to before_first. Gaps
    are taken within blocks of ids, whose first ones then get the last id of the block before."""
    rows = postings.withColumn("block", F.shiftright("docid", BITS))
    last = rows.groupBy("tok", "block").agg(F.max("docid").alias("last"))
    edge = F.lag("last", 1, before_first).over(Window.partitionBy("tok").orderBy("block"))
    before = F.lag("docid").over(Window.partitionBy("tok", "block").orderBy("docid"))
    out = rows.withColumn("before", before).join(last.select("tok", "block", edge.alias("edge")), ["tok", "block"])
    return out.withColumn("gap", F.col("docid") - F.coalesce("before", "edge")).select(*postings.columns, "gap")


def gap_decode(gapped: DataFrame, order: str = "at") -> DataFrame:
    """Running sums of gaps by an integer order, within blocks of it and then over blocks."""
    rows = gapped.withColumn("block", F.shiftright(order, BITS))
    sums = rows.groupBy("tok", "block").agg(F.sum("gap").alias("all"))
    base = F.coalesce(F.sum("all").over(Window.partitionBy("tok").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = F.sum("gap").over(Window.partitionBy("tok", "block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    out = rows.withColumn("inner", inner).join(sums.select("tok", "block", base.alias("base")), ["tok", "block"])
    return out.withColumn("docid", F.col("base") + F.col("inner")).select(*gapped.columns, "docid")


def content_ranges(docs: DataFrame, key: str = "docno") -> DataFrame:
    """(lo, hi): the fewest closed ranges that cover the keys. Ranges are joined within blocks of keys; those that touch a
    block's edge are joined within blocks of blocks, and the few that touch those's among themselves."""
    span, wide = 1 << BITS, 1 << 2 * BITS
    rows = docs.select(F.col(key).cast("long").alias("v")).where("v is not null").distinct().withColumn("block", F.shiftright("v", BITS))
    island = F.col("v") - F.row_number().over(Window.partitionBy("block").orderBy("v"))
    within = rows.withColumn("island", island).groupBy("block", "island").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).select("lo", "hi")
    touches = lambda n: (F.pmod("lo", F.lit(n)) == 0) | (F.pmod("hi", F.lit(n)) == n - 1)
    near = coalesce_ranges(within.where(touches(span)), F.shiftright("lo", 2 * BITS))
    return within.where(~touches(span)).union(near.where(~touches(wide))).union(coalesce_ranges(near.where(touches(wide))))


def coalesce_ranges(ranges: DataFrame, *within: Column) -> DataFrame:
    """Overlapping or adjacent (lo, hi) joined, in each group of `within`."""
    ranges = ranges.withColumn("group", F.struct(F.lit(0), *within))
    order = Window.partitionBy("group").orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.withColumn("new", F.when(reach.isNull() | (F.col("lo") > reach + 1), 1).otherwise(0))
    marked = marked.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("group", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select("lo", "hi")


def covered(value: int, ranges: DataFrame) -> bool:
    return not ranges.where((F.lit(value) >= F.col("lo")) & (F.lit(value) <= F.col("hi"))).isEmpty()


def ranges_to_text(ranges: list[tuple[int, int]]) -> str:
    return ";".join(f"{lo},{hi}" for lo, hi in ranges) or "empty"


def ranges_from_text(text: str) -> list[tuple[int, int]]:
    return [] if text == "empty" else [(int(a), int(b)) for a, b in (x.split(",") for x in text.split(";"))]


def missing_ids(docs: DataFrame, spark: SparkSession, first: int = 0, last: int | None = None, key: str = "docno") -> DataFrame:
    """Ids of [first, last] that docs lacks; last: its largest."""
    last = last if last is not None else int(docs.agg(F.coalesce(F.max(key), F.lit(-1))).first()[0])
    return spark.range(first, last + 1).withColumnRenamed("id", key).join(docs.select(key), key, "left_anti")
