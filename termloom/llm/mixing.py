"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .support import Cut, packed

#: White space that separates words.
WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix(
    spark: SparkSession,
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    repeats: int = 3,
    seed: str = "mix",
    rows_per_bucket: int = 2_000,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, finish_cut, taken) for each row of docs(doc_id, text, source).

    Sources, ordered by code point with null last, weigh `weights` in turn. They share the words of all documents;
    a target stops at `repeats` times its source's words and the excess is shared again by weight. Each source is a
    flow of its documents in a shuffled order that depends on seed and doc_id alone, repeated up to `repeats` times;
    a document's virtual finish time is its source's words up to its end, divided by the source's target. All
    finish times are sorted globally and the mix is cut where the total budget is used up.

    Null doc_id sorts first; null or wordless text has size 0 and is never taken; equal rows are separate documents;
    an empty table gives an empty result. Other columns of docs are not looked at.
    """
    cut = Cut(spark)
    base = docs.select(docs["doc_id"].alias("doc_id"), docs["source"].alias("source"), word_count(docs["text"]).alias("size"))
    base = cut(base.withColumn("h", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))) 
    sources = targets(base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), weights, repeats)
    sources = cut(sources)
    total, n = sources.agg(F.sum("source_size"), F.sum("n")).first()
    if not total:
        return base.select("doc_id", "source", "size", F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("taken"))
    # A running sum over a source that may hold a third of all rows: in hash-range buckets first.
    digits = 1
    while 16**digits * rows_per_bucket < n:
        digits += 1
    base = base.join(F.broadcast(sources) if sources.count() < 10_000 else sources, base.source.eqNullSafe(sources.source)).select(base["*"], "rank", "source_size", "target").withColumn("bucket", F.substring("h", 1, digits))
    sums = base.groupBy("rank", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("rank").alias("r"), F.col("bucket").alias("k"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
    inner = Window.partitionBy("rank", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    flow = base.join(sums, (base["rank"] == sums.r) & (base.bucket == sums.k)).withColumn("sent", F.col("offset") + F.sum("size").over(inner))
    flow = cut(flow.select("doc_id", "source", "size", "source_size", "target", "rank", "h", "sent"))

    def finish(epoch: Column) -> Column:
        return (epoch * F.col("source_size") + F.col("sent")).cast("double") / F.col("target")

    order = ["finish", "rank", "h", "doc_id"]
    entries = flow.where("size > 0 and target > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    entries = entries.select(finish(F.col("epoch")).alias("finish"), "rank", "h", "doc_id", "size")
    parts = max(8, int(n * repeats / 100_000))
    ranged = cut(entries.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    sums = ranged.groupBy("part").agg(F.sum("size").alias("words"), F.min("finish").alias("first"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("part").alias("p"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
    running = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # Only the partition in which the budget ends needs its rows summed one by one.
    edge = sums.where(F.col("offset") < total).orderBy(F.desc("offset"), F.desc("p")).limit(1)
    last = (
        ranged.join(F.broadcast(edge), ranged.part == edge.p)
        .withColumn("running", F.col("offset") + F.sum("size").over(running))
        .where(F.col("running") <= total)
        .agg(F.max(F.struct(*order)).alias("last"))
    )
    low = ranged.join(F.broadcast(edge), ranged.part < edge.p).agg(F.max(F.struct(*order)).alias("last"))
    cutoff = last.union(low).agg(F.max("last").alias("last")).first()["last"]
    if cutoff is None:
        taken = F.lit(0)
    else:
        edge_key = F.struct(F.lit(cutoff["finish"]), F.lit(cutoff["rank"]), F.lit(cutoff["h"]), F.lit(cutoff["doc_id"]).cast(flow.schema["doc_id"].dataType))
        key = lambda e: F.struct(finish(F.lit(e)), "rank", "h", "doc_id")
        taken = sum((F.when((F.col("size") > 0) & (F.col("target") > 0) & (key(e) <= edge_key), 1).otherwise(0) for e in range(repeats)), F.lit(0))
    return flow.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * taken).alias("taken"))


def mixed(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of docs as often as mix() takes it, with all its columns.

    Rows equal in doc_id, source and size are taken as often together as mix() says, dealt evenly among them."""
    cut = Cut(spark)
    taken = mix(spark, docs, **options).where("size > 0")
    taken = taken.groupBy("doc_id", "source", "size").agg((F.sum("taken") / F.first("size")).cast("int").alias("times"), F.count("*").cast("int").alias("rows"))
    taken = cut(taken.where("times > 0").select(F.col("doc_id").alias("id"), F.col("source").alias("src"), F.col("size").alias("words"), "times", "rows"))
    own = packed(docs, a=docs["doc_id"], b=docs["source"], c=word_count(docs["text"]), d=F.xxhash64(docs["text"]))
    found = own.join(taken, own.a.eqNullSafe(F.col("id")) & own.b.eqNullSafe(F.col("src")) & (own.c == F.col("words")))
    out = found.where("rows = 1").select("row", F.explode(F.sequence(F.lit(1), F.col("times"))))
    if not taken.where("rows > 1").isEmpty():
        each = Window.partitionBy("id", "src", "words").orderBy("d")
        several = found.where("rows > 1").withColumn("n", F.row_number().over(each) - 1)
        share = F.floor(F.col("times") / F.col("rows")) + F.when(F.col("n") < F.col("times") % F.col("rows"), 1).otherwise(0)
        several = several.withColumn("share", share.cast("int")).where("share > 0")
        out = out.union(several.select("row", F.explode(F.sequence(F.lit(1), F.col("share")))))
    return out.select("row.*")


def targets(sources: DataFrame, weights: tuple[int, ...], repeats: int) -> DataFrame:
    """Adds rank, weight and target to (source, source_size, ...): the water level at which capped shares use the budget.

    With the sources ordered by cap / weight, the level if the first i are capped is (budget - their caps) / (weights
    of the rest); it peaks at the true one. Single-partition windows run over one row a source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    every = Window.partitionBy(F.lit(1))
    out = sources.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1)))
    out = out.withColumn("cap", F.col("source_size") * repeats)
    filled = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    out = out.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) / F.sum("weight").over(filled.rowsBetween(0, Window.unboundedFollowing)))
    return out.withColumn("target", F.least(F.col("cap").cast("double"), F.max("level").over(every) * F.col("weight")))


ORACLE = r"""
with base as (
  select row_number() over () as rid, doc_id, source, md5('mix:' || coalesce(doc_id::varchar, '')) as h,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size
  from documents),
s as (select source, sum(size)::bigint as source_size from base group by source),
r as (select *, row_number() over (order by source is null, source) as rank from s),
w as (select *, case (rank - 1) % 3 when 0 then 5::double when 1 then 2::double else 1::double end as weight, source_size * 3 as cap from r),
l as (select *, (sum(source_size) over () - coalesce(sum(cap) over (order by cap / weight, rank rows between unbounded preceding and 1 preceding), 0))::double
    / sum(weight) over (order by cap / weight, rank rows between current row and unbounded following) as level from w),
t as (select *, least(cap::double, max(level) over () * weight) as target from l),
f as (select b.rid, b.doc_id, b.h, b.size, t.rank, t.source_size, t.target,
    sum(b.size) over (partition by t.rank order by b.h, b.doc_id nulls first, b.size rows unbounded preceding)::bigint as sent
  from base b join t on b.source is not distinct from t.source),
e as (select rid, doc_id, h, size, rank, (epoch * source_size + sent)::double / target as finish
  from f, (select unnest([0, 1, 2]) as epoch) where size > 0 and target > 0),
c as (select *, sum(size) over (order by finish, rank, h, doc_id nulls first rows unbounded preceding) as running from e),
k as (select rid, count(*) as times from c where running <= (select sum(size) from base) group by rid)
select f.doc_id, f.size, f.source_size, f.target, (f.size * coalesce(k.times, 0))::bigint as taken
from f left join k using (rid)
"""
