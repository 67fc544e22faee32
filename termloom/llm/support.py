"""What the operators share: table reading, lineage cuts and connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_DIRS: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application in spark.checkpoint.dir; a temporary one only on a local master that has none (tests)."""
    sc = spark.sparkContext
    app = sc.applicationId
    if app not in _DIRS:
        base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not base and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = base or f"file://{tempfile.mkdtemp(prefix='termloom-')}"
        _DIRS[app] = f"{base.rstrip('/')}/termloom-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_forget, spark, _DIRS[app])
    return _DIRS[app]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _forget(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        _delete(spark, path)


class Cut:
    """Tables of one operator call, written to the shared folder and read back: the plan behind them is not run again,
    and a lost executor costs the open stage alone."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{uuid.uuid4().hex[:12]}"
        self.paths: dict[int, str] = {}
        self.n = 0

    def __call__(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that no plan still needs."""
        if path := self.paths.pop(id(df), None):
            _delete(self.spark, path)


def packed(docs: DataFrame, **own: Column) -> DataFrame:
    """The whole input row as one struct `row`, beside own columns: extra columns of the input can't clash with them."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *[c.alias(k) for k, c in own.items()])


def components(cut: Cut, edges: DataFrame) -> DataFrame:
    """(node, root) for every node of undirected edges (a, b), root being the smallest node reachable.

    Alternating large-star and small-star rounds; each is one written table of edges, so memory is bounded by a
    partition and hubs are split by adaptive skew joins.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(low, both.a == low.u).where("b > u").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = cut(large)
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        pairs = large.join(low, large.a == low.u)
        small = pairs.select(F.col("b").alias("a"), F.col("m").alias("b")).union(pairs.select(F.col("u").alias("a"), F.col("m").alias("b")))
        after = cut(small.where("a <> b").distinct())
        cut.drop(large)
        cut.drop(edges)
        edges = after
        state = tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())
        if state == before:
            break
        before = state
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
