"""Collections, topics and relevance judgements as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MEMBER = "collection.tsv"


def _split_valid(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(docid, docno, text) and the rejected (docid, line) of numbered lines (docid, line): a row is two non-empty
    fields apart by one tab, the first a whole number."""
    parts = F.split(F.trim(F.regexp_replace("line", r"^\s+|\s+$", "")), "\t", -1)
    number = F.expr("try_cast(parts[0] as bigint)")
    rows = lines.withColumn("parts", parts).withColumn("docno", F.when(F.size("parts") == 2, number)).withColumn("text", F.get("parts", 1))
    ok = F.col("docno").isNotNull() & (F.size("parts") == 2) & (F.coalesce(F.col("text"), F.lit("")) != "")
    return rows.where(ok).select("docid", "docno", "text"), rows.where(~ok).select("docid", "line")


def numbered(spark: SparkSession, path: str, limit: int = -1) -> DataFrame:
    """(docid, line) of text or .gz files: docid is the line's ordinal over all files, by path and place in them, bad lines
    included; a positive limit keeps the first so many. Lines are counted for each input split, whose lines follow each other."""
    at = ["_metadata.file_path", "_metadata.file_block_start"]
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col(at[0]).alias("file"), F.col(at[1]).alias("block"), F.monotonically_increasing_id().alias("id"))
    splits = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1))  # a row a split
    starts = splits.select(F.col("file").alias("file_"), F.col("block").alias("block_"), "first", F.coalesce(before, F.lit(0)).alias("start"))
    out = lines.join(starts, (lines.file == starts.file_) & (lines.block == starts.block_)).select((F.col("start") + F.col("id") - F.col("first")).alias("docid"), "line")
    return out.where(F.col("docid") < limit) if limit > 0 else out


def archived(spark: SparkSession, path: str, limit: int = -1, member: str = MEMBER, most: int = 1 << 30) -> DataFrame:
    """(docid, line) of a member of .tar.gz archives, read as a stream on an executor; bytes that aren't UTF-8 are replaced.

    Archives on mounted file systems are streamed from there. Of others the packed bytes are read as one value, so those of
    over `most` bytes are refused: unpack them, which also lets many tasks read them."""
    from urllib.parse import unquote, urlparse

    files = spark.read.format("binaryFile").load(path)
    places = files.select("path", "length").collect()  # a row an archive
    local = all(urlparse(r["path"]).scheme in ("", "file") for r in places)
    if not local and (large := [r["path"] for r in places if r["length"] > most]):
        raise ValueError(f"unpack {', '.join(large)}: an archive of over {most} bytes can be streamed from a mounted file system alone")
    files = files.select("path").withColumn("content", F.lit(None).cast("binary")) if local else files.select("path", "content")

    def lines(stream) -> Iterator[str]:
        import tarfile

        with tarfile.open(fileobj=stream, mode="r|gz") as tar:
            for info in tar:
                if info.name.removeprefix("./") == member:
                    for line in tar.extractfile(info):
                        yield line.decode("utf-8", "replace").rstrip("\n")
                    return
        raise ValueError(f"no member {member!r} in the archive")

    def run(batches) -> Iterator:
        import io
        from itertools import islice

        import pandas as pd

        n = 0
        for pdf in batches:
            for where, content in zip(pdf["path"], pdf["content"], strict=True):
                with open(unquote(urlparse(where).path), "rb") if local else io.BytesIO(content) as stream:
                    found = lines(stream)
                    while held := list(islice(found, min(10_000, limit - n) if limit > 0 else 10_000)):
                        yield pd.DataFrame({"docid": range(n, n + len(held)), "line": held})
                        n += len(held)

    return files.coalesce(1).mapInPandas(run, "docid long, line string")


def read_collection(spark: SparkSession, path: str, limit: int = -1) -> tuple[DataFrame, DataFrame]:
    """(docid, docno, text) and rejects of a .tar.gz with collection.tsv, a .tsv or .gz, or Parquet with doc_id and text."""
    if path.rstrip("/").endswith(".parquet"):
        return from_table(spark.read.parquet(path), limit)
    lines = archived(spark, path, limit) if path.endswith((".tar.gz", ".tgz")) else numbered(spark, path, limit)
    return _split_valid(lines)


def from_table(df: DataFrame, limit: int = -1, id_: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """A table whose ids are docids and docnos alike; rows without id or text are rejected. A positive limit keeps the
    first so many rows by id, rejects included."""
    rows = df.select(F.col(id_).cast("long").alias("docid"), F.col(id_).cast("long").alias("docno"), F.col(text).alias("text"))
    rows = rows.orderBy(F.asc_nulls_last("docid"), "text").limit(limit) if limit > 0 else rows
    ok = F.col("docno").isNotNull() & (F.coalesce(F.col("text"), F.lit("")) != "")
    return rows.where(ok), rows.where(~ok).select("docid", F.col("text").alias("line"))


def first_by_docno(rows: DataFrame) -> DataFrame:
    """Of rows of one docno, the one with the smallest docid. A partial minimum a task comes before the shuffle."""
    first = rows.groupBy("docno").agg(F.min(F.struct("docid", "text")).alias("first"))
    return first.select("first.docid", "docno", "first.text")


def each_docno(rows: DataFrame) -> DataFrame:
    """first_by_docno() where a docno comes twice, else the rows as they are: the texts are shuffled only if they must be."""
    return rows.select("docid", "docno", "text") if rows.groupBy("docno").count().where("count > 1").isEmpty() else first_by_docno(rows)


def fetch(rows: DataFrame, start: int, stop: int | None = None) -> DataFrame:
    """Rows of docno `start`, or in [start, stop); Parquet statistics prune the scan."""
    return rows.where(F.col("docno") == start) if stop is None else rows.where((F.col("docno") >= start) & (F.col("docno") < stop))


def topics(spark: SparkSession, path: str) -> DataFrame:
    """(qid, query): further tab-separated fields join the query by a blank."""
    parts: Column = F.split("value", "\t", -1)
    return spark.read.text(path).where("value <> ''").select(F.get(parts, 0).cast("long").alias("qid"), F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), " ").alias("query"))


def qrels(spark: SparkSession, path: str) -> DataFrame:
    """(qid, docid, rel) of blank-separated qid, iteration, docid, rel."""
    return spark.read.csv(path, sep=" ", schema="qid LONG, q0 STRING, docid LONG, rel INT").select("qid", "docid", "rel")
