"""Documents that arrive in files, indexed as they come."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..catalog import Catalog
from ..sources.collections import from_table


def follow(spark: SparkSession, folder: str, schema: str, catalog: Catalog, name: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append new Parquet files of doc_id and text in folder to an index. Each micro-batch is a batch of tables of its own,
    seen once it is whole; one that is replayed adds nothing, as documents already covered are left out."""
    stream = spark.readStream.schema(schema).parquet(folder)

    def add(batch, _):
        catalog.append(name, from_table(batch)[0])

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
