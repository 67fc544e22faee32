"""The index of a table directory's documents, built once for a session."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..config import IndexConfig
from ..operators.index import Index, build
from ..sources.collections import from_table

_BUILT: dict[tuple[str, str, IndexConfig], Index] = {}
_BASES: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """A folder of this application, in the cluster's shared checkpoint folder if it names one."""
    app = spark.sparkContext.applicationId
    if app not in _BASES:
        sc = spark.sparkContext
        base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not base and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not base:
            own = tempfile.TemporaryDirectory(prefix="termloom-")
            atexit.register(own.cleanup)
            base = f"file://{own.name}"
        _BASES[app] = f"{base.rstrip('/')}/termloom-index-{uuid.uuid4().hex[:8]}"
    return _BASES[app]


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_table(spark.read.parquet(f"{sf_dir}/documents.parquet"))[0]


def index(spark: SparkSession, sf_dir: str, config: IndexConfig = IndexConfig()) -> Index:
    key = (spark.sparkContext.applicationId, sf_dir, config)
    if key not in _BUILT:
        _BUILT[key] = build(spark, rows(spark, sf_dir), config, f"{work_dir(spark)}/{len(_BUILT)}")
    return _BUILT[key]


def fresh(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one."""
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex[:8]}"
