"""Shared scratch tables: lineage is cut by writing Parquet that every executor can reread.

The folder is the one the cluster names in ``spark.checkpoint.dir``. Only a single-process
``local`` master may go without that setting; it then gets a temporary folder of its own.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """URI of this application's scratch folder, below ``spark.checkpoint.dir``."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = _LOCAL_ROOTS.get(context.applicationId)
        if root is None:
            folder = tempfile.mkdtemp(prefix="loomgrid-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            root = _LOCAL_ROOTS[context.applicationId] = Path(folder).as_uri()
    return f"{root.rstrip('/')}/loomgrid/{context.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path in the scratch folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the scratch folder and return the reread table.

    The reread plan starts at a file scan with known size, so nothing upstream runs twice and
    Spark chooses broadcast or shuffle joins from true sizes. A lost executor loses nothing.
    ``files`` is for tables of a few rows, which would else be scattered over as many files as the
    step before has tasks.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    (df.repartition(files) if files else df).write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``settle`` returned, once all that reads them is settled itself."""
    for table in tables:
        _delete(table.sparkSession, table.scratch_path)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def settle_measured(df: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, dict]:
    """``settle``, and aggregates of the table that the same write takes, so that no job rereads it.

    They are taken in the write's own stage, whose tasks count once each even if they run again.
    """
    seen = Observation()
    table = settle(df.observe(seen, *[e.alias(k) for k, e in measures.items()]), name)
    return table, seen.get


def release(spark: SparkSession) -> None:
    """Delete this application's scratch folder; results not yet read are lost."""
    _delete(spark, scratch_root(spark))
