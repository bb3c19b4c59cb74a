"""Shipping the package to executors that don't have it installed."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors, once an application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="sievework-code-")
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(f"{folder}/sievework-{uuid.uuid4().hex[:8]}.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    spark.sparkContext.addPyFile(z.filename)
    _shipped.add(app)


def settled(df: DataFrame) -> DataFrame:
    """df computed once: a checkpoint in the folder that spark.checkpoint.dir names, or kept in memory where the session names none."""
    return df.checkpoint() if df.sparkSession.conf.get("spark.checkpoint.dir", None) else df.persist()


def spread(df: DataFrame) -> DataFrame:
    """df dealt evenly over the cores, before steps that take much time a row: a small file of many rows is read by a task or two, and what follows would stay with them."""
    return df.repartition(parts(df.sparkSession))


def parts(spark: SparkSession) -> int:
    """How many parts rows are dealt into that take much time each."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
