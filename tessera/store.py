"""Intermediate tables that outlive executors.

``cut`` writes a DataFrame as Parquet under the folder that the session names in ``spark.checkpoint.dir`` (or that was set
by ``SparkContext.setCheckpointDir``) and reads it back, so later plans start from files that every executor sees. Where neither is set, a folder is made
if the session runs in one process (``local[...]``); on a cluster that would lose rows without an error, so ``cut`` raises instead.
``drop`` deletes a table that no later plan reads; what is left at the end of the driver's process goes with it, in shared folders too.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    set_by_hand = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_by_hand.isDefined():
        return set_by_hand.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="tessera-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return f"file://{_LOCAL[0]}"


def cut(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")  # the shuffle files of a table that is written serve no other plan
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(schema).parquet(path)
    out._cut_at = path
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return out


def drop(*tables: DataFrame) -> None:
    """Delete the files of tables made by ``cut`` once nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._cut_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
