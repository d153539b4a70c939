"""Tables written between steps, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one where a local session (tests) names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = found.get() if found.isDefined() else None
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="tidewater-")
    return _own[app]


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet and read back: later steps start from it, and joins see its true size."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
