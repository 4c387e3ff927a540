"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

#: Folders made for sessions on this machine alone, by application.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`; one is made only where none is set and all runs on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="verdictlake-")
        folder = _own[app]
    return folder
