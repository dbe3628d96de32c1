"""Lineage cut by checkpoints in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df written by checkpoint(): steps that build on it don't compute it again, and a lost executor costs nothing.

    The folder is the session's spark.checkpoint.dir; only a session on this machine alone that names none gets one here.
    """
    sc, spark = df.sparkSession.sparkContext, df.sparkSession
    if not sc.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found:
            if not re.match(r"local(\[|$)", sc.master):
                raise RuntimeError("spark.checkpoint.dir is not set: checkpoints need a folder that driver and executors share")
            found = tempfile.mkdtemp(prefix="recollex-checkpoints-")
        sc.setCheckpointDir(found)
    return df.checkpoint()
