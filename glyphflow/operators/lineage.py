"""Cutting the lineage of frames that grow step by step."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame

_LOCAL: list[tempfile.TemporaryDirectory] = []


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the folder that spark.checkpoint.dir names, which all executors share; a folder of this machine serves
    only where that is unset and the master is local."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not shared:
            _LOCAL.append(tempfile.TemporaryDirectory(prefix="glyphflow-"))
        context.setCheckpointDir(shared or "file://" + _LOCAL[-1].name)
    return df.checkpoint()
