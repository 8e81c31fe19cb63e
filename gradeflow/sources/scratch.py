"""Intermediate results in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the checkpoint folder, so that it survives lost executors and its plan is short.

    The folder is the session's, else what ``spark.checkpoint.dir`` names; only on a local master a
    temporary one is set in its absence, on a cluster its absence is an error.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="gradeflow-"))
    return df.checkpoint()
