"""Small tables that later steps read."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame


def settle(df: DataFrame) -> DataFrame:
    """`df` computed once and read from the checkpoint folder from then on. Where none is set,
    local sessions get a temporary one, and a cluster raises a RuntimeError."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or os.path.join(tempfile.gettempdir(), f"rollcast-{os.getpid()}"))
    return df.checkpoint()
