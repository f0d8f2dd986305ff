"""Tables that are computed once and outlive a lost executor."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def materialize(df: DataFrame) -> DataFrame:
    """Compute a table once that a plan reads several times. The checkpoint lies in the folder that the session names in
    ``spark.checkpoint.dir``. Without one, a folder of this machine is made, but only where all tasks run on it."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="domlake-checkpoint-"))
    return df.checkpoint(eager=True)
