"""Tables that several later steps read, written once to the folder that the cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def stored(df: DataFrame) -> DataFrame:
    """df from a checkpoint in spark.checkpoint.dir; a folder of the machine only where the master is local and none is set."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
    return df.checkpoint()
