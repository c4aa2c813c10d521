"""Cutting lineage: a table that several later steps read is computed once."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage by files in the folder that spark.checkpoint.dir names, which driver and executors share.

    A folder of this machine stands in only where the setting is absent and all work is on this machine, as in tests.
    """
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="strandloom-"))
    return df.checkpoint(eager=True)
