"""Results that several later steps read: written once to the shared folder, without their lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def settle(df: DataFrame) -> DataFrame:
    """A checkpoint in the folder that spark.checkpoint.dir names; a folder of its own only where none is set."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        where = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not where and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(where or f"file:///tmp/checkpoints/{uuid.uuid4().hex}")
    return df.checkpoint(eager=True)
