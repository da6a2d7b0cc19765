"""Where intermediate files go: the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only a local master, whose executors are the driver's own process, may do without: there a
    temporary folder is set as that folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="sparray-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")
