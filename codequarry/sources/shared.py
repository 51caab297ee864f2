"""The folder that the driver and all executors see."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """What the session names in spark.checkpoint.dir; a temporary folder only where driver and executors are one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("codequarry.shared.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a shared folder on {master}")
        folder = "file://" + tempfile.mkdtemp(prefix="codequarry-")
        spark.conf.set("codequarry.shared.dir", folder)
    return folder


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/codequarry/{uuid.uuid4().hex}"
