"""Where the registered queries write, and how their workers find the package on this machine."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import cache
from pathlib import Path

from pyspark.sql import SparkSession


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh path under the folder that ``spark.checkpoint.dir`` names.

    Only on one machine may it be unset; then a temporary folder is made.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        root = _local_root()
    return os.path.join(root, f"{name}-{uuid.uuid4().hex}")


@cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="sparkseek-")


def workers_find_package(spark: SparkSession) -> None:
    """Python workers on this machine look for the package where the driver found it."""
    root = str(Path(__file__).resolve().parents[1])
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, root])
