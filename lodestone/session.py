"""Where the engine keeps scratch data of a session."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN = "lodestone.scratch"


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    Where that is not set, a session on one machine gets a folder of its own, deleted when Python ends; on a cluster it is an error,
    as executors would write to disks that the others do not see.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_OWN, None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        base = f"file://{path}"
        spark.conf.set(_OWN, base)
    return base.rstrip("/")


def scratch_root(spark: SparkSession) -> str:
    """A fresh folder for tables of a query, or for namespaces of one."""
    return f"{shared_root(spark)}/store-{spark.sparkContext.applicationId}/{uuid.uuid4().hex[:12]}"
