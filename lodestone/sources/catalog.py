"""The list of namespaces under a root folder."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..validate import NAME
from .files import Files


def namespaces(spark: SparkSession, root: str) -> DataFrame:
    """(name, created_at) of every namespace that a write created, in order of name."""
    files, found = Files(spark), []
    for name in files.names(root.rstrip("/")):
        if NAME.fullmatch(name):
            states = [n for n in files.names(f"{root}/{name}/_meta") if n.endswith(".json") and not n.startswith(".")]
            if states:
                found.append((name, json.loads(files.read(f"{root}/{name}/_meta/{states[-1]}"))["created_at"]))
    return spark.createDataFrame(found, "name string, created_at long").orderBy(F.col("name"))
