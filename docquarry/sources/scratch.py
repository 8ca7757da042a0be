"""A folder of its own in the place that all machines share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

from ..plans.errors import EngineError

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession, what: str) -> str:
    """Below the session's spark.checkpoint.dir; where it is unset, and all runs on one machine, in a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise EngineError("UNAVAILABLE", "on a cluster, spark.checkpoint.dir must name a folder that all machines share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="docquarry-")
        root = _own[app]
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"
