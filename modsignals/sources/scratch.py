"""Where intermediate tables go."""

import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A folder that the driver and every executor reach: the session's checkpoint folder, else its warehouse.

    A session with one machine needs no shared folder and falls back to a temporary one. Elsewhere a warehouse on a local disk
    is refused, since each executor would write to its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if (spark.sparkContext.master or "").startswith("local") and "cluster" not in spark.sparkContext.master:
        return tempfile.mkdtemp(prefix="modsignals-")
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    if urlparse(warehouse).scheme in ("", "file"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return warehouse


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/modsignals/{name}-{uuid.uuid4().hex}"
