"""Where tasks on different machines can meet."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of input after which memory is given back.
TRIMMED = 4 << 20


def trim(size: int = 1 << 62) -> None:
    """Gives back what work on ``size`` bytes, or a task, has freed: workers live on, and would keep it beside the next task's."""
    if size <= TRIMMED:
        return
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir``, else the checkpoint folder of the context, else one set here for local runs.

    On a cluster, where a folder of this machine is seen by nobody else, one of the first two must be set."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = at.get() if at.isDefined() else None
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="avrospark-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
