"""A session with the settings the engine expects."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: What Spark sends a Python worker of the engine at once: see bounded_batches().
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def session(master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """UTC, adaptive execution on; other settings come from the cluster or conf."""
    b = SparkSession.builder.appName("lodeseek").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        b = b.master(master)
    for k, v in (conf or {}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def require(settings: dict, *names: str) -> dict:
    """The named settings; a KeyError names the first that is missing or empty."""
    for n in names:
        if not settings.get(n):
            raise KeyError(f"setting {n} is missing")
    return {n: settings[n] for n in names}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session, where checkpoints go too.

    Where it is unset, a local master gets a fresh temporary folder; any other is an error.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not path and sc.getCheckpointDir() is None and not re.match(r"local(\[|$)", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path or "file://" + tempfile.mkdtemp(prefix="lodeseek-"))
    return (path or sc.getCheckpointDir()).rstrip("/")


def bounded_batches(rows: DataFrame) -> DataFrame:
    """rows, whose session sends workers Arrow batches of at most BATCH_ROWS rows and BATCH_BYTES bytes from now on.

    Spark has these bounds as settings of a session only; lower ones that are set already stay. A worker's memory
    then doesn't grow with the rows of its partition, and no result changes.
    """
    conf = rows.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = re.fullmatch(r"(-?[0-9]+)b?", conf.get(f"spark.sql.execution.arrow.{name}"))
        if now is None or not 0 < int(now[1]) <= most:
            conf.set(f"spark.sql.execution.arrow.{name}", str(most))
    return rows


def fresh_folder(spark: SparkSession, kind: str) -> str:
    """A new folder's name below the shared one."""
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
