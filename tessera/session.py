"""The session that queries run in, and what its workers need."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def workers_find_package(spark: SparkSession) -> SparkSession:
    """Python workers import this package from where the driver has it, however the session was started."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in have:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, have)])
    return spark


_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession, name: str | None = None) -> str:
    """A fresh folder that the driver and every executor can reach (without a name, the folder that holds them).

    It lies in the folder that the session names in ``spark.checkpoint.dir``, or that was set as its checkpoint folder.
    Where there is neither, a temporary folder of this machine serves a local session and is set as the checkpoint
    folder; on a cluster, whose executors could not see it, that is an error.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or _own_dir.get(context.applicationId)
    if not base:
        given = context._jsc.sc().getCheckpointDir()
        if given.isDefined():
            base = given.get()
        elif re.fullmatch(r"local(\[.*\])?", context.master or ""):
            base = "file://" + tempfile.mkdtemp(prefix="tessera-")
            context.setCheckpointDir(base)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _own_dir[context.applicationId] = base
    return base.rstrip("/") + (f"/{name}-{uuid.uuid4().hex[:12]}" if name else "")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` in the shared checkpoint folder, its lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, read again: unlike a checkpoint it carries no constraints of the plan that
    made it, which pile up where each round of a loop is built on the one before."""
    path = shared_dir(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_session(cores: int = 8, memory: str = "8g", shuffle_partitions: int = 8) -> SparkSession:
    """A session on this machine, for tests and the bench. On a cluster, pass the cluster's own session instead."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tessera")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return workers_find_package(spark)
