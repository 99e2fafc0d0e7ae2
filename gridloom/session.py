"""What the package asks of a session."""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_folder(spark: SparkSession) -> None:
    """Give checkpoints the folder that ``spark.checkpoint.dir`` names. Only where everything runs in one process may a
    temporary folder stand in for a setting that is absent."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="gridloom-"))


def ready(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it (a shared path, or shipped by --py-files), and
    see that checkpoints have a folder."""
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))
    checkpoint_folder(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def cut(df: DataFrame) -> DataFrame:
    """Compute once and keep the rows in the shared checkpoint folder, so that the lineage ends here.

    The rows are there when this returns, so the shuffles that made them can go at once; else they stay until the driver
    happens to collect its garbage. The setting holds for plans that are made under it.
    """
    checkpoint_folder(df.sparkSession)
    conf = df.sparkSession.conf
    before = conf.get(TIDY, None)
    conf.set(TIDY, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        if before is None:
            conf.unset(TIDY)
        else:
            conf.set(TIDY, before)


def shared_path(spark: SparkSession, *names: str) -> str:
    """A path in the shared folder of this application, the same for the same names."""
    checkpoint_folder(spark)
    sc = spark.sparkContext
    tag = hashlib.sha256("\0".join([sc.applicationId, *names]).encode()).hexdigest()[:24]
    return f"{sc.getCheckpointDir()}/{names[0]}-{tag}"
