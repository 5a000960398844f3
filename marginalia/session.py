"""Session helpers shared by the operators: table access, shared storage and partition sizing."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "marginalia", cpus: int | str = 8, **conf: str) -> SparkSession:
    """A local session with the settings the tests and the benchmark use; a cluster passes its own."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "16g",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of the cluster (spark.checkpoint.dir); only a local session without one gets a temporary folder.

    On a cluster a machine's own folder would not be shared, so a missing setting is an error there.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not configured and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        sc.setCheckpointDir(configured or os.path.join(tempfile.gettempdir(), "marginalia-checkpoints"))


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the checkpoint folder and continue from the written copy.

    Used where a result is read more than once, or where its partitioning must
    not change between two reads. The copy is on storage all executors share,
    so it outlives a lost executor.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
