"""Session defaults and the shared folder that checkpoints and written tables use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "simloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of its own: on a cluster such a
    folder would exist on one machine only.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="simloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/simloom/{name}-{uuid.uuid4().hex}"


#: Estimated bytes up to which one more shuffle of a table costs less than the cores that its scan leaves idle.
SPREAD_BYTES = 1 << 30


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """A table under ``SPREAD_BYTES`` dealt by key over the cores; a larger one fills them with its own splits."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if int(str(size)) > SPREAD_BYTES:
        return df
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and go on from there (survives lost executors)."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
