"""Session builder, tables in the shared folder, and the package on the workers' path."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent


def build(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that results depend on; sizes and cores come from the deployment."""
    builder = SparkSession.builder
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**settings, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def stored(df: DataFrame) -> DataFrame:
    """df written as a Parquet table in spark.checkpoint.dir, which all executors share, and read back: a cut of lineage, and of plans
    that would hold it many times. Only where the session runs in one process may the setting be missing."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = os.path.join(tempfile.gettempdir(), "checkpoints")
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers: through the session's file server, once a session,
    unless the workers' path has it already."""
    sc = spark.sparkContext
    if getattr(sc, "_motionlake_shipped", False):
        return
    on_path = any(p and Path(p).resolve() == PACKAGE.parent for p in os.environ.get("PYTHONPATH", "").split(os.pathsep))
    if not on_path:
        target = Path(tempfile.mkdtemp(prefix="motionlake")) / "motionlake.zip"
        with zipfile.ZipFile(target, "w") as z:
            for source in sorted(PACKAGE.rglob("*.py")):
                z.write(source, source.relative_to(PACKAGE.parent))
        sc.addPyFile(str(target))
    sc._motionlake_shipped = True
