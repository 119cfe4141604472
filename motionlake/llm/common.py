"""What the operators of this package share: word classes, shared storage and safe column names."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package

#: A word is a maximal run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir, which all executors share. Only where the session runs in one process may it be unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = os.path.join(tempfile.gettempdir(), "checkpoints")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: a cut of lineage that
    outlives any executor, and that later passes read instead of doing the work again."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_stored_at"] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables, once everything made of them is materialized itself."""
    for df in tables:
        if path := df.__dict__.get("_stored_at"):
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(docs: DataFrame, *keys: str) -> DataFrame:
    """doc_id, text, the other keys, and row: a struct of all columns of docs, whose names then clash with none of an operator's own."""
    return docs.select(*dict.fromkeys(("doc_id", "text", *keys)), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))


def unpacked(rows: DataFrame, docs: DataFrame, changed: dict[str, Column] | None = None) -> DataFrame:
    """The columns of docs from the struct of `packed`, some of them replaced."""
    changed = {k.lower(): v for k, v in (changed or {}).items()}
    return rows.select(*(changed.get(c.lower(), F.col("row").getField(c)).alias(c) for c in docs.columns))


def word_list(text: Column) -> Column:
    """The words of a text; none for null, an empty text or white space only."""
    inner = F.trim(F.translate(text, SPACES, " " * len(SPACES)))
    words = F.split(inner, " +")
    return F.when(F.coalesce(F.length(inner), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(words)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(*keys: Column) -> Column:
    """A number in [0, 1) that depends on the keys alone, so that reruns and retries agree."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11).cast("double") / F.lit(float(1 << 53))


def long_array(values: list[int]) -> Column:
    return F.from_json(F.lit(json.dumps(values)), "array<bigint>")


#: Rows and bytes of an Arrow batch: texts are held as a batch by the JVM and, twice, by the worker.
BATCH_ROWS, BATCH_BYTES = 4096, 4 << 20


def map_pandas(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """mapInPandas with this package on the workers' path, in batches of bounded bytes, which holds for the session
    from then on. Frames without rows are left out: pandas gives their text columns no chunks, which Arrow can't take."""
    spark = df.sparkSession
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.mapInPandas(lambda batches: (made for made in run(batches) if len(made)), schema)
