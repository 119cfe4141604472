"""Sinks: aligned columns as one table, key/value summaries, CSV results, nested JSON and a short report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, by: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def key_values(one_row: DataFrame) -> DataFrame:
    """key, value (text) for each column of a one-row frame."""
    pairs = F.array(*(F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in one_row.columns))
    return one_row.select(F.explode(pairs).alias("p")).select("p.key", "p.value")


def write_summary(one_row: DataFrame, path: str) -> None:
    """summary as CSV and as text lines 'key: value'."""
    rows = key_values(one_row).coalesce(1)
    write_csv(rows, f"{path}/summary.csv")
    rows.select(F.concat_ws(": ", "key", F.coalesce("value", F.lit("")))).write.mode("overwrite").text(f"{path}/summary.txt")


def write_json(one_row: DataFrame, path: str) -> None:
    one_row.coalesce(1).write.mode("overwrite").json(path)


def report(summary: DataFrame, retrieval: DataFrame, top: int = 20) -> str:
    """Markdown of a one-row summary and the first rows of a retrieval table (at most `top`)."""
    lines = ["# Retrieval report", ""] + [f"- **{r['key']}**: {r['value']}" for r in key_values(summary).collect()]
    head = retrieval.columns
    lines += ["", "| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
    lines += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in retrieval.limit(top).collect()]
    return "\n".join(lines) + "\n"


def write_rollouts(frames: DataFrame, meta: DataFrame, policies: DataFrame, path: str) -> None:
    """Roll-outs as Parquet, their metadata as CSV with a header, and the names of the policies (policy_id, policy_name) as one JSON object."""
    write_table(frames, f"{path}/rollouts.parquet")
    write_csv(meta, f"{path}/meta.csv")
    pairs = F.array_sort(F.collect_list(F.struct(F.col("policy_id").cast("string"), "policy_name")))
    policies.agg(F.to_json(F.map_from_entries(pairs)).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/policy_names.json")


def write_features(style: DataFrame, path: str, legacy: DataFrame | None = None) -> None:
    """Style features, and the legacy set under both of its names if it is asked for."""
    write_table(style, f"{path}/feat_style.parquet")
    for name in ("feat", "feat_legacy") if legacy is not None else ():
        write_table(legacy, f"{path}/{name}.parquet")
