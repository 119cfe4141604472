"""The canonical metadata table against the cases that it is for."""

import pytest
from pyspark.sql import functions as F

from motionlake.sources import metadata


def base(spark, n, split="test"):
    return spark.range(n).select(F.col("id").alias("row_index"), F.lit(split).alias("split"))


def made(found):
    table, provenance, warnings = found
    rows = {r["row_index"]: r.asDict() for r in table.collect()}
    return rows, {r["column"]: r["source"] for r in provenance.collect()}, sorted(r["warning"] for r in warnings.collect())


def test_a_whole_table_is_kept(spark):
    table = spark.createDataFrame([(0, "1", "b", "20", "80", "7", "1", "x", "train"), (1, "0", "a", "bad", "80", None, "0", None, None)], "position long, row_index string, scenario_id string, start string, window_len string, front_id string, policy_id string, policy_name string, split string")
    rows, source, warnings = made(metadata.canonical(base(spark, 2), table))
    assert rows[0] == {"row_index": 0, "scenario_id": "a", "start": 0, "window_len": 80, "front_id": "", "policy_id": 0, "policy_name": "", "source_index": None, "split": "test", "source_key": "a|0|80|"}
    assert rows[1]["source_key"] == "b|20|80|7" and rows[1]["policy_name"] == "x" and rows[1]["split"] == "train"
    assert source == {"scenario_id": "table", "start": "table", "window_len": "table", "front_id": "table", "policy_id": "table", "policy_name": "table", "source_index": "none", "split": "table", "source_key": "key_fields"}
    assert warnings == []


def test_rows_in_another_order_are_numbered_anew(spark):
    """Row 5 is beyond the range and row 1 stands twice: ties go by the window's key, then by position."""
    table = spark.createDataFrame([(0, "5", "d"), (1, "1", "c"), (2, "1", "b"), (3, None, "a")], "position long, row_index string, scenario_id string")
    rows, _, warnings = made(metadata.canonical(base(spark, 4), table))
    assert [rows[i]["scenario_id"] for i in range(4)] == ["b", "c", "a", "d"]
    assert warnings == ["row_index is not 0 to n - 1: numbered anew"]


def test_a_table_of_another_length_is_left_out(spark):
    table = spark.createDataFrame([(0, "0", "a")], "position long, row_index string, scenario_id string")
    rows, source, warnings = made(metadata.canonical(base(spark, 3), table))
    assert all(r["scenario_id"] == "" and r["source_key"] == "|0|0|" for r in rows.values()) and len(rows) == 3
    assert source["scenario_id"] == "default" and "the table has 1 rows, not 3: left out" in warnings


def test_what_is_missing_is_inferred(spark):
    """Two sources of two rows: numbers by source key, policies by order, names from policies."""
    table = spark.createDataFrame([(0, "0", "b"), (1, "1", "a"), (2, "2", "b"), (3, "3", "a")], "position long, row_index string, scenario_id string")
    rows, source, warnings = made(metadata.canonical(base(spark, 4), table))
    assert [(r["source_index"], r["policy_id"], r["policy_name"]) for _, r in sorted(rows.items())] == [(1, 0, "policy_0"), (0, 0, "policy_0"), (1, 1, "policy_1"), (0, 1, "policy_1")]
    assert (source["source_index"], source["policy_id"], source["policy_name"]) == ("inferred", "inferred", "derived")
    assert warnings == ["policy_id inferred from the order within sources", "source_index inferred from source_key"]
    uneven = spark.createDataFrame([(0, "0", "b"), (1, "1", "a"), (2, "2", "b")], "position long, row_index string, scenario_id string")
    rows, source, _ = made(metadata.canonical(base(spark, 3), uneven))
    assert all(r["policy_id"] is None and r["policy_name"] == "" for r in rows.values()) and source["policy_id"] == "none"


@pytest.mark.parametrize("with_table", [True, False])
def test_side_files_come_first(spark, with_table):
    table = spark.createDataFrame([(0, "0", "4", "t"), (1, "1", "5", "t")], "position long, row_index string, policy_id string, policy_name string") if with_table else None
    side = {"policy_id": spark.createDataFrame([(0, "9"), (1, "x")], "row_index long, value string"), "source_index": spark.createDataFrame([(0, "3"), (1, "3")], "row_index long, value string")}
    rows, source, _ = made(metadata.canonical(base(spark, 2), table, side))
    assert [(rows[i]["policy_id"], rows[i]["source_index"]) for i in (0, 1)] == [(9, 3), (None, 3)]
    assert [rows[i]["policy_name"] for i in (0, 1)] == (["t", "t"] if with_table else ["policy_9", ""])
    assert source["policy_id"] == source["source_index"] == "side_file"


def test_no_rows(spark):
    rows, _, warnings = made(metadata.canonical(base(spark, 0)))
    assert rows == {} and warnings == []
