"""The pipeline against a plain one, stage by stage."""

import sys
from collections import Counter
from pathlib import Path

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from motionlake.llm import neardup
from motionlake.llm.common import table
from motionlake.llm.queries import ORACLES, QUERIES

sys.path.insert(0, str(Path(__file__).parent))
import cases  # noqa: E402


def test_stages_in_order(spark, sf_dir):
    docs, names = table(spark, sf_dir, "documents"), [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "near_dedup", "mix", "encode"]
    columns, rows = docs.columns, {r["doc_id"]: r for r in docs.collect()}
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = out.collect()
        out = corpus_pipeline.materialize(stage(spark, out, sf_dir))
        assert out.columns == columns
        after = out.collect()
        if name == "quality_rules":
            assert {r["doc_id"] for r in after} <= {r["doc_id"] for r in before} and all(len((r["text"] or "").split()) >= 50 for r in after)
        if name == "line_dedup":
            lines = Counter(x for r in after for x in r["text"].split("\n") if x.strip())
            assert max(lines.values()) == 1 and set(lines) <= {x for r in rows.values() for x in r["text"].split("\n")}
        if name == "mix":
            assert set(Counter(r["doc_id"] for r in after).values()) <= {1, 2}
    last = corpus_pipeline.STAGES[-1][1](spark, out, sf_dir).collect()
    run = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter(map(tuple, last)) == Counter(map(tuple, run)) and len(last) == out.count()


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_odd_tables(spark, sf_dir, name, stage):
    """Nulls, empty and long texts, repeated rows, columns of clashing names, and no rows at all."""
    docs = cases.documents(spark).withColumns({c: F.lit("x") for c in ("copies", "target", "_other", "sid", "n_words")})
    given = Counter(cases.rows_of(docs))
    out = stage(spark, docs, sf_dir)
    found = Counter(cases.rows_of(out)) if name != "encode" else None
    if name == "encode":
        assert Counter(r["doc_id"] for r in out.select("doc_id").collect()) == Counter(i for i, _ in given.elements())
    else:
        assert out.columns == docs.columns and out.where("copies <> 'x' OR target <> 'x' OR kept <> 'k'").isEmpty()
    if name in ("quality_rules", "near_dedup"):
        assert found and not found - given
    if name == "mix":
        assert found and all(n <= 2 * given[r] for r, n in found.items())
    if name == "line_dedup":
        known = {x for _, t in given for x in (t or "").split("\n")}
        assert found and all(set((t or "").split("\n")) <= known for _, t in found)
    assert stage(spark, cases.empty(spark), sf_dir).isEmpty()


def test_near_duplicates_at_the_threshold_of_the_pipeline(spark, sf_dir):
    """All links of the pipeline's 0.8 against all pairs, and one document of each group stays."""
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    sql = ORACLES["op10_near_duplicates"].replace("85 *", "80 *")
    want = {r[0]: r[1] for r in con.sql(f"SELECT doc_id, component_id FROM ({sql})").fetchall()}
    docs = table(spark, sf_dir, "documents")
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs, percent=80).collect()}
    assert got == want
    assert {r["doc_id"] for r in neardup.one_of_each(docs, percent=80).collect()} == set(want.values())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = QUERIES[name](spark, sf_dir)
    want = con.sql(ORACLES[name])
    order = [want.columns.index(c) for c in got.columns]
    assert Counter(map(tuple, got.collect())) == Counter(tuple(r[i] for i in order) for r in want.fetchall())
