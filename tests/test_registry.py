from pathlib import Path

import __spark_entry__ as entry
from tidemark import queries

WANTED = {p: n for p, n in dict(S=28, P=29, J=28, A=52, W=21, T=9, U=6, F=27, C=9, M=17, H=9).items()}


def test_every_operator_has_a_query():
    want = {f"{p}{i}" for p, n in WANTED.items() for i in range(1, n + 1)} - {"A34"}  # A34 does not exist
    assert want == set(queries.coverage())


def test_coverage_document_is_current():
    from tools.coverage import render

    assert (Path(__file__).resolve().parents[1] / "COVERAGE.md").read_text() == render()


def test_entry_runs_small(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["predictor_id", "task_id"] and df.count() > 0


def test_oracle_keys_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
