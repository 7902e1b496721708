"""Every query of the catalogue against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import importlib
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from siftwarden.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="driver tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)].astype(object)
    clean = lambda v: None if v is None or v is pd.NaT or v is pd.NA or v != v else round(v, 6) if isinstance(v, float) else v
    return sorted(repr(tuple(map(clean, r))) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_against_sql(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), duck.sql(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["source", "n_findings", "risk_score", "grade"]
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("gone", [["siftwarden/llm", "tests/llm"], ["siftwarden/llm", "tests/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
@pytest.mark.parametrize("paths", [{}, {"PYTHONPATH": str(Path(__file__).resolve().parents[1])}])
def test_entry_without_corpus_operators(tmp_path, gone, paths):
    top = Path(__file__).resolve().parents[1]
    if paths and "siftwarden/llm" in gone:
        pytest.skip("the package itself would come from that path")
    shutil.copytree(top, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "__pycache__", *(Path(g).name for g in gone)))
    told = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len([n for n in q if n == 'pipeline' or n.startswith('op')]), len(q))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | paths
    run = subprocess.run([sys.executable, "-c", told], cwd=tmp_path / "copy", env=env, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    corpus, all_ = map(int, run.stdout.split())
    there = 0
    if (top / "siftwarden/llm/registry.py").exists():
        there = len(importlib.import_module("siftwarden.llm.registry").QUERIES)
    assert corpus == (there if gone == ["corpus_pipeline.py"] else 0)
    assert all_ - corpus == len(catalogue.QUERIES)


def test_findings_are_dealt_by_their_number(spark, duck, monkeypatch):
    """A task's findings don't grow with the table: so many tasks as rows want, whatever the session's number of partitions."""
    from siftwarden.plans import standins

    assert standins.tasks(spark, SF) is None
    monkeypatch.setattr(standins, "A_TASK", 500)
    n = -(-duck.execute("SELECT count(*) FROM lineitem").fetchall()[0][0] // 500)
    assert standins.tasks(spark, SF) == n > 4
    assert standins.findings(spark, SF).rdd.getNumPartitions() == n
    for name in ("first_last_seen", "fingerprint_dedupe", "resolve_open_findings", "sink_sarif_documents", "sink_report_documents"):
        assert rows(catalogue.QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(catalogue.ORACLES[name]).df())


def test_reports_deal_findings_before_their_texts_are_made(spark, capsys, monkeypatch):
    """Lines are read once, meet their scan, and are dealt by project as they are: what is shuffled doesn't grow by the texts."""
    from siftwarden.plans import standins

    monkeypatch.setattr(standins, "A_TASK", 500)
    catalogue.QUERIES["sink_report_documents"](spark, SF).explain("formatted")
    plan = capsys.readouterr().out.split("\n\n")
    assert sum("lineitem.parquet" in node for node in plan) == 1
    dealt = [node for node in plan if ") Exchange" in node]
    assert len(dealt) == 3 and not any(text in node for node in dealt for text in ("piece", "fingerprint", "file_path", "snippet"))
