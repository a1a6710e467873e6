"""The driver's contract: names, SQL and whole agreement with DuckDB for a few queries on the smallest tables."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

DATA = Path("/root/testdata/sf0.001")
SAMPLE = ["flagship_page_report", "URL8_surt_key", "TXT1_search_text", "PRD7_unresolved_failures", "JN9_resolve_resource", "AGG6_archive_quality", "JN16_page_identity", "SRC11_SNK6_ORD9_tar_export", "SNK7_wacz", "STM10_tuner", "JN20_peer_archives", "AGG3_storage_summary", "AGG8_issue_report", "WIN3_AGG20_cleanup_plan", "SRC5_JN5_shared_pages", "STM3_next_run", "GRF1_crawl_frontier"]


def test_names():
    import __spark_entry__ as e

    queries = e.queries()
    assert set(e.oracle_sql()) <= set(queries) and set(SAMPLE) <= set(queries)


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_equals_sql(spark, name):
    import duckdb

    from webstrata import catalog

    got = catalog.queries()[name](spark, str(DATA))
    db = duckdb.connect()
    for f in DATA.iterdir():
        db.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    want = db.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    plain = lambda v: round(v, 6) if isinstance(v, float) else int(v) if hasattr(v, "as_tuple") else v
    ours = sorted((tuple(plain(r[c]) for c in sorted(names)) for r in got.collect()), key=repr)
    theirs = sorted((tuple(plain(v) for _, v in sorted(zip(names, r, strict=True))) for r in want.fetchall()), key=repr)
    assert ours == theirs


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("gone", [["webstrata/llm"], ["webstrata/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_other_queries_load_without_the_training_data_subpackage(tmp_path, gone):
    root = Path(__file__).resolve().parent.parent
    skip = shutil.ignore_patterns(".git", "__pycache__", "tests", *(g.split("/")[-1] for g in gone))
    shutil.copytree(root, tmp_path / "copy", ignore=skip)
    assert not any((tmp_path / "copy" / g).exists() for g in gone)
    code = "import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); assert set(o) <= set(q); print(sum(not k.startswith('op') for k in q), 'pipeline' in q)"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", env={**os.environ, "PYTHONPATH": str(tmp_path / "copy")}, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    n, pipeline = out.stdout.split()
    assert int(n) > 200 and pipeline == "False"
