"""Registered queries against DuckDB on the smallest tables, and the entry without the corpus subpackage."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

DATA = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are absent")
@pytest.mark.parametrize("name", ["flagship_replay", "p9_valid_cusip", "b1_weekly_bars", "w21_collapse", "j1_asof_join", "u12_effective_holdings", "l2_fifo_lots", "st7_robust_scores", "j2_latest_as_of", "u1_membership_intervals", "u3_members_at", "k6_change_feed", "j14_reconcile", "a14_coverage_audit", "f12_success_label"])
def test_query_matches_sql(spark, name):
    import duckdb

    from asofkit.plans import registry

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents labels".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = registry.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(map(str, r)) for r in df.select(*cols).toPandas().astype(object).where(lambda x: x.notna(), None).itertuples(index=False))
    want = sorted(tuple(map(str, r)) for r in con.sql(f"SELECT {', '.join(cols)} FROM ({registry.ORACLES[name]})").df().astype(object).where(lambda x: x.notna(), None).itertuples(index=False))
    clean = lambda rows: [tuple(x.removesuffix(" 00:00:00").removesuffix(".0") for x in r) for r in rows]
    assert sorted(clean(got)) == sorted(clean(want))


@pytest.mark.parametrize("left", [(), ("asofkit/llm/__pycache__/queries.cpython-313.pyc",), ("corpus_pipeline.py",)])
def test_entry_imports_without_the_corpus_subpackage(tmp_path, left):
    """Also where a cache folder or the pipeline's file stayed behind."""
    import shutil

    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "asofkit", tmp_path / "asofkit", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in left:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("from asofkit.llm import nothing\n")
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q) and 'pipeline' not in q and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
