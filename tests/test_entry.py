import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__
from folioforge.plans.queries import ORACLES, QUERIES

ROOT = Path(__file__).resolve().parents[1]


def test_entry_needs_no_session_to_list_queries():
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()) >= 40, set(e.oracle_sql()) <= set(e.queries()))"], cwd=ROOT, capture_output=True, text=True)
    assert done.stdout.strip().endswith("True True"), done.stderr


def test_library_does_not_import_the_corpus_operators():
    for path in (ROOT / "folioforge").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "llm" not in path.read_text(encoding="utf-8"), path


SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SMALL).exists(), reason="needs the driver's tables")
def test_queries_equal_their_sql(spark):
    import duckdb

    db = duckdb.connect()
    db.execute("SET timezone = 'UTC'")
    for p in Path(SMALL).glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    plain = lambda v: round(float(v), 6) if isinstance(v, float) else str(v)
    for name, run in QUERIES.items():
        got = run(spark, SMALL)
        rows = got.collect()
        if name in ORACLES:
            cursor = db.execute(ORACLES[name])
            names = [c[0] for c in cursor.description]
            want = sorted(str([plain(v) for _, v in sorted(zip(names, r))]) for r in cursor.fetchall())
            assert sorted(str([plain(r[c]) for c in sorted(got.columns)]) for r in rows) == want and sorted(names) == sorted(got.columns), name


@pytest.mark.skipif(not Path(SMALL).exists(), reason="needs the driver's tables")
def test_flagship(spark):
    assert __spark_entry__.entry(spark).count() == 20
