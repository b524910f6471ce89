"""Every query against its SQL on the smallest tables, and none empty that shouldn't be."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from veladura.plans.catalogue import ORACLE, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
EMPTY = {"filter_never", "reminders_due", "filter_end_of_day"}


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, db, tmp_path, name):
    rows = QUERIES[name](spark, SF)
    rows.write.parquet(f"{tmp_path}/out")
    cols = ", ".join(f'"{c}"' for c in sorted(rows.columns))
    db.execute(f"CREATE OR REPLACE TABLE want AS SELECT {cols} FROM ({ORACLE[name]})")
    db.execute(f"CREATE OR REPLACE TABLE got AS SELECT {cols} FROM '{tmp_path}/out/*.parquet'")
    assert db.execute("SELECT * FROM want EXCEPT ALL SELECT * FROM got").fetchall() == []
    assert db.execute("SELECT * FROM got EXCEPT ALL SELECT * FROM want").fetchall() == []
    if name not in EMPTY:
        assert db.execute("SELECT 1 FROM got LIMIT 1").fetchall()


def test_entry_registers_everything():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
