"""Every query with SQL of its own against DuckDB, and the entry point without the training-data operators."""

import math
import subprocess
import sys

import duckdb
import pytest

from sluice import queries

ORACLES = queries.oracles()


def rows(df):
    df = df[sorted(df.columns)]
    flat = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) or str(v) in ("NaT", "<NA>") else round(float(v), 4) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(map(flat, r)) for r in df.astype(object).values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, sf, name):
    found = queries.queries()[name](spark, sf).toPandas()
    if name not in ORACLES:
        assert len(found)
        return
    db = duckdb.connect()
    for t in queries.TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = db.execute(ORACLES[name]).df()
    assert sorted(found.columns) == sorted(want.columns)
    assert rows(found) == rows(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_training_operators():
    hide = "import sys; sys.modules['sluice.llm'] = None; import __spark_entry__ as e; assert len(e.queries()) > 50 and not any(q.startswith('op') for q in e.queries())"
    hide = hide.replace("sys.modules['sluice.llm'] = None", "import importlib.abc\nclass No(importlib.abc.MetaPathFinder):\n    def find_spec(self, name, path=None, target=None):\n        if name.startswith(('sluice.llm', 'corpus_pipeline')): raise ModuleNotFoundError(f'No module named {name!r}', name=name)\nsys.meta_path.insert(0, No())\n")
    hide = hide.replace("; class", "\nclass").replace("\n; import __spark_entry__", "\nimport __spark_entry__")
    subprocess.run([sys.executable, "-c", hide], check=True, cwd=__file__.rsplit("/", 2)[0], timeout=120)
