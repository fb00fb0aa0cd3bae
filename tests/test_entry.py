"""The registry can be read without a session, and every query has a twin or a reason to have none."""

import subprocess
import sys
from pathlib import Path

#: Results that SQL can't express: models and tokenizers in the training-data part.
NO_TWIN = set()


def test_registry_needs_no_session():
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), len(s))"
    out = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[1], capture_output=True, text=True, timeout=120)
    n, m = map(int, out.stdout.split()[-2:])
    assert n >= m > 90


def test_twins():
    from loomlake.plans import registry
    import __spark_entry__ as entry

    entry.queries()
    assert set(registry.QUERIES) - set(registry.ORACLE_SQL) == NO_TWIN


def test_flagship(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert rows and rows[0].asDict().keys() == {"date", "count", "cumulative", "total_records", "unique_users"}
