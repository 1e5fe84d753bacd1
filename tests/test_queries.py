"""Every core query against its SQL, or that it runs where SQL can't express it."""

import pytest
from conftest import DATA, same_rows

from scrubline.plans import queries


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    rows = df.collect()
    if name in queries.ORACLES:
        found = duck.sql(queries.ORACLES[name])
        same_rows(rows, df.columns, found.fetchall(), list(found.columns))
    else:
        assert len(df.columns) > 1


def test_core_does_not_import_the_training_data_subpackage():
    from pathlib import Path

    root = Path(queries.__file__).parents[1]
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "llm" not in path.read_text()
