import os

import duckdb
import pytest

from tesserae import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(small, t)}.parquet'")
    return c


def plain(rows):
    out = []
    for r in rows:
        cells = []
        for v in r:
            if isinstance(v, bool) or v is None:
                cells.append(str(v))
            elif hasattr(v, "as_tuple") or isinstance(v, int | float):
                cells.append(repr(round(float(v), 6)))
            else:
                cells.append(str(v))
        out.append(tuple(cells))
    return sorted(out)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, small, name):
    mine = registry.queries()[name](spark, small)
    theirs = duck.sql(registry.oracle_sql()[name])
    assert sorted(mine.columns) == sorted(theirs.columns)
    cols = sorted(mine.columns)
    quoted = ", ".join(f'"{c}"' for c in cols)
    assert plain(mine.select(*[f"`{c}`" for c in cols]).collect()) == plain(theirs.project(quoted).fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_runs(spark, small, name):
    assert registry.queries()[name](spark, small).count() > 0
