"""Every registered query against its SQL, value by value."""

import pytest

from codeloom.queries import registry
from tests.conftest import SF_DIR

QUERIES = registry()
TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "boolean": "BOOLEAN"}


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    query, sql = QUERIES[name]
    df = query(spark, SF_DIR)
    cols = sorted(df.columns)
    mine = [tuple(r) for r in df.select(*cols).collect()]
    cur = duck.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    kinds = {c[0]: str(c[1]) for c in cur.description}
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema} == kinds
    at = [names.index(c) for c in cols]
    theirs = [tuple(r[i] for i in at) for r in cur.fetchall()]
    assert mine, "a query without rows checks nothing"
    assert _sorted(mine) == _sorted(theirs)
