import math

import duckdb
import pytest

from lambertlake import catalog

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def base():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    clean = lambda v: None if v is None else "nan" if isinstance(v, float) and math.isnan(v) else v + 0.0 if isinstance(v, float) else v
    return sorted((tuple(clean(r[i]) for i in order) for r in found), key=str)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_gives_the_rows_of_its_sql(spark, base, name):
    got = catalog.QUERIES[name](spark, SF)
    if name not in catalog.ORACLE_SQL:
        assert got.count() > 0
        return
    want = base.sql(catalog.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got.columns, map(tuple, got.collect())), rows(want.columns, want.fetchall())
    assert len(a) == len(b)
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    assert not wrong, wrong[:3]
    kind = lambda t: "float" if "DOUBLE" in t or "DECIMAL" in t or t == "FLOAT" else "int" if "INT" in t else "other"
    types = dict(zip(want.columns, (kind(str(t)) for t in want.types)))
    for c, t in got.dtypes:
        assert types[c] == ("float" if t == "double" else "int" if t in ("int", "bigint") else "other"), (c, t, types[c])
