"""Every grid query against its SQL on the small driver tables."""

import os

import duckdb
import pandas as pd
import pytest

from terracube.queries import QUERIES, SQL

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


def rows(df: pd.DataFrame) -> list:
    def plain(v):
        if pd.api.types.is_scalar(v) and pd.isna(v):
            return ""
        if hasattr(v, "item"):
            v = v.item()
        return repr(float(v)) if isinstance(v, float | int) and not isinstance(v, bool) else str(v)

    df = df[sorted(df.columns)]
    # rows are paired by their keys: what is not a rounded number comes first
    kinds = {c: any(isinstance(v, float) and v != round(v) for v in df[c].dropna()) for c in df.columns}
    return [tuple(plain(v) for v in r) for r in df.itertuples(index=False)], kinds


def paired(got: pd.DataFrame, want: pd.DataFrame) -> list[tuple[tuple, tuple]]:
    (a, k1), (b, k2) = rows(got), rows(want)
    names = sorted(got.columns)
    first = [i for i, c in enumerate(names) if not (k1[c] or k2[c])] + [i for i, c in enumerate(names) if k1[c] or k2[c]]
    order = lambda r: tuple(r[i] for i in first)
    assert len(a) == len(b)
    return list(zip(sorted(a, key=order), sorted(b, key=order), strict=True))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    for x, y in paired(got, want):
        assert x == y
