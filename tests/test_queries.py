"""Every query of the core against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from sagebrook.plans import registry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if hasattr(v, "isoformat"):
        return str(v)
    v = v.item() if hasattr(v, "item") else v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


def rows(df):
    cols = sorted(df.columns)
    return sorted((tuple(plain(v) for v in r) for r in df[cols].astype(object).values.tolist()), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_agrees_with_sql(spark, duck, name):
    got = registry.queries()[name](spark, str(DATA)).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert len(got)
        return
    want = duck.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_prompts_have_their_numbered_sources(spark):
    got = registry.queries()["user_prompt_sources"](spark, str(DATA)).toPandas()["prompt"]
    assert (got.str.contains("## Kaynak [^2] — ", regex=False) & got.str.contains("\n\n---\n\n", regex=False)).any()
    assert {p.split("\n")[0] for p in got} == {"Aşağıdaki kaynaklara dayanarak soruyu yanıtla.", "Answer the question based on the sources below."}
