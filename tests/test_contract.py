"""Every query against its SQL on the smallest tables, and the driver's entry."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from wiretide.plans import contract

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    plain = lambda v: None if v is None or v is pd.NA or v != v else round(v, 9) if isinstance(v, float) else v
    return sorted(tuple(str(plain(v)) for v in r) for r in frame.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    got, want = contract.queries()[name](spark, DATA).toPandas(), duck.sql(contract.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    number = lambda f: f.apply(lambda c: pd.to_numeric(c) if c.dtype.kind in "iuf" else c)
    assert rows(number(got)) == rows(number(want))


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_document_is_one_row(spark):
    found = contract.queries()["json_document"](spark, DATA).collect()
    assert len(found) == 1 and found[0].analysis.startswith('{"assets":')


def test_document_in_parts_is_the_document(spark):
    from wiretide.plans import analysis
    from wiretide.plans.report import dump
    from wiretide.sources import lens

    v = contract.View(spark, DATA)
    tables = analysis.Tables(v.tcp, v.sessions, v.segments.drop("payload"), v.high, v.low, v.initiators, contract._vendors(spark, DATA))
    found = analysis.document_parts(tables, lens.CAPTURE, {}, size=300).collect()
    assert len(found) > 3 and max(len(r.analysis) for r in found) < sum(len(r.analysis) for r in found) / 2
    assert "".join(r.analysis for r in sorted(found)) == dump(analysis.document(tables, lens.CAPTURE, {}).analysis)
