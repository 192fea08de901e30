"""Every registered query of the domain against its SQL in DuckDB, on the smallest tables."""

import glob
import os
import sys

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from tessera.plans import catalog


def rows(df):
    def plain(v):
        if pd.isna(v):
            return "~"
        return f"{float(v):.6g}" if isinstance(v, float) else str(v).removesuffix(" 00:00:00")

    names = sorted(df.columns)
    return names, sorted(tuple(plain(v) for v in r) for r in df[names].itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"create view {os.path.basename(f).removesuffix('.parquet')} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, sf, duck, name):
    assert rows(catalog.queries()[name](spark, sf).toPandas()) == rows(duck.sql(catalog.oracle_sql()[name]).df())


#: Queries that look for the oldest job with a message's address or phone.
OLDEST = ["classified_messages", "closing_outcomes", "closings_rematched", "jobs_marked_closed", "payment_signals"]


@pytest.mark.parametrize("name", OLDEST)
def test_a_text_is_read_once_and_all_keys_share_a_walk(spark, sf, name):
    """Figures of plans: how often words of a street are looked for (one more for a second text of a message), and walks."""
    plan = catalog.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("([A-Za-z]+)") <= 2 and plan.count("Window [") == 1


def shifted(sf, folder, con, **keys):
    """Links to the tables, and rows of some whose key is 10,000 greater beside their own: more customers or suppliers than numbers."""
    views = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(f).removesuffix(".parquet")
        if name in keys:
            more = f"select * replace ({keys[name]} + n * 10000 as {keys[name]}) from '{f}', range(2) r(n)"
            con.sql(f"copy ({more}) to '{folder}/{name}.parquet' (format parquet)")
        else:
            os.symlink(f, f"{folder}/{name}.parquet")
        views.sql(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return views


def test_customers_beyond_ten_thousand_have_numbers_of_their_own(spark, sf, tmp_path):
    views = shifted(sf, tmp_path, duckdb.connect(), customer="c_custkey")
    got = rows(catalog.queries()["phone_bindings_checked"](spark, str(tmp_path)).toPandas())
    assert got == rows(views.sql(catalog.oracle_sql()["phone_bindings_checked"]).df())


def test_suppliers_beyond_ten_thousand_have_numbers_of_their_own(spark, sf, tmp_path):
    views = shifted(sf, tmp_path, duckdb.connect(), supplier="s_suppkey")
    got = rows(catalog.queries()["previewed_messages"](spark, str(tmp_path)).toPandas())
    assert got == rows(views.sql(catalog.oracle_sql()["previewed_messages"]).df())


def test_every_query_is_registered():
    assert set(catalog.queries()) == set(catalog.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("absent", ["public_tokenizers", "tessera.llm.catalog", "corpus_pipeline"])
def test_entry_without_a_module(monkeypatch, absent):
    for name in [n for n in sys.modules if n.startswith(("tessera.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, absent, None)  # importing it fails
    found, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(catalog.queries()) <= set(found) and set(catalog.oracle_sql()) <= set(sql)
    assert "pipeline" not in found and any(n.startswith("op1_") for n in found) <= (absent == "corpus_pipeline")


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
