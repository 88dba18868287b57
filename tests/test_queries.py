import importlib

import pytest

from docweave.plans import catalog, oracle


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_same_as_sql(same_as_sql, name):
    rows = same_as_sql(catalog.QUERIES[name], oracle.SQL[name])
    assert len(set(rows)) > 1 or name in ("q41_ttl_expiry", "q03_garbled_counts", "q67_settings")


def test_all_registered():
    entry = importlib.import_module("__spark_entry__")
    assert set(catalog.QUERIES) <= set(entry.queries())
    assert len(catalog.QUERIES) == 68


def test_entry(spark):
    entry = importlib.import_module("__spark_entry__")
    assert {r["route"] for r in entry.entry(spark).collect()} >= {"text", "ocr"}
