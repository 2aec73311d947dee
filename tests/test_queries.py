"""Every registered query against its comparison SQL on the smallest tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry_file  # noqa: E402
from packetloom.catalog import QUERIES  # noqa: E402
from tests.check_oracles import compare  # noqa: E402

SMALL = "/root/testdata/sf0.001"
TEXTS = entry_file.oracle_sql()


def test_every_query_has_comparison_sql():
    assert set(QUERIES) <= set(TEXTS)
    assert set(TEXTS) <= set(entry_file.queries())


def test_entry(spark):
    assert entry_file.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    ok, message = compare(spark, SMALL, name, entry_file.queries()[name], TEXTS.get(name))
    assert ok, message
