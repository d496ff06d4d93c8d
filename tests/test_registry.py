import ast
import pathlib
import re

import pytest

from __spark_entry__ import entry
from civicpulse.plans.oracles import ORACLES
from civicpulse.plans.registry import QUERIES
from tests.check import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, FOLDER, name) is None


def test_entry(spark):
    assert entry(spark).columns == ["resource", "city", "sentiment", "level", "geo", "n"]


def test_no_lineage_cut_on_executor_disks_and_no_cross_join():
    root = pathlib.Path(__file__).parent.parent / "civicpulse"
    for path in root.rglob("*.py"):
        source = path.read_text()
        ast.parse(source)
        assert not re.search(r"localCheckpoint|crossJoin|toPandas\(", source), path
