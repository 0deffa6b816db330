"""Every registered query against its DuckDB oracle at sf0.01 (what the driver's correctness
gate does): same row count, same column names, same order-insensitive value hash."""

import pytest

from conftest import SF001, SF01
from oracle_harness import compare, duck

import __spark_entry__ as entry_mod

from chatsift.plans.oracles import ORACLES
from chatsift.plans.queries import QUERIES


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_mod.queries()) and set(ORACLES) <= set(entry_mod.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    res = compare(QUERIES[name](spark, SF01), con, ORACLES[name])
    assert res["cols_match"], res["cols"]
    assert res["rows"][0] == res["rows"][1], res["rows"]
    assert res["hash_match"], res["first_diff"]


def test_entry_smoke(spark):
    df = entry_mod.entry(spark)
    assert df.count() > 0
    assert df.columns == ["conv_id", "turn", "prompt_text", "completion_text", "n_prompt", "n_completion", "source"]


@pytest.fixture(scope="module")
def con_small():
    return duck(SF001)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle_smallest_scale(spark, con_small, name):
    res = compare(QUERIES[name](spark, SF001), con_small, ORACLES[name])
    assert res["cols_match"] and res["rows"][0] == res["rows"][1] and res["hash_match"], res
