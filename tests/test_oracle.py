"""Every registered query with SQL gives the same columns, types and rows as DuckDB."""

import pytest

from check import compare, duck
from hazegrid.functions import aqi
from hazegrid.plans.catalog import ORACLES, QUERIES
from hazegrid.schema import SOURCE_RULES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF), con, ORACLES[name]) is None


def test_only_fits_and_samples_lack_sql():
    assert sorted(set(QUERIES) - set(ORACLES)) == [
        "m03_linear_estimator", "m04_random_forest", "m05_gradient_boosting", "m07_model_comparison",
        "m08_feature_importance", "m10_day_ahead_trees", "s16_pipeline_roundtrip"]


def test_entry(spark):
    import __spark_entry__ as e
    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name, rule", [("p26_traffic_score", "score_traffic"), ("p27_kiln_score", "score_brick_kiln"),
                                        ("p28_biomass_score", "score_biomass"), ("p29_construction_score", "score_construction")])
def test_a_changed_rule_differs_from_its_sql(spark, con, name, rule, monkeypatch):
    changed = SOURCE_RULES[rule] | {"above": {k: 2 * x for k, x in SOURCE_RULES[rule]["above"].items()}}
    monkeypatch.setitem(SOURCE_RULES, rule, changed)
    assert compare(QUERIES[name](spark, SF), con, ORACLES[name]) is not None


def test_changed_advice_differs_from_its_sql(spark, con, monkeypatch):
    monkeypatch.setattr(aqi, "ADVICE", [(51, *aqi.ADVICE[0][1:]), (110, *aqi.ADVICE[1][1:]), *aqi.ADVICE[2:]])
    assert compare(QUERIES["p18_advice"](spark, SF), con, ORACLES["p18_advice"]) is not None
