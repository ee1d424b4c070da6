"""Every registered query against its oracle on the smallest driver tables."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as driver
from testbed import suites
from testbed.compare import connect, problem

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")

# Fitted values, which SQL can't tell: their checked forms have oracles.
FITTED = {
    "rf_lag_fit", "recursive_forecast", "indicator_extend", "forecast_4y", "forecast_balance_4y", "monthly_mart",
    "forecast_holdout_errors",
}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_registry():
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert set(suites.QUERIES) - set(suites.ORACLES) == FITTED


@pytest.mark.parametrize("broken", ["tidemark.llm", "tidemark.llm.queries", "corpus_pipeline", "numpy.absent"])
def test_other_queries_stay_without_the_corpus_part(broken):
    """In an interpreter of its own, one module of the corpus part can't be imported."""
    code = f"import sys; sys.modules[{broken!r}] = None; import __spark_entry__ as d; print(len(d.queries()), 'pipeline' in d.queries(), set(d.oracle_sql()) <= set(d.queries()))"
    here = os.path.dirname(driver.__file__)
    out = subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=here, capture_output=True, text=True, check=True).stdout.split()
    whole = len(driver.queries()) if broken == "numpy.absent" else len(suites.QUERIES)
    assert out == [str(whole), str(broken == "numpy.absent" and "pipeline" in driver.queries()), "True"]


def test_entry(spark):
    assert driver.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(suites.ORACLES))
def test_oracle(spark, con, name):
    wrong, _ = problem(suites.QUERIES[name](spark, SF), con, suites.ORACLES[name])
    assert wrong is None


@pytest.mark.parametrize("name", sorted(FITTED))
def test_runs(spark, name):
    assert suites.QUERIES[name](spark, SF).count() > 0
