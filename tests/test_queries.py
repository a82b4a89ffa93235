"""Every registered query against its SQL at the smallest scale."""

import functools
import re
from pathlib import Path
from urllib.parse import urlparse

import pytest

import compare
from areaindex.registry import ORACLES, QUERIES, outputs
from conftest import SF


@pytest.fixture(scope="module", autouse=True)
def score_once():
    """The queries over the scored table share one run of it here."""
    plain = outputs.scored
    outputs.scored = functools.lru_cache(plain)
    yield
    outputs.scored = plain


def event_log(spark) -> Path:
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    (log,) = Path(urlparse(spark.conf.get("spark.eventLog.dir")).path).glob("local-*")
    return log


@pytest.fixture(scope="module", autouse=True)
def log_start(spark):
    return event_log(spark).stat().st_size


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, name):
    verdict = compare.compare(con, QUERIES[name](spark, SF), name)
    assert verdict.startswith("ok"), verdict


def test_no_executed_plan_pairs_all_rows_or_runs_python(spark, log_start):
    """Over every plan that ran in this module, the landed parts of a query included."""
    with event_log(spark).open() as log:
        log.seek(log_start)
        plans = [line for line in log if "sparkPlanInfo" in line]
    nodes = {n for line in plans for n in re.findall(r'"nodeName":"([^"]+)"', line)}
    assert len(plans) > 2 * len(QUERIES) and any("SortMergeJoin" in n for n in nodes)
    assert not [n for n in nodes if re.search("Cartesian|BroadcastNestedLoop|Python|Pandas|Arrow", n)]
