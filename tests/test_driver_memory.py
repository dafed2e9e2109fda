"""No table that grows with the input is sent through the driver, however small its files are."""

import pytest

from marlgate.operators.raw import display_of_raw
from marlgate.plans import analysis, queries
from marlgate.plans.analysis import stored_fixture


@pytest.fixture
def plans(spark, monkeypatch):
    """The plans of all tables that are stored: at this size Spark's estimates would have every join broadcast."""
    found, store = {}, analysis.cut

    def cut(df, name, *args):
        found[name] = _plan(df)
        return store(df, name, *args)

    monkeypatch.setattr(analysis, "cut", cut)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    return found


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _sent(plans: dict[str, str]) -> list[str]:
    return [name for name, plan in plans.items() if "Broadcast" in plan]


def test_pages_and_entries_stay_where_they_lie(spark, data, plans):
    a = stored_fixture(spark, data)
    for name in ("mapped", "mapped_numbers", "named_figures", "captions", "below", "refs_in_context"):
        plans[name] = _plan(getattr(a, name))
    assert {"texts", "carried", "entries"} < set(plans) and not _sent(plans)


def test_display_documents_stay_where_they_lie(spark, data, plans):
    a = stored_fixture(spark, data)
    plans["elements"] = _plan(a.elements)
    plans["figure_list"] = _plan(a.figure_list)
    plans["display"] = _plan(a.display())
    plans["figures alone"] = _plan(stored_fixture(spark, data).display(only=("figures",)))
    assert {"figures", "mapped"} < set(plans) and not _sent(plans)


def test_raw_documents_stay_where_they_lie(spark, data, plans):
    a = stored_fixture(spark, data)
    plans["raw"], plans["counts"] = _plan(a.raw), _plan(a.counts)
    plans["display of raw"] = _plan(display_of_raw(a.raw))
    assert not _sent(plans)


def test_queries_of_mentions_send_nothing(spark, data, plans):
    plans["overlay_primitives"] = _plan(queries.overlay_primitives(spark, data))
    plans["overlay_images"] = _plan(queries.overlay_images(spark, data))
    plans["mapping_rate"] = _plan(queries.mapping_rate(spark, data))
    assert not _sent(plans)
