"""The core problems against plain versions over the whole small tables."""

import brute
import pytest

from tidemark.plans import problems


def rows(spark, data, name, key):
    return brute.once([r.asDict(recursive=True) for r in spark.read.parquet(f"{data}/{name}.parquet").collect()], key)


@pytest.fixture(scope="module")
def inc(spark, data):
    return rows(spark, data, "aapl_income_quarter", "inc_id")


def found(spark, data, name):
    got = [tuple(r) for r in problems.QUERIES[name](spark, data).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_times(spark, data, inc):
    assert found(spark, data, "p5_found") == brute.p5(inc, rows(spark, data, "vsco_3m_daily", "env_id"))


def test_validity(spark, data, inc):
    assert found(spark, data, "p6_found") == brute.p6(rows(spark, data, "universe_events", "event_id"), inc)


def test_units(spark, data, inc):
    rates = [r.asDict() for r in spark.read.parquet(f"{data}/fx_rates.parquet").collect()]
    assert found(spark, data, "p2_found") == brute.p2(inc, rows(spark, data, "revenue_margins", "point_id"), rates)


def test_drift(spark, data):
    assert found(spark, data, "p4_found") == brute.p4(rows(spark, data, "aapl_segmentation", "seg_id"))


def test_nested(spark, data):
    out = set()
    for r in rows(spark, data, "vsco_3m_daily", "env_id"):
        raw = r["raw_response"] or {}
        own = (raw.get("search_metadata") or {}).get("id")
        key = own if own and own.strip() else str(r["env_id"])
        q = (r["request_params"] or {}).get("q")
        q = q if q is not None else (raw.get("search_parameters") or {}).get("q")
        for i, t in enumerate((raw.get("interest_over_time") or {}).get("timeline_data") or []):
            out |= {(key, q, "timeline", i, j) for j, v in enumerate((t or {}).get("values") or []) if v is not None}
        for b in ("top", "rising"):
            out |= {(key, q, b, i, 0) for i, v in enumerate((raw.get("related_queries") or {}).get(b) or []) if v is not None}
    assert found(spark, data, "p3_found") == out
