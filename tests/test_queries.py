"""Registered queries against their SQL at the smallest scale.

A sample runs by default; ROLLBOOK_ALL=1 runs every query."""

import datetime
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = [
    "teacher_workload", "day_status", "global_search", "teacher_clash", "clashing_rows", "adjacent_gap", "version_diff", "routine_as_of", "activate_due", "timetable_grid",
    "resolve_names", "fuzzy_resolve", "unique_usernames", "period_rules", "upsert_duties", "plan_documents", "build_lines", "row_bands", "plan_weekly_off", "throttle",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if hasattr(v, "as_tuple"):
        return f"{float(v):.6g}"
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    return repr(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(str([norm(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(entry.queries()) if os.environ.get("ROLLBOOK_ALL") else SAMPLE)
def test_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = table(df.columns, df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    cur = duck.execute(sql)
    assert got == table([d[0] for d in cur.description], cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_sql():
    from rollbook.plans.registry import QUERIES

    assert set(QUERIES) <= set(entry.oracle_sql())


def test_no_nested_loops(spark):
    for name in ("teacher_clash", "remedial_clash", "fuzzy_resolve", "version_diff", "roster_candidates"):
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan, name


def test_names_are_resolved_once_for_all_rules(monkeypatch):
    """Other resolutions of the same names would keep Spark from sharing the shuffles behind them."""
    from unittest.mock import MagicMock

    from rollbook.plans import quality as P

    asked = []
    monkeypatch.setattr(P, "Q", MagicMock())
    monkeypatch.setattr(P, "_resolved", lambda t: asked.append(t) or "names")
    P.issue_totals(MagicMock())
    assert len(asked) == 1


def _names_asked(monkeypatch, run):
    """The plans of the names that a query resolves."""
    from rollbook.operators import quality as Q

    asked, resolve = [], Q.resolve_once
    monkeypatch.setattr(Q, "resolve_once", lambda names, *rest: asked.append(names) or resolve(names, *rest))
    run()
    return [n._jdf.queryExecution().optimizedPlan().toString() for n in asked]


def test_time_gaps_ask_for_no_names(spark, monkeypatch):
    assert _names_asked(monkeypatch, lambda: entry.queries()["gap_issues"](spark, SF)) == []


def test_classes_ask_for_names_of_lessons_and_read_them_once(spark, monkeypatch):
    out = []
    (plan,) = _names_asked(monkeypatch, lambda: out.append(entry.queries()["issues_by_class"](spark, SF)))
    assert "House Duty List" not in plan and "Ghost" not in plan
    assert out[0]._jdf.queryExecution().executedPlan().toString().count("/lineitem.parquet") == 1


def test_clashes_read_the_lessons_once(spark, monkeypatch):
    out = []
    (plan,) = _names_asked(monkeypatch, lambda: out.append(entry.queries()["clash_issues"](spark, SF)))
    assert "House Duty List" not in plan and "Ghost" not in plan
    assert "/lineitem.parquet" not in out[0]._jdf.queryExecution().executedPlan().toString()


def test_roster_audit_asks_for_no_names_of_lessons(spark, monkeypatch):
    (plan,) = _names_asked(monkeypatch, lambda: entry.queries()["roster_audit"](spark, SF))
    assert "House Duty List" in plan and "Time Table Board" not in plan
