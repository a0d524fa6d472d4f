"""Collects the query and oracle registries of all plan modules."""

from __future__ import annotations


def all_queries() -> dict:
    from noticeflow.plans import analytics, ml, queries
    out = dict(queries.QUERIES)
    out.update(analytics.QUERIES)
    out.update(ml.QUERIES)
    return out


def all_oracles() -> dict:
    from noticeflow.plans import analytics_oracle, ml_oracle, oracle_queries
    out = dict(oracle_queries.ORACLE)
    out.update(analytics_oracle.ORACLE)
    out.update(ml_oracle.ORACLE)
    qs = all_queries()
    return {k: v for k, v in out.items() if k in qs}
