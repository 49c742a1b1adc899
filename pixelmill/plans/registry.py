"""All registered queries and their DuckDB twins."""

from __future__ import annotations

from pixelmill.plans import flagship, q_evaluate, q_images, q_models, q_prepare


def _modules():
    return [q_prepare, q_evaluate, q_models, q_images]


def all_queries() -> dict:
    out = {"feature_split_summary": flagship.feature_split_summary}
    for m in _modules():
        out.update(m.QUERIES)
    return out


def all_sql() -> dict:
    out = {"feature_split_summary": flagship.SQL.strip()}
    for m in _modules():
        out.update(m.SQL)
    return out
