"""Named queries over the driver's tables, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from .plans import api_plans, build_plans, decode_plans, diagnostic_plans, extract_plans, extract_rows, graph_plans, promotion_plans, rollup_plans, text_plans, token_plans

PLANS = (text_plans, graph_plans, extract_plans, extract_rows, decode_plans, build_plans, diagnostic_plans, token_plans, promotion_plans, rollup_plans, api_plans)


def _all() -> dict[str, tuple[Callable, str | None]]:
    return {name: pair for module in PLANS for name, pair in module.QUERIES.items()}


def queries() -> dict[str, Callable]:
    return {name: f for name, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
