"""Queries over the given tables, each with the SQL that must agree with it."""

from checks.registry import QUERIES, SQL


def all_queries():
    from checks import (  # noqa: F401
        demand_queries, forecast_queries, mixture_queries, result_queries, sampling_queries,
        source_queries, start_queries, stream_queries, time_queries, window_queries,
    )
    return QUERIES, SQL
