"""Runnable queries on the driver's tables, each next to the SQL it must equal."""

from slotcast.registry import base, calibration, daily_rows, features, fitted, panels, shaping, sinks, sweeps

MODULES = (panels, features, daily_rows, calibration, shaping, sweeps, sinks, fitted)


def all_queries():
    return dict(base.QUERIES)


def all_sql():
    return {n: s() for n, s in base.SQL.items()}


__all__ = ["MODULES", "all_queries", "all_sql"]
