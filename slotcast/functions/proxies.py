"""Supply, demand and weather-stress proxies."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from slotcast.functions.numeric import as_col


def solar_output(radiation, installed) -> Column:
    """Radiation in kW/m2 times capacity times a 0.75 performance ratio."""
    return as_col(radiation) / 1000.0 * as_col(installed) * 0.75


def wind_output(speed, installed) -> Column:
    """Wind speed relative to 10 m/s times capacity times a 0.3 load factor."""
    return as_col(speed) / 10.0 * as_col(installed) * 0.3


def residual_load(load, *renewables) -> Column:
    out = as_col(load)
    for r in renewables:
        out = out - as_col(r)
    return out


def thermal_capacity(total, *others) -> Column:
    """Total capacity less the other technologies; a missing capacity counts as 0."""
    out = as_col(total)
    for c in others:
        out = out - F.coalesce(as_col(c), F.lit(0.0))
    return out


def scarcity_ratio(load, resource) -> Column:
    """Load per unit of a resource that may be 0; NULL where the denominator is 0."""
    below = as_col(resource) + 1.0
    return as_col(load) / F.when(below != 0, below)


def heat_stress(temperature, limit: float = 35.0) -> Column:
    t = as_col(temperature)
    return F.when(t.isNotNull(), F.greatest(t - limit, F.lit(0.0)))


def cold_stress(temperature, limit: float = 15.0) -> Column:
    t = as_col(temperature)
    return F.when(t.isNotNull(), F.greatest(F.lit(limit) - t, F.lit(0.0)))


def first_present(columns, *names) -> str | None:
    """The first of ``names`` that is in ``columns``."""
    return next((n for n in names if n in columns), None)
