"""The feature plan: lags, day statistics, proxies, calendar, fuel and rain, leakage-safe."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotcast.functions import calendar as cal
from slotcast.functions import proxies as px
from slotcast.functions.numeric import finite_columns, row_median, row_sum
from slotcast.limits import CUTOFF_SLOT, Limits
from slotcast.operators import daystats, lags


@dataclass(frozen=True)
class FeatureSpec:
    """Input columns by role. Every role is optional but the target; absent columns are skipped."""

    y: str = "smp_system_price"
    # fixed values: column names of the sources and stems of the features made from them
    y_stem: str = "smp"
    load: str = "load_total_mw"
    load_stem: str = "load"
    north: str = "smp_north_price"
    central: str = "smp_central_price"
    south: str = "smp_south_price"
    lagged: tuple = (
        ("smp_system_price", "smp_same_cycle"), ("load_total_mw", "load_same_cycle"),
        ("load_north_mw", "load_north_same_cycle"), ("load_central_mw", "load_central_same_cycle"),
        ("load_south_mw", "load_south_same_cycle"), ("smp_north_price", "smp_north_same_cycle"),
        ("smp_south_price", "smp_south_same_cycle"), ("hydro_inflow_m3s", "hydro_inflow_same_cycle"),
        ("hydro_total_discharge_m3s", "hydro_discharge_same_cycle"),
        ("hydro_water_level_m", "hydro_level_same_cycle"),
    )
    lagged_prefixes: tuple = (
        "temperature_", "humidity_", "cloud_cover_", "wind_speed_",
        "shortwave_radiation_", "direct_radiation_", "diffuse_radiation_", "disp_",
    )
    fuel: tuple = ("coal_proxy_price", "brent_price", "gas_proxy_price", "usd_vnd")
    radiation: str = "shortwave_radiation_hcmc"
    wind: str = "wind_speed_hcmc"
    capacity: str = "disp_{}_installed_mw"
    rain: str = "precipitation"
    heat: tuple = (("hn", ("temperature_2m_hn", "temperature_hanoi")), ("hcmc", ("temperature_2m_hcmc", "temperature_hcmc")))
    cold: tuple = (("hn", ("temperature_2m_hn", "temperature_hanoi")),)
    lag_days: tuple = lags.LAG_DAYS
    weekly: tuple = (7, 14, 28)
    load_forecast: tuple = (1, 2, 7, 14)
    quantile_days: int = 28
    cutoff: int = CUTOFF_SLOT
    limits: Limits = Limits()


def lag_prefixes(columns, spec: FeatureSpec) -> dict[str, str]:
    """Source column to lag prefix: the named ones, then weather and capacity by prefix."""
    out = {c: p for c, p in spec.lagged if c in columns}
    out.update({c: f"{c}_same_cycle" for c in columns if c.startswith(spec.lagged_prefixes)})
    return out


def daily_inputs(features: list[str], spec: FeatureSpec = FeatureSpec()) -> tuple[list[str], list[str]]:
    """(profile, scalar) columns of the daily models among ``features``.

    Profile columns differ by slot: lags of the target and the load, load forecasts and
    the newest weather lags. Scalar columns are one value per day.
    """
    lagged = (f"{spec.y_stem}_same_cycle_", f"{spec.load_stem}_same_cycle_", "load_forecast_")
    weather = tuple(p for p in spec.lagged_prefixes if p != "disp_")
    daily = ("morning_", "prev_full_", f"{spec.y_stem}_rolling_", "low_rate_", "is_")
    profile = [c for c in features if c.startswith(lagged) or (c.startswith(weather) and c.endswith("_same_cycle_1d"))]
    return profile, [c for c in features if c.startswith(daily) or c == "season"]


def add_features(df: DataFrame, spec: FeatureSpec = FeatureSpec()) -> DataFrame:
    """All features on a gap-free panel. Rows and keys are unchanged.

    A panel that arrives partitioned by series is shuffled once, to meet the day table,
    which is 1/48 of it; lags and long means are windows inside a series. ``df`` is read
    twice, so hand over a written table when it is costly to compute.
    """
    staged = _time_shifted(df, spec)
    joined = daystats.attach_day_features(staged, _day_table(df, spec))
    return finite_columns(_arithmetic(joined, df.columns, spec))


def _time_shifted(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    rain = [c for c in df.columns if spec.rain in c.lower()]
    if rain:
        df = df.withColumn("precip_total", row_sum(rain))
    fuel = [c for c in spec.fuel if c in df.columns]
    means = {f"{c}_rolling_7d": (c, 7, 2, 168) for c in fuel}
    if rain:
        means["precip_rolling_7d"] = ("precip_total", 7, 1, 168)
        means["precip_rolling_30d"] = ("precip_total", 30, 1, 720)
    if means:
        df = lags.running_parts(df, list(dict.fromkeys(m[0] for m in means.values())))
    out = {}
    for col, prefix in lag_prefixes(df.columns, spec).items():
        out.update(lags.slot_lags(col, prefix, spec.lag_days, spec.cutoff))
    for c in fuel:
        out[f"{c}_lag"] = lags.lag_days(c, 2)
        out[f"{c}_momentum"] = lags.lag_days(c, 2) - lags.lag_days(c, 9)
    for name, (c, days, shift, least) in means.items():
        out[name] = lags.rolling_mean(c, days, shift, least)
    return lags.drop_parts(df.withColumns(out))


def _day_table(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    regional = (spec.north, spec.south)
    return daystats.day_features(
        df, spec.y, spec.load if spec.load in df.columns else None,
        regional if set(regional) <= set(df.columns) else None,
        spec.limits, spec.cutoff, spec.quantile_days, spec.y_stem, spec.load_stem,
    )


def _arithmetic(df: DataFrame, raw_columns, spec: FeatureSpec) -> DataFrame:
    """Everything that needs one row only: three projections, no shuffle."""
    have = set(df.columns)
    y, ld = f"{spec.y_stem}_same_cycle", f"{spec.load_stem}_same_cycle"

    def cap(kind: str):
        name = spec.capacity.format(kind)
        return F.col(name) if name in have else F.lit(0.0)

    def lagged(stem: str, days) -> list[str]:
        return [f"{stem}_{k}d" for k in days if f"{stem}_{k}d" in have]

    a = dict(cal.clock_features())
    solar, wind = spec.radiation in have, spec.wind in have
    has_solar = solar and spec.capacity.format("solar") in have
    has_wind = wind and spec.capacity.format("wind") in have
    a["solar_gen_proxy"] = px.solar_output(spec.radiation, cap("solar")) if has_solar else F.lit(0.0)
    a["wind_gen_proxy"] = px.wind_output(spec.wind, cap("wind")) if has_wind else F.lit(0.0)
    for stem, name in ((y, spec.y_stem), (ld, spec.load_stem)):
        if f"{stem}_1d" not in have:
            continue
        a[f"{name}_momentum_1d_2d"] = F.col(f"{stem}_1d") - F.col(f"{stem}_2d")
        if lagged(stem, spec.weekly):
            a[f"{name}_weekly_median"] = row_median(lagged(stem, spec.weekly))
    if f"{ld}_1d" in have:
        a["load_forecast_proxy"] = row_median(lagged(ld, spec.load_forecast))
        if f"{ld}_7d" in have:
            a["load_forecast_trend"] = F.col(f"{ld}_1d") - F.col(f"{ld}_7d")
    north, south = f"{spec.y_stem}_north_same_cycle_1d", f"{spec.y_stem}_south_same_cycle_1d"
    if {north, south} <= have:
        a[f"{spec.y_stem}_spread_ns_1d"] = F.col(north) - F.col(south)
    if f"{y}_1d" in have:
        a[f"{spec.y_stem}_dev_from_7d_mean"] = F.col(f"{y}_1d") - F.col(f"{spec.y_stem}_rolling_mean_7d")
    a["is_weekend"] = cal.weekend(flag="is_weekend" if "is_weekend" in have else None)
    a["is_holiday"] = cal.holiday(flag="is_holiday" if "is_holiday" in have else None)
    a["is_post_covid"] = cal.after_year()
    for kind, rules, fn in (("heat", spec.heat, px.heat_stress), ("cold", spec.cold, px.cold_stress)):
        for place, names in rules:
            found = px.first_present(raw_columns, *names)
            if found:
                a[f"{kind}_stress_{place}"] = fn(found)
    df = df.withColumns(a)
    have |= set(a)

    b = {}
    for stem, name in ((y, spec.y_stem), (ld, spec.load_stem)):
        if f"{name}_weekly_median" in have:
            b[f"{name}_level_vs_weekly"] = F.col(f"{stem}_2d") - F.col(f"{name}_weekly_median")
    if f"{ld}_1d" in have:
        b["holiday_load_impact"] = F.col("is_holiday") * F.col(f"{ld}_1d")
        b["residual_load_proxy"] = px.residual_load("load_forecast_proxy", "solar_gen_proxy", "wind_gen_proxy")
        if solar:
            b["load_to_rad_ratio"] = px.scarcity_ratio("load_forecast_proxy", spec.radiation)
        if wind:
            b["load_to_wind_ratio"] = px.scarcity_ratio("load_forecast_proxy", spec.wind)
    df = df.withColumns(b) if b else df
    have |= set(b)

    c = {}
    if "residual_load_proxy" in have:
        if spec.capacity.format("total") in have:
            thermal = px.thermal_capacity(cap("total"), cap("hydro"), cap("solar"), cap("wind"))
            c["thermal_margin_proxy"] = thermal - F.col("residual_load_proxy")
        if "precip_rolling_30d" in have:
            c["hydro_stress_proxy"] = px.scarcity_ratio("residual_load_proxy", "precip_rolling_30d")
    df = df.withColumns(c) if c else df
    return df.drop(spec.north, spec.central, spec.south)
