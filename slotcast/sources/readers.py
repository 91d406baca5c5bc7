"""CSV readers by column name. Timestamps are TIMESTAMP_NTZ; missing is NULL.

Every reader takes a path or glob. Files may order their columns differently: files are grouped by
their header, and each distinct header is one scan, so a name is read from where that file has it. A
number that cannot be read is an error, unless ``malformed="null"`` is asked for.
"""

import csv
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotcast.operators import panel
from slotcast.operators.policy import numeric_columns

# fixed values: column names of the sources
PRICE = ("smp_system_price", "smp_north_price", "smp_central_price", "smp_south_price")
LOAD = ("load_total_mw", "load_north_mw", "load_central_mw", "load_south_mw")
HYDRO_FLOWS = ("inflow_m3s", "total_discharge_m3s", "plant_discharge_m3s", "spill_discharge_m3s")
HYDRO_LEVELS = ("water_level_m",)
CAPACITY = ("installed_capacity_mw", "expected_midday_low_load_mw", "expected_evening_peak_mw")
FUEL = ("coal_proxy_price", "brent_price", "gas_proxy_price", "usd_vnd", "dxy_index")
CALENDAR = ("is_weekend", "is_workday", "is_holiday", "is_tet", "is_pre_holiday", "is_post_holiday", "season")
HEADER_BYTES = 1 << 16
WEATHER_BOOKKEEPING = ("date", "cycle_id", "source", "timezone")
# fixed values: label and the text that marks it in ``resource_type``
RESOURCES = {"total": "quốc", "hydro": "thủy", "solar": "trời trang", "wind": "gió"}


def _files(spark: SparkSession, path: str) -> list[str]:
    """The files that a path or glob names, as Spark's own planning lists them."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = []
    for status in found.globStatus(at) or ():
        inside = found.listStatus(status.getPath()) if status.isDirectory() else [status]
        names += [x.getPath().toString() for x in inside if x.isFile() and not x.getPath().getName().startswith(("_", "."))]
    if not names:
        raise FileNotFoundError(f"no file at {path}")
    return sorted(names)


def _first_lines(batches):
    """The header of each file, read from its beginning only."""
    for batch in batches:
        names, heads = batch.column(0).to_pylist(), []
        for name in names:
            files, at = fs.FileSystem.from_uri(name)
            with files.open_input_stream(at, compression="detect") as file:
                head = b""
                while b"\n" not in head and (more := file.read(HEADER_BYTES)):
                    head += more
            heads.append(next(csv.reader([head.partition(b"\n")[0].decode("utf-8-sig").rstrip("\r")]), []))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(heads, pa.list_(pa.string()))], names=["file", "names"])


def _headers(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """Files by header. Tasks read the first line of each file; the driver sees names of files and columns."""
    files = _files(spark, path)
    spread = spark.createDataFrame([(f,) for f in files], "file string").repartition(min(len(files), spark.sparkContext.defaultParallelism))
    out: dict[tuple[str, ...], list[str]] = {}
    for r in spread.mapInArrow(_first_lines, "file string, names array<string>").collect():
        out.setdefault(tuple(n.strip() for n in r["names"]), []).append(r["file"])
    return {names: sorted(found) for names, found in sorted(out.items())}


def _csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, by name, with ``_file``; a column that a file lacks is NULL there."""
    parts = [
        spark.read.schema(", ".join(f"`{n}` string" for n in names)).csv(files, header=True, enforceSchema=False, encoding="utf-8")
        .withColumn("_file", F.col("_metadata.file_path"))
        for names, files in _headers(spark, path).items()
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _double(c: str, malformed: str):
    """A number, or NULL for an empty field; what is neither raises or becomes NULL."""
    text = F.trim(F.col(f"`{c}`"))
    value = F.expr(f"try_cast(trim(`{c}`) as double)")
    if malformed == "null":
        return value.alias(c)
    bad = (text != "") & value.isNull()
    return F.when(bad, F.raise_error(F.concat(F.lit(f"column {c} holds no number: "), text)).cast("double")).otherwise(value).alias(c)


def _doubles(df: DataFrame, cols, malformed: str = "error") -> list:
    return [_double(c, malformed) for c in cols if c in df.columns]


def _stamp(df: DataFrame, cols, keep=(), malformed: str = "error") -> DataFrame:
    return df.select(F.col("datetime").cast("timestamp_ntz").alias("ts"), *keep, *_doubles(df, cols, malformed))


def read_series(spark: SparkSession, path: str, cols, series_id="system", malformed: str = "error") -> DataFrame:
    """Half-hourly values, one row per series and time; of repeated times the smallest row is kept.

    ``series_id`` is the name of one series, or a column expression over the file's columns and ``_file``
    (its path) that names the series of each row, so many series are one scan.
    """
    named = F.lit(series_id) if isinstance(series_id, str) else series_id
    df = _stamp(_csv(spark, path), cols, [named.alias("series_id")], malformed)
    kept = [c for c in df.columns if c not in ("series_id", "ts")]
    return panel.dedup_first(df, ["series_id", "ts"], kept).select("series_id", "ts", *kept)


def hydro_rollup(spark: SparkSession, path: str, source=None, flows=HYDRO_FLOWS, levels=HYDRO_LEVELS, malformed: str = "error") -> DataFrame:
    """Rows of many plants to one per time. ``source`` names the plant of a row; by default its file."""
    plant = (F.col("_file") if source is None else source).alias("file")
    raw = _stamp(_csv(spark, path), [*flows, *levels], [plant], malformed)
    return panel.plant_rollup(raw, "file", "ts", [c for c in flows if c in raw.columns], [c for c in levels if c in raw.columns])


def read_hydro(spark: SparkSession, path: str, source=None, malformed: str = "error") -> DataFrame:
    """Hourly rows of many plants in many files to one half-hourly row per time."""
    hourly = hydro_rollup(spark, path, source, malformed=malformed)
    return panel.upsample_ffill(hourly, [c for c in hourly.columns if c != "ts"])


def read_capacity(spark: SparkSession, path: str, resources: dict[str, str] = RESOURCES, malformed: str = "error") -> DataFrame:
    """Dated capacity rows to ``disp_<label>_<measure>`` columns, one row per date."""
    raw = _csv(spark, path)
    raw = raw.select(F.col("date").cast("date").alias("date"), "resource_type", *_doubles(raw, CAPACITY, malformed))
    measures = dict(zip(("installed_mw", "midday_mw", "evening_mw"), [F.col(c) for c in CAPACITY]))
    wide = panel.label_pivot(raw, "resource_type", resources, ["date"], **measures)
    return wide.select("date", *[F.col(c).alias(f"disp_{c}") for c in wide.columns if c != "date"])


def _number_columns(raw: DataFrame, drop) -> list[str]:
    """Columns without a value that is no number, in one pass over the table."""
    cols = [c for c in raw.columns if c not in drop]
    texts = [F.count_if((F.trim(F.col(f"`{c}`")) != "") & F.expr(f"try_cast(trim(`{c}`) as double)").isNull()).alias(str(i)) for i, c in enumerate(cols)]
    found = raw.agg(*texts).first() if cols else ()
    return [c for c, n in zip(cols, found) if not n]


def read_weather(spark: SparkSession, path: str, cols=None, malformed: str = "error") -> DataFrame:
    """The weather columns as numbers: those named, or all that hold numbers only, but for the bookkeeping."""
    raw = _csv(spark, path)
    cols = cols or _number_columns(raw, ("datetime", "_file", *WEATHER_BOOKKEEPING))
    df = _stamp(raw, cols, malformed=malformed)
    return panel.dedup_first(df, ["ts"], [c for c in df.columns if c != "ts"])


def read_daily(spark: SparkSession, path: str, cols, malformed: str = "error") -> DataFrame:
    """A date-keyed table; only the columns it has."""
    raw = _csv(spark, path)
    return raw.select(F.col("date").cast("date").alias("date"), *_doubles(raw, cols, malformed))


def load_sources(spark: SparkSession, root: str, season_days: int = 7, weather=None, malformed: str = "error") -> DataFrame:
    """The whole input directory to one imputed panel of one series.

    ``weather`` names the weather columns, by default all that hold numbers; ``malformed`` is that of the readers.
    """
    price = read_series(spark, f"{root}/market/smp_prices_nsmo.csv", PRICE, malformed=malformed)
    load = read_series(spark, f"{root}/market/load_data_nsmo.csv", LOAD, malformed=malformed)
    grid = panel.make_grid(price, whole_days=True)
    df = panel.attach(panel.attach(grid, price), load)
    df = panel.attach(df, read_hydro(spark, f"{root}/hydro/hydro_hourly_*.csv", malformed=malformed))
    df = panel.attach_daily(df, read_capacity(spark, f"{root}/market/dispatch_capacity_nsmo.csv", malformed=malformed))
    df = panel.attach(df, read_weather(spark, f"{root}/exogenous/weather_3_regions_30min_open_meteo.csv", weather, malformed))
    df = panel.attach_daily(df, read_daily(spark, f"{root}/exogenous/fuel_macro_yfinance_clean.csv", FUEL, malformed))
    df = panel.attach_daily(df, read_daily(spark, f"{root}/exogenous/calendar_vietnam.csv", CALENDAR, malformed))
    cols = numeric_columns(df, ("cycle",))
    filled = panel.impute(df, cols, season_days, observed="smp_system_price", whole_days=True)
    return filled.where("in_span").drop("in_span")

