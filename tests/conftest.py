import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def contract(spark):
    """40 days of a price that counts up, with regional prices, loads, one temperature, one capacity."""
    return contract_panel(spark)


def contract_panel(spark):
    from pyspark.sql import functions as F

    from slotcast.functions.clock import with_clock

    v = F.col("id").cast("double")
    return with_clock(
        spark.range(48 * 40).select(
            F.lit("a").alias("series_id"),
            (F.lit("2025-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("id") * 30).cast("int"))).alias("ts"),
            v.alias("smp_system_price"),
            (v + 10).alias("smp_north_price"),
            (v + 20).alias("smp_central_price"),
            (v + 30).alias("smp_south_price"),
            (v + 1000).alias("load_total_mw"),
            (v + 2000).alias("load_north_mw"),
            (v + 3000).alias("load_central_mw"),
            (v + 4000).alias("load_south_mw"),
            (20 + v / 10000).alias("temperature_hanoi"),
            (80000 + v / 1000).alias("disp_total_installed_mw"),
        )
    )
