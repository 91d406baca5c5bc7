"""Readers by column name, and tables in the shared folder."""

import os
from types import SimpleNamespace

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from slotcast.sources import readers, shared


def put(folder, name, text):
    (folder / name).write_text(text, encoding="utf-8")


def test_columns_are_found_by_name_in_every_file(spark, tmp_path):
    put(tmp_path, "a.csv", "datetime,inflow_m3s,water_level_m\n2025-01-01 00:00:00,1,10\n")
    put(tmp_path, "b.csv", "water_level_m,datetime,other,inflow_m3s\n30,2025-01-01 00:00:00,x,3\n")
    put(tmp_path, "c.csv", "datetime,inflow_m3s\n2025-01-01 00:00:00,5\n")
    got = readers.read_hydro(spark, f"{tmp_path}/*.csv").where("ts = timestamp_ntz'2025-01-01 00:00:00'").first()
    assert (got["hydro_inflow_m3s"], got["hydro_water_level_m"]) == (3.0, 20.0)


def test_many_series_in_one_read(spark, tmp_path):
    for name, head, row in (("n", "datetime,y", "2025-01-01 00:00:00,1"), ("s", "y,datetime", "2,2025-01-01 00:00:00")):
        (tmp_path / name).mkdir()
        put(tmp_path / name, "x.csv", f"{head}\n{row}\n{row}\n")
    series = F.regexp_extract("_file", "/([^/]+)/[^/]+$", 1)
    got = {r.series_id: r.y for r in readers.read_series(spark, f"{tmp_path}/*/*.csv", ["y"], series).collect()}
    assert got == {"n": 1.0, "s": 2.0}


def test_a_number_that_cannot_be_read_is_an_error_by_default(spark, tmp_path):
    put(tmp_path, "a.csv", "datetime,y\n2025-01-01 00:00:00,1x\n2025-01-01 00:30:00,\n")
    with pytest.raises(PySparkException):
        readers.read_series(spark, f"{tmp_path}/a.csv", ["y"]).collect()
    got = readers.read_series(spark, f"{tmp_path}/a.csv", ["y"], malformed="null").collect()
    assert [r.y for r in got] == [None, None]


def test_weather_types_do_not_depend_on_content(spark, tmp_path):
    put(tmp_path, "w.csv", "datetime,temperature_x,source,cloud\n2025-01-01 00:00:00,1,s,\n")
    assert dict(readers.read_weather(spark, f"{tmp_path}/w.csv").dtypes) == {"ts": "timestamp_ntz", "temperature_x": "double", "cloud": "double"}


def test_weather_text_columns_are_left_out_unless_named(spark, tmp_path):
    put(tmp_path, "w.csv", "datetime,temperature_x,sky\n2025-01-01 00:00:00,1,clear\n2025-01-01 00:30:00,2,3\n")
    assert readers.read_weather(spark, f"{tmp_path}/w.csv").columns == ["ts", "temperature_x"]
    named = readers.read_weather(spark, f"{tmp_path}/w.csv", ["sky"], malformed="null").orderBy("ts")
    assert [r.sky for r in named.collect()] == [None, 3.0]
    with pytest.raises(PySparkException):
        readers.read_weather(spark, f"{tmp_path}/w.csv", ["sky"]).collect()


def test_headers_are_read_from_the_start_of_each_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "HEADER_BYTES", 8)
    put(tmp_path, "a.csv", '"day, local",datetime,y\n' + "x,2025-01-01 00:00:00,1\n" * 1000)
    put(tmp_path, "b.csv", "\ufeffdatetime,y\r\n2025-01-01 00:30:00,2\r\n")
    put(tmp_path, "empty.csv", "datetime,y\n")
    found = readers._headers(spark, f"{tmp_path}/*.csv")
    assert [k for k, _ in found.items()] == [("datetime", "y"), ("day, local", "datetime", "y")]
    assert [len(v) for v in found.values()] == [2, 1]
    got = readers.read_series(spark, f"{tmp_path}/*.csv", ["y"]).orderBy("ts").collect()
    assert [r.y for r in got] == [1.0, 2.0]
    with pytest.raises(FileNotFoundError):
        readers.read_series(spark, f"{tmp_path}/none*.csv", ["y"])


def test_settled_tables_are_deleted(spark):
    paths = []
    df = shared.settle(spark.range(5), "x", paths)
    folder = paths[0].removeprefix("file:")
    assert df.count() == 5 and os.path.isdir(folder)
    shared.drop_tables(spark, paths)
    assert not os.path.exists(folder) and paths == []


def test_a_cluster_needs_a_shared_folder():
    context = SimpleNamespace(
        master="spark://host:7077", getConf=lambda: {},
        _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False))),
    )
    session = SimpleNamespace(sparkContext=context, conf={})
    with pytest.raises(ValueError):
        shared.shared_dir(session)
    context.master = "local[2]"
    assert os.path.isdir(shared.shared_dir(session))
    session.conf = {"spark.checkpoint.dir": "hdfs:///tmp/x/"}
    assert shared.shared_dir(session) == "hdfs:///tmp/x"
