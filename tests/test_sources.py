import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from loadcast.series import SeriesSpec
from loadcast.session import cut_lineage
from loadcast.sources import records, store
from loadcast.sources.merge import merge_rows, read_merged
from loadcast.streaming.ingest import ingest, record_stream

LINES = [
    {"date_heure": "2024-01-01T02:00:00+01:00", "consommation": 50000, "gaz": 10.5, "taux_co2": 40, "nucleaire": "300"},
    {"date_heure": "2024-01-01T00:00:00+00:00", "consommation": 48000},
    {"date_heure": "2024-01-01T03:00:00+00:00", "consommation": None, "gaz": None, "fioul": None},
    {"date_heure": "2024-01-01T04:00:00+00:00", "consommation": "ND", "gaz": "x", "eolien": "NaN"},
    {"date_heure": "not a time", "consommation": 1},
    {"consommation": 2},
]


@pytest.fixture
def landed(tmp_path):
    folder = tmp_path / "landed"
    folder.mkdir()
    (folder / "a.json").write_text("\n".join(map(json.dumps, LINES)) + "\n{broken\n")
    return str(folder)


def check(rows):
    by_time = {r.date_heure: r for r in rows}
    assert len(rows) == 4 and len(by_time) == 4
    full, short, nulls, bad = (by_time[dt.datetime(2024, 1, 1, h)] for h in (1, 0, 3, 4))
    assert (full.y, full.gaz, full.nucleaire, full.taux_co2) == (50000.0, 10.5, 300.0, 40.0)
    assert (full.fioul, full.ech_comm_italie, full.prevision_j1) == (0.0, 0.0, None)
    assert (short.gaz, short.taux_co2, short.y) == (0.0, None, 48000.0)
    assert (nulls.gaz, nulls.fioul, nulls.consommation, nulls.eolien) == (None, None, None, 0.0)
    assert (bad.gaz, bad.consommation, bad.y, bad.eolien) == (None, None, None, None)


def test_records(spark, landed):
    df = records.read_records(spark, landed)
    assert len(df.columns) == 23
    check(df.collect())


def test_record_stream(spark, landed, tmp_path):
    sink, state = str(tmp_path / "sink"), str(tmp_path / "state")
    for _ in range(2):  # the second run finds nothing new
        query = ingest(spark, landed, sink, state)
        query.awaitTermination(120)
        check(spark.read.parquet(sink).collect())
    assert record_stream(spark, landed).isStreaming


def test_stream_drops_repeats(spark, landed, tmp_path):
    (tmp_path / "landed" / "b.json").write_text(json.dumps(LINES[1]) + "\n")
    sink = str(tmp_path / "sink")
    ingest(spark, landed, sink, str(tmp_path / "state"), late_by="1 day").awaitTermination(120)
    assert spark.read.parquet(sink).count() == 4


def test_newest(spark, landed):
    df = records.read_records(spark, landed)
    spec = SeriesSpec((), "date_heure", "y")
    rows = records.newest(df, spec, 1).collect()
    assert [r.y for r in rows] == [50000.0]
    assert records.newest(df, spec, 10, F.col("gaz") > 0).count() == 1


def test_first_non_empty(spark):
    a, b = spark.range(0), spark.range(3)
    assert records.first_non_empty(a, b).count() == 3
    assert records.first_non_empty(b, a).count() == 3
    assert records.first_non_empty(a, a).count() == 0


def test_report_and_forecast_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5), ("b", 2.5)], "k string, yhat double")
    store.write_report(df, str(tmp_path / "r"))
    assert sorted(store.read_report(spark, str(tmp_path / "r"), "k string, yhat double").collect()) == sorted(df.collect())
    store.write_forecasts(df, str(tmp_path / "f"), ["k"])
    assert spark.read.parquet(str(tmp_path / "f")).where("k = 'b'").first().yhat == 2.5
    store.write_forecasts(df, str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g")).count() == 2


def test_registry(spark, tmp_path):
    path = str(tmp_path / "registry")
    for day, kind in ((1, "linear"), (3, "linear"), (5, "random_forest")):
        store.register_model(spark, path, kind, kind.title(), f"models/{kind}-{day}", dt.datetime(2024, 1, day))
    registry = store.read_registry(spark, path)
    assert store.latest_model(registry, "linear").first().path == "models/linear-3"
    assert store.latest_model(registry).first().path == "models/random_forest-5"
    assert store.latest_model(registry, "lightgbm").count() == 0


def test_cut_lineage_uses_the_session_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir", None)
    out = cut_lineage(spark.range(5))
    assert out.count() == 5
    used = spark.sparkContext.getCheckpointDir()
    assert used and (folder is None or folder in used)


def test_merged_table_holds_one_row_each(spark, tmp_path):
    path = str(tmp_path / "t")
    assert read_merged(spark, path) is None

    def batch(*rows):
        return spark.createDataFrame([(k, dt.datetime(2024, 1, d) if d else None, v) for k, d, v in rows],
                                     "k string, ts timestamp_ntz, v double")

    def state():
        return sorted((r.k, r.ts.day, r.v) for r in read_merged(spark, path).collect())

    first = batch(("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, None), ("a", 1, 1.0), ("c", None, 5.0))
    merge_rows(first, path, ["k", "ts"], "ts", 0)
    assert state() == [("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, None)]
    before = {f.name: f.stat().st_mtime_ns for f in (tmp_path / "t" / "_day=2024-01-02").iterdir()}
    for _ in range(2):  # the second time as after a failure
        merge_rows(batch(("a", 1, 7.0), ("b", 3, 3.0)), path, ["k", "ts"], "ts", 1)
        assert state() == [("a", 1, 7.0), ("a", 2, 2.0), ("b", 1, None), ("b", 3, 3.0)]
    assert {f.name: f.stat().st_mtime_ns for f in (tmp_path / "t" / "_day=2024-01-02").iterdir()} == before
    merge_rows(batch(("a", 1, 4.0), ("a", 1, 4.0)), path, ["k", "ts"], "ts", 0)  # an earlier batch repeated
    assert ("a", 1, 7.0) in state()
    merge_rows(batch(), path, ["k", "ts"], "ts", 2)
    assert len(state()) == 4


def test_equal_records_are_dropped_and_others_of_the_same_time_kept(spark, tmp_path):
    landed, sink = tmp_path / "landed", str(tmp_path / "sink")
    landed.mkdir()
    lines = ['{"date_heure": "2024-01-01T00:00:00+00:00", "consommation": %d}' % v for v in (1, 2, 1)]
    (landed / "a.json").write_text("\n".join(lines))
    ingest(spark, str(landed), sink, str(tmp_path / "state"), late_by="1 day").awaitTermination(120)
    assert sorted(r.y for r in spark.read.parquet(sink).collect()) == [1, 2]
