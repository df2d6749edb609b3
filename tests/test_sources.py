from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.sources import calendar_text, days, records
from quantloom.streaming import flows


def test_days_round_trip_prune_and_replace(spark, tmp_path):
    p = str(tmp_path / "t")
    df = spark.createDataFrame([(date(2026, 1, d), d, float(d)) for d in (5, 6, 7)], "dt date, a int, b double")
    days.write_days(df, p)
    days.write_days(df.where("a = 6").withColumn("b", F.lit(60.0)), p)
    got = days.read_days(spark, p, date(2026, 1, 6), columns=["b", "missing"])
    assert sorted((r.dt.day, r.b, r.missing) for r in got.collect()) == [(6, 60.0, None), (7, 7.0, None)]
    assert "PartitionFilters: [isnotnull(dt" in got._jdf.queryExecution().toString()
    assert days.days_of(spark, p) == [date(2026, 1, d) for d in (5, 6, 7)]
    assert days.days_left([1, 2, 3, 4], [1, 2, 3], 1) == [3, 4]


def test_run_store_and_fingerprint(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "x int, y string")
    days.save_run(df, {"asset": "S", "start": date(2026, 1, 5)}, str(tmp_path / "r"))
    back, meta = days.load_run(spark, str(tmp_path / "r"))
    assert meta == {"asset": "S", "start": "2026-01-05"}
    assert days.fingerprint(back).first() == days.fingerprint(df.orderBy(F.desc("x"))).first() != days.fingerprint(df.limit(2)).first()
    with pytest.raises(Exception):
        days.save_run(df, {}, str(tmp_path / "r"))


@pytest.mark.parametrize("compress", [True, False])
def test_binary_records(spark, tmp_path, compress):
    rows = np.zeros(3, records.dtype("quotes"))
    rows["instrument_id"], rows["price"], rows["side"] = [1, 2, 3], [10**9, 2**63 - 1, -5], [b"A", b"B", b"N"]
    folder = tmp_path / "d"
    folder.mkdir()
    (folder / "2026-01-05.bin").write_bytes(records.pack(rows, compress))
    records.register(spark)
    got = spark.read.format("records").option("layout", "quotes").option("path", str(folder)).load().orderBy("instrument_id").collect()
    assert [(r.instrument_id, r.price, r.side) for r in got] == [(1, 10**9, "A"), (2, 2**63 - 1, "B"), (3, -5, "N")]
    assert len(records.unpack(b"", "quotes")) == 0


def test_record_files_with_frames_and_faults():
    import zstandard

    sizes = {k: records.dtype(k).itemsize for k in records.LAYOUTS}
    assert sizes == {"statistics": 64, "definition": 360, "quotes": 80, "orders": 56}
    rows = np.zeros(50, records.dtype("definition"))
    rows["strike_price"], rows["raw_symbol"], rows["instrument_class"], rows["maturity_year"] = np.arange(50) * 10**9, b"AXN C100", b"C", 2026
    raw = records.pack(rows, False)
    z = zstandard.ZstdCompressor()
    back = records.unpack(z.compress(raw[:1000]) + z.compress(raw[1000:]), "definition")
    assert back["strike_price"].tolist() == rows["strike_price"].tolist() and back["raw_symbol"][0] == b"AXN C100"
    for bad in (raw + b"torn", b"RECS" + raw[4:], raw[:3] + b"\x09" + raw[4:]):
        with pytest.raises(ValueError):
            records.unpack(bad, "definition")
    with pytest.raises(ValueError):
        records.unpack(records.pack(np.zeros(9, records.dtype("quotes")), False), "definition")


def test_calendar_text(spark, tmp_path):
    (tmp_path / "c.txt").write_text("Mon\nJan 5\n8:30am\nUSD\nCPI m/m\nUSD\nRetail Sales\n10:00pm\nEUR\nZEW\nTue\nJan 6\nAll Day\nUSD\nBank Holiday\n")
    got = sorted((str(r.date), r.time, r.event) for r in calendar_text.events(spark, str(tmp_path), 2026).collect())
    assert got == [("2026-01-05", "08:30", "CPI m/m"), ("2026-01-05", "08:30", "Retail Sales"), ("2026-01-06", "All Day", "Bank Holiday")]
    kinds = [r.i for r in spark.createDataFrame([("Bank Holiday",), ("CPI m/m",), ("ZEW",), ("Daylight Saving Time Shift",), (None,)], "e string").select(calendar_text.impact(F.col("e")).alias("i")).collect()]
    assert kinds == ["grey", "red", "red", None, None]
    (tmp_path / "of_2031.txt").write_text("Wed Jan 1\nAll Day\nUSD\nBank Holiday\n")
    assert {str(r.date) for r in calendar_text.events(spark, str(tmp_path / "of_2031.txt")).collect()} == {"2031-01-01"}


def test_streams_equal_batch(spark, tmp_path):
    rows = [(i, "S", datetime(2026, 1, 5, 10, i // 20, i % 60), float(i), 1) for i in range(100)] + [(5, "S", datetime(2026, 1, 5, 10, 0, 5), 5.0, 1)]
    schema = "id int, k string, ts timestamp, p double, n int"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    s = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    assert flows.run_once(flows.once(s(), "id", "ts", "1 hour"), str(tmp_path / "once")).count() == 100
    got = {r.bucket.minute: r.volume for r in flows.run_once(flows.bar_stream(s(), ["k"], "ts", "p", "n", delay="0 seconds"), str(tmp_path / "bars")).collect()}
    assert got[0] == 21 and got[1] == 20 and 4 not in got
