import datetime as dt
import glob
import json
import os
import shutil
import tempfile

import pytest
from pyspark.sql import functions as F

from barloom.operators import outcomes as oc
from barloom.sources import daily_files as files
from barloom.sources import store
from barloom.streaming import candles as cd
from barloom.streaming import jobs

D = dt.date


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="spark-")


def put(folder, name, text):
    path = f"{folder}/{name}"
    with open(path, "w") as f:
        f.write(text)
    return path


def test_full_daily(spark, folder):
    p = put(folder, "full.csv", "SYMBOL, SERIES, DATE1, PREV_CLOSE, OPEN_PRICE, HIGH_PRICE, LOW_PRICE, LAST_PRICE, CLOSE_PRICE, AVG_PRICE, TTL_TRD_QNTY, TURNOVER_LACS, NO_OF_TRADES, DELIV_QTY, DELIV_PER\n"
            "ABC, EQ, 17-Sep-2026, 10.00, 11.00, 12.00, 9.50, 11.40, 11.50, 11.10, 2000, 2.25, 40, -, -\n")
    r = files.read_full_daily_csv(spark, p).first()
    assert (r.date, r.symbol, r.series, r.close, r.volume, r.turnover, r.delivery_qty, r.delivery_pct) == (D(2026, 9, 17), "ABC", "EQ", 11.5, 2000, 225000.0, None, None)


def test_legacy_daily(spark, folder):
    p = put(folder, "legacy.csv", "SYMBOL,SERIES,OPEN,HIGH,LOW,CLOSE,LAST,PREVCLOSE,TOTTRDQTY,TOTTRDVAL,TIMESTAMP,\nABC,EQ,1,2,1,2,2,1,100,150.5,4-JAN-2010,\n")
    r = files.read_legacy_daily_csv(spark, p).first()
    assert (r.date, r.turnover, r.isin, r.delivery_qty) == (D(2010, 1, 4), 150.5, None, None)


def test_scripcode_daily_takes_the_date_from_the_name(spark, folder):
    p = put(folder, "EQ040110.CSV", "SC_CODE,SC_NAME,SC_GROUP,SC_TYPE,OPEN,HIGH,LOW,CLOSE,LAST,PREVCLOSE,NO_TRADES,NO_OF_SHRS,NET_TURNOV,TDCLOINDI\n500001,ABC LTD     ,A ,Q,1,2,1,2,2,1,7,100,150.5,\n")
    r = files.read_scripcode_daily_csv(spark, p).first()
    assert (r.date, r.symbol, r.series, r.exchange, r.trades) == (D(2010, 1, 4), "500001", "A", "BSE", 7)


def test_udiff_keeps_equities(spark, folder):
    head = "TradDt,FinInstrmTp,ISIN,TckrSymb,SctySrs,OpnPric,HghPric,LwPric,ClsPric,LastPric,PrvsClsgPric,TtlTradgVol,TtlTrfVal,TtlNbOfTxsExctd"
    p = put(folder, "u.csv", head + "\n2026-09-17,STK,INE1,ABC,EQ,1,2,1,2,2,1,10,15,3\n2026-09-17,BND,INE2,XYZ,GB,1,2,1,2,2,1,10,15,3\n2026-09-17,,INE3,NUL,EQ,1,2,1,2,2,1,10,15,3\n")
    assert sorted(r.symbol for r in files.read_udiff_csv(spark, p, "NSE").collect()) == ["ABC", "NUL"]


def test_index_close(spark, folder):
    p = put(folder, "i.csv", "Index Name,Index Date,Open Index Value,High Index Value,Low Index Value,Closing Index Value,Points Change,Change(%),Volume,Turnover (Rs. Cr.),P/E,P/B,Div Yield\n"
            "CNX Nifty,17-09-2026,1,2,1,2,-,.5,100,1.5,20,-,1\nNifty 50,18-09-2026,1,2,1,3,1,.5,100,1.5,20,3,1\nNo Close,18-09-2026,-,-,-,-,-,-,-,-,-,-,-\n")
    got = files.read_index_close_csv(spark, p).orderBy("date").collect()
    assert [(r.index_code, r.close, r.points_change, r.turnover) for r in got] == [("NIFTY_50", 2.0, None, 15_000_000.0), ("NIFTY_50", 3.0, 1.0, 15_000_000.0)]


def test_reference_files(spark, folder):
    c = put(folder, "l.csv", "SYMBOL,NAME OF COMPANY, SERIES, DATE OF LISTING, PAID UP VALUE, MARKET LOT, ISIN NUMBER, FACE VALUE\nABC,Abc Ltd,EQ,06-OCT-2008,5,1,INE1,10\nNOI,No Isin,EQ,06-OCT-2008,5,1,,10\n")
    j = put(folder, "l.json", json.dumps([{"SCRIP_CD": "500001", "Scrip_Name": "Abc", "Status": "Active", "GROUP": "A", "FACE_VALUE": "10.00", "ISIN_NUMBER": "INE1", "scrip_id": "ABC"}, {"scrip_id": "X", "ISIN_NUMBER": ""}]))
    got = files.read_security_list(spark, c, j).orderBy("exchange").collect()
    assert [(r.exchange, r.symbol, r.face_value, r.paid_up_value) for r in got] == [("BSE", "ABC", 10.0, None), ("NSE", "ABC", 10.0, 5.0)]
    s = put(folder, "s.csv", " Abc Ltd,OLD,NEW,06-OCT-2008\n")
    assert tuple(files.read_symbol_changes(spark, s).first()) == ("Abc Ltd", "OLD", "NEW", D(2008, 10, 6))
    with pytest.raises(Exception):
        files.read_symbol_changes(spark, put(folder, "bad.csv", "a,b,c\n")).collect()
    b = put(folder, "b.csv", "Symbol,Series,Security Name,Band,Remarks\nABC,EQ,Abc,20,-\nDEF,EQ,Def,No Band,-\n")
    assert [r.band_pct for r in files.read_price_bands(spark, b).orderBy("symbol").collect()] == [20, None]


def test_json_feeds(spark, folder):
    h = put(folder, "h.json", json.dumps({"CM": [{"tradingDate": "26-Jan-2026", "description": "R"}], "FO": []}))
    assert files.read_holidays(spark, h, "CM").first().date == D(2026, 1, 26)
    for seg in ("FO", "XX"):
        with pytest.raises(Exception, match="no holidays"):
            files.read_holidays(spark, h, seg).collect()
    row = {"symbol": "ABC", "series": "EQ", "isin": "INE1", "faceVal": "10", "subject": " Bonus 1:1 ", "exDate": "02-Jan-2026", "recDate": "-"}
    a = files.read_actions_json(spark, put(folder, "a.json", json.dumps([row, row]))).collect()
    assert len(a) == 1 and (a[0].ex_date, a[0].record_date, a[0].subject) == (D(2026, 1, 2), None, "Bonus 1:1")
    f1 = put(folder, "f1.json", json.dumps([{"symbol": "A", "isin": "I", "toDate": "31-Mar-2025", "seqNumber": "1", "consolidated": "Consolidated", "broadCastDate": "20-Apr-2025 18:00:00", "xbrl": "u"}]))
    f2 = put(folder, "f2.json", json.dumps([{"symbol": "A", "isin": "I", "qe_Date": "30-JUN-2025", "seq_Id": "2", "consolidated": "Standalone", "broadcast_Date": None, "revised_Date": "25-Jul-2025 10:00:00", "creation_Date": "20-Jul-2025 10:00:00"}]))
    got = files.read_filing_index(spark, f1, f2).orderBy("seq").collect()
    assert [(r.broadcast, r.is_annual, r.consolidated) for r in got] == [(D(2025, 4, 20), True, True), (D(2025, 7, 25), False, False)]
    k = put(folder, "k.json", json.dumps({"symbol": "A", "exchange": "NSE", "interval": "5m", "candles": [{"ts": "2026-01-02T09:15:00+05:30", "o": 1.0, "h": 2.0, "l": 1.0, "c": 1.5, "v": 3}]}))
    assert files.read_candles_json(spark, k).first().candle_start == dt.datetime(2026, 1, 2, 3, 45)
    n = put(folder, "n.json", json.dumps({"symbol": "A", "candles": [{"ts": "2026-01-02T09:15:00", "o": 1.0, "h": 2.0, "l": 1.0, "c": 1.5, "v": 3}]}))
    with pytest.raises(Exception, match="offset"):
        files.read_candles_json(spark, n).collect()


def bars(spark, rows):
    return spark.createDataFrame(rows, "exchange string, symbol string, date date, close double")


def test_upsert_replaces_dates_and_converges(spark, folder):
    base = bars(spark, [("NSE", "A", D(2023, 1, 2), 1.0), ("NSE", "B", D(2023, 1, 2), 2.0), ("NSE", "A", D(2023, 1, 3), 3.0), ("BSE", "A", D(2022, 1, 3), 4.0)])
    lake = f"{folder}/lake"
    assert store.read_committed(spark, lake, base.schema).count() == 0
    store.upsert_bars(spark, lake, base)
    new = bars(spark, [("NSE", "A", D(2023, 1, 2), 9.0)])
    for n in range(2):
        store.upsert_bars(spark, lake, new)
        got = sorted(tuple(r) for r in store.read_committed(spark, lake, base.schema).select("exchange", "symbol", F.col("date").cast("string"), "close").collect())
        assert got == [("BSE", "A", "2022-01-03", 4.0), ("NSE", "A", "2023-01-02", 9.0), ("NSE", "A", "2023-01-03", 3.0)]
        assert store.verify_committed(spark, lake, base.schema).count() == 0 and {r.commit for r in store.current_manifest(spark, lake).collect()} == {n + 2}
    assert [r.symbol for r in store.read_committed(spark, lake, base.schema, "BSE", "2022-01-01", "2022-12-31").collect()] == ["A"]
    m1, m2 = store.partition_manifest(base), store.partition_manifest(base.orderBy(F.desc("close")))
    assert store.verify_manifest(m1, m2).count() == 0
    changed = base.withColumn("close", F.when(F.col("symbol") == "B", 7.0).otherwise(F.col("close")))
    assert [r.problem for r in store.verify_manifest(m1, store.partition_manifest(changed)).collect()] == ["content"]


def test_a_run_that_stops_between_the_steps_leaves_the_old_state(spark, folder):
    base, new = bars(spark, [("NSE", "A", D(2023, 1, 2), 1.0)]), bars(spark, [("NSE", "A", D(2023, 1, 2), 5.0), ("NSE", "A", D(2024, 1, 2), 6.0)])
    lake = f"{folder}/lake"
    read = lambda: sorted(r.close for r in store.read_committed(spark, lake, base.schema).collect())
    store.upsert_bars(spark, lake, base)
    version = store.write_version(spark, lake, new)  # stops here: written beside, not committed
    assert read() == [1.0] and store.verify_committed(spark, lake, base.schema).count() == 0
    os.makedirs(f"{lake}/manifest/commit=2/_temporary/0")  # stops while the manifest is written
    assert read() == [1.0]
    shutil.rmtree(f"{lake}/manifest/commit=2")
    store.commit_version(spark, lake, version, new.schema)
    assert read() == [5.0, 6.0] and store.verify_committed(spark, lake, base.schema).count() == 0
    # a file lost after the commit is seen
    shutil.rmtree(glob.glob(f"{lake}/bars/version={version}/exchange=NSE/year=2024")[0])
    spark.catalog.refreshByPath(f"{lake}/bars")
    assert [(r.year, r.problem) for r in store.verify_committed(spark, lake, base.schema).collect()] == [(2024, "missing")]


def test_artifacts_by_content(spark, folder):
    for name, text in (("a_2024-01-01_1.csv", "x"), ("a_2024-01-01_2.csv", "x"), ("a_2024-01-02_1.csv", "x"), ("a_2024-01-02_2.csv", "y")):
        put(folder, name, text)
    a = store.read_artifacts(spark, folder).select(F.lit("a").alias("source"), F.regexp_extract("path", r"_(\d{4}-\d\d-\d\d)_", 1).alias("day"), "sha256", F.col("path").alias("captured_at"))
    assert {r.day: (r.n_captures, r.n_contents, r.republished) for r in store.dedupe_artifacts(a).collect()} == {"2024-01-01": (2, 1, False), "2024-01-02": (2, 2, True)}


def ticks(spark):
    t0 = dt.datetime(2024, 1, 2, 9, 0)
    rows = [(f"S{i % 3}", t0 + dt.timedelta(seconds=37 * i), 100.0 + (i * 7919 % 200) / 10, i, 1 + i % 4) for i in range(600)]
    return spark.createDataFrame(rows, jobs.TICK_SCHEMA)


def test_candle_stream_equals_batch(spark, folder):
    t = ticks(spark)
    t.filter("event_id < 300").coalesce(1).write.parquet(f"{folder}/in")
    t.filter("event_id >= 300").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    q = jobs.start_candles(jobs.read_ticks(spark, f"{folder}/in"), f"{folder}/out", f"{folder}/ck")
    q.awaitTermination()
    out = spark.read.parquet(f"{folder}/out")
    last = t.agg(F.max("ts")).first()[0] - dt.timedelta(minutes=10)
    batch = cd.candles(t, "5 minutes", tiebreak="event_id").filter(F.col("candle_end") <= F.lit(last))
    assert out.count() == batch.count() > 0 and out.exceptAll(batch).count() == 0


def test_fill_stream_equals_batch_and_logs_every_poll(spark, folder):
    c = cd.candles(ticks(spark), "5 minutes", tiebreak="event_id").cache()
    t0 = dt.datetime(2024, 1, 2, 9, 1)
    rows = []
    for i in range(30):
        sym, made, until = f"S{i % 3}", t0 + dt.timedelta(minutes=3 * i), dt.datetime(2024, 1, 3)
        rows.append((2 * i, sym, made, until, "market" if i % 3 == 0 else "stop_loss", "sell", None, None if i % 3 == 0 else 101.0, 5, None if i % 3 == 0 else i, "open"))
        if i % 3:
            rows.append((2 * i + 1, sym, made, until, "target", "sell", None, 119.0, 5, i, "open"))
    orders = spark.createDataFrame(rows, "order_id long, symbol string, created_at timestamp, valid_until timestamp, type string, side string, limit_price double, trigger_price double, qty long, oco_group long, status string").cache()
    cut = dt.datetime(2024, 1, 2, 12, 0)
    c.filter(F.col("candle_start") < F.lit(cut)).coalesce(1).write.parquet(f"{folder}/c/0")
    schema = c.schema

    def run():
        src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/c")
        jobs.start_fills(src, orders, f"{folder}/fills", f"{folder}/log", f"{folder}/ck", f"{folder}/state").awaitTermination()
    run()
    c.filter(F.col("candle_start") >= F.lit(cut)).coalesce(1).write.parquet(f"{folder}/c/1")
    run()
    want = oc.oco_first(oc.touch_fills(orders, c)).select("order_id", "candle_start", "fill_price")
    got = spark.read.parquet(f"{folder}/fills").select("order_id", "candle_start", "fill_price")
    assert got.count() == want.count() > 10 and got.exceptAll(want).count() == 0
    log = spark.read.parquet(f"{folder}/log").collect()
    assert len(log) == 2 and sum(r.fills for r in log) == want.count()
    left = [spark.read.schema(orders.schema).parquet(f"{folder}/state/book/batch={k}") for k in (0, 1)]
    assert orders.count() > left[0].count() >= left[1].count()  # what fired or ran out is not looked at again
    assert left[1].join(got, "order_id").isEmpty()


def test_bars_dealt_by_symbol_are_written_without_another_shuffle(spark, tmp_path):
    from barloom.sources import store
    df = spark.range(40).select(F.lit("NSE").alias("exchange"), F.concat(F.lit("S"), (F.col("id") % 5).cast("string")).alias("symbol"), F.date_add(F.lit("1999-12-01").cast("date"), F.col("id").cast("int")).alias("date"), "id")
    before = spark.sparkContext.statusTracker().getJobIdsForGroup("bars-once")
    spark.sparkContext.setJobGroup("bars-once", "")
    store.write_bars(df.repartition("symbol"), str(tmp_path / "lake"))
    jobs = set(spark.sparkContext.statusTracker().getJobIdsForGroup("bars-once")) - set(before)
    stages = {s for j in jobs for s in spark.sparkContext.statusTracker().getJobInfo(j).stageIds}
    spark.sparkContext.setJobGroup("", "")
    assert len(stages) <= 3, stages
    assert spark.read.parquet(str(tmp_path / "lake")).count() == 40
