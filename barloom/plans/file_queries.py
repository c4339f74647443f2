"""Reference files (survey 2.1, S6-S12): the derived tables are printed in each file layout to the shared folder, read back
by the reader and compared with the tables."""

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.lineage import shared_folder
from barloom.plans.registry import query
from barloom.sources import daily_files as files


def _new_folder(wb, name: str) -> str:
    return f"{shared_folder(wb.spark)}/{name}-{uuid.uuid4().hex}"


def _csv(wb, df: DataFrame, name: str, header: bool = True) -> str:
    path = _new_folder(wb, name)
    df.write.csv(path, header=header, emptyValue="")
    return path


def _arrays(wb, rows: DataFrame, key: str, name: str) -> str:
    """One file per key that holds a JSON array of the key's rows. Keys are small: a month, a year or a symbol."""
    path = _new_folder(wb, name)
    cols = [c for c in rows.columns if c != key]
    docs = rows.groupBy(key).agg(F.to_json(F.collect_list(F.struct(*cols)), {"ignoreNullFields": "false"}).alias("value"))
    docs.repartition(key).write.partitionBy(key).text(path)
    return path


def _dmy(c: str):
    return F.date_format(c, "dd-MMM-yyyy")


def _security_list(wb):
    s = wb.listings.join(wb.securities, "security_id")
    nse = s.filter("exchange = 'NSE'").select(
        F.col("symbol").alias("SYMBOL"), F.col("company_name").alias("NAME OF COMPANY"), F.concat(F.lit(" "), "series").alias(" SERIES"), F.lit("06-OCT-2008").alias(" DATE OF LISTING"),
        (F.col("face_value") / 2).alias(" PAID UP VALUE"), F.lit("1").alias(" MARKET LOT"), F.col("isin").alias(" ISIN NUMBER"), F.col("face_value").alias(" FACE VALUE"))
    bse = s.filter("exchange = 'BSE'").select(
        (F.col("security_id") % 5).alias("part"), F.col("security_id").cast("string").alias("SCRIP_CD"), F.col("company_name").alias("Scrip_Name"), F.col("status").alias("Status"), F.col("series").alias("GROUP"),
        F.format_string("%.2f", "face_value").alias("FACE_VALUE"), F.coalesce("isin", F.lit("")).alias("ISIN_NUMBER"), F.lit("-").alias("INDUSTRY"), F.concat("symbol", F.lit(" ")).alias("scrip_id"))
    return files.read_security_list(wb.spark, _csv(wb, nse, "security_list"), _arrays(wb, bse, "part", "security_list"))


query("s6_security_list", """
SELECT exchange, l.symbol, s.company_name, l.series, CASE WHEN exchange = 'NSE' THEN DATE '2008-10-06' END AS listed_on, s.isin, s.face_value, CASE WHEN exchange = 'NSE' THEN s.face_value / 2 END AS paid_up_value,
 CASE WHEN exchange = 'NSE' THEN 'Active' ELSE s.status END AS status, CAST(NULL AS VARCHAR) AS industry
FROM listings l JOIN securities s USING (security_id) WHERE isin IS NOT NULL""", "face_value paid_up_value")(_security_list)
query("s7_symbol_changes", "SELECT company, old_symbol, new_symbol, changed_on FROM changes")(
    lambda wb: files.read_symbol_changes(wb.spark, _csv(wb, wb.changes.select(F.concat(F.lit(" "), "company"), "old_symbol", "new_symbol", F.upper(_dmy("changed_on"))), "symbol_changes", header=False)))
BAND = "CASE security_id % 4 WHEN 0 THEN '5' WHEN 1 THEN '10' WHEN 2 THEN '20' ELSE 'No Band' END"
query("s8_price_bands", f"SELECT symbol, series, try_cast({BAND} AS INTEGER) AS band_pct FROM listings WHERE exchange = 'NSE'")(
    lambda wb: files.read_price_bands(wb.spark, _csv(wb, wb.listings.filter("exchange = 'NSE'").select(
        F.col("symbol").alias("Symbol"), F.col("series").alias("Series"), F.lit("x").alias("Security Name"), F.expr(BAND).alias("Band"), F.lit("-").alias("Remarks")), "price_bands")))


def _holidays(wb):
    days = wb.calendar.filter("NOT is_trading AND exchange = 'NSE'").groupBy(F.year("date").alias("year")).agg(
        F.collect_list(F.struct(F.upper(_dmy("date")).alias("tradingDate"), F.concat(F.lit("Closed "), F.col("date").cast("string")).alias("description"))).alias("d"))
    path = _new_folder(wb, "holidays")
    days.select("year", F.to_json(F.create_map(F.lit("CM"), F.col("d"), F.lit("FO"), F.slice("d", 1, 1))).alias("value")).repartition("year").write.partitionBy("year").text(path)
    return files.read_holidays(wb.spark, path, "CM")


query("s9_holidays", "SELECT date, 'Closed ' || CAST(date AS VARCHAR) AS description FROM calendar WHERE NOT is_trading AND exchange = 'NSE'")(_holidays)


def _actions(wb):
    """Every third action is captured twice."""
    rows = wb.actions.select(
        F.date_format("ex_date", "yyyyMM").alias("month"), "symbol", F.lit("x").alias("comp"), F.lit("EQ").alias("series"), F.lit("-").alias("isin"), F.lit("10").alias("faceVal"),
        F.concat("subject", F.lit(" ")).alias("subject"), _dmy("ex_date").alias("exDate"), F.when(F.col("action_id") % 2 == 0, _dmy("captured_on")).otherwise("-").alias("recDate"), "action_id")
    rows = rows.unionByName(rows.filter("action_id % 3 = 0")).drop("action_id")
    return files.read_actions_json(wb.spark, _arrays(wb, rows, "month", "actions")).drop("row_hash", "isin")


query("s10_actions_json", """
SELECT DISTINCT symbol, 'EQ' AS series, trim(subject) AS subject, ex_date, CASE WHEN action_id % 2 = 0 THEN captured_on END AS record_date, 10.0::DOUBLE AS face_value FROM actions""", "face_value")(_actions)


def _filing_index(wb):
    f = wb.filings.select("symbol", "consolidated", "period_end", "broadcast", F.abs(F.hash("symbol", "period_end")).cast("string").alias("seq"))
    stamp = F.concat(F.upper(_dmy("broadcast")), F.lit(" 18:30:00"))
    basis = F.when(F.col("consolidated"), "Consolidated").otherwise("Non-Consolidated")
    old = f.filter("period_end < '1996-01-01'").select(
        F.year("period_end").alias("year"), "symbol", F.lit("INE0").alias("isin"), _dmy("period_end").alias("toDate"), F.col("seq").alias("seqNumber"), basis.alias("consolidated"), F.lit("Audited").alias("audited"),
        F.coalesce(stamp, F.lit("-")).alias("broadCastDate"), F.lit("x.xml").alias("xbrl"))
    new = f.filter("period_end >= '1996-01-01'").select(
        F.year("period_end").alias("year"), "symbol", F.lit("INE0").alias("isin"), _dmy("period_end").alias("qe_Date"), F.col("seq").alias("seq_Id"), basis.alias("consolidated"),
        F.when(F.month("period_end") == 6, stamp).alias("broadcast_Date"), F.when(F.month("period_end") != 6, stamp).alias("revised_Date"), F.lit(None).cast("string").alias("creation_Date"), F.lit("x").alias("type_Sub"), F.lit("y.xml").alias("xbrl"))
    return files.read_filing_index(wb.spark, _arrays(wb, old, "year", "filings"), _arrays(wb, new, "year", "filings")).drop("seq")


query("s11_filing_index", """
SELECT symbol, 'INE0' AS isin, period_end, consolidated, broadcast, CASE WHEN period_end < DATE '1996-01-01' THEN 'x.xml' ELSE 'y.xml' END AS document, month(period_end) = 3 AS is_annual FROM filings""")(_filing_index)


def _candles(wb):
    rows = wb.candles.select("symbol", F.struct(F.date_format("candle_start", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("ts"), F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"), F.col("volume").alias("v")).alias("k"))
    docs = rows.groupBy(F.col("symbol").alias("part")).agg(F.to_json(F.struct(F.first("symbol").alias("symbol"), F.lit("NSE").alias("exchange"), F.lit("30m").alias("interval"), F.collect_list("k").alias("candles"))).alias("value"))
    path = _new_folder(wb, "candles")
    docs.repartition("part").write.partitionBy("part").text(path)
    return files.read_candles_json(wb.spark, path)


query("s12_candles_json", "SELECT symbol, 'NSE' AS exchange, candle_start, open, high, low, close, volume FROM candles", "open high low close")(_candles)
