"""Daily price, index and reference files: raw text columns -> canonical rows.

Each ``read_*`` only reads text columns in parallel; each ``normalise_*`` is a projection that can also
be applied to rows from anywhere else. "-" and blanks are NULL, never zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LAKH, CRORE = 100_000.0, 10_000_000.0
BAR_COLUMNS = ["date", "exchange", "symbol", "isin", "series", "open", "high", "low", "close", "prev_close", "last", "vwap", "volume", "turnover",
               "trades", "delivery_qty", "delivery_pct", "source"]

# Printed index names (lower case) and their stable codes.
INDEX_CODES = {"s&p cnx nifty": "NIFTY_50", "cnx nifty": "NIFTY_50", "nifty 50": "NIFTY_50", "s&p cnx nifty junior": "NIFTY_NEXT_50", "cnx nifty junior": "NIFTY_NEXT_50",
               "nifty next 50": "NIFTY_NEXT_50", "cnx bank": "NIFTY_BANK", "bank nifty": "NIFTY_BANK", "nifty bank": "NIFTY_BANK", "cnx 500": "NIFTY_500",
               "nifty 500": "NIFTY_500", "cnx it": "NIFTY_IT", "nifty it": "NIFTY_IT"}


def _read_text(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """CSV with every column as trimmed text; header names trimmed, a nameless trailing column dropped."""
    raw = spark.read.csv(path, header=header, inferSchema=False, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    keep = [c for c in raw.columns if c.strip() and not c.strip().startswith("_c")] if header else raw.columns
    return raw.select(*[F.trim(F.col(f"`{c}`")).alias(c.strip()) for c in keep])


def _text(name: str) -> Column:
    c = F.trim(F.col(f"`{name}`"))
    return F.when((c != "") & (c != "-"), c)


def _num(name: str) -> Column:
    """Blank and "-" are missing; any other text that is no number fails the read instead of becoming a price."""
    text = f"replace(nullif(nullif(trim(`{name}`), '-'), ''), ',', '')"
    return F.expr(f"CASE WHEN {text} IS NULL THEN NULL ELSE coalesce(try_cast({text} as double), raise_error(concat('not a number in {name}: ', {text}))) END")


def _int(name: str) -> Column:
    return _num(name).cast("long")


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def _bars(df: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """Canonical column list; fields a layout lacks become typed NULLs."""
    types = {"date": "date", "volume": "long", "trades": "long", "delivery_qty": "long", **{c: "string" for c in ("exchange", "symbol", "isin", "series", "source")}}
    return df.select(*[fields.get(c, F.lit(None)).cast(types.get(c, "double")).alias(c) for c in BAR_COLUMNS])


def normalise_full_daily(raw: DataFrame) -> DataFrame:
    """Full daily layout: dd-MMM-yyyy, turnover in lakhs, delivery columns."""
    return _bars(raw, {
        "date": F.to_date(_text("DATE1"), "dd-MMM-yyyy"), "exchange": F.lit("NSE"), "symbol": _text("SYMBOL"), "series": _text("SERIES"),
        "open": _zero(_num("OPEN_PRICE")), "high": _zero(_num("HIGH_PRICE")), "low": _zero(_num("LOW_PRICE")), "close": _zero(_num("CLOSE_PRICE")),
        "prev_close": _num("PREV_CLOSE"), "last": _num("LAST_PRICE"), "vwap": _num("AVG_PRICE"), "volume": _zero(_num("TTL_TRD_QNTY")),
        "turnover": _zero(_num("TURNOVER_LACS")) * LAKH, "trades": _int("NO_OF_TRADES"), "delivery_qty": _int("DELIV_QTY"), "delivery_pct": _num("DELIV_PER"),
        "source": F.lit("full_daily")})


def read_full_daily_csv(spark: SparkSession, path: str) -> DataFrame:
    return normalise_full_daily(_read_text(spark, path))


def normalise_legacy_daily(raw: DataFrame) -> DataFrame:
    """Legacy layout: unpadded d-MMM-yyyy in upper case, rupee turnover, no delivery and no ISIN."""
    return _bars(raw, {
        "date": F.to_date(F.initcap(_text("TIMESTAMP")), "d-MMM-yyyy"), "exchange": F.lit("NSE"), "symbol": _text("SYMBOL"), "series": _text("SERIES"),
        "open": _zero(_num("OPEN")), "high": _zero(_num("HIGH")), "low": _zero(_num("LOW")), "close": _zero(_num("CLOSE")), "prev_close": _num("PREVCLOSE"),
        "last": _num("LAST"), "volume": _zero(_num("TOTTRDQTY")), "turnover": _zero(_num("TOTTRDVAL")), "source": F.lit("legacy_daily")})


def read_legacy_daily_csv(spark: SparkSession, path: str) -> DataFrame:
    return normalise_legacy_daily(_read_text(spark, path))


def date_in_name(name: Column) -> Column:
    """ddMMyy right after the letters EQ in a file name."""
    return F.to_date(F.regexp_extract(name, r"(?i)EQ_?(?:ISINCODE_)?(\d{6})", 1), "ddMMyy")


def normalise_scripcode_daily(raw: DataFrame, file_name: Column) -> DataFrame:
    """Numeric-code layout: the code is the symbol, the date comes from the file name."""
    return _bars(raw.withColumn("_date", date_in_name(file_name)), {
        "date": F.col("_date"), "exchange": F.lit("BSE"), "symbol": _text("SC_CODE"), "series": _text("SC_GROUP"), "open": _zero(_num("OPEN")), "high": _zero(_num("HIGH")),
        "low": _zero(_num("LOW")), "close": _zero(_num("CLOSE")), "prev_close": _num("PREVCLOSE"), "last": _num("LAST"), "volume": _zero(_num("NO_OF_SHRS")),
        "turnover": _zero(_num("NET_TURNOV")), "trades": _int("NO_TRADES"), "source": F.lit("scripcode_daily")})


def read_scripcode_daily_csv(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, header=True, inferSchema=False, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return normalise_scripcode_daily(raw.select("*", F.col("_metadata.file_name").alias("_file")), F.col("_file"))


def normalise_udiff(raw: DataFrame, exchange: str) -> DataFrame:
    """Unified layout: ISO dates and ISINs; only equities are kept."""
    kind = _text("FinInstrmTp")
    eq = raw.filter(kind.isNull() | (kind == "STK"))
    return _bars(eq, {
        "date": F.to_date(_text("TradDt")), "exchange": F.lit(exchange), "symbol": _text("TckrSymb"), "isin": _text("ISIN"), "series": _text("SctySrs"),
        "open": _zero(_num("OpnPric")), "high": _zero(_num("HghPric")), "low": _zero(_num("LwPric")), "close": _zero(_num("ClsPric")), "prev_close": _num("PrvsClsgPric"),
        "last": _num("LastPric"), "volume": _zero(_num("TtlTradgVol")), "turnover": _zero(_num("TtlTrfVal")), "trades": _int("TtlNbOfTxsExctd"), "source": F.lit("udiff")})


def read_udiff_csv(spark: SparkSession, path: str, exchange: str) -> DataFrame:
    return normalise_udiff(_read_text(spark, path), exchange)


def index_code(name: Column, codes: dict[str, str] = INDEX_CODES) -> Column:
    table = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
    return F.try_element_at(table, F.lower(F.trim(name)))


def normalise_index_close(raw: DataFrame, codes: dict[str, str] = INDEX_CODES) -> DataFrame:
    """Index closes: rows without a close are skipped, turnover in crores, stable code beside the name."""
    out = raw.select(
        F.to_date(_text("Index Date"), "dd-MM-yyyy").alias("date"), _text("Index Name").alias("index_name"), index_code(F.col("`Index Name`"), codes).alias("index_code"),
        _num("Open Index Value").alias("open"), _num("High Index Value").alias("high"), _num("Low Index Value").alias("low"), _num("Closing Index Value").alias("close"),
        _num("Points Change").alias("points_change"), _num("Change(%)").alias("pct_change"), _int("Volume").alias("volume"), (_num("Turnover (Rs. Cr.)") * CRORE).alias("turnover"),
        _num("P/E").alias("pe"), _num("P/B").alias("pb"), _num("Div Yield").alias("div_yield"))
    return out.filter(F.col("close").isNotNull())


def read_index_close_csv(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, header=True, inferSchema=False, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return normalise_index_close(raw)


def read_security_list(spark: SparkSession, csv_path: str | None = None, json_path: str | None = None) -> DataFrame:
    """Listed securities of either exchange; rows without an ISIN are dropped. Face value and paid-up
    value are different things and both are kept."""
    parts = []
    if csv_path:
        r = _read_text(spark, csv_path)
        parts.append(r.select(F.lit("NSE").alias("exchange"), _text("SYMBOL").alias("symbol"), _text("NAME OF COMPANY").alias("company_name"), _text("SERIES").alias("series"),
                              F.to_date(F.initcap(_text("DATE OF LISTING")), "dd-MMM-yyyy").alias("listed_on"), _text("ISIN NUMBER").alias("isin"), _num("FACE VALUE").alias("face_value"),
                              _num("PAID UP VALUE").alias("paid_up_value"), F.lit("Active").alias("status"), F.lit(None).cast("string").alias("industry")))
    if json_path:
        fields = ["SCRIP_CD", "Scrip_Name", "Status", "GROUP", "FACE_VALUE", "ISIN_NUMBER", "INDUSTRY", "scrip_id"]
        j = spark.read.schema(T.StructType([T.StructField(f, T.StringType()) for f in fields])).json(json_path, multiLine=True)
        parts.append(j.select(F.lit("BSE").alias("exchange"), _text("scrip_id").alias("symbol"), _text("Scrip_Name").alias("company_name"), _text("GROUP").alias("series"),
                              F.lit(None).cast("date").alias("listed_on"), _text("ISIN_NUMBER").alias("isin"), _num("FACE_VALUE").alias("face_value"), F.lit(None).cast("double").alias("paid_up_value"),
                              _text("Status").alias("status"), _text("INDUSTRY").alias("industry")))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.filter(F.col("isin").isNotNull())


def read_symbol_changes(spark: SparkSession, path: str) -> DataFrame:
    """Headerless (company, old symbol, new symbol, date); a row of another width stops the read."""
    schema = "company string, old_symbol string, new_symbol string, changed string"
    raw = spark.read.schema(schema).csv(path, mode="FAILFAST", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return raw.select("company", "old_symbol", "new_symbol", F.to_date(F.initcap("changed"), "dd-MMM-yyyy").alias("changed_on"))


def read_price_bands(spark: SparkSession, path: str) -> DataFrame:
    r = _read_text(spark, path)
    return r.select(_text("Symbol").alias("symbol"), _text("Series").alias("series"), F.expr("try_cast(trim(Band) as int)").alias("band_pct"))


def read_holidays(spark: SparkSession, path: str, segment: str) -> DataFrame:
    """Holidays of one segment of the yearly JSON; a missing or empty segment raises when read, since it
    would otherwise mean "no holidays"."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, array<struct<tradingDate:string, description:string>>>").alias("m"))
    days = F.try_element_at("m", F.lit(segment))
    checked = text.select(F.when(F.coalesce(F.size(days), F.lit(0)) > 0, days).otherwise(
        F.raise_error(F.lit(f"no holidays for segment {segment}"))).alias("d"))
    return checked.select(F.explode("d").alias("h")).select(F.to_date(F.initcap("h.tradingDate"), "dd-MMM-yyyy").alias("date"), F.col("h.description").alias("description"))


def read_actions_json(spark: SparkSession, path: str) -> DataFrame:
    """Corporate actions with the raw subject and a content hash, so that a row captured twice is one."""
    names = ["symbol", "comp", "series", "isin", "faceVal", "subject", "exDate", "recDate"]
    raw = spark.read.schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).json(path, multiLine=True)
    return raw.select(
        _text("symbol").alias("symbol"), _text("series").alias("series"), _text("isin").alias("isin"), F.trim("subject").alias("subject"),
        F.to_date(_text("exDate"), "dd-MMM-yyyy").alias("ex_date"), F.to_date(_text("recDate"), "dd-MMM-yyyy").alias("record_date"), _num("faceVal").alias("face_value"),
        F.sha2(F.to_json(F.struct(*names)), 256).alias("row_hash")).dropDuplicates(["row_hash"])


def read_filing_index(spark: SparkSession, results_path: str | None = None, integrated_path: str | None = None) -> DataFrame:
    """Filing listings of both feeds. The broadcast time falls back to the revision, then the creation;
    a period ending in March is annual."""
    stamp = "dd-MMM-yyyy HH:mm:ss"

    def day(c):
        return F.to_date(F.to_timestamp(F.initcap(c), stamp))
    parts = []
    if results_path:
        names = ["symbol", "isin", "toDate", "seqNumber", "consolidated", "audited", "broadCastDate", "xbrl"]
        r = spark.read.schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).json(results_path, multiLine=True)
        parts.append(r.select("symbol", "isin", F.to_date(F.initcap("toDate"), "dd-MMM-yyyy").alias("period_end"), F.col("seqNumber").alias("seq"),
                              (F.lower("consolidated") == "consolidated").alias("consolidated"), day(_text("broadCastDate")).alias("broadcast"), _text("xbrl").alias("document")))
    if integrated_path:
        names = ["symbol", "isin", "qe_Date", "seq_Id", "consolidated", "broadcast_Date", "revised_Date", "creation_Date", "type_Sub", "xbrl"]
        r = spark.read.schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).json(integrated_path, multiLine=True)
        parts.append(r.select("symbol", "isin", F.to_date(F.initcap("qe_Date"), "dd-MMM-yyyy").alias("period_end"), F.col("seq_Id").alias("seq"),
                              (F.lower("consolidated") == "consolidated").alias("consolidated"),
                              day(F.coalesce(_text("broadcast_Date"), _text("revised_Date"), _text("creation_Date"))).alias("broadcast"), _text("xbrl").alias("document")))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.withColumn("is_annual", F.month("period_end") == 3)


def read_candles_json(spark: SparkSession, path: str) -> DataFrame:
    """Intraday candles; a time without an offset has no meaning and raises."""
    raw = spark.read.schema("symbol string, exchange string, interval string, candles array<struct<ts:string, o:double, h:double, l:double, c:double, v:long>>").json(path, multiLine=True)
    x = raw.select("symbol", "exchange", F.explode("candles").alias("k"))
    ts = F.when(F.col("k.ts").rlike(r"(Z|[+-]\d\d:?\d\d)$"), F.to_timestamp("k.ts")).otherwise(F.raise_error(F.lit("candle time without offset")))
    return x.select("symbol", "exchange", ts.alias("candle_start"), F.col("k.o").alias("open"), F.col("k.h").alias("high"), F.col("k.l").alias("low"), F.col("k.c").alias("close"), F.col("k.v").alias("volume"))
