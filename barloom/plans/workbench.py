"""Market tables derived from the given parquet tables, once as DataFrames and once as SQL.

Everything grows with the input: a symbol is a brand plus a block of 100 suppliers, a company a
nation plus a block of 1,500 customers, so the number of symbols rises with the data while the rows
of one symbol stay those of a trading calendar.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.windows import order_key
from barloom.operators import actions as act
from barloom.operators import lake

SERIES = ["EQ", "BE", "BZ"]

# Subject text by part size; any other size is a plain dividend.
SUBJECTS = {
    1: "Bonus 1:1",
    2: "Face Value Split (Sub-Division) - From Rs 10/- Per Share To Rs 2/- Per Share",
    3: "Bonus 1:2 And Dividend - Rs 3.50 Per Share",
    4: "Rights 1:5 @ Premium Rs 40/-",
    5: "Rights Issue 3:10",
    6: "Consolidation Of Equity Shares From Re 1/- Per Share To Rs 10/- Per Share",
    7: "Demerger",
    8: "Scheme Of Arrangement",
    9: "Buy Back Of Shares",
    10: "Annual General Meeting",
    11: "Interest Payment",
    12: "Redemption",
    13: "Distribution - Rs 2.25 Per Unit Dividend Re 0.32 Per Unit",
    14: "Return On Capital - Rs 0.80 Per Unit",
    15: "Interim Dividend",
    16: "Bonus Ncrps 1:116",
    17: "Bonus Issue Of Shares",
    18: "Capital Reduction",
    19: "Rights - 7 Ccps And 7 Warrants:40",
    20: "Consolidation Of Shares",
    21: "Change Of Name",
    22: "Dividend - Rs 1,250.00 Per Share & Special Dividend - Re 1 Per Share",
    23: " ",
    24: "Extra Ordinary General Meeting And Something Else",
    25: "Face Value Split - From Rs 0/- To Rs 5/-",
    26: "Bonus 1:1 & Rights 3:19",
}


def _subject_sql() -> str:
    cases = "\n".join(f"  WHEN {k} THEN '{v}'" for k, v in SUBJECTS.items())
    return (f"CASE p_size\n{cases}\n  ELSE 'Interim Dividend - Rs ' || CAST(p_size AS VARCHAR)"
            " || '.50 Per Share' END")


TABLE_SQL: dict[str, str] = {
    "tape": """
SELECT p_brand || '-' || CAST(l_suppkey // 100 AS VARCHAR) AS symbol,
       CASE l_linestatus WHEN 'O' THEN 'NSE' ELSE 'BSE' END AS exchange,
       CASE l_returnflag WHEN 'A' THEN 'EQ' WHEN 'N' THEN 'BE' ELSE 'BZ' END AS series,
       CAST(l_shipdate AS DATE) AS date, floor(l_extendedprice * 100 / l_quantity) / 100 AS price,
       l_quantity AS qty, l_extendedprice AS amount, l_discount AS discount,
       l_orderkey AS orderkey, l_linenumber AS linenumber, l_partkey AS partkey, l_suppkey AS suppkey
FROM lineitem JOIN part ON p_partkey = l_partkey""",
    "bars": """
SELECT *, lag(close) OVER (PARTITION BY exchange, symbol, series ORDER BY date) AS prev_close,
       turnover / volume AS vwap, delivery_qty * 100.0::DOUBLE / volume AS delivery_pct,
       CASE WHEN series = 'EQ' THEN 'full' WHEN series = 'BE' THEN 'legacy' ELSE 'unified' END AS source
FROM (
  SELECT exchange, symbol, series, date,
         arg_min(price, row(orderkey, linenumber, partkey, amount, qty)) AS open,
         max(price) AS high, min(price) AS low,
         arg_max(price, row(orderkey, linenumber, partkey, amount, qty)) AS close,
         CAST(sum(qty) AS BIGINT) AS volume, round(sum(amount), 2) AS turnover, count(*) AS trades,
         CAST(sum(qty) FILTER (WHERE discount < 0.05) AS BIGINT) AS delivery_qty
  FROM tape GROUP BY exchange, symbol, series, date)""",
    "panel": """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol, date
     ORDER BY CASE series WHEN 'EQ' THEN 1 WHEN 'BE' THEN 2 ELSE 3 END) AS rn
  FROM bars WHERE exchange = 'NSE') WHERE rn = 1""",
    "idx": """
SELECT CASE exchange WHEN 'NSE' THEN 'BROAD_500' ELSE 'WIDE_200' END AS index_code,
       CASE WHEN exchange = 'NSE' AND year(date) < 1998 THEN 'Broad Five Hundred'
            WHEN exchange = 'NSE' THEN 'Broad 500' ELSE 'Wide 200' END AS index_name,
       date, min(price) AS low, max(price) AS high, round(sum(amount), 2) / sum(qty) AS close
FROM tape WHERE day(date) <> 13 GROUP BY exchange, date""",
    "calendar": """
SELECT exchange, date, NOT (isodow(date) >= 6 OR (month(date), day(date)) IN ((1, 26), (8, 15), (10, 2)))
         AS is_trading
FROM (SELECT exchange, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date
      FROM tape GROUP BY exchange)
WHERE year(date) <> 2000""",
    "securities": """
SELECT bn + 100 * grp AS security_id, symbol AS canonical_symbol, 'Company ' || bn || ' of block ' || grp AS company_name,
       CASE WHEN bn % 10 = 7 THEN NULL WHEN bn % 10 = 3 THEN 'INF' WHEN bn % 10 = 9 THEN 'IN9' ELSE 'INE' END
         || lpad(CAST(bn + 100 * grp AS VARCHAR), 9, '0') AS isin,
       CASE WHEN bn % 3 = 0 THEN 'BSE' ELSE 'NSE' END AS primary_exchange,
       CASE WHEN bn % 11 = 5 THEN 'SUSPENDED' ELSE 'ACTIVE' END AS status,
       CASE WHEN bn % 2 = 0 THEN 10.0::DOUBLE ELSE 2.0::DOUBLE END AS face_value
FROM (SELECT DISTINCT p_brand || '-' || CAST(p_partkey // 2000 AS VARCHAR) AS symbol,
             CAST(substr(p_brand, 7) AS BIGINT) AS bn, p_partkey // 2000 AS grp FROM part)""",
    "listings": """
SELECT exchange, canonical_symbol AS symbol, series, security_id
FROM securities, (VALUES ('NSE', 'EQ'), ('BSE', 'EQ'), ('NSE', 'BE')) v(exchange, series)
WHERE series = 'EQ' OR security_id % 4 = 0""",
    "symhist": """
SELECT security_id, 'NSE' AS exchange, 'OLD' || canonical_symbol AS symbol,
       DATE '1900-01-01' AS valid_from, DATE '1998-01-01' AS valid_to FROM securities
UNION ALL
SELECT security_id, 'NSE', canonical_symbol, DATE '1998-01-01', NULL FROM securities""",
    "changes": """
SELECT company_name AS company, 'OLD' || canonical_symbol AS old_symbol, canonical_symbol AS new_symbol,
       DATE '1998-01-01' AS changed_on FROM securities
UNION ALL
SELECT company_name, 'ANC' || canonical_symbol, 'OLD' || canonical_symbol, DATE '1996-06-01'
FROM securities WHERE security_id % 2 = 0
UNION ALL
SELECT company_name, canonical_symbol, 'GONE' || canonical_symbol, DATE '1999-01-01'
FROM securities WHERE security_id % 5 = 1""",
    "actions": f"""
SELECT p_partkey AS action_id, 'NSE' AS exchange, p_brand || '-' || CAST(p_partkey // 2000 AS VARCHAR) AS symbol,
       DATE '1995-06-01' + CAST(p_partkey * 37 % 2300 AS INTEGER) AS ex_date,
       DATE '1995-05-01' + CAST(p_partkey * 37 % 2300 AS INTEGER) AS captured_on,
       {_subject_sql()} AS subject, p_size
FROM part""",
    "parsed": """
SELECT action_id, exchange, symbol, ex_date, captured_on, g.* EXCLUDE (p_size)
FROM actions JOIN (
  SELECT * FROM (VALUES
   (1, 1, 'bonus', NULL::DOUBLE, 1, 1, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, 0.5::DOUBLE, 2.0::DOUBLE, 'parsed'),
   (2, 1, 'split', NULL, NULL, NULL, 10, 2, NULL, 0.2, 5.0, 'parsed'),
   (3, 1, 'bonus', NULL, 1, 2, NULL, NULL, NULL, 2.0/3.0, 1.5, 'parsed'),
   (3, 2, 'dividend', 3.5, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'parsed'),
   (4, 1, 'rights', NULL, 1, 5, NULL, NULL, 40, NULL, NULL, 'parsed'),
   (5, 1, 'rights', NULL, 3, 10, NULL, NULL, NULL, NULL, NULL, 'ambiguous'),
   (6, 1, 'consolidation', NULL, NULL, NULL, 1, 10, NULL, 10, 0.1, 'parsed'),
   (7, 1, 'demerger', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'parsed'),
   (8, 1, 'demerger', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'parsed'),
   (9, 1, 'buyback', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'parsed'),
   (10, 1, 'agm', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'parsed'),
   (11, 1, 'interest', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'parsed'),
   (12, 1, 'interest', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'parsed'),
   (13, 1, 'distribution', 2.25, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'parsed'),
   (14, 1, 'distribution', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'ambiguous'),
   (15, 1, 'dividend', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'ambiguous'),
   (16, 1, 'bonus', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'parsed'),
   (17, 1, 'bonus', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'ambiguous'),
   (18, 1, 'capital_reduction', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'ambiguous'),
   (19, 1, 'rights', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'ambiguous'),
   (20, 1, 'consolidation', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'parsed'),
   (21, 1, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'unparsed'),
   (22, 1, 'dividend', 1250, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'parsed'),
   (22, 2, 'dividend', 1, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'parsed'),
   (23, 1, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'unparsed'),
   (24, 1, 'agm', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'ambiguous'),
   (25, 1, 'split', NULL, NULL, NULL, 0, 5, NULL, NULL, NULL, 'ambiguous'),
   (26, 1, 'bonus', NULL, 1, 1, NULL, NULL, NULL, 0.5, 2.0, 'ambiguous'),
   (26, 2, 'rights', NULL, 3, 19, NULL, NULL, NULL, NULL, NULL, 'ambiguous')
  ) v(p_size, clause, action_type, amount, num, den, fv_from, fv_to, premium, price_factor, volume_factor, parse_status)
  UNION ALL
  SELECT s, 1, 'dividend', s + 0.5, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'parsed' FROM range(27, 51) r(s)
) g USING (p_size)""",
    "cumprice": """
SELECT action_id, arg_max(b.close, row(b.date, -(CASE b.series WHEN 'EQ' THEN 1 WHEN 'BE' THEN 2 ELSE 3 END))) AS cum_price
FROM actions a JOIN bars b ON b.symbol = a.symbol AND b.exchange = a.exchange AND b.date < a.ex_date
GROUP BY action_id""",
    "facevalue": """
SELECT a.action_id, coalesce(arg_min(s.fv_from, row(s.ex_date, s.action_id)), min(x.face_value)) AS face_value
FROM actions a LEFT JOIN parsed s ON s.exchange = a.exchange AND s.symbol = a.symbol AND s.ex_date > a.ex_date AND s.fv_from > 0 AND s.parse_status = 'parsed'
  AND s.action_type IN ('split', 'consolidation')
LEFT JOIN securities x ON x.canonical_symbol = a.symbol
GROUP BY a.action_id""",
    "factored": """
SELECT p.* REPLACE (coalesce(p.price_factor, r.rf) AS price_factor, coalesce(p.volume_factor, 1.0 / r.rf) AS volume_factor)
FROM parsed p LEFT JOIN (
  SELECT action_id, CASE WHEN issue >= cum_price THEN 1.0::DOUBLE
                         WHEN f >= 0.2 THEN f END AS rf
  FROM (SELECT p.action_id, cum_price, premium + face_value AS issue,
               (den * cum_price + num * (premium + face_value)) / (den + num) / cum_price AS f
        FROM parsed p JOIN cumprice USING (action_id) JOIN facevalue USING (action_id)
        WHERE p.action_type = 'rights' AND premium IS NOT NULL)) r USING (action_id)""",
    "timeline": """
SELECT exchange, symbol, effective_date, price_factor, volume_factor,
       product(price_factor) OVER w AS cumulative_price_factor, product(volume_factor) OVER w AS cumulative_volume_factor
FROM (SELECT exchange, symbol, ex_date AS effective_date, product(price_factor) AS price_factor,
             product(volume_factor) AS volume_factor
      FROM (SELECT DISTINCT ON (exchange, symbol, ex_date, action_type, num, den, round(price_factor, 12)) *
            FROM factored WHERE price_factor IS NOT NULL AND parse_status = 'parsed'
            ORDER BY captured_on DESC, action_id DESC)
      GROUP BY ALL)
WINDOW w AS (PARTITION BY exchange, symbol ORDER BY effective_date DESC ROWS UNBOUNDED PRECEDING)""",
    "adj": """
SELECT b.exchange, b.symbol, b.series, b.date, b.open * f AS open, b.high * f AS high, b.low * f AS low, b.close * f AS close,
       b.prev_close * f AS prev_close, b.vwap * f AS vwap,
       CAST(round_even(b.volume * v, 0) AS BIGINT) AS volume, b.turnover, b.trades,
       CAST(round_even(b.delivery_qty * v, 0) AS BIGINT) AS delivery_qty, b.delivery_pct,
       f AS cumulative_price_factor, v AS cumulative_volume_factor
FROM (SELECT b.*, coalesce(t.cumulative_price_factor, 1.0) AS f, coalesce(t.cumulative_volume_factor, 1.0) AS v
      FROM bars b ASOF LEFT JOIN timeline t
        ON b.exchange = t.exchange AND b.symbol = t.symbol AND b.date < t.effective_date) b""",
    "filings": """
SELECT symbol, consolidated, period_end, broadcast,
       coalesce(broadcast + 1, period_end + 60) AS available_on, month(period_end) = 3 AS is_annual,
       revenue * k AS q_revenue, pbt * k AS q_pbt, finance * k AS q_finance, pat * k AS q_pat, eps * k AS q_eps,
       CASE WHEN month(period_end) = 3 THEN sum(revenue) OVER w * k END AS y_revenue,
       CASE WHEN month(period_end) = 3 THEN sum(pat) OVER w * k END AS y_pat,
       equity * k AS i_equity, borrow_nc * k AS i_borrow_nc, borrow_c * k AS i_borrow_c
FROM (
  SELECT q.*, v.consolidated, v.k,
         CASE WHEN qn % 7 <> 3 THEN period_end + CAST(45 + qn % 30 + v.lag AS INTEGER) END AS broadcast, v.lag
  FROM (
    SELECT 'Brand#' || (c_nationkey + 1) || '-' || (c_custkey // 1500) AS symbol, c_nationkey AS nk,
           CAST(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS period_end,
           min(c_nationkey * 3 + quarter(o_orderdate) + year(o_orderdate)) AS qn,
           round(sum(o_totalprice), 4) AS revenue,
           round(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice WHEN o_orderpriority = '5-LOW' THEN -0.5 * o_totalprice ELSE 0 END), 4) AS pbt,
           round(sum(CASE WHEN o_orderpriority = '2-HIGH' THEN o_totalprice * 0.25 ELSE 0 END), 4) AS finance,
           round(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice * 0.75 WHEN o_orderpriority = '5-LOW' THEN -0.5 * o_totalprice ELSE 0 END), 4) AS pat,
           round(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice * 0.75 WHEN o_orderpriority = '5-LOW' THEN -0.5 * o_totalprice ELSE 0 END), 4) / 10000 AS eps,
           round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END), 4) AS equity,
           round(sum(CASE WHEN o_orderpriority = '3-MEDIUM' THEN o_totalprice END), 4) AS borrow_nc,
           round(sum(CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN o_totalprice END), 4) AS borrow_c
    FROM orders JOIN customer ON c_custkey = o_custkey
    GROUP BY ALL) q
  JOIN (VALUES (TRUE, 1.0::DOUBLE, 0), (TRUE, 1.25::DOUBLE, 100), (FALSE, 0.75::DOUBLE, 0)) v(consolidated, k, lag)
    ON (NOT v.consolidated OR nk % 2 = 1) AND (v.lag = 0 OR qn % 7 = 1))
WINDOW w AS (PARTITION BY symbol, consolidated, lag ORDER BY period_end ROWS 3 PRECEDING)""",
    "ledger": """
SELECT 'PF-' || (suppkey // 10) AS portfolio, symbol, date, orderkey // 1000 AS block, orderkey, linenumber, partkey, suppkey, amount,
       CAST(qty AS BIGINT) AS qty, price, 'buy' AS side, 'delivery' AS product, exchange, series
FROM tape
UNION ALL
SELECT 'PF-' || (suppkey // 10), symbol, date + CAST(1 + 7 * linenumber AS INTEGER), orderkey // 1000, orderkey, linenumber, partkey, suppkey, amount,
       CASE WHEN linenumber % 2 = 1 THEN CAST(qty AS BIGINT) ELSE CAST(qty AS BIGINT) // 2 END,
       floor(price * (100 + (linenumber - 4) * 2)) / 100, 'sell', 'delivery', exchange, series
FROM tape WHERE linenumber % 2 = 1 OR qty >= 2""",
    "ticks": """
SELECT event_type || '-' || (user_id // 50) AS symbol, ts, value AS price, event_id, 1 + event_id % 100 AS qty FROM events""",
    "job_runs": """
SELECT event_type || '-' || (user_id // 50) AS job, CAST(ts AS DATE) AS day, event_id AS attempt, ts AS finished_at,
       CASE WHEN value < 25 THEN 'failed' WHEN value < 40 THEN 'degraded' WHEN value < 50 THEN 'skipped' ELSE 'success' END AS status,
       event_id % 2 = 0 AS scheduled
FROM events""",
    "candles": """
SELECT symbol, time_bucket(INTERVAL 30 MINUTE, ts) AS candle_start, arg_min(price, row(ts, event_id)) AS open, max(price) AS high,
       min(price) AS low, arg_max(price, row(ts, event_id)) AS close, CAST(sum(qty) AS BIGINT) AS volume
FROM ticks GROUP BY ALL""",
    "book": """
SELECT event_id * 2 AS order_id, symbol, ts + INTERVAL 90 SECOND AS created_at,
       CAST(CAST(ts + INTERVAL 90 SECOND AS DATE) + 1 AS TIMESTAMP) AS valid_until,
       CASE event_id % 4 WHEN 0 THEN 'market' WHEN 2 THEN 'stop_loss' ELSE 'limit' END AS type,
       CASE WHEN event_id % 4 IN (0, 1) THEN 'buy' ELSE 'sell' END AS side,
       CASE event_id % 4 WHEN 1 THEN floor(price * 75) / 100 WHEN 3 THEN floor(price * 125) / 100 END AS limit_price,
       CASE event_id % 4 WHEN 2 THEN floor(price * 50) / 100 END AS trigger_price,
       qty, CASE WHEN event_id % 4 = 2 THEN event_id END AS oco_group, 'open' AS status
FROM ticks
UNION ALL
SELECT event_id * 2 + 1, symbol, ts + INTERVAL 90 SECOND, CAST(CAST(ts + INTERVAL 90 SECOND AS DATE) + 1 AS TIMESTAMP),
       'target', 'sell', NULL, floor(price * 150) / 100, qty, event_id, 'open'
FROM ticks WHERE event_id % 4 = 2""",
}


class Workbench:
    """The same tables as lazily built DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        if spark.conf.get("spark.sql.session.timeZone") != "UTC":
            spark.conf.set("spark.sql.session.timeZone", "UTC")

    _shared: dict = {}

    @classmethod
    def shared(cls, spark: SparkSession, sf_dir: str) -> "Workbench":
        """One workbench per application and folder, so that tables cut once serve every later query."""
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in cls._shared:
            cls._shared = {key: cls(spark, sf_dir)}
        return cls._shared[key]

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def tape(self) -> DataFrame:
        li = self.read("lineitem")
        part = self.read("part").select("p_partkey", "p_brand")
        series = F.when(F.col("l_returnflag") == "A", "EQ").when(F.col("l_returnflag") == "N", "BE").otherwise("BZ")
        return li.join(part, li.l_partkey == part.p_partkey).select(
            F.concat("p_brand", F.lit("-"), F.expr("l_suppkey div 100").cast("string")).alias("symbol"),
            F.when(F.col("l_linestatus") == "O", "NSE").otherwise("BSE").alias("exchange"),
            series.alias("series"), F.to_date("l_shipdate").alias("date"),
            (F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity")) / 100).alias("price"),
            F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("amount"),
            F.col("l_discount").alias("discount"), F.col("l_orderkey").alias("orderkey"),
            F.col("l_linenumber").alias("linenumber"), F.col("l_partkey").alias("partkey"),
            F.col("l_suppkey").alias("suppkey"))

    @cached_property
    def bars(self) -> DataFrame:
        # Trades equal in all of these have the same price, so the order is total where it matters.
        cents = F.round(F.col("amount") * 100)
        return lake.bars_from_trades(self.tape, order_key([
            (F.col("orderkey"), 13), (F.col("linenumber"), 2), (F.col("partkey"), 11), (cents, 9), (F.col("qty"), 3)]))

    @cached_property
    def panel(self) -> DataFrame:
        """One row a day and symbol; written, as days, index returns, features, outcomes and windows all read it."""
        from barloom.functions.lineage import written
        return written(lake.panel(self.bars.filter(F.col("exchange") == "NSE"), SERIES))

    @cached_property
    def idx(self) -> DataFrame:
        """One row a day and index; written, as it is small and costs a pass over all trades."""
        from barloom.functions.lineage import written
        nse = F.col("exchange") == "NSE"
        return written(self.tape.filter(F.dayofmonth("date") != 13).groupBy("exchange", "date")
                .agg(F.min("price").alias("low"), F.max("price").alias("high"),
                     (F.round(F.sum("amount"), 2) / F.sum("qty")).alias("close"))
                .select(F.when(nse, "BROAD_500").otherwise("WIDE_200").alias("index_code"),
                        F.when(nse & (F.year("date") < 1998), "Broad Five Hundred")
                        .when(nse, "Broad 500").otherwise("Wide 200").alias("index_name"),
                        "date", "low", "high", "close"))

    @cached_property
    def calendar(self) -> DataFrame:
        md = F.date_format("date", "MM-dd")
        return (self.tape.groupBy("exchange").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
                .select("exchange", F.explode(F.sequence("lo", "hi")).alias("date"))
                .filter(F.year("date") != 2000)
                .withColumn("is_trading", ~((F.weekday("date") >= 5) | md.isin("01-26", "08-15", "10-02"))))

    @cached_property
    def securities(self) -> DataFrame:
        p = self.read("part").select(
            F.concat("p_brand", F.lit("-"), F.expr("p_partkey div 2000").cast("string")).alias("symbol"),
            F.substring("p_brand", 7, 9).cast("long").alias("bn"), F.expr("p_partkey div 2000").alias("grp")).distinct()
        sid = F.col("bn") + 100 * F.col("grp")
        ten = F.col("bn") % 10
        return p.select(
            sid.alias("security_id"), F.col("symbol").alias("canonical_symbol"),
            F.concat(F.lit("Company "), F.col("bn").cast("string"), F.lit(" of block "), F.col("grp").cast("string")).alias("company_name"),
            F.concat(F.when(ten == 7, F.lit(None)).when(ten == 3, "INF").when(ten == 9, "IN9").otherwise("INE"),
                     F.lpad(sid.cast("string"), 9, "0")).alias("isin"),
            F.when(F.col("bn") % 3 == 0, "BSE").otherwise("NSE").alias("primary_exchange"),
            F.when(F.col("bn") % 11 == 5, "SUSPENDED").otherwise("ACTIVE").alias("status"),
            F.when(F.col("bn") % 2 == 0, 10.0).otherwise(2.0).alias("face_value"))

    @cached_property
    def listings(self) -> DataFrame:
        places = F.array(*[F.struct(F.lit(e).alias("exchange"), F.lit(s).alias("series"))
                           for e, s in (("NSE", "EQ"), ("BSE", "EQ"), ("NSE", "BE"))])
        return (self.securities.select("security_id", F.col("canonical_symbol").alias("symbol"), F.explode(places).alias("p"))
                .select("p.exchange", "symbol", "p.series", "security_id")
                .filter((F.col("series") == "EQ") | (F.col("security_id") % 4 == 0)))

    @cached_property
    def symhist(self) -> DataFrame:
        s = self.securities
        cut = F.lit("1998-01-01").cast("date")
        old = s.select("security_id", F.lit("NSE").alias("exchange"), F.concat(F.lit("OLD"), "canonical_symbol").alias("symbol"),
                       F.lit("1900-01-01").cast("date").alias("valid_from"), cut.alias("valid_to"))
        new = s.select("security_id", F.lit("NSE").alias("exchange"), F.col("canonical_symbol").alias("symbol"),
                       cut.alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
        return old.unionByName(new)

    @cached_property
    def changes(self) -> DataFrame:
        s = self.securities

        def step(df, old, new, day):
            return df.select(F.col("company_name").alias("company"), F.concat(F.lit(old), "canonical_symbol").alias("old_symbol"),
                             F.concat(F.lit(new), "canonical_symbol").alias("new_symbol"), F.lit(day).cast("date").alias("changed_on"))
        return (step(s, "OLD", "", "1998-01-01")
                .unionByName(step(s.filter("security_id % 2 = 0"), "ANC", "OLD", "1996-06-01"))
                .unionByName(step(s.filter("security_id % 5 = 1"), "", "GONE", "1999-01-01")))

    @cached_property
    def actions(self) -> DataFrame:
        size = F.col("p_size")
        text = F.concat(F.lit("Interim Dividend - Rs "), size.cast("string"), F.lit(".50 Per Share"))
        for k, v in SUBJECTS.items():
            text = F.when(size == k, v).otherwise(text)
        shift = (F.col("p_partkey") * 37 % 2300).cast("int")
        return self.read("part").select(
            F.col("p_partkey").alias("action_id"), F.lit("NSE").alias("exchange"),
            F.concat("p_brand", F.lit("-"), F.expr("p_partkey div 2000").cast("string")).alias("symbol"),
            F.date_add(F.lit("1995-06-01").cast("date"), shift).alias("ex_date"),
            F.date_add(F.lit("1995-05-01").cast("date"), shift).alias("captured_on"), text.alias("subject"))

    @cached_property
    def parsed(self) -> DataFrame:
        return act.parse_subjects(self.actions)

    @cached_property
    def factored(self) -> DataFrame:
        return act.apply_rights(self.parsed, self.bars, self.securities, SERIES)

    @cached_property
    def timeline(self) -> DataFrame:
        return act.factor_timeline(act.dedupe_actions(self.factored))

    @cached_property
    def adj(self) -> DataFrame:
        return act.adjust_bars(self.bars, self.timeline)

    @cached_property
    def filings(self) -> DataFrame:
        o, c = self.read("orders"), self.read("customer").select("c_custkey", "c_nationkey")
        pr, tp = F.col("o_orderpriority"), F.col("o_totalprice")
        pat = F.when(pr == "1-URGENT", tp * 0.75).when(pr == "5-LOW", -0.5 * tp).otherwise(0)
        q = (o.join(c, o.o_custkey == c.c_custkey)
             .withColumn("symbol", F.concat(F.lit("Brand#"), (F.col("c_nationkey") + 1).cast("string"), F.lit("-"),
                                            F.expr("c_custkey div 1500").cast("string")))
             .withColumn("period_end", F.last_day(F.add_months(F.trunc("o_orderdate", "quarter"), 2)))
             .withColumn("qn", F.col("c_nationkey") * 3 + F.quarter("o_orderdate") + F.year("o_orderdate"))
             .groupBy("symbol", F.col("c_nationkey").alias("nk"), "period_end").agg(
                 F.min("qn").alias("qn"), F.round(F.sum(tp), 4).alias("revenue"),
                 F.round(F.sum(F.when(pr == "1-URGENT", tp).when(pr == "5-LOW", -0.5 * tp).otherwise(0)), 4).alias("pbt"),
                 F.round(F.sum(F.when(pr == "2-HIGH", tp * 0.25).otherwise(0)), 4).alias("finance"),
                 F.round(F.sum(pat), 4).alias("pat"),
                 (F.round(F.sum(pat), 4) / 10000).alias("eps"),
                 F.round(F.sum(F.when(F.col("o_orderstatus") == "F", tp).otherwise(0)), 4).alias("equity"),
                 F.round(F.sum(F.when(pr == "3-MEDIUM", tp)), 4).alias("borrow_nc"),
                 F.round(F.sum(F.when(pr == "4-NOT SPECIFIED", tp)), 4).alias("borrow_c")))
        versions = F.array(*[F.struct(F.lit(a).alias("consolidated"), F.lit(k).alias("k"), F.lit(lag).alias("lag"))
                             for a, k, lag in ((True, 1.0, 0), (True, 1.25, 100), (False, 0.75, 0))])
        v = (q.withColumn("v", F.explode(versions)).select("*", "v.*").drop("v")
             .filter((~F.col("consolidated") | (F.col("nk") % 2 == 1)) & ((F.col("lag") == 0) | (F.col("qn") % 7 == 1)))
             .withColumn("broadcast", F.when(F.col("qn") % 7 != 3, F.date_add("period_end", (45 + F.col("qn") % 30 + F.col("lag")).cast("int")))))
        w = Window.partitionBy("symbol", "consolidated", "lag").orderBy("period_end").rowsBetween(-3, 0)
        march = F.month("period_end") == 3
        k = F.col("k")
        return v.select(
            "symbol", "consolidated", "period_end", "broadcast",
            F.coalesce(F.date_add("broadcast", 1), F.date_add("period_end", 60)).alias("available_on"), march.alias("is_annual"),
            (F.col("revenue") * k).alias("q_revenue"), (F.col("pbt") * k).alias("q_pbt"), (F.col("finance") * k).alias("q_finance"),
            (F.col("pat") * k).alias("q_pat"), (F.col("eps") * k).alias("q_eps"),
            F.when(march, F.sum("revenue").over(w) * k).alias("y_revenue"), F.when(march, F.sum("pat").over(w) * k).alias("y_pat"),
            (F.col("equity") * k).alias("i_equity"), (F.col("borrow_nc") * k).alias("i_borrow_nc"), (F.col("borrow_c") * k).alias("i_borrow_c"))

    @cached_property
    def ledger(self) -> DataFrame:
        """A purchase and, for most, a later sale of every trade, from one scan."""
        odd, whole = F.col("linenumber") % 2 == 1, F.col("qty").cast("long")
        leg = lambda date, qty, price, side: F.struct(date.alias("date"), qty.alias("qty"), price.alias("price"), F.lit(side).alias("side"))
        buy = leg(F.col("date"), whole, F.col("price"), "buy")
        sell = leg(F.date_add("date", 1 + 7 * F.col("linenumber")), F.when(odd, whole).otherwise(F.expr("cast(qty as bigint) div 2")), F.floor(F.col("price") * (100 + (F.col("linenumber") - 4) * 2)) / 100, "sell")
        legs = F.explode(F.when(odd | (F.col("qty") >= 2), F.array(buy, sell)).otherwise(F.array(buy)))
        t = self.tape.withColumn("leg", legs)
        return t.select(F.concat(F.lit("PF-"), F.expr("suppkey div 10").cast("string")).alias("portfolio"), "symbol", "leg.date", F.expr("orderkey div 1000").alias("block"), "orderkey", "linenumber", "partkey", "suppkey", "amount",
                        "leg.qty", "leg.price", "leg.side", F.lit("delivery").alias("product"), "exchange", "series")

    @cached_property
    def trades_in_order(self) -> DataFrame:
        from barloom.operators.ledger import trades_in_order
        return trades_in_order(self.ledger)

    @cached_property
    def ticks(self) -> DataFrame:
        return self.read("events").select(
            F.concat("event_type", F.lit("-"), F.expr("user_id div 50").cast("string")).alias("symbol"), "ts",
            F.col("value").alias("price"), "event_id", (1 + F.col("event_id") % 100).alias("qty"))

    @cached_property
    def job_runs(self) -> DataFrame:
        v = F.col("value")
        return self.read("events").select(
            F.concat("event_type", F.lit("-"), F.expr("user_id div 50").cast("string")).alias("job"), F.to_date("ts").alias("day"),
            F.col("event_id").alias("attempt"), F.col("ts").alias("finished_at"),
            F.when(v < 25, "failed").when(v < 40, "degraded").when(v < 50, "skipped").otherwise("success").alias("status"),
            (F.col("event_id") % 2 == 0).alias("scheduled"))

    @cached_property
    def candles(self) -> DataFrame:
        from barloom.streaming.candles import candles
        return candles(self.ticks, "30 minutes", tiebreak="event_id").drop("candle_end")

    @cached_property
    def book(self) -> DataFrame:
        t = self.ticks
        four = F.col("event_id") % 4
        made = F.col("ts") + F.expr("INTERVAL 90 SECONDS")
        until = F.date_add(F.to_date(made), 1).cast("timestamp")
        p = F.col("price")
        base = t.select(
            (F.col("event_id") * 2).alias("order_id"), "symbol", made.alias("created_at"), until.alias("valid_until"),
            F.when(four == 0, "market").when(four == 2, "stop_loss").otherwise("limit").alias("type"),
            F.when(four <= 1, "buy").otherwise("sell").alias("side"),
            F.when(four == 1, (F.floor(p * 75) / 100)).when(four == 3, (F.floor(p * 125) / 100)).alias("limit_price"),
            F.when(four == 2, (F.floor(p * 50) / 100)).alias("trigger_price"), "qty",
            F.when(four == 2, F.col("event_id")).alias("oco_group"), F.lit("open").alias("status"))
        twin = t.filter(four == 2).select(
            (F.col("event_id") * 2 + 1).alias("order_id"), "symbol", made.alias("created_at"), until.alias("valid_until"),
            F.lit("target").alias("type"), F.lit("sell").alias("side"), F.lit(None).cast("double").alias("limit_price"),
            (F.floor(p * 150) / 100).alias("trigger_price"), "qty", F.col("event_id").alias("oco_group"), F.lit("open").alias("status"))
        return base.unionByName(twin)

    def _features(self, panel: DataFrame) -> DataFrame:
        from barloom.operators import features as ft
        from barloom.operators.screening import symbol_window
        f = ft.features(panel, self.idx.filter("index_code = 'BROAD_500'"), self.panel.select("date").distinct())
        return f.withColumn("prev_rsi14", F.lag("rsi14").over(symbol_window("symbol")))

    @cached_property
    def feat(self) -> DataFrame:
        return self._features(self.panel)

    @cached_property
    def metrics(self) -> DataFrame:
        from barloom.operators import fundamentals as fd
        return fd.derive_metrics(fd.preferred_basis(self.filings))

    @cached_property
    def fpanel(self) -> DataFrame:
        """Features and fundamentals. Fundamentals are attached to the bars first: the as-of join deals and sorts bars by symbol,
        as the features need them, and no wide row of features is sorted once more. Bars are not adjusted here, so their close is the raw one."""
        from barloom.operators import fundamentals as fd
        raw = self.panel.withColumn("close_raw", F.col("close"))
        return self._features(fd.attach_fundamentals(raw, self.metrics).drop("close_raw"))

    @cached_property
    def picks(self) -> DataFrame:
        """Picks of the ten rules on every day; cut, since outcomes, tracking and views read them."""
        from barloom.functions.lineage import cut
        from barloom.operators import screening as sc
        from barloom.plans.screen_queries import workbench_rules
        return cut(sc.scan(self.fpanel, sc.variants_of(list(workbench_rules().values()))))

    @cached_property
    def outcomes(self) -> DataFrame:
        """Gross outcomes of every pick; cut, since trades, marks and equity all read them."""
        from barloom.functions.lineage import cut
        from barloom.operators import outcomes as oc
        bars = self.numbered_market
        entries = oc.next_open_entry(self.picks.select("rule", "symbol", "date", "stop_pct", "target_pct", "hold_days"), bars, "market")
        return cut(oc.first_exit(entries, bars, ["rule", "date"], 0.0))

    @cached_property
    def numbered_market(self) -> DataFrame:
        """Numbered bars; written, as entries, blocks, exits and marks all read them."""
        from barloom.functions.lineage import written
        from barloom.operators import outcomes as oc
        return written(oc.numbered_bars(self.panel, "market"))

    @cached_property
    def numbered_symbol(self) -> DataFrame:
        from barloom.functions.lineage import written
        from barloom.operators import outcomes as oc
        return written(oc.numbered_bars(self.panel, "symbol"))

    @cached_property
    def trades(self) -> DataFrame:
        return self.outcomes.filter("status = 'closed'").withColumn("net_return", F.col("net_return") - 0.0026)

    @cached_property
    def marks(self) -> DataFrame:
        from barloom.operators import outcomes as oc
        o = self.outcomes.withColumnRenamed("date", "signal_date")
        return oc.daily_marks(o, self.numbered_market, ["rule", "signal_date"]).withColumnRenamed("net", "gross")

    @cached_property
    def daily(self) -> DataFrame:
        from barloom.operators import evaluation as ev
        return ev.daily_returns(self.marks, ["rule"], ["symbol", "signal_date"], 0.0026)

    @cached_property
    def equity(self) -> DataFrame:
        from barloom.operators import evaluation as ev
        return ev.equity_from_returns(self.daily, ["rule"], weight=0.01)

    @cached_property
    def windows(self) -> DataFrame:
        from barloom.operators import evaluation as ev
        return ev.walk_windows(self.panel.agg(F.min("date").alias("start"), F.max("date").alias("end")))

    @cached_property
    def eqw(self) -> DataFrame:
        from barloom.functions.lineage import cut
        from barloom.operators import evaluation as ev
        return cut(ev.assign_windows(self.equity, self.windows))

    @cached_property
    def bench(self) -> DataFrame:
        return self.idx.filter("index_code = 'BROAD_500'").select("date", "close")

    @cached_property
    def wmetrics(self) -> DataFrame:
        from barloom.operators import evaluation as ev
        t = ev.assign_windows(self.trades, self.windows, date="entry_date")
        return ev.window_outcome(ev.window_metrics(self.eqw, t, self.bench, ["rule", "label"]))

    @cached_property
    def gated(self) -> DataFrame:
        from barloom.operators import evaluation as ev
        head = F.split("rule", "_")[0]
        hz = F.when(head == "short", "short_term").when(head == "longterm", "long_term").otherwise(head)
        return ev.gate(self.wmetrics.withColumn("horizon", hz))

    @cached_property
    def oos(self) -> DataFrame:
        from barloom.operators import evaluation as ev
        return ev.oos_summary(self.wmetrics.join(F.broadcast(self.windows.select("label", "test_start", "test_end")), "label"), self.trades)
