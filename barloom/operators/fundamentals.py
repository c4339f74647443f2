"""Point-in-time fundamentals: filing facts, trailing sums, ratios, as-of attachment to the panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.joins import asof_join
from barloom.functions.windows import latest_per, safe_div

# Filing contexts and the element (first match wins) behind each item.
CONTEXTS = {"OneD": "quarter", "FourD": "ytd", "OneI": "instant"}
FLOW_TAGS = {
    "revenue": ["RevenueFromOperations"], "total_income": ["Income"], "finance_costs": ["FinanceCosts"],
    "depreciation": ["DepreciationDepletionAndAmortisationExpense"], "pbt": ["ProfitBeforeTax"], "tax_expense": ["TaxExpense"],
    "pat": ["ProfitLossForPeriod"], "pat_owners": ["ProfitOrLossAttributableToOwnersOfParent"],
    "eps": ["BasicEarningsLossPerShareFromContinuingAndDiscontinuedOperations", "BasicEarningsLossPerShareFromContinuingOperations"],
    "paid_up_capital": ["PaidUpValueOfEquityShareCapital"], "face_value": ["FaceValueOfEquityShareCapital"],
}
INSTANT_TAGS = {
    "equity": ["Equity"], "equity_owners": ["EquityAttributableToOwnersOfParent"], "borrowings_noncurrent": ["BorrowingsNoncurrent"],
    "borrowings_current": ["BorrowingsCurrent"], "total_assets": ["Assets"],
}
REQUIRED = ["revenue", "pbt", "pat"]
SCALE_SLIP = 10.0
COLUMNS = ["roce", "de_ratio", "sales_cagr3", "profit_cagr3", "eps_ttm"]


def extract_filing_facts(docs: DataFrame, flow=None, instant=None) -> DataFrame:
    """(filing_id, kind, item, value, tag) from XML text ``xml``, read whole on the JVM. Facts need a
    unit and one of the three plain contexts; a context with a scenario or segment does not count."""
    flow, instant = flow or FLOW_TAGS, instant or INSTANT_TAGS
    rows = [(c, kind, item, tag, i) for c, kind in CONTEXTS.items()
            for item, tags in (instant if kind == "instant" else flow).items() for i, tag in enumerate(tags)]
    lookup = F.create_map(*[x for c, kind, item, tag, i in rows
                            for x in (F.lit(f"{c}|{tag}"), F.struct(F.lit(kind).alias("kind"), F.lit(item).alias("item"), F.lit(i).alias("pos")))])
    xml = F.regexp_replace("xml", r"(?s)<!--.*?-->", "")
    fact = r'<(?:[\w.-]+:)?([\w.-]+)(?=[^>]*\bunitRef=)[^>]*\bcontextRef="(OneD|FourD|OneI)"[^>]*>\s*([^<]*?)\s*</'
    parts = [F.regexp_extract_all("_x", F.lit(fact), F.lit(g)) for g in (1, 2, 3)]

    def plain(ctx: str) -> Column:
        body = F.regexp_extract("_x", rf'(?s)<(?:[\w.-]+:)?context\b[^>]*\bid="{ctx}"[^>]*>(.*?)</(?:[\w.-]+:)?context>', 1)
        return F.when((body != "") & ~body.rlike(r"<(?:[\w.-]+:)?(?:scenario|segment)\b"), F.lit(ctx))
    base = docs.select("filing_id", xml.alias("_x")).select(
        "filing_id", F.array_compact(F.array(*[plain(c) for c in CONTEXTS])).alias("_plain"),
        F.arrays_zip(parts[0].alias("tag"), parts[1].alias("ctx"), parts[2].alias("text")).alias("_f"))
    long = (base.select("filing_id", "_plain", F.posexplode("_f").alias("_at", "f"))
            .filter(F.array_contains("_plain", F.col("f.ctx")))
            .select("filing_id", F.col("f.tag").alias("tag"), lookup[F.concat("f.ctx", F.lit("|"), "f.tag")].alias("m"),
                    F.expr("try_cast(f.text as double)").alias("value"), "_at")
            .filter(F.col("m").isNotNull() & F.col("value").isNotNull()))
    first = F.struct("m.pos", "_at")
    return long.groupBy("filing_id", F.col("m.kind").alias("kind"), F.col("m.item").alias("item")).agg(
        F.min_by("value", first).alias("value"), F.min_by("tag", first).alias("tag"))


def filing_sanity(facts: DataFrame) -> DataFrame:
    """Status per filing from its quarter items: unsupported when none of the required items exist,
    partial when one is missing or earnings per share times shares misses profit by 10x, else parsed."""
    items = REQUIRED + ["eps", "paid_up_capital", "face_value", "pat_owners"]
    wide = facts.groupBy("filing_id").agg(*[
        F.max(F.when((F.col("kind") == "quarter") & (F.col("item") == i), F.col("value"))).alias(i) for i in items])
    missing = sum((F.col(i).isNull().cast("int") for i in REQUIRED), F.lit(0))
    profit = F.coalesce(F.when(F.col("pat_owners") != 0, F.col("pat_owners")), F.col("pat"))
    ratio = safe_div(F.col("eps") * safe_div(F.col("paid_up_capital"), F.col("face_value")), profit)
    slip = F.coalesce((ratio > 0) & ~ratio.between(1 / SCALE_SLIP, SCALE_SLIP), F.lit(False))
    return wide.select("filing_id", missing.alias("n_missing"), slip.alias("scale_slip")).withColumn(
        "status", F.when(F.col("n_missing") == len(REQUIRED), "unsupported").when((F.col("n_missing") > 0) | F.col("scale_slip"), "partial").otherwise("parsed"))


def pending_filings(filings: DataFrame, done: DataFrame, min_period) -> DataFrame:
    """Filings not parsed yet, a standalone one only when the company never files consolidated."""
    both = filings.filter("consolidated").select("symbol").distinct()
    todo = filings.filter(F.col("period_end") >= F.lit(min_period).cast("date")).join(done.select("filing_id"), "filing_id", "left_anti")
    return todo.filter("consolidated").unionByName(todo.filter("NOT consolidated").join(both, "symbol", "left_anti"))


def preferred_basis(filings: DataFrame) -> DataFrame:
    """Consolidated filings of companies that have any, else standalone. A company files a few times
    a year, so its window is small."""
    w = Window.partitionBy("symbol")
    return (filings.withColumn("_any", F.max(F.col("consolidated").cast("int")).over(w))
            .filter(F.col("consolidated").cast("int") == F.col("_any")).drop("_any"))


def available_on(broadcast: Column, period_end: Column, lag_days: int = 60) -> tuple[Column, Column]:
    """(usable from, whether estimated): the day after broadcast, else a fixed lag after period end."""
    return F.coalesce(F.date_add(broadcast, 1), F.date_add(period_end, lag_days)), broadcast.isNull()


def _as_known(filings: DataFrame, value: Column, update, empty: str) -> DataFrame:
    """symbol, available_on, period_end and ``known``, the state after each filing: a fold over a company's filings in the
    order in which they became available, later periods last. ``update(state, filing)`` must keep the state bounded; a
    filing is a struct a, p, v (available on, period end, value). A company files a few times a year, so its filings are one
    short list, and rows stay linear in them. Of filings of one day and period the last state counts."""
    listed = F.sort_array(F.collect_list(F.struct(F.col("available_on").alias("a"), F.col("period_end").alias("p"), value.alias("v"))))
    first = F.struct(F.expr(f"cast(array() as {empty})").alias("known"), F.expr(f"cast(array() as array<struct<a:date,p:date,known:{empty}>>)").alias("out"))

    def step(s, x):
        known = update(s["known"], x)
        return F.struct(known.alias("known"), F.concat(s["out"], F.array(F.struct(x["a"].alias("a"), x["p"].alias("p"), known.alias("known")))).alias("out"))
    out = filings.groupBy("symbol").agg(F.aggregate(listed, first, step, lambda s: s["out"]).alias("out"))
    last = F.filter("out", lambda x, i: ~F.coalesce((F.get("out", i + 1)["a"] == x["a"]) & (F.get("out", i + 1)["p"] == x["p"]), F.lit(False)))
    return out.select("symbol", F.explode(last).alias("x")).select("symbol", F.col("x.a").alias("available_on"), F.col("x.p").alias("period_end"), "x.known")


def ttm(filings: DataFrame, items: list[str]) -> DataFrame:
    """Sum of the four newest quarters as known on each filing's date; NULL unless they follow one
    another (70 to 110 days apart) and all are present. A restatement replaces its period from its
    own date on. The state is the four newest periods: an older one can never come back among them."""
    kind = f"array<struct<p:date,v:struct<{','.join(f'{i}:double' for i in items)}>>>"

    def update(known, x):
        others = F.filter(known, lambda y: y["p"] != x["p"])
        return F.slice(F.sort_array(F.concat(others, F.array(F.struct(x["p"].alias("p"), x["v"].alias("v")))), asc=False), 1, 4).cast(kind)
    q = _as_known(filings, F.struct(*[F.col(i).cast("double").alias(i) for i in items]), update, kind).filter(F.size("known") == 4)
    gaps = [F.datediff(F.col("known")[i]["p"], F.col("known")[i + 1]["p"]).between(70, 110) for i in range(3)]
    total = lambda item: F.when(gaps[0] & gaps[1] & gaps[2], sum((F.col("known")[i]["v"][item] for i in (2, 1, 0)), F.col("known")[3]["v"][item]))
    return q.select("symbol", "available_on", "period_end", *[total(i).alias(f"{i}_ttm") for i in items])


def balance_ratios(filings: DataFrame, sums: DataFrame) -> DataFrame:
    """roce and de_ratio from trailing profit and the newest known balance sheet."""
    w = Window.partitionBy("symbol").orderBy("available_on", "period_end").rowsBetween(Window.unboundedPreceding, 0)
    bal = F.last(F.when(F.col("i_equity").isNotNull(), F.struct("i_equity", "i_borrow_nc", "i_borrow_c")), ignorenulls=True).over(w)
    b = filings.select("symbol", "available_on", "period_end", bal.alias("b"))
    nc, c = F.col("b.i_borrow_nc"), F.col("b.i_borrow_c")
    debt = F.when(nc.isNotNull() | c.isNotNull(), F.coalesce(nc, F.lit(0.0)) + F.coalesce(c, F.lit(0.0)))
    j = b.join(sums, ["symbol", "available_on", "period_end"], "left").withColumn("debt", debt).withColumn("eq", F.col("b.i_equity"))
    capital = F.col("eq") + F.col("debt")
    return j.select("symbol", "available_on", "period_end",
                    F.when(capital > 0, (F.col("q_pbt_ttm") + F.col("q_finance_ttm")) / capital).alias("roce"),
                    F.when(F.col("eq") > 0, F.col("debt") / F.col("eq")).alias("de_ratio"))


def growth3(filings: DataFrame) -> DataFrame:
    """Three-year growth of full-year sales and profit: newest known annual filing against the first
    one three years (give or take 20 days) earlier; NULL off a base or end that is not positive. The state is the annual
    periods up to three years and 20 days before the newest, each as first and as last filed."""
    value = "struct<y_revenue:double,y_pat:double>"
    kind = f"array<struct<p:date,first:{value},last:{value}>>"

    def update(known, x):
        before = F.filter(known, lambda y: y["p"] == x["p"])
        first = F.when(F.size(before) > 0, F.get(before, 0)["first"]).otherwise(x["v"])
        entry = F.array(F.struct(x["p"].alias("p"), first.alias("first"), x["v"].alias("last")))
        all_ = F.sort_array(F.concat(F.filter(known, lambda y: y["p"] != x["p"]), entry.cast(kind)), asc=False)
        kept = F.filter(all_, lambda y: F.datediff(F.greatest(x["p"], F.coalesce(F.get(known, 0)["p"], x["p"])), y["p"]) <= 1115)
        return F.when(x["v"].isNotNull(), kept).otherwise(known)
    annual = F.when(F.col("is_annual"), F.struct(F.col("y_revenue").cast("double").alias("y_revenue"), F.col("y_pat").cast("double").alias("y_pat")))
    n = F.get("known", 0)
    far = F.filter("known", lambda y: F.abs(F.datediff(n["p"], y["p"]) - 1095) <= 20)
    known = _as_known(filings, annual, update, kind).withColumn("n", n["last"]).withColumn("b", F.element_at(F.when(F.size(far) > 0, far), -1)["first"]).filter("b IS NOT NULL")

    def cagr(c):
        s, e = F.col(f"b.{c}"), F.col(f"n.{c}")
        return F.when((s > 0) & (e > 0), F.pow(e / s, F.lit(1.0 / 3)) - 1)
    return known.select("symbol", "available_on", "period_end", cagr("y_revenue").alias("sales_cagr3"), cagr("y_pat").alias("profit_cagr3"))


def derive_metrics(filings: DataFrame) -> DataFrame:
    """One row per filing with every ratio as known on its date (one basis per company)."""
    key = ["symbol", "available_on", "period_end"]
    sums = ttm(filings, ["q_pbt", "q_finance", "q_eps"])
    return (balance_ratios(filings, sums).join(growth3(filings), key, "left")
            .join(sums.select(*key, F.col("q_eps_ttm").alias("eps_ttm")), key, "left").select(*key, *COLUMNS))


def attach_fundamentals(panel: DataFrame, metrics: DataFrame) -> DataFrame:
    """Metrics as known on each bar's date, plus pe_ttm (positive earnings only) and fund_age_days."""
    m = metrics.withColumn("fund_date", F.col("available_on"))
    hit = asof_join(panel, m, ["symbol"], "date", "fund_date", COLUMNS, tiebreak=["period_end"])
    return (hit.withColumn("fund_age_days", F.datediff("date", "fund_date_asof"))
            .withColumn("pe_ttm", F.when(F.col("eps_ttm") > 0, F.col("close_raw") / F.col("eps_ttm"))).drop("fund_date_asof"))


def latest_fundamentals(metrics: DataFrame) -> DataFrame:
    return latest_per(metrics, ["symbol"], [F.col("available_on").desc(), F.col("period_end").desc()])
