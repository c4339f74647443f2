"""Corporate actions: subject text to typed actions, factors, factor timeline, back-adjustment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.joins import asof_join
from barloom.functions.lineage import written
from barloom.functions.windows import in_list_order, latest_per

# How exchanges spell the words that decide a clause.
DIVIDEND_WORDS = ["dividend", "divdend", "div"]
CURRENCY_WORDS = ["rs", "re"]
# Words that may stand between a keyword and its amount.
FILLERS = {"dividend": ["of", *CURRENCY_WORDS], "distribution": ["of", *CURRENCY_WORDS], "premium": ["of", *CURRENCY_WORDS], "from": CURRENCY_WORDS, "to": CURRENCY_WORDS}
PERMANENT = ["demerger", "capital_reduction"]
CASH_LIKE = ["dividend", "distribution", "interest", "buyback", "agm"]
MIN_RIGHTS_FACTOR = 0.2


def _number(text: Column) -> Column:
    return F.regexp_replace(text, ",", "").try_cast("double")


def _clause(text: Column, pos: Column) -> Column:
    """One clause as words and figures in their order, with the words alone as a phrase to search in."""
    tokens = F.regexp_extract_all(text, F.lit(r"([a-z]+|[0-9][0-9,]*(?:\.[0-9]+)?|:)"))
    return F.struct(pos.alias("i"), tokens.alias("t"), F.concat(F.lit(" "), F.array_join(F.filter(tokens, lambda t: t.rlike("^[a-z]")), " "), F.lit(" ")).alias("w"))


def _amount_after(c: Column, is_key, fillers: list[str]) -> Column:
    """The figure that follows a keyword, at most two fillers between; of several keywords the first with a figure."""
    def at(i):
        t = [F.get(c["t"], i + k) for k in (1, 2, 3)]
        skip = [x.isin(fillers) for x in t]
        return F.when(t[0].rlike("^[0-9]"), t[0]).when(skip[0] & t[1].rlike("^[0-9]"), t[1]).when(skip[0] & skip[1] & t[2].rlike("^[0-9]"), t[2])
    found = F.filter(F.transform(c["t"], lambda t, i: F.when(is_key(t), at(i))), lambda x: x.isNotNull())
    return _number(F.get(found, 0))


def _ratio(c: Column) -> Column:
    """The figures on both sides of the first colon, whole numbers only."""
    pairs = F.filter(F.transform(c["t"], lambda t, i: F.when(t == ":", F.struct(F.get(c["t"], i - 1).alias("num"), F.get(c["t"], i + 1).alias("den")))),
                     lambda p: p["num"].rlike("^[0-9]+$") & p["den"].rlike("^[0-9]+$"))
    return F.get(pairs, 0)


def _clause_fields(c: Column) -> Column:
    """Type, kind and figures of a clause, by the words it has.

    kind: cash = amount, note = recognised without figures, vague = recognised but figures missing, bonus / face /
    rights = figures that lead to a factor. The order of the tests is given: the first that holds decides."""
    w = c["w"]
    phrase = lambda *p: reduce(lambda x, y: x | y, [w.contains(f" {x} ") for x in p])
    starts = lambda *p: reduce(lambda x, y: x | y, [w.startswith(f" {x} ") for x in p])
    word = lambda k: F.split(F.trim(w), " ")[k]
    unit_payout = lambda t: t.startswith("distr") & t.endswith("ion")
    paid = _amount_after(c, unit_payout, FILLERS["distribution"])
    dividend = _amount_after(c, lambda t: t.isin(DIVIDEND_WORDS) | t.endswith("dividend"), FILLERS["dividend"])
    old, new = (_amount_after(c, lambda t, k=k: t == k, FILLERS[k]) for k in ("from", "to"))
    ratio = _ratio(c)
    shares = phrase("consolidation of shares", "consolidation of equity shares")
    preference = phrase("bonus") & (phrase("ncrps", "n c r p s") | (phrase("preference") & phrase("convertible", "nonconvertible") & (phrase("non") | phrase("nonconvertible"))))
    opening = unit_payout(word(0)) | word(0).isin("interest", "nterest") | starts("return on capital", "return of capital")
    second = F.coalesce(unit_payout(F.get(F.split(F.trim(w), " "), 1)) | F.get(F.split(F.trim(w), " "), 1).isin("interest", "nterest"), F.lit(False))
    tests = [
        (paid.isNotNull(), "distribution", "cash"), (starts("interest payment", "redemption"), "interest", "note"), (dividend.isNotNull(), "dividend", "cash"),
        (opening | second | w.rlike("^ [a-z]+ return o[nf] capital "), "distribution", "vague"),
        (starts(*[f"{p}{d}" for p in ("", "interim ", "final ", "special ") for d in DIVIDEND_WORDS]), "dividend", "vague"),
        (phrase("bonus") & ~preference & ratio.isNotNull(), "bonus", "bonus"), (preference, "bonus", "note"), (starts("bonus"), "bonus", "vague"),
        (phrase("capital reduction"), "capital_reduction", "vague"), (phrase("face value split") & old.isNotNull() & new.isNotNull(), "split", "face"),
        (shares & old.isNotNull() & new.isNotNull(), "consolidation", "face"), (phrase("rights") & ratio.isNotNull(), "rights", "rights"), (starts("rights"), "rights", "vague"),
        (shares, "consolidation", "note"), (phrase("buyback", "buy back"), "buyback", "note"), (w.contains("demerger") | phrase("scheme of arrangement", "scheme of arangement"), "demerger", "note"),
        (w.contains(" general me") | phrase("agm", "egm"), "agm", "note")]
    kind = reduce(lambda acc, t: F.when(F.coalesce(t[0], F.lit(False)), F.struct(F.lit(t[1]).alias("t"), F.lit(t[2]).alias("k"))).otherwise(acc), reversed(tests),
                  F.lit(None).cast("struct<t:string,k:string>"))
    k = kind["k"]
    pair = k.isin("bonus", "rights")
    return F.struct(c["i"].alias("clause"), kind["t"].alias("action_type"), k.alias("kind"), F.when(k == "cash", F.when(kind["t"] == "distribution", paid).otherwise(dividend)).alias("amount"),
                    F.when(pair, ratio["num"].cast("int")).alias("num"), F.when(pair, ratio["den"].cast("int")).alias("den"),
                    F.when(k == "face", old).alias("fv_from"), F.when(k == "face", new).alias("fv_to"),
                    F.when(k == "rights", _amount_after(c, lambda t: t == "premium", FILLERS["premium"])).alias("premium"))


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed once a row: Spark doesn't fold projections through a generator."""
    return df.withColumn(name, F.explode(F.array(value)))


def parsed_clauses(subjects: DataFrame) -> DataFrame:
    """One row per recognised clause of each distinct subject, with the status of the whole subject: parsed, ambiguous
    (something in it was not understood) or unparsed, which has no row. Clauses are flat rows; a subject's few are put
    together again by aggregates."""
    texts = F.filter(F.transform(F.split(F.lower(F.trim("subject")), r"\s+and\s+|\s*&\s*"), lambda c: F.trim(c)), lambda c: c != "")
    rows = subjects.select("subject").distinct().select("subject", F.posexplode(texts).alias("_i", "_text"))
    rows = _once(_once(rows, "_c", _clause(F.col("_text"), F.col("_i") + 1)), "_f", _clause_fields(F.col("_c"))).select("subject", "_f.*")
    face = F.col("kind") == "face"
    unclear = (F.col("kind").isNull() | (F.col("kind") == "vague") | ((F.col("kind") == "rights") & F.col("premium").isNull())
               | (face & ((F.col("fv_from") <= 0) | (F.col("fv_to") <= 0))))
    status = rows.groupBy("subject").agg(F.when(F.max(F.coalesce(unclear, F.lit(False))), "ambiguous").otherwise("parsed").alias("parse_status"))
    bonus = (F.col("kind") == "bonus") & (F.col("num") > 0) & (F.col("den") > 0)
    face &= (F.col("fv_from") > 0) & (F.col("fv_to") > 0)
    return (rows.filter("kind IS NOT NULL").join(status, "subject")
            .withColumn("price_factor", F.when(bonus, F.col("den") / (F.col("num") + F.col("den"))).when(face, F.col("fv_to") / F.col("fv_from")))
            .withColumn("volume_factor", F.when(bonus, (F.col("num") + F.col("den")) / F.col("den")).when(face, F.col("fv_from") / F.col("fv_to")))
            .select("subject", "clause", "action_type", "amount", "num", "den", "fv_from", "fv_to", "premium", "price_factor", "volume_factor", "parse_status"))


def parse_subjects(actions: DataFrame) -> DataFrame:
    """One row per recognised clause (one NULL-typed row when nothing is recognised), with status parsed / ambiguous /
    unparsed for the whole subject. Exchanges print a few thousand subjects over and over: each is parsed once, written, and
    met by the actions."""
    clauses = written(parsed_clauses(actions))
    out = actions.join(clauses, "subject", "left").withColumn("clause", F.coalesce("clause", F.lit(1))).withColumn("parse_status", F.coalesce("parse_status", F.lit("unparsed")))
    return out.select(*[c for c in actions.columns if c != "subject"], *[c for c in clauses.columns if c != "subject"])


def cum_price(actions: DataFrame, bars: DataFrame, precedence: list[str], keys=("action_id",)) -> DataFrame:
    """Adds the last close strictly before the ex-date (preferred series when a day has several).

    A symbol has a few such actions, so meeting its earlier bars by equality on the symbol and keeping
    the newest in a hash aggregate is cheaper than sorting every bar for an as-of join."""
    want = actions.select(*keys, "exchange", "symbol", "ex_date")
    b = bars.filter(F.col("series").isin(precedence)).select(
        "exchange", "symbol", "date", "close", (F.unix_date("date") * 10 - in_list_order("series", precedence)).alias("_at"))
    hit = (b.join(want, ["exchange", "symbol"]).filter(F.col("date") < F.col("ex_date"))
           .groupBy(*keys).agg(F.max_by("close", "_at").alias("cum_price")))
    return actions.join(hit, list(keys), "left")


def face_value_asof(actions: DataFrame, parsed: DataFrame, securities: DataFrame) -> DataFrame:
    """Adds the face value in force at the ex-date: the "from" value of the earliest later face-value
    change of the same exchange whose subject was understood, else today's."""
    changes = (parsed.filter(F.col("action_type").isin("split", "consolidation") & (F.col("fv_from") > 0) & (F.col("parse_status") == "parsed"))
               .groupBy("exchange", "symbol", F.col("ex_date").alias("change_date"))
               .agg(F.min_by("fv_from", F.struct("action_id", "clause")).alias("_fv")))
    hit = asof_join(actions, changes, ["exchange", "symbol"], "ex_date", "change_date", ["_fv"], direction="forward", strict=True)
    now = securities.select(F.col("canonical_symbol").alias("symbol"), F.col("face_value").alias("_now"))
    return (hit.join(now, "symbol", "left").withColumn("face_value", F.coalesce("_fv", "_now"))
            .drop("_fv", "_now", "change_date_asof"))


def rights_factor(num: Column, den: Column, issue: Column, cum: Column) -> Column:
    """Theoretical ex-rights price over the cum-rights close; 1 when the issue is not below the
    market; NULL when the result is too small to trust."""
    f = (den * cum + num * issue) / (den + num) / cum
    ok = (num > 0) & (den > 0) & (cum > 0) & (issue >= 0)
    return F.when(ok & (issue >= cum), 1.0).when(ok & (f >= MIN_RIGHTS_FACTOR), f)


def apply_rights(parsed: DataFrame, bars: DataFrame, securities: DataFrame, precedence: list[str]) -> DataFrame:
    """Fills the factor of every rights issue that states its premium."""
    todo = (F.col("action_type") == "rights") & F.col("premium").isNotNull()
    rights = parsed.filter(todo).select("action_id", "clause", "exchange", "symbol", "ex_date", "num", "den", "premium")
    priced = face_value_asof(cum_price(rights, bars, precedence, ("action_id", "clause")), parsed, securities)
    f = priced.select("action_id", "clause", rights_factor(
        F.col("num"), F.col("den"), F.col("premium") + F.col("face_value"), F.col("cum_price")).alias("_rf"))
    return (parsed.join(f, ["action_id", "clause"], "left")
            .withColumn("price_factor", F.coalesce("price_factor", "_rf"))
            .withColumn("volume_factor", F.coalesce("volume_factor", F.lit(1.0) / F.col("_rf"))).drop("_rf")
            .select(*parsed.columns))


def resolve_action_identity(actions: DataFrame, history: DataFrame, listings: DataFrame) -> DataFrame:
    """Security of each action: the stored id, else the only security that ever owned the symbol;
    otherwise the symbol itself is the key."""
    owners = (history.select("symbol", "security_id").unionByName(listings.select("symbol", "security_id"))
              .groupBy("symbol").agg(F.min("security_id").alias("_lo"), F.max("security_id").alias("_hi")))
    sole = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo"))
    return (actions.join(owners, "symbol", "left").withColumn("resolved_id", F.coalesce("security_id", sole))
            .withColumn("identity_key", F.coalesce(F.col("resolved_id").cast("string"), F.col("symbol")))
            .drop("_lo", "_hi"))


def dedupe_actions(factored: DataFrame) -> DataFrame:
    """One row per economic event (type, ratio and factor of a security on an ex-date), the newest capture wins. Only
    subjects that were understood as a whole feed it. With ``identity_key`` (see resolve_action_identity) a feed repeated
    under a new symbol is the same event."""
    usable = factored.filter(F.col("price_factor").isNotNull() & (F.col("parse_status") == "parsed"))
    who = F.col("identity_key") if "identity_key" in factored.columns else F.col("symbol")
    keyed = usable.withColumn("_f", F.round("price_factor", 12)).withColumn("_w", who)
    return latest_per(keyed, ["exchange", "_w", "ex_date", "action_type", "num", "den", "_f"],
                      [F.col("captured_on").desc(), F.col("action_id").desc()]).drop("_f", "_w")


def excluded_actions(factored: DataFrame) -> DataFrame:
    """Actions that adjust nothing, by reason: no factor, or one in a subject not understood as a whole. A closeable hole
    marks the run degraded."""
    reason = (F.when(F.col("action_type").isin(PERMANENT), "permanent")
              .when(F.col("action_type").isin(CASH_LIKE), "cash_like")
              .when((F.col("action_type") == "bonus") & (F.col("parse_status") == "parsed"), "cash_like")
              .otherwise("closeable_hole"))
    return (factored.filter(F.col("price_factor").isNull() | (F.col("parse_status") != "parsed")).withColumn("reason", reason)
            .groupBy("reason", "action_type").agg(F.count("*").alias("n_actions"))
            .withColumn("degraded", F.col("reason") == "closeable_hole"))


def factor_timeline(actions: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Same-day factors multiplied, then accumulated from the newest ex-date back. With ``aliases``
    (symbol, alias) every step is repeated for each alias symbol."""
    day = (actions.groupBy("exchange", "symbol", F.col("ex_date").alias("effective_date"))
           .agg(F.product("price_factor").alias("price_factor"), F.product("volume_factor").alias("volume_factor")))
    w = (Window.partitionBy("exchange", "symbol").orderBy(F.col("effective_date").desc())
         .rowsBetween(Window.unboundedPreceding, 0))
    out = (day.withColumn("cumulative_price_factor", F.product("price_factor").over(w))
           .withColumn("cumulative_volume_factor", F.product("volume_factor").over(w)))
    if aliases is None:
        return out
    named = out.join(aliases, "symbol", "left")
    return (named.withColumn("symbol", F.explode(F.array_distinct(F.array("symbol", F.coalesce("alias", "symbol")))))
            .drop("alias").distinct())


PRICES = ["open", "high", "low", "close", "prev_close", "last", "vwap", "settle_price"]
QUANTITIES = ["volume", "delivery_qty"]


def adjust_bars(bars: DataFrame, timeline: DataFrame) -> DataFrame:
    """Scale each bar by the cumulative factor of the first effective date after it; the bar of the
    ex-date itself and turnover stay as they are. Quantities round half to even."""
    cols = ["cumulative_price_factor", "cumulative_volume_factor"]
    hit = asof_join(bars, timeline.select("exchange", "symbol", "effective_date", *cols), ["exchange", "symbol"],
                    "date", "effective_date", cols, direction="forward", strict=True).drop("effective_date_asof")
    for c in cols:
        hit = hit.withColumn(c, F.coalesce(c, F.lit(1.0)))
    for c in PRICES:
        if c in bars.columns:
            hit = hit.withColumn(c, F.col(c) * F.col(cols[0]))
    for c in QUANTITIES:
        if c in bars.columns:
            hit = hit.withColumn(c, F.bround(F.col(c) * F.col(cols[1]), 0).cast("long"))
    return hit


def reparse(stored: DataFrame, actions: DataFrame, version: int) -> DataFrame:
    """Status transitions when stored rows (action_id, parse_status) are parsed again, with the
    number of ex-dates touched."""
    fresh = (parse_subjects(actions).groupBy("action_id", "ex_date")
             .agg(F.max("parse_status").alias("new_status")))
    return (stored.select("action_id", F.col("parse_status").alias("old_status")).join(fresh, "action_id")
            .groupBy("old_status", "new_status")
            .agg(F.count("*").alias("n_actions"), F.countDistinct("ex_date").alias("n_ex_dates"))
            .withColumn("parser_version", F.lit(version)))


def identify_bars(bars: DataFrame, history: DataFrame, listings: DataFrame) -> DataFrame:
    """Adds ``identity_key``: the security that owned the symbol on the bar's day (half-open validity), else the only one
    that ever listed it, else the symbol. Symbols are first turned into owners per day range, so no bar is multiplied."""
    old = history.select("exchange", "symbol", F.col("valid_from").alias("date"), "security_id", "valid_to").dropDuplicates(["exchange", "symbol", "date"])
    old = old.withColumnRenamed("security_id", "_then").withColumnRenamed("valid_to", "_to")
    hit = asof_join(bars, old, ["exchange", "symbol"], "date", "date", ["_then", "_to"]).drop("date_asof")
    hit = hit.withColumn("_then", F.when(F.col("_to").isNull() | (F.col("date") < F.col("_to")), F.col("_then"))).drop("_to")
    now = listings.groupBy("exchange", "symbol").agg(F.min("security_id").alias("_lo"), F.max("security_id").alias("_hi"))
    now = now.select("exchange", "symbol", F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).alias("_now"))
    return hit.join(now, ["exchange", "symbol"], "left").withColumn("identity_key", F.coalesce(F.coalesce("_then", "_now").cast("string"), "symbol")).drop("_then", "_now")


def rebuild_adjusted(bars: DataFrame, actions: DataFrame, securities: DataFrame, precedence: list[str], history: DataFrame | None = None, listings: DataFrame | None = None) -> DataFrame:
    """Subjects -> factors -> timeline -> adjusted bars, as one plan. With symbol history and listings everything is keyed
    on the security: an action announced under one symbol reaches bars printed under any other that the security used."""
    parsed = parse_subjects(actions)
    if history is None or listings is None:
        return adjust_bars(bars, factor_timeline(dedupe_actions(apply_rights(parsed, bars, securities, precedence))))
    if "security_id" not in parsed.columns:
        parsed = parsed.withColumn("security_id", F.lit(None).cast("long"))
    keyed = resolve_action_identity(parsed, history, listings).withColumn("symbol", F.col("identity_key"))
    named = identify_bars(bars, history, listings).withColumn("_printed", F.col("symbol")).withColumn("symbol", F.col("identity_key"))
    owners = securities.withColumn("canonical_symbol", F.col("security_id").cast("string"))
    out = adjust_bars(named, factor_timeline(dedupe_actions(apply_rights(keyed, named, owners, precedence))))
    return out.withColumn("symbol", F.col("_printed")).drop("_printed", "identity_key")
