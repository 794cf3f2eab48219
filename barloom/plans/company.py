"""Queries: company statements, facts, monitoring, ratios, scores and sector ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fundamentals as fu
from ..operators import joins, merge
from ..sources import storage, views
from .common import near, query, rounded, shown
from .views import sql

S = ("statements", "filed")
SK = ["ticker_id", "end_date", "fiscal_period"]


def parsed(spark, folder):
    return fu.parse_payloads(views.statement_payloads(spark, folder))


@query("x1_parse_payloads", sql("""
SELECT ticker_id, ticker, 'income' AS kind, end_date, filing_date, fiscal_period, fiscal_year, revenues AS a, net_income_loss AS b FROM filed
UNION ALL SELECT ticker_id, ticker, 'balance', end_date, filing_date, fiscal_period, fiscal_year, assets, equity FROM filed
UNION ALL SELECT ticker_id, ticker, 'cash', end_date, filing_date, fiscal_period, fiscal_year, operating_cash_flow, net_cash_flow FROM filed""", *S))
def x1(spark, folder):
    names = {"income": ("revenues", "net_income_loss"), "balance": ("assets", "equity"), "cash": ("net_cash_flow_from_operating_activities", "net_cash_flow")}
    pick = lambda i: F.coalesce(*[F.when(F.col("kind") == k, F.col("items")[v[i]]) for k, v in names.items()])
    return parsed(spark, folder).select("ticker_id", "ticker", "kind", "end_date", "filing_date", "fiscal_period", "fiscal_year", pick(0).alias("a"), pick(1).alias("b"))


FACTS = """SELECT ticker_id, end_date AS date, filing_date, fiscal_period, fiscal_year, 'quarterly' AS timeframe, revenues, cost_of_revenue, gross_profit,
  operating_expenses, net_income_loss, assets, current_assets, liabilities, current_liabilities, equity,
  operating_cash_flow AS net_cash_flow_from_operating_activities, net_cash_flow FROM filed"""
FACT_COLUMNS = ["ticker_id", "date", "filing_date", "fiscal_period", "fiscal_year", "timeframe", "revenues", "cost_of_revenue", "gross_profit", "operating_expenses",
                "net_income_loss", "assets", "current_assets", "liabilities", "current_liabilities", "equity", "net_cash_flow_from_operating_activities", "net_cash_flow"]


def facts(spark, folder):
    return fu.facts(parsed(spark, folder)).select(*FACT_COLUMNS)


@query("x2_facts", sql("SELECT * FROM facts", *S, facts=FACTS))
def x2(spark, folder):
    return facts(spark, folder)


VALUES = FACT_COLUMNS[6:]
META = FACT_COLUMNS[2:6]
BOTH = {
    "facts": FACTS, "old": "SELECT * FROM facts WHERE ticker_id % 4 <> 0",
    "new": "SELECT * REPLACE (CASE WHEN ticker_id % 3 = 0 THEN NULL ELSE revenues * 2 END AS revenues, filing_date + 30 AS filing_date, CASE WHEN ticker_id % 2 = 0 THEN NULL ELSE timeframe END AS timeframe) FROM facts WHERE ticker_id % 4 <> 1",
}


def old_and_new(spark, folder):
    f = facts(spark, folder)
    new = f.where(F.col("ticker_id") % 4 != 1).withColumns({
        "revenues": F.when(F.col("ticker_id") % 3 != 0, F.col("revenues") * 2), "filing_date": F.date_add("filing_date", 30),
        "timeframe": F.when(F.col("ticker_id") % 2 != 0, F.col("timeframe"))})
    return f.where(F.col("ticker_id") % 4 != 0), new


MERGED = f"""SELECT ticker_id, date, {', '.join(f"CASE WHEN n.filing_date IS NOT NULL THEN n.{c} ELSE o.{c} END AS {c}" for c in META)},
  {', '.join(f"coalesce(n.{c}, o.{c}) AS {c}" for c in VALUES)} FROM old o FULL JOIN new n USING (ticker_id, date)"""


@query("x3_coalescing_upsert", sql(MERGED, *S, **BOTH))
def x3(spark, folder):
    return merge.upsert_facts(*old_and_new(spark, folder))


query("w4_upsert_facts", sql(MERGED.replace("FULL JOIN new n", "FULL JOIN (SELECT * FROM new WHERE ticker_id % 5 <> 0) n"), *S, **BOTH))(
    lambda spark, folder: (lambda o, n: merge.upsert_facts(o, n.where(F.col("ticker_id") % 5 != 0)))(*old_and_new(spark, folder)))


@query("w9_overwrite_facts", sql("SELECT * FROM new UNION ALL SELECT * FROM old ANTI JOIN new USING (ticker_id, date)", *S, **BOTH))
def w9(spark, folder):
    return merge.replace_rows(*old_and_new(spark, folder), ["ticker_id", "date"])


RAWP = "SELECT ticker_id, end_date AS period_end, filing_date, TIMESTAMP '2000-01-01' AS ingested_at FROM filed"
STORED = """SELECT ticker_id, date, CASE WHEN ticker_id % 5 = 0 THEN filing_date - 1 WHEN ticker_id % 7 = 0 THEN NULL ELSE filing_date END AS filing_date,
  CASE WHEN ticker_id % 3 = 0 THEN TIMESTAMP '1999-12-01' WHEN ticker_id % 11 = 0 THEN NULL ELSE TIMESTAMP '2000-02-01' END AS updated_at FROM facts WHERE ticker_id % 4 <> 0"""
PENDING = """SELECT r.ticker_id, r.period_end, r.filing_date FROM rawp r LEFT JOIN stored f ON f.ticker_id = r.ticker_id AND f.date = r.period_end
WHERE f.ticker_id IS NULL OR f.updated_at IS NULL OR f.updated_at < r.ingested_at OR (r.filing_date IS NOT NULL AND (f.filing_date IS NULL OR f.filing_date < r.filing_date))"""


def raw_and_stored(spark, folder):
    raw = views.statement_payloads(spark, folder).select(
        "ticker_id", "ticker", F.col("end_date").alias("period_end"), "filing_date", "payload", F.lit("2000-01-01").cast("timestamp").alias("ingested_at"))
    t = F.col("ticker_id")
    stored = fu.facts(parsed(spark, folder)).where(t % 4 != 0).withColumns({
        "filing_date": F.when(t % 5 == 0, F.date_sub("filing_date", 1)).when(t % 7 != 0, F.col("filing_date")),
        "updated_at": F.when(t % 3 == 0, F.lit("1999-12-01").cast("timestamp")).when(t % 11 == 0, None).otherwise(F.lit("2000-02-01").cast("timestamp")),
        "revenues": F.col("revenues") + 1})
    return raw, stored


@query("j6_pending_payloads", sql(PENDING, *S, facts=FACTS, rawp=RAWP, stored=STORED))
def j6(spark, folder):
    return joins.pending(*raw_and_stored(spark, folder)).select("ticker_id", "period_end", "filing_date")


@query("x4_extract_pending", sql("""SELECT f.ticker_id, f.date, CASE WHEN p.ticker_id IS NULL OR f.revenues IS NULL THEN f.revenues + 1 ELSE f.revenues END AS revenues,
  f.assets FROM facts f LEFT JOIN pend p ON p.ticker_id = f.ticker_id AND p.period_end = f.date""", *S, facts=FACTS, rawp=RAWP, stored=STORED, pend=PENDING))
def x4(spark, folder):
    return fu.extract_pending(*raw_and_stored(spark, folder)).select("ticker_id", "date", "revenues", "assets")


@query("x5_dedupe_payloads", sql("SELECT ticker_id, count(*) AS payloads, max(filing_date) + 1 AS newest FROM filed GROUP BY 1", *S))
def x5(spark, folder):
    """The same payloads once more with their keys in another order and a later filing date."""
    raw = views.statement_payloads(spark, folder)
    again = raw.withColumns({
        "payload": F.regexp_replace("payload", r'^\{"status":"OK",(.*)\}$', r'{$1,"status":"OK"}'), "filing_date": F.date_add("filing_date", 1)})
    out = fu.dedupe_payloads(raw.unionByName(again), ["filing_date", "payload"])
    return out.groupBy("ticker_id").agg(F.count(F.lit(1)).alias("payloads"), F.max("filing_date").alias("newest"))


INC_MISS = "income_statement.earnings_per_share_basic;income_statement.weighted_average_shares_outstanding;income_statement.operating_income_loss"
CHECKED = f"""SELECT ticker_id, end_date, fiscal_period, 'income' AS kind, '' AS errors, concat_ws(';', CASE WHEN revenues < 0 THEN 'negative_revenues' END,
    CASE WHEN abs(gross_profit - (revenues - cost_of_revenue)) > abs((revenues - cost_of_revenue) * 0.01) THEN 'gross_profit_inconsistent' END) AS warnings,
    concat_ws(';', CASE WHEN revenues IS NULL THEN 'income_statement.revenues' END, '{INC_MISS}') AS missing_fields, CASE WHEN abs(revenues) > 1e12 THEN 'revenues_too_high' ELSE '' END AS outliers FROM filed
UNION ALL SELECT ticker_id, end_date, fiscal_period, 'balance', concat_ws(';', CASE WHEN abs(assets - (liabilities + equity)) > abs(assets * 0.01) THEN 'balance_off' END, CASE WHEN assets < 0 THEN 'negative_assets' END),
    '', '', CASE WHEN current_liabilities > 0 AND NOT (current_assets / current_liabilities BETWEEN 0.1 AND 10) THEN 'unusual_current_ratio' ELSE '' END FROM filed
UNION ALL SELECT ticker_id, end_date, fiscal_period, 'cash', '', CASE WHEN abs(net_cash_flow - (operating_cash_flow + investing_cash_flow + financing_cash_flow))
    > abs((operating_cash_flow + investing_cash_flow + financing_cash_flow) * 0.05) THEN 'cash_flow_sum_off' ELSE '' END, '', '' FROM filed"""
ISSUES = ("errors", "warnings", "missing_fields", "outliers")


@query("x6_statement_validation", sql("SELECT * FROM ck", *S, ck=CHECKED))
def x6(spark, folder):
    v = fu.validate_statements(parsed(spark, folder))
    return v.select(*SK, "kind", *[F.array_join(c, ";").alias(c) for c in ISSUES])


def distinct_issues(c):
    return f"(SELECT count(DISTINCT x) FROM (SELECT ticker_id, unnest(string_split({c}, ';')) AS x FROM ck) y WHERE y.ticker_id = t.ticker_id AND x <> '')"


@query("x7_penalty_score", sql(f"""SELECT ticker_id, CAST(greatest(0, least(100, 100 - 20 * e - 5 * w - 3 * m - 2 * o)) AS DOUBLE) AS quality_score, CAST(e = 0 AS INTEGER) AS is_valid FROM (
  SELECT ticker_id, {distinct_issues('errors')} AS e, {distinct_issues('warnings')} AS w, {distinct_issues('missing_fields')} AS m, {distinct_issues('outliers')} AS o
  FROM (SELECT DISTINCT ticker_id FROM ck) t)""", *S, ck=CHECKED))
def x7(spark, folder):
    return fu.validation_report(parsed(spark, folder)).select("ticker_id", "quality_score", "is_valid")


LAST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker_id ORDER BY filing_date DESC, end_date DESC) AS rn FROM filed) WHERE rn = 1"


@query("x8_cross_checks", sql("""SELECT ticker_id, concat_ws(';', CASE WHEN abs(assets - (liabilities + equity)) > 0.02 * CASE WHEN assets = 0 THEN 1 ELSE abs(assets) END THEN 'balance_off_2pct' END,
  CASE WHEN abs(net_cash_flow - t) > 0.05 * CASE WHEN t = 0 THEN 1 ELSE abs(t) END THEN 'cash_flow_off_5pct' END) AS cross_warnings
FROM (SELECT *, operating_cash_flow + investing_cash_flow + financing_cash_flow AS t FROM newest)""", *S, newest=LAST))
def x8(spark, folder):
    return fu.cross_checks(parsed(spark, folder)).select("ticker_id", F.array_join("cross_warnings", ";").alias("cross_warnings"))


@query("x9_latest_statements", sql("SELECT ticker_id, end_date, filing_date, assets, equity FROM newest", *S, newest=LAST))
def x9(spark, folder):
    return fu.latest(parsed(spark, folder), "balance").select("ticker_id", "end_date", "filing_date", "assets", "equity")


@query("x9_statements_by_period", sql("""SELECT ticker_id, k AS kind, min(end_date) AS end_date FROM filed, (VALUES ('income'), ('balance'), ('cash')) t(k)
WHERE fiscal_period = 'Q3' GROUP BY 1, 2""", *S))
def x9b(spark, folder):
    return fu.by_period(parsed(spark, folder), "Q3").select("ticker_id", "kind", "end_date")


PREV = "lag(revenues, 4) OVER (PARTITION BY ticker_id ORDER BY end_date)"


@query("x10_growth_arithmetic", sql(f"""SELECT ticker_id, end_date, {near('net_income_loss / nullif(revenues, 0)', 7)} AS margin,
  {near('(revenues - pr) / abs(nullif(pr, 0))', 6)} AS growth, {near('CASE WHEN pr > 0 AND revenues >= 0 THEN pow(revenues / pr, 0.5::DOUBLE) - 1 END', 6)} AS cagr
FROM (SELECT *, {PREV} AS pr FROM filed)""", *S))
def x10(spark, folder):
    from pyspark.sql import Window

    f = views.filed(spark, folder)
    pr = F.lag("revenues", 4).over(Window.partitionBy("ticker_id").orderBy("end_date"))
    f = f.withColumn("pr", pr)
    now, before = F.col("revenues"), F.col("pr")
    return f.select("ticker_id", "end_date", rounded(fu.safe_divide("net_income_loss", "revenues"), 7).alias("margin"),
                    rounded(fu.growth(now, before), 6).alias("growth"), rounded(fu.cagr(now, before, 2), 6).alias("cagr"))


# Every line item's payload names get a figure of their own: the n-th name is n times the statement's revenues.
ITEM_NAMES = list(dict.fromkeys(name for names in fu.ALTERNATIVES.values() for name in names))
FIRST_NAME = {item: ITEM_NAMES.index(names[0]) + 1 for item, names in fu.ALTERNATIVES.items()}


@query("x11_line_item_names", sql(f"""SELECT ticker_id, end_date, {', '.join(
    f"{near(f'CASE WHEN ticker_id % 2 = 0 THEN {k} * revenues' + (f' ELSE {ITEM_NAMES.index(fu.ALTERNATIVES[i][1]) + 1} * revenues' if len(fu.ALTERNATIVES[i]) > 1 else '') + ' END', 4)} AS {i}"
    for i, k in FIRST_NAME.items())} FROM filed""", *S))
def x11(spark, folder):
    """First names are absent for odd tickers, so that the alternatives stand in."""
    f = views.filed(spark, folder).select("ticker_id", "end_date", F.col("revenues").alias("_r"))
    first = {ITEM_NAMES[k - 1] for k in FIRST_NAME.values()}
    f = f.select("ticker_id", "end_date", *[
        F.when(F.lit(name not in first) | (F.col("ticker_id") % 2 == 0), F.col("_r") * (k + 1)).alias(name) for k, name in enumerate(ITEM_NAMES)])
    return shown(f.select("ticker_id", "end_date", *[fu.line_item(f, i).alias(i) for i in FIRST_NAME]), ["ticker_id", "end_date"], dict.fromkeys(FIRST_NAME, 4))


FLAT = """SELECT ticker_id, end_date, fiscal_period, fiscal_year, filing_date, revenues, net_income_loss, assets, equity, operating_cash_flow AS net_cash_flow_from_operating_activities,
  (11 - CASE WHEN revenues IS NULL THEN 1 ELSE 0 END) / 12.0::DOUBLE AS data_quality_score, 1 + CASE WHEN revenues IS NULL THEN 1 ELSE 0 END AS missing_data_count FROM filed"""
FLAT_KEYS = ["ticker_id", "end_date", "fiscal_period", "fiscal_year", "filing_date", "revenues", "net_income_loss", "assets", "equity", "net_cash_flow_from_operating_activities", "missing_data_count"]


def flat(spark, folder):
    return fu.flat_records(parsed(spark, folder))


@query("x12_flat_records", sql(f"SELECT {', '.join(FLAT_KEYS)}, {near('data_quality_score', 6)} AS data_quality_score FROM flat", *S, flat=FLAT))
def x12(spark, folder):
    return shown(flat(spark, folder), FLAT_KEYS, {"data_quality_score": 6})


@query("j7_match_statements", sql("SELECT ticker_id, end_date, revenues, assets FROM filed", *S))
def j7(spark, folder):
    p = parsed(spark, folder)
    keys = ["ticker", "end_date", "fiscal_period", "fiscal_year"]
    right = fu.wide(p, "balance").select(*keys, "position", "assets")
    twice = right.unionByName(right.withColumns({"position": F.col("position") + 10, "assets": F.lit(0.0)}))
    return joins.match_statements(fu.wide(p, "income").select("ticker_id", *keys, "revenues"), twice, ["position"]).select("ticker_id", "end_date", "revenues", "assets")


@query("a9_source_confidence", sql(f"""SELECT ticker_id, end_date, {near('(c1 + c2) / 2', 6)} AS confidence FROM (SELECT ticker_id, end_date,
  CASE ticker_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 WHEN 2 THEN 0.6 ELSE 0.5 END::DOUBLE AS c1,
  CASE (ticker_id + 1) % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 WHEN 2 THEN 0.6 ELSE 0.5 END::DOUBLE AS c2 FROM filed)""", *S))
def a9(spark, folder):
    def source(k):
        return F.when(k % 4 == 0, "direct_report").when(k % 4 == 1, "intra_report_impute").when(k % 4 == 2, "inter_report_derive").otherwise("elsewhere")

    t = F.col("ticker_id")
    p = fu.wide(parsed(spark, folder), "income").select("ticker_id", "ticker", "end_date", "filing_date", "fiscal_period", "fiscal_year", "timeframe", "position",
        F.lit("income").alias("kind"), F.create_map(F.lit("revenues"), F.lit(1.0)).alias("items"),
        F.create_map(F.lit("revenues"), source(t), F.lit("gross_profit"), source(t + 1)).alias("sources"))
    return shown(fu.flat_records(p).withColumnRenamed("data_source_confidence", "confidence"), ["ticker_id", "end_date"], {"confidence": 6})


@query("a8_completeness", sql(f"""SELECT ticker_id, {near('(11 * count(*) - 3 * count(*) - count(*) FILTER (revenues IS NULL)) / (11.0::DOUBLE * count(*))', 3)} AS data_quality_score,
  3 * count(*) + count(*) FILTER (revenues IS NULL) AS missing_data_count, 11 * count(*) AS total_fields_count FROM filed GROUP BY 1""", *S))
def a8(spark, folder):
    return shown(fu.completeness(parsed(spark, folder)), ["ticker_id", "missing_data_count", "total_fields_count"], {"data_quality_score": 3})


NOW = "1999-01-15"


def records(spark, folder):
    return flat(spark, folder).withColumnRenamed("end_date", "date")


@query("a5_collection_progress", sql(f"""SELECT (SELECT count(*) FROM tickers WHERE active AND id % 3 <> 0) AS total_tickers, count(*) AS tickers_with_data,
  count(*) FILTER (newest >= DATE '{NOW}' - 30) AS recent_data_count, {near('count(*) / (SELECT count(*) FROM tickers WHERE active AND id % 3 <> 0)', 6)} AS overall_progress
FROM (SELECT ticker_id, max(end_date) AS newest FROM filed GROUP BY 1)""", *S, "tickers"))
def a5(spark, folder):
    t = views.tickers(spark, folder).withColumn("has_financials", F.col("id") % 3 != 0)
    out = fu.collection_progress(records(spark, folder), t, NOW)
    return shown(out, ["total_tickers", "tickers_with_data", "recent_data_count"], {"overall_progress": 6})


@query("a6_quality_summary", sql(f"""SELECT {near('avg(data_quality_score)', 6)} AS average_quality_score, {near('count(revenues) / count(*)', 6)} AS revenues, 1.0::DOUBLE AS net_income,
  1.0::DOUBLE AS assets, 1.0::DOUBLE AS cash_flow FROM flat""", *S, flat=FLAT))
def a6(spark, folder):
    return shown(fu.quality_summary(records(spark, folder)), ["net_income", "assets", "cash_flow"], {"average_quality_score": 6, "revenues": 6})


@query("a6_missing_histogram", sql("SELECT missing_data_count, count(*) AS ticker_count FROM flat GROUP BY 1", *S, flat=FLAT))
def a6b(spark, folder):
    return fu.missing_histogram(records(spark, folder))


@query("a7_recent_activity", sql(f"SELECT ticker_id, end_date AS date, filing_date, missing_data_count FROM flat WHERE end_date >= DATE '{NOW}' - 7 ORDER BY end_date DESC, ticker_id LIMIT 50", *S, flat=FLAT))
def a7(spark, folder):
    return fu.recent_activity(records(spark, folder), NOW).select("ticker_id", "date", "filing_date", "missing_data_count")


query("x13_has_financials", sql("SELECT id, ticker, CAST(id IN (SELECT ticker_id FROM filed WHERE end_date > DATE '2000-06-01') AS INTEGER) AS has_financials FROM tickers", *S, "tickers"))(
    lambda spark, folder: merge.set_flag(views.tickers(spark, folder), facts(spark, folder).where(F.col("date") > "2000-06-01").join(
        views.tickers(spark, folder).select(F.col("id").alias("ticker_id"), "ticker"), "ticker_id"), "has_financials").select("id", "ticker", F.col("has_financials").cast("int").alias("has_financials")))


@query("j11_with_recent_facts", sql("SELECT id, ticker FROM tickers WHERE id IN (SELECT ticker_id FROM filed WHERE end_date >= DATE '2000-12-01' - 180)", *S, "tickers"))
def j11(spark, folder):
    t = views.tickers(spark, folder).select(F.col("id").alias("ticker_id"), "ticker")
    return joins.with_recent(t, facts(spark, folder), "2000-12-01").select(F.col("ticker_id").alias("id"), "ticker")


@query("j12_not_present", sql("SELECT ticker_id, date, assets FROM facts WHERE ticker_id % 4 = 0", *S, facts=FACTS))
def j12(spark, folder):
    f = facts(spark, folder)
    return joins.not_present(f, f.where(F.col("ticker_id") % 4 != 0), ["ticker_id", "date"]).select("ticker_id", "date", "assets")


@query("j13_latest_of_each", sql("""SELECT ticker, f.end_date AS facts_date, f.assets AS facts_assets, b.date AS bars_date, b.close AS bars_close FROM
  (SELECT ticker, end_date, assets FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY end_date DESC) AS rn FROM filed) WHERE rn = 1) f
  LEFT JOIN (SELECT ticker, date, close FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn FROM bars) WHERE rn = 1) b USING (ticker)""", *S, "bars"))
def j13(spark, folder):
    f = views.filed(spark, folder).select("ticker", F.col("end_date").alias("date"), "assets")
    return joins.latest_of_each({"facts": f, "bars": views.bars(spark, folder).select("ticker", "date", "close")})


@query("s25_newest_payloads", sql("SELECT ticker, max(filing_date) AS file_date FROM filed WHERE filing_date BETWEEN DATE '1999-05-10' AND DATE '1999-05-17' GROUP BY 1", *S))
def s25(spark, folder):
    p = views.statement_payloads(spark, folder)
    files = p.select(F.concat(F.lit("/cache/"), "ticker", F.lit("_financials_"), F.date_format("filing_date", "yyyyMMdd"), F.lit(".json")).alias("path"), "payload")
    return storage.newest_payloads(files, "1999-05-17").select("ticker", "file_date")


# Ratios and scores: figures the payloads lack are derived from those present.
RICH = """SELECT f.ticker_id, f.ticker, f.end_date AS date, f.fiscal_period, f.fiscal_year, revenues, cost_of_revenue, gross_profit, gross_profit - operating_expenses AS operating_income_loss, net_income_loss, assets,
  current_assets, liabilities, current_liabilities, equity, liabilities * 0.4::DOUBLE AS long_term_debt, equity * 0.3::DOUBLE AS retained_earnings,
  floor(assets / 1000) AS basic_average_shares, operating_cash_flow AS net_cash_flow_from_operating_activities, t.market_cap / 1e6 AS market_cap, t.sic_code
FROM statements f JOIN tickers t ON t.id = f.ticker_id"""
R = ("statements", "tickers")


def rich(spark, folder):
    t = views.tickers(spark, folder).select(F.col("id").alias("ticker_id"), (F.col("market_cap") / 1e6).alias("market_cap"), "sic_code")
    f = views.statements(spark, folder).withColumnsRenamed({"end_date": "date", "operating_cash_flow": "net_cash_flow_from_operating_activities"})
    return f.join(t, "ticker_id").withColumns({
        "operating_income_loss": F.col("gross_profit") - F.col("operating_expenses"), "long_term_debt": F.col("liabilities") * 0.4,
        "retained_earnings": F.col("equity") * 0.3, "basic_average_shares": F.floor(F.col("assets") / 1000)})


def cap(n, e):
    lo, hi = fu.CAPS[n]
    return f"CASE WHEN ({e}) IS NOT NULL THEN least(greatest({e}, {lo}), {hi}) END"


RATIO_SQL = {
    "pe_ratio": "market_cap / nullif(net_income_loss, 0)", "pb_ratio": "market_cap / nullif(equity, 0)", "ps_ratio": "market_cap / nullif(revenues, 0)",
    "roe": "net_income_loss / nullif(equity, 0)", "roa": "net_income_loss / nullif(assets, 0)", "roi": "net_income_loss / nullif(equity + long_term_debt, 0)",
    "gross_margin": "gross_profit / nullif(revenues, 0)", "operating_margin": "operating_income_loss / nullif(revenues, 0)", "net_margin": "net_income_loss / nullif(revenues, 0)",
    "current_ratio": "current_assets / nullif(current_liabilities, 0)", "debt_to_equity": "liabilities / nullif(equity, 0)", "debt_to_assets": "liabilities / nullif(assets, 0)",
    "financial_leverage": "assets / nullif(equity, 0)",
}
RATIOS = {n: cap(n, e) if n in fu.CAPS else e for n, e in RATIO_SQL.items()}


@query("x14_ratios", sql("SELECT ticker_id, date, " + ", ".join(f"{near(e, 5)} AS {n}" for n, e in RATIOS.items()) + " FROM rich", *R, rich=RICH))
def x14(spark, folder):
    return shown(fu.ratios(rich(spark, folder)), ["ticker_id", "date"], {n: 5 for n in RATIOS})


def back(c, y):
    return f"(SELECT any_value({c}) FROM rich p WHERE p.ticker_id = r.ticker_id AND p.fiscal_period = r.fiscal_period AND CAST(p.fiscal_year AS INTEGER) = CAST(r.fiscal_year AS INTEGER) - {y})"


GROWN = {"revenue": "revenues", "earnings": "net_income_loss", "book_value": "equity", "asset": "assets"}
GROWTH_CTE = "SELECT r.*, " + ", ".join(f"{back(c, y)} AS {n}_{y}" for n, c in GROWN.items() for y in (1, 3)) + " FROM rich r"
GROWTH = {f"{n}_growth_1y": f"({c} - {n}_1) / abs(nullif({n}_1, 0))" for n, c in GROWN.items()} | {
    f"{n}_growth_3y": f"CASE WHEN {n}_3 > 0 AND {c} >= 0 THEN pow({c} / {n}_3, {1 / 3!r}) - 1 END" for n, c in GROWN.items()} | {
    "asset_turnover": "revenues / nullif(assets, 0)", "working_capital_turnover": "revenues / nullif(current_assets - current_liabilities, 0)"}


@query("x15_growth", sql("SELECT ticker_id, date, " + ", ".join(f"{near(e, 5)} AS {n}" for n, e in GROWTH.items()) + " FROM gr", *R, rich=RICH, gr=GROWTH_CTE))
def x15(spark, folder):
    return shown(fu.growth_rates(rich(spark, folder)), ["ticker_id", "date"], {n: 5 for n in GROWTH})


PIO_BASE = """SELECT *, net_income_loss / nullif(assets, 0) AS roa, net_cash_flow_from_operating_activities / nullif(assets, 0) AS cfo, long_term_debt / nullif(assets, 0) AS debt,
  current_assets / nullif(current_liabilities, 0) AS cr, gross_profit / nullif(revenues, 0) AS gm, revenues / nullif(assets, 0) AS tn FROM rich"""
PIO = {
    "piotroski_roa_positive": "n.roa > 0", "piotroski_cfo_positive": "n.cfo > 0", "piotroski_roa_improved": "n.roa > p.roa", "piotroski_cfo_vs_roa": "n.cfo > n.roa",
    "piotroski_debt_decreased": "n.debt < p.debt", "piotroski_current_ratio_improved": "n.cr > p.cr", "piotroski_shares_outstanding": "n.basic_average_shares <= p.basic_average_shares",
    "piotroski_gross_margin_improved": "n.gm > p.gm", "piotroski_asset_turnover_improved": "n.tn > p.tn",
}
PIO_SUM = " + ".join(f"CAST(coalesce({c}, false) AS INTEGER)" for c in PIO.values())


@query("x16_piotroski", sql("SELECT n.ticker_id, n.date, " + ", ".join(f"CAST(coalesce({c}, false) AS INTEGER) AS {k}" for k, c in PIO.items()) + f""", {PIO_SUM} AS piotroski_f_score
FROM pb n LEFT JOIN pb p ON p.ticker_id = n.ticker_id AND p.fiscal_period = n.fiscal_period AND CAST(p.fiscal_year AS INTEGER) = CAST(n.fiscal_year AS INTEGER) - 1""", *R, rich=RICH, pb=PIO_BASE))
def x16(spark, folder):
    return fu.piotroski(rich(spark, folder)).select("ticker_id", "date", *PIO, "piotroski_f_score")


@query("x16_altman", sql(f"""SELECT ticker_id, date, {near('''1.2 * (current_assets - current_liabilities) / nullif(assets, 0) + 1.4 * retained_earnings / nullif(assets, 0)
  + 3.3 * operating_income_loss / nullif(assets, 0) + 0.6 * market_cap / nullif(liabilities, 0) + revenues / nullif(assets, 0)''', 5)} AS altman_z_score FROM rich""", *R, rich=RICH))
def x16b(spark, folder):
    return shown(fu.altman(rich(spark, folder)), ["ticker_id", "date"], {"altman_z_score": 5})


SECTOR = """CASE WHEN sic_code BETWEEN 100 AND 999 THEN 'Energy' WHEN sic_code BETWEEN 1000 AND 1499 THEN 'Materials'
  WHEN sic_code BETWEEN 1500 AND 1799 OR sic_code BETWEEN 2000 AND 3999 THEN 'Industrials' WHEN sic_code BETWEEN 4000 AND 4999 THEN 'Utilities'
  WHEN sic_code BETWEEN 5000 AND 5199 THEN 'Consumer Staples' WHEN sic_code BETWEEN 5200 AND 5999 THEN 'Consumer Discretionary'
  WHEN sic_code BETWEEN 6000 AND 6799 THEN 'Financials' WHEN sic_code BETWEEN 7000 AND 8999 THEN 'Technology' ELSE 'Industrials' END"""


@query("x17_sectors", sql(f"SELECT id, sic_code, {SECTOR} AS gics_sector FROM tickers", "tickers"))
def x17(spark, folder):
    return views.tickers(spark, folder).select("id", "sic_code", fu.sector(F.col("sic_code")).alias("gics_sector"))


METRICS = ("roe", "roa", "pe_ratio", "pb_ratio", "ps_ratio", "debt_to_equity")
PEERS = f"SELECT ticker_id, ticker, date, {SECTOR} AS gics_sector, sic_code // 100 AS industry, {', '.join(f'{RATIOS[m]} AS {m}' for m in METRICS)} FROM rich"


def peers(spark, folder):
    return fu.ratios(rich(spark, folder)).select(
        "ticker_id", "ticker", "date", fu.sector(F.col("sic_code")).alias("gics_sector"), fu.industry(F.col("sic_code")).alias("industry"), *METRICS)


def ranks_sql(part, prefix, m="roe", least=5):
    w = f"PARTITION BY {part}"
    n = f"count({m}) OVER ({w})"
    ok = f"{n} >= {least} AND {m} IS NOT NULL"
    return f"""SELECT ticker_id, date, {near(f'CASE WHEN {ok} THEN 100.0::DOUBLE * (rank() OVER ({w} ORDER BY {m} NULLS LAST) - 1) / nullif({n} - 1, 0) END', 5)} AS {m}_{prefix}_percentile,
  CASE WHEN {ok} THEN rank() OVER ({w} ORDER BY {m} DESC NULLS LAST) END AS {m}_{prefix}_rank, {n} AS {prefix}_total_{m},
  {near(f'CASE WHEN {n} >= {least} THEN quantile_cont({m}, 0.5) OVER ({w}) END', 6)} AS {prefix}_median_{m},
  {near(f'CASE WHEN {ok} THEN {m} / nullif(quantile_cont({m}, 0.5) OVER ({w}), 0) END', 5)} AS {m}_relative_to_{prefix} FROM peers WHERE {m} IS NOT NULL"""


def ranks(keys, prefix, m="roe", least=5):
    def run(spark, folder):
        out = fu.group_ranks(peers(spark, folder).where(F.col(m).isNotNull()), keys, m, prefix, least)
        return shown(out, ["ticker_id", "date", f"{m}_{prefix}_rank", f"{prefix}_total_{m}"],
                     {f"{m}_{prefix}_percentile": 5, f"{prefix}_median_{m}": 6, f"{m}_relative_to_{prefix}": 5})

    return run


query("x18_sector_ranks", sql(ranks_sql("date, gics_sector", "sector"), *R, rich=RICH, peers=PEERS))(ranks(["date", "gics_sector"], "sector"))
query("x18_market_ranks", sql(ranks_sql("date", "market"), *R, rich=RICH, peers=PEERS))(ranks(["date"], "market"))
for _m in METRICS[1:]:
    query(f"x18_sector_ranks_{_m}", sql(ranks_sql("date, gics_sector", "sector", _m), *R, rich=RICH, peers=PEERS))(ranks(["date", "gics_sector"], "sector", _m))
for _m in METRICS:
    # Industries are small in the test tables, so groups of any size are ranked.
    query(f"x18_industry_ranks_{_m}", sql(ranks_sql("date, industry", "industry", _m, 1), *R, rich=RICH, peers=PEERS))(ranks(["date", "industry"], "industry", _m, 1))


@query("x19_companies_in_sector", sql("SELECT ticker_id, ticker FROM peers WHERE gics_sector = 'Industrials' AND date = DATE '1998-06-30'", *R, rich=RICH, peers=PEERS))
def x19(spark, folder):
    return fu.companies_in(peers(spark, folder), "Industrials", "1998-06-30").select("ticker_id", "ticker")


@query("x20_active_common_stock", sql("SELECT id, ticker FROM tickers WHERE active AND type = 'CS' ORDER BY ticker", "tickers"))
def x20(spark, folder):
    return fu.active_common_stock(views.tickers(spark, folder)).select("id", "ticker")


