"""Market-shaped views over the star-schema test tables.

The same rules exist as SQL in ``plans.views`` for the comparison engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def symbol(number: Column) -> Column:
    """'T' and the number, zero-padded to at least six digits (never cut)."""
    digits = number.cast("string")
    pad = F.greatest(F.lit(0), F.lit(6) - F.length(digits))
    return F.concat(F.lit("T"), F.repeat(F.lit("0"), pad), digits)


def bars(spark: SparkSession, folder: str) -> DataFrame:
    """Weekly bars, one row per (ticker, week).

    Pure grouped aggregation with map-side combine, so one supplier holding a large
    share of the rows reaches the reducers as one partial row per task and week.
    """
    price = F.col("l_extendedprice") / F.col("l_quantity")
    rows = table(spark, folder, "lineitem").select(
        (F.col("l_suppkey") + 1).alias("ticker_id"),
        F.date_trunc("week", "l_shipdate").cast("date").alias("date"),
        price.alias("p"),
        F.struct("l_orderkey", "l_linenumber", "l_shipdate", price.alias("p")).alias("at"),
        "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    )
    return (
        rows.groupBy("ticker_id", "date")
        .agg(
            F.min_by("p", "at").alias("open"),
            F.max(F.col("p") * (1 + F.col("l_tax"))).alias("high"),
            F.min(F.col("p") * (1 - F.col("l_discount"))).alias("low"),
            F.max_by("p", "at").alias("close"),
            F.sum("l_quantity").cast("long").alias("volume"),
            F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("turnover"),
        )
        .select(
            "ticker_id", symbol(F.col("ticker_id")).alias("ticker"), "date",
            "open", "high", "low", "close", "volume",
            F.col("close").alias("adjusted_close"),
            (F.col("turnover").cast("double") / F.col("volume")).alias("vwap"),
        )
    )


def tickers(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("s_suppkey") + 1
    return table(spark, folder, "supplier").select(
        n.alias("id"),
        symbol(n).alias("ticker"),
        F.col("s_name").alias("name"),
        F.when(F.col("s_suppkey") % 10 == 0, "ETF").otherwise("CS").alias("type"),
        (F.col("s_acctbal") > 0).alias("active"),
        (F.col("s_acctbal") * 1e8).alias("market_cap"),
        (F.col("s_acctbal") * 5e3).alias("avg_volume"),
        (F.lit(100) + (F.col("s_suppkey") * 89) % 8900).alias("sic_code"),
        F.lit("stocks").alias("market"),
    )


def supplier_count(spark: SparkSession, folder: str) -> Column:
    return table(spark, folder, "supplier").agg(F.count(F.lit(1))).scalar()


def dividends(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_custkey") % supplier_count(spark, folder) + 1).alias("ticker_id"),
        F.col("o_orderdate").cast("date").alias("ex_dividend_date"),
        (F.col("o_totalprice") / 1e5).alias("cash_amount"),
    )


def statements(spark: SparkSession, folder: str) -> DataFrame:
    """Quarterly company figures, one row per (ticker_id, quarter)."""
    price = F.col("o_totalprice").cast("decimal(18,2)")
    status, rank = F.col("o_orderstatus"), F.substring("o_orderpriority", 1, 1)

    def total(cond, name):
        return F.coalesce(F.sum(F.when(cond, price)), F.lit(0)).cast("double").alias(name)

    quarter = F.date_trunc("quarter", "o_orderdate").cast("date")
    grouped = (
        table(spark, folder, "orders")
        .select(
            (F.col("o_custkey") % supplier_count(spark, folder) + 1).alias("ticker_id"),
            quarter.alias("q"), "o_totalprice", "o_orderstatus", "o_orderpriority",
        )
        .groupBy("ticker_id", "q")
        .agg(
            total(F.lit(True), "revenues"),
            total(rank.isin("1", "2"), "cost_of_revenue"),
            total(rank == "3", "operating_expenses"),
            total(rank == "5", "net_income_loss"),
            total(status == "F", "liabilities"),
            total(status == "O", "current_liabilities"),
            total(status == "P", "pending"),
        )
    )
    end = F.date_sub(F.add_months("q", 3), 1)
    return grouped.select(
        "ticker_id", symbol(F.col("ticker_id")).alias("ticker"),
        end.alias("end_date"), F.date_add(end, 45).alias("filing_date"),
        F.concat(F.lit("Q"), F.quarter("q").cast("string")).alias("fiscal_period"),
        F.year("q").cast("string").alias("fiscal_year"),
        "revenues", "cost_of_revenue", "operating_expenses", "net_income_loss",
        (F.col("revenues") - F.col("cost_of_revenue")).alias("gross_profit"),
        (F.col("revenues") * 2).alias("assets"),
        F.col("revenues").alias("current_assets"),
        "liabilities", "current_liabilities",
        (F.col("revenues") * 2 - F.col("liabilities")).alias("equity"),
        F.col("current_liabilities").alias("operating_cash_flow"),
        (-F.col("liabilities") / 2).alias("investing_cash_flow"),
        (-F.col("pending")).alias("financing_cash_flow"),
        (F.col("current_liabilities") - F.col("liabilities") / 2 - F.col("pending")).alias("net_cash_flow"),
    )


def filed(spark: SparkSession, folder: str) -> DataFrame:
    """Statements as filed: some figures are missing or do not add up."""
    t = F.col("ticker_id")
    return statements(spark, folder).withColumns({
        "revenues": F.when((t % 9 == 0) & (F.col("fiscal_period") == "Q2"), None).when(t % 11 == 0, -F.col("revenues")).otherwise(F.col("revenues")),
        "gross_profit": F.when(t % 7 == 0, F.col("gross_profit") * 1.05 + 1).otherwise(F.col("gross_profit")),
        "equity": F.when(t % 5 == 0, F.col("equity") * 0.9 - 1).otherwise(F.col("equity")),
        "net_cash_flow": F.when(t % 6 == 0, F.col("net_cash_flow") * 1.2 + 1).otherwise(F.col("net_cash_flow")),
    })


INCOME = ["revenues", "cost_of_revenue", "gross_profit", "operating_expenses", "net_income_loss"]
BALANCE = ["assets", "current_assets", "liabilities", "current_liabilities", "equity"]
CASH = ["operating_cash_flow", "investing_cash_flow", "financing_cash_flow", "net_cash_flow"]


def statement_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Statements in the vendor's nested JSON form: one payload per ticker and quarter."""
    cash_key = {
        "operating_cash_flow": "net_cash_flow_from_operating_activities",
        "investing_cash_flow": "net_cash_flow_from_investing_activities",
        "financing_cash_flow": "net_cash_flow_from_financing_activities",
        "net_cash_flow": "net_cash_flow",
    }

    def items(names, key=lambda c: c):
        return F.map_from_arrays(
            F.array(*[F.lit(key(c)) for c in names]),
            F.array(*[F.struct(F.col(c).alias("value"), F.lit("USD").alias("unit")) for c in names]),
        )

    result = F.struct(
        F.date_format("end_date", "yyyy-MM-dd").alias("end_date"),
        F.date_format("filing_date", "yyyy-MM-dd").alias("filing_date"),
        F.lit("quarterly").alias("timeframe"), "fiscal_period", "fiscal_year",
        F.struct(
            items(INCOME).alias("income_statement"),
            items(BALANCE).alias("balance_sheet"),
            items(CASH, cash_key.get).alias("cash_flow_statement"),
        ).alias("financials"),
    )
    return filed(spark, folder).select(
        "ticker_id", "ticker", "end_date", "filing_date",
        F.to_json(F.struct(F.lit("OK").alias("status"), F.array(result).alias("results"))).alias("payload"),
    )


def articles(spark: SparkSession, folder: str) -> DataFrame:
    n = supplier_count(spark, folder)
    return table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("id"),
        # Documents have no titles; the body stays whole.
        F.substring("text", 1, 200).alias("title"),
        F.col("text").alias("description"),
        F.concat(F.lit("https://news.example.com/"), F.col("doc_id").cast("string")).alias("article_url"),
        F.col("source").alias("author"),
        F.date_format(
            F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp")) + F.col("doc_id") * 3600),
            "yyyy-MM-dd'T'HH:mm:ss'Z'",
        ).alias("published_utc"),
        F.array("lang").alias("keywords"),
        F.array_distinct(
            F.array(symbol(F.col("doc_id") % n + 1), symbol(F.col("doc_id") * 7 % n + 1))
        ).alias("tickers"),
        F.struct(F.col("source").alias("name"), F.concat(F.lit("https://"), "source").alias("homepage_url")).alias("publisher"),
        "doc_id",
    )


def insights(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "labels").select(
        F.col("doc_id").cast("string").alias("article_id"),
        F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive")
        .otherwise("neutral").alias("sentiment"),
    )


def scored(spark: SparkSession, folder: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, folder, "events").select(
        e.alias("id"),
        (((e * 31) % 200 - 80) / 1000.0).alias("y_pred"),
        (((e * 57) % 240 - 100) / 1000.0).alias("y_true"),
        F.col("value").alias("current_price"),
        ((e * 7919 % 10007) / 10006.0).alias("confidence"),
        F.col("ts").cast("date").alias("date"),
        F.col("user_id").alias("ticker_id"),
    )
