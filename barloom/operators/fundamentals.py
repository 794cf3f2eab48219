"""Company statements: parsing, facts, validation, ratios, growth, scores, sector ranks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import value_ranks
from . import merge
from .joins import match_statements, pending
from .validate import issues

# Line items read per statement kind, and the keys that mark a flat statement.
LINE_ITEMS = {
    "income": (
        "revenues", "cost_of_revenue", "gross_profit", "operating_expenses",
        "selling_general_and_administrative_expenses", "research_and_development", "operating_income_loss",
        "interest_expense", "interest_income", "other_income_expense",
        "income_loss_before_income_tax_expense_benefit", "income_tax_expense_benefit", "net_income_loss",
        "net_income_loss_attributable_to_parent", "earnings_per_share_basic", "earnings_per_share_diluted",
        "weighted_average_shares_outstanding", "weighted_average_shares_outstanding_diluted",
    ),
    "balance": (
        "assets", "current_assets", "noncurrent_assets", "inventory_net", "property_plant_equipment_net",
        "liabilities", "current_liabilities", "noncurrent_liabilities", "accounts_payable_current",
        "equity", "equity_attributable_to_parent", "long_term_debt",
    ),
    "cash": (
        "net_cash_flow_from_operating_activities", "net_cash_flow_from_investing_activities",
        "net_cash_flow_from_financing_activities", "net_cash_flow",
    ),
}
NESTED_NAME = {"income": "income_statement", "balance": "balance_sheet", "cash": "cash_flow_statement"}
LIST_NAME = {"income": "income_statements", "balance": "balance_sheets", "cash": "cash_flow_statements"}
FLAT_MARKS = {
    "income": ("revenues", "net_income_loss"), "balance": ("assets", "equity"),
    "cash": ("net_cash_flow_from_operating_activities", "net_cash_flow"),
}
META = (
    "start_date", "end_date", "filing_date", "timeframe", "fiscal_period", "fiscal_year", "cik", "company_name",
    "source_filing_url", "source_filing_file_url",
)
# Names of line items in the fact table where they differ from the payload.
FACT_NAMES = {
    "earnings_per_share_basic": "basic_earnings_per_share", "earnings_per_share_diluted": "diluted_earnings_per_share",
    "weighted_average_shares_outstanding": "basic_average_shares",
    "weighted_average_shares_outstanding_diluted": "diluted_average_shares",
    "other_income_expense": "nonoperating_income_loss",
    "income_loss_before_income_tax_expense_benefit": "income_loss_from_continuing_operations_before_tax",
    "inventory_net": "inventory", "property_plant_equipment_net": "fixed_assets",
    "accounts_payable_current": "accounts_payable",
}
# Alternative payload names per line item, first present wins.
ALTERNATIVES = {
    "operating_income": ("operating_income_loss",),
    "interest_expense": ("interest_expense", "interest_expense_operating"),
    "income_before_tax": ("income_loss_from_continuing_operations_before_tax",),
    "income_tax_expense": ("income_tax_expense_benefit",),
    "net_income": ("net_income_loss", "net_income_loss_attributable_to_parent"),
    "weighted_average_shares": ("basic_average_shares",),
    "weighted_average_shares_diluted": ("diluted_average_shares",),
    "selling_general_administrative": ("selling_general_and_administrative_expenses",),
    "property_plant_equipment": ("fixed_assets",),
    "equity": ("equity", "equity_attributable_to_parent"),
    "other_assets_current": ("other_current_assets",),
    "other_assets_noncurrent": ("other_noncurrent_assets",),
    "other_liabilities_current": ("other_current_liabilities",),
    "other_liabilities_noncurrent": ("other_noncurrent_liabilities",),
    "operating_cash_flow": ("net_cash_flow_from_operating_activities",),
    "investing_cash_flow": ("net_cash_flow_from_investing_activities",),
    "financing_cash_flow": ("net_cash_flow_from_financing_activities",),
    "capital_expenditures": ("payments_to_acquire_property_plant_and_equipment",),
    "depreciation_amortization": ("depreciation_depletion_and_amortization",),
}
PAYLOAD = "status string, request_id string, results array<map<string,string>>, " + ", ".join(
    f"{n} array<map<string,string>>" for n in LIST_NAME.values()
)


def number(text: Column) -> Column:
    """A line item is a number or an object with a value."""
    return F.coalesce(text.try_cast("double"), F.get_json_object(text, "$.value").try_cast("double"))


def _by_kind(kind: Column, values: dict) -> Column:
    out = F.lit(None)
    for k, v in values.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def parse_payloads(raw: DataFrame) -> DataFrame:
    """(ticker_id, ticker, payload) to one row per statement: kind, meta, items, sources.

    Handles nested statements, flat keys on the result, and separate statement lists. Each
    payload and each financials object is parsed once; the rest works on maps of its text.
    """
    p = raw.select("ticker_id", "ticker", F.from_json("payload", PAYLOAD).alias("p"))
    empty = F.array().cast("array<map<string,string>>")

    def tagged(name, kind):
        return F.transform(F.coalesce(F.col("p")[name], empty), lambda r: F.struct(F.lit(kind).alias("kind"), r.alias("flat")))

    entries = F.concat(tagged("results", "any"), *[tagged(n, k) for k, n in LIST_NAME.items()])
    rows = p.select("ticker_id", "ticker", F.posexplode(entries).alias("position", "e")).select(
        "ticker_id", "ticker", "position", F.col("e.kind").alias("form"), F.col("e.flat").alias("flat"),
        F.from_json(F.when(F.col("e.kind") == "any", F.col("e.flat")["financials"]), "map<string,map<string,string>>").alias("fin"),
    )
    kinds = F.when(F.col("form") == "any", F.array(*map(F.lit, LINE_ITEMS))).otherwise(F.array("form"))
    by_kind = rows.withColumn("kind", F.explode(kinds))
    kind = F.col("kind")
    flat_keys = _by_kind(kind, {k: F.array(*map(F.lit, names)) for k, names in LINE_ITEMS.items()})
    marks = _by_kind(kind, {k: F.array(*map(F.lit, names)) for k, names in FLAT_MARKS.items()})
    nested = F.col("fin")[_by_kind(kind, {k: F.lit(n) for k, n in NESTED_NAME.items()})]
    s = by_kind.withColumns({
        "nested": F.coalesce(nested, F.create_map().cast("map<string,string>")),
        "flat_items": F.map_filter("flat", lambda k, _: F.array_contains(flat_keys, k)),
    }).where(
        (F.col("form") != "any") | (F.size("nested") > 0) | F.arrays_overlap(F.map_keys("flat_items"), marks)
    )
    # A key of the nested form counts even when its value is null.
    texts = F.map_zip_with(
        "flat_items", "nested", lambda k, f, n: F.when(F.map_contains_key(F.col("nested"), k), n).otherwise(f)
    )
    s = s.withColumn("texts", texts)
    dates = {"start_date", "end_date", "filing_date"}
    meta = [
        (F.try_to_timestamp(F.col("flat")[m], F.lit("yyyy-MM-dd")).cast("date") if m in dates else F.col("flat")[m]).alias(m)
        for m in META
    ]
    return s.select(
        "ticker_id", "ticker", "position", "kind", *meta,
        F.transform_values("texts", lambda _, t: number(t)).alias("items"),
        F.transform_values("texts", lambda _, t: F.get_json_object(t, "$.source")).alias("sources"),
    )


def wide(statements: DataFrame, kind: str, extra: list[str] = ()) -> DataFrame:
    """Statements of one kind with a column per line item."""
    keep = [c for c in statements.columns if c not in ("kind", "items", "sources")]
    return statements.where(F.col("kind") == kind).select(
        *keep, *[F.col("items")[f].alias(f) for f in LINE_ITEMS[kind]], *extra
    )


def facts(statements: DataFrame) -> DataFrame:
    """One fact row per (ticker_id, period end): figures merged, metadata of the last statement.

    Of several statements the last non-null figure wins, as if each had been upserted.
    """
    order = F.struct(F.coalesce("filing_date", F.lit("0001-01-01").cast("date")), F.col("position"))
    aggs = [F.max_by(m, order).alias(m) for m in ("filing_date", "fiscal_period", "fiscal_year", "timeframe", "source_filing_url", "source_filing_file_url")]
    for kind, names in LINE_ITEMS.items():
        for f in names:
            x = F.when(F.col("kind") == kind, F.col("items")[f])
            aggs.append(F.max_by(x, F.when(x.isNotNull(), order)).alias(FACT_NAMES.get(f, f)))
    return statements.where(F.col("end_date").isNotNull()).groupBy(
        "ticker_id", F.col("end_date").alias("date")
    ).agg(*aggs)


def extract_pending(raw: DataFrame, stored: DataFrame) -> DataFrame:
    """Pending payloads parsed, flattened and merged into the stored facts."""
    todo = pending(raw, stored)
    new = facts(parse_payloads(todo))
    return merge.upsert_facts(stored.select(*new.columns), new)


def payload_hash(payload: Column | str) -> Column:
    """SHA-256 of a canonical form: top-level fields, results and their keys in fixed order."""
    p = F.from_json(payload, PAYLOAD)

    def ordered(m):
        return F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"])))

    parts = [p["status"], F.to_json(F.transform(p["results"], ordered))] + [
        F.to_json(F.transform(p[n], ordered)) for n in LIST_NAME.values()
    ]
    return F.sha2(F.concat_ws("|", *[F.coalesce(x, F.lit("")) for x in parts]), 256)


def dedupe_payloads(raw: DataFrame, order: list[str]) -> DataFrame:
    """One row per distinct payload content; payload and filing date of the latest copy."""
    values = [c for c in raw.columns]
    return raw.withColumn("response_hash", payload_hash("payload")).groupBy("response_hash").agg(
        F.max_by(F.struct(*values), F.struct(*order)).alias("r")
    ).select("response_hash", "r.*")


# Validation ---------------------------------------------------------------------------


def _missing(kind: str, names) -> Column:
    label = {"income": "income_statement", "balance": "balance_sheet", "cash": "cash_flow"}[kind]
    # A value of 0 counts as present; only a missing line item is reported.
    return issues(*[(F.col(n).isNull(), f"{label}.{n}") for n in names])


def check_income(s: DataFrame) -> DataFrame:
    r, cost, gross = F.col("revenues"), F.col("cost_of_revenue"), F.col("gross_profit")
    return s.withColumns({
        "errors": F.array().cast("array<string>"),
        "warnings": issues(
            (r < 0, "negative_revenues"),
            (F.abs(gross - (r - cost)) > F.abs((r - cost) * 0.01), "gross_profit_inconsistent"),
        ),
        "missing_fields": _missing("income", (
            "revenues", "net_income_loss", "earnings_per_share_basic", "weighted_average_shares_outstanding", "operating_income_loss")),
        "outliers": issues((F.abs(r) > 1e12, "revenues_too_high")),
    })


def check_balance(s: DataFrame) -> DataFrame:
    a, li, e = F.col("assets"), F.col("liabilities"), F.col("equity")
    current = F.try_divide("current_assets", "current_liabilities")
    return s.withColumns({
        "errors": issues((F.abs(a - (li + e)) > F.abs(a * 0.01), "balance_off"), (a < 0, "negative_assets")),
        "warnings": F.array().cast("array<string>"),
        "missing_fields": _missing("balance", ("assets", "liabilities", "equity", "current_assets", "current_liabilities")),
        "outliers": issues(((F.col("current_liabilities") > 0) & ~current.between(0.1, 10.0), "unusual_current_ratio")),
    })


def check_cash(s: DataFrame) -> DataFrame:
    total = sum((F.col(f"net_cash_flow_from_{k}_activities") for k in ("operating", "investing", "financing")), F.lit(0.0))
    return s.withColumns({
        "errors": F.array().cast("array<string>"),
        "warnings": issues((F.abs(F.col("net_cash_flow") - total) > F.abs(total * 0.05), "cash_flow_sum_off")),
        "missing_fields": _missing("cash", ("net_cash_flow_from_operating_activities",)),
        "outliers": F.array().cast("array<string>"),
    })


CHECKS = {"income": check_income, "balance": check_balance, "cash": check_cash}
ISSUE_COLUMNS = ("errors", "warnings", "missing_fields", "outliers")


def validate_statements(statements: DataFrame) -> DataFrame:
    """Issues per statement, all kinds together."""
    keys = ["ticker_id", "ticker", "end_date", "filing_date", "fiscal_period"]
    parts = [
        check(wide(statements, kind)).select(*keys, F.lit(kind).alias("kind"), *ISSUE_COLUMNS) for kind, check in CHECKS.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def penalty_score(errors, warnings, missing, outliers) -> Column:
    """100 minus 20 per error, 5 per warning, 3 per missing field, 2 per outlier, in [0, 100]."""
    raw = F.lit(100.0) - F.size(errors) * 20 - F.size(warnings) * 5 - F.size(missing) * 3 - F.size(outliers) * 2
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw))


def validation_report(statements: DataFrame) -> DataFrame:
    """Per ticker: distinct issues of all its statements and the penalty score."""
    v = validate_statements(statements)
    merged = v.groupBy("ticker_id").agg(
        *[F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in ISSUE_COLUMNS]
    )
    return merged.select(
        "ticker_id", *ISSUE_COLUMNS, penalty_score(*ISSUE_COLUMNS).alias("quality_score"),
        (F.size("errors") == 0).cast("int").alias("is_valid"),
    )


def latest(statements: DataFrame, kind: str) -> DataFrame:
    """Latest statement of a kind per ticker by filing date, then period end."""
    s = wide(statements, kind)
    values = [c for c in s.columns if c not in ("ticker_id", "ticker")]
    order = F.struct(F.coalesce("filing_date", F.lit("0001-01-01").cast("date")), F.col("end_date"), F.col("position"))
    return s.groupBy("ticker_id", "ticker").agg(F.max_by(F.struct(*values), order).alias("r")).select("ticker_id", "ticker", "r.*")


def by_period(statements: DataFrame, fiscal_period: str) -> DataFrame:
    """First statement of each kind with a fiscal period, per ticker."""
    s = statements.where(F.col("fiscal_period") == fiscal_period)
    return s.groupBy("ticker_id", "ticker", "kind").agg(
        F.min_by(F.struct("end_date", "items"), F.struct("end_date", "position")).alias("r")
    ).select("ticker_id", "ticker", "kind", "r.*")


def cross_checks(statements: DataFrame) -> DataFrame:
    """Warnings across the latest statements of a ticker."""
    key = ["ticker_id", "ticker"]
    i = latest(statements, "income").select(*key, F.col("end_date").alias("i_end"), F.col("fiscal_period").alias("i_per"))
    b = latest(statements, "balance").select(*key, F.col("end_date").alias("b_end"), F.col("fiscal_period").alias("b_per"), "assets", "liabilities", "equity")
    c = latest(statements, "cash").select(*key, F.col("end_date").alias("c_end"), F.col("fiscal_period").alias("c_per"), *LINE_ITEMS["cash"])
    j = i.join(b, key, "full").join(c, key, "full")
    a = F.col("assets")
    parts = [F.col(f"net_cash_flow_from_{k}_activities") for k in ("operating", "investing", "financing")]
    total = parts[0] + parts[1] + parts[2]

    def size(x):
        return F.when(x == 0, 1.0).otherwise(F.abs(x))

    return j.select(*key, issues(
        ((F.col("i_end") != F.col("b_end")) | (F.col("i_per") != F.col("b_per")), "income_balance_period"),
        ((F.col("i_end") != F.col("c_end")) | (F.col("i_per") != F.col("c_per")), "income_cash_period"),
        (F.abs(a - (F.col("liabilities") + F.col("equity"))) > size(a) * 0.02, "balance_off_2pct"),
        (F.abs(F.col("net_cash_flow") - total) > size(total) * 0.05, "cash_flow_off_5pct"),
    ).alias("cross_warnings"))


# Arithmetic ---------------------------------------------------------------------------


def safe_divide(a, b) -> Column:
    return F.try_divide(F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b)


def growth(now: Column, before: Column) -> Column:
    return F.try_divide(now - before, F.abs(before))


def cagr(end: Column, begin: Column, periods: int) -> Column:
    """Null without a positive start; a negative end has no real root."""
    return F.when((begin > 0) & (end >= 0), F.pow(F.try_divide(end, begin), F.lit(1.0 / periods)) - 1) if periods > 0 else F.lit(None).cast("double")


def line_item(df: DataFrame, name: str) -> Column:
    """First present alternative of a line item."""
    have = [F.col(c) for c in ALTERNATIVES.get(name, (name,)) if c in df.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("double")


def source_confidence(source: Column) -> Column:
    """Null without a source."""
    return (
        F.when(source == "direct_report", 1.0).when(source == "intra_report_impute", 0.8)
        .when(source == "inter_report_derive", 0.6).when(source.isNotNull(), 0.5)
    )


# The figures of the flat record.
FLAT_RECORD = {
    "income": ("revenues", "cost_of_revenue", "gross_profit", "operating_expenses", "net_income_loss"),
    "balance": ("assets", "current_assets", "liabilities", "equity", "long_term_debt"),
    "cash": ("net_cash_flow_from_operating_activities", "net_cash_flow_from_investing_activities"),
}


def flat_records(statements: DataFrame) -> DataFrame:
    """One record per income statement with its matching balance sheet and cash flow.

    Adds the share of filled figures, the number missing, and the mean source confidence of
    the income figures.
    """
    marks = [source_confidence(F.col("sources")[f]) for f in FLAT_RECORD["income"]]
    known = F.array_compact(F.array(*marks))
    confidence = F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, x: a + x), F.size(known).cast("double"))
    income = wide(statements, "income", [confidence.alias("data_source_confidence")])
    keys = ["ticker", "end_date", "fiscal_period", "fiscal_year"]
    side = {k: wide(statements, k).select(*keys, "position", *FLAT_RECORD[k]) for k in ("balance", "cash")}
    out = income.select("ticker_id", *keys, "filing_date", "timeframe", *FLAT_RECORD["income"], "data_source_confidence")
    for k in ("balance", "cash"):
        out = match_statements(out, side[k], ["position"]).drop("position")
    names = [f for fs in FLAT_RECORD.values() for f in fs]
    filled = sum((F.col(f).isNotNull().cast("int") for f in names), F.lit(0))
    return out.withColumns({
        "data_quality_score": filled / len(names), "missing_data_count": F.lit(len(names)) - filled,
    })


# Fields whose presence counts as completeness.
ESSENTIAL_FIELDS = {
    "income": ("revenues", "net_income_loss", "earnings_per_share_basic", "weighted_average_shares_outstanding", "operating_income_loss"),
    "balance": ("assets", "equity", "current_assets", "current_liabilities", "liabilities"),
    "cash": ("net_cash_flow_from_operating_activities",),
}


def completeness(statements: DataFrame) -> DataFrame:
    """Per ticker: share of the essential fields present over all its statements."""
    have, total = F.lit(0), F.lit(0)
    for kind, names in ESSENTIAL_FIELDS.items():
        mine = F.col("kind") == kind
        total = total + F.when(mine, len(names)).otherwise(0)
        have = have + F.when(mine, sum((F.col("items")[f].isNotNull().cast("int") for f in names), F.lit(0))).otherwise(0)
    return statements.groupBy("ticker_id").agg(F.sum(have).alias("h"), F.sum(total).alias("total_fields_count")).select(
        "ticker_id", F.round(F.col("h") / F.col("total_fields_count"), 4).alias("data_quality_score"),
        (F.col("total_fields_count") - F.col("h")).alias("missing_data_count"), "total_fields_count",
    )


# Monitoring ---------------------------------------------------------------------------


def collection_progress(records: DataFrame, tickers: DataFrame, today, days: int = 30) -> DataFrame:
    """One row: tickers with data over active tickers with financials, and recent ones."""
    have = records.groupBy("ticker_id").agg(F.max("date").alias("newest"))
    recent = F.col("newest") >= F.date_sub(F.lit(today).cast("date"), days)
    total = tickers.where(F.col("active") & F.col("has_financials")).agg(F.count(F.lit(1))).scalar()
    return have.agg(F.count(F.lit(1)).alias("tickers_with_data"), F.count_if(recent).alias("recent_data_count")).select(
        total.alias("total_tickers"), "tickers_with_data", "recent_data_count",
        F.coalesce(F.try_divide(F.col("tickers_with_data").cast("double"), total.cast("double")), F.lit(0.0)).alias("overall_progress"),
    )


def quality_summary(records: DataFrame) -> DataFrame:
    """One row: mean score and the filled share of four key figures."""
    return records.agg(
        F.coalesce(F.avg("data_quality_score"), F.lit(0.0)).alias("average_quality_score"),
        *[(F.count(c) / F.count(F.lit(1))).alias(n) for n, c in {
            "revenues": "revenues", "net_income": "net_income_loss", "assets": "assets",
            "cash_flow": "net_cash_flow_from_operating_activities"}.items()],
    )


def missing_histogram(records: DataFrame) -> DataFrame:
    return records.groupBy("missing_data_count").agg(F.count(F.lit(1)).alias("ticker_count")).orderBy("missing_data_count")


def recent_activity(records: DataFrame, today, days: int = 7, limit: int = 50) -> DataFrame:
    return records.where(F.col("date") >= F.date_sub(F.lit(today).cast("date"), days)).orderBy(
        F.desc("date"), "ticker_id").limit(limit)


# Declared metrics ---------------------------------------------------------------------

# Lower and upper caps per ratio.
CAPS = {
    "pe_ratio": (-100, 100), "pb_ratio": (0, 50), "debt_to_equity": (0, 10), "current_ratio": (0, 20), "roe": (-1, 2), "roa": (-1, 1),
    "net_margin": (-2, 2), "gross_margin": (-1, 1), "operating_margin": (-2, 2), "asset_turnover": (0, 10), "quick_ratio": (0, 20),
    "cash_ratio": (0, 10), "interest_coverage": (-100, 1000), "financial_leverage": (1, 50),
}


def _field(df, name):
    return F.col(name).cast("double") if name in df.columns else F.lit(None).cast("double")


def ratios(f: DataFrame) -> DataFrame:
    """Valuation (needs market_cap), profitability, liquidity and leverage; capped."""
    g = {n: _field(f, n) for n in (
        "market_cap", "revenues", "gross_profit", "operating_income_loss", "net_income_loss", "assets", "equity", "liabilities",
        "current_assets", "current_liabilities", "inventory", "cash", "interest_expense", "long_term_debt")}
    written_off = F.coalesce(_field(f, "depreciation_amortization"), line_item(f, "depreciation_amortization").cast("double"))
    ebitda = g["operating_income_loss"] + written_off
    values = {
        "pe_ratio": F.try_divide(g["market_cap"], g["net_income_loss"]), "pb_ratio": F.try_divide(g["market_cap"], g["equity"]),
        "ps_ratio": F.try_divide(g["market_cap"], g["revenues"]),
        "ev_ebitda": F.try_divide(g["market_cap"] + g["long_term_debt"] - g["cash"], ebitda),
        "roe": F.try_divide(g["net_income_loss"], g["equity"]), "roa": F.try_divide(g["net_income_loss"], g["assets"]),
        "roi": F.try_divide(g["net_income_loss"], g["equity"] + g["long_term_debt"]),
        "gross_margin": F.try_divide(g["gross_profit"], g["revenues"]),
        "operating_margin": F.try_divide(g["operating_income_loss"], g["revenues"]),
        "net_margin": F.try_divide(g["net_income_loss"], g["revenues"]),
        "current_ratio": F.try_divide(g["current_assets"], g["current_liabilities"]),
        "quick_ratio": F.try_divide(g["current_assets"] - g["inventory"], g["current_liabilities"]),
        "cash_ratio": F.try_divide(g["cash"], g["current_liabilities"]),
        "debt_to_equity": F.try_divide(g["liabilities"], g["equity"]), "debt_to_assets": F.try_divide(g["liabilities"], g["assets"]),
        "interest_coverage": F.try_divide(g["operating_income_loss"], g["interest_expense"]),
        "financial_leverage": F.try_divide(g["assets"], g["equity"]),
    }

    def capped(n, v):
        if n not in CAPS:
            return v
        lo, hi = (F.lit(float(x)) for x in CAPS[n])
        return F.when(v.isNotNull(), F.least(F.greatest(v, lo), hi))

    return f.withColumns({n: capped(n, v) for n, v in values.items()})


def _year_back(column: str, years: int) -> Column:
    """Value of the same fiscal period ``years`` before, null when that year is absent."""
    w = Window.partitionBy("ticker_id", "fiscal_period").orderBy(F.col("fiscal_year").cast("int")).rangeBetween(-years, -years)
    return F.first(column).over(w)


def growth_rates(f: DataFrame) -> DataFrame:
    """One-year growth and three-year annual growth of key figures, turnover and cycle days."""
    named = {"revenue": "revenues", "earnings": "net_income_loss", "book_value": "equity", "asset": "assets"}
    out = f.withColumns({f"_{n}_{y}": _year_back(c, y) for n, c in named.items() for y in (1, 3)})
    rates = {}
    for n, c in named.items():
        rates[f"{n}_growth_1y"] = growth(F.col(c), F.col(f"_{n}_1"))
        rates[f"{n}_growth_3y"] = cagr(F.col(c), F.col(f"_{n}_3"), 3)
    inventory, receivables, cost = (_field(f, c) for c in ("inventory", "accounts_receivable", "cost_of_revenue"))
    rates |= {
        "asset_turnover": F.try_divide(F.col("revenues"), F.col("assets")),
        "working_capital_turnover": F.try_divide(F.col("revenues"), F.col("current_assets") - F.col("current_liabilities")),
        "inventory_turnover": F.try_divide(cost, inventory), "receivables_turnover": F.try_divide(F.col("revenues"), receivables),
        "days_sales_outstanding": F.try_divide(receivables * 365, F.col("revenues")),
        "days_inventory_outstanding": F.try_divide(inventory * 365, cost),
    }
    return out.withColumns(rates).drop(*[f"_{n}_{y}" for n in named for y in (1, 3)])


def piotroski(f: DataFrame) -> DataFrame:
    """Nine yes/no signals against the same period a year before, and their sum."""
    x = f.withColumns({
        "_roa": F.try_divide("net_income_loss", "assets"),
        "_cfo": F.try_divide("net_cash_flow_from_operating_activities", "assets"),
        "_debt": F.try_divide(F.coalesce(_field(f, "long_term_debt"), F.lit(0.0)), F.col("assets")),
        "_current": F.try_divide("current_assets", "current_liabilities"), "_shares": _field(f, "basic_average_shares"),
        "_margin": F.try_divide("gross_profit", "revenues"), "_turn": F.try_divide("revenues", "assets"),
    })
    before = {n: _year_back(f"_{n}", 1) for n in ("roa", "debt", "current", "shares", "margin", "turn")}
    signals = {
        "piotroski_roa_positive": F.col("_roa") > 0,
        "piotroski_cfo_positive": F.col("_cfo") > 0,
        "piotroski_roa_improved": F.col("_roa") > before["roa"],
        "piotroski_cfo_vs_roa": F.col("_cfo") > F.col("_roa"),
        "piotroski_debt_decreased": F.col("_debt") < before["debt"],
        "piotroski_current_ratio_improved": F.col("_current") > before["current"],
        "piotroski_shares_outstanding": F.col("_shares") <= before["shares"],
        "piotroski_gross_margin_improved": F.col("_margin") > before["margin"],
        "piotroski_asset_turnover_improved": F.col("_turn") > before["turn"],
    }
    out = x.withColumns({n: F.coalesce(c, F.lit(False)).cast("int") for n, c in signals.items()})
    return out.withColumn("piotroski_f_score", sum((F.col(n) for n in signals), F.lit(0))).drop(
        *[c for c in out.columns if c.startswith("_")]
    )


def altman(f: DataFrame) -> DataFrame:
    """Z = 1.2 WC/TA + 1.4 RE/TA + 3.3 EBIT/TA + 0.6 MVE/TL + 1.0 S/TA; null if a part is missing."""
    a = F.col("assets")
    z = (
        F.try_divide(F.col("current_assets") - F.col("current_liabilities"), a) * 1.2
        + F.try_divide(_field(f, "retained_earnings"), a) * 1.4 + F.try_divide(_field(f, "operating_income_loss"), a) * 3.3
        + F.try_divide(_field(f, "market_cap"), F.col("liabilities")) * 0.6 + F.try_divide(F.col("revenues"), a)
    )
    return f.withColumn("altman_z_score", z)


def sector(sic: Column) -> Column:
    """Sector by SIC range; the ranges are fixed values."""
    return (
        F.when(sic.between(100, 999), "Energy").when(sic.between(1000, 1499), "Materials")
        .when(sic.between(1500, 1799) | sic.between(2000, 3999), "Industrials").when(sic.between(4000, 4999), "Utilities")
        .when(sic.between(5000, 5199), "Consumer Staples").when(sic.between(5200, 5999), "Consumer Discretionary")
        .when(sic.between(6000, 6799), "Financials").when(sic.between(7000, 8999), "Technology").otherwise("Industrials")
    )


def industry(sic_code: Column) -> Column:
    """Major group of an industry code, two of its four digits."""
    return F.floor(sic_code / 100).cast("int")


def group_ranks(df: DataFrame, keys: list[str], metric: str, prefix: str, min_companies: int = 5) -> DataFrame:
    """Percentile (0-100), rank (1 is highest), median and relative value of a metric within
    groups of at least min_companies. Groups of any size are cut by value (functions.ranks)."""
    r = value_ranks(df, keys, metric)
    low, high = F.floor((F.col("n_total") - 1) / 2), F.floor(F.col("n_total") / 2)

    def at(k):
        return F.max(F.when((F.col("n_below") <= k) & (k < F.col("n_below") + F.col("n_equal")), F.col(metric)))

    medians = r.groupBy(*keys).agg(((at(low) + at(high)) / 2).alias(f"{prefix}_median_{metric}"))
    out = df.join(r, [*keys, metric], "left").join(medians, keys, "left")
    n, median = F.col("n_total"), F.col(f"{prefix}_median_{metric}")
    enough = n >= min_companies
    return out.withColumns({
        f"{metric}_{prefix}_percentile": F.when(enough, F.try_divide(F.col("n_below") * 100.0, (n - 1).cast("double"))),
        f"{metric}_{prefix}_rank": F.when(enough, n - F.col("n_below") - F.col("n_equal") + 1),
        f"{metric}_relative_to_{prefix}": F.when(enough, F.try_divide(F.col(metric), median)),
        f"{prefix}_median_{metric}": F.when(enough, median),
        f"{prefix}_total_{metric}": n,
    }).drop("n_equal", "n_below", "n_total")


def companies_in(df: DataFrame, name: str, on_date) -> DataFrame:
    return df.where((F.col("gics_sector") == name) & (F.col("date") == F.lit(on_date).cast("date")))


def active_common_stock(tickers: DataFrame) -> DataFrame:
    return tickers.where(F.col("active") & (F.col("type") == "CS")).orderBy("ticker")
