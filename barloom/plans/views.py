"""SQL text of the market views, for the comparison engine."""

VIEWS = {
    "bars": """
  SELECT l_suppkey + 1 AS ticker_id,
    'T' || repeat('0', greatest(0, 6 - length(CAST(l_suppkey + 1 AS VARCHAR)))) || CAST(l_suppkey + 1 AS VARCHAR) AS ticker,
    CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
    first(p ORDER BY l_orderkey, l_linenumber, l_shipdate, p) AS open,
    max(p * (1 + l_tax)) AS high, min(p * (1 - l_discount)) AS low,
    last(p ORDER BY l_orderkey, l_linenumber, l_shipdate, p) AS close,
    CAST(sum(l_quantity) AS BIGINT) AS volume,
    last(p ORDER BY l_orderkey, l_linenumber, l_shipdate, p) AS adjusted_close,
    CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / sum(l_quantity) AS vwap
  FROM (SELECT *, l_extendedprice / l_quantity AS p FROM lineitem) GROUP BY 1, 2, 3""",
    "tickers": """
  SELECT s_suppkey + 1 AS id,
    'T' || repeat('0', greatest(0, 6 - length(CAST(s_suppkey + 1 AS VARCHAR)))) || CAST(s_suppkey + 1 AS VARCHAR) AS ticker,
    s_name AS name, CASE WHEN s_suppkey % 10 = 0 THEN 'ETF' ELSE 'CS' END AS type,
    s_acctbal > 0 AS active, s_acctbal * 1e8 AS market_cap, s_acctbal * 5e3 AS avg_volume,
    100 + (s_suppkey * 89) % 8900 AS sic_code, 'stocks' AS market
  FROM supplier""",
    "dividends": """
  SELECT o_orderkey AS id, o_custkey % (SELECT count(*) FROM supplier) + 1 AS ticker_id,
    CAST(o_orderdate AS DATE) AS ex_dividend_date, o_totalprice / 1e5 AS cash_amount
  FROM orders""",
    "statements": """
  SELECT ticker_id,
    'T' || repeat('0', greatest(0, 6 - length(CAST(ticker_id AS VARCHAR)))) || CAST(ticker_id AS VARCHAR) AS ticker,
    CAST(q + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS end_date,
    CAST(q + INTERVAL 3 MONTH + INTERVAL 44 DAY AS DATE) AS filing_date,
    'Q' || CAST(quarter(q) AS VARCHAR) AS fiscal_period, CAST(year(q) AS VARCHAR) AS fiscal_year,
    revenues, cost_of_revenue, operating_expenses, net_income_loss,
    revenues - cost_of_revenue AS gross_profit, revenues * 2 AS assets, revenues AS current_assets,
    liabilities, current_liabilities, revenues * 2 - liabilities AS equity,
    current_liabilities AS operating_cash_flow, -liabilities / 2 AS investing_cash_flow,
    -pending AS financing_cash_flow, current_liabilities - liabilities / 2 - pending AS net_cash_flow
  FROM (SELECT o_custkey % (SELECT count(*) FROM supplier) + 1 AS ticker_id,
      CAST(date_trunc('quarter', o_orderdate) AS DATE) AS q,
      CAST(sum(p) AS DOUBLE) AS revenues,
      CAST(coalesce(sum(p) FILTER (left(o_orderpriority, 1) IN ('1', '2')), 0) AS DOUBLE) AS cost_of_revenue,
      CAST(coalesce(sum(p) FILTER (left(o_orderpriority, 1) = '3'), 0) AS DOUBLE) AS operating_expenses,
      CAST(coalesce(sum(p) FILTER (left(o_orderpriority, 1) = '5'), 0) AS DOUBLE) AS net_income_loss,
      CAST(coalesce(sum(p) FILTER (o_orderstatus = 'F'), 0) AS DOUBLE) AS liabilities,
      CAST(coalesce(sum(p) FILTER (o_orderstatus = 'O'), 0) AS DOUBLE) AS current_liabilities,
      CAST(coalesce(sum(p) FILTER (o_orderstatus = 'P'), 0) AS DOUBLE) AS pending
    FROM (SELECT *, CAST(o_totalprice AS DECIMAL(18,2)) AS p FROM orders) GROUP BY 1, 2)""",
    "filed": """
  SELECT * REPLACE (
    CASE WHEN ticker_id % 9 = 0 AND fiscal_period = 'Q2' THEN NULL WHEN ticker_id % 11 = 0 THEN -revenues ELSE revenues END AS revenues,
    CASE WHEN ticker_id % 7 = 0 THEN gross_profit * 1.05::DOUBLE + 1 ELSE gross_profit END AS gross_profit,
    CASE WHEN ticker_id % 5 = 0 THEN equity * 0.9::DOUBLE - 1 ELSE equity END AS equity,
    CASE WHEN ticker_id % 6 = 0 THEN net_cash_flow * 1.2::DOUBLE + 1 ELSE net_cash_flow END AS net_cash_flow)
  FROM statements""",
    "articles": """
  SELECT CAST(doc_id AS VARCHAR) AS id, substr(text, 1, 200) AS title, text AS description,
    'https://news.example.com/' || CAST(doc_id AS VARCHAR) AS article_url, source AS author,
    TIMESTAMP '2024-01-01' + to_hours(doc_id) AS published_at, lang, source AS publisher_name,
    list_distinct([
      'T' || repeat('0', greatest(0, 6 - length(CAST(a AS VARCHAR)))) || CAST(a AS VARCHAR),
      'T' || repeat('0', greatest(0, 6 - length(CAST(b AS VARCHAR)))) || CAST(b AS VARCHAR)]) AS tickers, doc_id
  FROM (SELECT *, doc_id % (SELECT count(*) FROM supplier) + 1 AS a,
    doc_id * 7 % (SELECT count(*) FROM supplier) + 1 AS b FROM documents)""",
    "insights": """
  SELECT CAST(doc_id AS VARCHAR) AS article_id,
    CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END AS sentiment
  FROM labels""",
    "scored": """
  SELECT event_id AS id, ((event_id * 31) % 200 - 80) / 1000.0::DOUBLE AS y_pred,
    ((event_id * 57) % 240 - 100) / 1000.0::DOUBLE AS y_true, value AS current_price,
    (event_id * 7919 % 10007) / 10006.0::DOUBLE AS confidence, CAST(ts AS DATE) AS date, user_id AS ticker_id
  FROM events""",
}


def sql(body: str, *views: str, once: bool = False, recursive: bool = False, **ctes: str) -> str:
    """body behind a WITH list of the named views and extra CTEs, in order; ``once`` has each of them computed once."""
    word = "AS MATERIALIZED" if once else "AS"
    parts = [f"{v} {word} ({VIEWS[v]})" for v in views]
    parts += [f"{name} {word} ({text})" for name, text in ctes.items()]
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)}\n{body}" if parts else body

