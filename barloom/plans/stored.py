"""Queries: upserts into stored, partitioned tables. Each writes a store, merges a batch into it and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.shared import fresh_path, materialise
from ..operators import features, merge, news
from ..sources import partitioned, views
from . import company, panel
from . import news as news_plans
from .common import near, query, shown
from .ingest import STORED, stored_and_batch
from .views import sql


def merged_store(spark, old, new, part, merged):
    """What the store holds after the batch."""
    path = fresh_path(spark, "store")
    partitioned.write_partitioned(old, path, part)
    partitioned.upsert_stored(spark, path, new, part, merged)
    return partitioned.read_partitioned(spark, path)


#: A batch of two years out of seven.
RECENT = STORED | {"batch": "SELECT * FROM new WHERE year(date) IN (1994, 1996)"}


@query("w1_stored_bars", sql("""
SELECT ticker, date, close, volume FROM batch
UNION ALL SELECT * FROM old WHERE NOT EXISTS (SELECT 1 FROM batch WHERE batch.ticker = old.ticker AND batch.date = old.date)""", "bars", **RECENT))
def w1(spark, folder):
    old, new = stored_and_batch(spark, folder)
    again = new.withColumn("close", F.col("close") + 1)
    batch = new.unionByName(again).where(F.year("date").isin(1994, 1996))
    return merged_store(spark, old, batch, partitioned.by_month(), lambda o, n: merge.upsert_bars(o, n, ["close"]))


@query("w2_stored_inserts", sql("SELECT * FROM old UNION ALL SELECT * FROM batch ANTI JOIN old USING (ticker, date)", "bars", **RECENT))
def w2(spark, folder):
    old, new = stored_and_batch(spark, folder)
    batch = new.where(F.year("date").isin(1994, 1996))
    return merged_store(spark, old, batch, partitioned.by_month(), lambda o, n: merge.insert_new(o, n, ["ticker", "date"]))


@query("w3_stored_tickers", sql("""
SELECT coalesce(o.ticker, n.ticker) AS ticker, coalesce(n.name, o.name) AS name, o.type AS type, coalesce(n.sic_code, o.sic_code) AS sic_code
FROM (SELECT * FROM tickers WHERE id % 4 <> 0) o
FULL JOIN (SELECT ticker, CASE WHEN id % 3 = 0 THEN NULL ELSE upper(name) END AS name, sic_code + 1 AS sic_code FROM tickers WHERE id % 10 = 0) n USING (ticker)""", "tickers"))
def w3(spark, folder):
    t = views.tickers(spark, folder)
    old = t.where(F.col("id") % 4 != 0).select("ticker", "name", "type", "sic_code")
    new = t.where(F.col("id") % 10 == 0).select(
        "ticker", F.when(F.col("id") % 3 != 0, F.upper("name")).alias("name"), (F.col("sic_code") + 1).alias("sic_code"))
    return merged_store(spark, old, new, partitioned.by_bucket("ticker"), lambda o, n: merge.upsert_tickers(o, n, ["name", "sic_code"]))


LATE_FACTS = {"late": "SELECT * FROM new WHERE year(date) IN (1995, 1997)"}


@query("w4_stored_facts", sql(company.MERGED.replace("FULL JOIN new n", "FULL JOIN late n"), *company.S, **company.BOTH, **LATE_FACTS))
def w4(spark, folder):
    old, new = company.old_and_new(spark, folder)
    return merged_store(spark, old, new.where(F.year("date").isin(1995, 1997)), partitioned.by_year(), merge.upsert_facts)


@query("w5_stored_dividends", sql("""
SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NOT NULL THEN o.ticker_id ELSE n.ticker_id END AS ticker_id,
  CASE WHEN n.id IS NOT NULL THEN n.ex_dividend_date ELSE o.ex_dividend_date END AS ex_dividend_date,
  CASE WHEN n.id IS NOT NULL THEN n.cash_amount ELSE o.cash_amount END AS cash_amount
FROM (SELECT * FROM dividends WHERE id % 3 <> 0) o
FULL JOIN (SELECT id, ticker_id + 1000 AS ticker_id, CASE WHEN id % 5 > 0 THEN ex_dividend_date + 1 END AS ex_dividend_date,
  cash_amount * 2 AS cash_amount FROM dividends WHERE id % 3 <> 1 AND id < 400) n ON o.id = n.id""", "dividends"))
def w5(spark, folder):
    d = views.dividends(spark, folder)
    new = d.where((F.col("id") % 3 != 1) & (F.col("id") < 400)).select(
        "id", (F.col("ticker_id") + 1000).alias("ticker_id"),
        F.when(F.col("id") % 5 > 0, F.date_add("ex_dividend_date", 1)).alias("ex_dividend_date"),
        (F.col("cash_amount") * 2).alias("cash_amount"))
    return merged_store(spark, d.where(F.col("id") % 3 != 0), new, partitioned.by_bucket("id"), merge.upsert_dividends)


@query("w7_stored_features", sql(f"""SELECT ticker, date, feature_name, feature_category, {near('coalesce(n.v, o.v)', 4)} AS feature_value
FROM lo o FULL JOIN (SELECT * FROM ln WHERE year(date) = 1995) n USING (ticker, date, feature_name, feature_category)""", "bars", once=True, **panel.W7))
def w7(spark, folder):
    keys = ["ticker", "date", "feature_category", "feature_name"]
    # The store (whose writer samples it first) and the batch read the panel, so it is written once.
    long = features.long_features(materialise(panel.long_input(spark, folder), "long-input"), list(panel.LONG))
    old = long.where(F.dayofyear("date") % 3 != 0)
    new = long.where((F.dayofyear("date") % 3 != 1) & (F.year("date") == 1995)).withColumn("feature_value", F.col("feature_value") * 2)
    out = merged_store(spark, old, new, partitioned.by_year(), lambda o, n: merge.replace_rows(o, n, keys))
    return shown(out, keys, {"feature_value": 4})


@query("w9_stored_facts", sql("SELECT * FROM late UNION ALL SELECT * FROM old ANTI JOIN late USING (ticker_id, date)", *company.S, **company.BOTH, **LATE_FACTS))
def w9(spark, folder):
    old, new = company.old_and_new(spark, folder)
    batch = new.where(F.year("date").isin(1995, 1997))
    return merged_store(spark, old, batch, partitioned.by_year(), lambda o, n: merge.replace_rows(o, n, ["ticker_id", "date"]))


def stored_news(spark, p):
    """A store of the prepared articles ``p`` on disk: its path."""
    path = fresh_path(spark, "articles")
    partitioned.write_articles(news_plans.stored(p), path)
    return path


def prepared_news(spark, folder):
    """The prepared articles, written once: the store's writer samples them before it writes, and the batch reads them again."""
    return materialise(news_plans.prepared(spark, folder), "prepared")


#: What changes when only the batch's articles are compared: as b7, without those that are not in it.
BATCH = """SELECT * REPLACE (CASE WHEN k % 5 = 0 THEN CASE WHEN k % 3 = 0 THEN 'absent' ELSE 'kept' END ELSE outcome END AS outcome,
  CASE WHEN k % 5 = 0 AND k % 3 = 1 THEN 'Old ' || left(title, 900) ELSE title END AS title,
  CASE WHEN k % 5 <> 0 THEN tickers WHEN k % 2 = 0 THEN 'OLD' ELSE own END AS tickers) FROM merged JOIN
  (SELECT id AS polygon_id, array_to_string(list_sort(tickers), ',') AS own FROM prepared) USING (polygon_id)"""


@query("w6_stored_articles", sql("SELECT polygon_id, title, outcome, tickers FROM batch WHERE outcome <> 'absent'", *news_plans.A, **news_plans.P, merged=news_plans.MERGED, batch=BATCH))
def w6(spark, folder):
    p = prepared_news(spark, folder)
    path = stored_news(spark, p)
    new = news.storable(p).where(F.col("polygon_id").cast("long") % 5 != 0)
    outcomes = partitioned.upsert_stored_articles(spark, path, new)
    out = partitioned.read_partitioned(spark, path).join(outcomes, "polygon_id", "left")
    return out.select("polygon_id", "title", F.coalesce("outcome", F.lit("kept")).alias("outcome"), F.array_join(F.array_sort("tickers"), ",").alias("tickers"))


@query("b7_stored_batch", sql("SELECT polygon_id, title, outcome, tickers FROM merged", *news_plans.A, **news_plans.P, merged=news_plans.MERGED))
def b7(spark, folder):
    p = prepared_news(spark, folder)
    path = stored_news(spark, p)
    outcomes = partitioned.upsert_stored_articles(spark, path, news.storable(p))
    out = partitioned.read_partitioned(spark, path).join(outcomes, "polygon_id")
    return out.select("polygon_id", "title", "outcome", F.array_join(F.array_sort("tickers"), ",").alias("tickers"))


@query("b14_stored_batch", sql("""SELECT (SELECT count(*) FROM prepared) AS fetched, count(*) FILTER (outcome = 'new') AS stored, count(*) FILTER (outcome = 'updated') AS updated,
  count(*) FILTER (outcome = 'skipped') + (SELECT count(*) FROM prepared WHERE NOT coalesce(is_valid, false)) AS skipped FROM merged""", *news_plans.A, **news_plans.P, merged=news_plans.MERGED))
def b14(spark, folder):
    """Counts need the outcomes only: no stored body is read for them."""
    p = prepared_news(spark, folder)
    return news.batch_counts(p, partitioned.article_outcomes(spark, stored_news(spark, p), news.storable(p)).select("outcome"))
