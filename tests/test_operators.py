"""Hand-computed cases and laws."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barloom.operators import dividends, evaluate, features, fundamentals, ingest, merge, news, prepare, validate
from barloom.sources import storage

D = dt.date
BAR = "ticker string, date date, open double, high double, low double, close double, volume long, adjusted_close double, vwap double"


def prices(spark, days):
    return spark.createDataFrame([("A", d, 100.0) for d in days], "ticker string, date date, close double")


def paid(spark, rows):
    return spark.createDataFrame([("A", *r) for r in rows], "ticker string, ex_dividend_date date, cash_amount double")


def features_of(spark, days, rows):
    out = dividends.dividend_features(prices(spark, days), paid(spark, rows)).orderBy("date").collect()
    return {r.date: r for r in out}


def test_dividend_on_a_bar(spark):
    days = [D(2023, 1, 2), D(2023, 1, 3), D(2023, 1, 4)]
    got = features_of(spark, days, [(D(2023, 1, 3), 2.0)])
    hit = got[D(2023, 1, 3)]
    assert (hit.dividend_amount, hit.dividend_yield, hit.is_ex_dividend) == (2.0, 0.02, 1)
    other = got[D(2023, 1, 4)]
    assert (other.dividend_amount, other.dividend_yield, other.is_ex_dividend, other.days_since_last_dividend) == (None, None, 0, 1)
    assert got[D(2023, 1, 2)].days_to_next_dividend == 1


def test_two_payments_of_one_date_add_up(spark):
    assert features_of(spark, [D(2023, 1, 3)], [(D(2023, 1, 3), 1.0), (D(2023, 1, 3), 1.5)])[D(2023, 1, 3)].dividend_amount == 2.5


def test_weekend_lands_on_friday(spark):
    got = features_of(spark, [D(2023, 1, 2), D(2023, 1, 3), D(2023, 1, 6)], [(D(2023, 1, 7), 1.0)])
    assert [d for d, r in got.items() if r.is_ex_dividend] == [D(2023, 1, 6)]


def test_two_ex_dates_on_one_bar_keep_the_later(spark):
    got = features_of(spark, [D(2023, 1, 6)], [(D(2023, 1, 5), 1.0), (D(2023, 1, 7), 3.0)])
    assert got[D(2023, 1, 6)].dividend_amount == 3.0


def test_equal_distance_takes_the_earlier_bar(spark):
    got = features_of(spark, [D(2023, 1, 3), D(2023, 1, 5)], [(D(2023, 1, 4), 1.0)])
    assert got[D(2023, 1, 3)].is_ex_dividend == 1 and got[D(2023, 1, 5)].is_ex_dividend == 0


def test_return_target(spark):
    df = spark.createDataFrame([(100.0, 110.0), (200.0, 220.0), (100.0, 350.0), (100.0, 20.0), (0.0, 5.0), (100.0, None)], "close double, Future_Close_10D double")
    out, name = features.return_target(df, 10)
    assert name == "Future_Return_10D"
    values = [r[name] for r in out.collect()]
    assert [v for v in values if v is not None] == pytest.approx([0.1, 0.1]) and values.count(None) == 2


def test_return_target_falls_back_to_highs(spark):
    df = spark.createDataFrame([(100.0, 130.0)], "close double, Future_High_10D double")
    assert features.return_target(df, 20)[1] == "Future_Return_10D"
    with pytest.raises(ValueError):
        features.return_target(spark.createDataFrame([(1.0,)], "close double"))


def test_profit(spark):
    df = spark.createDataFrame([(0.1, 0.05), (-0.2, -0.1), (0.05, 0.02), (0.0, 0.0)], "y_true double, y_pred double")
    assert [r.profit for r in evaluate.add_profit(df, 100).collect()] == pytest.approx([10, 0, 5, 0])


def test_sweep_kept_counts_never_rise(spark):
    df = spark.range(5000).select(
        ((F.col("id") * 37 % 1000) / 1000.0).alias("confidence"), ((F.col("id") * 91 % 200 - 90) / 1000.0).alias("y_pred"),
        ((F.col("id") * 53 % 300 - 120) / 1000.0).alias("y_true"))
    out = evaluate.sweep(df, min_share=0.0, max_share=1.0).orderBy("threshold").collect()
    kept = [r.test_samples_kept for r in out]
    assert kept == sorted(kept, reverse=True) and len(out) > 80
    for r in out[::20]:
        assert r.test_samples_kept == df.where(F.col("confidence") >= r.threshold).count()


def test_sweep_on_any_grid(spark):
    df = spark.createDataFrame([(0.1, 0.2, c) for c in (0.05, 0.1, 0.26, 0.26, 0.95)], "y_true double, y_pred double, confidence double")

    def kept(thresholds):
        out = evaluate.sweep(df, thresholds, min_share=0.0, max_share=1.0).collect()
        return {r["threshold"]: r["test_samples_kept"] for r in out}

    assert kept([0.1, 0.15, 0.2, 0.25, 0.9]) == {0.1: 4, 0.15: 3, 0.2: 3, 0.25: 3, 0.9: 1}
    assert kept([0.9, 0.2, 0.1, 0.2]) == {0.9: 1, 0.2: 3, 0.1: 4}
    assert kept([0.26]) == {0.26: 3}


def test_sweep_with_bad_confidence(spark):
    rows = [(0.1, 0.2, c) for c in (0.5, 0.5, float("nan"), float("inf"), float("-inf"), None)]
    df = spark.createDataFrame(rows, "y_true double, y_pred double, confidence double")
    out = evaluate.sweep(df, [0.01, 0.021, 0.6], min_share=0.0, max_share=1.0).collect()
    assert [(r["test_samples_kept"], r["average_confidence"]) for r in out] == [(2, 0.5), (2, 0.5)]
    with pytest.raises(ValueError, match="infinite"):
        evaluate.require_finite_confidence(df)


def test_sweep_problems(spark):
    same = spark.range(1000).select(F.lit(0.1).alias("y_pred"), F.lit(0.5).alias("confidence"))
    assert "diversity" in evaluate.sweep_problems(same)
    nan = spark.range(10).select((F.col("id") / 10).alias("y_pred"), F.lit(float("nan")).alias("confidence"))
    assert "NaN" in evaluate.sweep_problems(nan)


def test_missing_threshold_keeps_all(spark):
    df = spark.createDataFrame([(1, 1, D(2024, 1, 5), 0.1, 0.2)], "id int, ticker_id int, date date, predicted_return double, confidence double")
    assert evaluate.select_daily(df, None).count() == 1
    assert evaluate.select_daily(df, None, only_friday=True).count() == 1


def bar(t, d, o, h, low, c, v=100, a=1.0, w=None):
    return (t, d, o, h, low, c, v, a, w)


def test_every_bar_is_valid_or_rejected(spark):
    rows = [
        bar("A", D(2020, 1, 1), 1.0, 2.0, 0.5, 1.5), bar("A", D(2020, 1, 2), 1.0, 0.9, 0.5, 1.5),
        bar("A$", D(2020, 1, 3), 1.0, 2.0, 0.5, 1.5), bar("A", D(2030, 1, 1), 1.0, 2.0, 0.5, 1.5), bar("A", D(2020, 1, 4), None, 2.0, 0.5, 1.5)]
    checked = validate.check_bars(spark.createDataFrame(rows, BAR), "2025-01-01")
    ok, bad = validate.split_valid(checked)
    assert ok.count() == 1 and bad.count() == 4
    errors = {r.date: r.errors for r in bad.collect()}
    assert errors[D(2020, 1, 2)] == ["high_below_open", "high_below_close"]
    assert errors[D(2020, 1, 3)] == ["ticker_format"] and errors[D(2030, 1, 1)] == ["date_in_future"]
    with pytest.raises(Exception, match="invalid bar"):
        validate.split_valid(checked, strict=True)[0].collect()


def test_vwap_repair(spark):
    rows = [bar("A", D(2020, 1, 1), 10.0, 12.0, 9.0, 11.0, 5, 1.0, 0.0), bar("A", D(2020, 1, 2), 10.0, 12.0, 9.0, 11.0, 0, 1.0, 50.0),
            bar("A", D(2020, 1, 3), 10.0, 12.0, 9.0, 11.0, 5, 1.0, 10.5), bar("A", D(2020, 1, 4), 10.0, 12.0, 9.0, 11.0)]
    out = validate.repair_vwap(spark.createDataFrame(rows, BAR)).orderBy("date").collect()
    assert [r.vwap for r in out] == [10.75, 10.6667, 10.5, None]


def test_short_tickers_and_gappy_columns_are_left_out(spark):
    rows = [bar("S", D(2020, 1, 1), 1.0, 2.0, 0.5, 1.5)] + [bar("L", D(2020, 1, 1) + dt.timedelta(days=i), 1.0, 2.0, 0.5, None if i < 2 else 1.5) for i in range(10)]
    df = spark.createDataFrame(rows, BAR)
    assert validate.enough_data(df, 5, 0.5).select("ticker").distinct().count() == 1
    assert validate.enough_data(df, 5, 0.1).count() == 0


def test_infinite_value_invalidates_a_ticker(spark):
    df = spark.createDataFrame([("A", 1.0), ("A", float("inf")), ("B", 1.0)], "ticker string, x double")
    assert {r.ticker for r in validate.valid_results(df, ["x"]).collect()} == {"B"}


def test_categories_and_settings():
    assert validate.category_of("OBV_SMA_10") == "trend" and validate.category_of("VPT_ROC_5") == "momentum"
    assert validate.category_of("Parkinson_Vol_10") == "basic" and validate.columns_in(["ATR", "MFI"], ["volume"]) == ["MFI"]
    validate.check_settings(10, 50)
    with pytest.raises(ValueError):
        validate.check_settings(0, 10, (2.0,), [(3, 1)])


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("A", D(2020, 1, 1), 1.0), ("A", D(2020, 1, 2), 2.0)], "ticker string, date date, close double")
    new = spark.createDataFrame([("A", D(2020, 1, 2), 5.0), ("A", D(2020, 1, 2), 6.0), ("B", D(2020, 1, 2), None)], old.schema)
    once = merge.upsert_bars(old, new, ["close"])
    rows = sorted(map(tuple, once.collect()), key=str)
    assert rows == sorted([("A", D(2020, 1, 1), 1.0), ("A", D(2020, 1, 2), 5.0), ("B", D(2020, 1, 2), None)], key=str)
    assert sorted(map(tuple, merge.upsert_bars(once, new, ["close"]).collect()), key=str) == rows


def test_one_hot_key_is_merged_whole(spark):
    """A key holding a third of the batch still gives one row, the first by order."""
    batch = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.concat(F.lit("T"), F.col("id"))).alias("ticker"),
        F.lit("2020-01-01").cast("date").alias("date"), F.col("id").cast("double").alias("close"))
    out = merge.upsert_bars(batch.limit(0), batch, ["close"])
    assert out.count() == 6001 and out.where("ticker = 'HOT'").first().close == 0.0


def test_raw_files(spark, tmp_path):
    (tmp_path / "bars.json").write_text(
        '{"T":"AAPL","t":1672704000000,"o":1.0,"h":2.0,"l":0.5,"c":1.5,"v":100,"vw":1.2}\n{"T":"BAD","t":1672704000000,"o":-1,"h":2,"l":1,"c":1,"v":1}\n')
    out = ingest.bars_from_raw(ingest.read_raw_bars(spark, str(tmp_path))).collect()
    assert len(out) == 1 and (out[0].ticker, out[0].date, out[0].volume, out[0].adjusted_close) == ("AAPL", D(2023, 1, 3), 100, 1.5)


def test_dividend_records(spark):
    cols = "id string, cash_amount string, amount string, cash string, currency string, ex_dividend_date string, frequency string, type string, ticker_id int"
    rows = [("1", "0.5", None, None, "USD", "2024-01-02", "4", "CD", 1), (None, "0.5", None, None, "USD", None, "4", "CD", 1),
            ("2", None, None, None, "USD", None, "4", "CD", 1), ("3", "x", None, None, "USD", None, "4", "CD", 1),
            ("4", "0", "0.7", None, "USDX", None, "4", "CD", 1), ("5", "0", "0.7", None, None, "later", "4", "CD", 1)]
    out = dividends.transform_records(spark.createDataFrame(rows, cols))
    assert [r.reason for r in out.collect()] == [None, "missing_id", "missing_cash_amount", "invalid_cash_amount", "invalid_currency", None]
    ok = dividends.accepted(out).collect()
    assert float(ok[1].cash_amount) == 0.7 and ok[1].ex_dividend_date is None and ok[0].ex_dividend_date == D(2024, 1, 2)
    c = dividends.record_counts(out).first()
    assert (c.processed, c.accepted, c.skipped, c.failed) == (6, 2, 1, 3)


PAYLOAD = '{"status":"OK","results":[{"end_date":"2023-12-31","filing_date":"2024-02-01","fiscal_period":"FY","fiscal_year":"2023","financials":{"income_statement":{"revenues":{"value":10.0,"source":"direct_report"},"net_income_loss":null},"balance_sheet":{}},"net_income_loss":3,"assets":{"value":7}}]}'
LISTS = '{"income_statements":[{"end_date":"2023-12-31","revenues":{"value":5}}],"cash_flow_statements":[{"end_date":"2023-12-31","net_cash_flow":-2}]}'


def test_statement_forms(spark):
    raw = spark.createDataFrame([(1, "A", PAYLOAD), (2, "B", LISTS), (3, "C", "{}"), (4, "D", "not json")], "ticker_id int, ticker string, payload string")
    got = {(r.ticker, r.kind): r for r in fundamentals.parse_payloads(raw).collect()}
    assert set(got) == {("A", "income"), ("A", "balance"), ("B", "income"), ("B", "cash")}
    income = got[("A", "income")]
    # A nested key wins over the flat one even when it is null.
    assert income["items"]["revenues"] == 10.0 and income["items"]["net_income_loss"] is None and income.sources["revenues"] == "direct_report"
    assert got[("A", "balance")]["items"]["assets"] == 7.0 and got[("B", "cash")]["items"]["net_cash_flow"] == -2.0
    fact = {r.ticker_id: r for r in fundamentals.facts(fundamentals.parse_payloads(raw)).collect()}
    assert fact[1].revenues == 10.0 and fact[1].assets == 7.0 and fact[1].date == D(2023, 12, 31)


def test_payload_hash_ignores_key_order(spark):
    df = spark.createDataFrame([('{"status":"OK","results":[{"a":"1","b":"2"}]}',), ('{"results":[{"b":"2","a":"1"}],"status":"OK"}',), ('{"status":"OK","results":[{"a":"1","b":"3"}]}',)], "p string")
    hashes = [r[0] for r in df.select(fundamentals.payload_hash("p")).collect()]
    assert hashes[0] == hashes[1] != hashes[2]


def test_growth_arithmetic(spark):
    r = spark.range(1).select(
        fundamentals.growth(F.lit(-5.0), F.lit(-10.0)).alias("g"), fundamentals.cagr(F.lit(8.0), F.lit(1.0), 3).alias("c"),
        fundamentals.cagr(F.lit(8.0), F.lit(-1.0), 3).alias("n"), fundamentals.safe_divide(F.lit(1.0), F.lit(0.0)).alias("d")).first()
    assert r.g == 0.5 and r.c == pytest.approx(1.0) and r.n is None and r.d is None


def test_text_and_keywords(spark):
    df = spark.createDataFrame([("  a \n\t b (REUTERS)c ",)], "t string").select(news.clean_text("t").alias("t"))
    assert df.first().t == "a b c"
    texts = ['["x", "y"]', "[x, y ,]", None, '"x"', "5", "", "[]"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, k string").select("i", news.keyword_list("k").alias("k")).orderBy("i").collect()
    assert [r.k for r in rows] == [["x", "y"], ["x", "y"], [], ["x"], ["5"], [], []]


def test_fund_rule_and_fallback(spark):
    r = spark.createDataFrame([("SPY",), ("ABC",), ("ABCD",)], "t string").select(news.is_fund(F.col("t")).alias("f")).collect()
    assert [x.f for x in r] == [True, True, False]
    rows = news.fallback_tickers(spark, 5, include_funds=False).collect()
    assert [x.ticker for x in rows] == ["AAPL", "GOOGL", "MSFT", "AMZN", "TSLA"] and rows[0].priority_score == 100.0


def test_storage_round_trip(spark, tmp_path):
    path = str(tmp_path / "f")
    df = spark.createDataFrame([("A", D(2020, 1, 1), 1.0, 2), ("B", D(2021, 1, 1), 3.0, 4)], "ticker string, date date, SMA_5 float, MFI int")
    for v in ("v1", "v2", "v3"):
        storage.write_features(df, path, v)
    back = storage.read_features(spark, path, "a", categories=["trend"], version="v2").collect()
    assert [tuple(r) for r in back] == [("A", D(2020, 1, 1), 1.0)]
    assert storage.drop_versions(spark, path, 2) == ["v1"] and storage.drop_versions(spark, path, 2) == []
    cons = str(tmp_path / "c")
    storage.consolidate(df, cons)
    out = storage.read_consolidated(spark, cons, start="2021-01-01")
    assert out.count() == 1 and "PartitionFilters: [isnotnull(year" in out._jdf.queryExecution().executedPlan().toString()


def test_cache_is_reused_until_old(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for age in (24, 24, -1):
        assert storage.cached(spark, str(tmp_path), build, age, a=1).count() == 3
    assert len(calls) == 2 and storage.cache_key(a=1, b=2) == storage.cache_key(b=2, a=1)


def test_training_set_needs_both_sides(spark):
    rows = [("A", D(2020, 1, 6) + dt.timedelta(days=7 * i), 100.0 + i, 101.0 + i, i + 0.5) for i in range(20)]
    df = spark.createDataFrame(rows, "ticker string, date date, close double, Future_Close_10D double, Ichimoku_Chikou double")
    out, target, names = prepare.training_set(df, 10, "2020-03-02")
    assert "Ichimoku_Chikou" not in names and "Future_Close_10D" not in names and target not in names
    assert {r.split for r in out.collect()} == {"train", "test"}
    with pytest.raises(ValueError):
        prepare.training_set(df, 10, "2030-01-01")


def test_drop_last_dates_is_strict(spark):
    df = spark.range(30).select(F.lit("test").alias("split"), F.col("id").cast("int").alias("date_int"))
    assert prepare.drop_last_dates(df, 10).agg(F.max("date_int")).first()[0] == 18
    assert prepare.drop_last_dates(df.limit(5), 10).count() == 5


def test_swap_in():
    assert prepare.swap_in(["a", "b", "c"], ["x"], 3) == ["a", "b", "x"]
    assert prepare.swap_in(["a"], ["x"], 3) == ["a", "x"]
