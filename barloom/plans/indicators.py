"""Queries for the indicators (trend, momentum, volatility, volume).

Comparison SQL spells each formula out: smoothing as an explicit weighted sum over the
whole history, windows as ROWS frames.
"""

from __future__ import annotations

from ..functions.shared import spread
from ..operators import momentum, trend, volatility, volume
from ..sources import views
from .common import near, query, shown
from .views import sql

K = ["ticker", "date"]
W = "PARTITION BY ticker ORDER BY date"


def frame(n):
    return f"({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def roll(fn, x, n):
    """fn over the last n rows, null until n values exist."""
    return f"CASE WHEN count({x}) OVER {frame(n)} = {n} THEN {fn}({x}) OVER {frame(n)} END"


def lag(x, h=1):
    return f"lag({x}, {h}) OVER ({W})"


def flag(cond):
    return f"CAST(coalesce({cond}, false) AS INTEGER)"


NUMBERED = f"SELECT *, row_number() OVER ({W}) - 1 AS k, count(*) OVER (PARTITION BY ticker) AS n FROM bars"


def smooth(source, x, alpha, name, min_rows):
    """CTE body: EMA (adjust=False) of the non-null x of source(ticker, date, x)."""
    a = repr(1 - alpha)
    return f"""
  SELECT b.ticker, b.date, CASE WHEN b.k >= {min_rows - 1} THEN
    sum(CASE WHEN a.k = 0 THEN a.x * pow({a}, b.k) ELSE {alpha!r} * a.x * pow({a}, b.k - a.k) END) END AS {name}
  FROM (SELECT ticker, date, {x} AS x, row_number() OVER ({W}) - 1 AS k FROM {source} WHERE {x} IS NOT NULL) a
  JOIN (SELECT ticker, date, row_number() OVER ({W}) - 1 AS k FROM {source} WHERE {x} IS NOT NULL) b
    ON a.ticker = b.ticker AND a.k <= b.k
  GROUP BY b.ticker, b.date, b.k"""


def final(columns: dict[str, tuple[str, int | None]], source: str) -> str:
    out = ", ".join(
        f"{e} AS \"{c}\"" if d is None else f"{near(e, d)} AS \"{c}\"" for c, (e, d) in columns.items()
    )
    return f"SELECT ticker, date, {out} FROM {source}"


def digits_of(columns):
    return {c: d for c, (_, d) in columns.items()}


def register(name, operator, columns, source, ctes):
    """columns: output -> (SQL expression, digits or None for integers)."""

    @query(name, sql(final(columns, source), "bars", **ctes))
    def run(spark, folder):
        return shown(operator(spread(views.bars(spark, folder))), K, digits_of(columns))


PERIODS = trend.AVERAGE_PERIODS

SMA = {f"SMA_{n}": (roll("avg", "close", n), 5) for n in PERIODS}
register("t1_sma", trend.sma, SMA, "bars", {})

EMA_CTES = {f"e{n}": smooth("bars", "close", 2 / (n + 1), f"v{n}", n) for n in PERIODS}
EMA_SOURCE = "bars " + " ".join(f"JOIN e{n} USING (ticker, date)" for n in PERIODS)
EMA = {f"EMA_{n}": (f"v{n}", 5) for n in PERIODS}
register("t2_ema", trend.exponential, EMA, EMA_SOURCE, EMA_CTES)

MACD_CTES = {
    "ef": smooth("bars", "close", 2 / 13, "fast", 12),
    "es": smooth("bars", "close", 2 / 27, "slow", 26),
    "ml": "SELECT ticker, date, fast - slow AS line FROM ef JOIN es USING (ticker, date)",
    "ms": smooth("ml", "line", 2 / 10, "sig", 9),
    "m1": f"SELECT ticker, date, line, sig, {flag('line > sig')} AS up FROM ml LEFT JOIN ms USING (ticker, date)",
    "m2": f"SELECT *, up - {lag('up')} AS crossing FROM m1",
}
MACD = {
    "MACD": ("line", 5), "MACD_Signal": ("sig", 5), "MACD_Histogram": ("line - sig", 5),
    "MACD_Above_Signal": ("up", None), "MACD_Crossover": ("crossing", None),
}
register("t3_macd", trend.macd, MACD, "m2", MACD_CTES)


def mid(n):
    return f"({roll('max', 'high', n)} + {roll('min', 'low', n)}) / 2"


ICHI_CTES = {
    "i1": f"SELECT *, {mid(9)} AS tk, {mid(26)} AS kj, {mid(52)} AS wide FROM bars",
    "i2": f"SELECT *, {lag('(tk + kj) / 2', 26)} AS sa, {lag('wide', 26)} AS sb, lead(close, 26) OVER ({W}) AS ck FROM i1",
}
BOTH = "sa IS NOT NULL AND sb IS NOT NULL"
ICHI = {
    "Ichimoku_Tenkan": ("tk", None), "Ichimoku_Kijun": ("kj", None), "Ichimoku_Senkou_A": ("sa", None),
    "Ichimoku_Senkou_B": ("sb", None), "Ichimoku_Chikou": ("ck", None),
    "Ichimoku_Tenkan_Above_Kijun": (flag("tk > kj"), None),
    "Ichimoku_Price_Above_Cloud": (flag(f"{BOTH} AND close > greatest(sa, sb)"), None),
    "Ichimoku_Price_Below_Cloud": (flag(f"{BOTH} AND close < least(sa, sb)"), None),
    "Ichimoku_Cloud_Green": (flag("sa > sb"), None),
    "Ichimoku_Cloud_Thickness": ("abs(sa - sb)", None),
}
register("t4_ichimoku", trend.ichimoku, ICHI, "i2", ICHI_CTES)

TREND_CTES = (
    EMA_CTES | MACD_CTES | ICHI_CTES
    | {"tj": f"SELECT * FROM i2 {' '.join(f'JOIN e{n} USING (ticker, date)' for n in PERIODS)} LEFT JOIN m2 USING (ticker, date)"}
)
TREND = SMA | EMA | MACD | ICHI
TREND["MACD_Above_Signal"] = ("coalesce(up, 0)", None)
register("t5_trend", trend.trend, TREND, "tj", TREND_CTES)

# momentum -----------------------------------------------------------------------------

RSI_CTES = {
    "r0": f"SELECT ticker, date, close, count(*) OVER (PARTITION BY ticker) AS n, close - {lag('close')} AS mv FROM bars",
    "r1": "SELECT *, CASE WHEN mv > 0 THEN mv ELSE 0.0 END AS gain, CASE WHEN mv < 0 THEN -mv ELSE 0.0 END AS loss FROM r0",
}
for _n in (14, 21):
    RSI_CTES[f"g{_n}"] = smooth("r1", "gain", 1 / _n, f"g{_n}", _n)
    RSI_CTES[f"l{_n}"] = smooth("r1", "loss", 1 / _n, f"l{_n}", _n)
RSI_CTES["r2"] = "SELECT ticker, date, " + ", ".join(
    f"CASE WHEN n >= {2 * n} THEN CASE WHEN l{n} = 0 THEN 100.0 ELSE 100 - 100 / (1 + g{n} / l{n}) END END AS rsi{n}"
    for n in (14, 21)
) + " FROM r1 " + " ".join(f"JOIN {s}{n} USING (ticker, date)" for n in (14, 21) for s in "gl")
RSI = {}
for _n in (14, 21):
    RSI |= {
        f"RSI_{_n}": (f"rsi{_n}", 5),
        f"RSI_{_n}_Overbought": (flag(f"rsi{_n} > 70"), None),
        f"RSI_{_n}_Oversold": (flag(f"rsi{_n} < 30"), None),
        f"RSI_{_n}_Neutral": (flag(f"rsi{_n} BETWEEN 30 AND 70"), None),
    }
register("m1_rsi", momentum.rsi, RSI, "r2", RSI_CTES)


def channel(n):
    return f"{roll('max', 'high', n)} AS hh{n}, {roll('min', 'low', n)} AS ll{n}"


STOCH_CTES = {
    "s1": f"SELECT *, {channel(14)} FROM bars",
    "s2": "SELECT *, 100 * (close - ll14) / nullif(hh14 - ll14, 0) AS sk FROM s1",
    "s3": f"SELECT *, {roll('avg', 'sk', 3)} AS sd FROM s2",
    "s4": f"SELECT *, {flag('sk > sd')} AS sup FROM s3",
    "s5": f"SELECT *, sup - {lag('sup')} AS scross FROM s4",
}
STOCH = {
    "Stoch_K": ("sk", 5), "Stoch_D": ("sd", 5),
    "Stoch_Overbought": (flag("sk > 80 AND sd > 80"), None),
    "Stoch_Oversold": (flag("sk < 20 AND sd < 20"), None),
    "Stoch_K_Above_D": ("sup", None), "Stoch_Crossover": ("scross", None),
}
register("m2_stochastic", momentum.stochastic, STOCH, "s5", STOCH_CTES)

ROC_CTES = {
    "c1": "SELECT *, " + ", ".join(
        f"100 * (close - {lag('close', n)}) / {lag('close', n)} AS roc{n}" for n in (10, 20, 30)) + " FROM bars"
}
ROC = {}
for _n in (10, 20, 30):
    ROC |= {
        f"ROC_{_n}": (f"roc{_n}", 5), f"ROC_{_n}_Positive": (flag(f"roc{_n} > 0"), None),
        f"ROC_{_n}_Strong_Positive": (flag(f"roc{_n} > 5"), None),
        f"ROC_{_n}_Strong_Negative": (flag(f"roc{_n} < -5"), None),
    }
register("m3_roc", momentum.roc, ROC, "c1", ROC_CTES)

WILL_CTES = {
    "w1": f"SELECT *, {channel(14)}, {channel(21)} FROM bars",
    "w2": "SELECT *, " + ", ".join(
        f"-100 * (hh{n} - close) / nullif(hh{n} - ll{n}, 0) AS wr{n}" for n in (14, 21)) + " FROM w1",
}
WILL = {}
for _n in (14, 21):
    WILL |= {
        f"Williams_R_{_n}": (f"wr{_n} + 0.0", 5), f"Williams_R_{_n}_Overbought": (flag(f"wr{_n} > -20"), None),
        f"Williams_R_{_n}_Oversold": (flag(f"wr{_n} < -80"), None),
        f"Williams_R_{_n}_Neutral": (flag(f"wr{_n} BETWEEN -80 AND -20"), None),
    }
register("m4_williams_r", momentum.williams, WILL, "w2", WILL_CTES)
MOMENTUM_CTES = RSI_CTES | STOCH_CTES | ROC_CTES | WILL_CTES | {
    "mj": "SELECT * FROM r2 JOIN s5 USING (ticker, date) JOIN (SELECT ticker, date, roc10, roc20, roc30 FROM c1) "
          "USING (ticker, date) JOIN (SELECT ticker, date, wr14, wr21 FROM w2) USING (ticker, date)"
}
MOMENTUM = RSI | STOCH | ROC | WILL
register("m5_momentum", momentum.momentum, MOMENTUM, "mj", MOMENTUM_CTES)

# volatility ---------------------------------------------------------------------------

BB_CTES = {
    "b1": f"SELECT *, {roll('avg', 'close', 20)} AS bm, {roll('stddev_pop', 'close', 20)} AS bs FROM bars",
    "b2": "SELECT *, bm - 2 * bs AS bl, bm + 2 * bs AS bu FROM b1",
    "b3": "SELECT *, bu - bl AS bw FROM b2",
    "b4": f"SELECT *, {roll('avg', 'bw', 20)} AS bwm, (close - bl) / nullif(bw, 0) AS bp FROM b3",
}
BB = {
    "BB_Lower": ("bl", 4), "BB_Middle": ("bm", 5), "BB_Upper": ("bu", 4),
    "BB_Bandwidth": ("100 * bw / bm", 5), "BB_Percent": ("bp", 6), "BB_Width": ("bw", 4),
    "BB_Above_Upper": (flag("close > bu"), None), "BB_Below_Lower": (flag("close < bl"), None),
    "BB_Squeeze": (flag("bw < bwm"), None), "BB_Position": ("bp", 6),
}
register("l1_bollinger", volatility.bollinger, BB, "b4", BB_CTES)

ATR_CTES = {
    "a1": f"SELECT *, row_number() OVER ({W}) - 1 AS k, greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) AS tr FROM bars",
    "a2": f"""SELECT ticker, date, close, k, CASE WHEN k >= 13 THEN avg(tr) FILTER (k < 14) OVER (PARTITION BY ticker) END AS seed, tr FROM a1""",
    "a3": f"""SELECT b.ticker, b.date, b.close, CASE WHEN b.k < 13 THEN 0.0 ELSE
        max(b.seed) * pow({13 / 14!r}, b.k - 13) + coalesce(sum(a.tr / 14 * pow({13 / 14!r}, b.k - a.k)) FILTER (a.k > 13), 0) END AS av
      FROM a2 b JOIN a2 a ON a.ticker = b.ticker AND a.k <= b.k GROUP BY b.ticker, b.date, b.close, b.k""",
    "a4": f"SELECT *, {roll('avg', 'av', 28)} AS am FROM a3",
}
ATR = {
    "ATR": ("av", 5), "ATR_Percent": ("100 * av / close", 5),
    "ATR_High_Volatility": (flag("av > am * 1.5"), None), "ATR_Low_Volatility": (flag("av < am * 0.5"), None),
    "ATR_Upper_Band": ("close + 2 * av", 4), "ATR_Lower_Band": ("close - 2 * av", 4),
}
register("l2_atr", volatility.atr, ATR, "a4", ATR_CTES)

VOL_CTES = {
    "v1": f"SELECT *, close / {lag('close')} - 1 AS ret, (high - low) / close AS hl, pow(ln(high / low), 2) AS l2 FROM bars",
    "v2": "SELECT *, " + ", ".join(
        f"{roll('stddev_samp', 'ret', n)} AS sd{n}, {roll('avg', 'hl', n)} AS hl{n}, {roll('avg', 'l2', n)} AS pk{n}"
        for n in (10, 20, 30)) + ", count(*) OVER (PARTITION BY ticker) AS n FROM v1",
    "v3": f"SELECT *, {roll('stddev_samp', 'sd20', 10)} AS vc, "
          + ", ".join(f"CASE WHEN count(sd10) OVER {frame(50)} = 50 THEN quantile_cont(sd10, {q}) OVER {frame(50)} END AS q{int(q * 10)}" for q in (0.8, 0.2))
          + " FROM v2",
    "v4": f"SELECT *, CASE WHEN count(vc) OVER {frame(50)} = 50 THEN quantile_cont(vc, 0.7) OVER {frame(50)} END AS q7 FROM v3",
}
VOLA = {}
for _n in (10, 20, 30):
    VOLA |= {
        f"Volatility_Std_{_n}": (f"sd{_n}", 7), f"Volatility_Annualized_{_n}": (f"sd{_n} * sqrt(252)", 6),
        f"HL_Volatility_{_n}": (f"hl{_n}", 7), f"Parkinson_Vol_{_n}": (f"sqrt(pk{_n} / (4 * ln(2)))", 7),
    }
register("l3_return_volatility", volatility.return_volatility, VOLA, "v2", {k: VOL_CTES[k] for k in ("v1", "v2")})
REGIME = {
    "Vol_Regime_High": (flag("sd10 > q8"), None), "Vol_Regime_Low": (flag("sd10 < q2"), None),
    "Vol_Trend_Rising": (flag("sd10 > sd30"), None),
}
register("l4_volatility_regime", lambda b: volatility.volatility_regime(volatility.return_volatility(b)), REGIME, "v3",
         {k: VOL_CTES[k] for k in ("v1", "v2", "v3")})
CLUSTER = {"Vol_Clustering": ("vc", 7), "Vol_Clustering_High": (flag("vc > q7"), None)}
register("l5_volatility_clustering",
         lambda b: volatility.volatility_clustering(volatility.return_volatility(b)), CLUSTER, "v4", VOL_CTES)
VOLATILITY_CTES = BB_CTES | ATR_CTES | VOL_CTES | {
    "lj": "SELECT b4.*, av, am, v4.* EXCLUDE (ticker, date, close) FROM b4 JOIN a4 USING (ticker, date) JOIN v4 USING (ticker, date)"
}
VOLATILITY = BB | ATR | VOLA | REGIME | CLUSTER
register("l6_volatility", volatility.volatility, VOLATILITY, "lj", VOLATILITY_CTES)

# volume -------------------------------------------------------------------------------


def level_ctes(source, x, tag):
    return {
        tag: f"SELECT *, {roll('avg', x, 10)} AS {tag}10, {roll('avg', x, 20)} AS {tag}20, {lag(x)} AS {tag}p, "
             f"{lag(x, 5)} AS {tag}p5, {lag(x, 10)} AS {tag}pp FROM {source}"
    }


def level_columns(prefix, x, tag, d):
    return {
        f"{prefix}_SMA_10": (f"{tag}10", d), f"{prefix}_SMA_20": (f"{tag}20", d),
        f"{prefix}_Above_SMA_10": (flag(f"{x} > {tag}10"), None), f"{prefix}_Above_SMA_20": (flag(f"{x} > {tag}20"), None),
        f"{prefix}_Rising": (flag(f"{x} > {tag}p"), None), f"{prefix}_Falling": (flag(f"{x} < {tag}p"), None),
        f"{prefix}_Momentum_5": (f"{x} - {tag}p5", d), f"{prefix}_Momentum_10": (f"{x} - {tag}pp", d),
    }


def diverges(now, then):
    """Sign of the change relative to then; a zero base takes the sign of now."""
    d = f"CASE WHEN {then} = 0 THEN sign({now}) ELSE sign({now} - {then}) * sign({then}) END"
    return f"(close > c5 AND {d} < 0) OR (close < c5 AND {d} > 0)"


OBV_CTES = {
    "o1": f"SELECT *, CASE WHEN close < {lag('close')} THEN -volume ELSE volume END AS sv, {lag('close', 5)} AS c5 FROM bars",
    "o2": f"SELECT *, CAST(sum(sv) OVER ({W}) AS DOUBLE) AS obv FROM o1",
} | level_ctes("o2", "obv", "o3")
OBV = {"OBV": ("obv", 2)} | level_columns("OBV", "obv", "o3", 3) | {
    "OBV_Price_Divergence": (flag(diverges("obv", "o3p5")), None)}
register("u1_obv", volume.obv, OBV, "o3", OBV_CTES)

VPT_CTES = {
    "p1": f"SELECT *, (close / {lag('close')} - 1) * volume AS fl FROM bars",
    "p2": f"SELECT *, sum(fl) OVER ({W}) AS vpt FROM p1",
} | level_ctes("p2", "vpt", "p3")
VPT = {"VPT": ("vpt", 4)} | level_columns("VPT", "vpt", "p3", 4) | {
    "VPT_ROC_5": ("100 * (vpt - p3p5) / nullif(p3p5, 0)", 3), "VPT_ROC_10": ("100 * (vpt - p3pp) / nullif(p3pp, 0)", 3)}
register("u2_vpt", volume.vpt, VPT, "p3", VPT_CTES)

A = 9 / 11
AD_CTES = {
    "d1": "SELECT *, CASE WHEN high = low THEN 0.0 ELSE ((close - low) - (high - close)) / (high - low) END * volume AS mf FROM bars",
    "d2": f"SELECT *, list_reduce(list(mf) OVER ({W}), lambda x, y: x + y) AS ad, row_number() OVER ({W}) - 1 AS k FROM d1",
} | level_ctes("d2", "ad", "d3") | {
    "d4": f"""SELECT b.ticker, b.date, sum(a.ad * pow({A!r}, b.k - a.k)) / sum(pow({A!r}, b.k - a.k)) AS ae
      FROM d2 a JOIN d2 b ON a.ticker = b.ticker AND a.k <= b.k GROUP BY b.ticker, b.date""",
    "d5": "SELECT * FROM d3 JOIN d4 USING (ticker, date)",
}
AD = {"AD_Line": ("ad", 4)} | level_columns("AD", "ad", "d3", 4) | {
    "AD_Oscillator": ("ad - ae", 4), "AD_Oscillator_Above_Zero": (flag("ad - ae > 0"), None)}
register("u3_ad_line", volume.ad_line, AD, "d5", AD_CTES)

PROFILE_CTES = {"f1": "SELECT *, " + ", ".join(
    f"{roll('avg', 'volume', n)} AS vm{n}, {lag('volume', n - 1)} AS vf{n}" for n in (10, 20, 50)) + " FROM bars"}
PROFILE = {}
for _n in (10, 20, 50):
    PROFILE |= {
        f"Volume_MA_{_n}": (f"vm{_n}", 4), f"Volume_Ratio_{_n}": (f"volume / vm{_n}", 7),
        f"High_Volume_{_n}": (flag(f"volume > vm{_n} * 1.5"), None), f"Low_Volume_{_n}": (flag(f"volume < vm{_n} * 0.5"), None),
        f"Volume_Trend_{_n}": (flag(f"volume > vf{_n}"), None),
    }
register("u4_volume_profile", volume.volume_profile, PROFILE, "f1", PROFILE_CTES)

PV_CTES = {
    "g1": f"SELECT *, close / {lag('close')} - 1 AS pc, volume / {lag('volume')} - 1 AS vch, {roll('avg', 'volume', 10)} AS vma, count(*) OVER (PARTITION BY ticker) AS n FROM bars",
    "g2": "SELECT *, " + ", ".join(
        f"CASE WHEN n >= 20 AND count(pc) OVER {frame(n)} = {n} AND stddev_pop(pc) OVER {frame(n)} > 0 AND stddev_pop(vch) OVER {frame(n)} > 0 "
        f"THEN corr(pc, vch) OVER {frame(n)} END AS cr{n}" for n in (10, 20)) + " FROM g1",
}
PV = {
    "PV_Correlation_10": ("cr10", 6), "PV_Correlation_20": ("cr20", 6),
    "Volume_Confirms_Uptrend": (flag("n >= 20 AND pc > 0 AND volume > vma"), None),
    "Volume_Confirms_Downtrend": (flag("n >= 20 AND pc < 0 AND volume > vma"), None),
    "Volume_Divergence": (flag("n >= 20 AND ((pc > 0 AND vch < 0) OR (pc < 0 AND vch > 0))"), None),
}
register("u5_price_volume", volume.price_volume, PV, "g2", PV_CTES)

POSITION_CTES = {"h1": f"SELECT *, {roll('min', 'volume', 50)} AS vlo, {roll('max', 'volume', 50)} AS vhi, "
                       f"{roll('avg', 'volume', 50)} AS vav, {roll('stddev_samp', 'volume', 50)} AS vsd FROM bars"}
POSITION = {
    "Volume_Percentile_50": ("CASE WHEN vlo IS NOT NULL THEN coalesce((volume - vlo) / nullif(vhi - vlo, 0), 0.5) END", 7),
    "Volume_Regime_High": (flag("volume > vav + 2 * vsd"), None), "Volume_Regime_Low": (flag("volume < vav - vsd"), None),
}
register("u6_volume_position", volume.volume_position, POSITION, "h1", POSITION_CTES)

MFI_CTES = {
    "n1": f"SELECT *, (high + low + close) / 3 AS tp, {lag('close', 5)} AS c5 FROM bars",
    "n2": f"SELECT *, CASE WHEN tp > {lag('tp')} THEN tp * volume ELSE 0.0 END AS fi, CASE WHEN tp < {lag('tp')} THEN tp * volume ELSE 0.0 END AS fo FROM n1",
    "n3": f"SELECT *, {roll('sum', 'fi', 14)} AS ps, {roll('sum', 'fo', 14)} AS ng FROM n2",
    "n4": "SELECT *, CASE WHEN ng = 0 THEN CASE WHEN ps > 0 THEN 100.0 END ELSE 100 - 100 / (1 + ps / ng) END AS mfi FROM n3",
    "n5": f"SELECT *, {lag('mfi')} AS mp, {lag('mfi', 5)} AS m5, {lag('mfi', 10)} AS m10 FROM n4",
}
MFI = {
    "MFI": ("mfi", 5), "MFI_Overbought": (flag("mfi > 80"), None), "MFI_Oversold": (flag("mfi < 20"), None),
    "MFI_Neutral": (flag("mfi BETWEEN 20 AND 80"), None), "MFI_Rising": (flag("mfi > mp"), None),
    "MFI_Falling": (flag("mfi < mp"), None), "MFI_Momentum_5": ("mfi - m5", 5), "MFI_Momentum_10": ("mfi - m10", 5),
    "MFI_Price_Divergence": (flag(diverges("mfi", "m5")), None),
}
register("u7_mfi", volume.money_flow, MFI, "n5", MFI_CTES)
VOLUME_CTES = OBV_CTES | VPT_CTES | AD_CTES | PROFILE_CTES | PV_CTES | POSITION_CTES | MFI_CTES | {
    "uj": "SELECT n5.*, " + ", ".join(
        f"{t}.* EXCLUDE (ticker_id, ticker, date, open, high, low, close, volume, adjusted_close, vwap{x})"
        for t, x in (("o3", ", c5"), ("p3", ""), ("d5", ""), ("f1", ""), ("g2", ""), ("h1", ""))
    ) + " FROM n5 " + " ".join(f"JOIN {t} USING (ticker, date)" for t in ("o3", "p3", "d5", "f1", "g2", "h1"))
}
VOLUME = OBV | VPT | AD | PROFILE | PV | POSITION | MFI
register("u8_volume", volume.volume, VOLUME, "uj", VOLUME_CTES)
