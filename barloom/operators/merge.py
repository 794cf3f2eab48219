"""Upserts as pure functions merge(old, new) -> DataFrame, written out as a new version.

Conflicts within a batch are settled by grouped aggregation, so a key that arrives many times is combined before the shuffle;
stored rows meet the batch in an anti join or a full outer join on the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BAR_KEY = ["ticker", "date"]


def _pick(df: DataFrame, keys: list[str], order, first: bool) -> DataFrame:
    values = [c for c in df.columns if c not in keys]
    pick = F.min_by if first else F.max_by
    return df.groupBy(*keys).agg(pick(F.struct(*values), order).alias("_r")).select(
        *keys, *[F.col("_r")[v].alias(v) for v in values]
    ).select(*df.columns)


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the first by the order columns."""
    return _pick(df, keys, F.struct(*order), True)


def replace_rows(old: DataFrame, new: DataFrame, keys: list[str], unique: bool = False) -> DataFrame:
    """New rows replace old rows with the same key, nulls included.

    Only the batch is made unique (``unique`` says that it is already); stored rows are read past its keys, not grouped.
    """
    batch = new if unique else new.dropDuplicates(keys)
    return old.join(batch.select(*keys), keys, "left_anti").unionByName(batch, allowMissingColumns=True)


def upsert_bars(old: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """The batch is deduplicated (first wins), then overwrites what is stored."""
    return replace_rows(old, keep_first(new, BAR_KEY, order), BAR_KEY, unique=True)


def insert_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is stored already are ignored."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"))


def upsert_columns(old: DataFrame, new: DataFrame, keys: list[str], rules: dict[str, str]) -> DataFrame:
    """Column-wise upsert. Rules per column:

    ``take``: the new value whenever the key is in the batch; ``fill``: the new value
    unless it is null; ``keep``: the stored value unless the key is new.
    """
    o = old.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in rules], F.lit(1).alias("_in_old"))
    n = new.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in rules], F.lit(1).alias("_in_new"))
    here_new, here_old = F.col("_in_new").isNotNull(), F.col("_in_old").isNotNull()

    def value(c, rule):
        a, b = F.col(f"_o_{c}"), F.col(f"_n_{c}")
        if rule == "take":
            return F.when(here_new, b).otherwise(a)
        if rule == "fill":
            return F.coalesce(b, a)
        return F.when(here_old, a).otherwise(b)

    return o.join(n, keys, "full").select(*keys, *[value(c, r).alias(c) for c, r in rules.items()])


def upsert_tickers(old: DataFrame, new: DataFrame, supplied: list[str]) -> DataFrame:
    """Only the supplied columns are updated; a missing value does not erase a stored one."""
    rules = {c: ("fill" if c in supplied else "keep") for c in old.columns if c != "ticker"}
    for c in rules:
        if c not in new.columns:
            new = new.withColumn(c, F.lit(None).cast(old.schema[c].dataType))
    return upsert_columns(old, new, ["ticker"], rules)


FACT_METADATA = ("filing_date", "fiscal_period", "fiscal_year", "timeframe")


def upsert_facts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Metadata is overwritten; a figure is kept when the new one is missing."""
    keys = ["ticker_id", "date"]
    rules = {c: ("take" if c in FACT_METADATA else "fill") for c in old.columns if c not in keys}
    return upsert_columns(old, new, keys, rules)


DIVIDEND_UPDATES = ("ex_dividend_date", "pay_date", "cash_amount", "raw_payload")


def upsert_dividends(old: DataFrame, new: DataFrame) -> DataFrame:
    """On a known id only four fields change."""
    rules = {c: ("take" if c in DIVIDEND_UPDATES else "keep") for c in old.columns if c != "id"}
    return upsert_columns(old, new, ["id"], rules)


def set_flag(tickers: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """column becomes true for the tickers among keys, and stays as it is elsewhere."""
    hits = keys.select("ticker").distinct().withColumn("_hit", F.lit(True))
    out = tickers.join(hits, "ticker", "left")
    base = F.col(column) if column in tickers.columns else F.lit(False)
    return out.withColumn(column, F.coalesce("_hit", base)).drop("_hit")


#: What an update of an article can change, and the lists that replace stored ones when they are not empty.
ARTICLE_FIELDS = ("title", "description", "quality_score", "relevance_score", "keywords")
ARTICLE_LISTS = ("tickers", "insights")


def article_batch(new: DataFrame, title_chars: int | None = None) -> DataFrame:
    """Titles cut where the store has a limit, tickers in upper case."""
    title = F.col("title") if title_chars is None else F.substring("title", 1, title_chars)
    return new.withColumns({"title": title, "tickers": F.transform("tickers", lambda t: F.upper(t))})


def upsert_articles(old: DataFrame, new: DataFrame, title_chars: int | None = None) -> DataFrame:
    """Articles with nested children: changed fields are updated, non-empty child lists replace.

    Adds outcome: new, updated, skipped (nothing to change), kept (not in the batch). Titles stay whole unless
    title_chars is given, for stores with a column of limited width.
    """
    fields, lists = ARTICLE_FIELDS, ARTICLE_LISTS
    # Set once, at the insert.
    fixed = [c for c in old.columns if c not in fields + lists + ("polygon_id",)]
    cut = article_batch(new, title_chars)
    o = old.select("polygon_id", *[F.col(c).alias(f"_o_{c}") for c in [*fields, *lists, *fixed]], F.lit(1).alias("_in_old"))
    n = cut.select("polygon_id", *[F.col(c).alias(f"_n_{c}") for c in [*fields, *lists, *fixed]], F.lit(1).alias("_in_new"))
    both = F.col("_in_new").isNotNull() & F.col("_in_old").isNotNull()
    changed = F.lit(False)
    for c in fields:
        changed = changed | ~F.col(f"_o_{c}").eqNullSafe(F.col(f"_n_{c}"))
    filled = {c: F.coalesce(F.size(f"_n_{c}"), F.lit(0)) > 0 for c in lists}
    touched = changed | filled["tickers"] | filled["insights"]
    outcome = (
        F.when(both & touched, "updated").when(both, "skipped")
        .when(F.col("_in_new").isNotNull(), "new").otherwise("kept")
    )
    here = F.col("_in_new").isNotNull()
    return o.join(n, "polygon_id", "full").select(
        "polygon_id",
        *[F.when(here, F.col(f"_n_{c}")).otherwise(F.col(f"_o_{c}")).alias(c) for c in fields],
        *[
            F.when(here & (filled[c] | F.col("_in_old").isNull()), F.col(f"_n_{c}")).otherwise(F.col(f"_o_{c}")).alias(c)
            for c in lists
        ],
        *[F.when(F.col("_in_old").isNotNull(), F.col(f"_o_{c}")).otherwise(F.col(f"_n_{c}")).alias(c) for c in fixed],
        outcome.alias("outcome"),
    )


def stamp_changes(old: DataFrame, new: DataFrame, keys: list[str], now) -> DataFrame:
    """New rows over old ones; updated_at moves to now only where a value changed."""
    values = [c for c in new.columns if c not in keys]
    o = old.select(*keys, F.struct(*values).alias("_o"), F.col("updated_at").alias("_at"))
    n = new.select(*keys, F.struct(*values).alias("_n"))
    j = o.join(n, keys, "full")
    same = F.col("_n").isNull() | F.col("_o").eqNullSafe(F.col("_n"))
    return j.select(
        *keys, *[F.coalesce(F.col("_n"), F.col("_o"))[v].alias(v) for v in values],
        F.when(same, F.col("_at")).otherwise(F.lit(now).cast("timestamp")).alias("updated_at"),
    )
