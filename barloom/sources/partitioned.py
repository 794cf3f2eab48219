"""Upserts into stored Parquet tables that read and rewrite only the partitions a batch touches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import materialise
from ..operators import merge

#: Name of the partition column in the folders.
PART = "part"


def by_month(date: str = "date") -> Column:
    return F.date_format(date, "yyyy-MM")


def by_year(date: str = "date") -> Column:
    return F.year(date).cast("string")


def by_bucket(key: str, buckets: int = 64) -> Column:
    """For keys without a date: a fixed number of buckets."""
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("string")


def write_partitioned(df: DataFrame, path: str, part: Column) -> None:
    """A new table; rows of a partition are spread over tasks by range, so that no task holds a whole one."""
    df = df.withColumn(PART, part)
    df.repartitionByRange(PART, *df.columns[:2]).write.partitionBy(PART).parquet(path)


def read_partitioned(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """The rows of a table without its partition column."""
    return _stored(spark, path).drop(PART)


def _stored(spark: SparkSession, path: str) -> DataFrame:
    """With its partition column, as text whatever the values look like."""
    known = spark.read.parquet(path).schema
    fields = [f for f in known.fields if f.name != PART]
    return spark.read.schema(type(known)(fields).add(PART, "string")).parquet(path)


def upsert_stored(
    spark: SparkSession, path: str, batch: DataFrame, part: Column, merged: Callable[[DataFrame, DataFrame], DataFrame]
) -> list[str]:
    """Merge a batch into the table at ``path`` with ``merged(old, new)``; returns the partitions that were rewritten.

    ``part`` must give a key the same partition always. Partitions without batch rows are neither read nor written. The merged partitions are
    written aside first and then swapped in by dynamic overwrite, so a job that fails before leaves the table as it was.
    """
    batch = materialise(batch.withColumn(PART, part), "batch")
    # One value per partition that the batch touches.
    touched = sorted(r[PART] for r in batch.select(PART).distinct().collect())
    if touched:
        old = _stored(spark, path).where(F.col(PART).isin(touched)).drop(PART)
        swap_in(merged(old, batch.drop(PART)).withColumn(PART, part), path)
    return touched


def swap_in(rows: DataFrame, path: str) -> None:
    """Replace the partitions that rows have, written aside first because they may come from the same table."""
    rows = materialise(rows, "merged")
    rows.repartitionByRange(PART, *rows.columns[:2]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(path)


# Articles: what is stored of an article is compared by digest, bodies are read where something changes.


DIGEST = "digest"


def article_digest() -> Column:
    """Of the fields that an update can change."""
    parts = [F.coalesce(F.to_json(F.struct(F.col(c).alias("v"))), F.lit("")) for c in merge.ARTICLE_FIELDS]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def write_articles(articles: DataFrame, path: str) -> None:
    write_partitioned(articles.withColumn(DIGEST, article_digest()), path, by_month("published_at"))


def article_outcomes(spark: SparkSession, path: str, new: DataFrame) -> DataFrame:
    """The batch with outcome (new, updated, skipped), stored digest and partition: one join with (id, digest, partition) of the store."""
    keys = _stored(spark, path).select("polygon_id", F.col(DIGEST).alias("_stored"), F.col(PART).alias("_at"))
    lists = [F.coalesce(F.size(c), F.lit(0)) > 0 for c in merge.ARTICLE_LISTS]
    known, same = F.col("_at").isNotNull(), F.col("_stored") == F.col(DIGEST)
    outcome = F.when(~known, "new").when(~same | lists[0] | lists[1], "updated").otherwise("skipped")
    batch = merge.article_batch(new).withColumn(DIGEST, article_digest()).join(keys, "polygon_id", "left")
    # An article stays in the partition it was stored in, as its publication time is set once.
    return batch.withColumns({"outcome": outcome, PART: F.coalesce("_at", by_month("published_at"))}).drop("_stored", "_at")


def upsert_stored_articles(spark: SparkSession, path: str, new: DataFrame) -> DataFrame:
    """Merge a batch of articles into the store; returns (polygon_id, outcome) of the batch.

    Only partitions with a new or changed article are read in full and swapped in.
    """
    delta = materialise(article_outcomes(spark, path, new), "delta")
    changed = delta.where("outcome <> 'skipped'")
    touched = sorted(r[PART] for r in changed.select(PART).distinct().collect())
    if touched:
        old = _stored(spark, path).where(F.col(PART).isin(touched))
        merged = merge.upsert_articles(old.drop(PART, DIGEST), changed.drop(PART, DIGEST, "outcome")).drop("outcome")
        merged = merged.withColumns({DIGEST: article_digest(), PART: by_month("published_at")})
        swap_in(merged.select(*old.columns), path)
    return delta.select("polygon_id", "outcome")
