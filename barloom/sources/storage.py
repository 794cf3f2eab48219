"""Parquet storage of features: versions, yearly consolidation, metadata, cache, exports."""

from __future__ import annotations

import hashlib
import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.validate import columns_in

KEYS = ["ticker", "date"]


def storage_types(df: DataFrame) -> DataFrame:
    """Small integers to long, floats to double."""
    up = {T.ByteType: "long", T.ShortType: "long", T.IntegerType: "long", T.FloatType: "double"}
    return df.select(*[
        F.col(f.name).cast(up[type(f.dataType)]).alias(f.name) if type(f.dataType) in up else F.col(f.name)
        for f in df.schema.fields
    ])


def write_features(df: DataFrame, path: str, version: str, rows_per_file: int = 5_000_000) -> None:
    """One version of the features; rows of a ticker lie together so that its filter skips files."""
    (
        storage_types(df).withColumn("version", F.lit(version))
        .repartitionByRange(*KEYS).sortWithinPartitions(*KEYS)
        .write.mode("append").partitionBy("version").option("compression", "snappy")
        .option("maxRecordsPerFile", rows_per_file).parquet(path)
    )


def read_features(spark: SparkSession, path: str, ticker=None, start=None, end=None, categories=None, version=None) -> DataFrame:
    df = spark.read.parquet(path)
    if version is not None:
        df = df.where(F.col("version") == version)
    return _filtered(df, ticker, start, end, categories)


def _filtered(df, ticker, start, end, categories):
    if ticker is not None:
        df = df.where(F.col("ticker") == ticker.upper())
    if start is not None:
        df = df.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col("date") <= F.lit(end).cast("date"))
    if categories is not None:
        names = [c for c in df.columns if c not in (*KEYS, "version", "year")]
        df = df.select(*KEYS, *columns_in(names, categories))
    return df


def feature_metadata(df: DataFrame, version: str) -> DataFrame:
    """One row per ticker: range, row count, number of features, missing share as a score."""
    features = [c for c in df.columns if c not in KEYS]
    missing = sum((F.sum(F.col(c).isNull().cast("int")) for c in features), F.lit(0))
    n = F.count(F.lit(1))
    return df.groupBy("ticker").agg(
        F.lit(version).alias("feature_version"), F.min("date").alias("start_date"), F.max("date").alias("end_date"),
        n.alias("record_count"), F.lit(len(features)).alias("total_features"),
        (F.lit(100.0) * (1 - missing / (n * len(features)))).alias("quality_score"),
    )


def write_metadata(metadata: DataFrame, path: str) -> None:
    metadata.write.mode("append").partitionBy("feature_version").parquet(path)


def stored_tickers(spark: SparkSession, path: str, version=None) -> DataFrame:
    df = spark.read.parquet(path)
    if version is not None:
        df = df.where(F.col("version") == version)
    return df.select("ticker").distinct()


def stored_files(spark: SparkSession, path: str) -> DataFrame:
    """(version, path, length, modificationTime) of the data files; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    return files.select(
        F.regexp_extract("path", r"/version=([^/]+)/", 1).alias("version"), "path", "length", "modificationTime"
    )


def storage_statistics(spark: SparkSession, path: str) -> DataFrame:
    """Files, bytes, rows and tickers per version."""
    sizes = stored_files(spark, path).groupBy("version").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))
    rows = spark.read.parquet(path).groupBy(F.col("version").cast("string").alias("version")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("ticker").alias("tickers")
    )
    return rows.join(sizes, "version", "left")


def surplus_versions(spark: SparkSession, path: str, keep: int = 3) -> list[str]:
    """Versions beyond the newest ``keep``, by write time then name. Versions are few."""
    found = stored_files(spark, path).groupBy("version").agg(F.max("modificationTime").alias("at"))
    return [r["version"] for r in found.orderBy(F.desc("at"), F.desc("version")).offset(max(1, keep)).collect()]


def drop_versions(spark: SparkSession, path: str, keep: int | None = 3) -> list[str]:
    """Deletes surplus versions (all of them when keep is None). Runs only when called."""
    gone = surplus_versions(spark, path, keep) if keep is not None else [
        r["version"] for r in stored_files(spark, path).select("version").distinct().collect()
    ]
    jvm = spark.sparkContext._jvm
    for v in gone:
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/version={v}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return gone


def consolidate(features: DataFrame, path: str, rows_per_file: int = 5_000_000) -> None:
    """All tickers by year. A year is range-split by ticker, so no task holds a whole year."""
    (
        storage_types(features).withColumn("year", F.year("date"))
        .repartitionByRange("year", *KEYS).sortWithinPartitions("year", *KEYS)
        .write.mode("overwrite").partitionBy("year").option("compression", "snappy")
        .option("maxRecordsPerFile", rows_per_file).parquet(path)
    )


def consolidation_report(spark: SparkSession, path: str, source_bytes: int | None = None) -> DataFrame:
    rows = spark.read.parquet(path).groupBy(F.col("year").cast("int").alias("year")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("ticker").alias("tickers")
    )
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    sizes = files.select(F.regexp_extract("path", r"/year=(\d+)/", 1).cast("int").alias("year"), "length").groupBy("year").agg(
        F.sum("length").alias("bytes")
    )
    out = rows.join(sizes, "year", "left")
    return out if source_bytes is None else out.withColumn("size_ratio", F.col("bytes") / source_bytes)


def read_consolidated(spark: SparkSession, path: str, ticker=None, start=None, end=None, categories=None) -> DataFrame:
    """The date range also becomes a year range, so whole years are pruned before any file opens."""
    df = spark.read.parquet(path)
    if start is not None:
        df = df.where(F.col("year") >= int(str(start)[:4]))
    if end is not None:
        df = df.where(F.col("year") <= int(str(end)[:4]))
    return _filtered(df, ticker, start, end, categories)


def with_metadata(features: DataFrame, metadata: DataFrame) -> DataFrame:
    """Metadata columns of the ticker on every row."""
    return features.join(metadata, "ticker", "left")


def load_years(features: DataFrame, tickers: DataFrame, years=None) -> DataFrame:
    """Chosen years with data_year and ticker_id (null for unknown tickers)."""
    out = features.withColumn("data_year", F.year("date"))
    if years is not None:
        out = out.where(F.col("data_year").isin(list(years)))
    out = out.drop("ticker_id")
    return out.join(tickers.select("ticker", F.col("id").alias("ticker_id")), "ticker", "left")


def features_and_target(features: DataFrame, horizon: int = 10) -> tuple[DataFrame, str]:
    """Features without future columns, plus one non-null target."""
    name = f"Future_Close_{horizon}D"
    if name not in features.columns:
        highs = [c for c in features.columns if c.startswith("Future_High_")]
        if not highs:
            raise ValueError(f"no target column: expected {name} or a Future_High_ column")
        name = highs[0]
    keep = [c for c in features.columns if not c.startswith(("Future_", "Target_Date_"))]
    return features.select(*keep, name).where(F.col(name).isNotNull()), name


def cache_key(**params) -> str:
    return hashlib.md5(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()


def cached(spark: SparkSession, folder: str, build, max_age_hours: float = 24, **params) -> DataFrame:
    """build() written under the md5 of its parameters; reused while young enough."""
    path = f"{folder}/prepared-{cache_key(**params)}"
    jvm = spark.sparkContext._jvm
    marker = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    fs = marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fresh = fs.exists(marker) and (
        time.time() - fs.getFileStatus(marker).getModificationTime() / 1000 <= max_age_hours * 3600
    )
    if not fresh:
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def stable_sample(df: DataFrame, keys: list[str], n: int, seed: int = 42) -> DataFrame:
    """n rows chosen by a seeded hash of the key: repeatable and independent of row order."""
    mark = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
    return df.withColumn("_mark", mark).orderBy("_mark", *keys).limit(n).drop("_mark")


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def newest_payloads(files: DataFrame, today, max_days: int = 7) -> DataFrame:
    """Newest payload per ticker, by the date in ``TICKER_financials_YYYYMMDD...`` file names.

    files: (path, payload). Files older than max_days, or dated after today, are not valid.
    """
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    day = F.try_to_timestamp(F.regexp_extract(name, r"_financials_(\d{8})", 1), F.lit("yyyyMMdd")).cast("date")
    dated = files.select(F.regexp_extract(name, r"^(.*)_financials_", 1).alias("ticker"), day.alias("file_date"), "payload")
    valid = dated.where(F.col("file_date") >= F.date_sub(F.lit(today).cast("date"), max_days)).where(
        F.col("file_date") <= F.lit(today).cast("date")
    )
    return valid.groupBy("ticker").agg(
        F.max("file_date").alias("file_date"), F.max_by("payload", F.struct("file_date", "payload")).alias("payload")
    )


def read_payload_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("wholetext", "true").text(path).select(
        F.input_file_name().alias("path"), F.col("value").alias("payload")
    )
