"""Canonical stream from several sources, idempotent date overwrite, manifests, stored artifacts."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.operators.lake import between


def union_sources(sources: dict[str, DataFrame], windows: list[tuple]) -> DataFrame:
    """One stream out of several: ``windows`` lists (source, exchange, first day or None, last day or
    None) and should not overlap; each source only gives the days it is chosen for."""
    parts = [between(sources[s].filter(F.col("exchange") == ex), lo, hi) for s, ex, lo, hi in windows]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def replace_dates(existing: DataFrame, new: DataFrame, keys: list[str] = ("exchange", "date")) -> DataFrame:
    """``existing`` with every date present in ``new`` replaced by ``new``; running it twice changes
    nothing more."""
    days = new.select(*keys).distinct()
    return existing.join(days, list(keys), "left_anti").unionByName(new.select(*existing.columns))


def write_bars(df: DataFrame, path: str) -> None:
    """Overwrite only the (exchange, year) partitions present in ``df``. Rows are spread by symbol, so a big
    year is not one task, and sorted for row-group skipping; bars that are dealt by symbol already stay where they are."""
    spread = df.withColumn("year", F.year("date")).repartition("symbol")
    (spread.sortWithinPartitions("exchange", "year", "symbol", "date").write.partitionBy("exchange", "year")
     .option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path))


def read_bars(spark: SparkSession, path: str, schema: T.StructType, exchange: str | None = None, first=None, last=None) -> DataFrame:
    """The lake under ``path``, an empty table of ``schema`` where nothing was written yet. The exchange and the years of
    the wanted days are conditions on the folders, so other folders are not opened."""
    declared = T.StructType([f for f in schema.fields if f.name not in ("exchange", "year")] + [T.StructField("exchange", T.StringType()), T.StructField("year", T.IntegerType())])
    try:
        df = spark.read.schema(declared).option("basePath", path).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        df = spark.createDataFrame([], declared)
    if exchange is not None:
        df = df.filter(F.col("exchange") == exchange)
    return between(df, first, last, year_partitioned=True).select(*[f.name for f in schema.fields])


MANIFEST = "exchange string, year int, n_rows long, fingerprint decimal(30,0), version string, commit long"


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """Every commit of the store at ``path``: per partition its row count, fingerprint and the version that holds it. What
    is still being written is not among them, as Spark only moves finished files there."""
    try:
        return spark.read.schema(MANIFEST).option("basePath", f"{path}/manifest").parquet(f"{path}/manifest")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], MANIFEST)


def current_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The partitions of the newest commit."""
    every = manifests(spark, path)
    return every.filter(F.col("commit") == every.agg(F.max("commit")).scalar())


def read_committed(spark: SparkSession, path: str, schema: T.StructType, exchange: str | None = None, first=None, last=None) -> DataFrame:
    """The rows of the newest commit, of the exchange and days wanted. Folders of other versions, partitions and years are
    not opened."""
    listed = current_manifest(spark, path).select("version", "exchange", "year")
    keys = [T.StructField("version", T.StringType()), T.StructField("exchange", T.StringType()), T.StructField("year", T.IntegerType())]
    declared = T.StructType([f for f in schema.fields if f.name not in ("version", "exchange", "year")] + keys)
    if listed.isEmpty():
        return spark.createDataFrame([], schema)
    df = spark.read.schema(declared).option("basePath", f"{path}/bars").parquet(f"{path}/bars").join(F.broadcast(listed), ["version", "exchange", "year"], "left_semi")  # a row per partition
    if exchange is not None:
        df = df.filter(F.col("exchange") == exchange)
    return between(df, first, last, year_partitioned=True).select(*[f.name for f in schema.fields])


def write_version(spark: SparkSession, path: str, new: DataFrame) -> str:
    """Writes the partitions of ``new``, with the dates of the last commit that it lacks, beside what is there. Nothing
    reads them before ``commit_version``."""
    version, touched = uuid.uuid4().hex, new.select("exchange", F.year("date").alias("year")).distinct()
    old = read_committed(spark, path, new.schema).withColumn("year", F.year("date")).join(touched, ["exchange", "year"], "left_semi")
    write_bars(replace_dates(old.select(*new.columns), new), f"{path}/bars/version={version}")
    return version


def commit_version(spark: SparkSession, path: str, version: str, schema: T.StructType) -> None:
    """Counts and fingerprints what the version's folders hold, and makes them current with one new manifest file."""
    fields = T.StructType([f for f in schema.fields if f.name not in ("exchange", "year")] + [T.StructField("exchange", T.StringType()), T.StructField("year", T.IntegerType())])
    folder = f"{path}/bars/version={version}"
    fresh = partition_manifest(spark.read.schema(fields).option("basePath", folder).parquet(folder).select(*[f.name for f in schema.fields])).withColumn("version", F.lit(version))
    before = current_manifest(spark, path)
    number = (before.agg(F.max("commit")).first()[0] or 0) + 1
    kept = before.join(fresh, ["exchange", "year"], "left_anti").drop("commit")
    fresh.select(*kept.columns).unionByName(kept).coalesce(1).write.parquet(f"{path}/manifest/commit={number}")


def upsert_bars(spark: SparkSession, path: str, new: DataFrame) -> None:
    """Replace the dates of ``new`` in the store at ``path``, which it starts if need be: write beside, count and
    fingerprint, then switch. A reader sees the state before or after, never one between; a run that stops early leaves
    the old state and is simply run again."""
    commit_version(spark, path, write_version(spark, path, new), new.schema)


def verify_committed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Partitions whose files differ from what their commit counted."""
    return verify_manifest(current_manifest(spark, path), partition_manifest(read_committed(spark, path, schema)))


def partition_manifest(df: DataFrame) -> DataFrame:
    """Row count and content fingerprint per (exchange, year). The fingerprint is a sum of row hashes, so it ignores row
    order and, unlike an exclusive or, sees pairs of equal rows."""
    cols = sorted(df.columns)
    return (df.withColumn("year", F.year("date")).groupBy("exchange", "year")
            .agg(F.count("*").alias("n_rows"), F.sum(F.xxhash64(*cols).cast("decimal(20,0)")).cast("decimal(30,0)").alias("fingerprint")))


def verify_manifest(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Partitions that are missing, new, or changed."""
    s = stored.select("exchange", "year", F.col("n_rows").alias("old_rows"), F.col("fingerprint").alias("_of"))
    j = s.join(current, ["exchange", "year"], "full_outer")
    problem = (F.when(F.col("n_rows").isNull(), "missing").when(F.col("old_rows").isNull(), "new").when(F.col("n_rows") != F.col("old_rows"), "row_count")
               .when(F.col("_of") != F.col("fingerprint"), "content"))
    return j.withColumn("problem", problem).filter(F.col("problem").isNotNull()).select("exchange", "year", "old_rows", "n_rows", "problem")


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """Stored source files as (path, length, sha256); only the hash leaves the read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return f.select("path", "length", F.sha2("content", 256).alias("sha256"), "modificationTime")


def dedupe_artifacts(artifacts: DataFrame) -> DataFrame:
    """Per (source, day): number of captures and of different contents; more than one content for a
    known day is reported as a republication."""
    a = artifacts.groupBy("source", "day").agg(F.count("*").alias("n_captures"), F.countDistinct("sha256").alias("n_contents"),
                                               F.max_by("sha256", "captured_at").alias("newest_sha256"))
    return a.withColumn("republished", F.col("n_contents") > 1)
