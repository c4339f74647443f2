"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words as maximal runs without ASCII white space.
SPACED_WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. A text of ASCII characters takes the fast built-in, which does the same there."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_count(text: Column) -> Column:
    """Number of words between ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_WORD)), F.lit(0)).cast("long")


def bucket_of_id(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def _shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir. Where none is set, a local session gets a temporary
    folder; on a cluster executors could not read one, so that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or _own_folder.get("path")
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = _own_folder["path"] = tempfile.mkdtemp(prefix="checkpoint-")
    return named


_own_folder: dict[str, str] = {}


def cut(df: DataFrame) -> DataFrame:
    """Ends the lineage: the rows are written once to a table in the shared folder and read from there, so a lost executor
    costs no more than a read. Unlike a checkpoint the table is compressed and hands no constraints of its plan on, which
    would grow from round to round in a loop. The tables stay until the folder is cleared."""
    path = f"{_shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Keys that are sent to every task at most: some 20 MB.
FEW = 1_000_000


def rows_with(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """The rows of df whose key is among the keys. The keys are counted: up to FEW of them go to every task, so df is not
    shuffled for them; more are joined by a shuffle."""
    keys = cut(keys.select(on).distinct())
    return df.join(F.broadcast(keys) if keys.count() <= FEW else keys, on, "left_semi")


def smallest_hashes(df: DataFrame, group: str, id_col: str, most: int, slots: int = 4096) -> DataFrame:
    """At most `most` rows of each group: those with the smallest hash of the id.

    Counts by slot of the hash tell where a group's sample ends, so only about as many rows as are wanted meet in the
    task that ranks them, whatever the group's size."""
    rows = df.withColumn("hash", F.xxhash64(F.lit("fit"), id_col)).withColumn("slot", F.shiftrightunsigned("hash", 1) / F.lit(2**63 // slots))
    rows = rows.withColumn("slot", F.floor("slot"))
    upto = Window.partitionBy(group).orderBy("slot")
    ends = rows.groupBy(group, "slot").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.sum("n").over(upto) - F.col("n"))
    ends = ends.filter(F.col("before") < most).groupBy(F.col(group).alias("of")).agg(F.max("slot").alias("end"))
    near = rows.join(ends, F.col(group) == F.col("of")).filter("slot <= end")
    rank = F.row_number().over(Window.partitionBy(group).orderBy("slot", "hash", id_col))
    return near.withColumn("rank", rank).filter(F.col("rank") <= most).select(*df.columns)


def free_name(name: str, taken: Iterable[str]) -> str:
    """The name, longer where a column has it already."""
    taken = {t.lower() for t in taken}
    while name.lower() in taken:
        name += "_"
    return name


def whole_rows(df: DataFrame, **keys: Column) -> DataFrame:
    """The row as one struct, with key columns beside it whose names can't clash with the row's own."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(k) for k, c in keys.items()])


def unwrap(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col("row")[c].alias(c) for c in columns])


_shipped: set[str] = set()


def ship(df: DataFrame) -> DataFrame:
    """Gives Python workers this package, once per application, as spark-submit --py-files would."""
    sc = df.sparkSession.sparkContext
    if sc.applicationId not in _shipped:
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        name = os.path.basename(package)
        sc.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(), name), "zip", os.path.dirname(package), name))
        _shipped.add(sc.applicationId)
    return df


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, which gives the memory that it freed back to the system when its task ends. Workers are used again
    by later stages, and the allocators else keep it for them, beside an executor's heap that is full by then."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim is not None:
                trim(0)

    return task
