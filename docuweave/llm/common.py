"""Helpers that several operators share: tables, shared-folder cuts, salted ranks, UDF shipping."""

from __future__ import annotations

import atexit
import gc
import math
import sys
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ship(module_name: str) -> None:
    """Pickle the functions of a module by value, so executors need not have this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


ship(__name__)

#: Rows in an Arrow batch sent to Python workers: texts may be long, so batches stay short.
ARROW_ROWS = "1000"


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session, for tables that hold long texts; a lower bound stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= int(ARROW_ROWS):
        spark.conf.set(key, ARROW_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; where it is unset, one beside the warehouse's tables."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return where or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/docuweave-shared"


_folders: set[str] = set()


def sweep(spark: SparkSession) -> None:
    """Let go of what finished rounds of a loop left: shuffle files, broadcasts and plans.

    Spark drops them when the driver's garbage is collected, which a driver with few rows of its own
    seldom does by itself; its memory grows meanwhile.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def written(df: DataFrame, *partition_by: str, few: bool = False) -> DataFrame:
    """Cut the lineage: write the rows as Parquet to the shared folder and read them back.

    Unlike ``localCheckpoint`` the files survive lost executors.  They go when the session ends.
    ``few`` is for small rows that come from a shuffle: where the session keeps Spark from coalescing
    partitions by itself, they are dealt to two files a core, since each file costs its task memory
    and, in a local folder, two processes that set its mode.
    """
    spark = df.sparkSession
    if few and spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled") == "false":
        df = df.repartition(2 * spark.sparkContext.defaultParallelism)
    home = f"{shared_dir(spark)}/docuweave-{spark.sparkContext.applicationId}"
    if home not in _folders:
        _folders.add(home)
        atexit.register(_remove, spark, home)
    path = f"{home}/{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm, where = spark.sparkContext._jvm, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        del jvm
    except Exception:  # the session has already ended; the folder belongs to it alone
        pass


def small(df: DataFrame, max_rows: int) -> bool:
    """Whether a table has at most so many rows; reads no more than it must."""
    return df.limit(max_rows + 1).count() <= max_rows


def crc(col: Column | str) -> Column:
    """Unsigned CRC-32 of a value's text."""
    return F.crc32(F.col(col).cast("string").cast("binary") if isinstance(col, str) else col.cast("string").cast("binary"))


def text_key(text: Column) -> list[Column]:
    """128 bits that stand for a text; null counts as the empty text."""
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t).alias("_k1"), F.xxhash64(F.lit("docuweave"), t).alias("_k2")]


def columns_of(df: DataFrame, kinds: dict[str, str]) -> list[np.ndarray]:
    """A small table's columns as arrays, collected by Arrow: no row objects on the driver."""
    table = df.select(*kinds).toArrow()
    return [table.column(c).to_numpy(zero_copy_only=False).astype(k) for c, k in kinds.items()] if table.num_rows else [np.empty(0, k) for k in kinds.values()]


def hot_join(left: DataFrame, right: DataFrame, on: list[str], flag: str) -> DataFrame:
    """Inner join that broadcasts the rows of ``right`` whose ``flag`` is true, of proven few, and shuffles the others.

    Both sides have the boolean ``flag``, equal for equal keys.
    """
    hot = left.where(flag).drop(flag).join(F.broadcast(right.where(flag).drop(flag)), on)
    return hot.unionByName(left.where(f"not {flag}").drop(flag).join(right.where(f"not {flag}").drop(flag), on))


def ranked(df: DataFrame, by: list[str], order: list[str], out: str, rows: int, first: tuple[str, ...] = (), per_task: int = 200_000) -> DataFrame:
    """Add a gapless rank from 0 within the keys ``by`` without gathering a key in one task.

    Each key is dealt over ``rows / per_task`` salts; ranks run inside a salt and are shifted by
    the sizes of the salts before it, so they follow ``order`` inside a salt only.  The columns
    ``first``, of few values, order the salts themselves.  The table of shifts has keys x values
    x salts rows, where salts are at most rows / per_task + 8; the join with it reuses the
    ranks' partitions, or broadcasts it if Spark finds it small enough.  ``df`` is read twice: pass a written table.
    Repeated rows get distinct ranks in any order; they are alike, so the result is the same.
    """
    n = max(8, math.ceil(rows / per_task))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(n)))
    sizes = salted.groupBy(*by, *first, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy(*first, "_salt").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(*by, *first, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = F.row_number().over(Window.partitionBy(*by, *first, "_salt").orderBy(*order))
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*by, *first, "_salt"]]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    left = salted.withColumn("_inside", inside).alias("a")
    joined = left.join(shifts.alias("b"), cond)
    keep = [F.col(f"a.{c}") for c in df.columns]
    return joined.select(*keep, (F.col("a._inside") - 1 + F.col("b._shift")).cast("long").alias(out))
