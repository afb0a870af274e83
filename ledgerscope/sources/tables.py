"""Tables that a run writes to the shared folder, to cut lineage and to be read more than once."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

T = TypeVar("T")
#: Tables of one run that are written at the same time, so that small ones don't leave executors idle.
AT_ONCE = 6


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder on a single machine, an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def write(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet under a fresh path and read back."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def at_once(names: Iterable[str], act: Callable[[str], T]) -> dict[str, T]:
    """``act`` of each of ``names``, of some at a time."""
    names = list(names)
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return dict(zip(names, pool.map(act, names)))


def write_all(spark: SparkSession, tables: Mapping[str, Callable[[], DataFrame]]) -> dict[str, DataFrame]:
    """What each of ``tables`` makes, written and read back, some planned and written at a time."""
    shared_folder(spark)
    return at_once(tables, lambda name: write(tables[name](), name))


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with ``name``, its rows' number from 1 in ``order``, without one task that sorts them all.

    Rows are dealt to ranges of the order and written with their range; the rows of earlier ranges
    are added to the number within the range. Only the ranges' sizes meet in one task.
    """
    ranged = write(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "numbered")
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__c"))
    earlier = F.sum("__c").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    before = sizes.select("__part", F.coalesce(earlier, F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) + F.col("__before")
    return ranged.join(F.broadcast(before), "__part").withColumn(name, place.cast("long")).drop("__part", "__before")
