"""Helpers for the operators: the shared folder, tables written to cut lineage, column hygiene."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1000
#: Lets a finished query drop its own shuffle files.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``).

    Where the session names none, a single machine gets a temporary folder and a cluster an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once, so that their Python workers can import it.

    Texts are long, so Arrow batches of the session are set to ``BATCH_ROWS`` rows where they have
    Spark's default size; a worker's memory then holds few texts at a time.
    """
    if spark.conf.get(_BATCH, "10000") == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    sc = spark.sparkContext
    if getattr(sc, "_ledgerscope_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="spark-")) / f"{package.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(path))
    sc._ledgerscope_shipped = True


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """The session with ``key`` set to ``value`` meanwhile; a table is planned when it is written."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


#: Paths of the tables that ``scratch`` deletes at its end.
_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def materialize(df: DataFrame, name: str, kept: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back, which cuts its lineage.

    The shuffle files of the write are dropped as soon as it ends: the table replaces them, and
    a lost executor costs a reread of the table, not a rerun of the plan. A ``kept`` table outlives
    ``scratch``.
    """
    spark = df.sparkSession
    ship(spark)
    path = shared_path(spark, name)
    if not kept and _SCRATCH.get() is not None:
        _SCRATCH.get().append(path)
    with setting(spark, _CLEANUP, "true"):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Delete the written table that ``df`` reads; nothing may read it any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete, at its end, the tables written within, but for ``kept`` ones; nothing may read them any more."""
    made: list[str] = []
    token = _SCRATCH.set(made)
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        for folder in made:
            _delete(spark, folder)


#: Bits of the filter of ``maybe_in`` for each value, and the most that it has (8 MB, four bits for each of 16 million values).
FILTER_BITS, FILTER_MOST = 8, 1 << 26


def maybe_in(hashed: Column, few: DataFrame) -> Column:
    """Whether a 64-bit hash can be among those of the written table ``few``, of one column: false for nearly all others, never for its own.

    A Bloom filter of two bits a value, as an array of 4,096 longs at most a row, which goes to the
    tasks as one value. With it, a join on a few keys shuffles few of the other side's texts.
    """
    words = min(FILTER_MOST, 1 << max(12, (FILTER_BITS * few.count() - 1).bit_length())) // 64
    place = lambda h: (F.shiftrightunsigned(h, 38), F.shiftrightunsigned(h, 12).bitwiseAND((1 << 26) - 1))
    word = lambda at: at.bitwiseAND(words - 1).cast("int")
    bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(at, 20).cast("int"))
    held = few.select(F.explode(F.array(*place(F.col(few.columns[0])))).alias("at")).select(word(F.col("at")).alias("word"), bit(F.col("at")).alias("bits"))
    every = held.unionAll(few.sparkSession.range(words).select(F.col("id").cast("int"), F.lit(0).cast("long"))).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    rows = every.groupBy(F.floor(F.col("word") / 4096).alias("k")).agg(F.sort_array(F.collect_list(F.struct("word", "bits")))["bits"].alias("part"))
    whole = rows.agg(F.flatten(F.sort_array(F.collect_list(F.struct("k", "part")))["part"])).scalar()
    first, second = (F.get(whole, word(at)).bitwiseAND(bit(at)) != 0 for at in place(hashed))
    return first & second


def with_columns(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """Add columns; a column of the same name (in any case) in ``df`` gives way."""
    names = {n.lower() for n in new}
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in names]
    return df.select(*kept, *[c.alias(n) for n, c in new.items()])


def docs_like(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` restricted to ``columns``, in that order."""
    return df.select(*[F.col(f"`{c}`") for c in columns])
