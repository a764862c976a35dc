"""Session helpers: shared working folder, materialised tables, size-checked broadcast."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Tables whose estimated size is at most this may be broadcast.
BROADCAST_BYTES = 8 << 20


def local_session(cpus: int | str = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lodestone")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as named in ``spark.checkpoint.dir``.

    Only where that setting is absent and all runs on one machine (tests) a
    temporary folder is made, set as the checkpoint folder, and deleted at exit.
    """
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def require_space(spark: SparkSession, path: str, gigabytes: float = 250.0) -> float:
    """The free GB of the file system of a path; an error if there are fewer than asked."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    free = p.getFileSystem(spark._jsc.hadoopConfiguration()).getStatus(p).getRemaining() / 1e9
    if free < gigabytes:
        raise OSError(f"{free:.1f} GB are free at {path}; {gigabytes} are needed")
    return free


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/lodestone/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


#: Spark's setting by which the shuffle files of an execution go when it ends.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _no_shuffle_left(spark: SparkSession) -> Iterator[None]:
    """Within, no shuffle file outlives the execution that made it."""
    before = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEAN_UP)
        else:
            spark.conf.set(_CLEAN_UP, before)


#: Spark's setting of the bytes of a batch that goes to Python, and a size for wide rows.
_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Within, batches that go to Python hold ``BATCH_BYTES`` at most, or one row."""
    before = spark.conf.get(_BATCH, None)
    spark.conf.set(_BATCH, BATCH_BYTES)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_BATCH)
        else:
            spark.conf.set(_BATCH, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it again.

    Cuts lineage in a way that survives the loss of any executor.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    with _no_shuffle_left(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``df`` has, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def number_rows(df: DataFrame, *order: Column | str, name: str = "number") -> DataFrame:
    """Add the position of each row, from 0, in a total order of all rows.

    The rows are sorted by ranges and written once; positions within a
    partition are offset by the sizes of those before it (a row each), so that
    no task sees all rows.
    """
    rows = materialize(df.orderBy(*order).withColumn("__id", F.monotonically_increasing_id()), "numbered").withColumn("__part", F.shiftright("__id", 33))
    before = F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = rows.groupBy("__part").count().withColumn("__before", before).drop("count")
    within = F.col("__id").bitwiseAND((1 << 33) - 1)
    return rows.join(F.broadcast(offsets), "__part").withColumn(name, within + F.col("__before")).drop("__id", "__part", "__before")


def running_total(df: DataFrame, by: str, order: str, value: Column, name: str) -> DataFrame:
    """Add the sum of ``value`` over the rows before, within groups of ``by`` in the order of ``order``.

    The rows are sorted by ranges and written once; a group that spans many
    ranges is summed up in each, offset by its sums in those before it, so that
    no task sees a whole group.
    """
    part, held, before, own = fresh(df.withColumn(name, F.lit(0)), "part", "held", "before", "own")
    rows = df.withColumn(own, value).orderBy(by, order).withColumn(part, F.shiftright(F.monotonically_increasing_id(), 33))
    rows = materialize(rows, "running")
    earlier = F.coalesce(F.sum(held).over(Window.partitionBy(by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a row for each range and the groups that it has, most of which are in one range alone
    sums = rows.groupBy(by, part).agg(F.sum(own).alias(held)).select(by, part, earlier.alias(before))
    within = F.sum(own).over(Window.partitionBy(by, part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.withColumnRenamed(by, held).withColumnRenamed(part, f"{part}2")
    out = rows.withColumn(name, F.coalesce(within, F.lit(0)))
    out = out.join(sums, (out[by].eqNullSafe(sums[held])) & (out[part] == sums[f"{part}2"]))
    return out.withColumn(name, F.col(name) + F.col(before)).drop(own, part, before, held, f"{part}2")


def drop(df: DataFrame) -> None:
    """Delete the files of a table that :func:`materialize` returned."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        drop_path(spark, path)


def drop_path(spark: SparkSession, path: str) -> None:
    if "/lodestone/" not in path:
        raise ValueError(f"not a working path: {path}")
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: A table of at most so many bytes may be a single row group, which is one task.
SPREAD_BYTES = 64 << 20


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table. A small one is dealt out to all cores; larger ones stay in the splits of their scan."""
    df = spark.read.parquet(path)
    return df.repartition(parallelism(spark)) if estimated_bytes(df) <= SPREAD_BYTES else df


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan, without running it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only if the estimated size is within ``limit``; else leave the join to Catalyst."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
