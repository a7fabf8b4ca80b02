"""Shared scratch space and pieces of Spark plumbing that several operators use.

Lineage is cut by writing a table into the folder that ``spark.checkpoint.dir``
names, which the driver and all executors see; a lost executor then costs only
the tasks it ran.  Where the setting is absent a temporary folder is set instead
if the session is local, as in unit tests; on a cluster that is an error, since
executors would not see each other's files.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables, as a URI that Spark resolves."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="sparkgrid-scratch-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/sparkgrid"


def stored(df: DataFrame, label: str, codec: str | None = None, options: dict[str, int] | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return a read of it.

    ``codec`` is Parquet's, the session's if none; ``options`` are the writer's.
    """
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path, compression=codec)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing will read again."""
    for table in tables:
        jvm = table.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(table.scratch_path)
        path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_side(df: DataFrame, max_rows: int = 200_000, max_bytes: int = 32 << 20) -> DataFrame:
    """``df`` with a broadcast hint if it was counted to be small, else as it is.

    ``df`` should be a stored table: it is read once to be measured.  Beyond the
    bound the join that follows is a shuffled one, which AQE splits where a key
    is hot; both ways give the same rows.
    """
    texts = [F.coalesce(F.length(F.col(f"`{n}`").cast("string")), F.lit(0)) for n in df.columns]
    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(sum(texts, F.lit(8))), F.lit(0))).first()
    return F.broadcast(df) if rows <= max_rows and size <= max_bytes else df


def ordered_prefix(df: DataFrame, order: Sequence[Column], sums: dict[str, Column], label: str, deal: Sequence[Column] | None = None) -> DataFrame:
    """Add, for each name in ``sums``, the sum of that column over all rows up to
    and including this one in the order of ``order``.

    No task sees more than one range of the rows: the table is dealt by range
    (a unique last key splits runs of equal rows), summed within each range, and
    the ranges' totals, one row for each, are then summed over.  ``deal`` are other
    keys for the ranges, which must go by the order: Spark brings a sample of the
    keys to the driver, so they should be short.
    """
    ranged = (
        df.withColumn("_uid", F.monotonically_increasing_id())
        .repartitionByRange(*(deal or (*order, F.col("_uid"))))
        .withColumn("_range", F.spark_partition_id())
    )
    kept = stored(ranged.select("*", *[c.cast("long").alias(f"_v_{n}") for n, c in sums.items()]), label)
    total = kept.groupBy("_range").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = total.select("_range", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums])
    inside = Window.partitionBy("_range").orderBy(*order, F.col("_uid"))
    here = kept.select("*", *[F.sum(f"_v_{n}").over(inside).alias(f"_s_{n}") for n in sums])
    out = here.join(base, "_range")
    return out.select(*df.columns, *[(F.col(f"_b_{n}") + F.col(f"_s_{n}")).alias(n) for n in sums])


def unused(name: str, columns: Sequence[str]) -> str:
    """``name``, or with underscores before it a name that none of the columns bears, in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name
