"""Tables between steps: written below spark.checkpoint.dir, the one place that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Stands in for the shared folder of a session that runs in one process and names none.
_own: str | None = None


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below spark.checkpoint.dir. Only a local session may leave that setting out."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        checkpoint = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = checkpoint.get() if checkpoint.isDefined() else None
    if base is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        global _own
        if _own is None:
            _own = tempfile.mkdtemp(prefix="tidemark-")
            atexit.register(shutil.rmtree, _own, ignore_errors=True)
        base = f"file://{_own}"
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def through_table(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, survives lost executors."""
    path = shared_dir(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.shared_path = path
    return table


def drop_table(table: DataFrame) -> None:
    """Remove a table of through_table() that nothing reads any more."""
    context = table.sparkSession.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(table.shared_path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


#: A hot key's rows are spread over so many copies of its partner row that each copy gets about a cold key's rows, but
#: over no more than this.
MOST_SALTS = 1024


def salted_join(rows: DataFrame, keyed: DataFrame, key: str, count: str, hot_keys: int = 5000) -> DataFrame:
    """Join many rows to one row a key, where `count` tells how many of the rows have that key.

    A key with more than 1 / hot_keys of all counted rows is hot; there are at most hot_keys of them, so their set is
    broadcast and their rows are spread over copies of the key's row, as many as the key has shares of 1 / hot_keys.
    The copies add up to 2 * hot_keys rows at most. `keyed` should be a written table.
    """
    total = keyed.agg(F.sum(count)).first()[0] or 0
    share = max(1, total // hot_keys)
    copies = F.least(F.ceil(F.col(count) / share), F.lit(MOST_SALTS)).cast("int")
    hot = keyed.where(F.col(count) > share).select(key, copies.alias("_salts"))
    spread = keyed.withColumn("_salt", F.explode(F.when(F.col(count) > share, F.sequence(F.lit(0), copies - 1)).otherwise(F.array(F.lit(0)))))
    others = [c for c in rows.columns if c != key]
    salt = F.when(F.col("_salts").isNotNull(), F.pmod(F.xxhash64(*others), F.col("_salts")).cast("int")).otherwise(0)
    return rows.join(F.broadcast(hot), key, "left").withColumn("_salt", salt).drop("_salts").join(spread, [key, "_salt"]).drop("_salt")


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """The rows with `_number`, 1, 2, ... in the order, which should be a total one. Rows are dealt to ranges of the order, numbered in each, and moved up by the ranges before it."""
    placed = through_table(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    moved = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    own = placed.withColumn("_number", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    return own.join(F.broadcast(moved), "_range").withColumn("_number", F.col("_number") + F.col("_before")).drop("_range", "_before")
