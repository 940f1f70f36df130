"""Continuous forms: postings that arrive as files are merged batch by batch, scrape outcomes are counted in windows."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import jobs as J


def postings_stream(spark: SparkSession, folder: str, schema: str = "site_name string, url string, title string, description string, arrival long, seen_at timestamp") -> DataFrame:
    """Postings from Parquet files that appear in a folder; repeats of a url within the watermark are dropped."""
    rows = spark.readStream.schema(schema).parquet(folder)
    return rows.withWatermark("seen_at", "1 day").dropDuplicatesWithinWatermark(["url"])


def _store(spark: SparkSession, path: str):
    """The Hadoop path and file system of a path, whatever its store."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _read(spark: SparkSession, path: str) -> dict:
    """A small JSON file of any store; empty if there is none."""
    where, store = _store(spark, path)
    if not store.exists(where):
        return {}
    source = store.open(where)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
    finally:
        source.close()


def current(spark: SparkSession, table: str) -> dict:
    """What the table's pointer says: the number of the newest whole version, and the batch that made it."""
    return _read(spark, f"{table}/current")


def _point(spark: SparkSession, table: str, said: dict) -> None:
    """Name a version as current: the pointer is written beside and then moved over the old one."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    new, store = _store(spark, f"{table}/current.new")
    out = store.create(new, True)
    out.write(json.dumps(said).encode())
    out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri() if new.toUri().getScheme() else store.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(store.makeQualified(new), store.makeQualified(jvm.org.apache.hadoop.fs.Path(f"{table}/current")), options)


def read_current(spark: SparkSession, table: str) -> DataFrame:
    """The table's newest whole version; empty before the first."""
    said = current(spark, table)
    return spark.read.schema(schemas.JOBS).parquet(f"{table}/v{said['version']}") if said else spark.createDataFrame([], schemas.JOBS)


def merge_into(table: str, checkpoint: str, now: dt.datetime | None = None):
    """A foreachBatch function that merges a batch into a versioned table of postings, in any store that Spark reads.

    A batch writes the next version beside the current one, then moves the pointer. A batch that runs again before that
    writes the same version again; one that runs again after it is known by the query's id and its number, and does
    nothing. So a new checkpoint, whose numbers start again, goes on from what is stored. Versions before the last are
    removed.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        if batch.isEmpty():
            return
        said, made_by = current(spark, table), f"{_read(spark, f'{checkpoint}/metadata').get('id')}:{epoch}"
        if said.get("batch") == made_by:
            return
        at = now or dt.datetime.now(dt.UTC).replace(tzinfo=None)
        version = said.get("version", -1) + 1
        old, rows = read_current(spark, table), batch.withColumn("position", F.col("arrival"))
        accepted = J.accept_new(rows, old, at.date())
        J.mark_seen(J.insert(old, accepted, at), rows.select("url"), at).write.mode("overwrite").parquet(f"{table}/v{version}")
        _point(spark, table, {"version": version, "batch": made_by})
        before, store = _store(spark, f"{table}/v{version - 2}")
        store.delete(before, True)

    return merge


def ingest_available(spark: SparkSession, folder: str, table: str, checkpoint: str, now: dt.datetime | None = None) -> DataFrame:
    """Merge what has arrived so far and stop. Returns the table's newest version."""
    query = postings_stream(spark, folder).writeStream.foreachBatch(merge_into(table, checkpoint, now)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return read_current(spark, table)


def ingest_continuously(spark: SparkSession, folder: str, table: str, checkpoint: str, every: str = "1 day"):
    """The scheduled form: a first merge at once, then one each interval, until the returned query is stopped."""
    stream = postings_stream(spark, folder).writeStream.foreachBatch(merge_into(table, checkpoint))
    return stream.option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def health_windows(outcomes: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Attempts and failures of each site in tumbling windows; outcomes has site_name, scrape_date, success."""
    rows = outcomes.withWatermark("scrape_date", late)
    return rows.groupBy(F.window("scrape_date", width).alias("window"), "site_name").agg(F.count(F.lit(1)).alias("attempts"), F.count_if(~F.col("success")).alias("failures"))
