"""Hand-kept lists: site registry, candidates, rejected sites, batches, review files; and the tables of the pipeline.

Text files keep their line order as `position`. Sites are few, so the lists are read as single files.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import text as X
from tidemark.tables import numbered


def lines(spark: SparkSession, path: str) -> DataFrame:
    """position and value of each line; a missing file has none."""
    try:
        whole = spark.read.text(path, wholetext=True)
    except AnalysisException:
        return spark.createDataFrame([], "position int, value string")
    return whole.select(F.posexplode(F.split("value", r"\r?\n")).alias("position", "value"))


def read_csv(spark: SparkSession, path: str) -> DataFrame | None:
    """A CSV with its header and a position; None if the file is missing."""
    try:
        rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    except AnalysisException:
        return None
    return rows.coalesce(1).withColumn("position", F.monotonically_increasing_id())


def valid_sites(rows: DataFrame) -> DataFrame:
    """Registry rows (with position) that are active and named, the first of each trimmed url."""
    if not {"site_name", "url", "active"} <= set(rows.columns):
        return rows.sparkSession.createDataFrame([], schemas.SITES).withColumn("position", F.lit(0).cast("long"))
    for name in ("keywords", "scrape_details"):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("string"))
    first = Window.partitionBy("_url").orderBy("position")
    kept = rows.where(F.lower("active").isin("yes", "true", "1")).withColumn("_url", X.strip(F.col("url")))
    kept = kept.where(X.blank(F.col("_url")).isNotNull() & X.blank(X.strip(F.col("site_name"))).isNotNull())
    return kept.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(*(f.name for f in schemas.SITES), "position")


def sites(spark: SparkSession, path: str) -> DataFrame:
    """The registry; empty if the file is missing or lacks a needed column."""
    rows = read_csv(spark, path)
    if rows is None:
        return valid_sites(spark.createDataFrame([], "x string"))
    return valid_sites(rows)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Candidates with position; columns that older files lack are empty."""
    rows = read_csv(spark, path)
    if rows is None:
        rows = spark.createDataFrame([], schemas.CANDIDATES).withColumn("position", F.lit(0).cast("long"))
    return rows.select(*((F.coalesce(F.col(f.name), F.lit("")) if f.name in rows.columns else F.lit("")).alias(f.name) for f in schemas.CANDIDATES), "position")


def rejected(listed: DataFrame) -> DataFrame:
    """name and url of rejected sites, from lines: comments and rules are skipped, a note in brackets is cut off."""
    line = X.strip(F.col("value"))
    own = listed.where((line != "") & ~line.startswith("#") & ~line.startswith("==")).withColumn("_l", line)
    split = F.instr("_l", " - ")
    url = F.regexp_replace(X.strip(F.expr("substring(_l, instr(_l, ' - ') + 3)")), r"(?U)\s*\([^)]*\)\s*$", "")
    return own.select("position", F.when(split > 0, X.strip(F.expr("left(_l, instr(_l, ' - ') - 1)"))).otherwise(F.col("_l")).alias("name"), F.when(split > 0, url).alias("url"))


def batch(listed: DataFrame) -> DataFrame:
    """position, name, url, description of a batch's lines: parts by ' - ', else by comma."""
    line = X.strip(F.col("value"))
    own = listed.where((line != "") & ~line.startswith("#")).withColumn("_l", line)
    dashed = F.col("_l").contains(" - ")
    parts = F.when(dashed, F.split("_l", " - ")).when(F.col("_l").contains(","), F.split("_l", ","))
    own = own.withColumn("_p", parts).where("_p is not null and size(_p) >= 2")
    return own.select("position", X.strip(F.get("_p", 0)).alias("name"), X.strip(F.get("_p", 1)).alias("url"), F.coalesce(X.strip(F.get("_p", 2)), F.lit("")).alias("description"))


def suggestions(listed: DataFrame) -> DataFrame:
    """name and url of suggestions: 'Name - URL' or a name alone."""
    line = X.strip(F.col("value"))
    own = listed.where((line != "") & ~line.startswith("#")).withColumn("_l", line)
    dash = F.instr("_l", " - ")
    return own.select("position", F.when(dash > 0, X.strip(F.expr("left(_l, instr(_l, ' - ') - 1)"))).otherwise(F.col("_l")).alias("name"), F.when(dash > 0, X.strip(F.expr("substring(_l, instr(_l, ' - ') + 3)"))).otherwise("").alias("url"))


def review_decisions(listed: DataFrame) -> DataFrame:
    """id and approved of a review file's checkbox lines; a checked line wins."""
    yes = F.regexp_extract("value", r"^- \[[xX]\] \*\*(\d+)\.\s", 1)
    no = F.regexp_extract("value", r"^- \[ \] \*\*(\d+)\.\s", 1)
    rows = listed.select(F.coalesce(X.blank(yes), X.blank(no)).alias("id"), (yes != "").alias("approved")).where("id is not null")
    return rows.groupBy("id").agg(F.bool_or("approved").alias("approved"))


def parser_configs(rows: DataFrame) -> DataFrame:
    """The newest parser configuration of each site."""
    newest = Window.partitionBy("site_name").orderBy(F.desc("id"))
    return rows.withColumn("_n", F.row_number().over(newest)).where("_n = 1").select("site_name", "parser_config")


def upsert_config(rows: DataFrame, new: DataFrame) -> DataFrame:
    """Configurations of the named sites replaced, others kept; replaced ones get new ids."""
    start = F.broadcast(rows.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_s")))
    own = numbered(new, [F.col("site_name")]).join(start).withColumn("id", (F.col("_s") + F.col("_number")).cast("long"))
    return rows.join(new.select("site_name"), "site_name", "left_anti").select(*rows.columns).unionByName(schemas.conform(own, rows.schema))


def with_config(site_rows: DataFrame, configs: DataFrame) -> DataFrame:
    """Sites with their stored parser configuration, null where there is none."""
    return site_rows.join(parser_configs(configs), "site_name", "left")
