"""Readers and writers: wide panels, square matrices, edge lists, entity dimensions, and the star-schema panels."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.checks import require_consistent, require_square
from ..functions.scalars import canonical, normalize_code, pad_code, positive_only, resolve_column


def _header(spark: SparkSession, path: str) -> list[str]:
    return spark.read.text(path).first()[0].lstrip("﻿").split(",")


def _csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema, encoding="UTF-8", mode="FAILFAST", enforceSchema=True)


def read_wide_panel(spark: SparkSession, path: str) -> DataFrame:
    """(t, entity, value) of a CSV with a date column and one numeric column for each entity."""
    names = _header(spark, path)
    df = _csv(spark, path, T.StructType([T.StructField("t", T.DateType()), *[T.StructField(c, T.DoubleType()) for c in names[1:]]]))
    long = df.unpivot("t", names[1:], "entity", "value")
    return long.withColumn("entity", pad_code("entity"))


def read_matrix(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """(row, col, value) of a square CSV matrix with a key column."""
    names = _header(spark, path)
    df = _csv(spark, path, T.StructType([T.StructField("row", T.StringType()), *[T.StructField(c, T.DoubleType()) for c in names[1:]]]))
    long = df.unpivot("row", names[1:], "col", "value").select(normalize_code("row").alias("row"), normalize_code("col").alias("col"), "value")
    if check:
        require_square(long)
    return long


def read_table(spark: SparkSession, path: str, kinds: dict[str, str] | None = None, codes: tuple[str, ...] = ("code", "stock_1", "stock_2")) -> DataFrame:
    """CSV with string keys: every column is text unless kinds names another type; key columns are normalised."""
    names, kinds = _header(spark, path), kinds or {}
    df = _csv(spark, path, T.StructType([T.StructField(c, T.StringType()) for c in names]))
    return df.select(*[(normalize_code(c) if c in codes else F.col(f"`{c}`").cast(kinds.get(c, "string"))).alias(c) for c in names])


def read_edges(spark: SparkSession, path: str, weight: str) -> DataFrame:
    """(e1, e2, weight) of an edge-list CSV, smaller key first."""
    df = read_table(spark, path, {weight: "double"})
    a, b = canonical(resolve_column(df, ["stock_1", "e1", "source"]), resolve_column(df, ["stock_2", "e2", "target"]))
    return df.select(a.alias("e1"), b.alias("e2"), F.col(weight).alias("weight"))


def read_optional(spark: SparkSession, path: str, fallback, **options) -> DataFrame:
    """The table if the path exists (on any file system of Spark's), else fallback()."""
    try:
        spark.read.text(path).schema  # noqa: B018  resolves the path
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return fallback()
    return read_table(spark, path, **options)


def entities_of_edges(edges: DataFrame) -> DataFrame:
    """Fallback dimension (entity, name, grp) from both ends' attributes; conflicts raise."""
    side = lambda k: edges.select(F.col(f"e{k}").alias("entity"), F.col(f"name_{k}").alias("name"), F.col(f"grp_{k}").alias("grp"))
    both = side(1).unionByName(side(2))
    require_consistent(both, "entity", ["name", "grp"])
    return both.dropDuplicates(["entity"])


def write_csv(df: DataFrame, path: str, mark: bool = True) -> None:
    """CSV files with a header, in UTF-8; each begins with a byte-order mark, as spreadsheets want it."""
    first, *rest = df.columns
    named = df.withColumnRenamed(first, "\ufeff" + first) if mark else df
    named.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def write_wide(long: DataFrame, path: str) -> None:
    write_csv(long.groupBy("t").pivot("entity").agg(F.first("value")).orderBy("t"), path)


# --- ingest ----------------------------------------------------------------------------------------------------


def last_per_date(bars: DataFrame, sequence: str) -> DataFrame:
    """One row for each entity and date: the last by sequence."""
    w = W.partitionBy("entity", "t").orderBy(F.col(sequence).desc())
    return bars.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def on_spine(panel: DataFrame) -> DataFrame:
    """(t, k, entity, value): every entity at every date of the panel; k numbers the dates from 1."""
    dates = panel.select("t").distinct().withColumn("k", F.row_number().over(W.orderBy("t")))
    grid = dates.join(panel.select("entity").distinct())
    return grid.join(panel.select("t", "entity", "value"), ["t", "entity"], "left").select("t", "k", "entity", positive_only("value").alias("value"))


def coverage_profile(spine: DataFrame) -> DataFrame:
    """Per entity: n_obs, first and last date, n_missing, coverage over the spine."""
    known = F.when(F.col("value").isNotNull(), F.col("t"))
    return spine.groupBy("entity").agg(
        F.count("value").alias("n_obs"), F.min(known).alias("first_date"), F.max(known).alias("last_date"),
        (F.count(F.lit(1)) - F.count("value")).alias("n_missing"), (F.count("value") / F.count(F.lit(1))).alias("coverage"),
    )


def covered(spine: DataFrame, least: float = 0.95) -> DataFrame:
    kept = coverage_profile(spine).filter(F.col("coverage") >= least).select("entity")
    return spine.join(kept, "entity", "left_semi")


# --- panels of the star schema ---------------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def brand_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly revenue by brand, without the cut-off last month."""
    items = table(spark, sf_dir, "lineitem").select("l_partkey", "l_extendedprice", F.date_trunc("month", "l_shipdate").cast("date").alias("t"))
    brands = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("entity"))
    # revenue is summed by part before the join, so the join's rows don't grow with lineitem
    by_part = items.groupBy("l_partkey", "t").agg(F.sum("l_extendedprice").alias("v"))
    panel = by_part.join(brands, "l_partkey").groupBy("t", "entity").agg(F.sum("v").alias("value"))
    return panel.join(panel.agg(F.max("t").alias("last")), F.col("t") < F.col("last")).drop("last")


def brand_groups(panel: DataFrame, groups: int = 5) -> DataFrame:
    """(entity, grp): the brand's number modulo ``groups``."""
    number = F.regexp_extract("entity", r"(\d+)", 1).cast("int")
    return panel.select("entity").distinct().select("entity", (number % groups).cast("string").alias("grp"))


def event_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily value by event type."""
    return table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("t"), F.col("event_type").alias("entity")).agg(F.sum("value").alias("value"))


def embedding_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, entity, value, grp): dimensions as observations, vectors as entities, labels as groups."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").cast("string").alias("entity"), F.col("label").cast("string").alias("grp"), F.posexplode("embedding").alias("t", "value")).withColumn("value", F.col("value").cast("double"))
