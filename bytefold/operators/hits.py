"""Analytics over hits and findings; all built-in aggregates with map-side combine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def offset_variance(hits: DataFrame, singles_as_zero: bool = False) -> DataFrame:
    """Sample variance of confidence per offset; null for a single hit unless asked for 0."""
    var = F.var_samp("confidence")
    return hits.groupBy("off").agg((F.coalesce(var, F.lit(0.0)) if singles_as_zero else var).alias("confidence_variance"), F.count(F.lit(1)).alias("hits"))


def key_candidates(hits: DataFrame, min_count: int = 2) -> DataFrame:
    """(offset, type) seen in at least ``min_count`` runs, with runs and libraries counted."""
    return hits.groupBy("off", "secret_type").agg(F.count_distinct("run_id").alias("run_count"), F.count_distinct("library").alias("lib_count")).filter(F.col("run_count") >= min_count)


def cross_library(hits: DataFrame) -> DataFrame:
    """(offset, type) seen in more than one library, with the sorted distinct libraries."""
    return hits.groupBy("off", "secret_type").agg(F.count_distinct("library").alias("lib_count"), F.array_join(F.array_sort(F.collect_set("library")), ",").alias("libraries")).filter("lib_count > 1")


def hit_summary(hits: DataFrame, approximate: bool = False) -> DataFrame:
    """Total hits and distinct offsets, libraries and types."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return hits.agg(F.count(F.lit(1)).alias("total_hits"), *(distinct(c).cast("bigint").alias(f"unique_{n}") for c, n in (("off", "offsets"), ("library", "libraries"), ("secret_type", "types"))))


def presence(rows: DataFrame, row: str, column: str) -> DataFrame:
    """Presence matrix in long form: each (row, column) pair of seen values and whether it occurs.

    Rows and columns are the distinct values; the matrix is closed by one grouping per side.
    """
    seen = rows.filter(F.col(row).isNotNull() & F.col(column).isNotNull()).select(row, column).distinct()
    columns = seen.select(column).distinct().agg(F.array_sort(F.collect_set(column)).alias("c")).scalar()
    return seen.groupBy(row).agg(F.collect_set(column).alias("_has")).select(row, F.explode(columns).alias(column), "_has").select(row, column, F.array_contains("_has", F.col(column)).alias("present"))


def detection_metrics(rows: DataFrame, by: list[str], found: Column, true: Column) -> DataFrame:
    """True and false positives, precision, recall and F1; every ratio of nothing is 0."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), b.cast("double")), F.lit(0.0))
    out = rows.groupBy(*by).agg(n(found & true).alias("tp"), n(found & ~true).alias("fp"), n(~found & true).alias("fn"))
    out = out.withColumn("precision", ratio("tp", F.col("tp") + F.col("fp"))).withColumn("recall", ratio("tp", F.col("tp") + F.col("fn")))
    return out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def xor_diff(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Differing bytes of image pairs ``(…by, off, v)`` over their common length, and their share."""
    both = a.select(*by, "off", F.col("v").alias("x")).join(b.select(*by, "off", F.col("v").alias("y")), [*by, "off"])
    changed = F.sum(F.when(F.col("x").bitwiseXOR(F.col("y")) != 0, 1).otherwise(0)).cast("bigint")
    return both.groupBy(*by).agg(F.count(F.lit(1)).alias("compared"), changed.alias("different")).withColumn("percent", F.coalesce(F.try_divide(F.col("different") * F.lit(100.0).cast("double"), F.col("compared")), F.lit(0.0)))


def static_mask(rows: DataFrame, by: list[str]) -> DataFrame:
    """Offsets at which all images that reach them hold one value."""
    return rows.groupBy(*by, "off").agg((F.min("v") == F.max("v")).alias("is_static"))


def classify_runs(rows: DataFrame, by: list[str], run: str, key_start: int, key_length: int) -> DataFrame:
    """Bytes of a known-key window over several runs as key, same or different; missing bytes count as 0.

    All runs equal the first exactly when least and largest value are equal, so no run is joined
    to another; a run without the byte adds a 0.
    """
    runs = rows.groupBy(*by).agg(F.count_distinct(run).alias("_runs"))
    n = rows.groupBy(*by, "off").agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"), F.count_distinct(run).alias("_n")).join(runs, by)
    low = F.when(F.col("_n") < F.col("_runs"), F.lit(0)).otherwise(F.col("_lo"))
    role = F.when((F.col("off") >= key_start) & (F.col("off") < key_start + key_length), "key").when(low == F.col("_hi"), "same").otherwise("different")
    return n.select(*by, "off", role.alias("role"))


def confidence_rollup(matches: DataFrame, by: list[str]) -> DataFrame:
    """Overall confidence of an algorithm's matches: best, count bonus, and the two together."""
    best, n = F.max("confidence"), F.count(F.lit(1))
    return matches.groupBy(*by).agg(best.alias("best"), n.alias("matches")).withColumn("by_count", F.least(F.col("matches") / 10.0, F.lit(1.0))).withColumn("overall", F.round(F.least(F.col("best") + F.least(F.col("matches") / 20.0, F.lit(0.3)), F.lit(1.0)), 4))


def latest(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The last row of each key: the view on a store that only appends."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")
