"""Views of results: filters, orders, pages and limits as a user asks for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most offsets that one read of classes gives.
RANGE_LIMIT = 16_384
# Columns that results can be ordered by.
SORTABLE = {"offset": "off", "confidence": "confidence", "length": "length", "algorithm": "algorithm"}


def of_algorithms(matches: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Matches of some algorithms; without names all of them."""
    return matches if names is None else matches.filter(F.col("algorithm").isin(names))


def counts_by_algorithm(matches: DataFrame) -> DataFrame:
    """Matches per algorithm: ``algorithm, hits``."""
    return matches.groupBy("algorithm").agg(F.count(F.lit(1)).alias("hits"))


def containing(strings: DataFrame, text: str, column: str = "value") -> DataFrame:
    """Strings that hold a text, whatever the case; an empty text holds in all."""
    return strings if not text else strings.filter(F.contains(F.lower(column), F.lower(F.lit(text))))


def ordered(matches: DataFrame, by: str = "offset", descending: bool = False) -> DataFrame:
    """Matches in an order of ``SORTABLE``; equal ones by image, offset, length and label, so it is one order."""
    if by not in SORTABLE:
        raise ValueError(f"results are ordered by one of {sorted(SORTABLE)}")
    c = F.col(SORTABLE[by])
    rest = [n for n in ("dump_id", "off", "length", "label", "algorithm") if n in matches.columns and n != SORTABLE[by]]
    return matches.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), *rest)


def best_first(matches: DataFrame) -> DataFrame:
    """Matches of highest confidence first, equal ones by offset."""
    return ordered(matches, "confidence", descending=True)


def first_of_each(rows: DataFrame, by: list[str], order: list[Column | str], limit: int) -> DataFrame:
    """The first ``limit`` rows of each group (Spark keeps each task's own first ones before the exchange)."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("_n", n).filter(F.col("_n") <= limit).drop("_n")


def next_page(rows: DataFrame, cursor: int | None, limit: int, order: str = "off") -> DataFrame:
    """The rows behind a cursor, in order; the last one's ``order`` is the next cursor."""
    behind = rows if cursor is None else rows.filter(F.col(order) > cursor)
    return behind.orderBy(order).limit(limit)


def class_range(consensus: DataFrame, start: int, length: int) -> DataFrame:
    """Classes of a range of offsets; a range over ``RANGE_LIMIT`` or a negative one is refused."""
    if start < 0 or not 0 < length <= RANGE_LIMIT:
        raise ValueError(f"a range of 1 to {RANGE_LIMIT} offsets")
    return consensus.filter(F.col("off").between(start, start + length - 1)).select("off", "class")


def byte_shares(consensus: DataFrame, by: list[str], threshold: float = 2000.0) -> DataFrame:
    """Offsets at or below a variance (static) and above it (dynamic)."""
    low = F.col("variance") <= threshold
    return consensus.groupBy(*by).agg(F.sum(low.cast("bigint")).alias("static"), F.sum((~low).cast("bigint")).alias("dynamic"))


def where_equal(rows: DataFrame, **values) -> DataFrame:
    """Rows whose columns equal all the given values (null equals null)."""
    for column, value in values.items():
        rows = rows.filter(F.col(column).eqNullSafe(F.lit(value)))
    return rows
