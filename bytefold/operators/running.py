"""Running positions, sums and last values of groups of any size.

A window over a group gathers the group in one task.  Here the rows are sorted by group and order
over all tasks; each task runs over its own stretch, and only what the first group of a stretch
brings along from the stretches before, one row per task, is added afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bytefold.session import materialize


def running(df: DataFrame, by: list[str], order: list[Column | str], position: str | None = None, totals: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with running columns in an order within the groups ``by``, each up to and with its row.

    ``position`` counts from 1; ``totals`` are sums (nulls add nothing), ``lasts`` the last values
    that aren't null.  The order must be total, nulls come first; null groups are groups.
    """
    totals, lasts = totals or {}, lasts or {}
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    keys = {f"_run_o{i}": as_col(c) for i, c in enumerate(order)}
    values = {f"_run_v{i}": c for i, c in enumerate([*totals.values(), *lasts.values()])}
    names = dict(zip([*totals, *lasts], values))
    rows = df.withColumns(keys | values).repartitionByRange(*by, *keys).withColumn("_run_part", F.spark_partition_id())
    held = materialize(rows, "running")
    along = Window.partitionBy("_run_part", *by).orderBy(*keys)
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    local = held.withColumns(({"_run_n": F.row_number().over(along)} if position else {}) | {f"_run_l_{n}": (F.sum(names[n]) if n in totals else F.last(names[n], ignorenulls=True)).over(upto) for n in names})

    newest = lambda v: F.max(F.when(F.col(v).isNotNull(), F.struct(*keys, v)))[v]
    per = held.groupBy("_run_part", *by).agg(F.count(F.lit(1)).alias("_run_c"), *((F.sum(names[n]) if n in totals else newest(names[n])).alias(f"_run_t_{n}") for n in names))
    before = Window.partitionBy(*by).orderBy("_run_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = per.select(F.col("_run_part").alias("_run_p"), *(F.col(c).alias(f"_run_b{i}") for i, c in enumerate(by)), F.sum("_run_c").over(before).alias("_run_cc"), *((F.sum(f"_run_t_{n}") if n in totals else F.last(f"_run_t_{n}", ignorenulls=True)).over(before).alias(f"_run_c_{n}") for n in names))
    # A stretch goes on with at most one group, its first: one row per task.
    carried = F.broadcast(carried.filter("_run_cc is not null"))
    same = F.col("_run_part") == F.col("_run_p")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_run_b{i}"))
    joined = local.join(carried, same, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = {position: (F.col("_run_n") + zero("_run_cc")).cast("bigint")} if position else {}
    for n in names:
        mine, old = F.col(f"_run_l_{n}"), F.col(f"_run_c_{n}")
        out[n] = F.when(mine.isNotNull() | old.isNotNull(), zero(f"_run_l_{n}") + zero(f"_run_c_{n}")) if n in totals else F.coalesce(mine, old)
    return joined.select(*df.columns, *(c.alias(n) for n, c in out.items()))
