"""The N best items of every group, by one global sort.

The rows are range-partitioned and sorted by (group, score columns, item), so a group of any size
is spread over as many partitions as it needs.  Each partition numbers its rows within their
group and reports how many rows of its last group it holds; the prefix sum of these counts over
the partitions turns the local numbers into exact global positions.  Only rows with a local
number up to N and one count per partition leave the sort.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _numbered(n: int, fields: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        last, seen = None, 0  # the group of the row before, and its rows so far
        types: dict[str, pa.DataType] = {}
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            types = {f: batch.schema.field(f).type for f in fields}
            group = batch.column("grp")
            at = np.arange(rows)
            starts = np.ones(rows, dtype=bool)
            if rows > 1:
                starts[1:] = pc.not_equal(group.slice(1), group.slice(0, rows - 1)).to_numpy(zero_copy_only=False)
            same = seen > 0 and group[0].as_py() == last
            starts[0] = not same
            since = np.maximum.accumulate(np.where(starts, at, -1))
            rank = np.where(since < 0, at + 1 + seen, at - since + 1)
            last, seen = group[-1].as_py(), int(rank[-1])
            keep = rank <= n
            if keep.any():
                kept = batch.filter(pa.array(keep))
                size = kept.num_rows
                yield pa.RecordBatch.from_arrays(
                    [kept.column(f) for f in fields] + [pa.array(np.full(size, part, dtype=np.int64)), pa.array(rank[keep].astype(np.int64)), pa.nulls(size, pa.int64())],
                    names=[*fields, "part", "local_no", "in_part"],
                )
        if seen:
            row = [pa.array([last], types[f]) if f == "grp" else pa.nulls(1, types[f]) for f in fields]
            yield pa.RecordBatch.from_arrays([*row, pa.array([part], pa.int64()), pa.array([0], pa.int64()), pa.array([seen], pa.int64())], names=[*fields, "part", "local_no", "in_part"])

    return number


def top_n_per_group(rows: DataFrame, group: Column | str, item: Column | str, order: list[Column], n: int = 3) -> DataFrame:
    """The ``n`` first items of every group in ``order`` (ascending, nulls first), item id last.

    Returns ``grp, item, position`` with position from 1.  Negate a score to rank it downwards.

    Defined cases: rows with a null group or item take no part; several rows of one item count
    once, by the row that ranks first; equal scores are broken by the item id, so each execution
    gives the same rows; groups with fewer than ``n`` items come out whole; an empty input gives
    no row.  Columns not named are never read.
    """
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    keys = [f"k{i}" for i in range(len(order))]
    base = rows.select(as_col(item).alias("item"), F.struct(*(c.alias(k) for c, k in zip(order, keys)), as_col(group).alias("grp")).alias("row"))
    base = base.filter(F.col("item").isNotNull() & F.col("row.grp").isNotNull())
    once = base.groupBy("item").agg(F.min("row").alias("row")).select("row.grp", *(f"row.{k}" for k in keys), "item")
    by = ["grp", *keys, "item"]
    ordered = once.repartitionByRange(*by).sortWithinPartitions(*by).select("grp", "item")
    kinds = dict(ordered.dtypes)
    local = ordered.mapInArrow(_numbered(n, ["grp", "item"]), f"grp {kinds['grp']}, item {kinds['item']}, part bigint, local_no bigint, in_part bigint")
    before = F.sum("in_part").over(Window.partitionBy("grp").orderBy("part").rangeBetween(Window.unboundedPreceding, -1))
    position = F.col("local_no") + F.coalesce(before, F.lit(0))
    return local.withColumn("position", position).filter((F.col("local_no") > 0) & (F.col("position") <= n)).select("grp", "item", F.col("position").cast("int").alias("position"))
