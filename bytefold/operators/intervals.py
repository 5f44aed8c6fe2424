"""Interval joins without a cross join: both sides meet in buckets of the axis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytefold.operators.running import running


def _level(start: Column, end: Column) -> Column:
    """The power of two at or above an interval's width: it touches at most two buckets of that width."""
    return F.greatest(F.lit(0), F.ceil(F.log2((end - start).cast("double")))).cast("int")


def _buckets(df: DataFrame, start: Column, end: Column, level: Column, name: str) -> DataFrame:
    """A row for each bucket of width ``2 ** level`` that ``[start, end)`` touches."""
    at = lambda c: F.call_function("shiftright", c.cast("bigint"), level)
    return df.withColumn(name, F.explode(F.sequence(at(start), at(end - 1))))


def _levels(df: DataFrame, start: str, end: str) -> list[int]:
    """The levels that occur: at most 64 whatever the data."""
    return sorted(r[0] for r in df.select(_level(F.col(start), F.col(end)).alias("l")).distinct().collect() if r[0] is not None)


def overlap_join(left: DataFrame, right: DataFrame, by: list[str], left_span: tuple[str, str], right_span: tuple[str, str], how: str = "inner") -> DataFrame:
    """Pairs of overlapping half-open intervals with equal ``by`` columns.

    Both sides are cut by width into levels of powers of two.  An interval is put into the buckets
    of its own level, and for each level of the other side above its own into that level's
    buckets, so it makes at most two rows for each level there is, however uneven the widths are.
    A pair meets at the higher of its two levels and is kept in the bucket of its later start, so
    it comes out once.  ``left_semi`` gives the left rows that overlap any right one.  Empty and
    null intervals overlap nothing.
    """
    (ls, le), (rs, re_) = left_span, right_span
    a = left.filter(F.col(ls) < F.col(le))
    b = right.select(*by, *(F.col(c).alias(f"_r_{c}") for c in right.columns if c not in by)).filter(F.col(f"_r_{rs}") < F.col(f"_r_{re_}"))
    levels = sorted({*_levels(a, ls, le), *_levels(b, f"_r_{rs}", f"_r_{re_}")})
    known = F.array(*(F.lit(x) for x in levels)).cast("array<int>")

    def spread(df: DataFrame, s: str, e: str) -> DataFrame:
        own = _level(F.col(s), F.col(e))
        at = df.withColumn("_own", own).withColumn("_l", F.explode(F.filter(known, lambda x: x >= F.col("_own"))))
        return _buckets(at, F.col(s), F.col(e), F.col("_l"), "_b")

    a, b = spread(a, ls, le).alias("a"), spread(b, f"_r_{rs}", f"_r_{re_}").alias("b")
    cond = (F.col(f"a.{ls}") < F.col(f"b._r_{re_}")) & (F.col(f"b._r_{rs}") < F.col(f"a.{le}"))
    for c in [*by, "_l", "_b"]:
        cond = cond & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    if how == "left_semi":
        return a.join(b, cond, how).select(*left.columns).dropDuplicates()
    later = F.greatest(F.col(f"a.{ls}"), F.col(f"b._r_{rs}")).cast("bigint")
    cond = cond & (F.greatest(F.col("a._own"), F.col("b._own")) == F.col("a._l")) & (F.call_function("shiftright", later, F.col("a._l")) == F.col("a._b"))
    joined = a.join(b, cond, how)
    return joined.select(*(F.col(f"a.{c}") for c in left.columns), *(F.col(f"b._r_{c}").alias(f"r_{c}") for c in right.columns if c not in by))


def point_join(points: DataFrame, intervals: DataFrame, by: list[str], at: str, span: tuple[str, str]) -> DataFrame:
    """Each point with the intervals ``[start, end)`` that hold it; interval columns get ``r_``.

    An interval is put into the one or two buckets of its width's level, a point into one bucket of
    each level that occurs.
    """
    s, e = f"r_{span[0]}", f"r_{span[1]}"
    b = intervals.select(*by, *(F.col(c).alias(f"r_{c}") for c in intervals.columns if c not in by)).filter(F.col(s) < F.col(e))
    levels = _levels(b, s, e)
    b = _buckets(b.withColumn("_l", _level(F.col(s), F.col(e))), F.col(s), F.col(e), F.col("_l"), "_b")
    a = points.withColumn("_l", F.explode(F.array(*(F.lit(x) for x in levels)).cast("array<int>")))
    a = a.withColumn("_b", F.call_function("shiftright", F.col(at).cast("bigint"), F.col("_l")))
    return a.join(b, [*by, "_l", "_b"]).filter((F.col(s) <= F.col(at)) & (F.col(at) < F.col(e))).drop("_l", "_b")


def owner_of(points: DataFrame, owners: DataFrame, by: list[str], at: str, base: str, end: str, name: str) -> DataFrame:
    """As-of lookup: the owner of the greatest base at or below a point, if the point is below its end.

    A union of both sides in address order with the last owner carried on: no pairs are formed.
    Every point comes out once; ``owner`` is null when no owner holds it.  Of owners with one base
    the name that sorts last counts.
    """
    kind = dict(points.dtypes)[at]
    keys = [c for c in points.columns]
    cols = [F.struct(*keys).alias("_p"), *by, F.col(at).cast(kind).alias("_at"), F.lit(None).cast(f"struct<base:{kind},end:{kind},name:string>").alias("_o"), F.lit(1).alias("_side")]
    p = points.select(*cols)
    o = owners.select(F.lit(None).cast(p.schema["_p"].dataType).alias("_p"), *by, F.col(base).cast(kind).alias("_at"), F.struct(F.col(base).cast(kind).alias("base"), F.col(end).cast(kind).alias("end"), F.col(name).cast("string").alias("name")).alias("_o"), F.lit(0).alias("_side"))
    both = p.unionByName(o).withColumn("_tie", F.coalesce("_o.name", F.to_json("_p")))
    seen = running(both, by, ["_at", "_side", "_tie"], lasts={"_last": F.col("_o")}).filter("_side = 1")
    holds = F.col("_at") < F.col("_last.end")
    return seen.select("_p.*", F.when(holds, F.col("_last.name")).alias("owner"), F.when(holds, F.col("_last.base")).alias("owner_base"))


def cumulative(rows: DataFrame, by: list[str], order: list[Column | str], size: str, name: str = "view_off") -> DataFrame:
    """Offsets of parts laid end to end in an order (the address-ordered view of an image); a group may be of any size."""
    return running(rows, by, order, totals={name: F.col(size)}).withColumn(name, (F.col(name) - F.col(size)).cast("bigint"))


def common_keys(rows: DataFrame, group: str, keys: list[str], check: str | None = None) -> DataFrame:
    """Keys held by every group, without those whose ``check`` value differs between groups."""
    groups = rows.select(group).distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    agg = [F.count_distinct(group).alias("_n")] + ([F.min(check).alias("_lo"), F.max(check).alias("_hi")] if check else [])
    out = rows.groupBy(*keys).agg(*agg).filter(F.col("_n") == groups)
    if check:
        out = out.filter(F.col("_lo").eqNullSafe(F.col("_hi")))
    return out.select(*keys)
