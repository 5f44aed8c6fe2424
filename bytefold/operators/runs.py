"""Runs of consecutive offsets: islands, gap-tolerant merging, fields, anchors.

Islands are found in blocks of offsets first, and only the runs are stitched over the whole image,
so a single huge image doesn't end up in one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 20


def islands(rows: DataFrame, by: list[str], value: str | None = None, off: str = "off", measures: dict[str, Column] | None = None, block: int = BLOCK) -> DataFrame:
    """Maximal runs of consecutive offsets (of equal ``value``, if given).

    ``measures`` are sums per run: name -> expression over a row.  Returns ``…by[, value], start,
    end, length, …measures`` with ``end`` beyond the run.
    """
    keys, extra = [*by, *([value] if value else [])], measures or {}
    cut = rows.select(*keys, F.col(off).alias("_o"), *(e.alias(m) for m, e in extra.items())).withColumn("_b", F.floor(F.col("_o") / block))
    number = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy("_o"))
    local = cut.withColumn("_g", F.col("_o") - number).groupBy(*keys, "_b", "_g").agg(F.min("_o").alias("start"), (F.max("_o") + 1).alias("end"), *(F.sum(m).alias(m) for m in extra))
    # A run inside its block is final; only runs at a block's edge may go on in the next block, so
    # at most two rows per block and value take part in the sort over the whole image.
    edge = (F.col("start") % block == 0) | (F.col("end") % block == 0)
    along = Window.partitionBy(*keys).orderBy("start")
    new = F.coalesce((F.lag("end").over(along) < F.col("start")).cast("int"), F.lit(1))
    stitched = local.filter(edge).withColumn("_n", new).withColumn("_r", F.sum("_n").over(along)).groupBy(*keys, "_r").agg(F.min("start").alias("start"), F.max("end").alias("end"), *(F.sum(m).alias(m) for m in extra))
    out = [*keys, "start", "end", *extra]
    whole = local.filter(~edge).select(*out).unionByName(stitched.select(*out))
    return whole.select(*keys, "start", "end", (F.col("end") - F.col("start")).alias("length"), *extra)


def class_regions(consensus: DataFrame, by: list[str], wanted: int, min_length: int) -> DataFrame:
    """Regions of one class with their mean variance: static ones from 32, volatile ones from 16 bytes."""
    runs = islands(consensus.filter(F.col("class") == wanted), by, measures={"_v": F.col("variance")})
    return runs.filter(F.col("length") >= min_length).withColumn("mean_variance", F.col("_v") / F.col("length")).drop("_v")


def merge_near(runs: DataFrame, by: list[str], wanted: Column, max_gap: int = 4, block: int = BLOCK) -> DataFrame:
    """Merge wanted runs at most ``max_gap`` apart unless another run lies in the gap.

    ``runs(…by, start, end)`` are disjoint; those that aren't ``wanted`` are barriers (the invariant
    runs).  A gap is always measured from the run before, so two runs merge exactly when they follow
    each other without a barrier.  Blocks of offsets are merged on their own; over the whole image
    only the first and last runs of each block meet.
    """
    keys = [*by, "_b"]
    cut = runs.select(*by, "start", "end", wanted.alias("_w")).withColumn("_b", F.floor(F.col("start") / block))
    inner = Window.partitionBy(*keys).orderBy("start")
    before = lambda w: ~F.lag("_w").over(w) | (F.col("start") - F.lag("end").over(w) > max_gap)
    local = cut.withColumn("_g", F.sum(F.coalesce((F.col("_w") & before(inner)).cast("int"), F.lit(0)) + (~F.col("_w")).cast("int")).over(inner))
    local = local.groupBy(*keys, "_g", "_w").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    ends = Window.partitionBy(*keys)
    edge = (F.col("start") == F.min("start").over(ends)) | (F.col("start") == F.max("start").over(ends))
    marked = local.withColumn("_edge", edge)
    along = Window.partitionBy(*by).orderBy("start")
    met = marked.filter("_edge").withColumn("_new", F.coalesce((F.col("_w") & before(along)).cast("int"), F.lit(0)) + (~F.col("_w")).cast("int")).withColumn("_inside", F.lag("_b").over(along) == F.col("_b"))
    met = met.withColumn("_g", F.sum(F.when(F.col("_inside"), 1).otherwise(F.col("_new"))).over(along)).filter("_w").groupBy(*by, "_g").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    out = [*by, "start", "end"]
    whole = marked.filter("_w and not _edge").select(*out).unionByName(met.select(*out))
    return whole.withColumn("length", F.col("end") - F.col("start"))


def infer_fields(consensus: DataFrame, by: list[str], key_start: Column, key_length: Column, threshold: float = 2000.0) -> DataFrame:
    """Fields of a layout: runs of one role (key, static, dynamic), named by role and sequence."""
    inside = (F.col("off") >= key_start) & (F.col("off") < key_start + key_length)
    role = F.when(inside, "key").when(F.col("variance") <= threshold, "static").otherwise("dynamic")
    runs = islands(consensus.withColumn("role", role), by, "role", measures={"_v": F.col("variance")})
    seq = F.row_number().over(Window.partitionBy(*by, "role").orderBy("start")) - 1
    return runs.withColumn("label", F.concat_ws("_", "role", seq.cast("string"))).withColumn("mean_variance", F.round(F.col("_v") / F.col("length"), 2)).drop("_v")


def longest(runs: DataFrame, by: list[str]) -> DataFrame:
    """The longest run of each group; of equal ones the first."""
    best = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("length"), "start"))
    return runs.withColumn("_n", best).filter("_n = 1").drop("_n")


def aligned_blocks(candidates: DataFrame, by: list[str], size: Column | None, block: int = 32, alignment: int = 16, density: float = 0.75) -> DataFrame:
    """Candidates that lie in an aligned block with enough of them, on rows.

    With ``size`` only blocks inside ``[0, size)`` count (mask variant); without it blocks may
    hang over the end (set variant).  Invalid parameters give no row.
    """
    if block <= 0 or alignment <= 0:
        return candidates.limit(0)
    last = F.floor(F.col("off") / alignment) * alignment
    low = F.greatest(F.lit(0), (F.floor((F.col("off") - block) / alignment) + 1) * alignment)
    high = last if size is None else F.least(last, F.floor((size - block) / alignment) * alignment)
    if size is None:  # the first block starts at the alignment below the least candidate
        least = candidates.groupBy(*by).agg((F.floor(F.min("off") / alignment) * alignment).alias("_low")) if by else candidates.agg((F.floor(F.min("off") / alignment) * alignment).alias("_low")).withColumn("_one", F.lit(1))
        rows = candidates.join(least, by) if by else candidates.withColumn("_one", F.lit(1)).join(least, "_one").drop("_one")
        low = F.greatest(low, F.col("_low"))
    else:
        rows = candidates
    rows = rows.withColumn("_l", low).withColumn("_h", high)
    spread = rows.filter("_l <= _h").withColumn("_s", F.explode(F.sequence("_l", "_h", F.lit(alignment).cast("bigint"))))
    dense = spread.groupBy(*by, "_s").agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") >= int(block * density)).drop("_c")
    return spread.join(dense, [*by, "_s"], "left_semi").select(*by, "off").distinct()
