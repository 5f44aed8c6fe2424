"""How detection converges with the number of images: precision and recall of three candidate sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bytefold.operators.consensus import KEY_CANDIDATE, classify
from bytefold.operators.hits import detection_metrics
from bytefold.operators.runs import aligned_blocks


#: Stands for a group's own size until that is known.
_WHOLE = (1 << 31) - 1


def prefix_variance(rows: DataFrame, by: list[str], ns: list[int], rank: str = "rank", whole: bool = False) -> DataFrame:
    """Variance per offset over the first N images for every N, in one pass.

    The images between two checkpoints are added up first; a running sum over the checkpoints of
    an offset gives every prefix, so each byte is read once whatever the number of checkpoints.
    Offsets that a prefix doesn't hold in full have no row for it.  With ``whole`` each group's own
    number of images is a checkpoint besides ``ns``.
    """
    ns = sorted(ns) + [_WHOLE] * whole
    at = F.element_at(F.filter(F.array(*(F.lit(n) for n in ns)), lambda n: n >= F.col(rank)), 1)
    v = F.col("v").cast("bigint")
    part = rows.filter(F.col(rank) <= ns[-1]).withColumn("n", at).groupBy(*by, "off", "n").agg(F.count(F.lit(1)).alias("c"), F.sum(v).alias("s"), F.sum(v * v).alias("q"), F.max(rank).alias("top"))
    # A checkpoint without images of its own still needs a row: each offset gets all of them.
    grid = part.select(*by, "off").distinct().withColumn("n", F.explode(F.array(*(F.lit(n) for n in ns))))
    w = Window.partitionBy(*by, "off").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    run = grid.join(part, [*by, "off", "n"], "left").select(*by, "off", "n", *(F.sum(F.coalesce(c, F.lit(0))).over(w).alias(c) for c in ("c", "s", "q")))
    if whole:
        size = part.groupBy(*by).agg(F.max("top").cast("int").alias("_size"))
        run = run.join(size, by) if by else run.crossJoin(size)  # one row
        run = run.filter((F.col("n") != _WHOLE) | ~F.col("_size").isin(ns)).withColumn("n", F.when(F.col("n") == _WHOLE, F.col("_size")).otherwise(F.col("n")))
    full = run.filter(F.col("c") == F.col("n"))
    var = (F.col("c") * F.col("q") - F.col("s") * F.col("s")) / (F.col("c") * F.col("c")).cast("double")
    return full.select(*by, "off", "n", var.alias("variance"))


def convergence(variances: DataFrame, entropy_offsets: DataFrame, truth: DataFrame, ns: list[int] | None, by: list[str] | None = None, block: int = 32, alignment: int = 16, density: float = 0.75) -> DataFrame:
    """Metrics of the variance, variance ∩ entropy, and aligned candidates for each N (and group).

    ``variances(…by, off, n, variance)``; ``entropy_offsets(…by, off)`` of the first image;
    ``truth(…by, off)``.  Without ``ns`` each group has the N that its variances have.
    """
    by = by or []
    at = [*by, "off"]
    var = variances.filter(classify(F.col("variance")) == KEY_CANDIDATE).select(*at, "n")
    combined = var.join(entropy_offsets.select(*at).distinct(), at, "left_semi")
    dense = aligned_blocks(combined, [*by, "n"], None, block, alignment, density)
    found = None
    for name, df in (("variance", var), ("combined", combined), ("aligned", dense)):
        one = df.select(*at, "n").distinct().withColumn("candidates", F.lit(name))
        found = one if found is None else found.unionByName(one)
    found = found.withColumn("found", F.lit(True))
    kinds = F.explode(F.array(*(F.lit(c) for c in ("variance", "combined", "aligned")))).alias("candidates")
    true = truth.select(*at).distinct()
    if ns is None:
        own = variances.select(*by, "n").distinct()
        true = true.join(own, by) if by else true.crossJoin(own)
    else:
        true = true.withColumn("n", F.explode(F.array(*(F.lit(n) for n in ns))))
    true = true.select(*at, "n", kinds).withColumn("true", F.lit(True))
    both = found.join(true, [*at, "n", "candidates"], "full")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return detection_metrics(both, [*by, "n", "candidates"], yes("found"), yes("true"))


def milestones(metrics: DataFrame, recall: float = 0.875, max_fp: int = 0) -> DataFrame:
    """The first N that detects the truth, and the first that does so without too many false hits."""
    first = lambda c: F.min(F.when(c, F.col("n")))
    seen = F.col("recall") >= recall
    return metrics.agg(first((F.col("candidates") == "variance") & seen).alias("first_detection_n"), first((F.col("candidates") == "aligned") & seen & (F.col("fp") <= max_fp)).alias("first_fp_target_n"))
