"""Entropy of images: whole, sliding, regions, coverage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bytefold.functions.kernels import as_bytes, sliding_entropy
from bytefold.operators.chunks import chunked


def check_threshold(threshold: float, window: int) -> None:
    """A window of w bytes has at most log2(w) bits per byte: a threshold above can never fire."""
    if threshold > np.log2(window):
        raise ValueError(f"threshold {threshold} can't be reached in a window of {window} bytes")


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each byte value occurs in each chunk; chunks of one image in a batch are added up."""
    for b in batches:
        held: dict[int, np.ndarray] = {}
        ids = b.column("dump_id").dictionary_encode()
        for code, data, size in zip(ids.indices.to_pylist(), b.column("data"), b.column("size").to_pylist()):
            counts = np.bincount(as_bytes(data.as_buffer())[:size], minlength=256)
            held[code] = held[code] + counts if code in held else counts
        for code, counts in held.items():
            seen = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([ids.dictionary.take(pa.array(np.full(len(seen), code))), pa.array(seen, pa.int32()), pa.array(counts[seen], pa.int64())], names=["dump_id", "v", "c"])


def image_entropy(images: DataFrame) -> DataFrame:
    """Bits per byte of each image; 0 for null and empty ones.  No image is held as a whole."""
    kind = dict(images.dtypes)["dump_id"]
    counts = chunked(images).select("dump_id", "size", "data").mapInArrow(_histogram, f"dump_id {kind}, v int, c bigint").groupBy("dump_id", "v").agg(F.sum("c").alias("c"))
    none = images.select("dump_id", F.lit(None).cast("int").alias("v"), F.lit(0).cast("bigint").alias("c")).distinct()
    n, weighted = F.sum("c"), F.sum(F.when(F.col("c") > 0, F.col("c") * F.log2("c")).otherwise(0.0))
    return counts.unionByName(none).groupBy("dump_id").agg(F.when(n > 0, F.greatest(F.lit(0.0), F.log2(n) - weighted / n)).otherwise(0.0).alias("entropy"))


def _profile(window: int, step: int):
    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, sizes = b.column("base_off").to_pylist(), b.column("size").to_pylist()
            for i, data in enumerate(b.column("data")):
                first = -base[i] % step  # the profile's grid is global, not the chunk's
                values = as_bytes(data.as_buffer() if data.is_valid else b"")[first:]
                h = sliding_entropy(values, window, step)
                h = h[: max(0, -(-(sizes[i] - first) // step))]
                if len(h):
                    off = base[i] + first + np.arange(len(h), dtype=np.int64) * step
                    ids = b.column("dump_id").take(pa.array(np.full(len(h), i)))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(off), pa.array(h)], names=["dump_id", "off", "entropy"])

    return profile


def entropy_profile(chunks: DataFrame, window: int = 32, step: int = 1) -> DataFrame:
    """Entropy of the window at every multiple of ``step``: ``dump_id, off, entropy``.

    Chunks need a halo of ``window - 1`` bytes.  An image shorter than the window has no row.
    """
    kind = dict(chunks.dtypes)["dump_id"]
    return chunks.select("dump_id", "base_off", "size", "data").mapInArrow(_profile(window, step), f"dump_id {kind}, off bigint, entropy double")


def high_regions(profile: DataFrame, threshold: float = 7.5, min_width: int = 32, step: int = 1, block: int = 1 << 20) -> DataFrame:
    """Runs of profile points at or over the threshold: ``dump_id, start, end, mean_entropy``.

    ``end`` is the offset of the first point below the threshold, or of the last point of the
    profile when the run reaches its end.  As the profile's grid is regular, the point after a
    run is one step on; only each image's last offset has to be looked up.
    """
    from bytefold.operators.runs import islands

    last = profile.groupBy("dump_id").agg(F.max("off").alias("_last"))
    high = profile.filter(F.col("entropy") >= threshold).withColumn("_k", (F.col("off") / step).cast("bigint"))
    runs = islands(high, ["dump_id"], off="_k", measures={"_e": F.col("entropy")}, block=block)
    ended = runs.join(last, "dump_id").select("dump_id", (F.col("start") * step).alias("start"), F.least(F.col("end") * step, F.col("_last")).alias("end"), (F.col("_e") / F.col("length")).alias("mean_entropy"))
    return ended.filter(F.col("end") - F.col("start") >= min_width)


def coverage(profile: DataFrame, threshold: float, window: int = 32, step: int = 1) -> DataFrame:
    """Byte ranges covered by windows at or over the threshold: ``dump_id, start, end``.

    The union of equal-width intervals: windows at most a width apart are one range.  Blocks are
    merged on their own, and over an image only the first and last range of each block meet.
    """
    from bytefold.operators.runs import merge_near

    points = profile.filter(F.col("entropy") >= threshold).select("dump_id", F.col("off").alias("start"), (F.col("off") + 1).alias("end"))
    merged = merge_near(points, ["dump_id"], F.lit(True), window - 1)
    return merged.select("dump_id", "start", (F.col("end") - 1 + window).alias("end"))


def entropy_stats(profile: DataFrame, by: list[str], sample: int = 200) -> DataFrame:
    """Least, largest, mean entropy and number of points, with a systematic sample of the points."""
    numbered = profile.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("off")) - 1).withColumn("_c", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    keep = F.col("_n") % F.greatest(F.lit(1), F.floor(F.col("_c") / sample)) == 0
    return numbered.groupBy(*by).agg(F.min("entropy").alias("min_entropy"), F.max("entropy").alias("max_entropy"), F.avg("entropy").alias("mean_entropy"), F.count(F.lit(1)).alias("points"), F.sort_array(F.collect_list(F.when(keep, F.struct("off", "entropy")))).alias("sample"))


