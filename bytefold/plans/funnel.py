"""The reduction funnel and its sweep over the number of images.

``reduce_images`` narrows the bytes of an image set down to candidate regions: variance, then
aligned density, then entropy coverage of the reference image, then runs.  It works chunk by
chunk; a chunk gets the edges of its neighbours, so no mask is ever gathered for a whole image.
All checkpoints of a sweep share one pass: the states of the images between two checkpoints are
added up once, and the reference's entropy profile, which doesn't depend on N, is computed once
per chunk.
"""

from __future__ import annotations

import hashlib
import math
import os
import stat
from collections.abc import Callable, Iterator
from itertools import groupby, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bytefold.functions.kernels import aligned, as_bytes, covered, runs_of, shannon, sliding_entropy
from bytefold.operators.chunks import CHUNK, chunked
from bytefold.operators.consensus import BROADCAST_GROUPS, ChunkState, consensus_state
from bytefold.operators.entropy import check_threshold
from bytefold.sources.images import file_states, file_windows

#: With fewer images than this the variance says nothing and only entropy is used.
MIN_IMAGES = 3

_PIECES = "grp string, n int, chunk_no int, total bigint, variance bigint, aligned bigint, high_entropy bigint, start bigint, end bigint, v double, e double, points bigint, raw binary"


class Params(dict):
    """Parameters of the funnel with their defaults."""

    def __init__(self, **given) -> None:
        super().__init__(alignment=8, block_size=32, density_threshold=0.5, min_variance=3000.0, entropy_window=32, entropy_threshold=4.5, min_region=16)
        unknown = set(given) - set(self)
        if unknown:
            raise TypeError(f"unknown parameters {sorted(unknown)}")
        self.update(given)
        check_threshold(self["entropy_threshold"], self["entropy_window"])


def _edges(pad: int):
    """Each chunk's state, and its edges for the chunks before and after."""

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                state = ChunkState.read(r["n"], r["sums"], r["squares"])
                for shift, part in ((0, slice(None)), (1, slice(-pad, None)), (-1, slice(0, pad))):
                    if r["chunk_no"] + shift >= 0:
                        n, _, s, q = state.cut(part).row()
                        rows.append((r["grp"], r["seg"], r["chunk_no"] + shift, -shift, n, s, q))
            cols = list(zip(*rows)) if rows else [[]] * 7
            types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["grp", "seg", "chunk_no", "side", "n", "sums", "squares"])

    return edges


def _variances(states: dict[int, ChunkState], n: int, pad: int, chunk: int) -> np.ndarray:
    """Variance of a chunk with ``pad`` offsets on either side (zeros where there is no data)."""
    out = np.zeros(chunk + 2 * pad)
    for side, at in ((0, pad), (-1, 0), (1, pad + chunk)):
        if side not in states or states[side].n != n:
            continue
        x = states[side].variance()
        start = at + pad - len(x) if side == -1 else at
        out[start : start + len(x)] = x[: len(out) - start]
    return out


def _reduce(points: int, p: Params, pad: int, chunk: int):
    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in b.to_pylist())
        for (grp, no), group in groupby(rows, key=lambda r: (r["grp"], r["chunk_no"])):
            ref, segments = None, {}
            for r in group:
                if r["data"] is not None:
                    ref = r
                else:
                    segments.setdefault(r["seg"], {})[r["side"]] = ChunkState.read(r["n"], r["sums"], r["squares"])
            if ref is None:
                continue
            base, left = no * chunk, min(pad, no * chunk)
            data = as_bytes(ref["data"])  # from base - left to base + chunk + pad
            first = -(base - left) % p["alignment"]
            profile = sliding_entropy(data[first:], p["entropy_window"], p["alignment"]).astype(np.float32)
            starts = (base - left) + first + np.arange(len(profile), dtype=np.int64) * p["alignment"]
            held: dict[int, ChunkState] = {}
            out = []
            for seg in range(points):
                for side, state in segments.get(seg, {}).items():
                    if side not in held:
                        held[side] = state
                    elif side >= 0 or len(state.sums) == len(held[side].sums):
                        held[side] = held[side].add(state)
                n, total = ref["ns"][seg], ref["totals"][seg]
                if total is None or total <= base:
                    continue
                size = min(chunk, total - base)
                inside = starts + p["entropy_window"] <= total
                if n < MIN_IMAGES:
                    var = np.zeros(chunk + 2 * pad)
                    mask = np.ones(chunk + 2 * pad, dtype=bool)
                    dense = mask.copy()
                else:
                    var = _variances(held, n, pad, chunk)
                    known = np.arange(len(var)) + base - pad
                    mask = (var >= p["min_variance"]) & (known >= 0) & (known < total)
                    low = max(0, pad - base)  # nothing lies before the image
                    shift = -(base - pad + low) % p["alignment"]
                    end = min(len(mask), total - (base - pad))
                    dense = np.zeros(len(mask), dtype=bool)
                    dense[low + shift : end] = aligned(mask[low + shift : end], p["block_size"], p["alignment"], p["density_threshold"])
                own = slice(pad, pad + size)
                high = starts[inside & (profile >= p["entropy_threshold"])] - (base - left)
                cover = covered(high, p["entropy_window"], len(data))[left : left + size]
                keep = dense[own] & cover
                lo, hi = runs_of(keep)
                pieces = []
                for a, b in zip(lo.tolist(), hi.tolist()):
                    mine = profile[inside & (starts >= base + a) & (starts + p["alignment"] <= base + b)]
                    alone = not len(mine)  # its region may hold no point at all; such a piece is short
                    pieces.append((base + a, base + b, float(var[pad + a : pad + b].sum()), float(mine.sum(dtype=np.float64)), len(mine), ref["data"][left + a : left + b] if alone else None))
                counts = (size, int(mask[own].sum()), int(dense[own].sum()), int(keep.sum()))
                out.append((grp, n, no, *counts, None, None, 0.0, 0.0, 0, None))
                out.extend((grp, n, no, 0, 0, 0, 0, *piece) for piece in pieces)
            if out:
                types = [pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * 6, pa.float64(), pa.float64(), pa.int64(), pa.binary()]
                names = [f.split()[0] for f in _PIECES.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return reduce


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mean entropy of regions that hold no profile point: that of their own bytes."""
    for b in batches:
        mean = [e / k if k else shannon(b"".join(x for x in raw if x is not None)) for e, k, raw in zip(b.column("e").to_pylist(), b.column("points").to_pylist(), b.column("raw").to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column(c) for c in ("grp", "n", "off", "length")] + [pa.array(mean, pa.float64()), b.column("mean_variance")], names=["grp", "n", "off", "length", "mean_entropy", "mean_variance"])


def held_images(images: DataFrame) -> DataFrame:
    """The images that hold bytes as ``grp, rank, dump_id, data``, numbered without the null and empty ones.

    The ranks of the others are broadcast, so that no image is moved for its number.
    """
    rows = images.select(F.coalesce(F.col("grp").cast("string"), F.lit("")).alias("grp"), F.col("rank").cast("int").alias("rank"), F.col("dump_id"), F.col("data").cast("binary").alias("data"))
    size = F.coalesce(F.octet_length("data"), F.lit(0))
    gaps = rows.filter(size == 0).groupBy("grp").agg(F.collect_list("rank").alias("_gaps"))
    before = F.size(F.filter(F.coalesce("_gaps", F.array().cast("array<int>")), lambda g: g < F.col("rank")))
    return rows.filter(size > 0).join(F.broadcast(gaps), "grp", "left").select("grp", (F.col("rank") - before).alias("rank"), "dump_id", "data")


def reduce_images(images: DataFrame, ns: list[int] | None = None, chunk: int = CHUNK, whole: bool = False, **params) -> tuple[DataFrame, DataFrame]:
    """Run the funnel over ``images(grp, rank, dump_id, data)`` for the first N images of each group.

    ``rank`` numbers the images of a group from 1; number 1 is the reference.  Returns the stage
    counts ``grp, n, total, variance, aligned, high_entropy`` and the regions ``grp, n, off,
    length, mean_entropy, mean_variance``.  Without ``ns`` the whole of each group is used
    (``n`` its own size); with ``whole`` that size is a checkpoint besides ``ns``.

    Defined cases: bytes beyond the shortest of the N images don't count; groups with fewer than
    N images have no row for N; with fewer than 3 images only entropy is used; null and empty
    images are left out and don't count in N; a threshold that a window can't reach is refused.
    """
    p = Params(**params)
    pad = _pad(p, chunk)
    held = held_images(images)
    whole = whole or ns is None
    ns = sorted({n for n in ns or [] if n >= 1})
    used = held if whole else held.filter(F.col("rank") <= ns[-1])  # what lies beyond the last N is a segment of its own
    totals, points = _checkpoints(used.select("grp", "rank", F.octet_length("data").cast("bigint").alias("size")), ns, whole)

    keyed = used.select(_segment_key(ns), "dump_id", "data")
    states = consensus_state(chunked(keyed, 0, chunk, ["key"]), F.col("key"))
    ref = held.filter("rank = 1").select("grp", "data", F.explode(F.sequence(F.lit(0), F.floor((F.octet_length("data") - 1) / chunk).cast("int"))).alias("chunk_no"))
    start = F.greatest(F.lit(0), F.col("chunk_no") * chunk - pad)
    ref = ref.select("grp", "chunk_no", F.substring("data", start + 1, F.col("chunk_no") * chunk + chunk + pad - start).alias("data")).join(totals, "grp")
    return _funnel(states, ref, points, p, pad, chunk)


def reduce_files(files: DataFrame, ns: list[int] | None = None, chunk: int = CHUNK, whole: bool = False, **params) -> tuple[DataFrame, DataFrame]:
    """``reduce_images`` over image files ``(grp, rank, path, size)`` read in ranges, of any size.

    Files of a group are folded stretch by stretch where they are read; the reference file is read
    once more for its entropy.
    """
    p = Params(**params)
    pad = _pad(p, chunk)
    rows = files.filter("size > 0").select(F.coalesce(F.col("grp").cast("string"), F.lit("")).alias("grp"), F.row_number().over(Window.partitionBy("grp").orderBy("rank")).alias("rank"), "path", F.col("size").cast("bigint").alias("size"))
    whole = whole or ns is None
    ns = sorted({n for n in ns or [] if n >= 1})
    used = rows if whole else rows.filter(F.col("rank") <= ns[-1])
    totals, points = _checkpoints(used.select("grp", "rank", "size"), ns, whole)
    states = file_states(used.select(_segment_key(ns), "path", "size"), chunk, group=F.col("key"))
    ref = file_windows(rows.filter("rank = 1").select("grp", "path", "size"), chunk, pad, pad).join(F.broadcast(totals) if totals.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS else totals, "grp")
    return _funnel(states, ref, points, p, pad, chunk)


def _pad(p: Params, chunk: int) -> int:
    """Bytes of its neighbours a chunk needs."""
    pad = max(p["block_size"], p["entropy_window"]) + p["alignment"]
    pad += -pad % p["alignment"]
    if chunk % p["alignment"] or chunk < pad:
        raise ValueError("the chunk must be a multiple of the alignment and hold a block")
    return pad


def _segment_key(ns: list[int]) -> Column:
    """Group and segment of an image: the checkpoints it lies behind."""
    bound = F.array(*(F.lit(n) for n in ns)).cast("array<int>")
    return F.concat_ws("\x1f", F.size(F.filter(bound, lambda n: n < F.col("rank"))).cast("string"), "grp").alias("key")


def _checkpoints(sizes: DataFrame, ns: list[int], whole: bool) -> tuple[DataFrame, int]:
    """Per group the Ns and the bytes that the first N images share (null with fewer images), and their number."""
    per_n = [F.when(F.max("rank") >= n, F.min(F.when(F.col("rank") <= n, F.col("size")))).alias(f"t{i}") for i, n in enumerate(ns)]
    points = [F.lit(n) for n in ns]
    if whole:
        per_n.append(F.when(~F.max("rank").isin(ns), F.min("size")).alias(f"t{len(ns)}"))
        points.append(F.col("images"))
    totals = sizes.groupBy("grp").agg(F.max("rank").alias("images"), *per_n)
    return totals.select("grp", F.array(*points).alias("ns"), F.array(*(F.col(f"t{i}") for i in range(len(points)))).alias("totals")), len(points)


def _funnel(states: DataFrame, ref: DataFrame, points: int, p: Params, pad: int, chunk: int) -> tuple[DataFrame, DataFrame]:
    """Stage counts and regions from segment states and the reference's padded chunks."""
    split = F.split("grp", "\x1f", 2)
    states = states.select(F.get(split, F.lit(1)).alias("grp"), F.get(split, F.lit(0)).cast("int").alias("seg"), "chunk_no", "n", "sums", "squares")
    edged = states.mapInArrow(_edges(pad), "grp string, seg int, chunk_no int, side int, n bigint, sums binary, squares binary")
    blank = lambda kind: F.lit(None).cast(kind)
    ref = ref.select("grp", blank("int").alias("seg"), "chunk_no", blank("int").alias("side"), blank("bigint").alias("n"), blank("binary").alias("sums"), blank("binary").alias("squares"), "data", "ns", "totals")
    rows = edged.select("*", blank("binary").alias("data"), blank("array<int>").alias("ns"), blank("array<bigint>").alias("totals")).unionByName(ref)
    pieces = rows.repartition("grp", "chunk_no").sortWithinPartitions("grp", "chunk_no").mapInArrow(_reduce(points, p, pad, chunk), _PIECES)

    stages = pieces.filter("start is null").groupBy("grp", "n").agg(*(F.sum(c).alias(c) for c in ("total", "variance", "aligned", "high_entropy")))
    # Pieces inside their chunk are final; only those at a chunk's edge are put together over the image.
    parts = pieces.filter("start is not null").withColumn("raws", F.array(F.col("raw")))
    edge = (F.col("start") % chunk == 0) | (F.col("end") % chunk == 0)
    along = Window.partitionBy("grp", "n").orderBy("start")
    new = F.coalesce((F.lag("end").over(along) != F.col("start")).cast("int"), F.lit(1))
    met = parts.filter(edge).withColumn("_new", new).withColumn("_g", F.sum("_new").over(along)).groupBy("grp", "n", "_g")
    raws = F.transform(F.array_sort(F.collect_list(F.when(F.col("raw").isNotNull(), F.struct("start", "raw")))), lambda s: s["raw"])
    met = met.agg(F.min("start").alias("off"), F.max("end").alias("end"), F.sum("v").alias("v"), F.sum("e").alias("e"), F.sum("points").alias("points"), raws.alias("raw"))
    alone = parts.filter(~edge).select("grp", "n", F.col("start").alias("off"), "end", "v", "e", "points", F.col("raws").alias("raw"))
    regions = alone.unionByName(met.drop("_g")).withColumn("length", F.col("end") - F.col("off")).filter(F.col("length") >= p["min_region"]).withColumn("mean_variance", F.col("v") / F.col("length"))
    regions = regions.select("grp", "n", "off", "length", "e", "points", "raw", "mean_variance").mapInArrow(_finish, "grp string, n int, off bigint, length bigint, mean_entropy double, mean_variance double")
    return stages, regions


def top_regions(regions: DataFrame, by: list[str], k: int = 10) -> DataFrame:
    """The k regions of highest mean variance, then entropy, then lowest offset."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("mean_variance"), F.desc("mean_entropy"), "off"))
    return regions.withColumn("position", n).filter(F.col("position") <= k)


def candidate_slices(regions: DataFrame, reference: DataFrame, sizes: list[int], stride: int = 8, chunk: int = CHUNK) -> DataFrame:
    """Slices of the reference at multiples of ``stride`` inside the regions, for each key size.

    ``reference(grp, data)``; a slice lies wholly inside its region.  Returns the regions' columns
    ``grp, n`` with ``off, size, value``.  The reference is cut into chunks with a halo, so a
    region only meets the chunks its slices start in.
    """
    if stride <= 0:
        raise ValueError("stride must be positive")
    end = F.col("off") + F.col("length")
    first = F.ceil(F.col("off") / stride) * stride
    slices = regions.withColumn("size", F.explode(F.array(*(F.lit(s) for s in sizes)))).withColumn("_last", end - F.col("size")).filter(first <= F.col("_last"))
    slices = slices.select("grp", "n", "size", F.explode(F.sequence(first, F.col("_last"), F.lit(stride).cast("bigint"))).alias("off")).withColumn("chunk_no", F.floor(F.col("off") / chunk).cast("int"))
    parts = reference.select("grp", F.col("data").cast("binary").alias("data")).filter(F.octet_length("data") > 0).select("grp", "data", F.explode(F.sequence(F.lit(0), F.floor((F.octet_length("data") - 1) / chunk).cast("int"))).alias("chunk_no"))
    parts = parts.select("grp", "chunk_no", F.substring("data", F.col("chunk_no") * chunk + 1, F.lit(chunk + max(sizes))).alias("part"))
    cut = F.substring("part", (F.col("off") - F.col("chunk_no") * chunk + 1).cast("int"), F.col("size"))
    return slices.join(parts, ["grp", "chunk_no"]).select("grp", "n", "off", "size", cut.alias("value")).filter(F.octet_length("value") == F.col("size"))


def load_oracle(path: str, config: dict | None = None) -> Callable[[bytes], bool]:
    """A user's predicate from a Python file: ``verify(bytes)``, or ``build_oracle(config).verify``.

    A file or folder that everyone may write is refused, as it runs with the user's rights.
    """
    for place in (path, os.path.dirname(os.path.abspath(path))):
        mode = os.stat(place).st_mode
        if mode & stat.S_IWOTH and not mode & stat.S_ISVTX:
            raise PermissionError(f"{place} may be written by everyone")
    with open(path, "rb") as file:
        source = file.read()
    space: dict = {"__name__": "oracle_" + hashlib.sha256(source).hexdigest()[:12]}
    exec(compile(source, path, "exec"), space)  # noqa: S102 - the user's own predicate
    if "build_oracle" in space:
        return space["build_oracle"](config or {}).verify
    return space["verify"]


def brute_force(slices: DataFrame, make_oracle: Callable[[], Callable[[bytes], bool]], exhaustive: bool = True) -> DataFrame:
    """Slices the predicate accepts.  ``make_oracle`` runs once per task; an exception is a miss.

    Without ``exhaustive`` the first hit of each (group, n) by offset and size comes out, whatever
    the partitions are: a task goes through its slices in that order and stops asking for a pair
    once it has hit, and the least of the tasks' first hits is the pair's.
    """

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        oracle, done = make_oracle(), None
        for b in batches:
            hits = []
            pairs = zip(b.column("grp").to_pylist(), b.column("n").to_pylist()) if not exhaustive else repeat(None)
            for pair, value in zip(pairs, b.column("value").to_pylist()):
                if not exhaustive and pair == done:
                    hits.append(False)
                    continue
                try:
                    hits.append(bool(oracle(value)))
                except Exception:
                    hits.append(False)
                if hits[-1]:
                    done = pair
            yield b.filter(pa.array(hits, pa.bool_()))

    schema = ", ".join(f"{n} {t}" for n, t in slices.dtypes)
    if exhaustive:
        return slices.mapInArrow(verify, schema)
    firsts = slices.sortWithinPartitions("grp", "n", "off", "size").mapInArrow(verify, schema)
    return firsts.groupBy("grp", "n").agg(F.min(F.struct("off", "size", "value")).alias("_first")).select("grp", "n", "_first.*")


#: Offsets shown before and after a hit.
NEIGHBORHOOD = 64


def neighborhood(consensus: DataFrame, hits: DataFrame, pad: int = NEIGHBORHOOD) -> DataFrame:
    """Variances from ``pad`` offsets before a hit to ``pad`` after it, in order."""
    span = hits.select("grp", F.col("off").alias("hit_off"), "size", F.explode(F.sequence(F.greatest(F.lit(0).cast("bigint"), F.col("off") - pad), F.col("off") + F.col("size") + pad - 1)).alias("off"))
    pairs = span.join(consensus.select("grp", "off", "variance"), ["grp", "off"]).groupBy("grp", "hit_off", "size").agg(F.array_sort(F.collect_list(F.struct("off", "variance"))).alias("w"))
    return pairs.select("grp", "hit_off", "size", F.col("w")[0]["off"].alias("start"), F.transform("w", lambda x: x["variance"]).alias("variances"))


def nsweep(images: DataFrame, ns: list[int], make_oracle: Callable[[], Callable[[bytes], bool]] | None = None, sizes: tuple[int, ...] = (32,), stride: int = 8, exhaustive: bool = True, chunk: int = CHUNK, whole: bool = False, **params) -> DataFrame:
    """One row per (group, N): stage counts, regions, candidates, those tried, hits, first hit.

    All candidates are tried, or without ``exhaustive`` those up to the first hit.  With ``whole``
    each group's own size is a checkpoint besides ``ns``.
    """
    stages, regions = reduce_images(images, ns, chunk, whole, **params)
    reference = held_images(images).filter("rank = 1").select("grp", "data")
    slices = candidate_slices(regions, reference, list(sizes), stride, chunk)
    out = stages.join(regions.groupBy("grp", "n").agg(F.count(F.lit(1)).alias("regions")), ["grp", "n"], "left").join(slices.groupBy("grp", "n").agg(F.count(F.lit(1)).alias("candidates")), ["grp", "n"], "left")
    if make_oracle:
        found = brute_force(slices, make_oracle, exhaustive)
        hits = found.groupBy("grp", "n").agg(F.count(F.lit(1)).alias("hits"), F.min("off").alias("hit_off"))
        if exhaustive:
            hits = hits.withColumn("tried", F.lit(None).cast("bigint"))
        else:
            first = found.select("grp", "n", F.struct("off", "size").alias("_first"))
            tried = slices.join(first, ["grp", "n"]).filter(F.struct("off", "size") <= F.col("_first")).groupBy("grp", "n").agg(F.count(F.lit(1)).alias("tried"))
            hits = hits.join(tried, ["grp", "n"], "left")
        out = out.join(hits, ["grp", "n"], "left").withColumn("tried", F.coalesce("tried", "candidates"))
    else:
        out = out.withColumns({"hits": F.lit(0).cast("bigint"), "hit_off": F.lit(None).cast("bigint"), "tried": F.lit(0).cast("bigint")})
    return out.na.fill(0, ["regions", "candidates", "hits", "tried"])


# The checkpoints of a convergence sweep.
CONVERGENCE_NS = [2, 3, 5, 7, 10, 15, 20, 25, 30, 50, 75, 100]


def report_markdown(points: list[dict]) -> str:
    """A sweep as a Markdown table (rows collected from ``nsweep``: a handful)."""
    head = ["n", "total", "variance", "aligned", "high_entropy", "candidates", "hits", "hit_off"]
    rows = ["| " + " | ".join(str(p.get(h) if p.get(h) is not None else "") for h in head) + " |" for p in sorted(points, key=lambda p: p["n"])]
    return "\n".join(["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *rows])


def report_html(title: str, points: list[dict]) -> str:
    """A sweep as a page with a bar for the bytes left at each N."""
    import html

    most = max((p["high_entropy"] for p in points), default=0) or 1
    bars = "".join(f"<tr><td>{p['n']}</td><td>{p['high_entropy']}</td><td><div style='background:#468;height:1em;width:{100 * p['high_entropy'] / most:.1f}%'></div></td></tr>" for p in sorted(points, key=lambda p: p["n"]))
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><table style='width:100%'><tr><th>N<th>bytes left<th style='width:70%'></tr>{bars}</table>"


def log2_limit(window: int) -> float:
    """The most bits per byte a window can have."""
    return math.log2(window)
