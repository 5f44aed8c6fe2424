"""Per-offset statistics across images.

The state of an offset is ``(n, sum x, sum x^2)`` in integers: exact and mergeable in any order.  A
state row holds one chunk of one group in the narrowest integers that ``n`` images can fill (one
image: its bytes alone), so the only exchange carries about as many bytes as the images themselves,
and far fewer where a task holds several images of a group.  Merging streams through sorted rows
with one chunk in memory.  Runs of a class are found inside the chunks, without a row per offset.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bytefold.functions.kernels import as_bytes
from bytefold.session import materialize

# Classes of a byte by its variance, and their upper cut-points.
INVARIANT, STRUCTURAL, POINTER, KEY_CANDIDATE = 0, 1, 2, 3
STRUCTURAL_MAX, POINTER_MAX = 200.0, 3000.0

STATE = "grp string, chunk_no int, n bigint, size int, sums binary, squares binary"

#: Bytes of states that a fold holds before it passes them on.
FOLD_BYTES = 64 << 20
#: Rows that ``expand`` puts into one batch.
_ROWS = 1 << 16
#: Groups whose image counts may be broadcast (some tens of bytes each); more are joined by a shuffle.
BROADCAST_GROUPS = 1_000_000


def classify(variance: Column) -> Column:
    """Class of a byte from its variance."""
    return F.when(variance == 0, INVARIANT).when(variance <= STRUCTURAL_MAX, STRUCTURAL).when(variance <= POINTER_MAX, POINTER).otherwise(KEY_CANDIDATE)


def band(value: Column, cuts: tuple[float, float, float], names: tuple[str, str, str, str]) -> Column:
    """Display band of a value: the first name whose cut-point lies above it, else the last."""
    return F.when(value < cuts[0], names[0]).when(value < cuts[1], names[1]).when(value < cuts[2], names[2]).otherwise(names[3])


# Display bands of variance and entropy.
VARIANCE_BANDS = ((1.0, 50.0, 200.0), ("static", "low", "medium", "high"))
ENTROPY_BANDS = ((2.0, 5.0, 7.0), ("low", "medium", "high", "random"))


def _types(n: int) -> tuple[type, type]:
    """The narrowest integers for the sum and the sum of squares of ``n`` bytes."""
    fit = lambda top: next(t for t in (np.uint16, np.uint32, np.uint64) if n * top <= np.iinfo(t).max)
    return fit(255), fit(255 * 255)


class ChunkState:
    """Count, sums and sums of squares of one chunk; of a single image the bytes themselves."""

    __slots__ = ("n", "sums", "squares")

    def __init__(self, n: int, sums: np.ndarray, squares: np.ndarray | None) -> None:
        self.n, self.sums, self.squares = n, sums, squares

    @classmethod
    def read(cls, n: int, sums, squares) -> ChunkState:
        if n == 1:
            return cls(1, as_bytes(sums), None)
        s, q = _types(n)
        return cls(n, np.frombuffer(sums, dtype=s), np.frombuffer(squares, dtype=q))

    def powers(self) -> np.ndarray:
        return np.multiply(self.sums, self.sums, dtype=np.uint32) if self.squares is None else self.squares

    def add(self, other: ChunkState) -> ChunkState:
        """Both together, over what both hold."""
        n, m = self.n + other.n, min(len(self.sums), len(other.sums))
        (s, q), pair = _types(n), (self.powers()[:m], other.powers()[:m])
        return ChunkState(n, np.add(self.sums[:m], other.sums[:m], dtype=s), np.add(*pair, dtype=q))

    def cut(self, part: slice) -> ChunkState:
        return ChunkState(self.n, self.sums[part], None if self.squares is None else self.squares[part])

    def spread(self) -> np.ndarray:
        """``n * sum x^2 - (sum x)^2``: the variance times n squared, exact, in 32 bits while it fits."""
        kind = np.uint32 if self.n * self.n * 255 * 255 <= np.iinfo(np.uint32).max else np.int64
        out = np.multiply(self.powers(), self.n, dtype=kind, casting="unsafe")
        out -= np.multiply(self.sums, self.sums, dtype=kind, casting="unsafe")
        return out

    def variance(self) -> np.ndarray:
        return self.spread() / float(self.n * self.n)

    def row(self) -> tuple[int, int, bytes, bytes]:
        return self.n, len(self.sums), self.sums.tobytes(), b"" if self.squares is None else self.squares.tobytes()

    @property
    def nbytes(self) -> int:
        return self.sums.nbytes + (0 if self.squares is None else self.squares.nbytes)


def state_batch(held: dict[tuple, ChunkState]) -> pa.RecordBatch:
    rows = [(*key, *state.row()) for key, state in held.items()]
    types = [pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
    names = ["grp", "chunk_no", "n", "size", "sums", "squares"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def _keyed(batch: pa.RecordBatch) -> Iterator[tuple[tuple, ChunkState]]:
    """The states of a batch of chunks or of states, without copying their bytes."""
    keys = zip(batch.column("grp").to_pylist(), batch.column("chunk_no").to_pylist())
    if "data" in batch.schema.names:
        for key, data, size in zip(keys, batch.column("data"), batch.column("size").to_pylist()):
            yield key, ChunkState(1, as_bytes(data.as_buffer())[:size], None)
    else:
        for key, n, sums, squares in zip(keys, batch.column("n").to_pylist(), batch.column("sums"), batch.column("squares")):
            yield key, ChunkState.read(n, sums.as_buffer(), squares.as_buffer())


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks or states to one state per (group, chunk) while they fit; what is split here is added up later."""
    held: dict[tuple, ChunkState] = {}
    size = 0
    for batch in batches:
        for key, state in _keyed(batch):
            if key in held:
                size -= held[key].nbytes
                state = held[key].add(state)
            held[key] = state
            size += state.nbytes
            if size >= FOLD_BYTES:
                yield state_batch(held)
                held, size = {}, 0
    if held:
        yield state_batch(held)


def consensus_state(chunks: DataFrame, group: Column | None = None) -> DataFrame:
    """States of ``byte_chunks`` by group; ``merge_states`` makes them final.

    Images are cut to the shortest of their group: chunks not held by all are dropped when the
    state is read (``whole_chunks``), the last one is cut in the fold.
    """
    g = (F.lit("") if group is None else F.coalesce(group.cast("string"), F.lit(""))).alias("grp")
    return merge_states(chunks.select(g, "chunk_no", "size", "data").mapInArrow(_fold, STATE))


def merge_states(states: DataFrame) -> DataFrame:
    """Add up states (of disjoint images) to one per (group, chunk)."""
    return states.repartition("grp", "chunk_no").sortWithinPartitions("grp", "chunk_no").mapInArrow(_merge, STATE)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted states: equal keys follow each other, so one chunk is held besides the rows to pass on."""
    done: dict[tuple, ChunkState] = {}
    at, size = None, 0
    for batch in batches:
        for key, state in _keyed(batch):
            if key == at:
                size -= done[key].nbytes
                state = done[key].add(state)
            elif size >= FOLD_BYTES:
                yield state_batch(done)
                done, size = {}, 0
            at, done[key] = key, state
            size += state.nbytes
    if done:
        yield state_batch(done)


def whole_chunks(states: DataFrame) -> DataFrame:
    """The states that hold all images of their group, from a table of states in the shared folder.

    A chunk with fewer images than the group's first chunk lies beyond the shortest image.  Writing
    the states first cuts the lineage, spares every later reader the images, and lets the group's
    size be read from two narrow columns; the states themselves are never gathered by group.
    """
    held = materialize(states, "consensus")
    most = held.groupBy("grp").agg(F.max("n").alias("_images"))
    few = most.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    return held.join(F.broadcast(most) if few else most, "grp").filter(F.col("n") == F.col("_images")).select(*held.columns)


def _expand(chunk: int):
    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        rows = 0

        def put() -> pa.RecordBatch:
            groups, offs, ns, means, variances = zip(*parts)
            names = pa.array(groups, pa.string()).take(pa.array(np.repeat(np.arange(len(parts)), [len(o) for o in offs])))
            arrays = [names, *(pa.array(np.concatenate(c)) for c in (offs, ns, means, variances))]
            return pa.RecordBatch.from_arrays(arrays, names=["grp", "off", "n", "mean", "variance"])

        for batch in batches:
            for (grp, no), state in _keyed(batch):
                variance = state.variance()
                for a in range(0, len(variance), _ROWS):
                    v, s = variance[a : a + _ROWS], state.sums[a : a + _ROWS]
                    off = np.arange(a, a + len(v), dtype=np.int64) + no * chunk
                    parts.append((grp, off, np.full(len(v), state.n, dtype=np.int64), s / float(state.n), v))
                    rows += len(v)
                    if rows >= _ROWS:
                        yield put()
                        parts, rows = [], 0
        if parts:
            yield put()

    return expand


def expand(states: DataFrame, chunk: int, whole: bool = False) -> DataFrame:
    """Rows per offset: ``grp, off, n, mean, variance, class`` (population variance).

    Only offsets that all images of the group hold.  For runs and counts of a class use
    ``state_runs`` and ``class_totals``, which make no row per offset.  With ``whole`` the states are
    known to hold all images of their group (those of ``whole_chunks`` and of ``file_states``).
    """
    rows = (states if whole else whole_chunks(states)).mapInArrow(_expand(chunk), "grp string, off bigint, n bigint, mean double, variance double")
    return rows.withColumn("class", classify(F.col("variance")))


def _classes(variance: np.ndarray) -> np.ndarray:
    return (variance > 0).astype(np.int8) + (variance > STRUCTURAL_MAX) + (variance > POINTER_MAX)


_RUNS = "grp string, class int, chunk_no int, start bigint, end bigint, v double, n bigint"


def _runs(chunk: int):
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for (grp, no), state in _keyed(batch):
                variance = state.variance()
                if not len(variance):
                    continue
                kinds = _classes(variance)
                first = np.flatnonzero(np.concatenate([[True], kinds[1:] != kinds[:-1]]))
                end = np.append(first[1:], len(kinds))
                parts.append((grp, no, kinds[first], first + no * chunk, end + no * chunk, np.add.reduceat(variance, first), state.n))
            if not parts:
                continue
            grp, no, kinds, first, end, total, n = zip(*parts)
            sizes = [len(k) for k in kinds]
            each = lambda values, kind: pa.array(values, kind).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
            flat = lambda arrays, kind: pa.array(np.concatenate(arrays), kind)
            arrays = [each(grp, pa.string()), flat([k.astype(np.int32) for k in kinds], pa.int32()), each(no, pa.int32()), flat(first, pa.int64()), flat(end, pa.int64()), flat(total, pa.float64()), each(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["grp", "class", "chunk_no", "start", "end", "v", "n"])

    return runs


def state_runs(states: DataFrame, chunk: int, wanted: list[int] | None = None, whole: bool = False) -> DataFrame:
    """Maximal runs of one class straight from the states: ``grp, class, start, end, length, mean_variance``.

    Runs are formed in the chunks; only those that touch a chunk's edge are put together over the
    image.  ``wanted`` keeps some classes; with ``whole`` the states are known to be whole chunks.
    """
    local = (states if whole else whole_chunks(states)).mapInArrow(_runs(chunk), _RUNS)
    if wanted is not None:
        local = local.filter(F.col("class").isin(wanted))
    edge = (F.col("start") % chunk == 0) | (F.col("end") % chunk == 0)
    along = Window.partitionBy("grp", "class").orderBy("start")
    new = F.coalesce((F.lag("end").over(along) < F.col("start")).cast("int"), F.lit(1))
    met = local.filter(edge).withColumn("_n", new).withColumn("_r", F.sum("_n").over(along))
    met = met.groupBy("grp", "class", "_r").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("v").alias("v"))
    out = ["grp", "class", "start", "end", "v"]
    length = F.col("end") - F.col("start")
    return local.filter(~edge).select(*out).unionByName(met.select(*out)).select("grp", "class", "start", "end", length.alias("length"), (F.col("v") / length).alias("mean_variance"))


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for (grp, _), state in _keyed(batch):
            spread = state.spread()
            moving = spread[spread > 0] / float(state.n * state.n)
            if still := len(spread) - len(moving):
                rows.append((grp, INVARIANT, still, 0.0, 0.0, 0.0, state.n))
            kinds = _classes(moving)
            for k in (STRUCTURAL, POINTER, KEY_CANDIDATE):
                if len(x := moving[kinds == k]):
                    rows.append((grp, k, len(x), float(x.sum()), float(x.min()), float(x.max()), state.n))
        if rows:
            types = [pa.string(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["grp", "class", "offsets", "v", "low", "high", "n"])


def class_totals(states: DataFrame, whole: bool = False) -> DataFrame:
    """Per group and class: ``grp, class, images, offsets, mean_variance, min_variance, max_variance``; a row per chunk and class at most."""
    rows = (states if whole else whole_chunks(states)).mapInArrow(_totals, "grp string, class int, offsets bigint, v double, low double, high double, n bigint")
    out = rows.groupBy("grp", "class").agg(F.max("n").alias("images"), F.sum("offsets").alias("offsets"), F.sum("v").alias("v"), F.min("low").alias("min_variance"), F.max("high").alias("max_variance"))
    return out.select("grp", "class", "images", "offsets", (F.col("v") / F.col("offsets")).alias("mean_variance"), "min_variance", "max_variance")


def _sums_of(chunk: int):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for ((grp, no), state), spans in zip(_keyed(batch), batch.column("spans").to_pylist()):
                total = np.concatenate([[0.0], np.cumsum(state.variance())])
                base, held = no * chunk, len(total) - 1
                for span in spans:
                    low, high = (min(max(x - base, 0), held) for x in (span["start"], span["end"]))
                    rows.append((grp, span["start"], span["end"], float(total[high] - total[low]), high - low))
            if rows:
                types = [pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["grp", "start", "end", "v", "offsets"])

    return sums


def span_means(held: DataFrame, spans: DataFrame, chunk: int) -> DataFrame:
    """Mean variance of ``spans(grp, start, end)`` over whole chunks: ``grp, start, end, mean_variance``.

    The disjoint spans meet the chunks they lie in; a chunk is looked at once for all of its spans.
    """
    touched = spans.select("grp", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / chunk).cast("int"), F.floor((F.col("end") - 1) / chunk).cast("int"))).alias("chunk_no"))
    per = touched.groupBy("grp", "chunk_no").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    parts = held.join(per, ["grp", "chunk_no"]).select(*held.columns, "spans").mapInArrow(_sums_of(chunk), "grp string, start bigint, end bigint, v double, offsets bigint")
    return parts.groupBy("grp", "start", "end").agg((F.sum("v") / F.sum("offsets")).alias("mean_variance"))


def consensus_of_bytes(rows: DataFrame, by: list[str]) -> DataFrame:
    """The same from single-byte rows ``(…by, off, v)`` with built-in aggregates only."""
    v = F.col("v").cast("bigint")
    n, s, q = F.count("v"), F.sum(v), F.sum(v * v)
    out = rows.groupBy(*by, "off").agg(n.alias("n"), s.alias("s"), q.alias("q"))
    var = (F.col("n") * F.col("q") - F.col("s") * F.col("s")) / (F.col("n") * F.col("n")).cast("double")
    return out.select(*by, "off", "n", (F.col("s") / F.col("n")).alias("mean"), var.alias("variance")).withColumn("class", classify(F.col("variance")))


def class_counts(consensus: DataFrame, by: list[str] | None = None) -> DataFrame:
    return consensus.groupBy(*(by or []), "class").agg(F.count(F.lit(1)).alias("offsets"))


def variance_summary(consensus: DataFrame, by: list[str] | None = None) -> DataFrame:
    v = F.col("variance")
    return consensus.groupBy(*(by or [])).agg(F.avg(v).alias("mean_variance"), F.min(v).alias("min_variance"), F.max(v).alias("max_variance"))
