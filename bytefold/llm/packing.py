"""Filling fixed-capacity containers with texts.

Each partition packs its texts online into a fixed number of open windows per capacity: a text
goes into the window where it fits best; when it fits none, the fullest window is emitted as a
container and a new one is opened.  What a partition leaves open is merged afterwards, window by
window, in a tree: a node merges the windows of ``fan_in`` nodes below it, closes all but the
``windows`` with the most room and passes these on, so no task ever sees more than ``fan_in``
times ``windows`` of them, whatever the number of partitions.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytefold.llm.tokens import DEFAULT_VOCAB, count_tokens
from bytefold.session import materialize

_ITEMS = "pack_id int, capacity_tokens int, window_id bigint, left_open boolean, window_offset int, doc_id bigint, part_no int, token_start bigint, n_tokens int"


class BoundedPacker:
    """Best-fit packing with a bounded number of open windows.

    ``room`` is kept sorted as (free tokens, window number), so the best fit is one bisection and
    the fullest window is the first entry.
    """

    def __init__(self, capacity: int, windows: int, first_id: int) -> None:
        self.capacity, self.windows, self.next_id = capacity, windows, first_id
        self.room: list[tuple[int, int]] = []

    def _open(self) -> tuple[int, int]:
        window = (self.capacity, self.next_id)
        self.next_id += 1
        return window

    def place(self, size: int) -> tuple[int, int, int | None]:
        """Place ``size`` tokens: the window, the offset in it, and the window emitted to make room."""
        emitted = None
        at = bisect_left(self.room, (size, -1))
        if at < len(self.room):
            free, window = self.room.pop(at)
        else:
            if len(self.room) >= self.windows:
                emitted = self.room.pop(0)[1]
            free, window = self._open()
        if free - size > 0:
            insort(self.room, (free - size, window))
        return window, self.capacity - free, emitted


def _pack(capacities: list[tuple[int, int]], windows: int, vocab: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 36
        packers = [(pack_id, BoundedPacker(capacity, windows, first)) for pack_id, capacity in capacities]
        held: dict[tuple[int, int], list[tuple]] = {}  # items of windows not known to be closed
        names = [f.split()[0] for f in _ITEMS.split(", ")]
        schema = pa.schema(list(zip(names, [pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32()])))
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [[] for _ in names]
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
            out.clear()
            return batch

        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            sizes = count_tokens(batch.column("text").to_pylist(), vocab)
            for doc_id, size in zip(doc_ids, sizes):
                if not size:  # takes no room, so it is laid nowhere
                    out.extend((pack_id, packer.capacity, None, False, None, doc_id, 0, 0, 0) for pack_id, packer in packers)
                    continue
                for pack_id, packer in packers:
                    capacity = packer.capacity
                    part, start = 0, 0
                    while size - start > capacity:  # only a text beyond the capacity is split
                        out.append((pack_id, capacity, packer.next_id, False, 0, doc_id, part, start, capacity))
                        packer.next_id += 1
                        part, start = part + 1, start + capacity
                    rest = size - start
                    window, offset, emitted = packer.place(rest)
                    held.setdefault((pack_id, window), []).append((offset, doc_id, part, start, rest))
                    closed = [w for w in (emitted, window if offset + rest == capacity else None) if w is not None]
                    for w in closed:
                        out.extend((pack_id, capacity, w, False, *item) for item in held.pop((pack_id, w), ()))
            if len(out) >= 16_384:
                yield flush()
        capacity_of = dict(capacities)
        for (pack_id, window), items in held.items():
            out.extend((pack_id, capacity_of[pack_id], window, True, *item) for item in items)
        yield flush()

    return pack


def _merge(windows: int) -> Callable[[pa.Table], pa.Table]:
    def merge(group: pa.Table) -> pa.Table:
        """Best-fit decreasing over the windows of one node; the roomiest go on to the next."""
        rows = sorted(zip(group["used"].to_pylist(), group["window_id"].to_pylist()), key=lambda r: (-r[0], r[1]))
        packer = BoundedPacker(group["capacity_tokens"][0].as_py(), len(rows), 0)
        names: dict[int, int] = {}
        into, base = [], []
        for used, window in rows:
            slot, offset, _ = packer.place(used)
            into.append(names.setdefault(slot, window))  # a merged window keeps the id of its first part
            base.append(offset)
        onward = {names[slot]: packer.capacity - free for free, slot in packer.room[-windows:]}
        return pa.table(
            {
                "pack_id": pa.array([group["pack_id"][0].as_py()] * len(rows), pa.int32()),
                "capacity_tokens": pa.array([packer.capacity] * len(rows), pa.int32()),
                "window_id": pa.array([w for _, w in rows], pa.int64()),
                "into": pa.array(into, pa.int64()),
                "base": pa.array(base, pa.int32()),
                "used": pa.array([onward.get(w) for w in into], pa.int32()),  # null: closed
            }
        )

    return merge


_MERGED = "pack_id int, capacity_tokens int, window_id bigint, into bigint, base int, used int"


def _merge_left(left: DataFrame, windows: int, fan_in: int) -> DataFrame:
    """Where each window left open ends: ``pack_id, window_id, into, base``."""
    parts = (left.agg(F.max(F.shiftright("window_id", 36))).first()[0] or 0) + 1
    level = left.groupBy("pack_id", "capacity_tokens", "window_id").agg(F.sum("n_tokens").cast("int").alias("used"))
    placed = None
    node = F.shiftright("window_id", 36)
    while placed is None or parts > 1:
        node, parts = F.floor(node / fan_in), math.ceil(parts / fan_in)
        moved = materialize(level.withColumn("node", node).groupBy("pack_id", "node").applyInArrow(_merge(windows), _MERGED), "packing-merge")
        if placed is None:
            placed = moved.select("pack_id", "window_id", "into", "base")
        else:
            step = moved.select("pack_id", F.col("window_id").alias("into"), F.col("into").alias("to"), F.col("base").alias("shift"))
            placed = placed.join(step, ["pack_id", "into"], "left").select("pack_id", "window_id", F.coalesce("to", "into").alias("into"), (F.col("base") + F.coalesce("shift", F.lit(0))).alias("base"))
        level = moved.filter("used is not null and window_id = into").select("pack_id", "capacity_tokens", "window_id", "used")
    return placed


def pack_texts(documents: DataFrame, pack_sizes: DataFrame, windows: int = 32, fan_in: int = 64, vocab: str = DEFAULT_VOCAB, max_sizes: int = 1000) -> DataFrame:
    """Lay every text of ``documents(doc_id, text)`` into containers of each capacity.

    ``pack_sizes(pack_id, capacity_tokens)`` is a small dimension; more than ``max_sizes`` rows
    are refused.  Returns one row per placed piece: ``pack_id, capacity_tokens, container_id,
    container_offset, doc_id, part_no, token_start, n_tokens``.

    Defined cases: a text longer than a capacity fills whole containers and its rest is placed
    like a text; null and empty texts take no room and come out once per capacity with 0 tokens
    and a null container, so that no document is lost; equal sizes go to the lowest window;
    repeated rows are placed as often as they come; capacities that are null or below 1 are left
    out; no capacity or no document gives no row.  Further columns are never read.
    """
    sizes = pack_sizes.filter("pack_id is not null and capacity_tokens >= 1").select("pack_id", "capacity_tokens").distinct().limit(max_sizes + 1).collect()
    if len(sizes) > max_sizes:
        raise ValueError(f"more than {max_sizes} capacities")
    capacities = sorted((int(r[0]), int(r[1])) for r in sizes)
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = materialize(texts.mapInArrow(_pack(capacities, windows, vocab), _ITEMS), "packing")
    left = items.filter("left_open")
    placed = _merge_left(left, windows, fan_in)
    piece = ["doc_id", "part_no", "token_start", "n_tokens"]
    closed = items.filter(~F.col("left_open")).select("pack_id", "capacity_tokens", F.col("window_id").alias("container_id"), F.col("window_offset").alias("container_offset"), *piece)
    merged = left.join(placed, ["pack_id", "window_id"]).select("pack_id", "capacity_tokens", F.col("into").alias("container_id"), (F.col("base") + F.col("window_offset")).cast("int").alias("container_offset"), *piece)
    return closed.unionByName(merged)


def fill_report(packed: DataFrame) -> DataFrame:
    """Per capacity: containers, texts, split texts, tokens, the fewest containers possible, fill."""
    per = packed.groupBy("pack_id", "capacity_tokens").agg(
        F.count_distinct("container_id").alias("containers"),
        F.sum("n_tokens").alias("tokens"),
        F.sum((F.col("part_no") == 0).cast("bigint")).alias("texts"),
        F.sum((F.col("part_no") == 1).cast("bigint")).alias("split_texts"),
    )
    return per.withColumn("fewest", F.ceil(F.col("tokens") / F.col("capacity_tokens"))).withColumn("fill", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6))
