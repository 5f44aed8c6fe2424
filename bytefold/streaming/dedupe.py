"""Exactly one copy of each message, on Structured Streaming.

State lives in the keyed state store.  Its keys are prefixes of the messages' hashes, as many as it
takes to keep every state small (``STATE_MESSAGES``); a state holds, for every live message, the copy
that remains so far (earliest event time, then smallest id).  Each copy that loses is emitted as
surplus at once, so the outcome doesn't depend on the order of arrival.  A message that saw no copy
for ``retention`` behind the watermark leaves the state, by a timer if its prefix gets no more rows:
its remaining copy goes to the archive, and nothing of it stays in memory.  Late arrivals are looked
up: copies of one message that met in no state are told apart in the archive and the live states
(``settle``).  State and output are committed together by the checkpoint and the file sink's log.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from bytefold.functions.normalize import micros_of, norm_id, trimmed
from bytefold.session import path_exists, scratch_path

SURPLUS, ARCHIVED = 0, 1

#: Event time of a copy that has none: it ranks after all others and never moves the watermark.
NO_TIME = np.iinfo(np.int64).max

_ENTRY = np.dtype([("h1", "<i8"), ("h2", "<i8"), ("ts", "<i8"), ("id", "<i8"), ("last", "<i8")])
_OUT = "kind int, h1 bigint, h2 bigint, ts bigint, id bigint"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _by_key(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows ordered by key, then best copy first, and where each key starts."""
    rows = rows[np.lexsort((rows["id"], rows["ts"], rows["h2"], rows["h1"]))]
    first = np.ones(len(rows), dtype=bool)
    first[1:] = (rows["h1"][1:] != rows["h1"][:-1]) | (rows["h2"][1:] != rows["h2"][:-1])
    return rows, first


def _entries(h1, h2, ts, ids) -> np.ndarray:
    rows = np.empty(len(ids), dtype=_ENTRY)
    rows["h1"], rows["h2"], rows["ts"], rows["id"] = h1, h2, ts, ids
    rows["last"] = np.where(rows["ts"] == NO_TIME, 0, rows["ts"])
    return rows


#: Messages that one state holds about, were all of the input live at once.
STATE_MESSAGES = 2048
#: Bits of the prefixes: 512 states for small inputs, 16 million at most.
_LEAST_BITS, _MOST_BITS = 9, 24
_HASH_BITS = 60
#: Key of the rows that move the watermark.
_CLOCK = -(1 << 40)


def prefix_bits(messages: int) -> int:
    """Bits of the hash prefix that keep the states of so many messages small."""
    return min(_MOST_BITS, max(_LEAST_BITS, (messages // STATE_MESSAGES).bit_length()))


def _combine(bits: int):
    """Settle copies that meet within one block, so that a hot message is one row per block."""

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            rows, first = _by_key(_entries(*(b.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2", "ts", "id"))))
            again = np.zeros(len(rows), dtype=bool)  # the same copy read twice
            again[1:] = ~first[1:] & (rows["id"][1:] == rows["id"][:-1])
            rows, first = rows[~again], first[~again]
            prefix = np.where(first, rows["h1"] >> (_HASH_BITS - bits), -1 - (rows["h1"] >> (_HASH_BITS - bits)))
            newest = int(np.where(rows["ts"] == NO_TIME, 0, rows["ts"]).max())
            # Rows of messages have no time for the watermark, so none is dropped as late; one row
            # per block moves it.
            columns = [np.append(x, y) for x, y in ((prefix, _CLOCK), *((rows[c], 0) for c in ("h1", "h2", "ts", "id")))]
            at = pa.array([None] * len(rows) + [newest], pa.int64()).cast(pa.timestamp("us", tz="UTC"))
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), at], names=["prefix", "h1", "h2", "ts", "id", "at"])

    return combine


def merge_block(live: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge new copies into a state: the live entries after it, and the copies that lost."""
    rows, first = _by_key(np.concatenate([live, new]))
    key = np.cumsum(first) - 1
    kept = rows[first].copy()
    last = np.zeros(len(kept), dtype=np.int64)
    np.maximum.at(last, key, rows["last"])
    kept["last"] = last
    lost = ~first & (rows["id"] != kept["id"][key])  # the same copy read twice is not surplus
    return kept, rows[lost]


def _frame(parts: list[tuple[int, np.ndarray]]) -> pd.DataFrame:
    parts = [(k, r) for k, r in parts if len(r)]
    kinds = np.concatenate([np.full(len(r), k, dtype=np.int32) for k, r in parts]) if parts else np.zeros(0, dtype=np.int32)
    rows = np.concatenate([r for _, r in parts]) if parts else np.zeros(0, dtype=_ENTRY)
    return pd.DataFrame({"kind": kinds} | {c: rows[c] for c in ("h1", "h2", "ts", "id")})


def _keep(retention_us: int):
    def keep(key: tuple, blocks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if key[0] < 0:  # settled before: only passed on
            for b in blocks if key[0] != _CLOCK else ():
                yield _frame([(SURPLUS, _entries(*(b[c].to_numpy() for c in ("h1", "h2", "ts", "id"))))])
            return
        live = np.frombuffer(state.get[0], dtype=_ENTRY) if state.exists else np.zeros(0, dtype=_ENTRY)
        if not state.hasTimedOut:
            for b in blocks:
                live, lost = merge_block(live, _entries(*(b[c].to_numpy() for c in ("h1", "h2", "ts", "id"))))
                yield _frame([(SURPLUS, lost)])
        old = live["last"] < state.getCurrentWatermarkMs() * 1000 - retention_us
        yield _frame([(ARCHIVED, live[old])])
        live = live[~old]
        if len(live):
            state.update((live.tobytes(),))
            state.setTimeoutTimestamp(int(live["last"].min() + retention_us) // 1000 + 1)
        elif state.exists:
            state.remove()

    return keep


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings that hold while a query is started and run."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _files(spark: SparkSession, path: str, schema, per_trigger: int) -> DataFrame:
    """A stream of the Parquet files in a folder; of a single file, its folder seen through its name."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isFile():
        return reader.option("pathGlobFilter", target.getName()).parquet(target.getParent().toString())
    return reader.parquet(path)


def surplus_copies(spark: SparkSession, path: str, key: list[Column], at: Column, copy_id: Column, delay: str = "1 day", retention: str = "30 days", files_per_trigger: int = 8, work_dir: str | None = None) -> DataFrame:
    """The ids of all copies but one of each message in the Parquet files at ``path``.

    The copy of the earliest time ``at`` (microseconds) remains, then of the smallest ``copy_id``.
    Runs a streaming query to the end of the files there are; with ``work_dir`` a later call goes
    on from the checkpoint and takes only new files.  Returns ``id``, one row per surplus copy.

    Defined cases: a copy with a null in any key column is a message of its own; a null time
    ranks last; the same copy read twice is one copy; an empty input gives no row; columns not
    named in the expressions are never read.
    """
    work = work_dir or scratch_path(spark, "dedupe")
    known = spark.read.parquet(path)
    source = _files(spark, path, known.schema, files_per_trigger)
    bits = _prefix_bits(spark, work, known)
    whole = F.lit(True)
    for c in key:
        whole = whole & c.isNotNull()
    digest = F.md5(F.concat_ws("\x1f", *(c.cast("string") for c in key)))
    number = lambda start: F.conv(F.substring(digest, start, 15), 16, 10).cast("bigint")
    rows = source.filter(whole & copy_id.isNotNull()).select(number(1).alias("h1"), number(16).alias("h2"), F.coalesce(at, F.lit(int(NO_TIME))).alias("ts"), copy_id.cast("bigint").alias("id"))
    blocks = rows.mapInArrow(_combine(bits), "prefix bigint, h1 bigint, h2 bigint, ts bigint, id bigint, at timestamp").withWatermark("at", delay)
    span = int(pd.Timedelta(retention).total_seconds() * 1_000_000)
    events = blocks.groupBy("prefix").applyInPandasWithState(_keep(span), _OUT, "live binary", "append", GroupStateTimeout.EventTimeTimeout)
    # State stores are opened for every batch whether or not they have rows: two per core do.
    partitions = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    with settings(spark, {"spark.sql.streaming.stateStore.providerClass": _ROCKSDB, "spark.sql.shuffle.partitions": str(partitions)}):
        query = events.writeStream.format("parquet").option("path", f"{work}/events").option("checkpointLocation", f"{work}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    return settle(spark.read.schema(_OUT).parquet(f"{work}/events"), live_copies(spark, f"{work}/checkpoint"))


def _prefix_bits(spark: SparkSession, work: str, known: DataFrame) -> int:
    """The prefix length of a work folder, set when the stream is started first."""
    if path_exists(spark, f"{work}/prefix"):
        return spark.read.schema("bits int").json(f"{work}/prefix").first()["bits"]
    bits = prefix_bits(known.count())  # from the files' footers
    spark.range(1).select(F.lit(bits).alias("bits")).coalesce(1).write.json(f"{work}/prefix")
    return bits


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for blob in b.column("live"):
            rows = np.frombuffer(blob.as_buffer(), dtype=_ENTRY) if blob.is_valid else np.zeros(0, dtype=_ENTRY)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), ARCHIVED, dtype=np.int32)), *(pa.array(rows[c].copy()) for c in ("h1", "h2", "ts", "id"))], names=["kind", "h1", "h2", "ts", "id"])


def live_copies(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The remaining copies of the messages that are still in the state store, as archive rows."""
    states = spark.read.format("statestore").load(checkpoint)
    value = F.col("value.groupState.live") if "groupState" in states.schema["value"].dataType.names else F.col("value.live")
    return states.select(value.alias("live")).mapInArrow(_unpack, _OUT)


def settle(events: DataFrame, live: DataFrame) -> DataFrame:
    """Surplus ids: those the stream emitted, and all but the best of the copies that met in no state.

    Such copies are of one key in the archive and the live states; only keys with several come out
    of the aggregate, so the join behind it is small.
    """
    apart = events.filter(F.col("kind") == ARCHIVED).unionByName(live).select("h1", "h2", "ts", "id")
    several = apart.groupBy("h1", "h2").agg(F.min(F.struct("ts", "id")).alias("best"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    late = apart.join(several, ["h1", "h2"]).filter(F.col("id") != F.col("best.id")).select("id")
    return events.filter(F.col("kind") == SURPLUS).select("id").unionByName(late).distinct()


def surplus_messages(spark: SparkSession, path: str, **options) -> DataFrame:
    """Surplus deliveries of progress messages: one message per task id, sequence number and type."""
    kind = F.coalesce(F.lower(trimmed("type")), F.lit("\x00"))  # a null type is a type of its own
    return surplus_copies(spark, path, [norm_id("task_id"), F.col("seq"), kind], micros_of("received_at"), F.col("delivery_id"), **options)
