"""Consensus built up dump by dump, and progress events, on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bytefold.operators.chunks import CHUNK, chunked
from bytefold.operators.consensus import STATE, consensus_state, expand, merge_states
from bytefold.session import scratch_path

#: Messages of a task that the reference's ring holds.
RING = 512


class ConsensusSession:
    """A session of incremental consensus over a folder of images.

    ``add`` folds more images into the state; ``follow`` does so from a stream, batch by batch.
    The state is a versioned table in the shared folder; a batch that is run again after a failure
    replaces its own version, so no image is folded twice.
    """

    def __init__(self, spark: SparkSession, size: int | None = None, short: str = "error", root: str | None = None, chunk: int = CHUNK) -> None:
        if short not in ("error", "skip"):
            raise ValueError("short images are an error or skipped")
        self.spark, self.size, self.short, self.chunk = spark, size, short, chunk
        self.root, self.version, self.finalized = root or scratch_path(spark, "session"), 0, False

    def state(self) -> DataFrame:
        if not self.version:
            return self.spark.createDataFrame([], STATE)
        return self.spark.read.schema(STATE).parquet(f"{self.root}/v{self.version}")

    def _check(self, images: DataFrame) -> DataFrame:
        """Images cut to the session's size; too short ones are an error or left out."""
        if self.size is None:
            return images
        length = F.coalesce(F.octet_length("data"), F.lit(0))
        if self.short == "error" and (bad := images.filter(length < self.size).select("dump_id").first()):
            raise ValueError(f"image {bad[0]} is shorter than {self.size} bytes")
        return images.filter(length >= self.size).withColumn("data", F.substring("data", F.lit(1), F.lit(self.size)))

    def add(self, images: DataFrame, version: int | None = None) -> None:
        """Fold images ``(dump_id, data)`` in."""
        if self.finalized:
            raise RuntimeError("the session is finalized")
        cut = self._check(images.select("dump_id", F.col("data").cast("binary").alias("data")))
        new = consensus_state(chunked(cut, 0, self.chunk))
        target = version or self.version + 1
        merge_states(self.state().unionByName(new)).write.mode("overwrite").parquet(f"{self.root}/v{target}")
        self.version = target

    def follow(self, stream: DataFrame) -> None:
        """Fold a stream of images until the files there are used up."""

        def fold(batch: DataFrame, epoch: int) -> None:
            if self.version < epoch + 1:
                self.add(batch, epoch + 1)

        query = stream.writeStream.foreachBatch(fold).option("checkpointLocation", f"{self.root}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()

    def live(self) -> DataFrame:
        """Variance as of now; zeros before a second image."""
        return expand(self.state(), self.chunk)

    def stats(self) -> dict:
        """Images so far, mean and largest variance, the five largest offsets."""
        rows = self.live()
        top = [(r["off"], r["variance"]) for r in rows.orderBy(F.desc("variance"), "off").limit(5).collect()]
        one = rows.agg(F.max("n").alias("n"), F.avg("variance").alias("mean"), F.max("variance").alias("max")).first()
        return {"images": one["n"] or 0, "mean_variance": one["mean"] or 0.0, "max_variance": one["max"] or 0.0, "top": top}

    def finalize(self) -> DataFrame:
        self.finalized = True
        return self.live()


def in_ring(events: DataFrame, ring: int = RING) -> DataFrame:
    """The last ``ring`` messages of each task; copies of a message take one place, the first to arrive stays."""
    key = [c for c in ("task_id", "seq", "type") if c in events.columns]
    copy = Window.partitionBy(*key).orderBy(*(c for c in ("received_at", "delivery_id") if c in events.columns), F.lit(0))
    once = events.withColumn("_n", F.row_number().over(copy)).filter("_n = 1")
    last = Window.partitionBy("task_id").orderBy(*(F.desc(c) for c in key[1:]))
    return once.withColumn("_n", F.row_number().over(last)).filter(F.col("_n") <= ring).drop("_n")


def replay(events: DataFrame, task_id: str, since: int = 0, ring: int = 1000) -> DataFrame:
    """Messages of a task after a sequence number, of the last ``ring`` that are kept."""
    return in_ring(events.filter(F.col("task_id") == task_id), ring).filter(F.col("seq") > since).orderBy("seq")


def idle_sessions(events: DataFrame, ttl_seconds: int, at: str = "received_at") -> DataFrame:
    """Tasks whose last event is older than the limit, measured from the newest event of all."""
    last = events.groupBy("task_id").agg(F.max(at).alias("last_at"))
    newest = events.agg(F.max(at).alias("m")).scalar()
    return last.filter(F.col("last_at") < newest - F.make_dt_interval(secs=F.lit(ttl_seconds)))


def run_tagged(spark: SparkSession, tag: str, action):
    """Run an action under a tag, so that ``cancel(tag)`` from another thread ends its jobs."""
    spark.addTag(tag)
    try:
        return action()
    finally:
        spark.removeTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    spark.interruptTag(tag)
