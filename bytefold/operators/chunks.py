"""Images as rows: chunks for kernels, single bytes for set-oriented plans.

``byte_chunks(dump_id, chunk_no, base_off, size, data)``: ``data`` holds the chunk's own ``size``
bytes and then a halo of following bytes, so a kernel with a window up to halo + 1 sees every
window that starts in the chunk and emits results for those starts only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Own bytes of a chunk: a multiple of every usual alignment and page size.
CHUNK = 1 << 16


def chunked(images: DataFrame, halo: int = 0, chunk: int = CHUNK, keep: list[str] | None = None) -> DataFrame:
    """Cut ``images(dump_id, data)`` into chunks; null and empty images have none.  No shuffle.

    Columns named in ``keep`` go along with every chunk.
    """
    keep = keep or []
    whole = images.select("dump_id", *keep, F.col("data").cast("binary").alias("data")).filter(F.octet_length("data") > 0)
    cut = whole.select("dump_id", *keep, "data", F.explode(F.sequence(F.lit(0), F.floor((F.octet_length("data") - 1) / chunk).cast("int"))).alias("chunk_no"))
    base = F.col("chunk_no").cast("bigint") * chunk
    part = F.substring("data", (base + 1).cast("int"), F.lit(chunk + halo))
    return cut.select("dump_id", *keep, "chunk_no", base.alias("base_off"), F.least(F.lit(chunk), F.octet_length("data") - base).cast("int").alias("size"), part.alias("data"))


def bytes_of(images: DataFrame) -> DataFrame:
    """One row per byte: ``dump_id, off, v`` (0..255).  For small images and comparison plans."""
    pairs = F.regexp_extract_all(F.hex(F.col("data").cast("binary")), F.lit("(..)"), F.lit(1))
    return images.select("dump_id", F.posexplode(pairs).alias("off", "h")).select("dump_id", F.col("off").cast("bigint").alias("off"), F.conv("h", 16, 10).cast("int").alias("v"))


def chunks_of_view(runs: DataFrame, halo: int = 0, chunk: int = CHUNK) -> DataFrame:
    """``byte_chunks`` of images kept as runs ``(dump_id, view_off, data)`` laid end to end.

    Serves containers, cores and mapped raw images alike: a run is cut at chunk borders, the pieces
    of a chunk and its halo meet by one exchange, and no image is ever put together as a whole.
    """
    size = F.octet_length("data").cast("bigint")
    rows = runs.select("dump_id", F.col("view_off").cast("bigint").alias("at"), F.col("data").cast("binary").alias("data")).filter(F.octet_length("data") > 0)
    first = F.greatest(F.lit(0).cast("bigint"), F.floor((F.col("at") - halo) / chunk))
    spread = rows.withColumn("n", F.explode(F.sequence(first, F.floor((F.col("at") + size - 1) / chunk))))
    low = F.greatest(F.col("n") * chunk, F.col("at"))
    high = F.least((F.col("n") + 1) * chunk + halo, F.col("at") + size)
    pieces = spread.filter(low < high).select("dump_id", "n", low.alias("low"), F.substring("data", (low - F.col("at") + 1).cast("int"), (high - low).cast("int")).alias("p"), F.greatest(F.lit(0), F.least((F.col("n") + 1) * chunk, high) - low).alias("own"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("low", "p"))), lambda x: x["p"])
    met = pieces.groupBy("dump_id", "n").agg(parts.alias("parts"), F.sum("own").cast("int").alias("size")).filter("size > 0")
    return met.select("dump_id", F.col("n").cast("int").alias("chunk_no"), (F.col("n") * chunk).alias("base_off"), "size", F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x)).alias("data"))


def around(images: DataFrame, places: DataFrame, before: int, after: int, chunk: int = CHUNK) -> DataFrame:
    """Chunks with the places that are looked at in them: ``dump_id, base_off, data, offsets``.

    Each of ``places(dump_id, off)`` comes out once, in a chunk that holds the bytes from ``before``
    ahead of it to ``after`` behind it as far as the image goes; ``offsets`` count from the chunk.
    Only chunks with places cross the exchange, never whole images.
    """
    at = places.select("dump_id", F.col("off").cast("bigint").alias("off")).withColumn("chunk_no", F.floor(F.greatest(F.lit(0), F.col("off") - before) / chunk).cast("int"))
    met = at.groupBy("dump_id", "chunk_no").agg(F.array_sort(F.collect_set("off")).alias("_at"))
    parts = chunked(images, before + after, chunk).select("dump_id", "chunk_no", "base_off", "data")
    joined = parts.join(met, ["dump_id", "chunk_no"])
    return joined.select("dump_id", "base_off", "data", F.transform("_at", lambda o: o - F.col("base_off")).alias("offsets"))
