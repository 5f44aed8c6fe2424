"""Library analysis: where do the known secrets of all runs lie, in one plan over all libraries."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bytefold.functions.crypto import expand_secret
from bytefold.functions.kernels import Automaton


def expand_secrets(secrets: DataFrame) -> DataFrame:
    """Secrets and what derives from them; keeps the other columns."""
    keep = [c for c in secrets.columns if c not in ("secret_type", "secret_value")]
    kinds = dict(secrets.dtypes)

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, k, v) for i, (kind, value) in enumerate(zip(b.column("secret_type").to_pylist(), b.column("secret_value").to_pylist())) for k, v in [(kind, value), *expand_secret(kind or "", value or b"")]]
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in keep), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.binary())], names=[*keep, "secret_type", "secret_value"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
    return secrets.select(*keep, "secret_type", "secret_value").mapInArrow(expand, f"{schema}{', ' if schema else ''}secret_type string, secret_value binary")


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at_set, machine, kinds = None, None, {}
    for b in batches:
        at, kind, off, length = [], [], [], []
        for i, (data, size, base, needles) in enumerate(zip(*(b.column(c).to_pylist() for c in ("data", "size", "base_off", "needles")))):
            if needles != at_set:  # chunks of one run follow each other
                at_set, kinds = needles, {}
                for n in needles or ():
                    kinds.setdefault(n["secret_value"], []).append(n["secret_type"])
                machine = Automaton(list(kinds))
            for o, v in machine.find(data) if kinds else ():
                if o < size:
                    for k in kinds[v]:
                        at.append(i)
                        kind.append(k)
                        off.append(base + o)
                        length.append(len(v))
        ids = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("library").take(ids), b.column("run_number").take(ids), b.column("dump_id").take(ids), pa.array(kind, pa.string()), pa.array(off, pa.int64()), pa.array(length, pa.int32())], names=["library", "run_number", "dump_id", "secret_type", "off", "length"])


def library_hits(chunks: DataFrame, secrets: DataFrame, scope: str = "per_run", expand: bool = True) -> DataFrame:
    """Occurrences of secrets in the chunks of their library's runs.

    ``chunks(library, run_number, dump_id, base_off, size, data)`` with a halo of at least the
    longest secret less one; ``secrets(library, run_number, secret_type, secret_value)``.
    ``per_run`` searches a run's own secrets; ``first_run`` those of the library's first run in all
    of its runs.  Each chunk meets the needles of its library only.
    """
    needles = secrets.select("library", "run_number", "secret_type", "secret_value")
    if scope == "first_run":
        needles = needles.withColumn("_f", F.min("run_number").over(Window.partitionBy("library"))).filter(F.col("run_number") == F.col("_f")).drop("_f")
    if expand:
        needles = expand_secrets(needles)
    keys = ["library"] if scope == "first_run" else ["library", "run_number"]
    sets = needles.filter(F.octet_length("secret_value") > 0).groupBy(*keys).agg(F.collect_set(F.struct("secret_type", "secret_value")).alias("needles"))
    kinds = dict(chunks.dtypes)
    return chunks.join(sets, keys).select("library", "run_number", "dump_id", "base_off", "size", "data", "needles").mapInArrow(_find, f"library {kinds['library']}, run_number {kinds['run_number']}, dump_id {kinds['dump_id']}, secret_type string, off bigint, length int")


def library_report(hits: DataFrame) -> DataFrame:
    """Hits, offsets, types and runs per library, and over all (library null)."""
    return hits.rollup("library").agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("off").alias("offsets"), F.count_distinct("secret_type").alias("types"), F.count_distinct("run_number").alias("runs"))
