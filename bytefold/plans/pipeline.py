"""The whole way from images to a verified key and a plugin, and experiments over several tools.

Stages write their results as tables into one folder, so a later stage or a refinement reads what an
earlier one left; between the stages a caller may stop the run.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytefold.operators import consensus as C
from bytefold.operators import runs as R
from bytefold.operators.chunks import CHUNK, chunked
from bytefold.plans import funnel, inspect
from bytefold.session import scratch_path


class Stopped(RuntimeError):
    """The caller asked the run to stop."""


def run_pipeline(images: DataFrame, make_oracle: Callable, name: str = "scan", ns: list[int] | None = None, sizes: tuple[int, ...] = (32,), stride: int = 8, exhaustive: bool = True, top_k: int = 10, plugin_threshold: float = 2000.0, root: str | None = None, stop: Callable[[], bool] = lambda: False, progress: Callable[[str, float], None] = lambda stage, done: None, **params) -> dict:
    """Consensus, reduction, predicate, optional sweep, plugin for the first hit, of one image set.

    ``images(grp, rank, dump_id, data)``.  Returns paths of the stages' tables, the stage counts,
    the first hits (or the best regions when there is none) with the count and the table of all,
    the sweep's points and the plugin's source.
    """
    spark = images.sparkSession
    root = root or scratch_path(spark, "pipeline")

    def stage(label: str, done: float) -> None:
        if stop():
            raise Stopped(label)
        progress(label, done)

    def keep(df: DataFrame, label: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{root}/{label}")
        return spark.read.schema(df.schema).parquet(f"{root}/{label}")

    stage("consensus", 0.0)
    whole = images.select(F.coalesce(F.col("grp").cast("string"), F.lit("")).alias("grp"), "rank", "dump_id", F.col("data").cast("binary").alias("data"))
    state = keep(C.consensus_state(chunked(whole, keep=["grp"]), F.col("grp")), "state")
    stage("reduce", 0.25)
    stages, regions = funnel.reduce_images(whole, **params)
    regions = keep(regions, "regions")
    stage("brute_force", 0.5)
    reference = funnel.held_images(whole).filter("rank = 1")
    slices = funnel.candidate_slices(regions, reference, list(sizes), stride)
    hits = keep(funnel.brute_force(slices, make_oracle, exhaustive), "hits")
    found = [r.asDict() for r in hits.orderBy("grp", "off", "size").limit(1000).collect()]
    out = {"root": root, "stages": [r.asDict() for r in stages.collect()], "hits": found, "hit_count": hits.count(), "hits_path": f"{root}/hits", "top": []}
    if not found:
        out["top"] = [r.asDict() for r in funnel.top_regions(regions, ["grp"], top_k).collect()]
    if ns:
        stage("nsweep", 0.75)
        points = funnel.nsweep(whole, ns, make_oracle, sizes, stride, exhaustive, **params)
        out["points"] = [r.asDict() for r in points.orderBy("grp", "n").collect()]
        out["headline"] = inspect.headline(out["points"])
    if found:
        stage("emit_plugin", 0.9)
        out["plugin"], out["rule"] = plugin_of(state, reference, found[0], name, plugin_threshold)
    progress("done", 1.0)
    return out


def plugin_of(state: DataFrame, reference: DataFrame, hit: dict, name: str, threshold: float = 2000.0, chunk: int = CHUNK) -> tuple[str, str]:
    """Plugin and rule from the saved state around a hit; only the neighborhood is read out."""
    spark = state.sparkSession
    one = spark.createDataFrame([(hit["grp"], hit["off"], hit["size"])], "grp string, off bigint, size int")
    pad = funnel.NEIGHBORHOOD
    chunks = F.col("chunk_no").between(max(0, hit["off"] - pad) // chunk, (hit["off"] + hit["size"] + pad) // chunk)
    near = funnel.neighborhood(C.expand(state.filter((F.col("grp") == hit["grp"]) & chunks), chunk), one, pad).first()
    part = reference.filter(F.col("grp") == hit["grp"]).select(F.substring("data", near["start"] + 1, len(near["variances"])).alias("d")).first()
    source, rule = inspect.plugin_for_hit({"off": hit["off"] - near["start"], "size": hit["size"], "start": 0, "variances": near["variances"]}, bytes(part["d"]), name, threshold)
    return source, rule


def refine(spark: SparkSession, root: str, more: DataFrame) -> DataFrame:
    """Fold more images into a pipeline's saved state; later stages see the new one."""
    state = spark.read.schema(C.STATE).parquet(f"{root}/state")
    new = C.consensus_state(chunked(more, keep=["grp"]), F.col("grp"))
    merged = C.merge_states(state.unionByName(new))
    merged.write.mode("overwrite").parquet(f"{root}/state-refined")
    return spark.read.schema(C.STATE).parquet(f"{root}/state-refined")


def experiment(images: DataFrame, block: int = 32, alignment: int = 16, density: float = 0.75) -> DataFrame:
    """Per tool: images, classes of bytes, aligned key candidates and their mean variance.

    ``images(tool, dump_id, data)``; all tools run in one plan, grouped by tool.
    """
    rows = C.expand(C.consensus_state(chunked(images, keep=["tool"]), F.col("tool")), CHUNK)
    dense = R.aligned_blocks(rows.filter(F.col("class") == C.KEY_CANDIDATE), ["grp"], None, block, alignment, density).join(rows, ["grp", "off"])
    regions = R.class_regions(dense, ["grp"], C.KEY_CANDIDATE, 16).groupBy("grp").agg(F.count(F.lit(1)).alias("regions"), F.max("length").alias("longest"))
    counts = rows.groupBy("grp").agg(F.max("n").alias("images"), *(F.sum((F.col("class") == k).cast("bigint")).alias(n) for k, n in enumerate(("invariant", "structural", "pointer", "key_candidate"))))
    return counts.join(regions, "grp", "left").na.fill(0).withColumnRenamed("grp", "tool")


class OracleRegistry:
    """Uploaded predicates: a file may run only after it was armed with its own digest."""

    def __init__(self, folder: str) -> None:
        self.folder = Path(folder)
        self.folder.mkdir(parents=True, exist_ok=True)
        self.folder.chmod(0o700)
        self.armed: set[str] = set()

    def upload(self, source: str) -> dict:
        """Store a predicate's source; its id is its digest, its shape is what it defines."""
        digest = hashlib.sha256(source.encode()).hexdigest()
        shape = "factory" if "def build_oracle" in source else "function" if "def verify" in source else None
        if shape is None:
            raise ValueError("the file defines neither verify nor build_oracle")
        path = self.folder / f"{digest}.py"
        path.write_text(source)
        path.chmod(0o600)
        return {"id": digest, "shape": shape}

    def arm(self, oracle_id: str, sha256: str) -> None:
        body = (self.folder / f"{oracle_id}.py").read_bytes()
        if not hashlib.sha256(body).hexdigest() == sha256 == oracle_id:
            raise PermissionError("the digest doesn't match the file")
        self.armed.add(oracle_id)

    def maker(self, oracle_id: str, config: dict | None = None) -> Callable:
        """A factory for ``brute_force``; the source travels with the plan, so executors need no file."""
        if oracle_id not in self.armed:
            raise PermissionError("the predicate isn't armed")
        source = (self.folder / f"{oracle_id}.py").read_text()

        def make():
            space: dict = {"__name__": "oracle"}
            exec(source, space)  # noqa: S102 - the user's own, armed predicate
            return space["build_oracle"](config or {}).verify if "build_oracle" in space else space["verify"]

        return make

    def dry_run(self, oracle_id: str, samples: list[bytes], config: dict | None = None) -> list[dict]:
        """Results and times on a few samples; an exception is reported and counts as a miss."""
        oracle, out = self.maker(oracle_id, config)(), []
        for s in samples:
            began = time.perf_counter()
            try:
                result, error = bool(oracle(s)), None
            except Exception as e:
                result, error = False, f"{type(e).__name__}: {e}"
            out.append({"ok": result, "error": error, "ms": (time.perf_counter() - began) * 1000})
        return out

    def delete(self, oracle_id: str) -> bool:
        path = self.folder / f"{oracle_id}.py"
        self.armed.discard(oracle_id)
        if path.is_file():
            path.unlink()
            return True
        return False


def collect_garbage(folder: str, quota: int) -> list[str]:
    """Delete the artifact folders least recently changed until the rest fits into ``quota`` bytes."""
    size = lambda p: sum(f.stat().st_size for f in p.rglob("*") if f.is_file()) if p.is_dir() else p.stat().st_size
    items = sorted(Path(folder).iterdir(), key=os.path.getmtime)
    sizes = {p: size(p) for p in items}
    total, gone = sum(sizes.values()), []
    for p in items:
        if total <= quota:
            break
        shutil.rmtree(p) if p.is_dir() else p.unlink()
        total -= sizes[p]
        gone.append(p.name)
    return gone


def register_artifacts(folder: str) -> list[dict]:
    """Name, size and SHA-256 of the files of a run."""
    return [{"name": str(p.relative_to(folder)), "size": p.stat().st_size, "sha256": hashlib.sha256(p.read_bytes()).hexdigest()} for p in sorted(Path(folder).rglob("*")) if p.is_file()]


def save_json(value, path: str) -> None:
    from bytefold.plans.report import jsonable

    Path(path).write_text(json.dumps(jsonable(value), indent=2))
