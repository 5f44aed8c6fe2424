"""Command line: ``python -m bytefold COMMAND …``; results go to a JSON file or standard output.

Exit codes: 0 a result or a hit, 2 no hit, 1 an error.
"""

from __future__ import annotations

import argparse
import glob
import json
import os
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytefold.functions.crypto import verifies
from bytefold.operators import consensus as C
from bytefold.operators import runs as R
from bytefold.operators.chunks import chunked
from bytefold.plans import funnel, inspect, library, patterns, report
from bytefold.session import local_session
from bytefold.sources import catalog, codec
from bytefold.sources.images import file_states
from bytefold.streaming.sessions import ConsensusSession

_FUNNEL = {"alignment": int, "block_size": int, "density_threshold": float, "min_variance": float, "entropy_window": int, "entropy_threshold": float, "min_region": int}


def _paths(items: list[str], pattern: str = "*") -> list[str]:
    return sorted(p for i in items for p in ([i] if os.path.isfile(i) else glob.glob(os.path.join(i, "**", pattern), recursive=True)) if os.path.isfile(p))


def _images(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Files as images in the order given: ``grp, rank, dump_id, data``."""
    order = spark.createDataFrame([(os.path.abspath(p), i + 1) for i, p in enumerate(paths)], "dump_id string, rank int")
    files = spark.read.format("binaryFile").load(list(map(os.path.abspath, paths)))
    return files.select(F.regexp_replace("path", "^file:(//)?", "").alias("dump_id"), F.col("content").alias("data")).join(F.broadcast(order), "dump_id").select(F.lit("").alias("grp"), "rank", "dump_id", "data")


def _params(a) -> dict:
    return {k: getattr(a, k) for k in _FUNNEL}


def _rows(df: DataFrame) -> list[dict]:
    return [report.jsonable(r.asDict(recursive=True)) for r in df.collect()]


def cmd_scan(spark, a):
    files = spark.createDataFrame([(p, os.path.getsize(p)) for p in _paths([a.root])] or [], "path string, size bigint")
    return _rows(catalog.dataset_summary(catalog.parse_runs(catalog.parse_dumps(files))).orderBy("library"))


def cmd_analyze(spark, a):
    paths = _paths(a.library_dirs)
    dumps = catalog.parse_runs(catalog.parse_dumps(spark.createDataFrame([(p,) for p in paths], "path string"))).filter("library is not null")
    dumps = catalog.normalize_phases(dumps, ["library", "run_number"]) if a.normalize else dumps
    chosen = catalog.dump_for_phase(dumps, ["library", "run_number"], a.phase)
    lines = catalog.read_keylogs(spark, [p for p in paths if p.endswith(a.keylog_filename)]).withColumn("path", F.regexp_replace("path", "^file:(//)?", ""))
    secrets = catalog.parse_keylog(catalog.parse_runs(lines).select("line", "library", "run_number"), a.template)
    longest = secrets.agg(F.max(F.octet_length("secret_value"))).first()[0] or 64
    files = _images(spark, [r.path for r in chosen.select("path").collect()])
    chunks = chunked(files, max(longest, 64) - 1).join(chosen.select(F.col("path").alias("dump_id"), "library", "run_number"), "dump_id")
    hits = library.library_hits(chunks, secrets, "first_run", not a.no_expand)
    return {"hits": _rows(hits.orderBy("library", "run_number", "off", "secret_type")), "summary": _rows(library.library_report(hits))}


def _files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Files in the order given, to be read in ranges: ``grp, rank, path, size``."""
    rows = [("", i + 1, os.path.abspath(p), os.path.getsize(p)) for i, p in enumerate(paths)]
    return spark.createDataFrame(rows, "grp string, rank int, path string, size bigint")


def _consensus(spark, paths):
    return C.expand(file_states(_files(spark, paths)), 1 << 16, whole=True)


def cmd_consensus(spark, a):
    rows = _consensus(spark, _paths(a.dumps)).persist()
    volatile = rows.filter(F.col("class") == C.KEY_CANDIDATE)
    if a.align:
        volatile = R.aligned_blocks(volatile, ["grp"], None, a.block_size, a.alignment_bytes, a.density).join(rows, ["grp", "off"])
    regions = R.class_regions(volatile.withColumn("class", F.lit(C.KEY_CANDIDATE)), ["grp"], C.KEY_CANDIDATE, a.min_length)
    return {"classes": _rows(C.class_counts(rows)), "variance": _rows(C.variance_summary(rows)), "volatile": _rows(regions.orderBy("start")), "static": _rows(R.class_regions(rows, ["grp"], C.INVARIANT, 32).orderBy("start"))}


def _session(spark, state):
    meta = json.loads(Path(state).read_text())
    s = ConsensusSession(spark, meta["size"], root=meta["root"])
    s.version = meta["version"]
    return s, meta


def cmd_consensus_begin(spark, a):
    meta = {"size": a.size, "root": os.path.abspath(a.state) + ".d", "version": 0}
    Path(a.state).write_text(json.dumps(meta))
    return meta


def cmd_consensus_add(spark, a):
    s, meta = _session(spark, a.state)
    s.add(_images(spark, [a.dump]).select("dump_id", "data"))
    Path(a.state).write_text(json.dumps(meta | {"version": s.version}))
    return s.stats()


def cmd_consensus_finalize(spark, a):
    s, _ = _session(spark, a.state)
    rows = s.finalize()
    return {"classes": _rows(C.class_counts(rows))} | s.stats()


def cmd_search_reduce(spark, a):
    stages, regions = funnel.reduce_files(_files(spark, _paths(a.dumps)), **_params(a))
    return {"stages": _rows(stages), "regions": _rows(regions.orderBy("off"))}


def _oracle(a):
    config = None
    if a.oracle_config:
        import tomllib

        config = tomllib.loads(Path(a.oracle_config).read_text())
    path = os.path.abspath(a.oracle)
    return lambda: funnel.load_oracle(path, config)


def cmd_brute_force(spark, a):
    found = json.loads(Path(a.candidates).read_text())["regions"]
    regions = spark.createDataFrame([("", r["n"], r["off"], r["length"], r["mean_entropy"], r["mean_variance"]) for r in found], "grp string, n int, off bigint, length bigint, mean_entropy double, mean_variance double")
    slices = funnel.candidate_slices(regions, _images(spark, [a.dump]), [int(s) for s in a.key_sizes.split(",")], a.stride)
    hits = _rows(funnel.brute_force(slices, _oracle(a), not a.first_hit).orderBy("off", "size"))
    out = {"tried": slices.count(), "hits": hits}
    return out | ({} if hits else {"top": _rows(funnel.top_regions(regions, ["grp"], a.top_k))})


def cmd_n_sweep(spark, a):
    images = _images(spark, _paths([a.runs_dir], a.dump_glob))
    points = _rows(funnel.nsweep(images, [int(n) for n in a.n_values.split(",")], _oracle(a), tuple(int(s) for s in a.key_sizes.split(",")), a.stride, not a.first_hit, **_params(a)).orderBy("n"))
    out = {"headline": inspect.headline(points), "points": points, "hits": [p for p in points if p["hits"]]}
    folder = Path(a.output_dir)
    folder.mkdir(parents=True, exist_ok=True)
    text = f"# {out['headline']}\n\n{funnel.report_markdown(points)}\n"
    (folder / "report.json").write_text(json.dumps(out, indent=2))
    (folder / "report.md").write_text(text)
    (folder / "report.html").write_text(funnel.report_html(out["headline"], points))
    return out


def cmd_emit_plugin(spark, a):
    paths = _paths(a.dumps)
    hit = json.loads(Path(a.hit).read_text())["hits"][a.hit_index]
    near = funnel.neighborhood(_consensus(spark, paths), spark.createDataFrame([("", hit["off"], hit["size"])], "grp string, off bigint, size int")).first()
    plugin, _ = inspect.plugin_for_hit({"off": hit["off"], "size": hit["size"], "start": near["start"], "variances": near["variances"]}, Path(paths[0]).read_bytes(), a.name, a.variance_threshold)
    return plugin


def cmd_export(spark, a):
    paths = _paths(a.dumps)
    reference = Path(paths[0]).read_bytes()
    if a.auto:
        rows = _consensus(spark, paths).persist()
        out = patterns.export_best_region(rows, reference, R.class_regions(rows, ["grp"], C.KEY_CANDIDATE, 16), a.format, a.name, a.context, a.min_static_ratio)
        return out and out["content"]
    mask = patterns.static_mask(_images(spark, paths), a.offset, a.length).first()
    pattern = mask and patterns.make_pattern(bytes(mask["data"]), mask["mask"], a.name, a.min_static_ratio)
    return pattern and patterns.RENDERERS[a.format](pattern)


def cmd_import(spark, a):
    secrets = []
    if a.keylog:
        secrets = [(bytes(r.secret_value), 3, 0) for r in catalog.parse_keylog(catalog.read_keylogs(spark, a.keylog).select("line")).orderBy("secret_type").collect()]
    out = a.container or str(Path(a.dump_file).with_suffix(".msl"))
    Path(out).write_bytes(codec.import_raw(Path(a.dump_file).read_bytes(), secrets, source_name=os.path.basename(a.dump_file), pid=a.pid))
    return {"written": out}


def cmd_import_dir(spark, a):
    written = []
    Path(a.output_dir).mkdir(parents=True, exist_ok=True)
    keylog = os.path.join(a.run_dir, a.keylog_filename)
    for p in _paths([a.run_dir], "*.dump"):
        one = argparse.Namespace(dump_file=p, keylog=keylog if os.path.exists(keylog) else None, container=os.path.join(a.output_dir, Path(p).stem + ".msl"), pid=0)
        written.append(cmd_import(spark, one)["written"])
    return {"written": written}


def cmd_verify(spark, a):
    key = Path(a.dump).read_bytes()[a.offset : a.offset + a.length]
    sealed, iv = bytes.fromhex(a.ciphertext_hex), bytes.fromhex(a.iv_hex) if a.iv_hex else bytes(range(16))
    row = spark.range(1).select(verifies(F.lit(key), F.lit(sealed), F.lit(bytes.fromhex(a.plaintext_hex)), iv).alias("v")).first()
    return {"verified": row["v"], "hits": [a.offset] if row["v"] else []}


def cmd_batch(spark, a):
    jobs = json.loads(Path(a.config).read_text())["jobs"]
    done = []
    for job in jobs:
        try:
            done.append({"job": job, "ok": True, "result": cmd_analyze(spark, _parser().parse_args(["analyze", *job["library_dirs"], "--phase", job["phase"]]))})
        except Exception as e:  # one job's failure doesn't end the others
            done.append({"job": job, "ok": False, "error": str(e)[:500]})
    return {"results": done, "succeeded": sum(d["ok"] for d in done), "failed": sum(not d["ok"] for d in done)}


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="bytefold", description="Analytics over sets of memory images")
    parser.add_argument("--cores", type=int, default=os.cpu_count())
    sub = parser.add_subparsers(dest="command", required=True)

    def add(name, *arguments, funnel_options=False):
        p = sub.add_parser(name)
        for flags, options in arguments:
            p.add_argument(*flags.split(), **options)
        if funnel_options:
            for k, kind in _FUNNEL.items():
                p.add_argument("--" + k.replace("_", "-"), type=kind, default=funnel.Params()[k])
        p.add_argument("-o", "--output")

    dumps = ("dumps", {"nargs": "+"})
    oracle = [("--oracle", {"required": True}), ("--oracle-config", {}), ("--key-sizes", {"default": "32"}), ("--stride", {"type": int, "default": 8}), ("--first-hit", {"action": "store_true"})]
    number = {"type": lambda x: int(x, 0)}
    add("scan", ("--root", {"required": True}))
    add("analyze", ("library_dirs", {"nargs": "+"}), ("--phase", {"required": True}), ("--keylog-filename", {"default": "keylog.csv"}), ("--template", {"default": "Auto-detect"}), ("--normalize", {"action": "store_true"}), ("--no-expand", {"action": "store_true"}))
    add("consensus", dumps, ("--min-length", {"type": int, "default": 16}), ("--align", {"action": "store_true"}), ("--block-size", {"type": int, "default": 32}), ("--alignment-bytes", {"type": int, "default": 16}), ("--density", {"type": float, "default": 0.75}))
    add("consensus-begin", ("--state", {"required": True}), ("--size", {"type": int, "required": True}))
    add("consensus-add", ("--state", {"required": True}), ("dump", {}))
    add("consensus-finalize", ("--state", {"required": True}))
    add("search-reduce", dumps, funnel_options=True)
    add("brute-force", ("--candidates", {"required": True}), ("--dump", {"required": True}), *oracle, ("--top-k", {"type": int, "default": 10}))
    add("n-sweep", ("--runs-dir", {"required": True}), ("--dump-glob", {"default": "*"}), ("--n-values", {"default": "1,3,5,10,20,30,50,75,100"}), *oracle, ("--output-dir", {"required": True}), funnel_options=True)
    add("emit-plugin", dumps, ("--hit", {"required": True}), ("--name", {"required": True}), ("--hit-index", {"type": int, "default": 0}), ("--variance-threshold", {"type": float, "default": 2000.0}))
    add("export", dumps, ("--offset", number), ("--length", {"type": int}), ("--auto", {"action": "store_true"}), ("--context", {"type": int, "default": 32}), ("--name", {"default": "pattern"}), ("--format", {"default": "volatility3", "choices": sorted(patterns.RENDERERS)}), ("--min-static-ratio", {"type": float, "default": 0.3}))
    add("import", ("dump_file", {}), ("--container", {}), ("--pid", {"type": int, "default": 0}), ("--keylog", {}))
    add("import-dir", ("run_dir", {}), ("--output-dir", {"required": True}), ("--keylog-filename", {"default": "keylog.csv"}))
    add("verify", ("dump", {}), ("--offset", number | {"required": True}), ("--length", {"type": int, "default": 32}), ("--ciphertext-hex", {"required": True}), ("--plaintext-hex", {"required": True}), ("--iv-hex", {}))
    add("batch", ("--config", {"required": True}))
    return parser


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    spark = local_session(a.cores, a.cores)
    spark.sparkContext.setLogLevel("ERROR")
    result = globals()["cmd_" + a.command.replace("-", "_")](spark, a)
    text = result if isinstance(result, str) else json.dumps(report.jsonable(result), indent=2)
    if a.output:
        Path(a.output).write_text(text)
    else:
        print(text)
    return 2 if result is None or (isinstance(result, dict) and result.get("hits") == []) else 0


if __name__ == "__main__":
    sys.exit(main())
