"""The detection algorithms and their registry.

An algorithm is ``fn(images, context) -> matches`` over ``images(dump_id, data)``; matches are
``dump_id, off, length, confidence, label``.  All run over every image at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytefold.functions import crypto
from bytefold.functions.kernels import EdgeScan
from bytefold.functions.plugins import import_modules
from bytefold.operators.chunks import around, chunked
from bytefold.operators.consensus import INVARIANT, KEY_CANDIDATE, consensus_state, span_means, state_runs, whole_chunks
from bytefold.operators.entropy import entropy_profile, high_regions
from bytefold.operators.runs import merge_near
from bytefold.operators.search import contains_join, exact_hits, masked_score, needle_halo, regex_search
from bytefold.operators.structures import builtin, match_structures

_COLUMNS = ["dump_id", "off", "length", "confidence", "label"]


@dataclass
class Context:
    """What a run may know: library, protocol version, phase, secrets and parameters."""

    library: str = ""
    protocol_version: str = ""
    phase: str = ""
    secrets: list[tuple[str, bytes]] = field(default_factory=list)
    extra: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Algorithm:
    name: str
    mode: str  # known_key or unknown_key
    run: Callable[[DataFrame, Context], DataFrame]


REGISTRY: dict[str, Algorithm] = {}


def algorithm(name: str, mode: str):
    """Register a function as an algorithm."""

    def add(fn):
        REGISTRY[name] = Algorithm(name, mode, fn)
        return fn

    return add


def discover(package: str = "bytefold.operators") -> list[str]:
    """Import every module of a package, so that its algorithms register; the names that are new.

    A module that can't be imported is left out with a warning.
    """
    before = set(REGISTRY)
    import_modules(package)
    return sorted(set(REGISTRY) - before)


def by_mode(mode: str) -> list[Algorithm]:
    return [a for a in REGISTRY.values() if a.mode == mode]


def _kind(df: DataFrame) -> str:
    return dict(df.dtypes)["dump_id"]


@algorithm("exact_match", "known_key")
def exact_match(images: DataFrame, context: Context) -> DataFrame:
    """All occurrences of the known secrets; confidence is the share of types found in the image."""
    needles = [(k, v) for k, v in context.secrets if v]
    types = max(1, len({k for k, _ in needles}))
    hits = exact_hits(chunked(images, needle_halo(needles)), needles)
    found = hits.groupBy("dump_id").agg((F.count_distinct("secret_type") / F.lit(float(types))).alias("confidence"))
    return hits.join(found, "dump_id").withColumnRenamed("secret_type", "label").select(*_COLUMNS)


def _keep_best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fold candidates in (image, part, offset, longer first) order; the state is the last one kept."""
    kept = None
    for b in batches:
        out = []
        for row in zip(*(b.column(c).to_pylist() for c in ("dump_id", "off", "length", "confidence", "_part"))):
            if kept is not None and (row[0], row[4]) == (kept[0], kept[4]) and row[1] < kept[1] + kept[2]:
                if row[3] > kept[3]:
                    kept = row
                continue
            if kept is not None:
                out.append(kept[:4])
            kept = row
        yield _matches(out, b.schema)
    if kept is not None:
        yield _matches([kept[:4]], b.schema)


def _matches(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[], [], [], []]
    names = ["dump_id", "off", "length", "confidence"]
    return pa.RecordBatch.from_arrays([pa.array(c, schema.field(n).type) for c, n in zip(columns, names)], names=names)


#: Offsets of a block whose candidates are merged on their own.
_BLOCK = 1 << 16


def _block_clusters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the clusters of overlapping candidates that lie inside a block; pass the others on.

    A candidate behind the end of all before it starts anew whatever came before.  Only a block's
    first cluster may go on from the block before, and one that reaches beyond the block into the next.
    """
    rows = ((*row, b.schema) for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("dump_id", "_b", "off", "length", "confidence"))))
    for (_, block), group in groupby(rows, key=lambda r: (r[0], r[1])):
        clusters: list[list[tuple]] = []
        top = None
        for dump, _, off, length, confidence, schema in group:
            if top is None or off >= top:
                clusters.append([])
                top = off + length
            clusters[-1].append((dump, off, length, confidence))
            top = max(top, off + length)
        done, open_rows = [], []
        for i, cluster in enumerate(clusters):
            alone = (i > 0 or block == 0) and max(off + length for _, off, length, _ in cluster) <= (block + 1) * _BLOCK
            if alone:
                kept = cluster[0]
                for row in cluster[1:]:
                    if row[1] >= kept[1] + kept[2]:
                        done.append(kept)
                        kept = row
                    elif row[3] > kept[3]:
                        kept = row
                done.append(kept)
            else:
                open_rows += cluster
        flags = pa.array([True] * len(done) + [False] * len(open_rows), pa.bool_())
        made = _matches(done + open_rows, schema)
        yield pa.RecordBatch.from_arrays([*made.columns, flags], names=[*made.schema.names, "final"])


def merge_overlapping(candidates: DataFrame) -> DataFrame:
    """Of overlapping candidates the one of higher confidence, decided from left to right.

    Clusters of overlapping candidates are independent.  Those inside a block are merged with the
    block; only clusters at a block's edge are folded over the image, by a task that streams
    through them and carries one candidate.
    """
    body = candidates.select("dump_id", "off", "length", "confidence")
    schema = ", ".join(f"{n} {t}" for n, t in body.dtypes)
    blocks = body.withColumn("_b", F.floor(F.col("off") / _BLOCK)).repartition("dump_id", "_b").sortWithinPartitions("dump_id", "_b", "off", F.desc("length"))
    merged = blocks.mapInArrow(_block_clusters, f"{schema}, final boolean")
    # What is final is disjoint and stays as it is; a part of its own keeps it apart from the open rows.
    parts = merged.withColumn("_part", F.when(F.col("final"), F.floor(F.col("off") / _BLOCK)).otherwise(-1)).drop("final")
    ordered = parts.repartition("dump_id", "_part").sortWithinPartitions("dump_id", "_part", "off", F.desc("length"))
    return ordered.mapInArrow(_keep_best, schema)


@algorithm("entropy_scan", "unknown_key")
def entropy_scan(images: DataFrame, context: Context) -> DataFrame:
    """Windows of key size at or over the threshold, overlaps merged."""
    sizes, least, step = context.extra.get("window_sizes", [32, 48]), context.extra.get("entropy_threshold", 4.5), context.extra.get("step", 1)
    chunks = chunked(images, max(sizes) - 1)
    found = None
    for w in sizes:
        one = entropy_profile(chunks, w, step).filter(F.col("entropy") >= least).select("dump_id", "off", F.lit(w).alias("length"), (F.round("entropy", 9) / 8.0).alias("confidence"))
        found = one if found is None else found.unionByName(one)
    return merge_overlapping(found).withColumn("label", F.concat(F.lit("high_entropy_"), F.col("length").cast("string"), F.lit("B"))).select(*_COLUMNS)


def _edges(window: int, least: float, threshold: float, drift: float, widths: tuple[int, ...]):
    """Streams through sorted profiles; what it carries is one ``EdgeScan``, whatever an image's size."""

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dump, scan = None, None
        for b in batches:
            out = []
            for row in zip(*(b.column(c).to_pylist() for c in ("dump_id", "off", "entropy", "size"))):
                if scan is None or row[0] != dump:
                    dump, scan = row[0], EdgeScan(threshold, drift, window, least, widths)
                out.extend((dump, *found) for found in scan.step(row[1], row[2], row[3]))
            if out:
                yield _matches(out, b.schema.append(pa.field("length", pa.int32())).append(pa.field("confidence", pa.float64())))

    return detect


@algorithm("change_point", "unknown_key")
def change_point(images: DataFrame, context: Context) -> DataFrame:
    """Key-wide plateaus of the entropy profile between a rising and a falling edge.

    The edge statistic is sequential along an image; images run in parallel, and a task carries a
    state of a few numbers through its images' profiles.
    """
    x = context.extra
    window, step = x.get("window", 32), x.get("step", 16)
    sized = images.select("dump_id", F.octet_length(F.col("data").cast("binary")).cast("bigint").alias("size"), "data")
    chunks = chunked(sized.withColumn("dump_id", F.struct("dump_id", "size")), window - 1)
    profile = entropy_profile(chunks, window, step).select("dump_id.dump_id", "off", "entropy", "dump_id.size")
    ordered = profile.repartition("dump_id").sortWithinPartitions("dump_id", "off")
    detect = _edges(window, x.get("entropy_threshold", 4.5), x.get("cusum_threshold", 0.8), x.get("drift", 0.05), tuple(x.get("plateau_widths", (32, 48))))
    found = ordered.mapInArrow(detect, f"dump_id {_kind(images)}, off bigint, length int, confidence double")
    return found.withColumn("label", F.concat(F.lit("cusum_plateau_"), F.col("length").cast("string"), F.lit("B"))).select(*_COLUMNS)


@algorithm("differential", "unknown_key")
def differential(images: DataFrame, context: Context) -> DataFrame:
    """Key-wide regions that vary across all images of a group; no match for fewer than two images.

    Images without a ``grp`` column are one group.  Matches belong to the group's first image (the
    smallest id).
    """
    chunk = context.extra.get("chunk", 1 << 16)
    named = images.select("dump_id", (F.coalesce(F.col("grp").cast("string"), F.lit("")) if "grp" in images.columns else F.lit("")).alias("grp"), "data")
    held = whole_chunks(consensus_state(chunked(named, 0, chunk, ["grp"]), F.col("grp")).filter("n >= 2"))
    runs = state_runs(held, chunk, [KEY_CANDIDATE, INVARIANT], whole=True)
    merged = merge_near(runs, ["grp"], F.col("class") == KEY_CANDIDATE)
    near = [F.abs(F.col("length") - w) for w in (32, 48)]
    wide = merged.filter(F.least(*near) <= 8)
    mean = span_means(held, wide, chunk).withColumn("length", F.col("end") - F.col("start"))
    score = 0.7 * F.least(F.col("mean_variance") / 8000.0, F.lit(1.0)) + 0.3 * F.greatest(1.0 - F.least(*near) / 8.0, F.lit(0.0))
    first = named.groupBy("grp").agg(F.min("dump_id").alias("dump_id"))
    return mean.join(first, "grp").select("dump_id", F.col("start").alias("off"), F.col("length").cast("int").alias("length"), F.round(score, 4).alias("confidence"), F.concat(F.lit("diff_key_candidate_"), F.col("length").cast("string"), F.lit("B")).alias("label"))


def _pairs(protocol: str):
    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            links = [crypto.joined(x, y, protocol) for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist())]
            yield b.select(["dump_id", "off", "off_b"]).filter(pa.array(links, pa.bool_()))

    return test


def _derived(derive: Callable[[bytes], list[bytes]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = [derive(x) for x in b.column("value").to_pylist()]
            at = pa.array(np.repeat(np.arange(len(values)), [len(v) for v in values]))
            yield pa.RecordBatch.from_arrays([b.column("dump_id").take(at), b.column("off").take(at), pa.array([x for v in values for x in v], pa.binary())], names=["dump_id", "off", "derived"])

    return run


@algorithm("constraint_validator", "unknown_key")
def constraint_validator(images: DataFrame, context: Context) -> DataFrame:
    """Candidates of the protocol's key size that derive from one another, or to bytes of the image.

    ``extra["candidates"]`` is ``dump_id, off, value``.  What a candidate derives to on its own is
    computed once and joined to the candidates of its image; only schemes that join two candidates
    (extraction, SSH) test pairs, within an image and key size.  Probes are searched in the chunks.
    A candidate equal to a known secret has confidence 1.
    """
    protocol, size = context.protocol_version, crypto.KEY_SIZES[context.protocol_version.upper()]
    candidates = context.extra["candidates"].filter(F.octet_length("value") == size).select("dump_id", "off", "value")
    kind = _kind(candidates)
    schema = f"dump_id {kind}, off bigint, derived binary"
    other = candidates.select("dump_id", F.col("off").alias("off_b"), F.col("value").alias("b"))
    alone = candidates.mapInArrow(_derived(lambda x: crypto.derived(x, protocol)), schema).withColumnRenamed("derived", "b")
    links = alone.join(other, ["dump_id", "b"]).filter("off <> off_b").select("dump_id", "off", "off_b")
    if crypto.joins(protocol):
        pairs = candidates.withColumnRenamed("value", "a").join(other, "dump_id").filter("off < off_b")
        links = links.unionByName(pairs.select("dump_id", "off", "off_b", "a", "b").mapInArrow(_pairs(protocol), f"dump_id {kind}, off bigint, off_b bigint"))
    both = links.select("dump_id", "off").unionByName(links.select("dump_id", F.col("off_b").alias("off"))).distinct().withColumn("link", F.lit(crypto.LINK_CONFIDENCE))
    rest = candidates.join(both, ["dump_id", "off"], "left_anti").mapInArrow(_derived(lambda x: [crypto.probe(x, protocol, size)]), schema)
    # A needle carries its own image and place; hits in other images are none.
    named = rest.select(F.to_json(F.struct(F.col("dump_id").cast("string").alias("d"), F.col("off").alias("o"))).alias("secret_type"), F.col("derived").alias("value"))
    hits = contains_join(chunked(images, size + 64), named).select("dump_id", F.from_json("secret_type", "d string, o bigint").alias("n"))
    probed = hits.filter(F.col("n.d").eqNullSafe(F.col("dump_id").cast("string"))).select("dump_id", F.col("n.o").alias("off")).distinct().withColumn("link", F.lit(crypto.PROBE_CONFIDENCE))
    found = both.unionByName(probed).join(candidates, ["dump_id", "off"])
    known = F.col("value").isin([v for _, v in context.secrets]) if context.secrets else F.lit(False)
    return found.select("dump_id", "off", F.lit(size).alias("length"), F.when(known, 1.0).otherwise(F.col("link")).alias("confidence"), F.lit("kdf_validated").alias("label"))


@algorithm("user_regex", "unknown_key")
def user_regex(images: DataFrame, context: Context) -> DataFrame:
    """Non-overlapping matches of the user's byte patterns."""
    return regex_search(images, context.extra.get("patterns", [])).withColumn("confidence", F.lit(1.0)).select(*_COLUMNS)


def applicable(patterns: list[dict], library: str, version: str) -> list[dict]:
    """Patterns for a library and version; an empty list in a pattern means any."""
    out = []
    for p in patterns:
        scope = p.get("applicable_to", {})
        if all(not allowed or have in allowed for allowed, have in ((scope.get("libraries"), library), (scope.get("protocol_versions"), version))):
            out.append(p)
    return out


def _structural(rules: list[dict]):
    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, off, score = [], [], []
            for i, (base, data, offsets) in enumerate(zip(b.column("base_off").to_pylist(), b.column("data").to_pylist(), b.column("offsets").to_pylist())):
                for o in offsets:
                    if (s := masked_score(data, o, rules)) > 0:
                        at.append(i)
                        off.append(base + o)
                        score.append(s)
            yield pa.RecordBatch.from_arrays([b.column("dump_id").take(pa.array(at, pa.int64())), pa.array(off, pa.int64()), pa.array(score, pa.float64())], names=["dump_id", "off", "confidence"])

    return test


@algorithm("pattern_match", "unknown_key")
def pattern_match(images: DataFrame, context: Context) -> DataFrame:
    """High-entropy candidates of a pattern's key length around which its masked rules hold."""
    out = images.select("dump_id", F.lit(0).cast("bigint").alias("off"), F.lit(0).alias("length"), F.lit(0.0).alias("confidence"), F.lit("").alias("label")).filter(F.lit(False))
    for p in applicable(context.extra.get("patterns", []), context.library, context.protocol_version):
        size = p["key_spec"]["length"]
        inner = Context(extra={"window_sizes": [size], "entropy_threshold": p["key_spec"].get("entropy_min", 7.0)})
        rules = [*p.get("pattern", {}).get("before", []), *p.get("pattern", {}).get("after", [])]
        before = max([0, *(-r["offset"] for r in rules)])
        after = max([size, *(r["offset"] + len(r.get("bytes", "")) // 2 for r in rules)])
        near = around(images, entropy_scan(images, inner).select("dump_id", "off"), before, after)
        found = near.mapInArrow(_structural(rules), f"dump_id {_kind(images)}, off bigint, confidence double")
        out = out.unionByName(found.select("dump_id", "off", F.lit(size).alias("length"), "confidence", F.lit(p.get("name", "unknown_pattern")).alias("label")))
    return out


@algorithm("structure_scan", "unknown_key")
def structure_scan(images: DataFrame, context: Context) -> DataFrame:
    """Structures at every 16th byte of high-entropy regions, and at every 64th of the first KiB."""
    window, step, least = 32, 16, context.extra.get("entropy_threshold", 6.5)
    version = context.protocol_version
    protocol = "TLS" if version.startswith("TLS") or version in ("12", "13") else "SSH" if version.startswith("SSH") or version == "2" else ""
    whole = images.select("dump_id", F.col("data").cast("binary").alias("data")).filter(F.octet_length("data") >= window)
    regions = high_regions(entropy_profile(chunked(whole, window - 1), window, step), least, 32, step)
    inside = regions.select("dump_id", F.explode(F.sequence("start", F.col("end") - 1, F.lit(step).cast("bigint"))).alias("o"))
    grid = whole.select("dump_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.least(F.octet_length("data"), F.lit(1024)).cast("bigint") - 1, F.lit(64).cast("bigint"))).alias("o"))
    library = context.extra.get("structures") or builtin()
    near = around(whole, inside.unionByName(grid).select("dump_id", F.col("o").alias("off")), 0, max(s.largest_size for s in library))
    placed = near.select(F.struct("dump_id", "base_off").alias("dump_id"), "data", "offsets")
    found = match_structures(placed, library, 0.5, protocol).select("dump_id.dump_id", (F.col("dump_id.base_off") + F.col("off")).alias("off"), "length", "confidence", "structure")
    return found.select("dump_id", "off", "length", "confidence", F.concat(F.lit("struct:"), F.col("structure")).alias("label"))


def matches_per_algorithm(matches: DataFrame) -> DataFrame:
    """Hits of each algorithm of ``run_all``."""
    return matches.groupBy("algorithm").agg(F.count(F.lit(1)).alias("hits"))


def run_all(images: DataFrame, context: Context, names: list[str] | None = None) -> DataFrame:
    """The matches of several algorithms, tagged by algorithm."""
    out = None
    for name in names or list(REGISTRY):
        one = REGISTRY[name].run(images, context).withColumn("algorithm", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def available(name: str, dumps: int, has_keylog: bool, has_candidates: bool) -> bool:
    """Whether an algorithm can run on what there is."""
    return {"differential": dumps >= 2, "exact_match": has_keylog, "constraint_validator": has_candidates}.get(name, dumps >= 1)
