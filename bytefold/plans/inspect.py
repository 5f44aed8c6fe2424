"""Looking into one place of an image: windows, region reports, plugins from a hit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytefold.functions.formats import detect_format
from bytefold.functions.kernels import ascii_strings, shannon
from bytefold.functions.navigate import navigate
from bytefold.operators.consensus import ENTROPY_BANDS, VARIANCE_BANDS
from bytefold.plans.patterns import make_pattern, volatility_plugin, yara_rule

#: Most bytes a hex window and a base64 window may show.
MAX_HEX, MAX_BASE64 = 4096, 16384


def base64_window(data: Column, offset: int, length: int) -> Column:
    """A window of an image in base64; an error for a bad range."""
    if offset < 0 or not 0 < length <= MAX_BASE64:
        raise ValueError(f"a window has 1 to {MAX_BASE64} bytes from a non-negative offset")
    return F.base64(F.substring(data, F.lit(offset + 1), F.lit(length)))


def _named(value: float, bands: tuple) -> str:
    cuts, names = bands
    return next((n for c, n in zip(cuts, names) if value < c), names[-1])


def region_report(data: bytes, offset: int, window: int = 64, variance: float | None = None, hits: list[dict] | None = None) -> dict:
    """What lies around an offset: its byte, entropy and strings of the window, variance, covering hits."""
    near = data[max(0, offset - window // 2) : offset + window // 2]
    entropy = shannon(near)
    return {
        "offset": offset,
        "byte": data[offset] if 0 <= offset < len(data) else 0,
        "entropy": entropy,
        "entropy_level": _named(entropy, ENTROPY_BANDS),
        "variance": variance,
        "variance_class": None if variance is None else _named(variance, VARIANCE_BANDS),
        "hits": [h for h in hits or [] if h["off"] <= offset < h["off"] + h["length"]],
        "strings": [t for *_, t in ascii_strings(near)],
    }


def context_of(data: Column, offset: Column, length: Column, pad: int = 256) -> Column:
    """Bytes before, of and behind a place, filled with zeros where the image ends."""
    before = F.substring(data, F.greatest(offset - pad, F.lit(0)) + 1, F.least(offset, F.lit(pad)))
    after = F.substring(data, offset + length + 1, F.lit(pad))
    return F.struct(F.lpad(before, pad, F.lit(b"\0")).alias("before"), F.substring(data, offset + 1, length).alias("key"), F.rpad(after, pad, F.lit(b"\0")).alias("after"))


def navigation(images: DataFrame) -> DataFrame:
    """Headers, segments and sections of images in a known format."""
    from bytefold.sources.container import _flat

    rows = images.select(F.col("dump_id").cast("string").alias("dump_id"), F.col("data").cast("binary").alias("data")).withColumn("format", detect_format(F.col("data")))

    def nodes(dump, data, name):
        for label, at, size, kind, depth in navigate(data or b"", name):
            yield (dump, name, label, at, size, kind, depth)

    return _flat(rows.filter("format is not null"), ["dump_id", "data", "format"], nodes, "dump_id string, format string, label string, off bigint, size bigint, kind string, depth int")


def plugin_for_hit(hit: dict, reference: bytes, name: str, threshold: float = 2000.0, min_static_ratio: float = 0.3, description: str = "") -> tuple[str, str]:
    """A plugin and a rule from a hit with its neighborhood (``off, size, start, variances``)."""
    start, variances = hit["start"], hit["variances"]
    if not variances:
        raise ValueError("the hit has no neighborhood")
    if start + len(variances) > len(reference):
        raise ValueError("the neighborhood lies beyond the reference")
    mask = [v <= threshold for v in variances]
    pattern = make_pattern(reference[start : start + len(variances)], mask, name, min_static_ratio)
    if pattern is None:
        raise ValueError(f"only {sum(mask)} of {len(mask)} bytes around the hit are static")
    key = hit["off"] - start
    fields, counts = [], {}
    for i, static in enumerate(mask):
        role = "key" if key <= i < key + hit["size"] else "static" if static else "dynamic"
        if fields and fields[-1]["role"] == role:
            fields[-1]["length"] += 1
        else:
            n = counts.setdefault(role, 0)
            counts[role] += 1
            fields.append({"role": role, "label": f"{role}_{n}", "offset": i, "length": 1})
    return volatility_plugin(pattern, name, description, key, hit["size"], fields), yara_rule(pattern)


def headline(points: list[dict]) -> str:
    """One sentence on a sweep."""
    if not points:
        return "The sweep ran on no image."
    hit = next((p for p in sorted(points, key=lambda p: p["n"]) if p["hits"]), None)
    if hit is None:
        last = max(points, key=lambda p: p["n"])
        return f"No hit with {last['n']} images; {last['high_entropy']} bytes are left."
    return f"At N={hit['n']}, {hit['high_entropy']} bytes are left and {hit['hits']} slices pass, the first at offset {hit['hit_off']:#x}."
