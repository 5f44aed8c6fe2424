"""Byte patterns from static masks, and their renderings as rule, signature and scanner."""

from __future__ import annotations

import json
import re
import string
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def pattern_columns(data: Column, mask: Column, min_static_ratio: float = 0.3) -> Column:
    """Pattern of a binary column and an array of static flags, as a struct; null if too little is static."""
    pairs = F.regexp_extract_all(F.lower(F.hex(data)), F.lit("(..)"), F.lit(1))
    static = F.size(F.filter(mask, lambda m: m))
    wild = F.transform(pairs, lambda h, i: F.when(F.coalesce(F.get(mask, i), F.lit(False)), h).otherwise("??"))
    ratio = static / F.size(mask).cast("double")
    out = F.struct(F.octet_length(data).alias("length"), F.array_join(pairs, " ").alias("hex_pattern"), F.array_join(wild, " ").alias("wildcard_pattern"), F.round(ratio, 4).alias("static_ratio"), static.alias("static_count"), (F.size(mask) - static).alias("volatile_count"))
    return F.when((F.octet_length(data) > 0) & (F.size(mask) > 0) & (ratio >= min_static_ratio), out)


def make_pattern(data: bytes, mask: list[bool], name: str = "unnamed_pattern", min_static_ratio: float = 0.3) -> dict | None:
    """The same for one collected region."""
    if not data or not mask or sum(mask) / len(mask) < min_static_ratio:
        return None
    wild = [f"{b:02x}" if i < len(mask) and mask[i] else "??" for i, b in enumerate(data)]
    return {"name": name, "length": len(data), "hex_pattern": data.hex(" "), "wildcard_pattern": " ".join(wild), "static_ratio": round(sum(mask) / len(mask), 4), "static_count": sum(mask), "volatile_count": len(mask) - sum(mask)}


def static_mask(images: DataFrame, offset: int, length: int) -> DataFrame:
    """Static flags of a region over images ``(grp, rank, data)``: ``grp, data, mask``.

    The first image that reaches the offset is the reference; others are compared over what they
    share with it; images that end before the offset are left out.
    """
    part = images.select("grp", "rank", F.substring(F.col("data").cast("binary"), F.lit(offset + 1), F.lit(length)).alias("p")).filter(F.octet_length("p") > 0)
    ref = part.groupBy("grp").agg(F.min_by("p", "rank").alias("data"))
    pairs = lambda c: F.regexp_extract_all(F.hex(c), F.lit("(..)"), F.lit(1))
    values = part.select("grp", F.posexplode(pairs("p")).alias("i", "v"))
    wanted = ref.select("grp", F.posexplode(pairs("data")).alias("i", "r"))
    flags = wanted.join(values, ["grp", "i"]).groupBy("grp", "i").agg(F.min(F.col("v") == F.col("r")).alias("s"))
    masks = flags.groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda x: x["s"]).alias("mask"))
    return ref.join(masks, "grp")


def anchors(mask: list[bool], least: int = 4) -> list[tuple[int, int]]:
    """Static runs as (start, length)."""
    text = "".join("s" if m else "." for m in mask)
    return [(m.start(), len(m.group())) for m in re.finditer("s+", text) if len(m.group()) >= least]


def longest_needle(wildcard: str) -> tuple[str, int]:
    """The first longest run of known bytes in a wildcard pattern: its hex and byte offset."""
    best, at, run = "", 0, ""
    for i, token in enumerate([*wildcard.split(), "??"]):
        if "?" not in token:
            run += token.lower()
            continue
        if len(run) > len(best):
            best, at = run, i - len(run) // 2
        run = ""
    return best, at


def wildcard_regex(wildcard: str) -> bytes:
    """A wildcard pattern as a bytes regex: known stretches are quoted, each unknown byte is a dot."""
    stretches = groupby(wildcard.split(), key=lambda token: "?" in token)
    return b"".join(b"." * len(list(tokens)) if unknown else re.escape(bytes.fromhex(" ".join(tokens))) for unknown, tokens in stretches)


def identifier(name: str) -> str:
    """A name as a rule identifier: word characters only, and no digit first."""
    return re.sub(r"^(?=\d)", "r_", re.sub(r"\W", "_", name)) or "unnamed_rule"


def class_name(name: str) -> str:
    """A name as a class name: its words in title case, run together."""
    title = string.capwords(re.sub(r"[\W_]+", " ", name)).replace(" ", "")
    return f"Scan{title}" if title[:1].isdigit() else title


_RULE = string.Template("""rule $name$tags
{
    meta:
        description = "$description"
        pattern_length = $length
        static_ratio = "$ratio"
        generated_by = "bytefold"

    strings:
        $$key = { $pattern }

    condition:
        $$key
}""")


def yara_rule(pattern: dict, rule_name: str | None = None, description: str | None = None, tags: list[str] | None = None) -> str:
    """A pattern as a YARA rule."""
    return _RULE.substitute(name=rule_name or identifier(pattern.get("name", "")), tags=" : " + " ".join(tags) if tags else "", description=description or f"Pattern: {pattern.get('name', 'unknown')}", length=pattern.get("length", 0), ratio=pattern.get("static_ratio", 0), pattern=pattern.get("wildcard_pattern", "").upper())


def json_signature(pattern: dict, library: str = "", version: str = "", description: str = "", rules: dict | None = None) -> str:
    """A pattern as a JSON signature that ``pattern_match`` reads."""
    scope = ({"libraries": [library]} if library else {}) | ({"protocol_versions": [version]} if version else {})
    return json.dumps(
        {
            "name": pattern.get("name", "unnamed"),
            "description": description or f"Pattern: {pattern.get('name', 'unnamed')}",
            "applicable_to": scope,
            "key_spec": {"length": pattern.get("length", 32), "entropy_min": 4.5},
            "pattern": rules or {"before": [], "after": []},
            "metadata": {"generated_by": "bytefold", "static_ratio": pattern.get("static_ratio", 0), "wildcard_pattern": pattern.get("wildcard_pattern", "")},
        },
        indent=4,
    )


_PLUGIN = string.Template('''"""$description"""

import math

from volatility3.framework import interfaces, renderers
from volatility3.framework.configuration import requirements
from volatility3.framework.layers import scanners
from volatility3.framework.renderers import format_hints

PATTERN = $regex
NEEDLE = bytes.fromhex("$needle")
NEEDLE_OFFSET = $needle_offset
SIZE = $length
KEY_OFFSET = $key_offset
KEY_LENGTH = $key_length
FIELDS = $fields


class $class_name(interfaces.plugins.PluginInterface):
    """Finds the pattern in a memory layer and shows the key bytes."""

    _required_framework_version = (2, 0, 0)

    @classmethod
    def get_requirements(cls):
        return [requirements.TranslationLayerRequirement(name="primary", description="Memory layer")]

    def _rows(self, layer):
        for at in layer.scan(context=self.context, scanner=scanners.RegExScanner(PATTERN)):
            key = layer.read(at + KEY_OFFSET, KEY_LENGTH, pad=True)
            share = [key.count(b) / len(key) for b in set(key)]
            entropy = -sum(p * math.log2(p) for p in share)
            yield 0, (format_hints.Hex(at + KEY_OFFSET), key.hex(), round(entropy, 4), KEY_LENGTH, format_hints.Hex(at), $ratio)

    def run(self):
        columns = [("Offset", format_hints.Hex), ("Key", str), ("Entropy", float), ("Length", int), ("Pattern", format_hints.Hex), ("StaticRatio", float)]
        layer = self.context.layers[self.config["primary"]]
        return renderers.TreeGrid(columns, self._rows(layer))
''')


def volatility_plugin(pattern: dict, plugin_name: str | None = None, description: str = "", key_offset: int = 0, key_length: int | None = None, fields: list[dict] | None = None) -> str:
    """A pattern as the source of a memory-forensics plugin."""
    needle, at = longest_needle(pattern["wildcard_pattern"])
    return _PLUGIN.substitute(class_name=class_name(plugin_name or pattern["name"]), description=(description or f"Scan for {pattern['name']}").replace('"""', "'''"), regex=repr(wildcard_regex(pattern["wildcard_pattern"])), needle=needle, needle_offset=at, length=pattern["length"], key_offset=key_offset, key_length=key_length or pattern["length"], fields=repr(fields or []), ratio=pattern["static_ratio"])


RENDERERS = {"yara": yara_rule, "json": json_signature, "volatility3": volatility_plugin}


def export_best_region(consensus: DataFrame, reference: bytes, regions: DataFrame, fmt: str = "volatility3", name: str = "pattern", context: int = 32, min_static_ratio: float = 0.3) -> dict | None:
    """The longest (then first) volatile region with its surroundings as a pattern, rendered.

    Only the region's rows come to the driver; its size is that of one key and its context.
    """
    if fmt not in RENDERERS:
        raise ValueError(f"unknown format {fmt}")
    best = regions.orderBy(F.desc("length"), "start").select("start", "end").first()
    if best is None:
        return None
    low, high = max(0, best["start"] - context), min(len(reference), best["end"] + context)
    rows = {r["off"]: r["variance"] for r in consensus.filter(F.col("off").between(low, high - 1)).select("off", "variance").collect()}
    pattern = make_pattern(reference[low:high], [rows.get(o) == 0 for o in range(low, high)], name, min_static_ratio)
    if pattern is None:
        return None
    return {"format": fmt, "content": RENDERERS[fmt](pattern), "pattern": pattern, "region": {"offset": low, "length": high - low, "key_start": best["start"], "key_end": best["end"]}}


def vtype(name: str, size: int, fields: list[tuple[str, int, str]]) -> str:
    """A layout as a vtype dictionary in JSON."""
    return json.dumps({name: [size, {n: [at, [kind]] for n, at, kind in fields}]})
