"""Needles, patterns and predicates over image chunks; hits as rows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bytefold.functions.kernels import Automaton, as_bytes, ascii_strings, runs_of, string_bytes, utf8_strings
from bytefold.operators.chunks import chunked

#: Needles that are shipped to every task; a table of any size goes through ``contains_join``.
MAX_NEEDLES = 100_000
#: Bytes by which needles of a table meet the data.
PREFIX = 4


def needle_halo(needles: list[tuple[str, bytes]]) -> int:
    """The halo chunks need so that no needle is lost at a chunk's end."""
    return max((len(v) for _, v in needles), default=1) - 1


def _by_id(batch: pa.RecordBatch, at: list[int]) -> pa.Array:
    return batch.column("dump_id").take(pa.array(at, pa.int64()))


def _exact(needles: list[tuple[str, bytes]]):
    kinds: dict[bytes, list[str]] = {}
    for kind, value in needles:
        if value:
            kinds.setdefault(value, []).append(kind)  # equal values keep all their types

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Automaton(list(kinds))
        for batch in batches:
            at, kind, off, length = [], [], [], []
            base, sizes = batch.column("base_off").to_pylist(), batch.column("size").to_pylist()
            for i, data in enumerate(batch.column("data").to_pylist()):
                for o, v in machine.find(data):
                    if o < sizes[i]:
                        for k in kinds[v]:
                            at.append(i)
                            kind.append(k)
                            off.append(base[i] + o)
                            length.append(len(v))
            if at:
                yield pa.RecordBatch.from_arrays([_by_id(batch, at), pa.array(kind, pa.string()), pa.array(off, pa.int64()), pa.array(length, pa.int32())], names=["dump_id", "secret_type", "off", "length"])

    return search


def exact_hits(chunks: DataFrame, needles: list[tuple[str, bytes]]) -> DataFrame:
    """Every occurrence, overlapping ones too, of each needle: ``dump_id, secret_type, off, length``.

    One pass with a multi-pattern automaton.  Two types with equal bytes both come out; an empty
    needle has no hit.  Chunks need ``needle_halo`` bytes of halo.
    """
    if len(needles) > MAX_NEEDLES:
        raise ValueError(f"more than {MAX_NEEDLES} needles: put them into a table for contains_join")
    kind = dict(chunks.dtypes)["dump_id"]
    return chunks.select("dump_id", "base_off", "size", "data").mapInArrow(_exact(needles), f"dump_id {kind}, secret_type string, off bigint, length int")


#: Bits of the map of needle prefixes that the scan looks at first: 2 MB, whatever the number of needles.
_MAP_BITS = 24
_MAP_PART = 32_768


def _prefix_map(keys: DataFrame) -> np.ndarray | None:
    """A map of the prefixes ``key`` (by their low bits), put together in the executors; None without any."""
    at = F.pmod("key", F.lit(1 << _MAP_BITS)) + 1
    parts = keys.select(F.bitmap_bucket_number(at).alias("b"), F.bitmap_bit_position(at).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("m")).collect()
    if not parts:
        return None
    bits = np.zeros(1 << _MAP_BITS, dtype=bool)
    for r in parts:
        bits[(r["b"] - 1) * _MAP_PART : r["b"] * _MAP_PART] = np.unpackbits(np.frombuffer(r["m"], dtype=np.uint8), bitorder="little")
    return np.packbits(bits)


def _prefixes(size: int, packed: np.ndarray):
    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(packed).astype(bool)
        for batch in batches:
            base, sizes = batch.column("base_off").to_pylist(), batch.column("size").to_pylist()
            for i, data in enumerate(batch.column("data")):
                values = as_bytes(data.as_buffer()).astype(np.int64)
                own = min(sizes[i], len(values) - size + 1)
                if own <= 0:
                    continue
                key = sum(values[k : own + k] << (8 * k) for k in range(size))
                off = np.flatnonzero(known[key & ((1 << _MAP_BITS) - 1)])
                if len(off):
                    same = np.full(len(off), i)
                    yield pa.RecordBatch.from_arrays([batch.column("dump_id").take(pa.array(same)), pa.array(np.full(len(off), base[i])), pa.array(off + base[i]), pa.array(key[off])], names=["dump_id", "base_off", "off", "key"])

    return prefixes


def contains_join(chunks: DataFrame, needles: DataFrame, prefix: int = PREFIX) -> DataFrame:
    """``exact_hits`` for a table of needles ``(secret_type, value)`` of any number.

    Needles meet the windows of the data that begin with their first bytes by a join on these
    bytes.  A map of all prefixes, of one size whatever the needles, goes to every task, so only
    windows that may begin a needle leave the scan; the rest of a needle is compared in its chunk.
    Chunks need a halo of the longest needle less one byte.  An empty needle has no hit.
    """
    kind = dict(chunks.dtypes)["dump_id"]
    body = needles.select("secret_type", F.col("value").cast("binary").alias("value")).filter(F.octet_length("value") > 0).distinct()
    out = exact_hits(chunks, []).filter(F.lit(False))
    for size in range(1, prefix + 1):
        part = body.filter(F.octet_length("value") >= size if size == prefix else F.octet_length("value") == size)
        byte = lambda i: F.conv(F.hex(F.substring("value", i + 1, 1)), 16, 10).cast("bigint")
        keyed = part.withColumn("key", sum((F.shiftleft(byte(i), 8 * i) for i in range(1, size)), byte(0)))
        known = _prefix_map(keyed)
        if known is None:
            continue
        found = chunks.select("dump_id", "base_off", "size", "data").mapInArrow(_prefixes(size, known), f"dump_id {kind}, base_off bigint, off bigint, key bigint")
        near = found.join(keyed, "key").select("dump_id", "base_off", "off", "secret_type", "value")
        if size == prefix:  # longer needles are compared with the bytes of their chunk
            whole = near.filter(F.octet_length("value") == size).select("dump_id", "secret_type", "off", "value")
            rest = near.filter(F.octet_length("value") > size).join(chunks.select("dump_id", "base_off", "data"), ["dump_id", "base_off"])
            same = F.substring("data", (F.col("off") - F.col("base_off") + 1).cast("int"), F.octet_length("value")) == F.col("value")
            near = whole.unionByName(rest.filter(same).select("dump_id", "secret_type", "off", "value"))
        out = out.unionByName(near.select("dump_id", "secret_type", "off", F.octet_length("value").alias("length")))
    return out


def _regex(patterns: list[tuple[str, bytes]]):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(name, re.compile(p, re.DOTALL)) for name, p in patterns]
        for batch in batches:
            at, label, off, length = [], [], [], []
            for i, data in enumerate(batch.column("data").to_pylist()):
                for name, p in compiled:
                    for m in p.finditer(data or b""):
                        if m.end() > m.start():
                            at.append(i)
                            label.append(name)
                            off.append(m.start())
                            length.append(m.end() - m.start())
            if at:
                yield pa.RecordBatch.from_arrays([_by_id(batch, at), pa.array(label, pa.string()), pa.array(off, pa.int64()), pa.array(length, pa.int32())], names=["dump_id", "label", "off", "length"])

    return search


def valid_patterns(patterns: list[tuple[str, str]]) -> tuple[list[tuple[str, bytes]], list[tuple[str, str]]]:
    """User patterns that compile, and the others with the reason they are skipped."""
    good, bad = [], []
    for name, text in patterns:
        raw = text.encode("latin-1", "ignore") if isinstance(text, str) else text
        if not raw:
            bad.append((name, "empty"))
            continue
        try:
            re.compile(raw)
            good.append((name, raw))
        except re.error as e:
            bad.append((name, str(e)))
    return good, bad


def regex_search(images: DataFrame, patterns: list[tuple[str, str]]) -> DataFrame:
    """Non-overlapping matches of byte patterns over whole images: ``dump_id, label, off, length``.

    Whole images and not chunks, as a match may have any length.  Invalid and empty patterns are
    left out; ``valid_patterns`` says why.
    """
    kind = dict(images.dtypes)["dump_id"]
    good, _ = valid_patterns(patterns)
    return images.select("dump_id", F.col("data").cast("binary").alias("data")).mapInArrow(_regex(good), f"dump_id {kind}, label string, off bigint, length int")


def _string_pieces(min_length: int, encoding: str):
    table = string_bytes(encoding)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, start, end, edge, piece = [], [], [], [], []
            for i, (base, size, data) in enumerate(zip(batch.column("base_off").to_pylist(), batch.column("size").to_pylist(), batch.column("data").to_pylist())):
                data = data[:size]
                for a, b in zip(*map(np.ndarray.tolist, runs_of(table[as_bytes(data)]))):
                    open_ended = (a == 0 and base > 0) or b == size
                    if open_ended or b - a >= min_length:
                        at.append(i)
                        start.append(base + a)
                        end.append(base + b)
                        edge.append(open_ended)
                        piece.append(data[a:b])
            if at:
                yield pa.RecordBatch.from_arrays([_by_id(batch, at), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(edge, pa.bool_()), pa.array(piece, pa.binary())], names=["dump_id", "start", "end", "edge", "piece"])

    return pieces


def _string_texts(min_length: int, encoding: str):
    extract = utf8_strings if encoding == "utf-8" else ascii_strings

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, base + off, length, text) for i, (base, piece) in enumerate(zip(batch.column("start").to_pylist(), batch.column("piece").to_pylist())) for off, length, text in extract(piece, min_length)]
            if rows:
                at, off, length, text = zip(*rows)
                yield pa.RecordBatch.from_arrays([_by_id(batch, list(at)), pa.array(off, pa.int64()), pa.array(length, pa.int32()), pa.array(text, pa.string())], names=["dump_id", "off", "length", "value"])

    return texts


def strings_of(images: DataFrame, min_length: int = 4, encoding: str = "ascii") -> DataFrame:
    """Printable strings: ``dump_id, off, length, value``; lengths in bytes, ``min_length`` in characters.

    Takes images ``(dump_id, data)`` or their chunks.  Runs are found inside the chunks; only runs
    at a chunk's edge are put together over the image.  A page of strings is ``results.next_page``.
    """
    kind = dict(images.dtypes)["dump_id"]
    chunks = images if "base_off" in images.columns else chunked(images)
    found = chunks.select("dump_id", "base_off", "size", "data").mapInArrow(_string_pieces(min_length, encoding), f"dump_id {kind}, start bigint, end bigint, edge boolean, piece binary")
    along = Window.partitionBy("dump_id").orderBy("start")
    new = F.coalesce((F.lag("end").over(along) < F.col("start")).cast("int"), F.lit(1))
    met = found.filter("edge").withColumn("_n", new).withColumn("_r", F.sum("_n").over(along)).groupBy("dump_id", "_r")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("start", "piece"))), lambda x: x["piece"])
    met = met.agg(F.min("start").alias("start"), F.concat_ws("", F.transform(parts, lambda p: F.hex(p))).alias("_h")).select("dump_id", "start", F.unhex("_h").alias("piece"))
    return found.filter("not edge").select("dump_id", "start", "piece").unionByName(met).mapInArrow(_string_texts(min_length, encoding), f"dump_id {kind}, off bigint, length int, value string")


def hits_in_static(hits: DataFrame, volatile_runs: DataFrame, by: list[str]) -> DataFrame:
    """Hits none of whose bytes lies in a volatile run (an anti range join by buckets)."""
    from bytefold.operators.intervals import overlap_join

    numbered = hits.withColumn("_end", F.col("off") + F.col("length"))
    touched = overlap_join(numbered, volatile_runs, by, ("off", "_end"), ("start", "end"), how="left_semi")
    keys = [c for c in hits.columns]
    return hits.join(touched.select(*keys).distinct(), keys, "left_anti")


def hex_lines(images: DataFrame, width: int = 16) -> DataFrame:
    """A hex dump: ``dump_id, off, hex, text`` per line of ``width`` bytes."""
    sized = images.select("dump_id", F.col("data").cast("binary").alias("d")).filter(F.octet_length("d") > 0)
    at = sized.select("dump_id", "d", F.explode(F.sequence(F.lit(0), F.floor((F.octet_length("d") - 1) / width).cast("int"))).alias("_n"))
    part = at.select("dump_id", (F.col("_n") * width).cast("bigint").alias("off"), F.substring("d", F.col("_n") * width + 1, F.lit(width)).alias("p"))
    pairs = F.regexp_extract_all(F.lower(F.hex("p")), F.lit("(..)"), F.lit(1))
    shown = F.transform(pairs, lambda h: F.when((h >= "20") & (h < "7f"), F.chr(F.conv(h, 16, 10).cast("bigint"))).otherwise("."))
    return part.select("dump_id", "off", F.array_join(pairs, " ").alias("hex"), F.array_join(shown, "").alias("text"))


def masked_score(data: bytes, at: int, rules: list[dict]) -> float:
    """Share of structural rules that hold for a candidate at ``at``; one outside the data fails.

    A rule: ``offset`` from the candidate's start, ``bytes`` and optional ``mask`` as hex text.
    """
    passed = 0
    for rule in rules:
        want = bytes.fromhex(rule.get("bytes", ""))
        mask = bytes.fromhex(rule["mask"]) if rule.get("mask") else b"\xff" * len(want)
        start = at + rule["offset"]
        if start < 0 or start + len(want) > len(data):
            continue
        bits = int.from_bytes(mask[: len(want)].ljust(len(want), b"\0"), "big")
        passed += int.from_bytes(data[start : start + len(want)], "big") & bits == int.from_bytes(want, "big") & bits
    return passed / len(rules) if rules else 0.0
