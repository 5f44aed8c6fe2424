"""Deeply nested records as flat tables, by Dewey labels.

Every node of a record gets the path of ordinals that leads to it (``2.0.1``) and the path of
names without ordinals (``regions[].key_hints[].offset``), its schema path.  A node's parent is
its label without the last ordinal, the position in any array above is an ordinal of the label,
and the nodes of one schema path are one table; no join is needed for any of these.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NODES = "doc string, label string, path string, kind string, value string"
_BATCH = 32_768


def _no_constant(name: str):
    raise ValueError(f"{name} is no JSON")


def read_json(text: str | None):
    """The value of a JSON text, read through any wrapping in JSON strings; ValueError if it is none."""
    value = json.loads(text, parse_constant=_no_constant)
    while isinstance(value, str):
        value = json.loads(value, parse_constant=_no_constant)
    return value


def walk(value, arrays: frozenset[str], wanted: Callable[[str], bool] = lambda path: True) -> Iterator[tuple[str, str, str, str | None]]:
    """All nodes as (label, path, kind, value), in document order, without recursion.

    ``arrays`` are schema paths that hold arrays: another value there counts as element 0.
    ``wanted`` says of a schema path whether the subtree below it may hold nodes to keep.
    """
    stack = [("", "", value)]
    while stack:
        label, path, v = stack.pop()
        if path in arrays and v is not None and not isinstance(v, list):
            v = [v]
        if isinstance(v, dict):
            yield label, path, "object", None
            below = [(i, f"{path}.{k}" if path else k, x) for i, (k, x) in enumerate(v.items())]
        elif isinstance(v, list):
            yield label, path, "array", None
            below = [(i, path + "[]", x) for i, x in enumerate(v)]
        else:
            kind = "null" if v is None else "bool" if isinstance(v, bool) else "int" if isinstance(v, int) else "float" if isinstance(v, float) else "text"
            yield label, path, kind, None if v is None else v if isinstance(v, str) else json.dumps(v)
            continue
        stack.extend((f"{label}.{i}" if label else str(i), p, x) for i, p, x in reversed(below) if wanted(p))


def _shred(arrays: frozenset[str], paths: frozenset[str] | None):
    above = None if paths is None else {p[:i] for p in paths for i in range(len(p) + 1)}

    def shred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(f.split()[0], pa.string()) for f in _NODES.split(", ")])
        out: list[tuple] = []
        for batch in batches:
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("json").to_pylist()):
                if not text:
                    continue
                try:
                    value = read_json(text)
                except (ValueError, RecursionError):
                    continue
                for node in walk(value, arrays, above.__contains__ if above is not None else lambda p: True):
                    if paths is None or node[1] in paths:
                        out.append((doc, *node))
                if len(out) >= _BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], schema=schema)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], schema=schema)

    return shred


def nodes(records: DataFrame, doc: Column, text: Column, arrays: list[str] | None = None, paths: list[str] | None = None) -> DataFrame:
    """The nodes of JSON texts: ``doc, label, path, kind, value``.

    With ``paths`` only nodes of these schema paths come out and no other branch is walked.

    Defined cases: null, empty and invalid JSON (also one nested beyond the parser's depth) gives
    no node; of repeated member names the last counts; null elements keep their position; a value
    that isn't an array where ``arrays`` says so is element 0; repeated rows repeat their nodes.
    """
    body = records.select(doc.cast("string").alias("doc"), text.cast("string").alias("json"))
    return body.mapInArrow(_shred(frozenset(arrays or ()), None if paths is None else frozenset(paths)), _NODES)


def ordinal(label: Column | str, depth: int) -> Column:
    """The ordinal at ``depth`` (from 0) of a label; null beyond its end."""
    return F.get(F.split(F.col(label) if isinstance(label, str) else label, r"\."), F.lit(depth)).cast("int")


def parent(label: Column | str) -> Column:
    """The label of the parent: the label without its last ordinal; null for the root."""
    c = F.col(label) if isinstance(label, str) else label
    return F.when(c != "", F.regexp_replace(c, r"\.?\d+$", ""))


def integer(kind: Column, value: Column) -> Column:
    """An integer kept as a JSON number or as text (decimal or ``0x`` hex); null if it is none."""
    t = F.lower(F.trim(value))
    hexed = F.when(t.rlike("^0x0*[0-9a-f]{1,16}$"), F.conv(F.substring(t, 3, 1000), 16, 10).try_cast("bigint"))
    plain = F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast("bigint"))
    whole = F.when(value.try_cast("double") == F.floor(value.try_cast("double")), value.try_cast("double").try_cast("bigint"))
    return F.when(kind.isin("int", "text"), F.coalesce(plain, F.when(kind == "text", hexed))).when(kind == "float", whole)


def _depth(path: str) -> int:
    """Ordinals in the label of a node at a schema path."""
    return path.count("[]") + sum(bool(name.rstrip("[]")) for name in path.split("."))


def flat_table(all_nodes: DataFrame, path: str, columns: list[str], above: str = "", prefix: str = "") -> DataFrame:
    """One table of the shredded records: a row per object at ``path`` with its scalar members.

    Columns: ``doc, label, parent_label`` and one text column per member name behind ``prefix``; a
    member with the name of one of the first three is called ``member_…``.  ``parent_label`` is
    the label of the row at the schema path ``above`` (the record itself by default) that holds the
    object.  Members and parents are reached by cutting ordinals off a label; only the members of
    one object meet in an exchange.
    """
    under = f"{path}." if path else ""
    own = all_nodes.filter((F.col("path") == path) & (F.col("kind") == "object")).select("doc", "label", F.lit(None).cast("string").alias("member"), F.lit(None).cast("string").alias("value"))
    leaf = all_nodes.filter(F.col("path").isin([under + c for c in columns]) & ~F.col("kind").isin("object", "array")).select("doc", parent("label").alias("label"), F.substring("path", len(under) + 1, 10_000).alias("member"), "value")
    names = {c: f"member_{c}" if prefix + c in ("doc", "label", "parent_label") else prefix + c for c in columns}
    picked = [F.max(F.when(F.col("member") == c, F.col("value"))).alias(names[c]) for c in columns]
    cut = F.regexp_replace("label", rf"(\.?\d+){{{_depth(path) - _depth(above)}}}$", "")
    return own.unionByName(leaf).groupBy("doc", "label").agg(*picked).select("doc", "label", (cut if path else F.lit(None).cast("string")).alias("parent_label"), *names.values())
