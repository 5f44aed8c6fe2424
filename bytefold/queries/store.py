"""Queries over the store tables: messages, nested records, references (p3, p4, p5)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytefold.functions.normalize import instant_micros, norm_id, trimmed
from bytefold.operators.nested import flat_table, integer, nodes, ordinal, parent
from bytefold.operators.references import OrphanTracker
from bytefold.session import scratch_path, table
from bytefold.streaming.dedupe import surplus_messages


def _arrivals(spark: SparkSession, d: str, increments: int = 3) -> tuple[str, int]:
    """The deliveries as files in the order of their batches, and how many files make an increment."""
    files = max(2 * increments, int(spark.conf.get("spark.sql.shuffle.partitions")))
    path = scratch_path(spark, "arrivals")
    rows = table(spark, d, "nsweep_events").select("batch_id", "delivery_id", "received_at", "task_id", "type", "seq")
    rows.repartitionByRange(files, "batch_id", "delivery_id").drop("batch_id").write.parquet(path)
    return path, -(-files // increments)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The surplus deliveries of progress messages, which arrive in several increments."""
    path, per_trigger = _arrivals(spark, d)
    return surplus_messages(spark, path, files_per_trigger=per_trigger).select(F.col("id").alias("delivery_id"))


def p3_kept(spark: SparkSession, d: str) -> DataFrame:
    """The deliveries that remain, one per message."""
    return table(spark, d, "nsweep_events").join(p3_found(spark, d), "delivery_id", "left_anti").select("delivery_id", "task_id", "type", "seq")


def _sweep_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nsweep_events").select("delivery_id", "extra")


def _sweep_nodes(spark: SparkSession, d: str) -> DataFrame:
    return nodes(_sweep_rows(spark, d), F.col("delivery_id"), F.col("extra"), ["points"], ["stages.total_bytes", "points[].stages.total_bytes"])


def _dump_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dumps").select(norm_id("dump_id").alias("dump_id"), "metadata_json").filter("dump_id is not null").groupBy("dump_id").agg(F.max("metadata_json").alias("metadata_json"))


def _dump_nodes(spark: SparkSession, d: str) -> DataFrame:
    return nodes(_dump_rows(spark, d), F.col("dump_id"), F.col("metadata_json"), ["regions", "regions[].key_hints"], ["regions[].key_hints[].offset"])


def _truth_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gt_runs").select("gt_id", F.to_json(F.struct("dumps")).alias("body"))


def _truth_nodes(spark: SparkSession, d: str) -> DataFrame:
    return nodes(_truth_rows(spark, d), F.col("gt_id"), F.col("body"), ["dumps"], ["dumps[].va_info.extra.region_start_va"])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The integer leaves of sweep points, key hints and ground-truth dumps with their positions."""

    def leaves(src: str, df: DataFrame, a, b) -> DataFrame:
        return df.select(F.lit(src).alias("src"), F.col("doc").alias("parent_key"), a.cast("int").alias("pos_a"), b.cast("int").alias("pos_b"), integer(F.col("kind"), F.col("value")).alias("leaf_value"))

    none = F.lit(-1)
    sweep = leaves("nsweep_events", _sweep_nodes(spark, d), F.when(F.col("path").startswith("points"), ordinal("label", 1)).otherwise(none), none)
    dump = leaves("dumps", _dump_nodes(spark, d), ordinal("label", 1), ordinal("label", 3))
    truth = leaves("gt_runs", _truth_nodes(spark, d), ordinal("label", 1), none)
    return sweep.unionByName(dump).unionByName(truth).filter("leaf_value is not null")


def p4_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Every node of the records of all three sources with its label, schema path and parent label."""
    dump = nodes(_dump_rows(spark, d), F.col("dump_id"), F.col("metadata_json"), ["regions", "regions[].key_hints", "modules"])
    sources = {"nsweep_events": nodes(_sweep_rows(spark, d), F.col("delivery_id"), F.col("extra"), ["points"]), "dumps": dump, "gt_runs": nodes(_truth_rows(spark, d), F.col("gt_id"), F.col("body"), ["dumps"])}
    return reduce(DataFrame.unionByName, (df.select(F.lit(src).alias("src"), "doc", "label", parent("label").alias("parent_label"), "path", "kind", "value") for src, df in sources.items()))


#: Flat tables: name, source, schema path, columns, and the schema path of the parent rows.
FLAT = [
    ("p4_points", "nsweep_events", "points[]", ["n", "candidates_tried", "hits"], ""),
    ("p4_regions", "dumps", "regions[]", ["base", "size", "prot"], ""),
    ("p4_key_hints", "dumps", "regions[].key_hints[]", ["offset", "length", "kind"], "regions[]"),
    ("p4_truth_dumps", "gt_runs", "dumps[]", ["label", "size_bytes", "format"], ""),
]


def _flat(source: str, path: str, columns: list[str], above: str) -> Callable[[SparkSession, str], DataFrame]:
    rows, key, text, arrays = {
        "nsweep_events": (_sweep_rows, "delivery_id", "extra", ["points"]),
        "dumps": (_dump_rows, "dump_id", "metadata_json", ["regions", "regions[].key_hints"]),
        "gt_runs": (_truth_rows, "gt_id", "body", ["dumps"]),
    }[source]

    def query(spark: SparkSession, d: str) -> DataFrame:
        """One flat table of the records of a source, with the label of its parent row."""
        found = nodes(rows(spark, d), F.col(key), F.col(text), arrays, [path, *(f"{path}.{c}" for c in columns)])
        return flat_table(found, path, columns, above, "v_")

    return query


#: Child table, its id, its reference, its time, and the parent table with its id and time.
RELATIONS = [
    ("findings", "finding_id", "run_id", "created_at", "analysis_runs", "run_id", "started_at"),
    ("analysis_runs", "run_id", "dump_id", "started_at", "dumps", "dump_id", "added_at"),
    ("dumps", "dump_id", "project_id", "added_at", "projects", "project_id", "created_at"),
]


#: Parts of the tracker's tables.
PARTS = 16


def _tracked(spark: SparkSession, d: str, snapshot: bool = False) -> OrphanTracker:
    """The tracker after three increments: references that come before their parents, the parents with further references, removals."""
    refs, parents = {}, {}
    for child, own, ref, at, parent, key, since in RELATIONS:
        refs[child] = table(spark, d, child, own if child == "findings" else None).select(F.lit(child).alias("child_table"), norm_id(own).alias("child_key"), F.lit(parent).alias("parent_table"), norm_id(ref).alias("ref"), instant_micros(at).alias("micros"))
        parents[parent] = table(spark, d, parent).select(F.lit(parent).alias("parent_table"), norm_id(key).alias("ref"), instant_micros(since).alias("parent_micros"))
    removed = table(spark, d, "removed_keys").select(F.lower(trimmed("parent_table")).alias("parent_table"), norm_id("key_id").alias("ref"), F.coalesce(F.col("removed_at").cast("string"), F.lit("")).alias("removed_at"), F.col("restored_at").isNotNull().alias("restored"))
    tracker = OrphanTracker(spark, parts=PARTS)
    tracker.advance(refs["dumps"].unionByName(refs["analysis_runs"]), parents["projects"], snapshot=False)
    tracker.advance(refs["findings"], parents["dumps"].unionByName(parents["analysis_runs"]), snapshot=False)
    tracker.advance(removals=removed, snapshot=snapshot)
    return tracker


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose reference is deleted, absent or late."""
    return OrphanTracker.report(_tracked(spark, d).pending())


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    """Failing references per table, month and state."""
    tracker = _tracked(spark, d, snapshot=True)
    return tracker.counts().filter(F.col("version") == tracker.version).select("child_table", "month_utc", "ref_state", "orphans")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p3_found, p3_kept, p4_found, p4_nodes, p5_found, p5_counts)} | {name: _flat(*rest) for name, *rest in FLAT}


def _id(c: str) -> str:
    return f"nullif(replace(lower(trim({c})), '-', ''), '')"


def _micros(c: str) -> str:
    return f"""CASE WHEN regexp_full_match({c}, '[0-9]{{8}}_[0-9]{{6}}_[0-9]{{1,6}}')
      THEN epoch_us(strptime(left({c}, 15), '%Y%m%d_%H%M%S')) + CAST(substr({c}, 17) AS BIGINT)
      WHEN regexp_matches({c}, '(Z|[+-][0-9][0-9]:?[0-9][0-9])$') THEN epoch_us(CAST({c} AS TIMESTAMPTZ))
      ELSE epoch_us(CAST({c} AS TIMESTAMP)) END"""


def _orphans() -> str:
    parts = []
    for child, own, ref, at, parent, key, since in RELATIONS:
        parts.append(f"""
  SELECT '{child}' AS child_table, c.k AS child_key, c.us,
    CASE WHEN EXISTS (SELECT 1 FROM removed_keys r WHERE lower(trim(r.parent_table)) = '{parent}' AND {_id('r.key_id')} = c.r AND r.restored_at IS NULL) THEN 'deleted'
      WHEN p.k IS NULL THEN 'absent' WHEN p.us > c.us THEN 'late' END AS ref_state
  FROM (SELECT {_id(own)} AS k, {_id(ref)} AS r, min({_micros(at)}) AS us FROM {child} GROUP BY 1, 2) c
  LEFT JOIN (SELECT {_id(key)} AS k, min({_micros(since)}) AS us FROM {parent} GROUP BY 1) p ON p.k = c.r
  WHERE c.r IS NOT NULL AND c.k IS NOT NULL""")
    return "WITH o AS (" + " UNION ALL ".join(parts) + """),
f AS (SELECT DISTINCT child_table, child_key, coalesce(strftime(make_timestamp(us), '%Y-%m'), 'unknown') AS month_utc, ref_state FROM o WHERE ref_state IS NOT NULL)
"""


_LEAF = """CASE WHEN json_type({v}) IN ('UBIGINT', 'BIGINT') THEN CAST({v} AS BIGINT)
  WHEN json_type({v}) = 'VARCHAR' AND regexp_full_match(trim({v} ->> '$'), '0[xX][0-9a-fA-F]{{1,15}}') THEN CAST(lower(trim({v} ->> '$')) AS BIGINT)
  WHEN json_type({v}) = 'VARCHAR' AND regexp_full_match(trim({v} ->> '$'), '[+-]?[0-9]+') THEN CAST(trim({v} ->> '$') AS BIGINT) END"""


def _json(table_name: str, key: str, col: str) -> str:
    """Rows with their JSON value, read through one wrapping."""
    return f"""SELECT k, CASE WHEN json_type(j) = 'VARCHAR' THEN TRY_CAST(j ->> '$' AS JSON) ELSE j END AS j
    FROM (SELECT {key} AS k, TRY_CAST(max({col}) AS JSON) AS j FROM {table_name} WHERE {col} <> '' GROUP BY 1)"""


def _elements(j: str) -> str:
    return f"CASE json_type({j}) WHEN 'ARRAY' THEN CAST({j} AS JSON[]) WHEN 'NULL' THEN [] ELSE CASE WHEN {j} IS NULL THEN [] ELSE [{j}] END END"


_LEAVES = f"""
WITH n AS ({_json('nsweep_events', 'delivery_id', 'extra')}),
np AS (SELECT k, unnest(e) AS x, generate_subscripts(e, 1) - 1 AS a FROM (SELECT k, {_elements("(j -> '$.points')")} AS e FROM n)),
d AS ({_json('dumps', _id('dump_id'), 'metadata_json')}),
dr AS (SELECT k, unnest(e) AS x, generate_subscripts(e, 1) - 1 AS a FROM (SELECT k, {_elements("(j -> '$.regions')")} AS e FROM d)),
dk AS (SELECT k, a, unnest(e) AS x, generate_subscripts(e, 1) - 1 AS b FROM (SELECT k, a, {_elements("(x -> '$.key_hints')")} AS e FROM dr)),
g AS (SELECT gt_id AS k, unnest(dumps) AS x, generate_subscripts(dumps, 1) - 1 AS a FROM gt_runs),
u AS (
  SELECT 'nsweep_events' AS src, CAST(k AS VARCHAR) AS parent_key, -1 AS pos_a, -1 AS pos_b, {_LEAF.format(v="(j -> '$.stages.total_bytes')")} AS leaf_value FROM n
  UNION ALL SELECT 'nsweep_events', CAST(k AS VARCHAR), a, -1, {_LEAF.format(v="(x -> '$.stages.total_bytes')")} FROM np
  UNION ALL SELECT 'dumps', k, a, b, {_LEAF.format(v="(x -> '$.offset')")} FROM dk
  UNION ALL SELECT 'gt_runs', CAST(k AS VARCHAR), a, -1, x.va_info.extra.region_start_va FROM g)
SELECT src, parent_key, CAST(pos_a AS INTEGER) AS pos_a, CAST(pos_b AS INTEGER) AS pos_b, leaf_value FROM u WHERE leaf_value IS NOT NULL"""


def _member(j: str, columns: list[str]) -> str:
    return ", ".join(f"CASE WHEN json_type({j} -> '$.{c}') NOT IN ('OBJECT', 'ARRAY') THEN {j} ->> '$.{c}' END AS v_{c}" for c in columns)


def _at(j: str, name: str) -> str:
    """The ordinal of a member in its object."""
    return f"(list_position(json_keys({j}), '{name}') - 1)"


def _tables() -> dict[str, str]:
    """The flat tables, their labels counted from the members' and elements' places."""
    columns = {name: cols for name, _, _, cols, _ in FLAT}
    dumps = f"""d AS ({_json('dumps', _id('dump_id'), 'metadata_json')}),
dr AS (SELECT k, {_at('j', 'regions')} || '.' || a AS label, x FROM (SELECT k, j, unnest(e) AS x, generate_subscripts(e, 1) - 1 AS a FROM (SELECT k, j, {_elements("(j -> '$.regions')")} AS e FROM d)))"""
    points = f"""n AS ({_json('nsweep_events', 'delivery_id', 'extra')}),
np AS (SELECT k, {_at('j', 'points')} || '.' || a AS label, x FROM (SELECT k, j, unnest(e) AS x, generate_subscripts(e, 1) - 1 AS a FROM (SELECT k, j, {_elements("(j -> '$.points')")} AS e FROM n)))"""
    hints = f"""dk AS (SELECT k, label || '.' || {_at('r', 'key_hints')} || '.' || b AS label, label AS up, x FROM (SELECT k, label, r, unnest(e) AS x, generate_subscripts(e, 1) - 1 AS b FROM (SELECT k, label, x AS r, {_elements("(x -> '$.key_hints')")} AS e FROM dr)))"""
    row = "json_type(x) = 'OBJECT'"
    return {
        "p4_points": f"WITH {points} SELECT CAST(k AS VARCHAR) AS doc, label, '' AS parent_label, {_member('x', columns['p4_points'])} FROM np WHERE {row}",
        "p4_regions": f"WITH {dumps} SELECT k AS doc, label, '' AS parent_label, {_member('x', columns['p4_regions'])} FROM dr WHERE {row}",
        "p4_key_hints": f"WITH {dumps}, {hints} SELECT k AS doc, label, up AS parent_label, {_member('x', columns['p4_key_hints'])} FROM dk WHERE {row}",
        "p4_truth_dumps": "SELECT CAST(gt_id AS VARCHAR) AS doc, '0.' || a AS label, '' AS parent_label, x.label AS v_label, CAST(x.size_bytes AS VARCHAR) AS v_size_bytes, x.format AS v_format FROM (SELECT gt_id, unnest(dumps) AS x, generate_subscripts(dumps, 1) - 1 AS a FROM gt_runs) WHERE x IS NOT NULL",
    }


def oracle_sql() -> dict[str, str]:
    ranked = f"""SELECT *, row_number() OVER (PARTITION BY {_id('task_id')}, seq, lower(trim(type)) ORDER BY received_at NULLS LAST, delivery_id) AS n
      FROM nsweep_events"""
    single = f"{_id('task_id')} IS NULL OR seq IS NULL"
    return {
        "p3_found": f"SELECT delivery_id FROM ({ranked}) WHERE n > 1 AND NOT ({single})",
        "p3_kept": f"SELECT delivery_id, task_id, type, seq FROM ({ranked}) WHERE n = 1 OR {single}",
        "p4_found": _LEAVES,
        **_tables(),
        "p5_found": _orphans() + "SELECT child_table, child_key, month_utc, ref_state FROM f",
        "p5_counts": _orphans() + "SELECT child_table, month_utc, ref_state, count(*) AS orphans FROM f GROUP BY 1, 2, 3",
    }
