"""Queries over hits: the findings table with the run, dump and library each finding came from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytefold.functions.crypto import encrypt, verifies
from bytefold.functions.normalize import instant_micros, micros_of, norm_hex, norm_id, norm_label, trimmed
from bytefold.operators import hits as H
from bytefold.operators import intervals as I
from bytefold.operators.results import where_equal
from bytefold.operators.running import running
from bytefold.session import table
from bytefold.sources import catalog as K
from bytefold.streaming.sessions import idle_sessions, in_ring


def findings(spark: SparkSession, d: str) -> DataFrame:
    """One row per finding id: ``finding_id, run_id, secret_type, off, length, confidence, micros``."""
    rows = table(spark, d, "findings", "finding_id").select(norm_id("finding_id").alias("finding_id"), F.struct(norm_id("run_id").alias("run_id"), norm_label("finding_type").alias("secret_type"), F.col("byte_offset").alias("off"), "length", "confidence", norm_hex("value_hex").alias("value"), instant_micros("created_at").alias("micros")).alias("r"))
    return rows.filter("finding_id is not null").groupBy("finding_id").agg(F.min("r").alias("r")).select("finding_id", "r.*")


def runs(spark: SparkSession, d: str) -> DataFrame:
    """One row per run, the finished one if there is one."""
    rows = table(spark, d, "analysis_runs").select(norm_id("run_id").alias("run_id"), norm_id("project_id").alias("project_id"), norm_id("dump_id").alias("dump_id"), "status", instant_micros("started_at").alias("started"), instant_micros("finished_at").alias("finished"))
    return H.latest(rows.filter("run_id is not null"), "run_id", [F.col("finished").desc_nulls_last(), "status", F.col("started").asc_nulls_last()])


def dumps(spark: SparkSession, d: str) -> DataFrame:
    """One row per dump with library, run number and kind from its path."""
    rows = table(spark, d, "dumps").select(norm_id("dump_id").alias("dump_id"), F.struct(norm_id("project_id").alias("project_id"), "file_path", F.lower(trimmed("file_type")).alias("file_type"), "file_size", instant_micros("added_at").alias("added")).alias("r"))
    rows = rows.filter("dump_id is not null").groupBy("dump_id").agg(F.min("r").alias("r")).select("dump_id", "r.*")
    part = lambda i: F.nullif(F.regexp_extract("file_path", r"^/data/([^/]+)/run_(\d+)/", i), F.lit(""))
    return rows.withColumn("library", part(1)).withColumn("run_number", part(2).cast("int"))


def hits(spark: SparkSession, d: str) -> DataFrame:
    """Findings with the library of their run's dump, null where that is unknown."""
    where = runs(spark, d).select("run_id", "dump_id").join(dumps(spark, d).select("dump_id", "library"), "dump_id", "left").select("run_id", "library")
    return findings(spark, d).join(where, "run_id", "left")


def hit_key_candidates(spark: SparkSession, d: str) -> DataFrame:
    """(offset page, type) seen in at least two runs."""
    return H.key_candidates(hits(spark, d).withColumn("off", F.floor(F.col("off") / 4096)))


def hit_cross_library(spark: SparkSession, d: str) -> DataFrame:
    return H.cross_library(hits(spark, d).withColumn("off", F.floor(F.col("off") / 65536)))


def hit_offset_variance(spark: SparkSession, d: str) -> DataFrame:
    valid = hits(spark, d).filter(F.col("confidence").between(0, 1) & ~F.isnan("confidence")).withColumn("off", F.floor(F.col("off") / 65536))
    return H.offset_variance(valid).withColumn("confidence_variance", F.round("confidence_variance", 6))


def hit_summary(spark: SparkSession, d: str) -> DataFrame:
    return H.hit_summary(hits(spark, d))


def hit_presence(spark: SparkSession, d: str) -> DataFrame:
    """Library by secret type, whether it was ever found."""
    return H.presence(hits(spark, d), "library", "secret_type")


def phase_presence(spark: SparkSession, d: str) -> DataFrame:
    """Secret type by lifecycle phase of the dump: shows which secrets outlive a phase."""
    phase = F.regexp_extract("file_path", r"([a-z_]+)\.[a-z]+$", 1)
    where = runs(spark, d).select("run_id", "dump_id").join(dumps(spark, d).select("dump_id", phase.alias("phase")), "dump_id").select("run_id", "phase")
    return H.presence(findings(spark, d).join(where, "run_id"), "secret_type", "phase")


def hit_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Hits per library and type with subtotals."""
    return hits(spark, d).rollup("library", "secret_type").agg(F.grouping_id().cast("bigint").alias("level"), F.count(F.lit(1)).alias("hits"))


def detection_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Precision and recall of a confidence cut per library, structural hits being the truth."""
    rows = hits(spark, d).filter(F.col("library").isNotNull())
    good = F.coalesce(F.col("confidence").between(0.75, 1) & ~F.isnan("confidence"), F.lit(False))
    out = H.detection_metrics(rows, ["library"], good, F.coalesce(F.col("secret_type") == "exact_match", F.lit(False)))
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


def confidence_rollup(spark: SparkSession, d: str) -> DataFrame:
    valid = findings(spark, d).filter(F.col("confidence").between(0, 1) & ~F.isnan("confidence"))
    return H.confidence_rollup(valid, ["run_id"]).withColumns({c: F.round(c, 4) for c in ("best", "by_count", "overall")})


def findings_by_type(spark: SparkSession, d: str) -> DataFrame:
    return findings(spark, d).groupBy("run_id", "secret_type").agg(F.count(F.lit(1)).alias("n"))


def findings_timeline(spark: SparkSession, d: str) -> DataFrame:
    """Order of each run's findings in time."""
    rows = findings(spark, d).filter("run_id is not null").select("run_id", "finding_id", "micros")
    placed = running(rows, ["run_id"], [F.col("micros").isNull(), "micros", "finding_id"], position="position")
    return placed.select("run_id", "finding_id", F.col("position").cast("int").alias("position"))


def run_view(spark: SparkSession, d: str) -> DataFrame:
    """Runs as of their last row."""
    return runs(spark, d).select("run_id", "project_id", "dump_id", "status", "finished")


def completed_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of one status, with the project they are of."""
    return where_equal(runs(spark, d), status="completed").select("run_id", "project_id")


def project_timeline(spark: SparkSession, d: str) -> DataFrame:
    """Runs per project and status with first and last start."""
    return runs(spark, d).groupBy("project_id", "status").agg(F.count(F.lit(1)).alias("runs"), F.min("started").alias("first"), F.max("started").alias("last"))


def run_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Distinct libraries, dumps, bytes and secrets of all runs."""
    d1 = dumps(spark, d).agg(F.count_distinct("library").alias("libraries"), F.count(F.lit(1)).alias("dumps"), F.sum("file_size").alias("bytes"))
    f1 = findings(spark, d).agg(F.count_distinct("secret_type", "value").alias("secrets"))
    return d1.withColumn("secrets", f1.scalar())


def secrets(spark: SparkSession, d: str) -> DataFrame:
    """Distinct (type, value) pairs with the short label of the type."""
    rows = findings(spark, d).filter("value is not null and secret_type is not null").select("secret_type", "value").distinct()
    return rows.withColumn("label", K.label(F.upper("secret_type")))


def hits_in_regions(spark: SparkSession, d: str) -> DataFrame:
    """Candidate regions with 64 KiB on either side that hold a finding of their run."""
    regions = entries(spark, d).select("run_id", "entry_id", (F.col("off") - 65536).alias("start"), (F.col("off") + F.col("length") + 65536).alias("end"))
    points = findings(spark, d).filter("run_id is not null and off is not null").select("run_id", "finding_id", "off")
    return I.point_join(points, regions, ["run_id"], "off", ("start", "end")).select("run_id", "finding_id", F.col("r_entry_id").alias("entry_id"))


def entries(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "topk_entries").select("entry_id", norm_id("run_id").alias("run_id"), F.col("byte_offset").alias("off"), "length", "mean_variance", "mean_entropy")
    return rows.filter("run_id is not null and off is not null and length > 0").dropDuplicates(["entry_id"])


def overlapping_regions(spark: SparkSession, d: str) -> DataFrame:
    """Findings whose bytes overlap the page-wide surroundings of a candidate region of their run."""
    f = findings(spark, d).filter("run_id is not null and off is not null and length > 0").select("run_id", "finding_id", F.col("off").alias("start"), (F.col("off") + F.col("length")).alias("end"))
    e = entries(spark, d).select("run_id", (F.col("off") - 4096).alias("start"), (F.col("off") + F.col("length") + 4096).alias("end"))
    return I.overlap_join(f, e, ["run_id"], ("start", "end"), ("start", "end"), how="left_semi").select("run_id", "finding_id")


def owner_lookup(spark: SparkSession, d: str) -> DataFrame:
    """For each finding the candidate region that starts last at or before it, within 1 MiB."""
    owners = entries(spark, d).select("run_id", F.col("off").alias("base"), (F.col("off") + (1 << 20)).alias("stop"), F.lpad(F.col("entry_id").cast("string"), 20, "0").alias("name"))
    points = findings(spark, d).filter("run_id is not null and off is not null").select("run_id", "finding_id", "off")
    return I.owner_of(points, owners, ["run_id"], "off", "base", "stop", "name").select("finding_id", F.col("owner").cast("bigint").alias("entry_id"), "owner_base")


def view_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Candidate regions of a run laid end to end in address order."""
    return I.cumulative(entries(spark, d), ["run_id"], ["off", "entry_id"], "length").select("run_id", "entry_id", "view_off")


def common_types(spark: SparkSession, d: str) -> DataFrame:
    """Types found in every library."""
    rows = hits(spark, d).filter("library is not null and secret_type is not null").select("library", "secret_type").distinct()
    return I.common_keys(rows, "library", ["secret_type"])


def unresolved_dumps(spark: SparkSession, d: str) -> DataFrame:
    """Runs with the path of their dump, null where the dump isn't known."""
    return runs(spark, d).filter("dump_id is not null").select("run_id", "dump_id").join(dumps(spark, d).select("dump_id", "file_path"), "dump_id", "left").select("run_id", "dump_id", "file_path")


def aes_check(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct 32-byte value encrypts and verifies under itself and not under its digest."""
    keys = findings(spark, d).filter(F.length("value") == 64).select(F.unhex("value").alias("key"), "value").distinct()
    plain = F.encode(F.lit("known plaintext"), "UTF-8")
    sealed = keys.withColumn("sealed", encrypt(F.col("key"), plain))
    right = verifies(F.col("key"), F.col("sealed"), plain)
    wrong = verifies(F.unhex(F.sha2("key", 256)), F.col("sealed"), plain)
    return sealed.select(right.alias("own"), wrong.alias("other")).groupBy("own", "other").agg(F.count(F.lit(1)).alias("keys"))


def event_replay(spark: SparkSession, d: str) -> DataFrame:
    """Per task: distinct messages, those kept in the reference's ring, those of them after sequence number 10."""
    rows = table(spark, d, "nsweep_events").select(norm_id("task_id").alias("task_id"), "seq", F.coalesce(F.lower(trimmed("type")), F.lit("\x00")).alias("type"), "received_at", "delivery_id").filter("task_id is not null and seq is not null")
    messages = rows.groupBy("task_id").agg(F.count_distinct("seq", "type").alias("messages"))
    kept = in_ring(rows).groupBy("task_id").agg(F.count(F.lit(1)).alias("kept"), F.sum((F.col("seq") > 10).cast("bigint")).alias("replayed"))
    return messages.join(kept, "task_id")


def idle_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Tasks without an event for 90 days before the newest event."""
    rows = table(spark, d, "nsweep_events").select(norm_id("task_id").alias("task_id"), F.timestamp_micros(micros_of("received_at")).alias("at")).filter("task_id is not null")
    return idle_sessions(rows, 90 * 86_400, "at").select("task_id", F.unix_micros("last_at").alias("last_at"))


def survivors_by_stage(spark: SparkSession, d: str) -> DataFrame:
    """Mean progress per stage and kind of event."""
    rows = table(spark, d, "nsweep_events").select(F.lower(trimmed("type")).alias("kind"), "stage", "pct")
    return rows.groupBy("kind", "stage").agg(F.count(F.lit(1)).alias("events"), F.round(F.avg(F.when(F.col("pct") >= 0, F.col("pct"))), 6).alias("mean_pct"))


def downsample(spark: SparkSession, d: str) -> DataFrame:
    """Every 16th candidate region of a run in address order, for display."""
    placed = running(entries(spark, d), ["run_id"], ["off", "entry_id"], position="position")
    return placed.filter("position % 16 = 1").select("run_id", "entry_id")


_QUERIES = (
    hit_key_candidates, hit_cross_library, hit_offset_variance, hit_summary, hit_presence, phase_presence, hit_rollup, detection_metrics, confidence_rollup,
    findings_by_type, findings_timeline, run_view, completed_runs, project_timeline, run_metadata, secrets, hits_in_regions, overlapping_regions, owner_lookup, view_offsets,
    common_types, unresolved_dumps, aes_check, event_replay, idle_tasks, survivors_by_stage, downsample,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def _id(c: str) -> str:
    return f"nullif(replace(lower(trim({c})), '-', ''), '')"


def _us(c: str) -> str:
    return f"""CASE WHEN regexp_full_match({c}, '[0-9]{{8}}_[0-9]{{6}}_[0-9]{{1,6}}')
      THEN epoch_us(strptime(left({c}, 15), '%Y%m%d_%H%M%S')) + CAST(substr({c}, 17) AS BIGINT)
      WHEN regexp_matches({c}, '(Z|[+-][0-9][0-9]:?[0-9][0-9])$') THEN epoch_us(CAST({c} AS TIMESTAMPTZ)) ELSE epoch_us(CAST({c} AS TIMESTAMP)) END"""


_HEX = "regexp_replace(regexp_replace(lower(value_hex), '[ :\\-]', '', 'g'), '^0x', '')"
_BASE = f"""
fnd AS (SELECT {_id('finding_id')} AS finding_id, any_value({_id('run_id')}) AS run_id, any_value(replace(replace(lower(trim(finding_type)), ' ', '_'), '-', '_')) AS secret_type,
    any_value(byte_offset) AS off, any_value(length) AS length, any_value(confidence) AS confidence, any_value(CASE WHEN regexp_full_match({_HEX}, '([0-9a-f][0-9a-f])+') THEN {_HEX} END) AS value, min({_us('created_at')}) AS micros
  FROM findings GROUP BY 1),
rn AS (SELECT * FROM (SELECT {_id('run_id')} AS run_id, {_id('project_id')} AS project_id, {_id('dump_id')} AS dump_id, status, {_us('started_at')} AS started, {_us('finished_at')} AS finished FROM analysis_runs) WHERE run_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY finished DESC NULLS LAST, status, started NULLS LAST) = 1),
dmp AS (SELECT {_id('dump_id')} AS dump_id, any_value({_id('project_id')}) AS project_id, any_value(file_path) AS file_path, any_value(file_size) AS file_size,
    nullif(regexp_extract(any_value(file_path), '^/data/([^/]+)/run_([0-9]+)/', 1), '') AS library FROM dumps GROUP BY 1),
hit AS (SELECT f.*, d.library FROM fnd f LEFT JOIN rn USING (run_id) LEFT JOIN dmp d ON d.dump_id = rn.dump_id),
ent AS (SELECT DISTINCT entry_id, {_id('run_id')} AS run_id, byte_offset AS off, length FROM topk_entries WHERE {_id('run_id')} IS NOT NULL AND byte_offset IS NOT NULL AND length > 0)
"""


_LABELS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.SHORT_LABELS.items())


def oracle_sql() -> dict[str, str]:
    w = "WITH " + _BASE
    valid = "confidence BETWEEN 0 AND 1 AND NOT isnan(confidence)"
    presence = "SELECT a.{r} AS {r}, b.{c} AS {c}, EXISTS (SELECT 1 FROM s WHERE s.{r} = a.{r} AND s.{c} = b.{c}) AS present FROM (SELECT DISTINCT {r} FROM s) a, (SELECT DISTINCT {c} FROM s) b"
    return {
        "hit_key_candidates": f"{w} SELECT off // 4096 AS off, secret_type, count(DISTINCT run_id) AS run_count, count(DISTINCT library) AS lib_count FROM hit GROUP BY 1, 2 HAVING count(DISTINCT run_id) >= 2",
        "hit_cross_library": f"{w} SELECT off // 65536 AS off, secret_type, count(DISTINCT library) AS lib_count, string_agg(DISTINCT library, ',' ORDER BY library) AS libraries FROM hit GROUP BY 1, 2 HAVING count(DISTINCT library) > 1",
        "hit_offset_variance": f"{w} SELECT off // 65536 AS off, round(var_samp(confidence), 6) AS confidence_variance, count(*) AS hits FROM hit WHERE {valid} GROUP BY 1",
        "hit_summary": f"{w} SELECT count(*) AS total_hits, count(DISTINCT off) AS unique_offsets, count(DISTINCT library) AS unique_libraries, count(DISTINCT secret_type) AS unique_types FROM hit",
        "hit_presence": f"{w}, s AS (SELECT DISTINCT library, secret_type FROM hit WHERE library IS NOT NULL AND secret_type IS NOT NULL) " + presence.format(r="library", c="secret_type"),
        "phase_presence": f"{w}, s AS (SELECT DISTINCT f.secret_type, regexp_extract(d.file_path, '([a-z_]+)\\.[a-z]+$', 1) AS phase FROM fnd f JOIN rn USING (run_id) JOIN dmp d ON d.dump_id = rn.dump_id WHERE f.secret_type IS NOT NULL) " + presence.format(r="secret_type", c="phase"),
        "hit_rollup": f"{w} SELECT library, secret_type, CAST(grouping_id(library, secret_type) AS BIGINT) AS level, count(*) AS hits FROM hit GROUP BY ROLLUP (library, secret_type)",
        "detection_metrics": f"""{w}, x AS (SELECT library, coalesce(confidence BETWEEN 0.75 AND 1 AND NOT isnan(confidence), false) AS f, coalesce(secret_type = 'exact_match', false) AS t FROM hit WHERE library IS NOT NULL),
c AS (SELECT library, count(*) FILTER (WHERE f AND t) AS tp, count(*) FILTER (WHERE f AND NOT t) AS fp, count(*) FILTER (WHERE NOT f AND t) AS fn FROM x GROUP BY 1),
p AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM c)
SELECT library, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM p""",
        "confidence_rollup": f"{w} SELECT run_id, round(max(confidence), 4) AS best, count(*) AS matches, round(least(count(*) / 10, 1.0), 4)::DOUBLE AS by_count, round(least(max(confidence) + least(count(*) / 20, 0.3), 1.0), 4)::DOUBLE AS overall FROM fnd WHERE {valid} GROUP BY 1",
        "findings_by_type": f"{w} SELECT run_id, secret_type, count(*) AS n FROM fnd GROUP BY 1, 2",
        "findings_timeline": f"{w} SELECT run_id, finding_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY micros NULLS LAST, finding_id) AS INTEGER) AS position FROM fnd WHERE run_id IS NOT NULL",
        "run_view": f"{w} SELECT run_id, project_id, dump_id, status, finished FROM rn",
        "completed_runs": f"{w} SELECT run_id, project_id FROM rn WHERE status = 'completed'",
        "project_timeline": f'{w} SELECT project_id, status, count(*) AS runs, min(started) AS "first", max(started) AS "last" FROM rn GROUP BY 1, 2',
        "run_metadata": f"{w} SELECT count(DISTINCT library) AS libraries, count(*) AS dumps, CAST(sum(file_size) AS BIGINT) AS bytes, (SELECT count(*) FROM (SELECT DISTINCT secret_type, value FROM fnd WHERE secret_type IS NOT NULL AND value IS NOT NULL)) AS secrets FROM dmp",
        "secrets": f"{w} SELECT DISTINCT secret_type, value, CASE upper(secret_type) {_LABELS} ELSE upper(secret_type) END AS label FROM fnd WHERE value IS NOT NULL AND secret_type IS NOT NULL",
        "hits_in_regions": f"{w} SELECT f.run_id, f.finding_id, e.entry_id FROM fnd f JOIN ent e ON e.run_id = f.run_id AND f.off >= e.off - 65536 AND f.off < e.off + e.length + 65536",
        "overlapping_regions": f"{w} SELECT run_id, finding_id FROM fnd f WHERE length > 0 AND EXISTS (SELECT 1 FROM ent e WHERE e.run_id = f.run_id AND f.off < e.off + e.length + 4096 AND e.off - 4096 < f.off + f.length)",
        "owner_lookup": f"""{w} SELECT f.finding_id, arg_max(e.entry_id, (e.off, e.entry_id)) FILTER (WHERE f.off < e.off + 1048576) AS entry_id, max(e.off) FILTER (WHERE f.off < e.off + 1048576) AS owner_base
FROM fnd f LEFT JOIN ent e ON e.run_id = f.run_id AND e.off <= f.off WHERE f.run_id IS NOT NULL AND f.off IS NOT NULL GROUP BY 1""",
        "view_offsets": f"{w} SELECT run_id, entry_id, CAST(sum(length) OVER (PARTITION BY run_id ORDER BY off, entry_id) - length AS BIGINT) AS view_off FROM ent",
        "common_types": f"{w} SELECT secret_type FROM hit WHERE library IS NOT NULL AND secret_type IS NOT NULL GROUP BY 1 HAVING count(DISTINCT library) = (SELECT count(DISTINCT library) FROM hit WHERE secret_type IS NOT NULL)",
        "unresolved_dumps": f"{w} SELECT run_id, rn.dump_id, file_path FROM rn LEFT JOIN dmp USING (dump_id) WHERE rn.dump_id IS NOT NULL",
        "aes_check": f"{w} SELECT true AS own, false AS other, count(DISTINCT value) AS keys FROM fnd WHERE length(value) = 64",
        "event_replay": f"""WITH m AS (SELECT DISTINCT {_id('task_id')} AS task_id, seq, coalesce(lower(trim(type)), chr(0)) AS type FROM nsweep_events WHERE {_id('task_id')} IS NOT NULL AND seq IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY seq DESC, type DESC) AS n FROM m)
SELECT task_id, count(*) AS messages, count(*) FILTER (WHERE n <= 512) AS kept, count(*) FILTER (WHERE n <= 512 AND seq > 10) AS replayed FROM r GROUP BY 1""",
        "idle_tasks": f"""SELECT {_id('task_id')} AS task_id, max(epoch_us(received_at)) AS last_at FROM nsweep_events WHERE {_id('task_id')} IS NOT NULL GROUP BY 1 HAVING max(epoch_us(received_at)) < (SELECT max(epoch_us(received_at)) FROM nsweep_events WHERE {_id('task_id')} IS NOT NULL) - 90 * 86400000000""",
        "survivors_by_stage": "SELECT lower(trim(type)) AS kind, stage, count(*) AS events, round(avg(pct) FILTER (WHERE pct >= 0), 6) AS mean_pct FROM nsweep_events GROUP BY 1, 2",
        "downsample": f"{w} SELECT run_id, entry_id FROM ent QUALIFY (row_number() OVER (PARTITION BY run_id ORDER BY off, entry_id) - 1) % 16 = 0",
    }
