"""Queries on the catalog of dumps and on containers made of it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytefold.functions.formats import MAGICS, parse_hex_pattern, suggest_formats
from bytefold.functions.normalize import norm_id
from bytefold.operators.intervals import point_join
from bytefold.operators.nested import read_json
from bytefold.queries.findings import dumps
from bytefold.queries.images import texts
from bytefold.session import table
from bytefold.sources import catalog as K
from bytefold.sources import container as M
from bytefold.sources.codec import ContainerWriter


def _files(spark: SparkSession, d: str) -> DataFrame:
    """Dumps as files of a tree: the stamp of a dump before its name, its run folder above it."""
    rows = dumps(spark, d).filter("file_path is not null and added is not null")
    epoch = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"))  # no session time zone takes part
    stamp = F.date_format(epoch + F.make_dt_interval(secs=F.floor(F.col("added") / 1_000_000)), "yyyyMMdd_HHmmss")
    base = K.base_name(F.col("file_path"))
    folder = F.concat_ws("_run_", "library", F.concat(F.lit("1_"), F.col("run_number").cast("string")))
    path = F.concat_ws("/", F.lit("/data"), "library", folder, F.concat(stamp, F.lit("_"), (F.col("added") % 1_000_000).cast("string"), F.lit("_"), base))
    return rows.filter("library is not null").select("dump_id", "file_type", "file_size", path.alias("path"))


def dump_files(spark: SparkSession, d: str) -> DataFrame:
    """Phase, kind, library and run of every dump from its path."""
    rows = K.parse_runs(K.parse_dumps(_files(spark, d)))
    return rows.select("dump_id", "timestamp", "phase_prefix", "phase_name", "kind", "library", "version", "run_number")


def canonical_phases(spark: SparkSession, d: str) -> DataFrame:
    """Canonical phase of every dump by order of time in its run."""
    rows = K.parse_runs(K.parse_dumps(_files(spark, d))).filter("phase_prefix <> 'full'")
    return K.normalize_phases(rows, ["library", "run_number"]).select("dump_id", "canonical_phase")


def first_of_phase(spark: SparkSession, d: str) -> DataFrame:
    """The first dump of each run after the handshake."""
    rows = K.parse_runs(K.parse_dumps(_files(spark, d)))
    return K.dump_for_phase(rows, ["library", "run_number"], "post_handshake").select("library", "run_number", "dump_id")


def dataset_summary(spark: SparkSession, d: str) -> DataFrame:
    """Runs, dumps and the phases of the first run per library."""
    return K.dataset_summary(K.parse_runs(K.parse_dumps(_files(spark, d))))


def folder_listing(spark: SparkSession, d: str) -> DataFrame:
    """The first page of every directory: folders first, then files by name."""
    files = _files(spark, d).select(F.regexp_extract("path", "^(.*)/[^/]+$", 1).alias("directory"), K.base_name(F.col("path")).alias("name"), F.lit(False).alias("is_dir"))
    parent = F.regexp_extract("path", "^(.*)/[^/]+/[^/]+$", 1)
    folders = _files(spark, d).select(parent.alias("directory"), F.element_at(F.split("path", "/"), -2).alias("name"), F.lit(True).alias("is_dir"))
    return K.browse(folders.unionByName(files), 20)


def known_runs(spark: SparkSession, d: str) -> DataFrame:
    """The first two runs of each library."""
    return K.discover_runs(K.parse_runs(K.parse_dumps(_files(spark, d))), 2).select("library", "run_number", "dumps")


def format_suggestions(spark: SparkSession, d: str) -> DataFrame:
    """How often the found values and the containers suggest each format."""
    v = table(spark, d, "findings").select(parse_hex_pattern(F.col("value_hex")).alias("b")).filter("b is not null")
    v = v.unionByName(_containers(spark, d).select(F.substring("data", 1, 64).alias("b")))
    return v.select(F.explode(suggest_formats(F.col("b"))).alias("s")).groupBy("s.format", "s.reason").agg(F.count(F.lit(1)).alias("n"))


def text_digests(spark: SparkSession, d: str) -> DataFrame:
    """Size and SHA-256 of every text as an artifact."""
    rows = texts(spark, d).filter("data is not null").select(F.col("dump_id").alias("path"), F.col("data").alias("content"))
    return K.artifacts(rows)


def address_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Ground-truth addresses as offsets into the region that holds them."""
    rows = table(spark, d, "gt_runs").select("gt_id", F.posexplode("dumps").alias("pos", "x")).select("gt_id", "pos", F.col("x.va_info.va").alias("va"), F.col("x.va_info.extra.region_start_va").alias("start"), F.col("x.va_info.extra.region_end_va").alias("end"))
    points = rows.filter("va is not null").select("gt_id", "pos", "va")
    spans = rows.filter("start < end").select("gt_id", "pos", "start", "end")
    return point_join(points, spans, ["gt_id", "pos"], "va", ("start", "end")).select("gt_id", "pos", (F.col("va") - F.col("r_start")).alias("inside"))


def capture_formats(spark: SparkSession, d: str) -> DataFrame:
    """Captures, bytes, hits and string-scan time per format of the ground truth."""
    x = table(spark, d, "gt_runs").select(F.explode("dumps").alias("x")).filter("x is not null")
    return x.groupBy(F.col("x.format").alias("format")).agg(F.count(F.lit(1)).alias("captures"), F.sum("x.size_bytes").alias("bytes"), F.sum(F.coalesce(F.size("x.hits_raw"), F.lit(0))).alias("hits"), F.round(F.sum("x.strings_bench.wall_seconds"), 6).alias("seconds"))


def _containers(spark: SparkSession, d: str) -> DataFrame:
    """A container for each dump whose metadata is an object: its modules, a page per region, key hints."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = lambda v: [x for x in (v if isinstance(v, list) else [v]) if isinstance(x, dict)] if v is not None else []
        number = lambda v: int(v, 0) if isinstance(v, str) else int(v or 0)
        for b in batches:
            ids, out = [], []
            for dump, text in zip(b.column("dump_id").to_pylist(), b.column("metadata_json").to_pylist()):
                try:
                    meta = read_json(text or "")
                except (ValueError, RecursionError):
                    continue
                if not isinstance(meta, dict):
                    continue
                w = ContainerWriter(algorithm=1, dump_uuid=dump.encode()[:16].ljust(16, b"0"), compression=len(dump) % 2)
                w.add_record(0x0040, {"ppid": 1, "exe": str((meta.get("tool") or {}).get("name", "")) if isinstance(meta.get("tool") or {}, dict) else ""})
                for m in listed(meta.get("modules")):
                    w.add_record(0x0002, {"base": number(m.get("base")), "size": 4096, "path": str(m.get("path") or "")})
                for n, r in enumerate(listed(meta.get("regions"))):
                    page = bytes((n + i) % 256 for i in range(1024))
                    region = w.add_region({"base": number(r.get("base")), "size": 3072, "prot": 1, "region_type": 5, "page_log2": 10}, [0, 1, 0], page * 2)
                    for h in listed(r.get("key_hints")):
                        w.add_record(0x0020, {"region_uuid": region, "offset": number(h.get("offset")) % 900, "key_length": 32, "key_type": 3, "protocol": 2, "note": str(h.get("kind") or "")})
                ids.append(dump)
                out.append(w.to_bytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(out, pa.binary())], names=["dump_id", "data"])

    rows = table(spark, d, "dumps").select(norm_id("dump_id").alias("dump_id"), "metadata_json").filter("dump_id is not null").groupBy("dump_id").agg(F.max("metadata_json").alias("metadata_json"))
    return rows.mapInArrow(build, "dump_id string, data binary")


def container_modules(spark: SparkSession, d: str) -> DataFrame:
    """Modules read back from containers."""
    return M.records(M.blocks(_containers(spark, d)), 0x0002).select("dump_id", F.col("base").cast("bigint").alias("base"), "path")


def container_regions(spark: SparkSession, d: str) -> DataFrame:
    """Regions read back from containers with the pages captured."""
    r = M.regions(M.blocks(_containers(spark, d)))
    pages = F.aggregate(F.filter("intervals", lambda i: i["state"] == "CAPTURED"), F.lit(0).cast("bigint"), lambda a, i: a + i["pages"])
    return r.select("dump_id", F.col("base").cast("bigint").alias("base"), pages.alias("captured_pages"))


def container_hints(spark: SparkSession, d: str) -> DataFrame:
    """Key hints read back from containers, per kind."""
    return M.records(M.blocks(_containers(spark, d)), 0x0020).groupBy("note").agg(F.count(F.lit(1)).alias("hints"))


def container_secrets(spark: SparkSession, d: str) -> DataFrame:
    """Bytes that key hints point at, one row per (dump, type, value)."""
    return M.secrets(M.blocks(_containers(spark, d))).select("dump_id", "secret_type", "protocol", F.lower(F.hex("secret_value")).alias("value"))


def container_chain(spark: SparkSession, d: str) -> DataFrame:
    """Chain check of every container."""
    return M.chain_breaks(M.blocks(_containers(spark, d))).groupBy("valid").agg(F.count(F.lit(1)).alias("containers"))


def container_report(spark: SparkSession, d: str) -> DataFrame:
    """Session report of every container."""
    return M.session_report(M.blocks(_containers(spark, d))).select("dump_id", F.col("regions").cast("bigint").alias("regions"), F.col("modules").cast("bigint").alias("modules"), F.col("key_hints").cast("bigint").alias("key_hints"), "captured_pages")


def container_keys(spark: SparkSession, d: str) -> DataFrame:
    """Load-independent keys of regions and how many dumps share each."""
    b = M.blocks(_containers(spark, d))
    return M.region_keys(M.regions(b), M.records(b, 0x0002)).groupBy("region_key").agg(F.count_distinct("dump_id").alias("dumps"))


def container_strings(spark: SparkSession, d: str) -> DataFrame:
    return M.strings(M.blocks(_containers(spark, d))).groupBy("origin").agg(F.count(F.lit(1)).alias("strings"))


_QUERIES = (
    dump_files, canonical_phases, first_of_phase, dataset_summary, folder_listing, known_runs, format_suggestions, text_digests, address_lookup, capture_formats, container_modules, container_regions,
    container_hints, container_secrets, container_chain, container_report, container_keys, container_strings,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def _id(c: str) -> str:
    return f"nullif(replace(lower(trim({c})), '-', ''), '')"


def oracle_sql() -> dict[str, str]:
    from bytefold.queries.findings import _us

    tree = f"""
dmp AS (SELECT {_id('dump_id')} AS dump_id, any_value(file_path) AS fp, min({_us('added_at')}) AS us FROM dumps GROUP BY 1),
fil AS (SELECT dump_id, regexp_extract(fp, '^/data/([^/]+)/run_([0-9]+)/', 1) AS library, CAST(nullif(regexp_extract(fp, '^/data/([^/]+)/run_([0-9]+)/', 2), '') AS INTEGER) AS run_number,
    concat(strftime(make_timestamp(us // 1000000 * 1000000), '%Y%m%d_%H%M%S'), '_', us % 1000000) AS stamp, regexp_extract(fp, '[^/]+$') AS base FROM dmp WHERE fp IS NOT NULL AND us IS NOT NULL AND regexp_matches(fp, '^/data/([^/]+)/run_([0-9]+)/')),
par AS (SELECT *, regexp_extract(base, '^(pre|post)_(.+)\\.(dump|msl)$', 1) AS pp, regexp_extract(base, '^(pre|post)_(.+)\\.(dump|msl)$', 2) AS pn, regexp_extract(base, '^(pre|post)_(.+)\\.(dump|msl)$', 3) AS ext,
    CASE WHEN ends_with(lower(base), '.msl') THEN 'msl' WHEN ends_with(lower(base), 'gdb_raw.bin') THEN 'gdb_raw' WHEN ends_with(lower(base), 'lldb_raw.bin') THEN 'lldb_raw' WHEN ends_with(lower(base), '.core') THEN 'gcore' ELSE 'raw' END AS nk FROM fil),
dfi AS (SELECT dump_id, library, run_number, CASE WHEN pp <> '' THEN stamp ELSE '' END AS timestamp, CASE WHEN pp <> '' THEN pp ELSE 'full' END AS phase_prefix, CASE WHEN pp <> '' THEN pn ELSE nk END AS phase_name,
    CASE WHEN pp <> '' THEN CASE WHEN ext = 'msl' THEN 'msl' ELSE 'raw' END ELSE nk END AS kind, concat('/data/', library, '/', library, '_run_1_', run_number, '/', stamp, '_', base) AS path, stamp, base FROM par WHERE pp <> '' OR nk <> 'raw')"""
    meta = f"""
src AS (SELECT {_id('dump_id')} AS dump_id, TRY_CAST(max(metadata_json) AS JSON) AS j FROM dumps WHERE metadata_json <> '' GROUP BY 1),
obj AS (SELECT dump_id, CASE WHEN json_type(j) = 'VARCHAR' THEN TRY_CAST(j ->> '$' AS JSON) ELSE j END AS j FROM src)"""
    els = lambda p: f"CASE json_type(j -> '{p}') WHEN 'ARRAY' THEN CAST(j -> '{p}' AS JSON[]) WHEN 'OBJECT' THEN [j -> '{p}'] ELSE [] END"
    return {
        "dump_files": f"WITH {tree} SELECT dump_id, timestamp, phase_prefix, phase_name, kind, library, '1' AS version, run_number FROM dfi",
        "canonical_phases": f"""WITH {tree}, p AS (SELECT library, run_number, phase_name, min(timestamp) AS f, CASE WHEN phase_name IN ('server_key_update', 'client_key_update') THEN 'key_update' WHEN phase_name = 'cleanup' THEN 'cleanup' END AS o FROM dfi WHERE phase_prefix <> 'full' GROUP BY 1, 2, 3),
k AS (SELECT *, row_number() OVER (PARTITION BY library, run_number, o IS NULL ORDER BY f, phase_name) AS k FROM p)
SELECT dump_id, concat(phase_prefix, '_', coalesce(o, CASE k WHEN 1 THEN 'handshake_end' WHEN 2 THEN 'second_event' ELSE concat('event_', k) END)) AS canonical_phase FROM dfi JOIN k USING (library, run_number, phase_name) WHERE phase_prefix <> 'full'""",
        "first_of_phase": f"WITH {tree} SELECT library, run_number, dump_id FROM dfi WHERE phase_prefix = 'post' AND phase_name = 'handshake' QUALIFY row_number() OVER (PARTITION BY library, run_number ORDER BY timestamp, path) = 1",
        "dataset_summary": f"WITH {tree}, m AS (SELECT library, min(run_number) AS f FROM dfi GROUP BY 1) SELECT library, count(DISTINCT run_number) AS runs, count(*) AS dumps, string_agg(DISTINCT CASE WHEN run_number = f THEN concat(phase_prefix, '_', phase_name) END, ',' ORDER BY CASE WHEN run_number = f THEN concat(phase_prefix, '_', phase_name) END) AS phases FROM dfi JOIN m USING (library) GROUP BY 1",
        "folder_listing": f"""WITH {tree}, e AS (SELECT concat('/data/', library, '/', library, '_run_1_', run_number) AS directory, concat(stamp, '_', base) AS name, false AS is_dir FROM fil UNION SELECT concat('/data/', library), concat(library, '_run_1_', run_number), true FROM fil)
SELECT *, CAST(row_number() OVER (PARTITION BY directory ORDER BY is_dir DESC, lower(name), name) - 1 AS INTEGER) AS position, count(*) OVER (PARTITION BY directory) AS total FROM e QUALIFY position < 20""",
        "known_runs": f"WITH {tree}, r AS (SELECT library, run_number, count(*) AS dumps FROM dfi GROUP BY 1, 2) SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY library ORDER BY run_number) <= 2",
        "format_suggestions": f"""WITH {meta}, x AS (SELECT CASE WHEN length(h) % 2 = 1 THEN '0' || h ELSE h END AS h FROM (SELECT upper(replace(value_hex, ' ', '')) AS h FROM findings) WHERE regexp_full_match(h, '[0-9A-F]*')),
m AS (SELECT unnest({list(MAGICS)}) AS format, unnest({list(MAGICS.values())}) AS magic)
SELECT format, 'magic at 0x0' AS reason, count(*) AS n FROM x JOIN m ON starts_with(h, magic) GROUP BY 1
UNION ALL SELECT CASE substr(h, 9, 2) WHEN '02' THEN 'elf64' WHEN '01' THEN 'elf32' ELSE 'elf' END, 'magic at 0x0', count(*) FROM x WHERE starts_with(h, '7F454C46') GROUP BY 1
UNION ALL SELECT CASE WHEN CAST(concat('0x', substr(h, 9, 8)) AS BIGINT) <= 30 THEN 'macho_fat' ELSE 'java_class' END, 'magic at 0x0', count(*) FROM x WHERE starts_with(h, 'CAFEBABE') AND length(h) >= 16 GROUP BY 1
UNION ALL SELECT 'msl', 'magic at 0x0', count(*) FROM obj WHERE json_type(j) = 'OBJECT'""",
        "text_digests": "SELECT doc_id AS path, CAST(octet_length(encode(text)) AS INTEGER) AS size, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL",
        "address_lookup": "WITH x AS (SELECT gt_id, CAST(i - 1 AS INTEGER) AS pos, dumps[i].va_info.va AS va, dumps[i].va_info.extra.region_start_va AS s, dumps[i].va_info.extra.region_end_va AS e FROM (SELECT *, unnest(generate_series(1, len(dumps))) AS i FROM gt_runs)) SELECT gt_id, pos, va - s AS inside FROM x WHERE va >= s AND va < e",
        "capture_formats": "SELECT x.format AS format, count(*) AS captures, CAST(sum(x.size_bytes) AS BIGINT) AS bytes, CAST(sum(coalesce(len(x.hits_raw), 0)) AS BIGINT) AS hits, round(sum(x.strings_bench.wall_seconds), 6) AS seconds FROM (SELECT unnest(dumps) AS x FROM gt_runs) WHERE x IS NOT NULL GROUP BY 1",
        "container_modules": f"WITH {meta}, m AS (SELECT dump_id, unnest({els('$.modules')}) AS x FROM obj WHERE json_type(j) = 'OBJECT') SELECT dump_id, CAST(coalesce(x ->> '$.base', '0') AS BIGINT) AS base, coalesce(x ->> '$.path', '') AS path FROM m WHERE json_type(x) = 'OBJECT'",
        "container_regions": f"WITH {meta}, m AS (SELECT dump_id, unnest({els('$.regions')}) AS x FROM obj WHERE json_type(j) = 'OBJECT') SELECT dump_id, CAST(coalesce(x ->> '$.base', '0') AS BIGINT) AS base, CAST(2 AS BIGINT) AS captured_pages FROM m WHERE json_type(x) = 'OBJECT'",
        "container_hints": f"WITH {meta}, m AS (SELECT dump_id, unnest({els('$.regions')}) AS j FROM obj WHERE json_type(j) = 'OBJECT'), h AS (SELECT unnest({els('$.key_hints')}) AS x FROM m) SELECT coalesce(x ->> '$.kind', '') AS note, count(*) AS hints FROM h WHERE json_type(x) = 'OBJECT' GROUP BY 1",
        "container_report": f"""WITH {meta}, o AS (SELECT dump_id, {els('$.regions')} AS r, {els('$.modules')} AS m FROM obj WHERE json_type(j) = 'OBJECT'),
x AS (SELECT dump_id, unnest(r) AS j FROM o), h AS (SELECT dump_id, list_filter({els('$.key_hints')}, lambda e: json_type(e) = 'OBJECT') AS h FROM x WHERE json_type(j) = 'OBJECT'),
n AS (SELECT dump_id, count(*) AS regions, CAST(sum(len(h)) AS BIGINT) AS hints FROM h GROUP BY 1)
SELECT o.dump_id, coalesce(n.regions, 0) AS regions, len(list_filter(m, lambda e: json_type(e) = 'OBJECT')) AS modules, coalesce(n.hints, 0) AS key_hints, 2 * coalesce(n.regions, 0) AS captured_pages FROM o LEFT JOIN n USING (dump_id)""",
        "container_secrets": f"""WITH {meta}, r AS (SELECT dump_id, list_filter({els('$.regions')}, lambda e: json_type(e) = 'OBJECT') AS r FROM obj WHERE json_type(j) = 'OBJECT'),
m AS (SELECT dump_id, unnest(r) AS j, generate_subscripts(r, 1) - 1 AS n FROM r),
h AS (SELECT dump_id, n, unnest({els('$.key_hints')}) AS x FROM m),
o AS (SELECT DISTINCT dump_id, n, CAST(coalesce(trim(x ->> '$.offset'), '0') AS BIGINT) % 900 AS o FROM h WHERE json_type(x) = 'OBJECT')
SELECT DISTINCT dump_id, 'SESSION_KEY' AS secret_type, 'TLS' AS protocol, string_agg(format('{{:02x}}', CAST((n + o + i) % 256 AS INTEGER)), '' ORDER BY i) AS value FROM o, (SELECT unnest(generate_series(0, 31)) AS i) GROUP BY dump_id, n, o""",
        "container_keys": f"""WITH {meta}, r AS (SELECT dump_id, len(list_filter({els('$.regions')}, lambda e: json_type(e) = 'OBJECT')) AS n FROM obj WHERE json_type(j) = 'OBJECT')
SELECT concat('anon:ANONYMOUS:0xc00:', k) AS region_key, count(*) AS dumps FROM (SELECT dump_id, unnest(generate_series(0, n - 1)) AS k FROM r) GROUP BY 1""",
        "container_strings": f"""WITH {meta}, o AS (SELECT dump_id, j, list_filter({els('$.regions')}, lambda e: json_type(e) = 'OBJECT') AS r, list_filter({els('$.modules')}, lambda e: json_type(e) = 'OBJECT') AS m FROM obj WHERE json_type(j) = 'OBJECT'),
g AS (SELECT dump_id, unnest(r) AS x, generate_subscripts(r, 1) - 1 AS n FROM o),
b AS (SELECT dump_id, n, page, i, (n + i) % 256 AS v FROM g, (SELECT unnest(generate_series(0, 1023)) AS i), (SELECT unnest([0, 2]) AS page)),
s AS (SELECT dump_id, n, page, count(*) AS c FROM (SELECT *, i - row_number() OVER (PARTITION BY dump_id, n, page ORDER BY i) AS k FROM b WHERE v BETWEEN 32 AND 126 OR v IN (9, 10, 13)) GROUP BY dump_id, n, page, k HAVING count(*) >= 4)
SELECT 'region' AS origin, count(*) AS strings FROM s UNION ALL SELECT 'module', count(*) FROM (SELECT unnest(m) AS x FROM o) WHERE length(x ->> '$.path') >= 4
UNION ALL SELECT 'process', count(*) FROM o WHERE json_type(j -> '$.tool') = 'OBJECT' AND length(j ->> '$.tool.name') >= 4""",
        "container_chain": f"WITH {meta} SELECT true AS valid, count(*) AS containers FROM obj WHERE json_type(j) = 'OBJECT'",
    }
