"""Directory trees as a catalog: dumps, runs, phases, key logs, sidecars, metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Names of dumps and run folders.
_PHASED = r"^(\d{8}_\d{6}_\d+)_(pre|post)_(.+)\.(dump|msl)$"
_RUN = r"^(.+?)_run_(\d+)_(\d+)$"

# Secret types a key log template allows.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "TLS 1.2": ("CLIENT_RANDOM",),
    "TLS 1.3": ("CLIENT_HANDSHAKE_TRAFFIC_SECRET", "SERVER_HANDSHAKE_TRAFFIC_SECRET", "CLIENT_TRAFFIC_SECRET_0", "SERVER_TRAFFIC_SECRET_0", "EXPORTER_SECRET"),
    "SSH 2": ("SSH2_SESSION_KEY", "SSH2_SESSION_ID", "SSH2_ENCRYPTION_KEY_CS", "SSH2_ENCRYPTION_KEY_SC"),
    "AES-256": ("AES256_KEY",),
}
TEMPLATES["Auto-detect"] = tuple(dict.fromkeys(t for types in TEMPLATES.values() for t in types))

# Short labels of secret types.
SHORT_LABELS = {"CLIENT_RANDOM": "Master Secret", "CLIENT_HANDSHAKE_TRAFFIC_SECRET": "Client HTS", "SERVER_HANDSHAKE_TRAFFIC_SECRET": "Server HTS", "CLIENT_TRAFFIC_SECRET_0": "Client TS0", "SERVER_TRAFFIC_SECRET_0": "Server TS0", "EXPORTER_SECRET": "Exporter", "SSH2_SESSION_KEY": "Session Key", "SSH2_SESSION_ID": "Session ID", "SSH2_ENCRYPTION_KEY_CS": "Enc C→S", "SSH2_ENCRYPTION_KEY_SC": "Enc S→C", "AES256_KEY": "AES-256 Key"}


def label(secret_type: Column) -> Column:
    """Short label of a secret type; itself if it has none."""
    return F.coalesce(F.create_map(*(F.lit(x) for kv in SHORT_LABELS.items() for x in kv))[secret_type], secret_type)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dump_kind(path: Column) -> Column:
    """Kind of a dump by its file name."""
    n = F.lower(base_name(path))
    return F.when(n.endswith(".msl"), "msl").when(n.endswith("gdb_raw.bin"), "gdb_raw").when(n.endswith("lldb_raw.bin"), "lldb_raw").when(n.endswith(".core"), "gcore").otherwise("raw")


def parse_dumps(files: DataFrame, path: str = "path") -> DataFrame:
    """Dump files with timestamp, phase prefix and name, kind; other files are dropped.

    A name without a phase is a dump only if its ending says which tool wrote it.
    """
    name = base_name(F.col(path))
    part = lambda i: F.regexp_extract(name, _PHASED, i)
    phased, kind = name.rlike(_PHASED), dump_kind(F.col(path))
    rows = files.filter(phased | (kind != "raw"))
    return rows.select("*", F.when(phased, part(1)).otherwise("").alias("timestamp"), F.when(phased, part(2)).otherwise("full").alias("phase_prefix"), F.when(phased, part(3)).otherwise(kind).alias("phase_name"), F.when(phased, F.when(part(4) == "msl", "msl").otherwise("raw")).otherwise(kind).alias("kind"))


def parse_runs(files: DataFrame, path: str = "path") -> DataFrame:
    """Library, version and number of the run folder a file lies in; null if it is none."""
    folder = F.element_at(F.split(F.col(path), "/"), -2)
    part = lambda i: F.nullif(F.regexp_extract(folder, _RUN, i), F.lit(""))
    return files.select("*", part(1).alias("library"), part(2).alias("version"), part(3).cast("int").alias("run_number"))


# Phases with a role of their own, and roles of the others in order of time.
_OWN_ROLE = {"server_key_update": "key_update", "client_key_update": "key_update", "cleanup": "cleanup"}
_ROLES = ("handshake_end", "second_event")


def normalize_phases(dumps: DataFrame, run: list[str]) -> DataFrame:
    """Canonical phase of each dump, by order of time and not by name.

    Phases of a run are taken in the order of their first dump; those without an own role are
    ``handshake_end``, ``second_event``, then ``event_k``.
    """
    own = F.create_map(*(F.lit(x) for kv in _OWN_ROLE.items() for x in kv))[F.col("phase_name")]
    phases = dumps.groupBy(*run, "phase_name").agg(F.min("timestamp").alias("_first")).withColumn("_own", own)
    k = F.row_number().over(Window.partitionBy(*run, F.col("_own").isNull()).orderBy("_first", "phase_name"))
    role = F.coalesce(F.col("_own"), F.when(k <= len(_ROLES), F.element_at(F.array(*(F.lit(r) for r in _ROLES)), F.least(k, F.lit(len(_ROLES))))).otherwise(F.concat(F.lit("event_"), k.cast("string"))))
    named = phases.select(*(F.col(c).alias(f"_k_{c}") for c in [*run, "phase_name"]), role.alias("_role"))
    same = F.lit(True)
    for c in [*run, "phase_name"]:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return dumps.join(named, same).select(*dumps.columns, F.concat_ws("_", "phase_prefix", "_role").alias("canonical_phase"))


def dump_for_phase(dumps: DataFrame, run: list[str], phase: str, order: str = "timestamp") -> DataFrame:
    """The first dump of each run at a phase, by its own or its canonical name."""
    full = F.concat_ws("_", "phase_prefix", "phase_name")
    canonical = F.col("canonical_phase") if "canonical_phase" in dumps.columns else F.lit(None)
    n = F.row_number().over(Window.partitionBy(*run).orderBy(F.when(full == phase, 0).otherwise(1), order, "path"))
    return dumps.filter((full == phase) | (canonical == phase)).withColumn("_n", n).filter("_n = 1").drop("_n")


def parse_keylog(lines: DataFrame, template: str | None = None, column: str = "line") -> DataFrame:
    """Secrets of key log lines ``TYPE identifier secret`` (hex); malformed lines are dropped.

    ``lines`` may have further columns, which are kept and also separate equal secrets; of equal
    (type, value) the first identifier counts.
    """
    words = F.split(F.trim(column), r"\s+")
    keep = [c for c in lines.columns if c != column]
    rows = lines.filter(F.size(words) == 3).select(*keep, words[0].alias("secret_type"), F.try_to_binary(words[1], F.lit("hex")).alias("identifier"), F.try_to_binary(words[2], F.lit("hex")).alias("secret_value"))
    rows = rows.filter(F.col("identifier").isNotNull() & F.col("secret_value").isNotNull() & F.col("secret_type").isin(*TEMPLATES[template or "Auto-detect"]))
    return rows.groupBy(*keep, "secret_type", "secret_value").agg(F.min("identifier").alias("identifier"))


def read_keylogs(spark: SparkSession, paths: str) -> DataFrame:
    """Lines of key log files (a CSV with the column ``line``) with their path."""
    return spark.read.option("header", True).schema("line string").csv(paths).select("line", F.col("_metadata.file_path").alias("path"))


def parse_sidecars(files: DataFrame) -> DataFrame:
    """Sidecar files ``(path, content)`` as maps: JSON objects (scalars only) or ``k=v`` lines.

    Of a folder's sidecars the first JSON one counts, then the first ``.meta``; key logs and
    timings are none.
    """
    name, folder = base_name(F.col("path")), F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    rows = files.filter(name.rlike(r"\.(json|meta)$") & ~name.rlike("^(keylog|timing)") & (name != "meta.json")).withColumn("folder", folder)
    n = F.row_number().over(Window.partitionBy("folder").orderBy(F.when(name.endswith(".json"), 0).otherwise(1), "path"))
    rows = rows.withColumn("_n", n).filter("_n = 1")
    raw = F.from_json("content", "map<string,string>")
    scalars = F.map_filter(raw, lambda k, v: ~v.rlike(r"^\s*[\[{]"))
    lines = F.filter(F.transform(F.split("content", r"\r?\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#") & x.contains("="))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("k"), F.trim(F.substring(x, F.locate("=", x) + 1, F.length(x))).alias("v")))
    last = F.filter(pairs, lambda p: F.lit(True))
    meta = F.map_from_entries(F.transform(F.array_distinct(F.transform(last, lambda p: p["k"])), lambda k: F.struct(k.alias("k"), F.element_at(F.filter(last, lambda p: p["k"] == k), -1)["v"].alias("v"))))
    return rows.select("folder", "path", F.coalesce(F.when(name.endswith(".json"), scalars).otherwise(meta), F.create_map().cast("map<string,string>")).alias("fields"))


# Names of dump kinds in run metadata, and what they mean.
DUMP_KINDS = {"gcore": "gcore", "gdb_raw": "gdb_raw", "lldb_raw": "lldb_raw", "memslicer": "msl", "msl": "msl"}


def run_metadata(files: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """``meta.json`` files ``(path, content)``, one row per run: ``run_dir, run_id, cipher, password, master_key, aslr_base, pid, dumps``.

    Numbers may be decimal or ``0x`` hex, a key of odd length gets a leading zero, ``dumps`` maps
    the canonical kind to ``path, size``.  A relative path counts from the folder above the run if
    ``listing(path)`` has it there, else from the run itself.  Files that aren't JSON objects give
    no row.
    """
    text = F.col("content").cast("string")
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    rows = files.filter(base_name(F.col("path")) == "meta.json").select(folder.alias("run_dir"), text.alias("t"))
    rows = rows.filter(F.get_json_object("t", "$").startswith("{"))
    get = lambda name: F.get_json_object("t", f"$.{name}")
    key = F.regexp_replace(F.lower(F.coalesce(get("master_key_hex"), F.lit(""))), "^0x", "")
    kinds = F.create_map(*(F.lit(x) for kv in DUMP_KINDS.items() for x in kv))
    dumps = F.from_json(get("dumps"), "map<string, struct<path: string, size: string>>")
    out = rows.select("run_dir", F.coalesce(get("run_id"), base_name(F.col("run_dir"))).alias("run_id"), F.coalesce(get("cipher"), F.lit("")).alias("cipher"), F.coalesce(get("password"), F.lit("")).alias("password"), F.coalesce(padded_hex(key), F.lit(b"")).alias("master_key"), F.coalesce(flexible_int(get("aslr_base")), F.lit(0)).alias("aslr_base"), F.coalesce(flexible_int(get("pid")), F.lit(0)).alias("pid"), F.explode_outer(dumps).alias("kind", "dump"))
    root, path = F.regexp_extract("run_dir", r"^(.*)/[^/]*$", 1), F.coalesce(F.col("dump.path"), F.lit(""))
    out = out.withColumn("_above", F.concat_ws("/", root, path))
    if listing is not None:
        out = out.join(listing.select(F.col("path").alias("_above"), F.lit(True).alias("_there")).distinct(), "_above", "left")
    else:
        out = out.withColumn("_there", F.lit(False))
    resolved = F.when(path == "", F.col("run_dir")).when(path.startswith("/"), path).when(F.col("_there"), F.col("_above")).otherwise(F.concat_ws("/", "run_dir", base_name(path)))
    entry = F.struct(F.coalesce(kinds[F.col("kind")], F.col("kind")).alias("kind"), F.struct(resolved.alias("path"), F.coalesce(flexible_int(F.col("dump.size")), F.lit(0)).alias("size")).alias("dump"))
    keys = ["run_dir", "run_id", "cipher", "password", "master_key", "aslr_base", "pid"]
    grouped = out.groupBy(*keys).agg(F.collect_list(F.when(F.col("dump").isNotNull(), entry)).alias("_d"))
    once = F.transform(F.array_distinct(F.transform("_d", lambda x: x["kind"])), lambda k: F.struct(k.alias("key"), F.element_at(F.filter("_d", lambda x: x["kind"] == k), -1)["dump"].alias("value")))
    return grouped.select(*keys, F.map_from_entries(once).alias("dumps"))


def discover_runs(dumps: DataFrame, max_runs: int | None = None) -> DataFrame:
    """Runs of each library in order of their number, at most the first ``max_runs``: ``library, version, run_number, dumps``."""
    runs = dumps.groupBy("library", "version", "run_number").agg(F.count(F.lit(1)).alias("dumps"))
    if max_runs is None:
        return runs
    n = F.row_number().over(Window.partitionBy("library").orderBy("run_number", "version"))
    return runs.withColumn("_n", n).filter(F.col("_n") <= max_runs).drop("_n")


def scan_level(paths: DataFrame) -> DataFrame:
    """What a folder is, by the run folders below it: ``level`` of ``run, library, scenario, protocol, dataset, none``.

    ``paths(root, path)``: a listing below each root.  The number of folders between the root and
    the run folders tells the level.
    """
    below = F.split(F.expr("substring(path, length(root) + 2)"), "/")
    at = F.array_position(F.transform(below, lambda x: x.rlike(r"_run_[^_]+_\d+$|^run_\d+$")), F.lit(True))
    inside = F.when(F.element_at(F.split("root", "/"), -1).rlike(r"_run_[^_]+_\d+$|^run_\d+$"), F.lit(0)).otherwise(F.nullif(at, F.lit(0)))
    depth = paths.select("root", inside.alias("_d")).groupBy("root").agg(F.max("_d").alias("_d"))
    names = F.array(*(F.lit(x) for x in ("run", "library", "scenario", "protocol", "dataset")))
    return depth.select("root", F.when(F.col("_d").isNull(), "none").otherwise(F.get(names, F.least("_d", F.lit(4)).cast("int"))).alias("level"))


def dataset_summary(dumps: DataFrame) -> DataFrame:
    """Per library: versions, runs, dumps, and the phases of its first run."""
    first = F.min("run_number").over(Window.partitionBy("library"))
    rows = dumps.withColumn("_first", F.col("run_number") == first)
    full = F.concat_ws("_", "phase_prefix", "phase_name")
    return rows.groupBy("library").agg(F.count_distinct("version", "run_number").alias("runs"), F.count(F.lit(1)).alias("dumps"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("_first"), full))), ",").alias("phases"))


def browse(entries: DataFrame, limit: int = 500, page: int = 0) -> DataFrame:
    """One page of every directory's entries for display: folders first, then by name.

    ``entries(directory, name, is_dir, …)``; adds ``position`` from 0 within the directory and
    ``total``, its number of entries, so the next page is there to ask for.  An entry given twice
    is one.
    """
    once = entries.dropDuplicates(["directory", "name", "is_dir"])
    along = Window.partitionBy("directory").orderBy(F.desc("is_dir"), F.lower("name"), "name")
    placed = once.withColumn("position", F.row_number().over(along) - 1).withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("directory")))
    return placed.filter((F.col("position") >= page * limit) & (F.col("position") < (page + 1) * limit))


def flexible_int(text: Column) -> Column:
    """A number written in decimal or ``0x`` hex."""
    t = F.lower(F.trim(text))
    return F.when(t.rlike("^0x[0-9a-f]+$"), F.conv(F.substring(t, 3, 64), 16, 10).try_cast("bigint")).otherwise(t.try_cast("bigint"))


def padded_hex(text: Column) -> Column:
    """Bytes of a hex text; one of odd length gets a leading zero."""
    t = F.trim(text)
    return F.try_to_binary(F.when(F.length(t) % 2 == 1, F.concat(F.lit("0"), t)).otherwise(t), F.lit("hex"))


def artifacts(files: DataFrame) -> DataFrame:
    """Registered files ``(path, content)`` with size and SHA-256."""
    return files.select("path", F.octet_length("content").alias("size"), F.sha2("content", 256).alias("sha256"))
