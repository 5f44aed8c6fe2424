"""Relations over block containers, and what is joined from them.

``blocks`` walks each container once; every other relation is a filter on the block type, one
decoder and built-in operators.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bytefold.sources import codec

BLOCKS = "dump_id string, seq int, file_off bigint, type int, flags int, length bigint, payload_version int, uuid string, parent string, prev_hash string, hash string, appendix boolean, payload binary"
_HEADER = "dump_id string, error string, dump_uuid string, version int, flags bigint, cap_bitmap decimal(20,0), ts_ns decimal(20,0), os int, arch int, pid bigint, clock int, block_count bigint, hash_algo int, tag string"


def _row_batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    columns = list(zip(*rows)) if rows else [[] for _ in arrow]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)


def _flat(df: DataFrame, columns: list[str], fn: Callable[..., Iterator[tuple]], schema: str) -> DataFrame:
    """Rows that ``fn`` makes of each row's ``columns``."""
    parsed = T._parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [r for row in zip(*(b.column(c).to_pylist() for c in columns)) for r in fn(*row)]
            for at in range(0, len(out), 8192):
                yield _row_batch(out[at : at + 8192], parsed)

    return df.select(*columns).mapInArrow(run, schema)


def _images(files: DataFrame) -> DataFrame:
    return files.select(F.col("dump_id").cast("string").alias("dump_id"), F.col("data").cast("binary").alias("data"))


def headers(files: DataFrame) -> DataFrame:
    """File headers of ``files(dump_id, data)``; a file that is no container has its ``error``."""
    from decimal import Decimal

    def head(dump, data):
        try:
            h = codec.file_header(data or b"")
            yield (dump, None, h["dump_uuid"].hex(), h["version"], h["flags"], Decimal(h["cap_bitmap"]), Decimal(h["ts_ns"]), h["os"], h["arch"], h["pid"], h["clock"], h["block_count"], h["hash_algo"], codec.tag_status(data))
        except codec.FormatError as e:
            yield (dump, str(e), *[None] * 12)

    return _flat(_images(files), ["dump_id", "data"], head, _HEADER)


def read_errors(files: DataFrame) -> DataFrame:
    """What keeps a container from being read whole: ``dump_id, file_off, error``, a row per faulty file.

    No container, a sealed one (``open_sealed`` reads it), a block without its magic, one cut off
    by the file's end, or bytes behind the last block.  ``blocks`` gives what comes before.
    """

    def check(dump, data):
        data = data or b""
        try:
            head = codec.file_header(data[: codec.FILE_HEADER])
        except codec.FormatError as e:
            yield (dump, 0, str(e))
            return
        if head["flags"] & codec.ENCRYPTED:
            yield (dump, 0, "the container is sealed")
            return
        at = head["header_size"]
        while at < len(data):
            raw = data[at : at + codec.BLOCK_HEADER]
            if raw[:4] != codec.BLOCK_MAGIC or len(raw) < codec.BLOCK_HEADER:
                yield (dump, at, "no block begins here")
                return
            length = codec.read(codec.BLOCK_LAYOUT, raw)[0]["length"]
            if length < codec.BLOCK_HEADER or at + length > len(data):
                yield (dump, at, "the block reaches beyond the file")
                return
            at += length

    return _flat(_images(files), ["dump_id", "data"], check, "dump_id string, file_off bigint, error string")


def blocks(files: DataFrame) -> DataFrame:
    """All blocks of all containers in file order, up to the first fault; ``read_errors`` lists the faults."""

    def walk(dump, data):
        try:
            for n, b in enumerate(codec.iter_blocks(data or b"")):
                yield (dump, n, b["file_off"], b["type"], b["flags"], b["length"], b["payload_version"], b["uuid"].hex(), b["parent"].hex(), b["prev_hash"].hex(), b["hash"].hex(), b["appendix"], b["payload"])
        except codec.FormatError:
            return

    return _flat(_images(files), ["dump_id", "data"], walk, BLOCKS)


def merge_continuations(all_blocks: DataFrame) -> DataFrame:
    """Continuation payloads appended to their parent.

    A parent takes continuations only until the next block that is none, so the blocks of a file
    fall into stretches of one plain block and the continuations after it; one that names another
    parent stands for itself.
    """
    along = Window.partitionBy("dump_id").orderBy("seq")
    cont = F.col("flags").bitwiseAND(codec.CONTINUATION) != 0
    s = all_blocks.withColumn("_cont", cont).withColumn("_s", F.sum((~cont).cast("int")).over(along))
    head = Window.partitionBy("dump_id", "_s")
    lead = F.max(F.when(~F.col("_cont") & (F.col("flags").bitwiseAND(codec.HAS_CHILDREN) != 0), F.col("uuid"))).over(head)
    s = s.withColumn("_own", F.when(F.col("_cont") & (F.col("parent") == lead), -1).otherwise(F.col("seq"))).withColumn("_key", F.when(F.col("_own") == -1, F.min(F.when(~F.col("_cont"), F.col("seq"))).over(head)).otherwise(F.col("seq")))
    first = [c for c in all_blocks.columns if c not in ("dump_id", "payload")]
    parts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "payload"))), lambda x: x["payload"])
    merged = s.groupBy("dump_id", "_key").agg(F.min_by(F.struct(*first), "seq").alias("h"), parts.alias("p"))
    return merged.select("dump_id", "h.*", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x)).alias("payload")).select(*all_blocks.columns)


def _types(layout: list[tuple[str, str]]) -> list[tuple[str, str]]:
    kinds = {"u8": "int", "u16": "int", "u32": "bigint", "u64": "decimal(20,0)", "flag": "boolean", "rest": "binary", "tight": "string"}
    return [(n, kinds.get(k, "string")) for n, k in layout if n and not n.endswith("_len")]


def _value(v, kind: str):
    from decimal import Decimal

    if kind == "decimal(20,0)":
        return Decimal(v)
    return v.hex() if kind == "string" and isinstance(v, bytes) else v


def records(all_blocks: DataFrame, kind: int) -> DataFrame:
    """Decoded blocks of one type; raw ids and hashes come out as hex.  A block that can't be
    decoded is left out (``generic`` has it)."""
    table = kind in codec.TABLES
    layout = codec.TABLES[kind][2] if table else codec.LAYOUTS[kind][1]
    columns = _types(layout)

    def decode(dump, seq, uuid, payload):
        try:
            optional = ("uptime_ns", "osv_len")
            rows = codec.read_table(kind, payload) if table else [codec.read(layout, payload, 0, optional)[0]]
        except (codec.FormatError, IndexError, KeyError):
            return
        for n, r in enumerate(rows):
            yield (dump, seq, uuid, n, *(_value(r[c], t) for c, t in columns))

    schema = "dump_id string, seq int, block_uuid string, row_no int, " + ", ".join(f"`{n}` {t}" for n, t in columns)
    return _flat(all_blocks.filter(F.col("type") == kind), ["dump_id", "seq", "uuid", "payload"], decode, schema)


def connectivity(all_blocks: DataFrame) -> DataFrame:
    """Rows of the connectivity tables: the variant and its fields as a map."""

    def decode(dump, seq, payload):
        try:
            for n, r in enumerate(codec.read_connectivity(payload)):
                yield (dump, seq, n, r.pop("row_type"), {k: v.hex() if isinstance(v, bytes) else str(v) for k, v in r.items() if k})
        except (codec.FormatError, IndexError):
            return

    return _flat(all_blocks.filter(F.col("type") == 0x0055), ["dump_id", "seq", "payload"], decode, "dump_id string, seq int, row_no int, row_type string, fields map<string,string>")


def regions(all_blocks: DataFrame) -> DataFrame:
    """Memory regions with page intervals; metadata only, so alignment can plan without bytes."""
    from decimal import Decimal

    def decode(dump, seq, uuid, payload):
        try:
            r = codec.read_region(payload)
        except codec.FormatError:
            return
        yield (dump, seq, uuid, Decimal(r["base"]), r["size"], r["prot"], r["region_type"], 1 << r["page_log2"], Decimal(r["ts_ns"]), [{"start_page": a, "pages": n, "state": s} for a, n, s in r["intervals"]])

    return _flat(all_blocks.filter(F.col("type") == codec.REGION), ["dump_id", "seq", "uuid", "payload"], decode, "dump_id string, seq int, uuid string, base decimal(20,0), size bigint, prot int, region_type int, page_size bigint, ts_ns decimal(20,0), intervals array<struct<start_page:bigint,pages:bigint,state:string>>")


def captured(all_blocks: DataFrame) -> DataFrame:
    """Captured page runs with their bytes: ``dump_id, seq, uuid, base, page_size, start_page, va, data``."""
    from decimal import Decimal

    def decode(dump, seq, uuid, payload):
        try:
            r = codec.read_region(payload)
        except codec.FormatError:
            return
        page = 1 << r["page_log2"]
        for first, _, data in r["captured"]:
            yield (dump, seq, uuid, Decimal(r["base"]), page, first, Decimal(r["base"] + first * page), data)

    return _flat(all_blocks.filter(F.col("type") == codec.REGION), ["dump_id", "seq", "uuid", "payload"], decode, "dump_id string, seq int, uuid string, base decimal(20,0), page_size bigint, start_page bigint, va decimal(20,0), data binary")


def graph(all_blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the pointer graphs."""
    from decimal import Decimal

    body = all_blocks.filter(F.col("type") == codec.GRAPH)

    def nodes(dump, payload):
        for i, n in enumerate(codec.read_graph(payload)[0]):
            yield (dump, i, n["kind"], Decimal(n["value"]), n["label"])

    def edges(dump, payload):
        for e in codec.read_graph(payload)[1]:
            yield (dump, e["src"], e["dst"], e["kind"], e["metadata"])

    return _flat(body, ["dump_id", "payload"], nodes, "dump_id string, idx int, kind int, value decimal(20,0), label string"), _flat(body, ["dump_id", "payload"], edges, "dump_id string, src int, dst int, kind int, metadata string")


def labelled_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with the labels of both ends."""
    end = lambda side: nodes.select("dump_id", F.col("idx").alias(side), F.col("label").alias(f"{side}_label"))
    return edges.join(end("src"), ["dump_id", "src"]).join(end("dst"), ["dump_id", "dst"])


def chain_breaks(all_blocks: DataFrame) -> DataFrame:
    """Chain check per container: blocks, whether it holds, and the offset of the first break."""
    prev = F.coalesce(F.lag("hash").over(Window.partitionBy("dump_id").orderBy("seq")), F.lit("00" * 32))
    checked = all_blocks.filter("not appendix").withColumn("_ok", F.col("prev_hash") == prev)
    return checked.groupBy("dump_id").agg(F.count(F.lit(1)).alias("blocks"), F.min("_ok").alias("valid"), F.min(F.when(~F.col("_ok"), F.col("file_off"))).alias("broken_at"))


def view(all_blocks: DataFrame) -> DataFrame:
    """Address-ordered view of a container: captured runs laid end to end with ``view_off``."""
    from bytefold.operators.intervals import cumulative

    runs = captured(all_blocks).withColumn("size", F.octet_length("data").cast("bigint"))
    return cumulative(runs, ["dump_id"], ["va", "seq"], "size")


# Names of region types, key types and protocols.
REGION_TYPES = {0: "UNKNOWN", 1: "HEAP", 2: "STACK", 3: "IMAGE", 4: "MAPPED_FILE", 5: "ANONYMOUS", 6: "SHARED_MEM", 255: "OTHER"}
KEY_TYPES = {1: "PRE_MASTER_SECRET", 2: "MASTER_SECRET", 3: "SESSION_KEY", 4: "HANDSHAKE_SECRET", 5: "APP_TRAFFIC_SECRET", 6: "RSA_PRIVATE_KEY", 7: "ECDH_PRIVATE_KEY", 8: "IKE_SA_KEY", 9: "ESP_AH_KEY", 10: "SSH_SESSION_KEY", 11: "WIREGUARD_KEY", 12: "ML_KEM_PRIVATE_KEY"}
PROTOCOLS = {1: "TLS", 2: "TLS", 3: "DTLS", 4: "DTLS", 5: "QUIC", 6: "IKEV2", 7: "SSH", 8: "WIREGUARD", 9: "PQ_TLS"}


def named(code: Column, names: dict[int, str], other: str) -> Column:
    """A code's name from a small fixed table."""
    c = F.lit(other)
    for k, v in reversed(list(names.items())):
        c = F.when(code == k, v).otherwise(c)
    return c


def secrets(all_blocks: DataFrame) -> DataFrame:
    """Key hints as secrets: the hinted bytes, if all their pages were captured.

    Joined on the region's id; a hint lies in one captured run or it has no bytes.  One row per
    (dump, type, value); the identifier is the value's first 32 bytes.
    """
    hints = records(all_blocks, 0x0020).select("dump_id", F.col("region_uuid").alias("uuid"), F.col("offset").cast("bigint").alias("offset"), "key_length", "key_type", "protocol")
    runs = captured(all_blocks).select("dump_id", "uuid", (F.col("start_page") * F.col("page_size")).alias("run_off"), "data")
    at = hints.join(runs, ["dump_id", "uuid"]).filter((F.col("run_off") <= F.col("offset")) & (F.col("offset") + F.col("key_length") <= F.col("run_off") + F.octet_length("data")))
    value = F.substring("data", (F.col("offset") - F.col("run_off") + 1).cast("int"), F.col("key_length").cast("int"))
    out = at.select("dump_id", named(F.col("key_type"), KEY_TYPES, "UNKNOWN").alias("secret_type"), value.alias("secret_value"), named(F.col("protocol"), PROTOCOLS, "UNKNOWN").alias("protocol"))
    return out.withColumn("identifier", F.substring("secret_value", F.lit(1), F.lit(32))).dropDuplicates(["dump_id", "secret_type", "secret_value"])


def region_keys(region_rows: DataFrame, modules: DataFrame) -> DataFrame:
    """Keys of regions that don't depend on where they were loaded.

    A region in a module is named by the module's path and its distance from the base; any other
    by its type, size and number among equals in file order.
    """
    from bytefold.operators.intervals import owner_of

    mods = modules.select("dump_id", F.col("base").alias("mbase"), (F.col("base") + F.col("size")).cast("decimal(20,0)").alias("mend"), F.lower(F.replace("path", F.lit("\\"), F.lit("/"))).alias("mpath"))
    rows = region_rows.select("dump_id", "seq", "uuid", "base", "size", "region_type", "page_size")
    owned = owner_of(rows, mods, ["dump_id"], "base", "mbase", "mend", "mpath")
    hexed = lambda c: F.concat(F.lit("0x"), F.lower(F.hex(c)))
    base_key = F.concat(F.lit("anon:"), named(F.col("region_type"), REGION_TYPES, "UNKNOWN"), F.lit(":"), hexed(F.col("size")))
    number = F.row_number().over(Window.partitionBy("dump_id", F.col("owner").isNull(), "_k").orderBy("seq")) - 1
    keyed = owned.withColumn("_k", base_key)
    return keyed.withColumn("region_key", F.when(F.col("owner").isNotNull(), F.concat(F.lit("mod:"), "owner", F.lit(":"), hexed((F.col("base") - F.col("owner_base")).cast("bigint")))).otherwise(F.concat("_k", F.lit(":"), number.cast("string")))).drop("_k")


def aligned_pages(all_blocks: DataFrame) -> DataFrame:
    """Pages that every dump captured under one region key: ``dump_id, region_key, page_off, page_size, data``.

    Keys are matched on metadata alone; only pages in the intersection are cut out of their runs.
    Keys whose page size differs between dumps are dropped.
    """
    from bytefold.operators.intervals import common_keys

    keys = region_keys(regions(all_blocks), records(all_blocks, 0x0002)).select("dump_id", "uuid", "region_key", "page_size")
    spans = regions(all_blocks).select("dump_id", "uuid", F.explode("intervals").alias("i")).filter("i.state = 'CAPTURED'").select("dump_id", "uuid", F.explode(F.sequence(F.col("i.start_page"), F.col("i.start_page") + F.col("i.pages") - 1)).alias("page_no"))
    pages = keys.join(spans, ["dump_id", "uuid"]).withColumn("page_off", F.col("page_no") * F.col("page_size"))
    shared = common_keys(pages, "dump_id", ["region_key", "page_off"], "page_size")
    wanted = pages.join(shared, ["region_key", "page_off"])
    runs = captured(all_blocks).select("dump_id", "uuid", (F.col("start_page") * F.col("page_size")).alias("run_off"), "data")
    cut = wanted.join(runs, ["dump_id", "uuid"]).filter((F.col("run_off") <= F.col("page_off")) & (F.col("page_off") < F.col("run_off") + F.octet_length("data")))
    part = F.substring("data", (F.col("page_off") - F.col("run_off") + 1).cast("int"), F.col("page_size").cast("int"))
    return cut.select("dump_id", "region_key", "page_off", "page_size", part.alias("data"))


def aligned_consensus(pages: DataFrame) -> DataFrame:
    """Consensus over aligned pages: ``region_key, page_off, off, n, mean, variance, class``.

    ``off`` counts through the slab of all shared pages in (key, page) order.  Pages are grouped
    by their key; only the regions' total sizes, a row per region, are summed in one order.
    """
    from bytefold.operators.consensus import consensus_state, expand

    body = pages.select(F.concat_ws("|", F.col("page_size").cast("string"), "region_key").alias("grp"), (F.col("page_off") / F.col("page_size")).cast("int").alias("chunk_no"), F.octet_length("data").alias("size"), "data")
    rows = expand(consensus_state(body, F.col("grp")), 1 << 32)
    split = F.split("grp", r"\|", 2)
    rows = rows.select(split[1].alias("region_key"), (F.shiftright("off", 32) * split[0].cast("bigint")).alias("page_off"), F.pmod("off", F.lit(1 << 32)).alias("_in"), "n", "mean", "variance", "class")
    shared = pages.select("region_key", "page_off", "page_size").distinct()
    rank = shared.withColumn("_page", F.sum("page_size").over(Window.partitionBy("region_key").orderBy("page_off")) - F.col("page_size"))
    size = shared.groupBy("region_key").agg(F.sum("page_size").alias("_size"))
    start = size.withColumn("_slab", F.sum("_size").over(Window.orderBy("region_key").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size")).drop("_size")
    placed = rank.join(start, "region_key").select("region_key", "page_off", (F.col("_page") + F.col("_slab")).alias("_base"))
    return rows.join(placed, ["region_key", "page_off"]).select("region_key", "page_off", (F.col("_base") + F.col("_in")).alias("off"), "n", "mean", "variance", "class")


def resolve_related(all_blocks: DataFrame, heads: DataFrame, file_hashes: DataFrame | None = None) -> DataFrame:
    """Related dumps with the container they name, null if it isn't there, and the hash check."""
    related = records(all_blocks, 0x0041).select("dump_id", "related_uuid", "related_pid", "relationship", "target_hash")
    targets = heads.filter("error is null").select(F.col("dump_uuid").alias("related_uuid"), F.col("dump_id").alias("target_id"))
    out = related.join(targets, "related_uuid", "left")
    if file_hashes is not None:
        out = out.join(file_hashes.select(F.col("dump_id").alias("target_id"), "file_hash"), "target_id", "left").withColumn("verified", F.when(F.col("target_hash") == "00" * 32, None).otherwise(F.col("target_hash") == F.col("file_hash")))
    return out


def session_report(all_blocks: DataFrame) -> DataFrame:
    """Per container: blocks, regions, bytes, captured pages, modules, hints, processes."""
    counts = all_blocks.groupBy("dump_id").agg(F.count(F.lit(1)).alias("blocks"), *(F.sum((F.col("type") == k).cast("int")).alias(n) for k, n in ((1, "regions"), (2, "modules"), (0x20, "key_hints"))))
    sizes = regions(all_blocks).select("dump_id", "size", F.aggregate(F.filter("intervals", lambda i: i["state"] == "CAPTURED"), F.lit(0).cast("bigint"), lambda a, i: a + i["pages"]).alias("pages")).groupBy("dump_id").agg(F.sum("size").alias("region_bytes"), F.sum("pages").alias("captured_pages"))
    return counts.join(sizes, "dump_id", "left").na.fill(0)


def strings(all_blocks: DataFrame, min_length: int = 4) -> DataFrame:
    """Strings of captured memory with their address, and those of module and process records.

    The address counts from the page run the string lies in, so it stays right behind pages that
    weren't captured.
    """
    from bytefold.operators.search import strings_of

    runs = captured(all_blocks).select(F.struct("dump_id", "va").alias("dump_id"), "data")
    found = strings_of(_flat_id(runs), min_length)
    split = F.split("dump_id", "\x1f")
    memory = found.select(split[0].alias("dump_id"), F.lit("region").alias("origin"), (split[1].cast("decimal(20,0)") + F.col("off")).cast("decimal(20,0)").alias("va"), "value")
    mods = records(all_blocks, 0x0002).select("dump_id", F.lit("module").alias("origin"), F.col("base").cast("decimal(20,0)").alias("va"), F.col("path").alias("value"))
    procs = records(all_blocks, 0x0040).select("dump_id", F.lit("process").alias("origin"), F.lit(None).cast("decimal(20,0)").alias("va"), F.explode(F.array("exe", "cmd")).alias("value"))
    return memory.unionByName(mods.filter(F.length("value") >= min_length)).unionByName(procs.filter(F.length("value") >= min_length))


def _flat_id(runs: DataFrame) -> DataFrame:
    return runs.select(F.concat_ws("\x1f", F.col("dump_id.dump_id"), F.col("dump_id.va").cast("string")).alias("dump_id"), "data")


# Groups of block types for display.
CATEGORIES = {"memory": (1, 0x1001), "modules": (2, 0x10), "threads and handles": (0x11, 0x12, 0x13, 0x53), "process": (0x14, 0x15, 0x40, 0x51), "keys": (0x20,), "provenance": (0x30, 0x41), "system": (0x50, 0x52, 0x55), "end": (0x0FFF,), "appendix": (0x1003,)}


def block_groups(all_blocks: DataFrame) -> DataFrame:
    """Blocks per category in the order of their first block."""
    c = F.lit("other")
    for name, kinds in CATEGORIES.items():
        c = F.when(F.col("type").isin(*kinds), name).otherwise(c)
    return all_blocks.withColumn("category", c).groupBy("dump_id", "category").agg(F.count(F.lit(1)).alias("blocks"), F.min("seq").alias("first_seq"), F.sum("length").alias("bytes"))


# The encryption extension of the file header.
_ALGO, _KDF, _ENCAP, _KEM_LEN, _NONCE, _SEALED_HEADER = 0x40, 0x41, 0x42, 0x4E, 0x50, 128


def unlock(files: DataFrame) -> DataFrame:
    """Decrypt sealed containers ``(dump_id, data, key)``: ``dump_id, data, tag``.

    Plain containers pass as they are.  AES-256-GCM with a raw key is decrypted by the engine's own
    function, with the header as authenticated data; a wrong key or a changed byte gives
    ``corrupted``, no key ``missing_key``, and other ciphers or key schemes ``unsupported``.
    """
    d = F.col("data").cast("binary")
    byte = lambda at: F.conv(F.hex(F.substring(d, F.lit(at + 1), F.lit(1))), 16, 10).cast("int")
    sealed = (F.hex(F.substring(d, F.lit(1), F.lit(8))) == "4D454D534C494345") & (byte(12).bitwiseAND(codec.ENCRYPTED) != 0)
    kem = byte(_KEM_LEN) + byte(_KEM_LEN + 1) * 256
    head = F.substring(d, F.lit(1), _SEALED_HEADER + kem)
    body = F.substring(d, _SEALED_HEADER + kem + 1, F.lit(2_147_483_647))
    known = (byte(_ALGO) == 1) & (byte(_KDF) == 0) & (byte(_ENCAP) == 0)
    usable = sealed & known & (F.octet_length("key") == 32)
    stream = F.when(usable, F.try_aes_decrypt(F.concat(F.substring(d, F.lit(_NONCE + 1), F.lit(12)), body), F.col("key"), F.lit("GCM"), F.lit("DEFAULT"), head))
    tag = F.when(~sealed, "not_encrypted").when(F.col("key").isNull(), "missing_key").when(~known | (F.octet_length("key") != 32), "unsupported").when(stream.isNull(), "corrupted").otherwise("valid")
    # The plain header: 64 bytes, size and flags set to say so.
    flags = F.unhex(F.lpad(F.hex(byte(12).bitwiseAND(255 - codec.ENCRYPTED).cast("bigint")), 2, "0"))
    plain = F.concat(F.substring(d, F.lit(1), F.lit(9)), F.lit(b"\x40"), F.substring(d, F.lit(11), F.lit(2)), flags, F.substring(d, F.lit(14), F.lit(51)), stream)
    return files.select("dump_id", F.when(tag == "valid", plain).when(tag == "not_encrypted", d).alias("data"), tag.alias("tag"))


def seal(parts: DataFrame) -> DataFrame:
    """Encrypt containers given as ``dump_id, head, stream, key, nonce`` (see ``sealed_parts``)."""
    body = F.aes_encrypt("stream", "key", F.lit("GCM"), F.lit("DEFAULT"), F.col("nonce"), F.col("head"))
    return parts.select("dump_id", F.concat("head", F.substring(body, F.lit(13), F.lit(2_147_483_647))).alias("data"))


def address_text(family: Column, raw_hex: Column) -> Column:
    """An address of the connection table as text: IPv4, shortest IPv6, else its hex."""
    import ipaddress

    def show(kinds: pd.Series, values: pd.Series) -> pd.Series:
        def one(kind, value):
            raw = bytes.fromhex(value or "")
            if kind == 2 and len(raw) >= 4:
                return str(ipaddress.IPv4Address(raw[:4]))
            return str(ipaddress.IPv6Address(raw[:16])) if kind == 10 and len(raw) >= 16 else value

        return pd.Series([one(k, v) for k, v in zip(kinds, values)], dtype=object)

    return F.pandas_udf(show, "string")(family, raw_hex)


def instant_text(ns: Column) -> Column:
    """Nanoseconds since the epoch as an ISO time in UTC."""
    return F.date_format(F.timestamp_micros(F.floor(ns / 1000).cast("bigint")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
