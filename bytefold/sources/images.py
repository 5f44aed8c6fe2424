"""Image files as chunks: a Python data source with ranged reads, maps and core parsing, dispatch.

``binaryFile`` holds a whole file in one row and stops at 2 GB; ``register(spark)`` adds the format
``byteimage``, which plans one task per stretch of a file and reads only that stretch.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator
from fnmatch import fnmatch

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from bytefold.operators.chunks import CHUNK

_SCHEMA = "dump_id string, chunk_no int, base_off bigint, size int, data binary"


class Stretch(InputPartition):
    """A run of chunks of one file."""

    def __init__(self, path: str, first: int, chunks: int) -> None:
        self.path, self.first, self.chunks = path, first, chunks


def open_image(path: str):
    """A seekable file of a path or address: local, or any file system that Arrow knows (hdfs, s3, gs)."""
    local = path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")
    if "://" not in local:
        return open(local, "rb", buffering=0)
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return system.open_input_file(place)


def list_images(options: dict) -> list[tuple[str, int]]:
    """Paths and sizes below ``path`` (several with commas) that match ``glob``."""
    out, pattern = [], options.get("glob", "*")
    for part in options["path"].split(","):
        if "://" in part and not part.startswith("file:"):
            from pyarrow import fs

            system, place = fs.FileSystem.from_uri(part.replace("s3a://", "s3://", 1))
            scheme = part.split("://")[0]
            info = system.get_file_info(place)
            found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(place, recursive="**" in pattern))
            kept = [f for f in found if f.type == fs.FileType.File and (info.type == fs.FileType.File or fnmatch(f.base_name, pattern.rsplit("/", 1)[-1]))]
            out += [(f"{scheme}://{f.path}" if scheme != "hdfs" else f"{part.split('://')[0]}://{part.split('://')[1].split('/')[0]}{f.path}", f.size) for f in kept]
            continue
        local = part.removeprefix("file://") if part.startswith("file://") else part.removeprefix("file:")
        names = [local] if os.path.isfile(local) else glob.glob(os.path.join(local, pattern), recursive=True)
        out += [(p, os.path.getsize(p)) for p in names if os.path.isfile(p)]
    return sorted(out)


class ImageReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.files = list_images(options)
        self.paths = [p for p, _ in self.files]
        self.chunk = int(options.get("chunk", CHUNK))
        self.halo = int(options.get("halo", 0))
        self.per_task = max(1, int(options.get("bytespertask", 64 << 20)) // self.chunk)

    def partitions(self) -> list[Stretch]:
        out = []
        for p, size in self.files:
            n = -(-size // self.chunk)
            out += [Stretch(p, i, min(self.per_task, n - i)) for i in range(0, n, self.per_task)]
        return out or [Stretch("", 0, 0)]

    def read(self, part: Stretch) -> Iterator[pa.RecordBatch]:
        if not part.chunks:
            return
        with open_image(part.path) as file:
            for n in range(part.first, part.first + part.chunks):
                file.seek(n * self.chunk)
                data = file.read(self.chunk + self.halo)
                yield pa.RecordBatch.from_arrays([pa.array([part.path]), pa.array([n], pa.int32()), pa.array([n * self.chunk], pa.int64()), pa.array([min(self.chunk, len(data))], pa.int32()), pa.array([data], pa.binary())], names=["dump_id", "chunk_no", "base_off", "size", "data"])


class ImageSource(DataSource):
    """``spark.read.format("byteimage").option("halo", 31).load(path)`` gives ``byte_chunks``."""

    @classmethod
    def name(cls) -> str:
        return "byteimage"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> ImageReader:
        return ImageReader(dict(self.options))


class ContainerReader(DataSourceReader):
    """Walks block containers by their headers; a task holds one block at a time."""

    def __init__(self, options: dict) -> None:
        self.paths = ImageReader(options).paths

    def partitions(self) -> list[Stretch]:
        return [Stretch(p, 0, 1) for p in self.paths] or [Stretch("", 0, 0)]

    def read(self, part: Stretch) -> Iterator[tuple]:
        from bytefold.functions.hashing import block_hash
        from bytefold.sources import codec

        if not part.chunks:
            return
        with open_image(part.path) as file:
            size = file.seek(0, os.SEEK_END)
            file.seek(0)
            try:
                head = codec.file_header(file.read(codec.FILE_HEADER))
            except codec.FormatError:
                return
            if head["flags"] & codec.ENCRYPTED:
                return
            at, seq, appendix = head["header_size"], 0, False
            while at + codec.BLOCK_HEADER <= size:
                file.seek(at)
                raw = file.read(codec.BLOCK_HEADER)
                if raw[:4] != codec.BLOCK_MAGIC:
                    return
                b, _ = codec.read(codec.BLOCK_LAYOUT, raw)
                if b["length"] < codec.BLOCK_HEADER or at + b["length"] > size:
                    return
                payload = file.read(b["length"] - codec.BLOCK_HEADER)
                digest = block_hash(raw + payload, head["hash_algo"] if head["hash_algo"] in (0, 1, 2) else 0)
                body = payload if appendix else codec.inflate(payload, b["flags"])
                yield (part.path, seq, at, b["type"], b["flags"], b["length"], b["payload_version"], b["uuid"].hex(), b["parent"].hex(), b["prev_hash"].hex(), digest.hex(), appendix, body)
                appendix = appendix or b["type"] == codec.END
                at, seq = at + b["length"], seq + 1


class ContainerSource(DataSource):
    """``spark.read.format("blockcontainer").load(path)`` gives the ``blocks`` relation."""

    @classmethod
    def name(cls) -> str:
        return "blockcontainer"

    def schema(self) -> str:
        from bytefold.sources.container import BLOCKS

        return BLOCKS

    def reader(self, schema) -> ContainerReader:
        return ContainerReader(dict(self.options))


def image_files(spark: SparkSession, paths: list[str], pattern: str = "*") -> DataFrame:
    """``dump_id, path, size`` of the files below some folders; listed by Spark, nothing is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(paths)
    return files.select(F.col("path").alias("dump_id"), "path", F.col("length").alias("size"))


#: Images that one task folds over one stretch; their sums fit 16 bits.
FOLD_IMAGES = 256


def _fold_files(chunk: int):
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bytefold.operators.consensus import ChunkState, as_bytes, state_batch

        for batch in batches:
            for r in batch.to_pylist():
                files = [open_image(p) for p in r["paths"]]
                try:
                    held = {}
                    for no in range(r["first"], r["last"] + 1):
                        size = min(chunk, r["least"] - no * chunk)
                        state = None
                        for file in files:
                            file.seek(no * chunk)
                            one = ChunkState(1, as_bytes(file.read(size)), None)
                            state = one if state is None else state.add(one)
                        held[r["grp"], no] = state
                        if len(held) == 64:
                            yield state_batch(held)
                            held = {}
                    if held:
                        yield state_batch(held)
                finally:
                    for file in files:
                        file.close()

    return fold


def file_states(files: DataFrame, chunk: int = CHUNK, unit_bytes: int = 16 << 20, group: Column | None = None) -> DataFrame:
    """Consensus states of image files ``(path, size)`` by group, each file read once and in ranges.

    A task reads the same stretch of up to ``FOLD_IMAGES`` files of a group and folds them on the
    spot, so images never cross an exchange; groups of more files exchange one state for each so
    many.  Only the bytes that all images of a group hold are read: sizes are known from the
    listing.  Empty files are left out.
    """
    from bytefold.operators.consensus import STATE, merge_states

    spark = files.sparkSession
    g = (F.lit("") if group is None else F.coalesce(group.cast("string"), F.lit(""))).alias("grp")
    known = files.filter("size > 0").select(g, "path", F.col("size").cast("bigint").alias("size"))
    least = known.groupBy("grp").agg(F.min("size").alias("least"), F.count(F.lit(1)).alias("images"))
    # Blocks of files by a hash of their path: no order over a group is needed to cut it.
    cut = known.join(least, "grp").withColumn("block", F.pmod(F.xxhash64("path"), F.ceil(F.col("images") / (FOLD_IMAGES // 2))))
    blocks = cut.groupBy("grp", "block", "least").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    per = F.greatest(F.lit(1), F.floor(F.lit(unit_bytes) / (F.size("paths") * F.lit(chunk)))).cast("int")
    chunks = F.ceil(F.col("least") / chunk).cast("int")
    work = blocks.select("grp", "paths", "least", per.alias("per"), F.explode(F.sequence(F.lit(0), chunks - 1, per)).alias("first"))
    work = work.select("grp", "paths", "least", "first", F.least(F.col("first") + F.col("per"), F.ceil(F.col("least") / chunk)).cast("int").alias("last"))
    work = work.withColumn("last", F.col("last") - 1)
    most, size = known.groupBy("grp").agg(F.count(F.lit(1)).alias("c"), F.sum("size").alias("s")).agg(F.max("c"), F.sum("s")).first()
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-(size or 0) // (4 * unit_bytes)))
    states = work.repartition(int(tasks)).mapInArrow(_fold_files(chunk), STATE)
    return merge_states(states) if (most or 0) > FOLD_IMAGES // 2 else states


def file_windows(files: DataFrame, chunk: int, before: int, after: int, task_bytes: int = 16 << 20) -> DataFrame:
    """Chunks of files ``(grp, path, size)`` with the bytes around them: ``grp, chunk_no, data``.

    ``data`` runs from ``before`` bytes ahead of the chunk (or the file's start) to ``after`` beyond it.
    """
    per = max(1, task_bytes // chunk)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                with open_image(r["path"]) as file:
                    for no in range(r["first"], min(r["first"] + per, -(-r["size"] // chunk))):
                        start = max(0, no * chunk - before)
                        file.seek(start)
                        data = file.read((no + 1) * chunk + after - start)
                        yield pa.RecordBatch.from_arrays([pa.array([r["grp"]], pa.string()), pa.array([no], pa.int32()), pa.array([data], pa.binary())], names=["grp", "chunk_no", "data"])

    work = files.filter("size > 0").select("grp", "path", "size", F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / chunk).cast("int") - 1, F.lit(per))).alias("first"))
    return work.repartition(2 * files.sparkSession.sparkContext.defaultParallelism, "grp", "first").mapInArrow(windows, "grp string, chunk_no int, data binary")


def register(spark: SparkSession) -> None:
    """Add the formats ``byteimage`` and ``blockcontainer`` to a session."""
    spark.dataSource.register(ImageSource)
    spark.dataSource.register(ContainerSource)


def read_range(chunks: DataFrame, offset: int, length: int) -> DataFrame:
    """The bytes ``[offset, offset + length)`` of each image; only its chunks are touched."""
    end = offset + length
    hit = chunks.filter((F.col("base_off") < end) & (F.col("base_off") + F.col("size") > offset))
    low = F.greatest(F.lit(offset), F.col("base_off"))
    part = F.substring("data", (low - F.col("base_off") + 1).cast("int"), (F.least(F.lit(end), F.col("base_off") + F.col("size")) - low).cast("int"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("base_off", "_p"))), lambda x: x["_p"])
    return hit.withColumn("_p", part).groupBy("dump_id").agg(parts.alias("_p")).select("dump_id", F.aggregate("_p", F.lit(b""), lambda a, x: F.concat(a, x)).alias("data"))


def source_kind(path: Column, head: Column) -> Column:
    """How to open a file: container, ELF core, raw with maps, or raw; magic before the name."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    core = (F.hex(F.substring(head, F.lit(1), F.lit(4))) == "7F454C46") & (F.hex(F.substring(head, F.lit(17), F.lit(2))) == "0400")
    return F.when(F.hex(F.substring(head, F.lit(1), F.lit(8))) == "4D454D534C494345", "msl").when(core, "gcore").when(name.endswith("gdb_raw.bin"), "gdb_raw").when(name.endswith("lldb_raw.bin"), "lldb_raw").otherwise("raw")


# Special paths of a memory map.
_PSEUDO = ("[vdso]", "[vvar]", "[vsyscall]")


def region_type(path: Column) -> Column:
    """Type of a mapped region by its path."""
    image = path.rlike(r"\.so(\.\d+.*)?$") | path.contains("/lib/") | path.contains("/usr/")
    return (
        F.when(path == "", "ANONYMOUS")
        .when(path.startswith("[heap"), "HEAP")
        .when(path.startswith("[stack"), "STACK")
        .when(path.isin(*_PSEUDO), "OTHER")
        .when(path.startswith("[anon_shmem"), "SHARED_MEM")
        .when(path.startswith("["), "OTHER")
        .when(image, "IMAGE")
        .when(path.startswith("/"), "MAPPED_FILE")
        .otherwise("UNKNOWN")
    )


def parse_maps(lines: DataFrame, column: str = "value") -> DataFrame:
    """Regions of memory-map lines ``start-end perms offset dev inode path``; other lines are dropped.

    Keeps all other columns.  The path may hold blanks or be missing.
    """
    pattern = r"^([0-9a-fA-F]+)-([0-9a-fA-F]+)\s+(\S{4})\s+([0-9a-fA-F]+)\s+(\S+)\s+(\d+)\s*(.*)$"
    part = lambda i: F.regexp_extract(column, pattern, i)
    number = lambda i: F.conv(part(i), 16, 10).cast("decimal(20,0)")
    rows = lines.filter(F.col(column).rlike(pattern))
    path = F.rtrim(part(7))
    return rows.select(*(c for c in lines.columns if c != column), number(1).alias("start"), number(2).alias("end"), part(3).alias("perms"), number(4).alias("file_offset"), part(5).alias("dev"), part(6).cast("bigint").alias("inode"), path.alias("path"), (path == "").alias("is_anon"), region_type(path).alias("region_type"))


def map_offsets(regions: DataFrame, sizes: DataFrame) -> DataFrame:
    """Where each mapped region lies in a flat image: cumulative sizes, cut at the image's end.

    ``sizes(dump_id, size)``; regions beyond the end are dropped and the last one may be partial.
    """
    from bytefold.operators.intervals import cumulative

    rows = cumulative(regions.withColumn("length", (F.col("end") - F.col("start")).cast("bigint")), ["dump_id"], ["start"], "length", "bin_off").join(sizes, "dump_id")
    return rows.filter(F.col("bin_off") < F.col("size")).withColumn("available", F.least(F.col("length"), F.col("size") - F.col("bin_off"))).drop("size")


# ELF program header and note types.
_PT_LOAD, _PT_NOTE, _NT_PRSTATUS, _NT_FILE = 1, 4, 1, 0x46494C45


def parse_core(data: bytes) -> dict:
    """Segments, process id and mapped files of a little-endian 64-bit ELF core."""
    word = lambda at, n: int.from_bytes(data[at : at + n], "little")
    if data[:4] != b"\x7fELF" or word(16, 2) != 4:
        raise ValueError("no ELF core")
    if data[4] != 2 or data[5] != 1:
        raise NotImplementedError("only little-endian 64-bit cores")
    table, entry, count = word(32, 8), word(54, 2), word(56, 2)
    segments, modules, pid = [], [], None
    for at in range(table, table + entry * count, entry):
        kind, flags, offset, vaddr, filesz, memsz = word(at, 4), word(at + 4, 4), word(at + 8, 8), word(at + 16, 8), word(at + 32, 8), word(at + 40, 8)
        if kind == _PT_LOAD:
            segments.append((vaddr, memsz, offset, filesz, flags))
        elif kind == _PT_NOTE:
            note, end = offset, offset + filesz
            while note + 12 <= end:
                name, size, what = word(note, 4), word(note + 4, 4), word(note + 8, 4)
                body = note + 12 + name + -name % 4
                if what == _NT_PRSTATUS and pid is None:
                    pid = word(body + 32, 4)
                elif what == _NT_FILE:
                    n, page = word(body, 8), word(body + 8, 8)
                    names = data[body + 16 + 24 * n : body + size].split(b"\0")
                    modules += [(word(body + 16 + 24 * i, 8), word(body + 24 + 24 * i, 8), word(body + 32 + 24 * i, 8) * page, names[i].decode("utf-8", "replace")) for i in range(min(n, len(names)))]
                note = body + size + -size % 4
    return {"pid": pid, "segments": segments, "modules": modules}


def core_segments(files: DataFrame) -> DataFrame:
    """PT_LOAD segments of ELF cores in address order with their place in the view."""
    from decimal import Decimal

    from bytefold.operators.intervals import cumulative
    from bytefold.sources.container import _flat, _images

    def segments(dump, data):
        try:
            core = parse_core(data or b"")
        except (ValueError, NotImplementedError, IndexError):
            return
        for vaddr, memsz, offset, filesz, flags in core["segments"]:
            yield (dump, core["pid"], Decimal(vaddr), memsz, offset, filesz, flags)

    rows = _flat(_images(files), ["dump_id", "data"], segments, "dump_id string, pid bigint, va decimal(20,0), mem_size bigint, file_off bigint, file_size bigint, flags bigint")
    return cumulative(rows, ["dump_id"], ["va"], "file_size")


def core_view(files: DataFrame) -> DataFrame:
    """Captured memory of ELF cores in address order: ``dump_id, va, view_off, data``."""
    parts = core_segments(files).select("dump_id", "va", "view_off", "file_off", "file_size").join(files.select(F.col("dump_id").cast("string").alias("dump_id"), F.col("data").cast("binary").alias("data")), "dump_id")
    return parts.select("dump_id", "va", "view_off", F.substring("data", (F.col("file_off") + 1).cast("int"), F.col("file_size").cast("int")).alias("data"))


def core_modules(files: DataFrame) -> DataFrame:
    """Mapped files of ELF cores."""
    from decimal import Decimal

    from bytefold.sources.container import _flat, _images

    def modules(dump, data):
        try:
            core = parse_core(data or b"")
        except (ValueError, NotImplementedError, IndexError):
            return
        for start, end, offset, path in core["modules"]:
            yield (dump, Decimal(start), Decimal(end), offset, path)

    return _flat(_images(files), ["dump_id", "data"], modules, "dump_id string, start decimal(20,0), end decimal(20,0), file_off bigint, path string")


def locate(addresses: DataFrame, segments: DataFrame) -> DataFrame:
    """Virtual addresses as offsets in the view and the file; an address in no segment is dropped."""
    from bytefold.operators.intervals import point_join

    spans = segments.select("dump_id", F.col("va").cast("bigint").alias("start"), (F.col("va") + F.col("file_size")).cast("bigint").alias("end"), "view_off", "file_off")
    at = point_join(addresses, spans, ["dump_id"], "va", ("start", "end"))
    inside = F.col("va") - F.col("r_start")
    return at.select(*addresses.columns, (F.col("r_view_off") + inside).alias("view_off"), (F.col("r_file_off") + inside).alias("file_off"))
