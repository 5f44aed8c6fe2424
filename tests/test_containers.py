"""Container codec round trips, relations over containers, and the other image sources."""

import struct

import pytest
from pyspark.sql import functions as F

from bytefold.functions.hashing import blake3
from bytefold.sources import codec as C
from bytefold.sources import container as M
from bytefold.sources import images as I

UUID = bytes(range(16))


def sample(algorithm=1, compression=0, base=0x400000, page0=b"\xaa", uuid=UUID):
    w = C.ContainerWriter(pid=7, dump_uuid=uuid, ts_ns=1_700_000_000_000_000_000, algorithm=algorithm, compression=compression)
    w.add_record(0x0040, {"ppid": 1, "exe": "/bin/ä", "cmd": "run --x"})
    w.add_record(0x0002, {"base": base, "size": 8192, "path": "C:\\Lib\\M.dll", "version": "1", "disk_hash": b"\x01" * 32})
    r = w.add_region({"base": base, "size": 3072, "prot": 3, "region_type": 3, "page_log2": 10}, [0, 1, 0], page0 * 1024 + b"string here\0" + b"\xbb" * 1012)
    w.add_region({"base": 2**63 + 4096, "size": 1024, "prot": 1, "region_type": 1, "page_log2": 10}, [0], b"\xcc" * 1024)
    w.add_record(0x0020, {"region_uuid": r, "offset": 64, "key_length": 32, "key_type": 3, "protocol": 2, "confidence": 2, "note": "k"})
    w.add_record(0x0020, {"region_uuid": r, "offset": 1030, "key_length": 32, "key_type": 3, "protocol": 2})  # in a page not captured
    w.add_record(0x0041, {"related_uuid": b"\x09" * 16, "related_pid": 8, "relationship": 1})
    w.add_table(0x0051, [{"pid": 1, "exe": "a", "cmd": "", "user": "root", "is_target": True, "rss": 2**40}, {"pid": 2}])
    w.add_table(0x0052, [{"pid": 1, "family": 2, "local_addr": b"\x7f\0\0\x01", "local_port": 443}])
    w.add_table(0x0053, [{"pid": 1, "fd": 3, "handle_type": 1, "path": "/tmp/x"}])
    w.add_table(0x1001, [{"base": base, "size": 3072, "path": "/lib/a.so"}])
    w.add_table(0x0010, [{"module_uuid": UUID, "base": base, "size": 1, "path": "m"}])
    w.add_table(0x0014, [{"key": "HOME", "value": "/root"}])
    w.add_record(0x0050, {"boot_ns": 5, "user": "u", "host": "h", "os_detail": "linux", "uptime_ns": 9, "os_version": "6"})
    w.add(0x0055, C.write_connectivity([{"row_type": "arp", "ip": b"\n\0\0\x01", "iface": "eth0"}, {"row_type": "mib_counter", "mib": "Tcp", "counter": "In", "value": 5}]))
    w.add_record(0x0011, {"thread_id": 4, "registers": b"regs"})
    w.set_graph([{"kind": 1, "value": 2**63, "label": "n0"}, {"kind": 3, "label": "n1"}], [{"src": 0, "dst": 1, "kind": 2, "metadata": "m"}])
    return w.to_bytes()


def files(spark, *datas):
    return spark.createDataFrame([(f"d{i}", bytearray(x) if x is not None else None) for i, x in enumerate(datas)], "dump_id string, data binary")


def test_blake3_vectors():
    tail = lambda n: bytes(i % 251 for i in range(n))
    assert blake3(b"").hex() == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert blake3(b"abc").hex() == "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85"
    assert [blake3(tail(n)).hex()[:16] for n in (1024, 1025, 2049, 31744)] == ["42214739f095a406", "d00278ae47eb27b3", "5f4d72f40d7a5f82", "62b6960e1a44bcc1"]


@pytest.mark.parametrize("algorithm", [0, 1, 2])
@pytest.mark.parametrize("compression", [0, 1, 2])
def test_round_trip(algorithm, compression):
    data = sample(algorithm, compression)
    b = C.iter_blocks(data)
    chain = [x for x in b if not x["appendix"]]
    assert chain[-1]["type"] == C.END and b[-1]["type"] == C.GRAPH
    assert all(y["prev_hash"] == x["hash"] for x, y in zip(chain, chain[1:]))
    by = {x["type"]: x["payload"] for x in b}
    assert C.read(C.LAYOUTS[0x0040][1], by[0x0040])[0]["exe"] == "/bin/ä"
    assert [r["user"] for r in C.read_table(0x0051, by[0x0051])] == ["root", ""]
    assert C.read_connectivity(by[0x0055])[0]["row_type"] == "arp"
    assert C.read_table(0x0014, by[0x0014])[0]["value"] == "/root"
    assert C.read(C.LAYOUTS[0x0050][1], by[0x0050])[0]["os_version"] == "6"
    nodes, edges, good = C.read_graph(by[C.GRAPH], algorithm)
    assert good and nodes[0]["value"] == 2**63 and edges[0]["metadata"] == "m"
    assert C.file_header(data)["pid"] == 7 and C.tag_status(data) == "not_encrypted"


def test_refused_and_damaged():
    data = sample()
    for bad in (b"", b"no", data[:8] + b"\x02" + data[9:], data[:11] + b"\x02" + data[12:]):
        with pytest.raises(C.FormatError):
            C.file_header(bad)
    assert len(C.iter_blocks(data[:500])) < len(C.iter_blocks(data))  # a cut block ends the walk
    short = bytearray(data)
    short[64 + 8 : 64 + 12] = (10).to_bytes(4, "little")
    with pytest.raises(C.FormatError):
        C.iter_blocks(bytes(short))
    assert C.read_table(0x0010, (5).to_bytes(4, "little") + bytes(4)) == []  # only announces modules
    with pytest.raises(C.FormatError):
        C.read_region(struct.pack("<QQBBB5xQ", 0, 1024, 0, 0, 9, 0))
    locked = bytearray(data)
    locked[12] |= 4
    assert C.tag_status(bytes(locked)) == "missing_key" and C.iter_blocks(bytes(locked)) == []


def test_page_intervals():
    assert C.page_intervals(C.page_map([0, 0, 1, 2, 3, 0]), 6) == [(0, 2, "CAPTURED"), (2, 1, "FAILED"), (3, 1, "UNMAPPED"), (4, 1, "FAILED"), (5, 1, "CAPTURED")]
    assert C.page_intervals(b"", 2) == [(0, 2, "FAILED")] and C.page_intervals(bytes(8), 5) == [(0, 5, "CAPTURED")]
    assert C.page_intervals(b"", 0) == []


def test_relations(spark):
    broken = bytearray(sample())
    broken[64 + 80 + 2] ^= 1
    df = files(spark, sample(), b"junk", None, bytes(broken))
    b = M.blocks(df)
    heads = {r.dump_id: r for r in M.headers(df).collect()}
    assert heads["d0"].dump_uuid == UUID.hex() and heads["d1"].error and heads["d2"].error
    chain = {r.dump_id: (r.valid, r.broken_at) for r in M.chain_breaks(b).collect()}
    assert chain["d0"] == (True, None) and not chain["d3"][0]
    mine = b.filter("dump_id = 'd0'")
    assert [r.path for r in M.records(mine, 0x0002).collect()] == ["C:\\Lib\\M.dll"]
    regions = {int(r.base): r for r in M.regions(mine).collect()}
    assert [i.state for i in regions[0x400000].intervals] == ["CAPTURED", "FAILED", "CAPTURED"] and 2**63 + 4096 in regions
    runs = [(int(r.va), len(r.data)) for r in M.captured(mine).orderBy("seq", "start_page").collect()]
    assert runs == [(0x400000, 1024), (0x400000 + 2048, 1024), (2**63 + 4096, 1024)]
    assert [r.view_off for r in M.view(mine).orderBy("va").collect()] == [0, 1024, 2048]
    found = M.secrets(mine).collect()
    assert [(r.secret_type, bytes(r.secret_value), r.protocol) for r in found] == [("SESSION_KEY", b"\xaa" * 32, "TLS")]
    keys = {r.region_key for r in M.region_keys(M.regions(mine), M.records(mine, 0x0002)).collect()}
    assert "mod:c:/lib/m.dll:0x0" in keys and "anon:HEAP:0x400:0" in keys
    nodes, edges = M.graph(mine)
    assert M.labelled_edges(nodes, edges).first().src_label == "n0"
    report = M.session_report(mine).first()
    assert (report.regions, report.key_hints, report.captured_pages, report.region_bytes) == (2, 2, 3, 4096)
    texts = {(r.origin, int(r.va) if r.va is not None else None, r.value) for r in M.strings(mine, 5).collect()}
    assert ("region", 0x400000 + 2048, "string here") in texts and ("process", None, "run --x") in texts
    assert {r.row_type: r.fields for r in M.connectivity(mine).collect()}["mib_counter"]["value"] == "5"
    assert {r.category for r in M.block_groups(mine).collect()} >= {"memory", "keys", "end", "appendix"}
    related = M.resolve_related(mine, M.headers(df)).collect()
    assert [(r.related_uuid, r.target_id) for r in related] == [("09" * 16, None)]


def test_continuations(spark):
    rows = [("d", 0, 1, 16, "p", "", b"a"), ("d", 1, 1, 32, "c", "p", b"b"), ("d", 2, 1, 32, "c2", "x", b"orphan"), ("d", 3, 1, 32, "c3", "p", b"c"), ("d", 4, 2, 0, "q", "", b"z"), ("d", 5, 1, 32, "c4", "p", b"late")]
    df = spark.createDataFrame([(*r[:6], bytearray(r[6])) for r in rows], "dump_id string, seq int, type int, flags int, uuid string, parent string, payload binary")
    got = {r.seq: bytes(r.payload) for r in M.merge_continuations(df).collect()}
    assert got == {0: b"abc", 2: b"orphan", 4: b"z", 5: b"late"}


def test_alignment_across_loads(spark):
    df = files(spark, sample(base=0x400000), sample(base=0x500000, page0=b"\xab"))
    pages = M.aligned_pages(M.blocks(df))
    keys = {(r.region_key, r.page_off) for r in pages.collect()}
    assert keys == {("mod:c:/lib/m.dll:0x0", 0), ("mod:c:/lib/m.dll:0x0", 2048), ("anon:HEAP:0x400:0", 0)}
    rows = M.aligned_consensus(pages)
    assert rows.count() == 3072
    assert rows.filter("variance > 0").select("region_key", "page_off").distinct().count() == 1


def test_import_raw(spark):
    secret = b"S" * 32
    data = C.import_raw(b"x" * 5000 + secret + b"y", [(secret, 3, 2), (b"missing", 3, 2), (b"", 3, 2)], algorithm=1)
    b = M.blocks(files(spark, data))
    assert [bytes(r.secret_value) for r in M.secrets(b).collect()] == [secret]
    assert M.regions(b).first()["size"] == 8192
    assert M.records(b, 0x0030).first().orig_size == 5033


def core():
    note = struct.pack("<III", 5, 40, 1) + b"CORE\0\0\0\0" + bytes(32) + struct.pack("<I", 77) + bytes(4)
    names = b"/lib/a.so\0"
    desc = struct.pack("<QQQQQ", 1, 4096, 0x1000, 0x2000, 2) + names
    note += struct.pack("<III", 5, len(desc), 0x46494C45) + b"CORE\0\0\0\0" + desc + bytes(-len(desc) % 4)
    ehdr = b"\x7fELF" + bytes([2, 1, 1]) + bytes(9) + struct.pack("<HHIQQQIHHHHHH", 4, 62, 1, 0, 64, 0, 0, 64, 56, 3, 0, 0, 0)
    at = 64 + 3 * 56
    ph = struct.pack("<IIQQQQQQ", 4, 0, at, 0, 0, len(note), len(note), 1)
    ph += struct.pack("<IIQQQQQQ", 1, 6, at + len(note), 0x5000, 0, 16, 32, 1)
    ph += struct.pack("<IIQQQQQQ", 1, 4, at + len(note) + 16, 0x1000, 0, 8, 8, 1)
    return ehdr + ph + note + b"A" * 16 + b"B" * 8


def test_core(spark):
    df = files(spark, core(), b"\x7fELF", None)
    seg = I.core_segments(df)
    assert [(int(r.va), r.view_off, r.file_size, r.pid) for r in seg.orderBy("va").collect()] == [(0x1000, 0, 8, 77), (0x5000, 8, 16, 77)]
    assert [(r.path, r.file_off) for r in I.core_modules(df).collect()] == [("/lib/a.so", 8192)]
    addresses = spark.createDataFrame([("d0", 0x5004), ("d0", 0x9000), ("d0", 0x1000)], "dump_id string, va bigint")
    assert sorted((r.va, r.view_off) for r in I.locate(addresses, seg).collect()) == [(0x1000, 0), (0x5004, 12)]
    with pytest.raises(NotImplementedError):
        I.parse_core(b"\x7fELF\x01" + core()[5:])


@pytest.mark.parametrize("chunk,halo", [(8, 3), (5, 0), (64, 9), (700, 31)])
def test_views_become_chunks(spark, chunk, halo):
    from bytefold.operators.chunks import chunked, chunks_of_view

    df = files(spark, core())
    want = spark.createDataFrame([("d0", bytearray(b"B" * 8 + b"A" * 16))], "dump_id string, data binary")
    key = lambda x: sorted((r.dump_id, r.chunk_no, r.base_off, r["size"], bytes(r.data)) for r in x.collect())
    assert key(chunks_of_view(I.core_view(df), halo, chunk)) == key(chunked(want, halo, chunk))
    box = M.view(M.blocks(files(spark, sample())))
    whole = b"".join(bytes(r.data) for r in box.orderBy("view_off").collect())
    image = spark.createDataFrame([("d0", bytearray(whole))], "dump_id string, data binary")
    assert key(chunks_of_view(box, halo, chunk)) == key(chunked(image, halo, chunk)) and len(whole) == 3072


def test_maps(spark):
    lines = ["00400000-00401000 r-xp 00000000 08:01 12 /usr/lib/my lib.so.1.1", "7f0000000000-7f0000002000 rw-p 00001000 00:00 0", "7ffc0000-7ffd0000 rw-p 00000000 00:00 0 [stack:5]", "junk", "ffffffff00000000-ffffffff00001000 r-xp 00000000 00:00 0 [vsyscall]", "1000-2000 r--p 0 00:00 0 /opt/data.bin"]
    df = spark.createDataFrame([("d", x) for x in lines], "dump_id string, value string")
    got = I.parse_maps(df).orderBy("start").collect()
    assert [r.region_type for r in got] == ["MAPPED_FILE", "IMAGE", "STACK", "ANONYMOUS", "OTHER"]
    assert got[1].path == "/usr/lib/my lib.so.1.1" and int(got[4].start) == 0xFFFFFFFF00000000
    sizes = spark.createDataFrame([("d", 4096 + 4096 + 100)], "dump_id string, size bigint")
    rows = I.map_offsets(I.parse_maps(df), sizes).orderBy("bin_off").collect()
    assert [(r.bin_off, r.available) for r in rows] == [(0, 4096), (4096, 4096), (8192, 100)]


def test_image_source(spark, tmp_path):
    data = bytes(i % 256 for i in range(1000))
    (tmp_path / "a.dump").write_bytes(data)
    (tmp_path / "empty.dump").write_bytes(b"")
    I.register(spark)
    df = spark.read.format("byteimage").option("chunk", 64).option("halo", 5).option("bytespertask", 128).load(str(tmp_path))
    rows = df.orderBy("chunk_no").collect()
    assert b"".join(bytes(r.data[: r["size"]]) for r in rows) == data and len(rows[0].data) == 69
    assert bytes(I.read_range(df, 60, 200).first().data) == data[60:260]
    assert bytes(I.read_range(df, 990, 200).first().data) == data[990:]
    assert spark.read.format("byteimage").load(str(tmp_path / "none")).count() == 0


def test_container_source_is_the_walk_in_memory(spark, tmp_path):
    (tmp_path / "a.msl").write_bytes(sample(0, 1))
    (tmp_path / "b.msl").write_bytes(b"junk")
    (tmp_path / "c.msl").write_bytes(sample()[:700])
    I.register(spark)
    read = spark.read.format("blockcontainer").option("glob", "*.msl").load(str(tmp_path))
    plain = M.blocks(spark.read.format("binaryFile").load(str(tmp_path)).select(F.regexp_replace("path", "^file:(//)?", "").alias("dump_id"), F.col("content").alias("data")))
    key = lambda df: sorted((r.dump_id, r.seq, r.file_off, r.type, r.hash, r.appendix, bytes(r.payload)) for r in df.collect())
    assert key(read) == key(plain) and len(key(read)) > 17


def test_source_kind(spark):
    rows = [("/x/a.msl", bytearray(b"raw bytes with a wrong name")), ("/x/y.bin", bytearray(b"MEMSLICE" + bytes(60))), ("/x/gcore.core", bytearray(core())), ("/x/gdb_raw.bin", bytearray(b"x")), ("/x/p.lldb_raw.bin", bytearray(b"x"))]
    df = spark.createDataFrame(rows, "path string, head binary")
    assert [r.k for r in df.select(I.source_kind(F.col("path"), F.col("head")).alias("k")).collect()] == ["raw", "msl", "gcore", "gdb_raw", "lldb_raw"]


def test_faults_are_listed(spark):
    """Nothing that can't be read vanishes without a row that says so."""
    w = C.ContainerWriter(algorithm=1)
    w.add_record(0x0002, {"base": 1, "size": 2, "path": "/m.so"})
    good = w.to_bytes()
    files = {"good": good, "none": b"no container", "empty": b"", "cut": good[:-9], "tail": good + b"junk" * 30, "null": None}
    df = spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in files.items()], "dump_id string, data binary")
    got = {r.dump_id: (r.file_off, r.error) for r in M.read_errors(df).collect()}
    assert set(got) == {"none", "empty", "cut", "tail", "null"}
    assert got["tail"] == (len(good), "no block begins here") and got["cut"][0] > 0
