"""Catalog, key logs, structures, crypto, patterns, algorithms, findings store, sessions."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from bytefold.functions import crypto as X
from bytefold.functions.formats import detect_format, little_endian, parse_hex_pattern
from bytefold.operators import algorithms as A
from bytefold.operators import hits as H
from bytefold.operators import intervals as I
from bytefold.operators import structures as T
from bytefold.plans import library as L
from bytefold.plans import patterns as P
from bytefold.plans import report as R
from bytefold.sources import catalog as K
from bytefold.sources.findings import FindingsStore
from bytefold.streaming import sessions as W


def test_dump_names_and_phases(spark):
    names = ["20240101_120000_1_pre_handshake.dump", "20240101_120001_1_post_handshake.msl", "20240101_120002_1_pre_abort.dump", "20240101_120003_1_pre_x.dump", "20240101_120004_1_pre_cleanup.dump", "20240101_120005_1_pre_server_key_update.dump", "gdb_raw.bin", "notes.txt"]
    df = spark.createDataFrame([(f"/r/TLS13/s/openssl/openssl_run_13_2/{n}",) for n in names], "path string")
    rows = K.parse_runs(K.parse_dumps(df))
    assert rows.count() == 7 and rows.filter("kind = 'gdb_raw'").first().phase_prefix == "full"
    assert {(r.library, r.version, r.run_number) for r in rows.collect()} == {("openssl", "13", 2)}
    timed = rows.filter("phase_prefix <> 'full'")
    got = {r.phase_name: r.canonical_phase for r in K.normalize_phases(timed, ["library", "run_number"]).filter("phase_prefix = 'pre'").collect()}
    assert got == {"handshake": "pre_handshake_end", "abort": "pre_second_event", "x": "pre_event_3", "cleanup": "pre_cleanup", "server_key_update": "pre_key_update"}
    named = K.normalize_phases(timed, ["library", "run_number"])
    assert K.dump_for_phase(named, ["library"], "pre_second_event").first().phase_name == "abort"
    assert K.dataset_summary(rows).first().dumps == 7


def test_keylog(spark):
    good = "CLIENT_RANDOM " + "ab" * 32 + " " + "cd" * 48
    lines = [good, good, "CLIENT_RANDOM zz cd", "CLIENT_RANDOM ab", "NO_SUCH " + "ab " + "cd", "", None, "  AES256_KEY   00  ff "]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    assert sorted(r.secret_type for r in K.parse_keylog(df).collect()) == ["AES256_KEY", "CLIENT_RANDOM"]
    assert K.parse_keylog(df, "TLS 1.3").count() == 0


def test_sidecars(spark):
    rows = [("/a/b.meta", "x = 1\n# no\nbad\ny=a=b\nx=2"), ("/a/keylog.json", "{}"), ("/c/s.json", '{"k": "v", "n": 3, "l": [1], "o": {"p": 1}}'), ("/c/t.meta", "z=1"), ("/e/f.json", "[1]"), ("/g/h.txt", "x")]
    got = {r.folder: r.fields for r in K.parse_sidecars(spark.createDataFrame(rows, "path string, content string")).collect()}
    assert got["/a"] == {"x": "2", "y": "a=b"} and got["/c"] == {"k": "v", "n": "3"} and got["/e"] == {} and "/g" not in got
    df = spark.createDataFrame([("0x1F", "abc"), ("12", "abcd"), ("x", None)], "n string, h string")
    got = df.select(K.flexible_int(F.col("n")).alias("n"), K.padded_hex(F.col("h")).alias("h")).collect()
    assert [r.n for r in got] == [31, 12, None] and bytes(got[0].h) == b"\x0a\xbc"


def test_formats(spark):
    pe = b"MZ" + bytes(58) + (64).to_bytes(4, "little") + b"PE\0\0" + bytes(20) + b"\x0b\x02"
    cases = [(b"\x7fELF\x02", "elf64"), (b"\x7fELF\x01", "elf32"), (b"\x7fELF", "elf"), (b"MEMSLICE", "msl"), (pe, "pe64"), (pe[:-2] + b"\x0b\x01", "pe32"), (b"MZ" + bytes(70), None), (b"\xca\xfe\xba\xbe\0\0\0\x02", "macho_fat"), (b"\xca\xfe\xba\xbe\0\0\0\x34", "java_class"), (b"\x30\x82\x01\0", "asn1_der"), (b"\x30\x82\0\x01", None), (b"\x1f\x8b\x08\0", "gzip"), (b"abc", None), (b"", None), (b"%PDF-", "pdf"), (b"MZ" + bytes(58) + b"\xff\xff\xff\xff", None)]
    df = spark.createDataFrame([(i, bytearray(x)) for i, (x, _) in enumerate(cases)], "i int, d binary")
    got = {r.i: r.f for r in df.select("i", detect_format(F.col("d")).alias("f")).collect()}
    assert [got[i] for i in range(len(cases))] == [w for _, w in cases]
    row = spark.createDataFrame([(bytearray(b"\x01\x02" + b"\xff" * 8), "aa Bb", "x")], "d binary, h string, b string").select(little_endian(F.col("d"), 0, 2).alias("a"), little_endian(F.col("d"), 2, 8).alias("u"), parse_hex_pattern(F.col("h")).alias("h"), parse_hex_pattern(F.col("b")).alias("n")).first()
    assert (row.a, int(row.u), bytes(row.h), row.n) == (0x0201, 2**64 - 1, b"\xaa\xbb", None)


def test_structures():
    lib = T.builtin()
    data = bytes(16) + (0x0303).to_bytes(2, "big") + bytes(range(1, 47)) + bytes(64)
    best = T.best_match(data, 16, [s for s in lib if "tls12" in s.tags], "TLS")
    assert best[0].name in ("tls12_key_block_aes128_gcm", "tls12_key_block_aes256_gcm", "tls12_master_secret", "tls12_pre_master_secret_rsa") and best[2] == 1.0
    sizes = {s.name: (s.total_size, len(s.fields)) for s in lib}
    assert sizes["tls12_master_secret"] == (48, 1) and sizes["tls12_key_block_aes128_gcm"] == (40, 4) and sizes["tls12_key_block_aes256_gcm"] == (72, 4)
    probed13 = [s for s in lib if s.name.startswith("tls13_")]
    assert len(probed13) == 12 and all(s.auto_offsets and s.fields[0].size_choices == (48, 32) for s in probed13)
    assert all(T.structure_named(f"ssh2_{n}").fields[0].size_choices == (64, 32, 20) for n in ("session_id", "exchange_hash"))
    assert T.structure_named("boringssl_tls13_handshake_traffic_secrets_sha256").stability == "experimental" and {"aes256_key", "aes_gcm_iv", "elf64_header"} <= set(sizes)
    assert T.best_match(b"\x7fELF\x02" + bytes(11) + b"\x02\0" + bytes(60), 0, [s for s in lib if s.name == "elf64_header"])[2] == 1.0
    probed = T.Structure("p", 32, (T.Field("s", "bytes", 0, 32, {"not_zero": True}, (48, 32)),), auto_offsets=True)
    assert T.overlay(b"\1" * 32 + bytes(16), probed)[1] == 32 and T.overlay(b"\1" * 48, probed)[1] == 48
    assert T.value_of(b"\1\2\3", T.Field("x", "uint32_be", 0, 3), 0, 3) == 0x030201
    assert not T.holds(None, {}) and T.holds(5, {"min": 5, "max": 5}) and not T.holds(0, {"not_zero": True})
    assert T.holds(b"\x05", {"byte_in": {"0": [4, 5]}}) and not T.holds(b"", {"byte_equals": {"0": 1}})
    assert (T.variant(32), T.variant(7)) == ("SHA-256", "7 bytes")
    text = json.dumps({"name": "n", "total_size": 4, "fields": [{"name": "a", "type": "uint32_le", "offset": 0, "size": 4}]})
    assert T.from_json(T.to_json(T.from_json(text))) == T.from_json(text)
    for bad in ({}, {"name": "n", "total_size": 0, "fields": []}, {"name": "n", "total_size": 2, "fields": [{"name": "a", "type": "q", "offset": 0, "size": 4}, {"name": "a", "type": "uint8", "offset": 0, "size": 1}, {}]}):
        assert T.validate(bad)


def test_key_derivation():
    # RFC 5869, first test case
    prk = X.hkdf_extract(bytes(range(13)), b"\x0b" * 22)
    assert prk.hex().startswith("077709362c2e32df0ddc3f0dc47bba63")
    assert X.hkdf_expand(prk, bytes(range(0xF0, 0xFA)), 42).hex().startswith("3cb25f25faacd57a90434f64d0362f2a")
    assert len(X.tls12_prf(b"s", b"l", b"seed", 100)) == 100
    first = hashlib.sha256(X.ssh_mpint(b"\x80") + b"H" + b"A" + b"S").digest()
    assert X.ssh_key(b"\x80", b"H", "A", b"S", 40)[:32] == first and X.ssh_mpint(b"\x80")[:5] == b"\0\0\0\x02\0"
    assert [k for k, _ in X.expand_secret("CLIENT_TRAFFIC_SECRET_0", b"x" * 32)] == ["CLIENT_TRAFFIC_SECRET_0_KEY_128", "CLIENT_TRAFFIC_SECRET_0_KEY_256", "CLIENT_TRAFFIC_SECRET_0_IV", "CLIENT_TRAFFIC_SECRET_0_FINISHED"]
    assert len(X.expand_secret("SSH2_SESSION_KEY", b"x")) == 6 and X.expand_secret("EXPORTER_SECRET", b"x") == []
    a = b"k" * 32
    b = X.hkdf_expand_label(a, "derived", bytes(32), 32)
    assert X.linked(a, b, "TLS13") == X.linked(b, a, "13") == 0.95 and X.linked(a, a[::-1], "SSH2") == 0.0
    with pytest.raises(NotImplementedError):
        X.require("Argon2id")


def test_aes(spark):
    df = spark.createDataFrame([(bytearray(b"k" * 32),), (bytearray(b"j" * 32),), (bytearray(b"short"),), (None,)], "k binary")
    plain = F.encode(F.lit("plain"), "UTF-8")
    sealed = X.encrypt(F.lit(b"k" * 32), plain)
    assert [r.v for r in df.select(X.verifies(F.col("k"), sealed, plain).alias("v")).collect()] == [True, False, None, None]


def test_patterns(spark):
    data, mask = bytes.fromhex("aabb2a00ff"), [True, True, False, True, True]
    p = P.make_pattern(data, mask, "7 a-b")
    assert p["wildcard_pattern"] == "aa bb ?? 00 ff" and p["static_ratio"] == 0.8
    assert P.make_pattern(data, [False] * 5) is None and P.make_pattern(b"", []) is None
    row = spark.createDataFrame([(bytearray(data), mask)], "d binary, m array<boolean>").select(P.pattern_columns(F.col("d"), F.col("m")).alias("p")).first().p
    assert row.wildcard_pattern == p["wildcard_pattern"] and row.hex_pattern == p["hex_pattern"] and row.static_ratio == 0.8
    assert P.anchors([True] * 4 + [False] + [True] * 3) == [(0, 4)]
    assert P.longest_needle("aa ?? bb cc ?? dd ee") == ("bbcc", 2)
    assert P.wildcard_regex("2a ?? 41") == b"\\*.A"
    assert P.identifier("7 a-b") == "r_7_a_b" and P.class_name("my pattern-x") == "MyPatternX" and P.identifier("") == "unnamed_rule"
    rule = P.yara_rule(p)
    assert rule.startswith("rule r_7_a_b\n{") and "$key = { AA BB ?? 00 FF }" in rule and rule.endswith("condition:\n        $key\n}")
    assert json.loads(P.json_signature(p, "openssl", "13"))["applicable_to"] == {"libraries": ["openssl"], "protocol_versions": ["13"]}
    compile(P.volatility_plugin(p), "plugin.py", "exec")
    df = spark.createDataFrame([("g", 1, bytearray(b"abcdef")), ("g", 2, bytearray(b"abXd")), ("g", 3, bytearray(b"a"))], "grp string, rank int, data binary")
    got = P.static_mask(df, 1, 4).first()
    assert bytes(got.data) == b"bcde" and got["mask"] == [True, False, True, True]


def test_best_region_export(spark):
    rows = spark.createDataFrame([("", o, 0.0 if not 40 <= o < 72 else 9000.0) for o in range(128)], "grp string, off bigint, variance double")
    regions = spark.createDataFrame([("", 40, 72, 32), ("", 100, 116, 16)], "grp string, start bigint, end bigint, length bigint")
    out = P.export_best_region(rows, bytes(range(128)), regions, "yara", context=16)
    assert out["region"] == {"offset": 24, "length": 64, "key_start": 40, "key_end": 72} and out["pattern"]["static_count"] == 32
    assert P.export_best_region(rows, b"", regions.limit(0)) is None
    with pytest.raises(ValueError):
        P.export_best_region(rows, b"", regions, "elf")


def images(spark, *datas):
    return spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(datas)], "dump_id int, data binary")


def test_algorithms(spark):
    rng = random.Random(8)
    key = bytes(rng.sample(range(256), 32))
    df = images(spark, bytes(100) + key + bytes(100), bytes(100) + key[::-1] + bytes(100))
    hits = A.REGISTRY["exact_match"].run(df, A.Context(secrets=[("k", key), ("absent", b"zzzz")])).collect()
    assert [(r.dump_id, r.off, r.confidence) for r in hits] == [(0, 100, 0.5)]
    scan = A.entropy_scan(df, A.Context(extra={"window_sizes": [32]})).filter("dump_id = 0").collect()
    # A zero before the key makes the window one byte earlier as good, and the first one stays.
    assert len(scan) == 1 and scan[0].off == 99 and scan[0].confidence == 0.625
    flip = images(spark, bytes(100) + b"\x00" * 32 + bytes(100), bytes(100) + b"\xff" * 32 + bytes(100))
    got = A.differential(flip, A.Context()).collect()
    assert [(r.off, r.length, r.confidence) for r in got] == [(100, 32, 1.0)]
    assert A.differential(images(spark, b"x" * 64), A.Context()).count() == 0
    narrow = images(spark, bytes(110), bytes(100) + b"\xff" * 10)
    assert A.differential(narrow, A.Context()).count() == 0
    b = X.hkdf_expand_label(key, "derived", bytes(32), 32)
    probe = X.probe(b"p" * 32, "TLS13", 32)
    dump = images(spark, key + b + b"p" * 32 + probe)
    cand = spark.createDataFrame([(0, 0, bytearray(key)), (0, 32, bytearray(b)), (0, 64, bytearray(b"p" * 32)), (0, 5, bytearray(b"short"))], "dump_id int, off bigint, value binary")
    got = {r.off: r.confidence for r in A.constraint_validator(dump, A.Context(protocol_version="TLS13", secrets=[("t", key)], extra={"candidates": cand})).collect()}
    assert got == {0: 1.0, 32: 0.95, 64: 0.70}
    pattern = {"name": "p", "applicable_to": {"libraries": ["openssl"]}, "key_spec": {"length": 32, "entropy_min": 4.9}, "pattern": {"before": [{"offset": -1, "bytes": "00"}]}}
    assert [r.off for r in A.pattern_match(df, A.Context(library="openssl", extra={"patterns": [pattern]})).filter("dump_id = 0").collect()] == [99]
    assert A.pattern_match(df, A.Context(library="other", extra={"patterns": [pattern]})).count() == 0
    header = b"\x7fELF\x02" + bytes(11) + b"\x02\0" + bytes(100)
    got = A.structure_scan(images(spark, header), A.Context(extra={"entropy_threshold": 4.0})).filter("label = 'struct:elf64_header'").collect()
    assert [(r.off, r.confidence) for r in got] == [(0, 1.0)]
    both = A.run_all(df, A.Context(secrets=[("k", key)]), ["exact_match", "change_point"])
    assert {r.algorithm for r in both.select("algorithm").distinct().collect()} >= {"exact_match"}
    assert not A.available("differential", 1, True, True) and A.available("entropy_scan", 1, False, False)
    assert len(A.REGISTRY) == 8 and [a.name for a in A.by_mode("known_key")] == ["exact_match"]


def test_greedy_merge_is_the_sequential_one(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(3), rng.randrange(120), rng.choice([8, 16]), rng.random()) for _ in range(200)]
    want = []
    for r in sorted(rows, key=lambda r: (r[0], r[1], -r[2])):
        if want and want[-1][0] == r[0] and r[1] < want[-1][1] + want[-1][2]:
            if r[3] > want[-1][3]:
                want[-1] = r
        else:
            want.append(r)
    df = spark.createDataFrame(rows, "dump_id int, off bigint, length int, confidence double")
    got = sorted(tuple(r) for r in A.merge_overlapping(df).collect())
    assert got == sorted(want)


def test_interval_joins(spark):
    rng = random.Random(6)
    left = [("g", i, rng.randrange(100), 0) for i in range(40)]
    left = [(g, i, a, a + rng.randrange(0, 30)) for g, i, a, _ in left]
    right = [("g", i, a, a + rng.randrange(1, 40)) for i, a in enumerate(rng.sample(range(100), 20))]
    ls, rs = spark.createDataFrame(left, "g string, id int, s bigint, e bigint"), spark.createDataFrame(right, "g string, id int, s bigint, e bigint")
    want = {(a[1], b[1]) for a in left for b in right if a[2] < a[3] and a[2] < b[3] and b[2] < a[3]}
    rows = I.overlap_join(ls, rs, ["g"], ("s", "e"), ("s", "e")).collect()
    assert {(r.id, r.r_id) for r in rows} == want and len(rows) == len(want)
    semi = I.overlap_join(ls, rs, ["g"], ("s", "e"), ("s", "e"), how="left_semi").collect()
    assert {r.id for r in semi} == {a for a, _ in want} and len(semi) == len({a for a, _ in want})
    points = spark.createDataFrame([("g", p) for p in range(0, 140, 3)] + [("h", 1)], "g string, p bigint")
    got = {(r.p, r.r_id) for r in I.point_join(points, rs, ["g"], "p", ("s", "e")).collect()}
    assert got == {(p, b[1]) for p in range(0, 140, 3) for b in right if b[2] <= p < b[3]}
    owners = I.owner_of(points, rs.withColumn("n", F.col("id").cast("string")), ["g"], "p", "s", "e", "n").collect()
    assert len(owners) == points.count()
    for r in owners:
        below = [b for b in right if r.g == "g" and b[2] <= r.p]
        last = max(below, key=lambda b: (b[2], str(b[1])), default=None)
        assert r.owner == (str(last[1]) if last and r.p < last[3] else None)
    keys = spark.createDataFrame([("a", 1, 9), ("b", 1, 9), ("a", 2, 9), ("b", 2, 8), ("a", 3, 9)], "g string, k int, c int")
    assert [r.k for r in I.common_keys(keys, "g", ["k"], "c").collect()] == [1]


def test_hit_analytics(spark):
    rows = [(100, "k", 1, "x", 1.0), (100, "k", 2, "y", 0.5), (200, "k", 3, "x", 1.0), (100, "k", 2, "y", None)]
    df = spark.createDataFrame(rows, "off bigint, secret_type string, run_id int, library string, confidence double")
    assert [(r.off, r.run_count, r.lib_count) for r in H.key_candidates(df).collect()] == [(100, 2, 2)]
    assert [r.libraries for r in H.cross_library(df).collect()] == ["x,y"]
    assert {r.off: r.confidence_variance for r in H.offset_variance(df).collect()} == {100: 0.125, 200: None}
    assert {r.off: r.confidence_variance for r in H.offset_variance(df, True).collect()}[200] == 0.0
    assert H.hit_summary(df).first().asDict() == {"total_hits": 4, "unique_offsets": 2, "unique_libraries": 2, "unique_types": 1}
    m = H.detection_metrics(df.limit(0).withColumn("g", F.lit(1)), ["g"], F.lit(True), F.lit(True))
    assert m.count() == 0
    roles = spark.createDataFrame([(1, o, 5) for o in range(6)] + [(2, o, 5 if o != 4 else 6) for o in range(5)], "run int, off bigint, v int").withColumn("g", F.lit(0))
    assert [r.role for r in H.classify_runs(roles, ["g"], "run", 0, 2).orderBy("off").collect()] == ["key", "key", "same", "same", "different", "different"]


def test_library_analysis(spark):
    secret = b"S" * 32
    derived = dict(X.expand_secret("CLIENT_TRAFFIC_SECRET_0", secret))["CLIENT_TRAFFIC_SECRET_0_IV"]
    secrets = spark.createDataFrame([("lib", 1, "CLIENT_TRAFFIC_SECRET_0", bytearray(secret)), ("lib", 2, "K", bytearray(b"T" * 8)), ("other", 1, "K", bytearray(b"abc"))], "library string, run_number int, secret_type string, secret_value binary")
    chunks = spark.createDataFrame([("lib", 1, "d1", 0, 60, bytearray(secret + derived + b"T" * 8)), ("lib", 2, "d2", 0, 60, bytearray(secret + b"T" * 8)), ("other", 1, "d3", 0, 3, bytearray(b"xyz"))], "library string, run_number int, dump_id string, base_off bigint, size int, data binary")
    own = {(r.dump_id, r.secret_type, r.off) for r in L.library_hits(chunks, secrets).collect()}
    assert own == {("d1", "CLIENT_TRAFFIC_SECRET_0", 0), ("d1", "CLIENT_TRAFFIC_SECRET_0_IV", 32), ("d2", "K", 32)}
    first = {(r.dump_id, r.secret_type) for r in L.library_hits(chunks, secrets, "first_run", False).collect()}
    assert first == {("d1", "CLIENT_TRAFFIC_SECRET_0"), ("d2", "CLIENT_TRAFFIC_SECRET_0")}
    assert {r.library: r.hits for r in L.library_report(L.library_hits(chunks, secrets)).collect()} == {"lib": 3, None: 3}


def test_findings_store(spark, tmp_path):
    store = FindingsStore(spark, str(tmp_path))
    assert store.table("findings").count() == 0
    project = store.create_project("p")
    run = store.start_run(project, store.add_dump(project, "/x", "raw", 5))
    store.add_findings(run, spark.createDataFrame([("k", 5, 32), ("k", 9, 32), ("j", 1, 16)], "secret_type string, off bigint, length int"))
    store.finish_run(run)
    assert store.table("analysis_runs").count() == 2 and [r.status for r in store.runs().collect()] == ["completed"]
    assert {r.finding_type: r["count"] for r in store.finding_counts(run).collect()} == {"k": 2, "j": 1}
    assert store.query_findings(run, "j").first().byte_offset == 1 and store.timeline(project).count() == 1
    hits = spark.createDataFrame([("a", "k", 1, 4), ("b", "k", 2, 4)], "library string, secret_type string, off bigint, length int")
    assert len(store.persist_hits(hits)) == 2 and store.list_projects().count() == 3


def test_sessions(spark, tmp_path):
    rng = random.Random(2)
    datas = [bytes(rng.randrange(256) for _ in range(100)) for _ in range(4)]
    rows = [(f"d{i}", bytearray(x)) for i, x in enumerate(datas)]
    schema = "dump_id string, data binary"
    for i, r in enumerate(rows):
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = W.ConsensusSession(spark, size=90)
    s.follow(spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in")))
    batch = W.ConsensusSession(spark, size=90)
    batch.add(spark.createDataFrame(rows, schema))
    key = lambda x: [(r.off, r.n, r.variance) for r in x.live().orderBy("off").collect()]
    assert key(s) == key(batch) and len(key(s)) == 90
    stats = s.stats()
    assert stats["images"] == 4 and len(stats["top"]) == 5 and stats["top"][0][1] == stats["max_variance"]
    short = spark.createDataFrame([("short", bytearray(b"x"))], schema)
    with pytest.raises(ValueError):
        s.add(short)
    s.short = "skip"
    s.add(short)
    assert s.stats()["images"] == 4
    s.finalize()
    with pytest.raises(RuntimeError):
        s.add(short)
    empty = W.ConsensusSession(spark)
    assert empty.stats() == {"images": 0, "mean_variance": 0.0, "max_variance": 0.0, "top": []}


def test_progress(spark):
    ev = spark.createDataFrame([("t", i) for i in range(1, 31)] + [("u", 1)], "task_id string, seq bigint").withColumn("received_at", F.timestamp_seconds(F.col("seq") * 100))
    assert [r.seq for r in W.replay(ev, "t", 25, 10).collect()] == [26, 27, 28, 29, 30]
    assert [r.seq for r in W.replay(ev, "t", 0, 3).collect()] == [28, 29, 30]
    assert [r.task_id for r in W.idle_sessions(ev, 1000).collect()] == ["u"]
    assert W.run_tagged(spark, "tag", lambda: spark.range(3).count()) == 3


def test_reports(spark, tmp_path):
    assert R.jsonable({"a": b"\x01", "s": {2, 1}, "p": tmp_path, "t": (b"",)}) == {"a": "01", "s": [1, 2], "p": str(tmp_path), "t": [""]}
    row = R.json_rows(spark.createDataFrame([(bytearray(b"\xab"), None)], "b binary, n int")).first().value
    assert json.loads(row) == {"b": "ab", "n": None}
    for pack in (True, False):
        R.save_session({"session_name": "s"}, str(tmp_path / f"x{pack}.session"), pack)
        assert R.load_session(str(tmp_path / f"x{pack}.session"))["session_name"] == "s"
    (tmp_path / "bad.session").write_text('{"schema_version": 9}')
    assert len(R.list_sessions(str(tmp_path))) == 2
    assert R.delete_session("xTrue", str(tmp_path)) and not R.delete_session("../x", str(tmp_path))


def test_all_queries_run(spark, data):
    from bytefold.queries import core

    assert set(core.oracle_sql()) <= set(core.queries())
    for name, f in core.queries().items():
        df = f(spark, data)
        assert len(set(df.columns)) == len(df.columns), name
        df.count()


def test_ring_holds_distinct_messages(spark):
    rows = [("t", q, k, 10 * q + c) for q in range(1, 41) for k in ("progress", "done") for c in range(3)]
    ev = spark.createDataFrame(rows, "task_id string, seq bigint, type string, delivery_id bigint")
    assert [(r.seq, r.delivery_id) for r in W.replay(ev, "t", 0, 4).collect()] == [(39, 390), (39, 390), (40, 400), (40, 400)]
    assert W.in_ring(ev).count() == 80 and W.RING == 512
    many = spark.range(1, 601).select(F.lit("u").alias("task_id"), F.col("id").alias("seq"))
    assert W.in_ring(many).agg(F.min("seq"), F.count("seq")).first()[:] == (89, 512)


def test_event_replay_counts(spark, data):
    from bytefold.queries.findings import event_replay

    got = event_replay(spark, data).collect()
    assert got and all(r.kept == min(r.messages, 512) for r in got) and max(r.kept for r in got) > 20


def test_first_verified_key(spark):
    from bytefold.functions.crypto import CHECK_IV, encrypt
    from bytefold.operators import verification as V
    from bytefold.operators.chunks import chunked

    key, plain = bytes(range(32)), b"known"
    image = bytearray(1024)
    image[0x100:0x120] = key
    image[0x1F0:0x210] = key
    df = spark.createDataFrame([("a", image), ("b", bytearray(1024)), ("c", bytearray(64)), ("d", None)], "dump_id string, data binary")
    sealed = bytes(spark.range(1).select(encrypt(F.lit(key), F.lit(plain))).first()[0])
    places = spark.createDataFrame([(i, o, p) for i in "abcd" for p, o in enumerate((0, 0x1F0, 0x100, 0x800))], "dump_id string, off bigint, position int")
    for chunk in (1 << 16, 256):
        chunks = chunked(df, 31, chunk)
        assert [(r.dump_id, r.off, r.key_hex) for r in V.first_verified(chunks, places, sealed, plain, chunk=chunk).collect()] == [("a", 0x1F0, key.hex())]
        assert [r.off for r in V.first_verified(chunks, places.drop("position"), sealed, plain, chunk=chunk).collect()] == [0x100]
        assert V.verified(chunks, places, b"ct", plain, chunk=chunk).count() == 0
    V.register_verifier(V.Verifier("first-byte", 1, lambda k, c, e, iv: k == c, lambda k, p, iv: k))
    assert V.first_verified(chunked(df), places, b"\x01", b"", "first-byte").count() == 0 and CHECK_IV
    del V.VERIFIERS["first-byte"]


def test_views_of_results(spark):
    from bytefold.operators import results as V

    rows = spark.createDataFrame([("a", 5, 32, 0.5, "x", "one"), ("a", 1, 48, 0.9, "y", "two"), ("b", 7, 16, None, "X y", "one"), ("b", 9, 8, 0.9, None, "two")], "dump_id string, off bigint, length int, confidence double, label string, algorithm string")
    assert [r.off for r in V.best_first(rows).collect()] == [1, 9, 5, 7]
    assert [r.off for r in V.ordered(rows, "length").collect()] == [9, 7, 5, 1]
    assert V.of_algorithms(rows, ["one"]).count() == 2 and V.of_algorithms(rows).count() == 4 and V.of_algorithms(rows, []).count() == 0
    assert {r.algorithm: r.hits for r in V.counts_by_algorithm(rows).collect()} == {"one": 2, "two": 2}
    assert [r.off for r in V.containing(rows, "x", "label").orderBy("off").collect()] == [5, 7] and V.containing(rows, "", "label").count() == 4
    assert [r.off for r in V.first_of_each(rows, ["dump_id"], ["off"], 1).orderBy("off").collect()] == [1, 7]
    assert [r.off for r in V.next_page(rows, 1, 2).collect()] == [5, 7] and [r.off for r in V.next_page(rows, None, 1).collect()] == [1]
    assert V.where_equal(rows, dump_id="b", label=None).count() == 1
    for bad in ((-1, 5), (0, 0), (0, V.RANGE_LIMIT + 1)):
        with pytest.raises(ValueError):
            V.class_range(rows, *bad)
    with pytest.raises(ValueError):
        V.ordered(rows, "colour")


def test_run_metadata_and_levels(spark):
    good = {"run_id": "r", "master_key_hex": "0xabc", "aslr_base": "0x400000", "pid": "7", "dumps": {"memslicer": {"path": "run_0001/m.msl", "size": "0x10"}, "gcore": {"path": "else/g.core", "size": 5}, "other": {"path": "/abs/o"}, "none": {}}}
    files = [("/d/run_0001/meta.json", json.dumps(good)), ("/d/run_0002/meta.json", "{}"), ("/d/run_0003/meta.json", "no json"), ("/d/run_0004/meta.json", "[1]"), ("/d/run_0001/x.json", "{}")]
    df = spark.createDataFrame([(p, bytearray(t.encode())) for p, t in files], "path string, content binary")
    listing = spark.createDataFrame([("/d/run_0001/m.msl",)], "path string")
    got = {r.run_dir: r for r in K.run_metadata(df, listing).collect()}
    one = got["/d/run_0001"]
    assert (one.run_id, bytes(one.master_key), one.aslr_base, one.pid) == ("r", b"\x0a\xbc", 0x400000, 7)
    assert {k: (v.path, v.size) for k, v in one.dumps.items()} == {"msl": ("/d/run_0001/m.msl", 16), "gcore": ("/d/run_0001/g.core", 5), "other": ("/abs/o", 0), "none": ("/d/run_0001", 0)}
    assert set(got) == {"/d/run_0001", "/d/run_0002"} and got["/d/run_0002"].run_id == "run_0002" and not got["/d/run_0002"].dumps
    runs = spark.createDataFrame([("lib", "1", n, f"d{i}") for i, n in enumerate((3, 1, 2, 1))], "library string, version string, run_number int, dump_id string")
    assert sorted((r.run_number, r.dumps) for r in K.discover_runs(runs, 2).collect()) == [(1, 2), (2, 1)] and K.discover_runs(runs).count() == 3
    path = "/data/TLS13/scen/lib/lib_run_13_1/20240101_000000_0_pre_x.dump"
    roots = ["/data", "/data/TLS13", "/data/TLS13/scen", "/data/TLS13/scen/lib", "/data/TLS13/scen/lib/lib_run_13_1"]
    levels = {r.root: r.level for r in K.scan_level(spark.createDataFrame([(r, path) for r in roots] + [("/x", "/x/a.txt")], "root string, path string")).collect()}
    assert [levels[r] for r in roots] == ["dataset", "protocol", "scenario", "library", "run"] and levels["/x"] == "none"


def test_suggestions_and_plug_ins(spark, tmp_path, monkeypatch):
    import sys

    from bytefold.functions import crypto
    from bytefold.functions.formats import suggest_formats
    from bytefold.operators import algorithms as G

    pe = bytearray(256)
    pe[0:2], pe[0x3C], pe[128:132], pe[152:154] = b"MZ", 128, b"PE\0\0", b"\x0b\x02"
    cases = [b"\x7fELF\x02", b"\x1f\x8b00", bytes(pe), b"\xca\xfe\xba\xbe\0\0\0\x02", b"", b"zz"]
    df = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(cases)], "i int, d binary").select("i", suggest_formats(F.col("d")).alias("s"))
    got = {r.i: [(x.format, x.reason) for x in r.s] for r in df.collect()}
    assert got[0] == [("elf64", "magic at 0x0")] and got[1] == [("gzip", "magic at 0x0")] and got[2] == [("pe64", "PE signature at 0x80")]
    assert got[3] == [("macho_fat", "magic at 0x0")] and got[4] == got[5] == []
    folder = tmp_path / "plugpack"
    folder.mkdir()
    (folder / "__init__.py").write_text("")
    (folder / "kdf_mine.py").write_text("from bytefold.functions.crypto import derivation\n@derivation('mine', 'X', ('A',))\ndef f(kind, value, algo):\n    return [('A2', value)]\n")
    (folder / "algo_mine.py").write_text("from bytefold.operators.algorithms import algorithm\n@algorithm('mine', 'unknown_key')\ndef f(images, context):\n    return images\n")
    (folder / "kdf_broken.py").write_text("import no_such_module\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    with pytest.warns(UserWarning):
        assert crypto.discover_derivations("plugpack") == ["mine"]
    with pytest.warns(UserWarning):
        assert G.discover("plugpack") == ["mine"]
    try:
        assert crypto.expand_secret("A", b"z") == [("A2", b"z")] and [s.name for s in crypto.schemes_of("x")] == ["mine"]
        assert [r.y for r in spark.createDataFrame([("A",), ("B",), ("SSH2_SESSION_KEY",)], "t string").select(crypto.supports(F.col("t")).alias("y")).collect()] == [True, False, True]
        assert len(crypto.expand_secret("SSH2_SESSION_KEY", b"k")) == 6 and crypto.expand_secret("none", b"") == []
    finally:
        del crypto.DERIVATIONS["mine"], G.REGISTRY["mine"]
        sys.modules.pop("plugpack", None)


@pytest.mark.parametrize("seed", range(2))
def test_running_equals_a_window(spark, seed):
    """Groups within and across the sorted stretches, null groups, nulls and ties in the order."""
    from pyspark.sql import Window

    from bytefold.operators.running import running

    rng = random.Random(seed)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), rng.choice([None, *range(40)]), i, rng.choice([None, 1, 5]), rng.choice([None, None, f"x{i}"])) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, o int, i int, v int, s string")
    got = running(df, ["g"], ["o", "i"], "pos", {"sum": F.col("v")}, {"last": F.col("s")}).collect()
    w = Window.partitionBy("g").orderBy("o", "i")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("*", F.row_number().over(w).cast("bigint").alias("pos"), F.sum("v").over(upto).alias("sum"), F.last("s", True).over(upto).alias("last")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr) and len(got) == 400
    assert running(df.limit(0), ["g"], ["o", "i"], "pos").count() == 0


def test_uneven_intervals_join_without_explosion(spark):
    """One interval of 2^47 bytes among small ones makes a few rows, and no pair is lost or doubled."""
    from bytefold.operators import intervals as I

    rng = random.Random(8)
    left = [("a", i, s := rng.randrange(4000), s + rng.randrange(1, 70)) for i in range(120)] + [("a", 900, 0, 1 << 47), ("a", 901, 5, 5), ("a", 902, None, 9)]
    right = [("a", i, s := rng.randrange(4000), s + rng.choice([1, 3, 64, 1000])) for i in range(60)] + [("a", 700, -50, 1 << 46), ("b", 701, 0, 10)]
    schema = "g string, i int, s bigint, e bigint"
    a, b = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    want = sorted((x[1], y[1]) for x in left for y in right if x[0] == y[0] and None not in (x[2], x[3]) and x[2] < x[3] and x[2] < y[3] and y[2] < x[3])
    joined = I.overlap_join(a, b, ["g"], ("s", "e"), ("s", "e"))
    assert sorted((r.i, r.r_i) for r in joined.collect()) == want
    assert sorted(r.i for r in I.overlap_join(a, b, ["g"], ("s", "e"), ("s", "e"), how="left_semi").collect()) == sorted({i for i, _ in want})
    points = spark.createDataFrame([("a", p) for p in (-60, -50, 0, 17, 3999, 1 << 45, 1 << 46)], "g string, p bigint")
    got = sorted((r.p, r.r_i) for r in I.point_join(points, b, ["g"], "p", ("s", "e")).collect())
    assert got == sorted((p, y[1]) for p in (-60, -50, 0, 17, 3999, 1 << 45, 1 << 46) for y in right if y[0] == "a" and y[2] <= p < y[3])
