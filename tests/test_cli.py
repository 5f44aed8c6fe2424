"""The command line end to end on small files, sealed containers, navigation."""

import json
import os

import pytest
from pyspark.sql import functions as F

from bytefold import __main__ as cli
from bytefold.functions.navigate import navigate
from bytefold.plans import inspect
from bytefold.sources import codec as C
from bytefold.sources import container as M

KEY = bytes((37 * i + 11) % 256 for i in range(32))


@pytest.fixture
def run(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(cli, "local_session", lambda *a, **k: spark)

    def call(*argv):
        out = tmp_path / "out"
        code = cli.main([*map(str, argv), "-o", str(out)])
        text = out.read_text()
        return code, json.loads(text) if text[:1] in "[{n" and text != "null" else text

    return call


@pytest.fixture
def dumps(tmp_path):
    folder = tmp_path / "dumps"
    folder.mkdir()
    for i in range(5):
        key = bytes((b + 101 * i) % 256 for b in KEY)
        (folder / f"{i}.dump").write_bytes(b"HEADER__" * 8 + bytes(192) + key + b"TRAILER_" * 8 + bytes(192))
    return folder


def test_pipeline(run, dumps, tmp_path):
    code, out = run("consensus", dumps)
    assert code == 0 and [(r["start"], r["end"]) for r in out["volatile"]] == [(256, 288)]
    code, found = run("search-reduce", dumps)
    assert [(r["off"], r["length"]) for r in found["regions"]] == [(256, 32)]
    (tmp_path / "cand.json").write_text(json.dumps(found))
    tmp_path.chmod(0o700)
    (tmp_path / "oracle.py").write_text(f"def verify(x):\n    return bytes(x) == {KEY!r}\n")
    code, hits = run("brute-force", "--candidates", tmp_path / "cand.json", "--dump", dumps / "0.dump", "--oracle", tmp_path / "oracle.py")
    assert code == 0 and hits["tried"] == 1 and hits["hits"][0]["off"] == 256
    (tmp_path / "hits.json").write_text(json.dumps(hits))
    (tmp_path / "never.py").write_text("def verify(x):\n    return False\n")
    code, none = run("brute-force", "--candidates", tmp_path / "cand.json", "--dump", dumps / "0.dump", "--oracle", tmp_path / "never.py")
    assert code == 2 and none["top"][0]["off"] == 256
    code, sweep = run("n-sweep", "--runs-dir", dumps, "--n-values", "1,3,5", "--oracle", tmp_path / "oracle.py", "--output-dir", tmp_path / "rep")
    assert code == 0 and [p["n"] for p in sweep["points"]] == [1, 3, 5] and "offset 0x100" in sweep["headline"]
    assert {p.name for p in (tmp_path / "rep").iterdir()} == {"report.json", "report.md", "report.html"}
    code, plugin = run("emit-plugin", dumps, "--hit", tmp_path / "hits.json", "--name", "my_scan")
    compile(plugin, "p.py", "exec")
    assert "class MyScan" in plugin
    assert run("export", dumps, "--auto", "--format", "yara")[1].startswith("rule pattern")
    assert json.loads(json.dumps(run("export", dumps, "--offset", "0x0", "--length", 64, "--format", "json")[1]))["metadata"]["static_ratio"] == 1.0


def test_sessions_and_imports(run, dumps, tmp_path):
    run("consensus-begin", "--state", tmp_path / "s.json", "--size", 500)
    for i in range(3):
        stats = run("consensus-add", "--state", tmp_path / "s.json", dumps / f"{i}.dump")[1]
    assert stats["images"] == 3 and stats["max_variance"] > 0
    assert sum(c["offsets"] for c in run("consensus-finalize", "--state", tmp_path / "s.json")[1]["classes"]) == 500
    (tmp_path / "keylog.csv").write_text(f"line\nAES256_KEY 00 {KEY.hex()}\n")
    out = run("import", dumps / "0.dump", "--keylog", tmp_path / "keylog.csv")[1]["written"]
    kinds = [b["type"] for b in C.iter_blocks(open(out, "rb").read())]
    assert kinds == [0x30, 1, 0x20, C.END]
    assert len(run("import-dir", dumps, "--output-dir", tmp_path / "msl")[1]["written"]) == 5


def test_dataset(run, tmp_path):
    secret = "ab" * 48
    for n in (1, 2):
        d = tmp_path / "root" / "TLS12" / "s" / "openssl" / f"openssl_run_12_{n}"
        d.mkdir(parents=True)
        (d / "keylog.csv").write_text(f"line\nCLIENT_RANDOM {'00' * 32} {secret}\nbroken line\n")
        (d / f"20240101_12000{n}_1_post_handshake.dump").write_bytes(bytes(64) + bytes.fromhex(secret) + bytes(10))
    assert run("scan", "--root", tmp_path / "root")[1][0]["runs"] == 2
    code, out = run("analyze", tmp_path / "root", "--phase", "post_handshake")
    assert code == 0 and [(h["run_number"], h["off"]) for h in out["hits"]] == [(1, 64), (2, 64)]
    (tmp_path / "b.json").write_text(json.dumps({"jobs": [{"library_dirs": [str(tmp_path / "root")], "phase": "post_handshake"}, {"phase": "x"}]}))
    code, out = run("batch", "--config", tmp_path / "b.json")
    assert (out["succeeded"], out["failed"]) == (1, 1)


def test_verify(run, spark, tmp_path):
    from bytefold.functions.crypto import encrypt

    sealed = spark.range(1).select(encrypt(F.lit(KEY), F.lit(b"plain")).alias("c")).first().c
    (tmp_path / "d").write_bytes(b"xx" + KEY)
    assert run("verify", tmp_path / "d", "--offset", "2", "--ciphertext-hex", bytes(sealed).hex(), "--plaintext-hex", b"plain".hex())[0] == 0
    assert run("verify", tmp_path / "d", "--offset", "0", "--ciphertext-hex", bytes(sealed).hex(), "--plaintext-hex", b"plain".hex())[0] == 2


def test_sealed_containers(spark):
    w = C.ContainerWriter(pid=3, algorithm=1)
    w.add_record(0x0002, {"base": 1, "path": "m.so"})
    head, stream = w.sealed_parts(b"n" * 12)
    parts = spark.createDataFrame([("s", bytearray(head), bytearray(stream), bytearray(KEY), bytearray(b"n" * 12))], "dump_id string, head binary, stream binary, key binary, nonce binary")
    sealed = bytes(M.seal(parts).first().data)
    changed = sealed[:-1] + bytes([sealed[-1] ^ 1])
    other = sealed[:0x40] + b"\x02" + sealed[0x41:]
    rows = [("ok", sealed, KEY), ("wrong", sealed, KEY[::-1]), ("changed", changed, KEY), ("none", sealed, None), ("other", other, KEY), ("plain", w.to_bytes(), None)]
    df = spark.createDataFrame([(i, bytearray(d), None if k is None else bytearray(k)) for i, d, k in rows], "dump_id string, data binary, key binary")
    out = M.unlock(df)
    assert {r.dump_id: r.tag for r in out.collect()} == {"ok": "valid", "wrong": "corrupted", "changed": "corrupted", "none": "missing_key", "other": "unsupported", "plain": "not_encrypted"}
    found = M.records(M.blocks(out), 0x0002).collect()
    assert {(r.dump_id, r.path) for r in found} == {("ok", "m.so"), ("plain", "m.so")}


def test_navigation(spark):
    elf = b"\x7fELF\x02\x01\x01" + bytes(25) + (64).to_bytes(8, "little") + bytes(14) + (56).to_bytes(2, "little") + (1).to_bytes(2, "little") + bytes(6) + (1).to_bytes(4, "little") + bytes(60)
    assert [n[0] for n in navigate(elf, "elf64")] == ["ELF-64 Header", "PHDR[0] LOAD"]
    assert navigate(b"\x7fELF\x02", "elf64") == [] and navigate(b"", None) == []
    w = C.ContainerWriter(algorithm=1).to_bytes()
    df = spark.createDataFrame([("a", bytearray(elf)), ("b", bytearray(w)), ("c", bytearray(b"text")), ("d", None)], "dump_id string, data binary")
    assert {(r.dump_id, r.format) for r in inspect.navigation(df).collect()} == {("a", "elf64"), ("b", "msl")}


def test_looking_at_one_place(spark):
    r = inspect.region_report(b"\0" * 40 + b"hello world" + b"\0" * 40, 45, 32, 3500.0, [{"off": 40, "length": 11}, {"off": 0, "length": 2}])
    assert r["strings"] == ["hello world"] and len(r["hits"]) == 1 and r["variance_class"] == "high" and r["byte"] == ord(" ")
    row = spark.createDataFrame([(bytearray(b"abcdef"),)], "d binary").select(inspect.context_of(F.col("d"), F.lit(1), F.lit(2), 4).alias("c"), inspect.base64_window(F.col("d"), 0, 3).alias("b")).first()
    assert (bytes(row.c.before), bytes(row.c.key), bytes(row.c.after), row.b) == (b"\0\0\0a", b"bc", b"def\0", "YWJj")
    with pytest.raises(ValueError):
        inspect.base64_window(F.col("d"), 0, 1 << 20)
    df = spark.createDataFrame([(2, "7f000001" + "0" * 24, "1700000000000000000"), (10, "20010db8" + "0" * 23 + "1", "0"), (1, "ff", "0")], "f int, a string, t string").withColumn("t", F.col("t").cast("decimal(20,0)"))
    got = df.select(M.address_text(F.col("f"), F.col("a")).alias("a"), M.instant_text(F.col("t")).alias("t")).collect()
    assert [g.a for g in got] == ["127.0.0.1", "2001:db8::1", "ff"] and got[0].t.startswith("2023-11-14T22:13:20")
    assert inspect.headline([]).startswith("The sweep") and os.sep
