"""From images to a plugin in one call, refinement, experiments, armed predicates, artifacts."""

import hashlib

import pytest
from pyspark.sql import functions as F

from bytefold.operators import consensus as C
from bytefold.plans import pipeline as P

KEY = bytes((37 * i + 11) % 256 for i in range(32))


def images(spark, n=5, start=0):
    rows = [("g", i + 1, f"d{i + start}", bytearray(b"HEADER__" * 8 + bytes(192) + bytes((b + 101 * (i + start)) % 256 for b in KEY) + b"TRAILER_" * 8 + bytes(64))) for i in range(n)]
    return spark.createDataFrame(rows, "grp string, rank int, dump_id string, data binary")


def test_pipeline(spark):
    seen = []
    out = P.run_pipeline(images(spark), lambda: lambda v: bytes(v) == KEY, "my_key", ns=[1, 3, 5], progress=lambda s, d: seen.append(s))
    assert [(h["off"], h["size"]) for h in out["hits"]] == [(256, 32)] and out["top"] == []
    assert [p["hits"] for p in out["points"]] == [1, 1, 1] and "class MyKey" in out["plugin"] and "rule my_key" in out["rule"]
    assert seen == ["consensus", "reduce", "brute_force", "nsweep", "emit_plugin", "done"]
    refined = P.refine(spark, out["root"], images(spark, 2, 5))
    assert C.expand(refined, 1 << 16).agg(F.max("n")).first()[0] == 7
    none = P.run_pipeline(images(spark), lambda: lambda v: False)
    assert none["hits"] == [] and none["top"][0]["off"] == 256 and "plugin" not in none
    with pytest.raises(P.Stopped):
        P.run_pipeline(images(spark), lambda: lambda v: False, stop=lambda: True)


def test_experiment(spark):
    tools = images(spark).withColumn("tool", F.when(F.col("rank") <= 3, "a").otherwise("b")).select("tool", "dump_id", "data")
    got = {r.tool: (r.images, r.key_candidate > 0, r.regions, r.longest) for r in P.experiment(tools).collect()}
    assert got["a"] == (3, True, 1, 32) and got["b"][0] == 2


def test_registry(spark, tmp_path):
    reg = P.OracleRegistry(str(tmp_path / "o"))
    source = "def verify(x):\n    return x[0] == 1\n"
    up = reg.upload(source)
    assert up == {"id": hashlib.sha256(source.encode()).hexdigest(), "shape": "function"}
    with pytest.raises(PermissionError):
        reg.maker(up["id"])
    with pytest.raises(PermissionError):
        reg.arm(up["id"], "00")
    reg.arm(up["id"], up["id"])
    runs = reg.dry_run(up["id"], [b"\x01", b"\x02", b""])
    assert [r["ok"] for r in runs] == [True, False, False] and runs[2]["error"].startswith("IndexError")
    with pytest.raises(ValueError):
        reg.upload("x = 1")
    assert reg.delete(up["id"]) and not reg.delete(up["id"])


def test_artifacts(tmp_path):
    for i in range(3):
        (tmp_path / f"run{i}").mkdir()
        (tmp_path / f"run{i}" / "f").write_bytes(b"x" * 100)
        import os

        os.utime(tmp_path / f"run{i}", (i, i))
    assert P.register_artifacts(str(tmp_path / "run0")) == [{"name": "f", "size": 100, "sha256": hashlib.sha256(b"x" * 100).hexdigest()}]
    assert P.collect_garbage(str(tmp_path), 150) == ["run0", "run1"]
    assert P.collect_garbage(str(tmp_path), 150) == []
    P.save_json({"a": b"\x01"}, str(tmp_path / "j.json"))
    assert "01" in (tmp_path / "j.json").read_text()


def test_pipeline_of_unequal_groups(spark):
    both = images(spark).union(images(spark, 3, 10).withColumn("grp", F.lit("h")))
    out = P.run_pipeline(both, lambda: lambda v: len(v) == 32)
    assert {(s["grp"], s["n"]) for s in out["stages"]} == {("g", 5), ("h", 3)}
    assert {h["grp"] for h in out["hits"]} == {"g", "h"}


def test_pipeline_with_an_empty_first_image(spark):
    df = images(spark).withColumn("rank", F.col("rank") + 1).union(spark.createDataFrame([("g", 1, "none", None)], "grp string, rank int, dump_id string, data binary"))
    out = P.run_pipeline(df, lambda: lambda v: bytes(v) == KEY, "my_key")
    assert [(h["n"], h["off"]) for h in out["hits"]] == [(5, 256)]


def test_pipeline_says_how_many_hits_there_are(spark):
    rows = [("g", i + 1, f"d{i}", bytearray(bytes((37 * k + 11 + 85 * i) % 256 for k in range(9000)))) for i in range(3)]
    df = spark.createDataFrame(rows, "grp string, rank int, dump_id string, data binary")
    out = P.run_pipeline(df, lambda: lambda v: True, plugin_threshold=1e9)
    whole = spark.read.parquet(out["hits_path"])
    assert out["hit_count"] == whole.count() > len(out["hits"]) == 1000
