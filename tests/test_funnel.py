"""The funnel against a plain version, and the planted-key fixture."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bytefold.functions.kernels import aligned, as_bytes, covered, runs_of, shannon
from bytefold.plans import convergence as V
from bytefold.operators.chunks import chunked
from bytefold.operators.consensus import consensus_state, expand
from bytefold.plans.funnel import Params, brute_force, candidate_slices, load_oracle, nsweep, reduce_files, reduce_images, report_markdown, top_regions
from bytefold.sources.images import file_states, image_files

SCHEMA = "grp string, rank int, dump_id string, data binary"


def plain(datas, n, p):
    total = min(len(x) for x in datas[:n])
    stack = np.array([as_bytes(x)[:total] for x in datas[:n]]).astype(np.int64)
    var = (n * (stack * stack).sum(0) - stack.sum(0) ** 2) / float(n * n)
    ref = datas[0][:total]
    mask = np.ones(total, bool) if n < 3 else var >= p["min_variance"]
    dense = mask if n < 3 else aligned(mask, p["block_size"], p["alignment"], p["density_threshold"])
    w, a = p["entropy_window"], p["alignment"]
    profile = np.array([shannon(ref[k : k + w]) for k in range(0, total - w + 1, a)])
    keep = dense & covered(np.flatnonzero(profile.astype(np.float32) >= p["entropy_threshold"]) * a, w, total)
    regions = []
    for lo, hi in zip(*runs_of(keep)):
        if hi - lo >= p["min_region"]:
            inside = profile[-(-lo // a) : min(len(profile), hi // a)]
            regions.append((int(lo), int(hi - lo), round(float(inside.mean() if len(inside) else shannon(ref[lo:hi])), 4)))
    return (total, int(mask.sum()), int(dense.sum()), int(keep.sum())), regions


@pytest.fixture(scope="module")
def datas():
    rng = np.random.RandomState(3)
    base = rng.randint(0, 256, 3000).astype(np.uint8)
    base[500:1500] = 0
    out = []
    for i in range(6):
        x = base.copy()
        for lo, hi in ((600, 632), (1000, 1100), (250, 264), (2040, 2060), (2940, 3000)):
            x[lo:hi] = rng.choice([3, 250], hi - lo) if i else rng.randint(0, 256, hi - lo)
        out.append(x.tobytes()[: 3000 - 7 * i])
    return out


@pytest.mark.parametrize("chunk", [64, 256, 1 << 16])
def test_funnel_is_the_plain_one(spark, datas, chunk):
    df = spark.createDataFrame([("g", i + 1, f"d{i}", bytearray(d)) for i, d in enumerate(datas)], SCHEMA)
    ns = [1, 2, 3, 4, 6]
    stages, regions = reduce_images(df, ns, chunk)
    got = {r.n: (r.total, r.variance, r.aligned, r.high_entropy) for r in stages.collect()}
    found = {}
    for r in regions.collect():
        found.setdefault(r.n, []).append((r.off, r.length, round(r.mean_entropy, 4)))
    for n in ns:
        counts, want = plain(datas, n, Params())
        assert got[n] == counts
        assert sorted(found.get(n, [])) == want


def test_first_hits_of_every_pair(spark):
    """Several groups and Ns in one task: each pair's first hit, at any number of partitions."""
    rows = [(g, n, off, size, bytes([(off * 7 + size + n) % 256] * size)) for g in ("a", "b", "c") for n in (3, 5) for off in range(0, 400, 8) for size in (16, 32)]
    df = spark.createDataFrame(rows[::-1], "grp string, n int, off bigint, size int, value binary")
    accept = lambda: lambda v: v[0] % 5 == 0
    every = brute_force(df, accept).collect()
    want = {}
    for r in sorted(every, key=lambda r: (r.grp, r.n, r.off, r["size"])):
        want.setdefault((r.grp, r.n), (r.off, r["size"], bytes(r.value)))
    assert len(want) == 6
    for parts in (1, 8):
        got = {(r.grp, r.n): (r.off, r["size"], bytes(r.value)) for r in brute_force(df.repartition(parts), accept, exhaustive=False).collect()}
        assert got == want


def test_planted_key(spark):
    key = bytes(np.random.RandomState(1).permutation(256)[:32].astype(np.uint8))
    images = [("g", i + 1, str(i), bytearray(bytes(256) + (key if i == 0 else bytes((b + 128 * (i % 2) + 5 * i) % 256 for b in key)) + bytes(736))) for i in range(5)]
    df = spark.createDataFrame(images, SCHEMA)
    stages, regions = reduce_images(df)
    assert [(r.off, r.length) for r in regions.collect()] == [(256, 32)]
    assert stages.first().high_entropy == 32
    slices = candidate_slices(regions, df.filter("rank = 1"), [32, 16], 8, 64)
    assert sorted((r.off, r["size"]) for r in slices.collect()) == [(256, 16), (256, 32), (264, 16), (272, 16)]
    hits = brute_force(slices, lambda: lambda v: bytes(v) == key)
    assert [(r.off, r["size"]) for r in hits.collect()] == [(256, 32)]

    def fails():
        def oracle(value):
            raise RuntimeError

        return oracle

    assert brute_force(slices, fails).count() == 0  # an exception is a miss
    assert brute_force(slices, lambda: lambda v: True, exhaustive=False).count() == 1
    points = nsweep(df, [1, 3, 5], lambda: lambda v: bytes(v) == key).orderBy("n").collect()
    assert [(p.n, p.hits) for p in points] == [(1, 1), (3, 1), (5, 1)]
    assert points[1].candidates < points[0].total and all(p.tried == p.candidates for p in points)
    first = nsweep(df, [1, 3], lambda: lambda v: bytes(v) == key, exhaustive=False).orderBy("n").collect()
    assert [(p.n, p.hits, p.hit_off) for p in first] == [(1, 1, 256), (3, 1, 256)] and all(0 < p.tried <= p.candidates for p in first)
    assert report_markdown([p.asDict() for p in points]).count("\n") == 4
    assert top_regions(regions, ["grp"], 1).count() == 1


def test_bad_parameters(spark):
    df = spark.createDataFrame([], SCHEMA)
    with pytest.raises(ValueError):
        reduce_images(df, [1], entropy_threshold=6.0)
    with pytest.raises(TypeError):
        reduce_images(df, [1], no_such=1)
    stages, regions = reduce_images(df, [1, 3])
    assert stages.count() == 0 and regions.count() == 0


def test_oracle_file(tmp_path):
    path = tmp_path / "oracle.py"
    path.write_text("def verify(x):\n    return x == b'k'\n")
    tmp_path.chmod(0o700)
    assert load_oracle(str(path))(b"k")
    path.write_text("class O:\n    def __init__(s, c):\n        s.c = c\n    def verify(s, x):\n        return x == s.c['k']\ndef build_oracle(c):\n    return O(c)\n")
    assert load_oracle(str(path), {"k": b"z"})(b"z")
    path.chmod(0o666)
    with pytest.raises(PermissionError):
        load_oracle(str(path))


def test_convergence(spark):
    rng = np.random.RandomState(4)
    rows = [(r, o, int(rng.randint(0, 256)) if 16 <= o < 48 else 7) for r in range(1, 11) for o in range(96)]
    df = spark.createDataFrame(rows, "rank int, off bigint, v int")
    var = V.prefix_variance(df, [], [2, 3, 5, 10])
    stack = np.array([v for _, _, v in rows]).reshape(10, 96)
    for n in (2, 3, 5, 10):
        got = [r.variance for r in var.filter(f"n = {n}").orderBy("off").collect()]
        assert np.allclose(got, stack[:n].var(axis=0))
    truth = spark.createDataFrame([(o,) for o in range(16, 48)], "off bigint")
    entropy = spark.createDataFrame([(o,) for o in range(0, 96)], "off bigint")
    metrics = V.convergence(var, entropy, truth, [2, 3, 5, 10])
    best = metrics.filter("n = 10 and candidates = 'aligned'").first()
    assert best.fp == 0 and best.recall > 0.8
    stones = V.milestones(metrics, 0.8).first()
    assert stones.first_detection_n <= 10 and stones.first_fp_target_n is not None


def test_whole_groups_beside_the_checkpoints(spark, datas):
    sizes = {"a": 6, "b": 4, "c": 3}
    df = spark.createDataFrame([(g, i + 1, f"{g}{i}", bytearray(datas[i])) for g, n in sizes.items() for i in range(n)], SCHEMA)
    stages, _ = reduce_images(df, [2, 3], 256, whole=True)
    got = {(r.grp, r.n): (r.total, r.variance, r.aligned, r.high_entropy) for r in stages.collect()}
    assert got == {(g, n): plain(datas, n, Params())[0] for g, own in sizes.items() for n in {2, 3, own}}
    assert {(r.grp, r.n) for r in nsweep(df, [2, 3], chunk=256, whole=True).collect()} == set(got)


def test_prefix_variance_of_whole_groups(spark):
    rng = np.random.RandomState(5)
    stacks = {g: rng.randint(0, 256, (n, 40)) for g, n in (("a", 7), ("b", 3), ("c", 4))}
    rows = [(g, r + 1, o, int(v)) for g, s in stacks.items() for r, x in enumerate(s) for o, v in enumerate(x)]
    df = spark.createDataFrame(rows, "label string, rank int, off bigint, v int")
    var = V.prefix_variance(df, ["label"], [2, 3, 5], whole=True)
    got = {}
    for r in var.orderBy("off").collect():
        got.setdefault((r.label, r.n), []).append(r.variance)
    assert set(got) == {("a", 2), ("a", 3), ("a", 5), ("a", 7), ("b", 2), ("b", 3), ("c", 2), ("c", 3), ("c", 4)}
    assert all(np.allclose(v, stacks[g][:n].var(axis=0)) for (g, n), v in got.items())
    offsets = df.select("label", "off").distinct()
    metrics = V.convergence(var, offsets, offsets, None, ["label"])
    assert {(r.label, r.n) for r in metrics.collect()} == set(got)
    alone = V.prefix_variance(df.filter("label = 'a'"), [], [2], whole=True)
    assert {r.n for r in alone.collect()} == {2, 7}


def test_groups_of_unequal_size_without_checkpoints(spark, datas):
    sizes = {"a": 6, "b": 4, "c": 1}
    df = spark.createDataFrame([(g, i + 1, f"{g}{i}", bytearray(datas[i])) for g, n in sizes.items() for i in range(n)], SCHEMA)
    stages, regions = reduce_images(df, chunk=256)
    assert {(r.grp, r.n): (r.total, r.variance, r.aligned, r.high_entropy) for r in stages.collect()} == {(g, n): plain(datas, n, Params())[0] for g, n in sizes.items()}
    found = {}
    for r in regions.collect():
        found.setdefault(r.grp, []).append((r.off, r.length, round(r.mean_entropy, 4)))
    assert {g: sorted(found.get(g, [])) for g in sizes} == {g: plain(datas, n, Params())[1] for g, n in sizes.items()}


@pytest.mark.parametrize("empty", [1, 2, 4])
def test_empty_images_take_no_rank(spark, datas, empty):
    for gap in (None, bytearray()):
        kept = [bytearray(d) for d in datas[:4]]
        rows = [("g", i + 1, f"d{i}", d) for i, d in enumerate([*kept[: empty - 1], gap, *kept[empty - 1 :]])]
        df = spark.createDataFrame(rows, SCHEMA)
        stages, _ = reduce_images(df, [3], 256, whole=True)
        assert {r.n: (r.total, r.variance, r.aligned, r.high_entropy) for r in stages.collect()} == {n: plain(datas, n, Params())[0] for n in (3, 4)}
    key = bytes(np.random.RandomState(1).permutation(256)[:32].astype(np.uint8))
    body = [bytearray(bytes(256) + bytes((b + 128 * (i % 2) + 5 * i) % 256 for b in key) + bytes(736)) for i in range(5)]
    df = spark.createDataFrame([("g", i + 1, str(i), d) for i, d in enumerate([*body[: empty - 1], None, *body[empty - 1 :]])], SCHEMA)
    assert [(p.n, p.hits, p.hit_off) for p in nsweep(df, [5], lambda: lambda v: bytes(v) == key).collect()] == [(5, 1, 256)]


def test_files_give_what_images_give(spark, tmp_path):
    """Image files read in ranges against whole images, over several checkpoints and uneven sizes."""
    rng = np.random.RandomState(3)
    rows, files = [], []
    for g in ("a", "b"):
        base = rng.randint(0, 256, 5000).astype(np.uint8)
        for rank, size in ((1, 5000), (2, 4800), (3, 4999), (4, 3000), (5, 0)):
            image = base.copy()
            image[1000:1064] = rng.randint(0, 256, 64)
            image[::17] = rng.randint(0, 256, len(image[::17]))
            path = tmp_path / f"{g}{rank}.bin"
            path.write_bytes(image[:size].tobytes())
            rows.append((g, rank, f"{g}{rank}", bytearray(image[:size].tobytes())))
            files.append((g, rank, str(path), size))
    images, listed = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(files, "grp string, rank int, path string, size bigint")
    options = {"chunk": 512, "whole": True, "min_variance": 100.0, "entropy_threshold": 3.5, "min_region": 8}
    for a, b in zip(reduce_images(images, [1, 2, 3], **options), reduce_files(listed, [1, 2, 3], **options)):
        left, right = ({tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect()} for df in (a, b))
        assert left == right and left
    state = {(r.grp, r.off, round(r.variance, 6)) for r in expand(file_states(listed, 512, group=F.col("grp")), 512, whole=True).collect()}
    assert state == {(r.grp, r.off, round(r.variance, 6)) for r in expand(consensus_state(chunked(images, 0, 512, ["grp"]), F.col("grp")), 512).collect()}
    listing = image_files(spark, [str(tmp_path)], "*.bin")
    assert {r["size"] for r in listing.collect()} - {0} == {5000, 4800, 4999, 3000}


def test_many_files_of_a_group_merge(spark, tmp_path, monkeypatch):
    from bytefold.sources import images as source

    monkeypatch.setattr(source, "FOLD_IMAGES", 4)
    rng = np.random.RandomState(4)
    for i in range(11):
        (tmp_path / f"{i}.bin").write_bytes(rng.randint(0, 256, 700).astype(np.uint8).tobytes())
    rows = expand(file_states(image_files(spark, [str(tmp_path)], "*.bin"), 256), 256, whole=True)
    assert rows.count() == 700 and {r.n for r in rows.collect()} == {11}
