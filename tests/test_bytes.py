"""Kernels and byte operators against plain Python."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bytefold.functions import kernels as K
from bytefold.operators import consensus as C
from bytefold.operators import entropy as E
from bytefold.operators import runs as R
from bytefold.operators import search as S
from bytefold.operators.chunks import bytes_of, chunked


def plain_entropy(data):
    return sum(-c / len(data) * math.log2(c / len(data)) for c in Counter(data).values()) if data else 0.0


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=200), st.integers(1, 40), st.integers(1, 20))
def test_sliding_entropy_is_the_entropy_of_each_window(data, window, step):
    got = K.sliding_entropy(K.as_bytes(data), window, step)
    want = [plain_entropy(data[i : i + window]) for i in range(0, len(data) - window + 1, step)]
    assert np.allclose(got, want, atol=1e-9) and len(got) == len(want)


@pytest.mark.parametrize("window", [256, 257, 258, 400])
def test_wide_windows(window):
    data = bytes(random.Random(window).choice(b"abcdefgh") for _ in range(700))
    want = [plain_entropy(data[i : i + window]) for i in range(0, 701 - window)]
    assert np.allclose(K.sliding_entropy(K.as_bytes(data), window), want, atol=1e-9)


def test_entropy_edges():
    assert K.shannon(b"") == 0.0
    assert K.shannon(b"aaaa") == 0.0
    assert K.shannon(bytes(range(256))) == 8.0
    assert len(K.sliding_entropy(K.as_bytes(b"abc"), 4)) == 0
    with pytest.raises(ValueError):
        E.check_threshold(7.5, 32)


@given(st.lists(st.booleans(), max_size=120), st.integers(1, 16), st.integers(1, 9), st.floats(0, 1))
def test_aligned_mask(mask, block, alignment, density):
    mask = np.array(mask, dtype=bool)
    keep = np.zeros(len(mask), dtype=bool)
    if mask.any():
        for s in range(0, len(mask) - block + 1, alignment):
            if mask[s : s + block].sum() >= int(block * density):
                keep[s : s + block] = True
    assert (K.aligned(mask, block, alignment, density) == (mask & keep)).all()


def test_contains_join_equals_the_automaton(spark):
    """Needles of every length in a table, overlaps and chunk borders, equal values, empty and null ones."""
    rng = random.Random(3)
    data = [bytes(rng.choice(b"ab\x00\xff") for _ in range(700)), b"", None, b"a"]
    needles = [(f"n{k}", bytes(rng.choice(b"ab\x00\xff") for _ in range(k % 9 + 1))) for k in range(24)] + [("same", b"ab"), ("other", b"ab"), ("none", b"")]
    chunks = chunked(images(spark, *data), S.needle_halo(needles), 64)
    rows = spark.createDataFrame([(k, bytearray(v)) for k, v in needles] + [("null", None)], "secret_type string, value binary")
    want = sorted(tuple(r) for r in S.exact_hits(chunks, needles).collect())
    assert sorted(tuple(r) for r in S.contains_join(chunks, rows).collect()) == want
    plain = sorted((0, k, o, len(v)) for k, v in needles for o in range(700) if v and data[0].startswith(v, o)) + [(3, k, 0, 1) for k, v in needles if v == b"a"]
    assert want == sorted(plain)


def test_automaton_without_the_package(monkeypatch):
    import builtins

    real = builtins.__import__
    monkeypatch.setattr(builtins, "__import__", lambda name, *a: (_ for _ in ()).throw(ImportError()) if name == "ahocorasick" else real(name, *a))
    slow = K.Automaton([b"aa", b"aab", b"]", b"\xff"])
    monkeypatch.undo()
    fast = K.Automaton([b"aa", b"aab", b"]", b"\xff"])
    data = b"aaab]\xff\xffaa"
    assert slow.machine is None and sorted(slow.find(data)) == sorted(fast.find(data))
    assert list(K.Automaton([]).find(data)) == []


def test_find_all_overlaps_and_takes_no_empty_needle():
    assert list(K.find_all(b"aaaa", b"aa")) == [0, 1, 2]
    assert list(K.find_all(b"aaaa", b"")) == []


def test_strings():
    data = b"abcd\x00ab\tc\x01" + "né€z".encode() + b"\xff\xfewxyz"
    assert K.ascii_strings(data) == [(0, 4, "abcd"), (5, 4, "ab\tc"), (len(data) - 4, 4, "wxyz")]
    assert K.utf8_strings("né€z".encode()) == [(0, 7, "né€z")]
    assert K.utf8_strings(b"\xff\xfewxyz") == [(2, 4, "wxyz")]  # not strict UTF-8: its ASCII runs
    assert K.utf8_strings("né€".encode()) == []  # three characters, six bytes
    assert K.ascii_strings(b"") == []


def test_plateau_of_a_planted_key():
    rng = random.Random(5)
    data = bytes(512) + bytes(rng.sample(range(256), 48)) + bytes(512)
    profile = K.sliding_entropy(K.as_bytes(data), 32, 16)
    scan = K.EdgeScan(least=1.0, tolerance=64)
    found = [f for i, e in enumerate(profile) for f in scan.step(16 * i, float(e), len(data))]
    assert len(found) == 1 and found[0][1] in (32, 48) and abs(found[0][0] - 512) <= 64 and 0 < found[0][2] <= 1
    quiet = K.EdgeScan()
    assert not [f for i in range(100) for f in quiet.step(16 * i, 5.0, 1600)]


def images(spark, *items):
    return spark.createDataFrame([(i, bytearray(x) if x is not None else None) for i, x in enumerate(items)], "dump_id int, data binary")


def test_chunks_give_the_image_back(spark):
    df = images(spark, bytes(range(200)), b"", None, b"x")
    rows = chunked(df, 3, 64).orderBy("dump_id", "chunk_no").collect()
    assert b"".join(bytes(r.data[: r["size"]]) for r in rows if r.dump_id == 0) == bytes(range(200))
    assert {r.dump_id for r in rows} == {0, 3}
    assert len(rows[0].data) == 67
    assert bytes_of(df).filter("dump_id = 0").count() == 200


def test_profile_and_hits_dont_depend_on_the_chunk(spark):
    rng = random.Random(1)
    data = bytes(rng.choice(b"abcd\x00\x01\xf0") for _ in range(500)) + b"needle" * 3
    df = images(spark, data)
    want = {i: plain_entropy(data[i : i + 32]) for i in range(0, len(data) - 31, 5)}
    needles = [("n", b"needle"), ("n2", b"needle"), ("a", b"ab"), ("e", b"")]
    hits = sorted((k, o) for k, v in needles if v for o in K.find_all(data, v))
    for chunk in (40, 64, 1000):
        got = {r.off: r.entropy for r in E.entropy_profile(chunked(df, 31, chunk), 32, 5).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
        found = S.exact_hits(chunked(df, S.needle_halo(needles), chunk), needles).collect()
        assert sorted((r.secret_type, r.off) for r in found) == hits


def test_high_regions_end_rule(spark):
    rows = [(0, o, e) for o, e in enumerate([1.0, 5.0, 5.0, 5.0, 1.0, 5.0, 5.0])]
    df = spark.createDataFrame(rows, "dump_id int, off bigint, entropy double")
    got = [(r.start, r.end) for r in E.high_regions(df, 4.0, 1).orderBy("start").collect()]
    assert got == [(1, 4), (5, 6)]  # the first point below; at the end of the data the last point


def test_consensus_three_ways(spark):
    rng = random.Random(2)
    data = [bytes(rng.randrange(256) for _ in range(300 - 7 * i)) for i in range(5)]
    df = images(spark, *data)
    size = min(map(len, data))
    want = np.array([np.frombuffer(x[:size], dtype=np.uint8) for x in data]).astype(float).var(axis=0)
    for chunk in (64, 1000):
        kernel = C.expand(C.consensus_state(chunked(df, 0, chunk)), chunk).orderBy("off").collect()
        assert np.allclose([r.variance for r in kernel], want) and len(kernel) == size
        halves = [C.consensus_state(chunked(df.filter(f"dump_id % 2 = {i}"), 0, chunk)) for i in (0, 1)]
        merged = C.expand(C.merge_states(halves[0].unionByName(halves[1])), chunk).orderBy("off").collect()
        assert [r.variance for r in merged] == [r.variance for r in kernel]
    rows = C.consensus_of_bytes(bytes_of(df), []).filter("n = 5").orderBy("off").collect()
    assert np.allclose([r.variance for r in rows], want)


def test_classes_and_regions(spark):
    base = bytes(64)
    data = [base[:8] + bytes([v] * 20) + base[28:] for v in (0, 120, 240)]
    rows = C.expand(C.consensus_state(chunked(images(spark, *data), 0, 64)), 64)
    assert {r["class"]: r.offsets for r in C.class_counts(rows).collect()} == {0: 44, 3: 20}
    region = C.KEY_CANDIDATE
    got = R.class_regions(rows, ["grp"], region, 16).collect()
    assert [(r.start, r.end, r.mean_variance) for r in got] == [(8, 28, 9600.0)]
    assert [(r.start, r.end) for r in R.class_regions(rows, ["grp"], C.INVARIANT, 32).collect()] == [(28, 64)]


@pytest.mark.parametrize("block", [3, 7, 1 << 20])
def test_islands_stitch_blocks(spark, block):
    offs = [0, 1, 2, 5, 6, 7, 8, 9, 20]
    df = spark.createDataFrame([("a", o) for o in offs] + [("b", 4)], "g string, off bigint")
    got = sorted((r.g, r.start, r.end) for r in R.islands(df, ["g"], block=block).collect())
    assert got == [("a", 0, 3), ("a", 5, 10), ("a", 20, 21), ("b", 4, 5)]


def test_merge_near(spark):
    rows = [("g", 0, 4, True), ("g", 6, 8, True), ("g", 8, 9, False), ("g", 9, 12, True), ("g", 20, 22, True)]
    runs = spark.createDataFrame(rows, "g string, start bigint, end bigint, w boolean")
    for block in (1 << 20, 8, 4):
        got = sorted((r.start, r.end) for r in R.merge_near(runs, ["g"], F.col("w"), block=block).collect())
        assert got == [(0, 8), (9, 12), (20, 22)]


@pytest.mark.parametrize("seed", range(4))
def test_merge_near_against_a_scan(spark, seed):
    rng = np.random.RandomState(seed)
    kinds = rng.choice([0, 1, 2], size=160, p=[0.45, 0.5, 0.05])  # other, wanted, barrier
    runs = []
    for g in ("a", "b"):
        kinds = np.roll(kinds, 7)
        edges = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), len(kinds)]
        runs += [(g, a, b, bool(kinds[a] == 1)) for a, b in zip(edges, edges[1:]) if kinds[a]]
    want = []
    for g in ("a", "b"):
        last = None
        for _, a, b, w in sorted(r for r in runs if r[0] == g):
            if not w:
                last = None
            elif last is not None and a - last[2] <= 4:
                last[2] = b
            else:
                last = [g, a, b]
                want.append(last)
    df = spark.createDataFrame(runs, "g string, start bigint, end bigint, w boolean")
    for block in (1 << 20, 16, 5):
        got = sorted((r.g, r.start, r.end) for r in R.merge_near(df, ["g"], F.col("w"), block=block).collect())
        assert got == sorted(map(tuple, want))


def test_state_runs_and_totals(spark):
    rng = np.random.RandomState(5)
    data = [bytes(np.where(rng.rand(900) < 0.3, rng.randint(0, 256, 900), 7).astype(np.uint8).tolist()) for _ in range(4)] + [b"", None]
    data[1] = data[1][:777]
    df = images(spark, *data)
    state = C.consensus_state(chunked(df, 0, 64))
    rows = C.expand(state, 64)
    assert rows.count() == 777 and rows.rdd.getNumPartitions() >= 1
    for kind in range(4):
        want = {(r.start, r.end, round(r.mean_variance, 6)) for r in R.class_regions(rows, ["grp"], kind, 1).collect()}
        got = {(r.start, r.end, round(r.mean_variance, 6)) for r in C.state_runs(state, 64, [kind]).collect()}
        assert got == want
    totals = {r["class"]: (r.offsets, r.images) for r in C.class_totals(state).collect()}
    assert totals == {r["class"]: (r["count"], 4) for r in rows.groupBy("class").count().collect()}
    spans = spark.createDataFrame([("", 10, 200), ("", 300, 301)], "grp string, start bigint, end bigint")
    for r in C.span_means(C.whole_chunks(state), spans, 64).collect():
        assert abs(r.mean_variance - rows.filter(F.col("off").between(r.start, r.end - 1)).agg(F.avg("variance")).first()[0]) < 1e-9


def test_states_are_narrow():
    one = C.ChunkState(1, np.array([255, 3], dtype=np.uint8), None)
    total = one
    for _ in range(299):
        total = total.add(one)
    assert total.n == 300 and total.sums.tolist() == [76500, 900] and total.squares.tolist() == [300 * 65025, 2700]
    assert one.row()[3] == b"" and (one.add(one)).sums.dtype == np.uint16 and total.sums.dtype == np.uint32


def test_alignment_variants_differ_at_the_tail(spark):
    df = spark.createDataFrame([("g", o) for o in range(40, 60)], "g string, off bigint")
    masked = {r.off for r in R.aligned_blocks(df, ["g"], F.lit(60), 32, 16, 0.5).collect()}
    hanging = {r.off for r in R.aligned_blocks(df, ["g"], None, 32, 16, 0.5).collect()}
    want = np.zeros(60, dtype=bool)
    want[40:] = True
    assert masked == set(np.flatnonzero(K.aligned(want, 32, 16, 0.5)).tolist())
    assert hanging == set(range(40, 60))
    assert R.aligned_blocks(df, ["g"], None, 0, 16).count() == 0


def test_fields_and_regex(spark):
    rows = spark.createDataFrame([("g", o, 0.0 if o < 4 else 9000.0) for o in range(12)], "g string, off bigint, variance double")
    got = [(r.label, r.start, r.end) for r in R.infer_fields(rows, ["g"], F.lit(6), F.lit(2)).orderBy("start").collect()]
    assert got == [("static_0", 0, 4), ("dynamic_0", 4, 6), ("key_0", 6, 8), ("dynamic_1", 8, 12)]
    good, bad = S.valid_patterns([("a", "aa"), ("b", "("), ("c", "")])
    assert [n for n, _ in good] == ["a"] and [n for n, _ in bad] == ["b", "c"]
    hits = S.regex_search(images(spark, b"aaaaa", None), [("a", "aa")]).collect()
    assert [(r.off, r.length) for r in hits] == [(0, 2), (2, 2)]  # not overlapping


def test_static_hits(spark):
    hits = spark.createDataFrame([(0, 5, 4), (0, 20, 4)], "dump_id int, off bigint, length int")
    volatile = spark.createDataFrame([(0, 8, 12)], "dump_id int, start bigint, end bigint")
    assert [r.off for r in S.hits_in_static(hits, volatile, ["dump_id"]).collect()] == [20]


def test_masked_rules():
    rules = [{"offset": -2, "bytes": "00 20", "mask": "00 ff"}, {"offset": 4, "bytes": "ff"}]
    assert S.masked_score(b"\x99\x20AAAA\xff", 2, rules) == 1.0
    assert S.masked_score(b"\x99\x20AAAA\x00", 2, rules) == 0.5
    assert S.masked_score(b"AAAA\xff", 0, rules) == 0.5  # a rule outside the data fails
    assert S.masked_score(b"AAAA", 0, []) == 0.0


@pytest.mark.parametrize("encoding", ["ascii", "utf-8"])
def test_strings_do_not_depend_on_the_chunks(spark, encoding):
    rng = random.Random(2)
    texts = ["plain text äöü ß that goes on ".encode() * 9, bytes(rng.choice(b"ab \x00\xff\xc3\xa4") for _ in range(900)), b"", None, b"x" * 64, "né".encode() * 40 + b"\x00abcd"]
    df = images(spark, *texts)
    extract = K.utf8_strings if encoding == "utf-8" else K.ascii_strings
    want = sorted((i, *s) for i, t in enumerate(texts) for s in extract(t or b"", 4))
    for source in (df, chunked(df, 0, 16), chunked(df, 7, 64)):
        assert sorted(tuple(r) for r in S.strings_of(source, 4, encoding).collect()) == want
    for r in E.image_entropy(df).collect():
        assert abs(r.entropy - K.shannon(texts[r.dump_id])) < 1e-9


def test_overlaps_merge_the_same_in_blocks(spark, monkeypatch):
    """Clusters inside, at the edges of and across blocks against one fold over the image."""
    from bytefold.operators import algorithms as A

    rng = random.Random(6)
    rows = []
    for dump in range(3):
        off = 0
        for _ in range(400):
            off += rng.choice([1, 1, 2, 7, 60, 900, 30_000])
            for length in rng.sample((32, 48), rng.choice([1, 2])):
                rows.append((dump, off, length, rng.choice([0.5, 0.6, 0.7])))
    want = []
    for dump in range(3):
        kept = None
        for row in sorted((r for r in rows if r[0] == dump), key=lambda r: (r[1], -r[2])):
            if kept is not None and row[1] < kept[1] + kept[2]:
                kept = row if row[3] > kept[3] else kept
                continue
            if kept is not None:
                want.append(kept)
            kept = row
        want.append(kept)
    df = spark.createDataFrame(rows, "dump_id int, off bigint, length int, confidence double")
    assert max(r[1] for r in rows) > 3 * A._BLOCK
    assert sorted(map(tuple, A.merge_overlapping(df).collect())) == sorted(want)
