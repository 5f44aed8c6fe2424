"""Messages, nested records, references and spelling rules: brute force and defined cases."""

import json
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from bytefold.functions import normalize as N
from bytefold.operators import nested as D
from bytefold.operators.references import OrphanTracker
from bytefold.streaming import dedupe as M


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first().y


def test_spellings(spark):
    assert one(spark, N.norm_id, " A0-B1 ") == "a0b1"
    assert one(spark, N.norm_id, " - ") is None and one(spark, N.norm_id, None) is None
    assert one(spark, N.norm_label, " Exact-Match x ") == "exact_match_x"
    assert one(spark, N.norm_source, " Case-_ Notes ") == "case_notes"
    for text, want in [("0xAB cd", "abcd"), ("AA:BB-cc", "aabbcc"), ("0x", None), ("abc", None), ("zz", None), ("", None), (None, None), ("0XFF", "ff"), ("00", "00")]:
        assert one(spark, N.norm_hex, text) == want, text
    assert one(spark, N.norm_hex, "ab" * 200_000) == "ab" * 200_000


def test_times(spark):
    second = 1_700_000_000_000_000
    for text in ("2023-11-14T22:13:20.000000+00:00", "2023-11-14T22:13:20Z", "2023-11-14 22:13:20", "20231114_221320_0", "2023-11-15T00:13:20+02:00", " 2023-11-14T17:13:20-05:00 "):
        assert one(spark, N.instant_micros, text) == second, text
    assert one(spark, N.instant_micros, "20231114_221320_25") == second + 25
    for text in (None, "", "soon", "20231399_221320_0"):
        assert one(spark, N.instant_micros, text) is None
    assert one(spark, N.month_of, second, "bigint") == "2023-11"
    assert one(spark, N.month_of, None, "bigint") == "unknown"
    assert one(spark, N.month_of, -1, "bigint") == "1969-12"


# ---- messages


EVENT = "delivery_id bigint, received_at timestamp_ntz, task_id string, type string, seq bigint, id string, ts double"


def surplus(rows):
    groups = defaultdict(set)
    for i, at, task, kind, seq, *_ in rows:
        task = (task or "").strip().replace("-", "").lower()
        if task and seq is not None:
            groups[task, seq, None if kind is None else kind.strip().lower()].add((at is None, at, i))
    return {i for g in groups.values() for _, _, i in sorted(g, key=lambda x: (x[0], x[1] or 0, x[2]))[1:]}


def events(seed, n=400):
    import datetime

    rng = random.Random(seed)
    start = datetime.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        task = rng.choice([None, "", "aa", "AA", " a-a", "bb", "c" * 3])
        at = None if rng.random() < 0.05 else start + datetime.timedelta(hours=rng.choice([0, 1, 2, 500, 2000, 2001]))
        rows.append((i, at, task, rng.choice([None, "p", "P ", "q"]), rng.choice([None, 1, 2, 3, 4]), "x", 1.0))
    return rows + rows[:5]  # the same deliveries again


@pytest.mark.parametrize("files,retention", [(1, "400 days"), (8, "1 hour")])
def test_surplus_is_exact_whatever_expires(spark, tmp_path, files, retention):
    rows = events(files)
    for k in range(files):
        spark.createDataFrame(rows[k::files], EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = M.surplus_messages(spark, str(tmp_path / "in"), files_per_trigger=1, retention=retention, delay="1 hour", work_dir=str(tmp_path / "w"))
    ids = [r.id for r in got.collect()]
    assert len(ids) == len(set(ids)) and set(ids) == surplus(rows)
    out = spark.read.parquet(str(tmp_path / "w/events"))
    kinds = {r.kind for r in out.select("kind").distinct().collect()}
    if files > 1:
        assert kinds == {M.SURPLUS, M.ARCHIVED}  # expiry took part
        assert set(ids) - {r.id for r in out.filter(F.col("kind") == M.SURPLUS).collect()}  # and the late lookup


def test_timers_expire_states_without_rows(spark, tmp_path):
    """A message whose prefix gets no more rows leaves the state when the watermark has passed it."""
    import datetime

    start = datetime.datetime(2024, 1, 1)
    row = lambda i, task, days: (i, start + datetime.timedelta(days=days), task, "p", 1, "x", 1.0)
    for k, rows in enumerate(([row(1, "a", 0)], [row(2, "b", 100)], [row(3, "c", 101)], [row(4, "a", 102)])):
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        got = M.surplus_messages(spark, str(tmp_path / "in"), files_per_trigger=1, work_dir=str(tmp_path / "w"))
        assert [r.id for r in got.collect()] == ([] if k < 3 else [4])  # found by the lookup: a is not live
    archived = spark.read.parquet(str(tmp_path / "w/events")).filter(F.col("kind") == M.ARCHIVED)
    assert [r.id for r in archived.collect()] == [1]
    assert {r.id for r in M.live_copies(spark, str(tmp_path / "w/checkpoint")).collect()} == {2, 3, 4}


def test_states_stay_small():
    assert M.prefix_bits(0) == 9 and M.prefix_bits(10**7) == 13 and 10**10 >> M.prefix_bits(10**10) <= M.STATE_MESSAGES


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    rows = events(9, 120)
    for half in (rows[:60], rows[60:]):
        spark.createDataFrame(half, EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        got = M.surplus_messages(spark, str(tmp_path / "in"), work_dir=str(tmp_path / "w"))
    assert {r.id for r in got.collect()} == surplus(rows)


def test_no_messages(spark, tmp_path):
    spark.createDataFrame([], EVENT).write.parquet(str(tmp_path / "in"))
    assert M.surplus_messages(spark, str(tmp_path / "in")).count() == 0


def test_block_merge_keeps_the_best():
    new = lambda *r: M._entries(*(np.array(c, dtype=np.int64) for c in zip(*r)))
    live, lost = M.merge_block(np.zeros(0, M._ENTRY), new((1, 1, 5, 7), (1, 1, 3, 9), (2, 2, 4, 4)))
    assert sorted(live["id"].tolist()) == [4, 9] and lost["id"].tolist() == [7]
    live, lost = M.merge_block(live, new((1, 1, 1, 11), (2, 2, 4, 4)))
    assert sorted(live["id"].tolist()) == [4, 11] and lost["id"].tolist() == [9]


# ---- nested records


def test_walk_labels():
    value = {"a": [{"b": 1}, None, {"b": "0x10"}], "c": {"b": 2.0}}
    got = list(D.walk(value, frozenset({"c"})))
    assert ("0.0.0", "a[].b", "int", "1") in got and ("0.2.0", "a[].b", "text", "0x10") in got
    assert ("1.0.0", "c[].b", "float", "2.0") in got and ("0.1", "a[]", "null", None) in got


def nodes(spark, texts, **kw):
    df = spark.createDataFrame(list(enumerate(texts)), "doc int, label string")  # a column named as one of the result
    return D.nodes(df, F.col("doc"), F.col("label"), **kw)


def test_nodes_of_odd_texts(spark):
    texts = [None, "", "{", "NaN", '{"a": NaN}', json.dumps(json.dumps({"p": {"x": 1}})), "[" * 100_000, '{"p": [null, {"x": "7"}]}', '{"p": null}', "{}", '{"p": {"x": 1, "x": 2}}', '"plain"']
    got = sorted((r.doc, r.label, r.value) for r in nodes(spark, texts, arrays=["p"], paths=["p[].x"]).collect())
    assert got == [("10", "0.0.0", "2"), ("5", "0.0.0", "1"), ("7", "0.1.0", "7")]


def test_integers(spark):
    cases = [("int", "5", 5), ("int", "-5", -5), ("text", " 12 ", 12), ("text", "0xFf", 255), ("text", "0x", None), ("text", "1.5", None), ("float", "3.0", 3), ("float", "3.5", None), ("bool", "true", None), ("int", str(2**70), None), ("null", None, None), ("text", "", None)]
    df = spark.createDataFrame([(i, k, v) for i, (k, v, _) in enumerate(cases)], "i int, kind string, value string")
    got = {r.i: r.y for r in df.select("i", D.integer(F.col("kind"), F.col("value")).alias("y")).collect()}
    assert [got[i] for i in range(len(cases))] == [w for *_, w in cases]


def test_flat_tables_link_to_their_parents(spark):
    text = json.dumps({"id": 1, "regions": [{"base": "b0", "hints": [{"o": 1}, {"o": 2}]}, {"base": None}]})
    n = nodes(spark, [text])
    regions = {r.label: r for r in D.flat_table(n, "regions[]", ["base"]).collect()}
    hints = {r.label: r for r in D.flat_table(n, "regions[].hints[]", ["o"], "regions[]").collect()}
    assert {k: (r.base, r.parent_label) for k, r in regions.items()} == {"1.0": ("b0", ""), "1.1": (None, "")}
    assert {k: (r.o, r.parent_label) for k, r in hints.items()} == {"1.0.1.0": ("1", "1.0"), "1.0.1.1": ("2", "1.0")}
    assert set(r.parent_label for r in hints.values()) <= set(regions)
    assert [r.parent_label for r in D.flat_table(n, "", ["id"]).collect()] == [None]
    clash = nodes(spark, [json.dumps({"label": "x", "doc": 2})])
    assert D.flat_table(clash, "", ["label", "doc"]).select("member_label", "member_doc").first() == ("x", "2")
    assert n.filter("label = '1.0.1.1'").select(D.ordinal("label", 1), D.ordinal("label", 3), D.ordinal("label", 9)).first() == (0, 1, None)
    assert nodes(spark, []).count() == 0


def test_nodes_of_a_long_text(spark):
    text = json.dumps({"p": [{"x": i} for i in range(50_000)]})
    assert nodes(spark, [text], paths=["p[].x"]).count() == 50_000


# ---- references


def states(refs, parents, removed):
    out = {}
    times = defaultdict(list)
    for t, k, at in parents:
        times[t, k].append(at)
    open_ = {}
    for t, k, at, restored in removed:
        open_[t, k, at] = open_.get((t, k, at), False) or restored
    gone = {(t, k) for (t, k, _), restored in open_.items() if not restored}
    for child, key, t, ref, at in refs:
        if ref is None or key is None:
            continue
        known = [x for x in times.get((t, ref), []) if x is not None]
        state = "deleted" if (t, ref) in gone else "absent" if (t, ref) not in times else "late" if known and at is not None and min(known) > at else None
        if state:
            out[child, key] = state
    return out


def frames(spark, refs=None, parents=None, removed=None):
    make = lambda rows, schema: None if rows is None else spark.createDataFrame(rows, schema)
    return dict(refs=make(refs, "child_table string, child_key string, parent_table string, ref string, micros bigint"), parents=make(parents, "parent_table string, ref string, parent_micros bigint"), removals=make(removed, "parent_table string, ref string, removed_at string, restored boolean"))


def found(tracker):
    rows = OrphanTracker.report(tracker.pending()).collect()
    got = {(r.child_table, r.child_key): r.ref_state for r in rows}
    assert len(got) == len(rows)
    return got


def test_increments_equal_one_batch(spark, tmp_path):
    rng = random.Random(7)
    refs = [("f", f"c{i}", "runs", rng.choice([None, *(f"r{j}" for j in range(12))]), rng.choice([None, 5, 50])) for i in range(80)] + [("f", None, "runs", "r1", 5)]
    parents = [("runs", f"r{j}", rng.choice([None, 1, 20, 99])) for j in range(8)]
    removed = [("runs", f"r{j}", "t1", False) for j in (1, 3, 9)]
    restored = [("runs", "r3", "t1", True)]
    tracker = OrphanTracker(spark, str(tmp_path / "s"), parts=4)
    seen = [[], [], []]
    for step in ((refs[:40], None, None), (None, parents[:5], None), (refs[40:], None, removed), (None, parents[5:], None), (None, None, restored), (None, None, None)):
        tracker.advance(**frames(spark, *step))
        for have, new in zip(seen, step):
            have.extend(new or [])
        assert found(tracker) == states(*seen)
    assert tracker.counts().select("version").distinct().count() == 6
    again = OrphanTracker(spark, str(tmp_path / "s"))  # a new driver goes on from the last commit
    assert again.version == 6 and found(again) == states(*seen)


def test_small_increments_touch_little(spark, tmp_path):
    """What an increment reads and writes follows from its own rows, not from what is kept."""
    refs = [("f", f"c{i}", "runs", f"r{i % 900}", 5) for i in range(6000)]
    parents = [("runs", f"r{j}", 1) for j in range(800)]
    tracker = OrphanTracker(spark, str(tmp_path / "s"), parts=64)
    tracker.advance(**frames(spark, refs, parents), snapshot=False)
    size = lambda v: sum(f.stat().st_size for name in ("refs", "parents", "removals", "pending") for f in (tmp_path / "s" / name / f"v{v}").rglob("*.parquet"))
    folders = lambda df: {f.rsplit("/", 2)[1] for f in df.inputFiles()}
    assert len(folders(tracker._read("refs"))) == 64
    seen = [refs, parents, []]
    for k, step in enumerate((([("f", "n1", "runs", "r850", 5)], None, None), (None, [("runs", "r850", 1)], None), (None, None, [("runs", "r7", "t", False)])), 2):
        tracker.advance(**frames(spark, *step), snapshot=False)
        seen = [a + (b or []) for a, b in zip(seen, step)]
        assert found(tracker) == states(*seen)
        assert size(k) * 10 < size(1)
        newest = tracker.tables["pending"][-1]
        assert newest["version"] in (k, f"{k}-1") and (newest["level"] or len(newest["parts"]) == 1)
    plan = tracker._read("refs", [3])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan  # of older versions only the touched parts are opened


def test_versions_are_merged(spark, tmp_path):
    tracker = OrphanTracker(spark, str(tmp_path / "s"), parts=4, fan=2)
    seen = [[], [], []]
    for i in range(7):
        step = ([("f", f"c{i}", "runs", f"r{i % 3}", 5)], [("runs", f"r{i}", 1)] if i % 2 else None, None)
        tracker.advance(**frames(spark, *step), snapshot=False)
        seen = [a + (b or []) for a, b in zip(seen, step)]
        assert found(tracker) == states(*seen)
    assert all(len(v) <= 4 for v in tracker.tables.values())
    assert found(OrphanTracker(spark, str(tmp_path / "s"))) == states(*seen)


def test_copies_and_empty_increment(spark):
    tracker = OrphanTracker(spark)
    tracker.advance(**frames(spark, [], [], []))
    assert found(tracker) == {}
    tracker.advance(**frames(spark, [("f", "c", "runs", "x", None), ("f", "c", "runs", "x", 1_700_000_000_000_000)]))
    rows = OrphanTracker.report(tracker.pending()).collect()
    assert [(r.child_key, r.month_utc, r.ref_state) for r in rows] == [("c", "2023-11", "absent")]


def test_queries_of_the_problems(spark, data):
    from bytefold.queries.store import queries

    for name, f in queries().items():
        df = f(spark, data)
        assert df.count() >= 0 and len(set(df.columns)) == len(df.columns), name


def test_p4_nodes_have_parents_in_all_sources(spark, data):
    from bytefold.queries.store import p4_nodes

    rows = p4_nodes(spark, data).select("src", "doc", "label", "parent_label").collect()
    there = {(r.src, r.doc, r.label) for r in rows}
    assert {r.src for r in rows} == {"nsweep_events", "dumps", "gt_runs"}
    assert all((r.parent_label is None) == (r.label == "") for r in rows)
    assert all((r.src, r.doc, r.parent_label) in there for r in rows if r.label)
