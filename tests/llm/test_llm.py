"""The operators for training data against brute force, held-out accuracy and their defined cases."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from bytefold.llm import mixing, packing, reading, terms, topn
from bytefold.llm.tokens import DEFAULT_VOCAB, count_tokens, encoder

pytestmark = pytest.mark.skipif(not __import__("os").path.exists(DEFAULT_VOCAB), reason="no vocabulary file here")


# ---- term frequencies


def term_rows(seed, n=600):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        hot = rng.random() < 0.4
        rows.append((f"i{rng.randrange(n)}", rng.choice([None, *(f"r{k}" for k in range(9))]), "hot" if hot else f"t{rng.randrange(60)}", rng.choice([None, "x", "y", f"v{i}"]), "n_items"))
    return rows


SCHEMA = "item string, rec string, a string, b string, term string"


@pytest.mark.parametrize("block", [1, 7, 1 << 18])
def test_terms_are_counted_exactly(spark, monkeypatch, block):
    monkeypatch.setattr(terms, "BLOCK_ROWS", block)
    rows = term_rows(block)
    kept = {}
    for item, rec, a, b, _ in rows:  # of an item's rows the smallest counts, nulls first
        key = lambda r: tuple((x is not None, x or "") for x in r)
        kept[item] = min(kept.get(item, (rec, a, b)), (rec, a, b), key=key)
    items, records = Counter(), defaultdict(set)
    for rec, a, b in kept.values():
        for f, t in (("a", a), ("b", b)):
            if t is not None:
                items[f, t] += 1
                records[f, t] |= {rec} - {None}
    got = terms.term_counts(spark.createDataFrame(rows, SCHEMA), {"a": "a", "b": "b"}, "rec", "item").collect()
    assert {(r.field_name, r.term): (r.n_items, r.n_records) for r in got} == {k: (n, len(records[k])) for k, n in items.items()}
    assert len({r.term_id for r in got}) == len(got)


def test_term_ids_are_ranks_and_hot_terms_are_looked_up(spark, monkeypatch):
    """The integers are the terms' ranks whatever the partitions, ranges and hot terms are."""
    rng = random.Random(4)
    rows = [(f"i{k}", rng.choice(["r1", "r2", None]), "hot" if k % 3 else f"t{rng.randrange(40)}", rng.choice(["x", "y"]), "") for k in range(500)]
    df = spark.createDataFrame(rows, SCHEMA)
    results = []
    for share, span, parts in ((0.001, 1 << 16, 1), (0.2, 8, 5), (1.0, 3, 3)):
        monkeypatch.setattr(terms, "HOT_SHARE", share)
        monkeypatch.setattr(terms, "RANGE", span)
        got = terms.term_counts(df.repartition(parts), {"a": "a", "b": "b"}, "rec", "item").collect()
        results.append({(r.field_name, r.term): (r.term_id, r.n_items, r.n_records) for r in got})
    assert results[0] == results[1] == results[2]
    assert [k for k, _ in sorted(results[0].items(), key=lambda x: x[1][0])] == sorted(results[0])
    assert sorted(v[0] for v in results[0].values()) == list(range(len(results[0])))


def test_terms_edges_and_marks(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert terms.term_counts(df, {"a": "a"}, "rec", "item").count() == 0
    long = "x" * 300_000
    rows = [(None, "r1", long, None, ""), (None, "r1", long, "", ""), ("i", None, "", None, "")]
    got = {(r.field_name, r.term): (r.n_items, r.n_records) for r in terms.term_counts(spark.createDataFrame(rows, SCHEMA), {"a": "a", "b": "b"}, "rec", "item").collect()}
    assert got == {("a", long): (2, 1), ("a", ""): (1, 0), ("b", ""): (1, 1)}  # null ids count each
    counts = spark.createDataFrame([("t", 0), ("u", 2), ("v", 3), ("w", 26)], "term string, n_records bigint")
    assert [r.mark for r in terms.mark_terms(counts, F.lit(100)).orderBy("term").collect()] == ["rare", "rare", None, "common"]


# ---- top n


@pytest.mark.parametrize("parts", [1, 3, 13])
def test_top_n(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice(["hot", "hot", "g1", "g2", "g3", None]), f"x{rng.randrange(400):03}", rng.choice([None, 0.5, 0.5, 1.0, rng.random()]), 1) for _ in range(900)]
    rows += [("tiny", "only", 0.1, 1), ("null item", None, 0.9, 1)]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame(rows, "g string, i string, score double, position int").repartition(parts)
        got = topn.top_n_per_group(df, "g", "i", [F.col("score").isNull(), 0.0 - F.col("score")], 3).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    best = {}
    rank = lambda r: (r[2] is None, -(r[2] or 0.0), r[0])
    for r in rows:
        if r[0] is not None and r[1] is not None and (r[1] not in best or rank(r) < rank(best[r[1]])):
            best[r[1]] = r
    want = defaultdict(list)
    for r in sorted(best.values(), key=lambda r: (*rank(r)[:2], r[1])):
        if len(want[r[0]]) < 3:
            want[r[0]].append(r[1])
    have = defaultdict(list)
    for r in sorted(got, key=lambda r: r.position):
        have[r.grp].append(r.item)
    assert have == want
    assert all([r.position for r in got if r.grp == g] and sorted(r.position for r in got if r.grp == g) == list(range(1, len(v) + 1)) for g, v in want.items())


def test_top_n_of_nothing(spark):
    df = spark.createDataFrame([], "g string, i string, s double")
    assert topn.top_n_per_group(df, "g", "i", [F.col("s")]).count() == 0


# ---- packing


def packed(spark, texts, sizes, parts=3, **kw):
    df = spark.createDataFrame([(i, t, "n") for i, t in texts], "doc_id bigint, text string, window_id string").repartition(parts, "doc_id")
    return packing.pack_texts(df, spark.createDataFrame(sizes, "pack_id int, capacity_tokens int"), **kw)


def check_packing(rows, texts, sizes):
    tokens = dict(zip([i for i, _ in texts], count_tokens([t for _, t in texts])))
    for pack, capacity in sizes:
        mine = [r for r in rows if r.pack_id == pack]
        spans = defaultdict(list)
        parts = defaultdict(list)
        for r in mine:
            parts[r.doc_id].append((r.part_no, r.token_start, r.n_tokens))
            if r.container_id is not None:
                assert 0 <= r.container_offset and r.container_offset + r.n_tokens <= capacity
                spans[r.container_id].append((r.container_offset, r.container_offset + r.n_tokens))
        for s in spans.values():
            s.sort()
            assert all(a[1] <= b[0] for a, b in zip(s, s[1:]))  # no two texts overlap
        assert parts.keys() == tokens.keys()
        for doc, p in parts.items():
            p.sort()
            assert sum(n for *_, n in p) == tokens[doc]
            assert [s for _, s, _ in p] == [capacity * k for k in range(len(p))]
            assert len(p) == max(1, -(-tokens[doc] // capacity))  # split only beyond the capacity
    return tokens


@pytest.mark.parametrize("parts,fan_in", [(1, 64), (5, 2), (9, 3)])
def test_packing_keeps_every_text_whole(spark, parts, fan_in):
    rng = random.Random(parts)
    texts = [(i, " ".join(rng.choice(["byte", "entropy", "a", "0x1f"]) for _ in range(rng.choice([1, 5, 30, 90])))) for i in range(300)]
    texts += [(1000, None), (1001, ""), (1002, "word " * 5000)]
    sizes = [(1, 64), (2, 200)]
    df = packed(spark, texts, sizes, parts, windows=4, fan_in=fan_in)
    rows = df.collect()
    tokens = check_packing(rows, texts, sizes)
    for r in packing.fill_report(df).collect():
        assert r.tokens == sum(tokens.values()) and r.fill > 0.85
    assert sum(r.container_id is None for r in rows) == 4


def test_packing_edges(spark):
    assert packed(spark, [], [(1, 8)]).count() == 0
    assert packed(spark, [(1, "a b")], []).count() == 0
    assert packed(spark, [(1, "a b")], [(1, 0), (None, 5)]).count() == 0
    rows = packed(spark, [(1, "same text")] * 3, [(1, 100)]).collect()
    assert len(rows) == 3 and len({r.container_id for r in rows}) == 1  # repeated rows are placed each time


def test_best_fit():
    p = packing.BoundedPacker(10, 2, 0)
    assert p.place(6) == (0, 0, None) and p.place(7) == (1, 0, None)
    assert p.place(3) == (1, 7, None)  # the tightest room
    assert p.place(9) == (2, 0, None) and p.place(9) == (3, 0, 2)  # the fullest window goes


# ---- mixing


def test_flow_prefers_fresh_texts():
    targets = {"a": (0.5, 1), "b": (0.5, 3)}
    patterns = {("a",): 50, ("a", "b"): 100, ("b",): 10}
    total = mixing.largest_total(patterns, targets)
    done, flows = mixing.route(patterns, targets, total)
    assert done == sum(int(s * total) for s, _ in targets.values())
    used = Counter()
    for (p, s), n in flows.items():
        used[p] += n
        assert n <= patterns[p] * targets[s][1]
    small = mixing.route(patterns, targets, 100)[1]
    assert max(Counter({p: 0}) + Counter({p: n for (p, _), n in small.items()})) and all(n <= patterns[p] for (p, s), n in small.items())
    assert mixing.largest_total({}, targets) == 0
    assert mixing.largest_total({("a",): 30}, {"a": (0.5, 2), "b": (0.5, 1)}) == pytest.approx(120, abs=2)


def mix(spark, docs, targets, **kw):
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id bigint, text string, source string, pattern string")
    return mixing.mix_sources(df, spark.createDataFrame(targets, "source string, target_share double, max_repeats int"), **kw)


def test_shares_are_reached(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "page"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(5, 40))) + f" {i}", rng.choice(["big", "big", "big", "Big ", "mid", "small", "none", None])) for i in range(1500)]
    docs += [(5000 + i, docs[i][1], "small") for i in range(40)] + [(9000, "", "big"), (9001, None, "big")]
    targets = [("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.15, 4), ("ghost", 0.05, 2), ("big", 0.1, 1)]
    chosen, report = mix(spark, docs, targets, buckets=8)
    rows = {r.source: r for r in report.collect()}
    assert rows.keys() == {"big", "mid", "small", "ghost"} and rows["ghost"].tokens == 0
    whole = sum(r.tokens for r in rows.values())
    for s, share in (("big", 0.5), ("mid", 0.3), ("small", 0.15)):
        assert rows[s].actual_share == pytest.approx(share / 0.95, abs=0.01)
        assert rows[s].tokens == pytest.approx(share / 0.95 * whole, rel=0.02)
    picked = chosen.collect()
    caps = {"big": 1, "mid": 2, "small": 4}
    assert all(1 <= r.repeats <= caps[r.source] for r in picked)
    text = {d[0]: d[1] for d in docs}
    assert all(r.n_tokens == count_tokens([text[r.doc_id]])[0] for r in picked)
    assert sorted((r.doc_id, r.source, r.repeats) for r in mix(spark, docs, targets, buckets=8)[0].collect()) == sorted((r.doc_id, r.source, r.repeats) for r in picked)


def test_mix_edges(spark):
    chosen, report = mix(spark, [], [("a", 1.0, 1)])
    assert chosen.count() == 0 and [(r.tokens, r.actual_share) for r in report.collect()] == [(0, 0.0)]
    assert mix(spark, [(1, "x y", "a")], [])[0].count() == 0
    same = [(i, "one text", "a") for i in range(5)]
    chosen, _ = mix(spark, same, [("a", 1.0, None)])
    assert [(r.doc_id, r.repeats) for r in chosen.collect()] == [(0, 1)]  # equal texts are one unit
    assert mix(spark, same, [("a", None, 2)])[0].count() == 0
    assert mix(spark, same, [("a", 1.0, 0)])[0].count() == 0
    with pytest.raises(ValueError):
        mix(spark, same, [(f"s{i}", 0.1, 1) for i in range(5)], max_targets=3)


# ---- reading level


def test_prose_leaves_listings_out():
    text = "# Title\n\nThe page opens. We see it; then, we stop.\n\n| a | b |\n|---|---|\n0087cc30  8a 11 71 86\n12:00:01 INFO engine.scan n=6\n/data/x/run_1/very_long_hypothetical_name.bin\nrule r_1 {\n  strings: $a = { 6E A9 ?? }\n  condition: $a\n}\n```\ncode in a fence is long enough, see.\n```\n<p>Last <b>one</b> here now, reader.</p>\n- a list line\nShort head\n"
    assert " ".join(reading.prose_words(text)) == "the page opens we see it ; then , we stop last one here now , reader a list line"
    for empty in (None, "", "   ", "\n\n", "# Only a heading", "Notes", "0087cc30  8a 11 71 86", "| a | b |"):
        assert reading.prose_words(empty) == []
    assert reading.prose_words("CAFÉ IST OFFEN, JETZT NOCH HIER.")[0] == "café"
    assert len(reading.prose_words("wort und satz hier. " * 50_000)) == 200_000


def levels(spark, docs, labels):
    documents = spark.createDataFrame(docs, "doc_id bigint, text string, ratings string")
    model = reading.train(documents, spark.createDataFrame(labels, "doc_id bigint, reading_level int, rater string"))
    return {r.doc_id: r for r in reading.reading_levels(documents, model).collect()}


def test_levels_follow_the_ratings(spark):
    vocabulary = {1: "cat dog sun", 2: "table window letter", 3: "report module record", 4: "whereas notwithstanding premise", 5: "epistemic heteroscedastic reification"}
    rng = random.Random(1)
    docs, truth = [], {}
    for i in range(200):
        level = rng.randint(1, 5)
        words = [rng.choice(vocabulary[level].split() if rng.random() < 0.8 else vocabulary[rng.randint(1, 5)].split()) for _ in range(40)]
        docs.append((i, " ".join(words) + ".", "extra"))
        truth[i] = level
    labels = [(i, max(1, min(5, truth[i] + rng.choice([0, 0, 0, 1]))), f"r{k}") for i in range(100) for k in range(1 + i % 2)]
    labels += [(5, None, "r9"), (6, 9, "r9"), (None, 3, "r1"), labels[0]]
    got = levels(spark, docs + [(900, None, ""), (901, "", ""), (902, "unknown words only, nothing rated here.", "")], labels)
    held_out = [got[i].reading_level == truth[i] for i in range(100, 200)]
    assert sum(held_out) >= 97
    assert got[900].reading_level is None and got[901].prose_words == 0 and got[902].reading_level in range(1, 6)
    assert all(0 <= got[i].p_demanding <= 1 for i in range(200))


def test_levels_without_labels(spark):
    got = levels(spark, [(1, "some words are here now.", "")], [])
    assert got[1].reading_level == 1  # all alike: the lower level
    assert levels(spark, [], []) == {}


def test_held_out_accuracy_on_the_test_tables(spark, data):
    """Rated documents not used for training: the side of the line between 3 and 4."""
    big = data.replace("0.001", "0.1")
    documents, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/doc_labels.parquet")
    test = F.abs(F.hash("doc_id")) % 4 == 0
    model = reading.train(documents, labels.filter(~test))
    rated = labels.filter(test & F.col("reading_level").isNotNull()).groupBy("doc_id").agg(F.avg("reading_level").alias("mean"))
    both = reading.reading_levels(documents, model).filter("reading_level is not null").join(rated, "doc_id").select((F.col("reading_level") >= 4).alias("got"), (F.col("mean") >= 3.5).alias("want")).collect()
    assert len(both) > 200 and sum(r.got == r.want for r in both) / len(both) > 0.95  # single ratings are off by one at times


# ---- tokens and queries


def test_tokens_round_trip():
    text = "Der Wert 0xABC — naïve 日本 \n\n end"
    e = encoder()
    assert e.decode(e.encode_ordinary(text)) == text
    assert count_tokens([None, "", text]) == [0, 0, len(e.encode_ordinary(text))]
    assert count_tokens(["<|endoftext|>"])[0] > 1  # a special token's text is ordinary text


def test_queries_run(spark, data):
    from bytefold.llm.queries import queries

    for name, f in queries().items():
        assert f(spark, data).count() > 0, name


def test_nothing_else_imports_this_package():
    import pathlib

    root = pathlib.Path(packing.__file__).parents[1]
    assert not [p for p in root.rglob("*.py") if p.parent.name != "llm" and "bytefold.llm" in p.read_text()]


def test_mix_takes_any_source_name_and_bounds_its_patterns(spark):
    """Names with separators, and fewer patterns told apart than there are: nothing is lost."""
    rows = [(i, f"text {i % 40} of the sources", ["a|b", "c", "d"][i % 3]) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    goal = spark.createDataFrame([("a|b", 0.5, 3), ("c", 0.25, 2), ("d", 0.25, 1)], "source string, target_share double, max_repeats int")
    reports = []
    for patterns in (1024, 1):
        chosen, report = mixing.mix_sources(docs, goal, max_patterns=patterns)
        reports.append({r.source: (r.available_tokens, r.most_repeats) for r in report.collect()})
        held = {(r[2], r[1]) for r in rows}
        texts = {r[0]: r[1] for r in rows}
        assert all((r.source, texts[r.doc_id]) in held for r in chosen.collect()) and chosen.count() > 0
    assert {s: n for s, (n, _) in reports[0].items()} == {s: n for s, (n, _) in reports[1].items()}


@pytest.mark.parametrize("seed", range(5))
def test_fill_and_cheapest_flow_agree(seed):
    rng = random.Random(seed)
    targets = {s: (0.25, rng.randint(1, 3)) for s in "abcd"}
    patterns = {p: rng.randint(1, 500) for p in {tuple(sorted(rng.sample("abcd", rng.randint(1, 3)))) for _ in range(8)}}
    for total in (100, 1000, 5000):
        net, start, end, _ = mixing._network(patterns, targets, total)
        assert net.fill(start, end) == mixing.route(patterns, targets, total)[0]
