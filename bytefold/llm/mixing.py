"""Mixing sources to target weights of all tokens, with capped repetition.

A text that several sources hold is one unit that may serve any of them.  The units are counted
by membership pattern (the set of target sources that hold the text), the pattern counts make a
small flow network (pattern -> source, cost growing with each further use of a text), and the
min-cost flow says how many tokens of each pattern go to each source.  Texts are then taken in a
seeded order, by an exact running sum over the pattern, so the shares come out to within one text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bytefold.functions.normalize import norm_source
from bytefold.llm.tokens import DEFAULT_VOCAB, count_tokens
from bytefold.session import materialize


class FlowNetwork:
    """Min-cost maximum flow with integer capacities, by successive cheapest paths."""

    def __init__(self) -> None:
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []
        self.out: list[list[int]] = []

    def node(self) -> int:
        self.out.append([])
        return len(self.out) - 1

    def edge(self, a: int, b: int, room: int, cost: int = 0) -> int:
        """Add an edge and its reverse; returns its number."""
        for u, v, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[u].append(len(self.to))
            self.to.append(v)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def flow_on(self, edge: int) -> int:
        return self.room[edge + 1]

    def fill(self, source: int, sink: int) -> int:
        """Maximum flow whatever it costs: blocking flows over shortest layers."""
        total = 0
        while True:
            layer = {source: 0}
            for u in (order := [source]):
                for e in self.out[u]:
                    if self.room[e] > 0 and self.to[e] not in layer:
                        layer[self.to[e]] = layer[u] + 1
                        order.append(self.to[e])
            if sink not in layer:
                return total
            tried = dict.fromkeys(layer, 0)
            path: list[int] = []
            while True:
                u = self.to[path[-1]] if path else source
                if u == sink:
                    push = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= push
                        self.room[e ^ 1] += push
                    total += push
                    path = path[: next(i for i, e in enumerate(path) if not self.room[e])]
                    continue
                edges = self.out[u]
                while tried[u] < len(edges) and not (self.room[edges[tried[u]]] > 0 and layer.get(self.to[edges[tried[u]]]) == layer[u] + 1):
                    tried[u] += 1
                if tried[u] < len(edges):
                    path.append(edges[tried[u]])
                elif path:
                    path.pop()
                    tried[self.to[path[-1]] if path else source] += 1
                else:
                    break

    def run(self, source: int, sink: int) -> int:
        total = 0
        while True:
            dist: dict[int, int] = {source: 0}
            via: dict[int, int] = {}
            active = [source]
            while active:  # label correcting: costs on reverse edges are negative
                later = []
                for u in active:
                    for e in self.out[u]:
                        v = self.to[e]
                        if self.room[e] > 0 and dist[u] + self.cost[e] < dist.get(v, 1 << 62):
                            dist[v], via[v] = dist[u] + self.cost[e], e
                            later.append(v)
                active = list(dict.fromkeys(later))
            if sink not in via:
                return total
            path, at = [], sink
            while at != source:
                path.append(via[at])
                at = self.to[via[at] ^ 1]
            push = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= push
                self.room[e ^ 1] += push
            total += push


def _network(patterns: dict[tuple[str, ...], int], targets: dict[str, tuple[float, int]], total: int) -> tuple[FlowNetwork, int, int, dict[tuple[tuple[str, ...], str], int]]:
    """Start -> pattern (cost r squared for the r-th use) -> target -> end, and the middle edges."""
    net = FlowNetwork()
    start, end = net.node(), net.node()
    sinks = {s: net.node() for s in targets}
    for s, (share, _) in targets.items():
        net.edge(sinks[s], end, int(share * total))
    arcs: dict[tuple[tuple[str, ...], str], int] = {}
    for p, tokens in patterns.items():
        uses = max(targets[s][1] for s in p)
        node = net.node()
        for r in range(1, uses + 1):
            net.edge(start, node, tokens, r * r)
        for s in p:
            arcs[p, s] = net.edge(node, sinks[s], tokens * targets[s][1])
    return net, start, end, arcs


def route(patterns: dict[tuple[str, ...], int], targets: dict[str, tuple[float, int]], total: int) -> tuple[int, dict[tuple[tuple[str, ...], str], int]]:
    """Route ``total`` tokens to the quotas of the targets; the tokens routed and each pattern's flow.

    The r-th use of a pattern's tokens costs r squared, so texts are repeated only where fresh
    ones are spent.
    """
    net, start, end, arcs = _network(patterns, targets, total)
    done = net.run(start, end)
    return done, {k: net.flow_on(e) for k, e in arcs.items() if net.flow_on(e)}


def largest_total(patterns: dict[tuple[str, ...], int], targets: dict[str, tuple[float, int]]) -> int:
    """The most tokens at which every target that holds any text still reaches its quota."""
    held = {s: t for s, t in targets.items() if t[0] > 0 and any(s in p for p in patterns)}
    if not held:
        return 0
    need = lambda total: sum(int(t[0] * total) for t in held.values())
    usable = {p: n for q, n in patterns.items() if (p := tuple(s for s in q if s in held))}
    low, high = 0, int(sum(n * max(held[s][1] for s in p) for p, n in usable.items()) / sum(t[0] for t in held.values())) + 1
    while high - low > max(1, high // 1_000_000):
        middle = (low + high) // 2
        net, start, end, _ = _network(usable, held, middle)
        low, high = (middle, high) if net.fill(start, end) >= need(middle) else (low, middle)
    return low


def _count(vocab: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens = pa.array(count_tokens(b.column("text").to_pylist(), vocab), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), b.column("print"), tokens], names=["doc_id", "source", "print", "n_tokens"])

    return count


#: Sets of sources that the flow tells apart; texts of rarer sets serve one source of theirs.
MAX_PATTERNS = 1024


def mix_sources(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 17, buckets: int = 4096, vocab: str = DEFAULT_VOCAB, max_targets: int = 200, max_patterns: int = MAX_PATTERNS) -> tuple[DataFrame, DataFrame]:
    """Combine ``documents(doc_id, text, source)`` to the shares of ``targets(source, target_share, max_repeats)``.

    Returns the selection ``doc_id, source, repeats, n_tokens`` (``doc_id`` the smallest that holds
    the text, ``source`` the quota it serves, ``repeats`` how often it is used for it) and the
    report ``source, target_share, max_repeats, available_tokens, tokens, texts, actual_share,
    most_repeats``.  ``total_tokens`` is the size of the mix; by default the most at which every
    target that holds any text reaches its share.

    Defined cases: equal texts are one unit, whichever sources hold them; a source without a
    target and a null source take no part; a target without texts is reported with share 0;
    null and empty texts hold no tokens and aren't selected; a target given twice counts by its
    larger share; null shares count as 0 and null repeats as 1; a cap below 1 bars the source;
    more than ``max_targets`` targets are refused; of the sets of sources that hold one text the
    ``max_patterns`` with the most tokens are told apart, and a text of another set serves one of
    its sources, chosen by its hash, so the network is bounded and no text is lost; empty tables
    give no selection.
    """
    goal = targets.select(norm_source("source").alias("source"), F.coalesce(F.col("target_share"), F.lit(0.0)).cast("double").alias("target_share"), F.coalesce(F.col("max_repeats"), F.lit(1)).cast("int").alias("max_repeats"))
    goal = goal.filter("source is not null").groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("t")).select("source", "t.*")
    known = goal.limit(max_targets + 1).collect()
    if len(known) > max_targets:
        raise ValueError(f"more than {max_targets} targets")
    aims = {r["source"]: (max(0.0, r["target_share"]), r["max_repeats"]) for r in known if r["max_repeats"] >= 1}

    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), norm_source("source").alias("source"), F.md5("text").alias("print"), F.col("text").cast("string").alias("text"))
    texts = texts.filter(F.col("source").isin(list(aims)) & (F.length("text") > 0))
    sized = texts.mapInArrow(_count(vocab), "doc_id bigint, source string, print string, n_tokens bigint")
    # A text of a third of all rows is one row per task after the map-side combine, and its set of
    # sources is bounded by the targets.
    units = sized.groupBy("print").agg(F.min("doc_id").alias("doc_id"), F.min("n_tokens").alias("n_tokens"), F.array_sort(F.collect_set("source")).alias("pattern")).filter("n_tokens > 0")
    place = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), "print")), 1, 15), 16, 10).cast("bigint")
    units = units.select("doc_id", "n_tokens", F.col("pattern").alias("members"), place.alias("place"))
    units = materialize(units.withColumn("bucket", F.pmod("place", F.lit(buckets)).cast("int")), "mixing")
    common = units.groupBy("members").agg(F.sum("n_tokens").alias("n")).orderBy(F.desc("n"), "members").limit(max_patterns).select("members", F.lit(True).alias("kept"))
    alone = F.array(F.get("members", F.pmod("place", F.size("members"))))
    units = units.join(F.broadcast(common), "members", "left").withColumn("pattern", F.when(F.col("kept"), F.col("members")).otherwise(alone)).drop("kept")

    # At most max_patterns rows and one for each target.
    tokens = {tuple(r["pattern"]): int(r["n"]) for r in units.groupBy("pattern").agg(F.sum("n_tokens").alias("n")).collect()}
    total = largest_total(tokens, aims) if total_tokens is None else total_tokens
    flows = route(tokens, aims, total)[1] if tokens and total > 0 else {}
    segments = []
    for p, n in tokens.items():
        at = 0
        for s in p:  # the pattern's uses laid end to end: each source has one stretch of them
            if amount := flows.get((p, s), 0):
                segments.append((list(p), s, at, at + amount, n))
                at += amount
    spark = documents.sparkSession
    stretch = spark.createDataFrame(segments, "pattern array<string>, source string, low bigint, high bigint, size bigint")

    per_bucket = units.groupBy("pattern", "bucket").agg(F.sum("n_tokens").alias("n"))
    before = per_bucket.withColumn("from", F.sum("n").over(Window.partitionBy("pattern").orderBy("bucket")) - F.col("n")).drop("n")
    inside = F.sum("n_tokens").over(Window.partitionBy("pattern", "bucket").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, -1))
    placed = units.withColumn("in_bucket", F.coalesce(inside, F.lit(0))).join(before, ["pattern", "bucket"]).withColumn("start", F.col("from") + F.col("in_bucket"))
    # Use r of a text starts at start + r * size; count the uses that start inside the stretch.
    uses = F.ceil((F.col("high") - F.col("start")) / F.col("size")) - F.ceil((F.col("low") - F.col("start")) / F.col("size"))
    chosen = placed.join(stretch, "pattern").withColumn("repeats", uses.cast("int")).filter("repeats > 0").select("doc_id", "source", "repeats", "n_tokens")

    have = per_source_tokens(units)
    got = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.count(F.lit(1)).alias("texts"), F.max("repeats").alias("most_repeats"))
    report = goal.join(have, "source", "left").join(got, "source", "left").na.fill(0, ["available_tokens", "tokens", "texts", "most_repeats"])
    report = report.withColumn("actual_share", F.round(F.try_divide(F.col("tokens"), F.sum("tokens").over(Window.partitionBy(F.lit(1)))), 6))
    return chosen, report.select("source", "target_share", "max_repeats", "available_tokens", "tokens", "texts", F.coalesce("actual_share", F.lit(0.0)).alias("actual_share"), "most_repeats")


def per_source_tokens(units: DataFrame) -> DataFrame:
    """Tokens of the distinct texts each source holds."""
    return units.select(F.explode("members").alias("source"), "n_tokens").groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"))
