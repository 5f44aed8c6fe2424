"""Queries on bytes: vectors of ``embeddings`` quantised to byte images, and texts as images.

A capture set is three consecutive vectors; together the sets cover the whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bytefold.functions.formats import detect_format, parse_hex_pattern
from bytefold.operators import consensus as C
from bytefold.operators import entropy as E
from bytefold.operators import hits as H
from bytefold.operators import runs as R
from bytefold.operators import search as S
from bytefold.operators.chunks import bytes_of, chunked
from bytefold.plans import convergence as V
from bytefold.plans.funnel import CONVERGENCE_NS, brute_force, candidate_slices, held_images, neighborhood, nsweep, reduce_images, top_regions
from bytefold.plans.patterns import pattern_columns
from bytefold.session import table

CHUNK = 1 << 16
NEEDLES = [("term_entropy", b"entropy scan"), ("term_keys", b"session keys"), ("term_table", b"table"), ("term_overlap", b"0000"), ("term_cfg", b"in der "), ("term_hex", b"0x")]


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """One row per byte of each vector image: ``vec_id, label, grp, rank, off, v``."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("off", "x"))
    v = F.least(F.lit(255), F.greatest(F.lit(0), F.floor(F.col("x").cast("double") * 900 + 128))).cast("int")
    return e.select("vec_id", "label", F.floor(F.col("vec_id") / 3).cast("bigint").alias("grp"), F.col("off").cast("bigint").alias("off"), v.alias("v"))


def vector_images(spark: SparkSession, d: str) -> DataFrame:
    """The same as binary images: ``dump_id, label, grp, data``."""
    e = table(spark, d, "embeddings")
    v = F.transform("embedding", lambda x: F.lpad(F.hex(F.least(F.lit(255), F.greatest(F.lit(0), F.floor(x.cast("double") * 900 + 128))).cast("bigint")), 2, "0"))
    return e.select(F.col("vec_id").alias("dump_id"), "label", F.floor(F.col("vec_id") / 3).cast("bigint").alias("grp"), F.unhex(F.array_join(v, "")).alias("data"))


def texts(spark: SparkSession, d: str) -> DataFrame:
    """Documents as images of their UTF-8 bytes."""
    return table(spark, d, "documents", "doc_id").select(F.col("doc_id").alias("dump_id"), F.encode("text", "UTF-8").alias("data"))


def _set_states(spark: SparkSession, d: str) -> DataFrame:
    """Consensus states of every capture set."""
    return C.consensus_state(chunked(vector_images(spark, d), keep=["grp"]), F.col("grp"))


def _sets(spark: SparkSession, d: str) -> DataFrame:
    """Consensus of every capture set through the chunk kernels."""
    return C.expand(_set_states(spark, d), CHUNK).withColumn("grp", F.col("grp").cast("bigint"))


def _set_runs(spark: SparkSession, d: str, wanted: list[int]) -> DataFrame:
    """Runs of the wanted classes in every capture set, without a row per offset."""
    return C.state_runs(_set_states(spark, d), CHUNK, wanted).withColumn("grp", F.col("grp").cast("bigint"))


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def consensus_variance(spark: SparkSession, d: str) -> DataFrame:
    """Variance per offset over all images."""
    rows = C.expand(C.consensus_state(chunked(vector_images(spark, d))), CHUNK)
    return _rounded(rows.drop("grp"), "mean", "variance").withColumn("class", F.col("class").cast("int"))


def consensus_by_set(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_sets(spark, d), "mean", "variance")


def consensus_by_label(spark: SparkSession, d: str) -> DataFrame:
    """Consensus per library with built-in aggregates only."""
    return _rounded(C.consensus_of_bytes(vectors(spark, d), ["label"]), "mean", "variance")


def welford_merge(spark: SparkSession, d: str) -> DataFrame:
    """Two partial states merged into one."""
    images = vector_images(spark, d)
    part = lambda odd: C.consensus_state(chunked(images.filter(F.col("dump_id") % 2 == odd)))
    rows = C.expand(C.merge_states(part(0).unionByName(part(1))), CHUNK)
    return _rounded(rows.select("off", "n", "variance"), "variance")


def variance_class_counts(spark: SparkSession, d: str) -> DataFrame:
    return C.class_totals(_set_states(spark, d)).groupBy("class").agg(F.sum("offsets").alias("offsets"))


def variance_summary(spark: SparkSession, d: str) -> DataFrame:
    totals = C.class_totals(_set_states(spark, d)).withColumn("v", F.col("mean_variance") * F.col("offsets"))
    rows = totals.groupBy(F.col("grp").cast("bigint").alias("grp")).agg((F.sum("v") / F.sum("offsets")).alias("mean_variance"), F.min("min_variance").alias("min_variance"), F.max("max_variance").alias("max_variance"))
    return _rounded(rows, "mean_variance", "min_variance", "max_variance")


def variance_bands(spark: SparkSession, d: str) -> DataFrame:
    return _sets(spark, d).groupBy(C.band(F.col("variance"), *C.VARIANCE_BANDS).alias("band")).agg(F.count(F.lit(1)).alias("offsets"))


def static_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of low variance (at most structural) per set."""
    low = _sets(spark, d).filter(F.col("class") <= C.STRUCTURAL)
    return R.islands(low, ["grp"])


def static_regions(spark: SparkSession, d: str) -> DataFrame:
    """Regions of 4 or more unchanging bytes per set, of images whose bytes are only 0 or 255."""
    two = F.transform("embedding", lambda x: F.when(x >= 0, F.lit("FF")).otherwise(F.lit("00")))
    images = table(spark, d, "embeddings").select(F.col("vec_id").alias("dump_id"), F.floor(F.col("vec_id") / 3).cast("bigint").alias("grp"), F.unhex(F.array_join(two, "")).alias("data"))
    runs = C.state_runs(C.consensus_state(chunked(images, keep=["grp"]), F.col("grp")), CHUNK, [C.INVARIANT])
    return runs.filter("length >= 4").select(F.col("grp").cast("bigint").alias("grp"), "start", "end", "length", "mean_variance")


def volatile_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of key-candidate bytes of 4 or more per set."""
    return _rounded(_set_runs(spark, d, [C.KEY_CANDIDATE]).filter("length >= 4").drop("class"), "mean_variance")


def merged_runs(spark: SparkSession, d: str) -> DataFrame:
    """Volatile runs merged over gaps without an unchanging byte."""
    return R.merge_near(_set_runs(spark, d, [C.KEY_CANDIDATE, C.INVARIANT]), ["grp"], F.col("class") == C.KEY_CANDIDATE)


def longest_run(spark: SparkSession, d: str) -> DataFrame:
    return R.longest(_set_runs(spark, d, [C.KEY_CANDIDATE]), ["grp"]).select("grp", "start", "end", "length")


def inferred_fields(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(R.infer_fields(_sets(spark, d), ["grp"], F.lit(16), F.lit(16)), "mean_variance", digits=1)


def top_offsets(spark: SparkSession, d: str) -> DataFrame:
    """The five offsets of largest variance over all images."""
    return consensus_variance(spark, d).orderBy(F.desc("variance"), "off").limit(5).select("off", "variance")


def neighborhoods(spark: SparkSession, d: str) -> DataFrame:
    """Variance around the most variable offset of each set."""
    rows = _sets(spark, d)
    best = rows.groupBy("grp").agg(F.max_by("off", F.struct("variance", -F.col("off"))).alias("off")).withColumn("size", F.lit(1))
    near = neighborhood(rows, best, 4)
    return near.select("grp", "hit_off", "start", F.transform("variances", lambda x: F.round(x, 6)).alias("variances")).select("grp", "hit_off", F.posexplode("variances").alias("i", "variance"), "start").select("grp", "hit_off", (F.col("start") + F.col("i")).alias("off"), "variance")


def prefix_variances(spark: SparkSession, d: str) -> DataFrame:
    """Variance per label over its first N images, for every N of the reference and for all its images."""
    return _rounded(V.prefix_variance(_ranked_bytes(spark, d), ["label"], CONVERGENCE_NS, whole=True), "variance")


def convergence(spark: SparkSession, d: str) -> DataFrame:
    """Precision and recall of three candidate sets by number of images, offsets 16 to 31 being true."""
    ranked = _ranked_bytes(spark, d)
    bright = ranked.filter("rank = 1 and v >= 100").select("label", "off")
    truth = ranked.filter(F.col("off").between(16, 31)).select("label", "off").distinct()
    out = V.convergence(V.prefix_variance(ranked, ["label"], CONVERGENCE_NS, whole=True), bright, truth, None, ["label"], 8, 4, 0.5)
    return _rounded(out, "precision", "recall", "f1")


def _ranked_bytes(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d)
    order = rows.select("label", "vec_id").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")))
    return rows.join(order, ["label", "vec_id"])


def xor_diff(spark: SparkSession, d: str) -> DataFrame:
    """Bytes that differ between each vector and the next."""
    rows = vectors(spark, d).select("vec_id", "off", "v")
    return _rounded(H.xor_diff(rows, rows.withColumn("vec_id", F.col("vec_id") - 1), ["vec_id"]), "percent")


def static_mask(spark: SparkSession, d: str) -> DataFrame:
    return H.static_mask(vectors(spark, d), ["grp"])


def byte_roles(spark: SparkSession, d: str) -> DataFrame:
    return H.classify_runs(vectors(spark, d), ["grp"], "vec_id", 16, 16)


def set_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Wildcard pattern of each set: bytes that all its images share."""
    rows = vectors(spark, d)
    mask = H.static_mask(rows, ["grp"]).groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("off", "is_static"))), lambda x: x["is_static"]).alias("mask"))
    first = vector_images(spark, d).groupBy("grp").agg(F.min_by("data", "dump_id").alias("data"))
    return first.join(mask, "grp").select("grp", pattern_columns(F.col("data"), F.col("mask"), 0.0).alias("p")).select("grp", "p.length", "p.wildcard_pattern", "p.static_ratio", "p.static_count")


def text_entropy(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(E.image_entropy(texts(spark, d)), "entropy")


def _profile(spark: SparkSession, d: str) -> DataFrame:
    return E.entropy_profile(chunked(texts(spark, d), 31), 32, 16)


def entropy_profile(spark: SparkSession, d: str) -> DataFrame:
    """Entropy of every window of 32 bytes at multiples of 16."""
    return _rounded(_profile(spark, d), "entropy")


def entropy_bands(spark: SparkSession, d: str) -> DataFrame:
    return E.entropy_profile(chunked(texts(spark, d), 31), 32, 1).groupBy(C.band(F.col("entropy"), *C.ENTROPY_BANDS).alias("band")).agg(F.count(F.lit(1)).alias("windows"))


def entropy_stats(spark: SparkSession, d: str) -> DataFrame:
    """Least, largest and mean entropy of each text with the sum of its sampled points' offsets and entropies."""
    rows = E.entropy_stats(_profile(spark, d), ["dump_id"])
    total = lambda f: F.aggregate("sample", F.lit(0.0), lambda a, x: a + x[f].cast("double"))
    out = rows.select("dump_id", "min_entropy", "max_entropy", "mean_entropy", "points", F.size("sample").alias("sampled"), total("off").cast("bigint").alias("sample_offsets"), total("entropy").alias("sample_entropy"))
    return _rounded(out, "min_entropy", "max_entropy", "mean_entropy", "sample_entropy", digits=5)


def high_entropy_regions(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(E.high_regions(_profile(spark, d), 4.0, 32, 16), "mean_entropy")


def entropy_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Bytes covered by high-entropy windows."""
    return E.coverage(_profile(spark, d), 4.0, 32, 16).groupBy("dump_id").agg(F.sum(F.col("end") - F.col("start")).alias("covered"))


def _digits(spark: SparkSession, d: str) -> DataFrame:
    return bytes_of(texts(spark, d)).filter(F.col("v").between(48, 57))


def aligned_block_filter(spark: SparkSession, d: str) -> DataFrame:
    """Digits in aligned blocks inside the text that hold at least a quarter of digits."""
    size = texts(spark, d).select("dump_id", F.octet_length("data").cast("bigint").alias("n"))
    rows = _digits(spark, d).join(size, "dump_id")
    return R.aligned_blocks(rows, ["dump_id"], F.col("n"), 32, 8, 0.25).groupBy("dump_id").agg(F.count(F.lit(1)).alias("kept"))


def aligned_block_set(spark: SparkSession, d: str) -> DataFrame:
    """The same by the set variant, whose blocks may hang over the end."""
    return R.aligned_blocks(_digits(spark, d), ["dump_id"], None, 32, 16, 0.5).groupBy("dump_id").agg(F.count(F.lit(1)).alias("kept"))


def exact_hits(spark: SparkSession, d: str) -> DataFrame:
    """Every occurrence of the needles with its offset."""
    return S.exact_hits(chunked(texts(spark, d), S.needle_halo(NEEDLES)), NEEDLES)


def needle_join(spark: SparkSession, d: str) -> DataFrame:
    """The same with the needles in a table, joined by their first bytes."""
    needles = spark.createDataFrame([(k, bytearray(v)) for k, v in NEEDLES], "secret_type string, value binary")
    return S.contains_join(chunked(texts(spark, d), S.needle_halo(NEEDLES)), needles)


def static_hits(spark: SparkSession, d: str) -> DataFrame:
    """Hits of the needles that touch no run of digits."""
    hits = S.exact_hits(chunked(texts(spark, d), S.needle_halo(NEEDLES)), NEEDLES)
    digits = R.islands(_digits(spark, d), ["dump_id"]).select("dump_id", "start", "end")
    return S.hits_in_static(hits, digits, ["dump_id"])


def regex_hits(spark: SparkSession, d: str) -> DataFrame:
    """Non-overlapping matches of a user's pattern."""
    return S.regex_search(texts(spark, d), [("offset", "0x[0-9a-f]+"), ("broken", "("), ("empty", "")])


def ascii_strings(spark: SparkSession, d: str) -> DataFrame:
    """Printable runs of 4 or more bytes."""
    return S.strings_of(texts(spark, d))


def utf8_strings(spark: SparkSession, d: str) -> DataFrame:
    """Runs of 4 or more printable or multi-byte characters."""
    return S.strings_of(texts(spark, d), 4, "utf-8").select("dump_id", "off", "length", F.length("value").alias("characters"), F.md5("value").alias("digest"))


def hex_dump(spark: SparkSession, d: str) -> DataFrame:
    return S.hex_lines(texts(spark, d)).select("dump_id", "off", "hex")


def value_formats(spark: SparkSession, d: str) -> DataFrame:
    """Formats that the found values begin with."""
    v = table(spark, d, "findings").select(parse_hex_pattern(F.col("value_hex")).alias("b")).filter("b is not null")
    return v.groupBy(F.coalesce(detect_format(F.col("b")), F.lit("none")).alias("format")).agg(F.count(F.lit(1)).alias("n"))


def funnel_stages(spark: SparkSession, d: str) -> DataFrame:
    """Bytes left after each stage of the funnel, per label and number of images."""
    return reduce_images(_ranked(spark, d), CONVERGENCE_NS, whole=True, entropy_threshold=4.0, min_region=8, min_variance=500.0)[0]


def funnel_regions(spark: SparkSession, d: str) -> DataFrame:
    """The regions that the funnel leaves, per label and number of images."""
    regions = reduce_images(_ranked(spark, d), CONVERGENCE_NS, whole=True, entropy_threshold=4.0, min_region=8, min_variance=500.0)[1]
    # Means of integers lie halfway between two roundings at times: a millionth up decides these alike everywhere.
    return _rounded(regions.withColumn("mean_variance", F.col("mean_variance") + 1e-6), "mean_entropy", "mean_variance", digits=4)


def best_regions(spark: SparkSession, d: str) -> DataFrame:
    """The two regions of highest mean variance per label and number of images from 3 on."""
    regions = reduce_images(_ranked(spark, d), CONVERGENCE_NS, whole=True, entropy_threshold=4.0, min_region=8, min_variance=500.0)[1]
    return top_regions(regions.filter("n >= 3"), ["grp", "n"], 2).select("grp", "n", "position", "off", "length")


def sweep(spark: SparkSession, d: str) -> DataFrame:
    """The sweep over N with a predicate that takes slices without a zero byte."""
    return nsweep(_ranked(spark, d), CONVERGENCE_NS, lambda: lambda value: 0 not in value, (16,), 8, whole=True, entropy_threshold=4.0, min_region=8, min_variance=500.0)


def first_hits(spark: SparkSession, d: str) -> DataFrame:
    """The first slice without a zero byte of each label and N, by offset and size."""
    images = _ranked(spark, d)
    regions = reduce_images(images, CONVERGENCE_NS, whole=True, entropy_threshold=4.0, min_region=8, min_variance=500.0)[1]
    slices = candidate_slices(regions, held_images(images).filter("rank = 1").select("grp", "data"), [16, 8], 8)
    return brute_force(slices, lambda: lambda value: 0 not in value, exhaustive=False).select("grp", "n", "off", "size", F.lower(F.hex("value")).alias("value"))


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    images = vector_images(spark, d)
    return images.select(F.col("label").cast("string").alias("grp"), F.row_number().over(Window.partitionBy("label").orderBy("dump_id")).alias("rank"), "dump_id", "data")


_QUERIES = (
    consensus_variance, consensus_by_set, consensus_by_label, welford_merge, variance_class_counts, variance_summary, variance_bands, static_runs, static_regions, volatile_runs,
    merged_runs, longest_run, inferred_fields, top_offsets, neighborhoods, prefix_variances, convergence, xor_diff, static_mask, byte_roles, set_patterns, text_entropy,
    entropy_profile, entropy_bands, entropy_stats, high_entropy_regions, entropy_coverage, aligned_block_filter, aligned_block_set, exact_hits, needle_join, static_hits,
    regex_hits, ascii_strings, utf8_strings, hex_dump, value_formats, funnel_stages, funnel_regions, best_regions, sweep, first_hits,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


_VEC = """vec AS (SELECT vec_id, label, vec_id // 3 AS grp, CAST(o - 1 AS BIGINT) AS off,
    CAST(least(255, greatest(0, floor(CAST(embedding[o] AS DOUBLE) * 900 + 128))) AS BIGINT) AS v
  FROM (SELECT *, unnest(generate_series(1, len(embedding))) AS o FROM embeddings))"""
_CLASS = "CASE WHEN variance = 0 THEN 0 WHEN variance <= 200 THEN 1 WHEN variance <= 3000 THEN 2 ELSE 3 END"


def _con(by: str) -> str:
    key = f"{by}, " if by else ""
    return f"""con AS (SELECT *, {_CLASS} AS class FROM (SELECT {key}off, count(*) AS n, sum(v) / count(*) AS mean,
    CAST(count(*) * sum(v * v) - sum(v) * sum(v) AS DOUBLE) / CAST(count(*) * count(*) AS DOUBLE) AS variance FROM vec GROUP BY {key}off))"""


_SETS = f"WITH {_VEC}, {_con('grp')}"
_RUNS = """runs AS (SELECT grp, min(off) AS start, max(off) + 1 AS "end", count(*) AS length, avg(variance) AS mv
  FROM (SELECT *, off - row_number() OVER (PARTITION BY grp ORDER BY off) AS g FROM con WHERE {cond}) GROUP BY grp, g)"""
_BYTES = """byt AS (SELECT doc_id, CAST(o - 1 AS BIGINT) AS off, CAST(concat('0x', h[o]) AS BIGINT) AS v FROM (
    SELECT doc_id, h, unnest(generate_series(1, len(h))) AS o FROM (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS h FROM documents WHERE text IS NOT NULL)))"""


def _sliding(window: int, name: str) -> str:
    """Entropy of every window: ``name(doc_id, off, e)``.

    Moving on by one byte changes two counts; the counts are those of equal bytes near by.  The sums
    are kept in whole 2^-40 parts, so they are exact however long a text is.
    """
    t = lambda c: f"CAST(round(CASE WHEN {c} > 0 THEN ({c}) * log2({c}) ELSE 0 END * 1099511627776) AS BIGINT)"
    reach = window - 1
    return f"""{name}_n AS (SELECT doc_id, off, v, count(*) OVER (PARTITION BY doc_id, v ORDER BY off RANGE BETWEEN 1 FOLLOWING AND {reach} FOLLOWING) AS nx, count(*) OVER (PARTITION BY doc_id, v ORDER BY off RANGE BETWEEN {reach} PRECEDING AND 1 PRECEDING) AS pv FROM byt),
{name}_s AS (SELECT doc_id, sum({t('c')}) AS s0 FROM (SELECT doc_id, v, count(*) AS c FROM byt WHERE off < {window} GROUP BY ALL) GROUP BY 1),
{name}_d AS (SELECT doc_id, off + 1 AS off, {t('nx')} - {t('(nx + 1)')} + {t('(pn + 1)')} - {t('pn')} AS d FROM (SELECT doc_id, off, nx, lead(pv, {window}) OVER (PARTITION BY doc_id ORDER BY off) AS pn FROM {name}_n) WHERE pn IS NOT NULL
  UNION ALL SELECT doc_id, 0, s0 FROM {name}_s JOIN (SELECT doc_id, count(*) AS n FROM byt GROUP BY 1) USING (doc_id) WHERE n >= {window}),
{name} AS (SELECT doc_id, off, greatest(0, log2({window}) - CAST(sum(d) OVER (PARTITION BY doc_id ORDER BY off) AS DOUBLE) / (1099511627776.0::DOUBLE * {window})) AS e FROM {name}_d)"""


def _prof(step: int) -> str:
    return f"siz AS (SELECT doc_id, count(*) AS n FROM byt GROUP BY 1), {_sliding(32, 'sli')}, pro AS (SELECT doc_id AS dump_id, off, round(e, 9) AS entropy FROM sli WHERE off % {step} = 0)"


_NS = f"""k AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rank FROM embeddings),
z AS (SELECT label, max(rank) AS size FROM k GROUP BY 1),
n AS (SELECT DISTINCT label, n FROM (SELECT label, size, unnest({CONVERGENCE_NS} || [size]) AS n FROM z) WHERE n <= size)"""

#: The whole funnel on images of 64 bytes: variance, dense blocks, covered bytes, regions with their means.
_FUNNEL = f"""WITH {_VEC}, {_NS},
vr AS (SELECT label, n, off, CASE WHEN n < 3 THEN 0 ELSE CAST(n * sum(v * v) - sum(v) * sum(v) AS DOUBLE) / (n * n) END AS variance FROM vec JOIN k USING (label, vec_id) JOIN n USING (label) WHERE rank <= n GROUP BY label, n, off),
ma AS (SELECT *, n < 3 OR variance >= 500 AS m FROM vr),
gr AS (SELECT unnest(generate_series(0, 32, 8)) AS w),
bl AS (SELECT label, n, w FROM ma JOIN gr ON off BETWEEN w AND w + 31 WHERE m GROUP BY ALL HAVING count(*) >= 16),
ref AS (SELECT label, off, v FROM vec JOIN k USING (label, vec_id) WHERE rank = 1),
pro AS (SELECT label, w, greatest(0, 5 - sum(c * log2(c)) / 32) AS e FROM (SELECT label, w, v, count(*) AS c FROM ref JOIN gr ON off BETWEEN w AND w + 31 GROUP BY ALL) GROUP BY 1, 2),
cov AS (SELECT DISTINCT label, off FROM ref JOIN pro USING (label) WHERE round(e, 9) >= 4.0 AND off BETWEEN w AND w + 31),
kep AS (SELECT a.*, m AND b.off IS NOT NULL AS dense, m AND b.off IS NOT NULL AND c.off IS NOT NULL AS keep FROM ma a
  LEFT JOIN (SELECT DISTINCT label, n, off FROM ma JOIN bl USING (label, n) WHERE off BETWEEN w AND w + 31) b USING (label, n, off) LEFT JOIN cov c USING (label, off)),
isl AS (SELECT label, n, min(off) AS start, max(off) + 1 AS stop, count(*) AS length, avg(variance) AS mean_variance FROM (SELECT *, off - row_number() OVER (PARTITION BY label, n ORDER BY off) AS g FROM kep WHERE keep) GROUP BY label, n, g HAVING count(*) >= 8),
own AS (SELECT label, n, start, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS e FROM (SELECT i.label, n, start, v, count(*) AS c FROM isl i JOIN ref r ON r.label = i.label AND off >= start AND off < stop GROUP BY ALL) GROUP BY 1, 2, 3),
reg AS (SELECT i.*, coalesce(p.e, o.e) AS mean_entropy FROM isl i JOIN own o USING (label, n, start)
  LEFT JOIN (SELECT i.label, n, start, avg(e) AS e FROM isl i JOIN pro p ON p.label = i.label AND w >= start AND w + 8 <= stop GROUP BY 1, 2, 3) p USING (label, n, start))
"""
_SLICES = """,
sli AS (SELECT r.label, r.n, r.off, r.size, count(*) FILTER (WHERE v = 0) = 0 AS hit, string_agg(format('{{:02x}}', v), '' ORDER BY f.off) AS value
  FROM (SELECT label, n, stop, size, unnest(generate_series(CAST(ceil(start / 8) * 8 AS BIGINT), stop - size, 8)) AS off FROM reg, (SELECT unnest([{sizes}]) AS size)) r
  JOIN ref f ON f.label = r.label AND f.off >= r.off AND f.off < r.off + r.size GROUP BY 1, 2, 3, 4)"""


def _hits() -> str:
    """Every occurrence of the needles: by the pieces between them, and by windows for the one that overlaps itself."""
    parts = []
    for kind, value in NEEDLES:
        v, size = value.decode(), len(value)
        if kind == "term_overlap":
            parts.append(f"SELECT doc_id AS dump_id, '{kind}' AS secret_type, off, {size} AS length FROM (SELECT doc_id, off, v, lead(v, 1) OVER w AS a, lead(v, 2) OVER w AS b, lead(v, 3) OVER w AS c FROM byt WINDOW w AS (PARTITION BY doc_id ORDER BY off)) WHERE v = 48 AND a = 48 AND b = 48 AND c = 48")
        else:
            parts.append(f"SELECT doc_id AS dump_id, '{kind}' AS secret_type, CAST(sum(strlen(p)) OVER (PARTITION BY doc_id ORDER BY i) + (i - 1) * {size} AS BIGINT) AS off, {size} AS length FROM (SELECT doc_id, unnest(string_split(text, '{v}')) AS p, generate_subscripts(string_split(text, '{v}'), 1) AS i, len(string_split(text, '{v}')) AS m FROM documents WHERE contains(text, '{v}')) QUALIFY i < m")
    return " UNION ALL ".join(parts)


def oracle_sql() -> dict[str, str]:
    profile = f"WITH {_BYTES}, {_prof(16)}"
    ents = """ent AS (SELECT doc_id, count(*) AS c FROM byt GROUP BY doc_id, v)"""
    blocks = """spr AS (SELECT doc_id, off, unnest(generate_series(greatest({low}, ((off - 32) // {a} + CASE WHEN (off - 32) % {a} < 0 THEN 0 ELSE 1 END) * {a}), {high}, {a})) AS s FROM dig JOIN siz USING (doc_id)),
den AS (SELECT doc_id, s FROM spr GROUP BY ALL HAVING count(*) >= {need})
SELECT doc_id AS dump_id, count(DISTINCT off) AS kept FROM spr SEMI JOIN den USING (doc_id, s) GROUP BY 1"""
    dig = "dig AS (SELECT doc_id, off FROM byt WHERE v BETWEEN 48 AND 57)"
    hits = f"hits AS ({_hits()})"
    clean = "upper(replace(value_hex, ' ', ''))"
    magic = {"elf": "7F454C46", "macho64_le": "CFFAEDFE", "macho32_le": "CEFAEDFE", "macho64_be": "FEEDFACF", "macho32_be": "FEEDFACE", "msl": "4D454D534C494345", "sqlite3": "53514C69746520666F726D6174203300", "gzip": "1F8B", "zip": "504B0304", "png": "89504E470D0A1A0A", "pdf": "25504446"}
    cases = " ".join(f"WHEN starts_with(h, '{m}') THEN '{n}'" for n, m in magic.items())
    return {
        "consensus_variance": f"WITH {_VEC}, {_con('')} SELECT off, n, round(mean, 6) AS mean, round(variance, 6) AS variance, class FROM con",
        "consensus_by_set": f"{_SETS} SELECT grp, off, n, round(mean, 6) AS mean, round(variance, 6) AS variance, class FROM con",
        "consensus_by_label": f"WITH {_VEC}, {_con('label')} SELECT label, off, n, round(mean, 6) AS mean, round(variance, 6) AS variance, class FROM con",
        "welford_merge": f"WITH {_VEC} SELECT off, count(*) AS n, round(var_pop(v), 6) AS variance FROM vec GROUP BY off",
        "variance_class_counts": f"{_SETS} SELECT class, count(*) AS offsets FROM con GROUP BY class",
        "variance_summary": f"{_SETS} SELECT grp, round(avg(variance), 6) AS mean_variance, round(min(variance), 6) AS min_variance, round(max(variance), 6) AS max_variance FROM con GROUP BY grp",
        "variance_bands": f"{_SETS} SELECT CASE WHEN variance < 1 THEN 'static' WHEN variance < 50 THEN 'low' WHEN variance < 200 THEN 'medium' ELSE 'high' END AS band, count(*) AS offsets FROM con GROUP BY 1",
        "static_runs": f"""{_SETS}, {_RUNS.format(cond='class <= 1')} SELECT grp, start, "end", length FROM runs""",
        "static_regions": """SELECT grp, min(off) AS start, max(off) + 1 AS "end", count(*) AS length, 0.0::DOUBLE AS mean_variance FROM (SELECT grp, off, off - row_number() OVER (PARTITION BY grp ORDER BY off) AS g
  FROM (SELECT vec_id // 3 AS grp, CAST(o - 1 AS BIGINT) AS off, embedding[o] >= 0 AS b FROM (SELECT *, unnest(generate_series(1, len(embedding))) AS o FROM embeddings)) GROUP BY grp, off HAVING bool_and(b) OR NOT bool_or(b)) GROUP BY grp, g HAVING count(*) >= 4""",
        "volatile_runs": f"""{_SETS}, {_RUNS.format(cond='class = 3')} SELECT grp, start, "end", length, round(mv, 6) AS mean_variance FROM runs WHERE length >= 4""",
        "merged_runs": f"""{_SETS}, {_RUNS.format(cond='class = 3')},
g AS (SELECT *, lag("end") OVER (PARTITION BY grp ORDER BY start) AS pe FROM runs),
f AS (SELECT *, CASE WHEN pe IS NULL OR start - pe > 4 OR EXISTS (SELECT 1 FROM con c WHERE c.grp = g.grp AND c.class = 0 AND c.off >= g.pe AND c.off < g.start) THEN 1 ELSE 0 END AS nw FROM g),
h AS (SELECT *, sum(nw) OVER (PARTITION BY grp ORDER BY start) AS k FROM f)
SELECT grp, min(start) AS start, max("end") AS "end", max("end") - min(start) AS length FROM h GROUP BY grp, k""",
        "longest_run": f"""{_SETS}, {_RUNS.format(cond='class = 3')} SELECT grp, start, "end", length FROM runs QUALIFY row_number() OVER (PARTITION BY grp ORDER BY length DESC, start) = 1""",
        "inferred_fields": f"""{_SETS},
r AS (SELECT *, CASE WHEN off >= 16 AND off < 32 THEN 'key' WHEN variance <= 2000 THEN 'static' ELSE 'dynamic' END AS role FROM con),
i AS (SELECT grp, role, min(off) AS start, max(off) + 1 AS "end", count(*) AS length, round(round(avg(variance), 2), 1) AS mean_variance FROM (SELECT *, off - row_number() OVER (PARTITION BY grp, role ORDER BY off) AS g FROM r) GROUP BY grp, role, g)
SELECT *, concat(role, '_', row_number() OVER (PARTITION BY grp, role ORDER BY start) - 1) AS label FROM i""",
        "top_offsets": f"WITH {_VEC}, {_con('')} SELECT off, round(variance, 6) AS variance FROM con ORDER BY variance DESC, off LIMIT 5",
        "neighborhoods": f"""{_SETS}, b AS (SELECT grp, off AS hit_off FROM con QUALIFY row_number() OVER (PARTITION BY grp ORDER BY variance DESC, off) = 1)
SELECT grp, hit_off, off, round(variance, 6) AS variance FROM b JOIN con USING (grp) WHERE off BETWEEN hit_off - 4 AND hit_off + 4""",
        "prefix_variances": f"""WITH {_VEC}, {_NS}
SELECT label, off, CAST(n AS INTEGER) AS n, round(CAST(n * sum(v * v) - sum(v) * sum(v) AS DOUBLE) / (n * n), 6) AS variance FROM vec JOIN k USING (label, vec_id) JOIN n USING (label) WHERE rank <= n GROUP BY label, off, n HAVING count(*) = n""",
        "convergence": f"""WITH {_VEC}, {_NS},
p AS (SELECT label, off, n FROM vec JOIN k USING (label, vec_id) JOIN n USING (label) WHERE rank <= n GROUP BY ALL HAVING count(*) = n AND var_pop(v) > 3000),
c AS (SELECT p.* FROM p JOIN (SELECT label, off FROM vec JOIN k USING (label, vec_id) WHERE rank = 1 AND v >= 100) USING (label, off)),
lo AS (SELECT label, n, min(off) // 4 * 4 AS lo FROM c GROUP BY 1, 2),
s AS (SELECT label, n, off, unnest(generate_series(greatest(lo, ((off - 8) // 4 + CASE WHEN (off - 8) % 4 < 0 THEN 0 ELSE 1 END) * 4), off // 4 * 4, 4)) AS s FROM c JOIN lo USING (label, n)),
a AS (SELECT DISTINCT label, off, n FROM s SEMI JOIN (SELECT label, n, s FROM s GROUP BY ALL HAVING count(*) >= 4) USING (label, n, s)),
f AS (SELECT *, 'variance' AS candidates FROM p UNION ALL SELECT *, 'combined' FROM c UNION ALL SELECT *, 'aligned' FROM a),
t AS (SELECT label, off, n, candidates FROM n, (SELECT unnest(generate_series(16, 31)) AS off), (SELECT unnest(['variance', 'combined', 'aligned']) AS candidates)),
m AS (SELECT label, n, candidates, count(*) FILTER (WHERE f.off IS NOT NULL AND t.off IS NOT NULL) AS tp, count(*) FILTER (WHERE t.off IS NULL) AS fp, count(*) FILTER (WHERE f.off IS NULL) AS fn
  FROM (SELECT *, off AS o FROM f) f FULL JOIN (SELECT *, off AS o FROM t) t USING (label, n, candidates, o) GROUP BY 1, 2, 3),
q AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM m)
SELECT label, CAST(n AS INTEGER) AS n, candidates, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM q""",
        "xor_diff": f"WITH {_VEC} SELECT a.vec_id, count(*) AS compared, sum(CASE WHEN xor(a.v, b.v) <> 0 THEN 1 ELSE 0 END)::BIGINT AS different, round(sum(CASE WHEN a.v <> b.v THEN 100.0::DOUBLE ELSE 0 END) / count(*), 6) AS percent FROM vec a JOIN vec b ON b.vec_id = a.vec_id + 1 AND a.off = b.off GROUP BY a.vec_id",
        "static_mask": f"WITH {_VEC} SELECT grp, off, min(v) = max(v) AS is_static FROM vec GROUP BY grp, off",
        "byte_roles": f"WITH {_VEC} SELECT grp, off, CASE WHEN off >= 16 AND off < 32 THEN 'key' WHEN min(v) = max(v) THEN 'same' ELSE 'different' END AS role FROM vec GROUP BY grp, off",
        "set_patterns": f"""WITH {_VEC}, m AS (SELECT grp, off, min(v) = max(v) AS s, arg_min(v, vec_id) AS r FROM vec GROUP BY grp, off)
SELECT grp, CAST(count(*) AS INTEGER) AS length, string_agg(CASE WHEN s THEN format('{{:02x}}', r) ELSE '??' END, ' ' ORDER BY off) AS wildcard_pattern, round(avg(s::INT), 4) AS static_ratio, CAST(sum(s::INT) AS INTEGER) AS static_count FROM m GROUP BY grp""",
        "text_entropy": f"WITH {_BYTES}, {ents} SELECT d.doc_id AS dump_id, round(coalesce(log2(sum(c)) - sum(c * log2(c)) / sum(c), 0) + 0.0, 6) AS entropy FROM documents d LEFT JOIN ent USING (doc_id) GROUP BY 1",
        "entropy_profile": f"{profile} SELECT dump_id, off, round(entropy, 6) AS entropy FROM pro",
        "entropy_bands": f"WITH {_BYTES}, {_prof(1)} SELECT CASE WHEN entropy < 2 THEN 'low' WHEN entropy < 5 THEN 'medium' WHEN entropy < 7 THEN 'high' ELSE 'random' END AS band, count(*) AS windows FROM pro GROUP BY 1",
        "entropy_stats": f"{profile}, z AS (SELECT *, row_number() OVER (PARTITION BY dump_id ORDER BY off) - 1 AS i, count(*) OVER (PARTITION BY dump_id) AS n FROM pro) SELECT dump_id, round(min(entropy), 5) AS min_entropy, round(max(entropy), 5) AS max_entropy, round(avg(entropy), 5) AS mean_entropy, count(*) AS points, CAST(count(*) FILTER (WHERE i % greatest(1, n // 200) = 0) AS INTEGER) AS sampled, CAST(sum(off) FILTER (WHERE i % greatest(1, n // 200) = 0) AS BIGINT) AS sample_offsets, round(sum(entropy) FILTER (WHERE i % greatest(1, n // 200) = 0), 5) AS sample_entropy FROM z GROUP BY 1",
        "high_entropy_regions": f"""{profile}, l AS (SELECT dump_id, max(off) AS last FROM pro GROUP BY 1),
r AS (SELECT dump_id, min(off) AS start, max(off) + 16 AS e, avg(entropy) AS me FROM (SELECT *, off // 16 - row_number() OVER (PARTITION BY dump_id ORDER BY off) AS g FROM pro WHERE entropy >= 4.0) GROUP BY dump_id, g)
SELECT dump_id, start, least(e, last) AS "end", round(me, 6) AS mean_entropy FROM r JOIN l USING (dump_id) WHERE least(e, last) - start >= 32""",
        "entropy_coverage": f"{profile} SELECT dump_id, count(DISTINCT off + k) AS covered FROM pro, (SELECT unnest(generate_series(0, 31)) AS k) WHERE entropy >= 4.0 GROUP BY 1",
        "aligned_block_filter": f"WITH {_BYTES}, siz AS (SELECT doc_id, count(*) AS n FROM byt GROUP BY 1), {dig}, " + blocks.format(low="0", a=8, high="least(off // 8 * 8, CASE WHEN n >= 32 THEN (n - 32) // 8 * 8 ELSE -1 END)", need=8),
        "aligned_block_set": f"WITH {_BYTES}, {dig}, siz AS (SELECT doc_id, min(off) // 16 * 16 AS lo FROM dig GROUP BY 1), " + blocks.format(low="lo", a=16, high="off // 16 * 16", need=16),
        "exact_hits": f"WITH {_BYTES}, {hits} SELECT * FROM hits",
        "needle_join": f"WITH {_BYTES}, {hits} SELECT * FROM hits",
        "static_hits": f"WITH {_BYTES}, {hits}, {dig} SELECT * FROM hits h WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id, off - k AS o, k FROM dig, (SELECT unnest(generate_series(0, 11)) AS k)) g WHERE g.doc_id = h.dump_id AND g.o = h.off AND g.k < h.length)",
        "regex_hits": """WITH m AS (SELECT doc_id, regexp_extract_all(text, '0x[0-9a-f]+') AS m, regexp_split_to_array(text, '0x[0-9a-f]+') AS p FROM documents WHERE regexp_matches(text, '0x[0-9a-f]+')),
u AS (SELECT doc_id, unnest(m) AS x, unnest(p[:len(m)]) AS b, generate_subscripts(m, 1) AS i FROM m)
SELECT doc_id AS dump_id, 'offset' AS label, CAST(sum(strlen(b) + strlen(x)) OVER (PARTITION BY doc_id ORDER BY i) - strlen(x) AS BIGINT) AS off, CAST(strlen(x) AS INTEGER) AS length FROM u""",
        "ascii_strings": f"WITH {_BYTES}, p AS (SELECT *, off - row_number() OVER (PARTITION BY doc_id ORDER BY off) AS g FROM byt WHERE v BETWEEN 32 AND 126 OR v IN (9, 10, 13)) SELECT doc_id AS dump_id, min(off) AS off, CAST(count(*) AS INTEGER) AS length, string_agg(chr(CAST(v AS INTEGER)), '' ORDER BY off) AS value FROM p GROUP BY doc_id, g HAVING count(*) >= 4",
        "utf8_strings": f"""WITH {_BYTES}, p AS (SELECT *, off - row_number() OVER (PARTITION BY doc_id ORDER BY off) AS g FROM byt WHERE v BETWEEN 32 AND 126 OR v IN (9, 10, 13) OR v > 127)
SELECT doc_id AS dump_id, min(off) AS off, CAST(count(*) AS INTEGER) AS length, CAST(count(*) FILTER (WHERE v & 192 <> 128) AS INTEGER) AS characters, md5(CAST(unhex(string_agg(format('{{:02x}}', v), '' ORDER BY off)) AS BLOB)) AS digest FROM p GROUP BY doc_id, g HAVING count(*) FILTER (WHERE v & 192 <> 128) >= 4""",
        "hex_dump": "SELECT doc_id AS dump_id, CAST((o - 1) * 16 AS BIGINT) AS off, lower(trim(regexp_replace(substr(h, (o - 1) * 32 + 1, 32), '(..)', '\\1 ', 'g'))) AS hex FROM (SELECT doc_id, h, unnest(generate_series(1, CAST(ceil(length(h) / 32) AS BIGINT))) AS o FROM (SELECT doc_id, hex(encode(text)) AS h FROM documents WHERE text <> ''))",
        "funnel_stages": _FUNNEL + "SELECT CAST(label AS VARCHAR) AS grp, CAST(n AS INTEGER) AS n, count(*) AS total, count(*) FILTER (WHERE m) AS variance, count(*) FILTER (WHERE dense) AS aligned, count(*) FILTER (WHERE keep) AS high_entropy FROM kep GROUP BY 1, 2",
        "funnel_regions": _FUNNEL + "SELECT CAST(label AS VARCHAR) AS grp, CAST(n AS INTEGER) AS n, start AS off, length, round(mean_entropy, 4) AS mean_entropy, round(mean_variance + 1e-6, 4) AS mean_variance FROM reg",
        "best_regions": _FUNNEL + "SELECT CAST(label AS VARCHAR) AS grp, CAST(n AS INTEGER) AS n, CAST(row_number() OVER w AS INTEGER) AS position, start AS off, length FROM reg WHERE n >= 3 WINDOW w AS (PARTITION BY label, n ORDER BY mean_variance DESC, mean_entropy DESC, start) QUALIFY row_number() OVER w <= 2",
        "sweep": _FUNNEL + f"""{_SLICES.format(sizes="16")}
SELECT CAST(s.label AS VARCHAR) AS grp, CAST(s.n AS INTEGER) AS n, s.total, s.variance, s.aligned, s.high_entropy, coalesce(r.c, 0) AS regions, coalesce(x.c, 0) AS candidates, coalesce(x.h, 0) AS hits, x.o AS hit_off, coalesce(x.c, 0) AS tried
FROM (SELECT label, n, count(*) AS total, count(*) FILTER (WHERE m) AS variance, count(*) FILTER (WHERE dense) AS aligned, count(*) FILTER (WHERE keep) AS high_entropy FROM kep GROUP BY 1, 2) s
LEFT JOIN (SELECT label, n, count(*) AS c FROM reg GROUP BY 1, 2) r USING (label, n)
LEFT JOIN (SELECT label, n, count(*) AS c, count(*) FILTER (WHERE hit) AS h, min(off) FILTER (WHERE hit) AS o FROM sli GROUP BY 1, 2) x USING (label, n)""",
        "first_hits": _FUNNEL + f"""{_SLICES.format(sizes="16, 8")} SELECT CAST(label AS VARCHAR) AS grp, CAST(n AS INTEGER) AS n, off, CAST(size AS INTEGER) AS size, value FROM sli WHERE hit QUALIFY row_number() OVER (PARTITION BY label, n ORDER BY off, size) = 1""",
        "value_formats": f"""WITH x AS (SELECT CASE WHEN length({clean}) % 2 = 1 THEN '0' || {clean} ELSE {clean} END AS h FROM findings WHERE regexp_full_match({clean}, '[0-9A-F]*'))
SELECT format, count(*) AS n FROM (SELECT CASE WHEN length(h) < 8 THEN 'none' {cases} WHEN starts_with(h, '3082') AND CAST(concat('0x', substr(h, 5, 4)) AS BIGINT) >= 64 THEN 'asn1_der' ELSE 'none' END AS format FROM x) GROUP BY 1""",
    }
