"""Queries of the training-data problems tagged llm, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytefold.functions.normalize import norm_hex, norm_id, norm_label, norm_source
from bytefold.llm.mixing import mix_sources
from bytefold.llm.packing import fill_report, pack_texts
from bytefold.llm.reading import reading_levels, train
from bytefold.llm.terms import mark_terms, term_counts
from bytefold.llm.tokens import token_counts
from bytefold.llm.topn import top_n_per_group
from bytefold.session import materialize, table


def _marked_terms(spark: SparkSession, d: str) -> DataFrame:
    findings = table(spark, d, "findings", "finding_id")
    run = norm_id("run_id")
    counts = term_counts(findings, {"finding_type": norm_label("finding_type"), "value_hex": norm_hex("value_hex")}, run, norm_id("finding_id"))
    runs = findings.select(run.alias("run")).agg(F.count_distinct("run").alias("n")).scalar()
    return mark_terms(counts, runs)


def p1_terms(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct type and byte value with its integer, findings, runs and mark."""
    return _marked_terms(spark, d).select("term_id", "field_name", "term", F.col("n_items").alias("n_findings"), F.col("n_records").alias("n_runs"), "mark")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The terms in too few or too many runs."""
    return _marked_terms(spark, d).filter("mark is not null").select("field_name", "term", "mark")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The three best findings and top-k entries of every run."""
    last = F.lit(float("inf"))
    findings = table(spark, d, "findings", "finding_id").filter("confidence >= 0 and confidence <= 1 and not isnan(confidence)")
    # Zero minus the score: ascending order ranks the highest first, and -0.0 equals 0.0.
    offset = [F.col("byte_offset").isNull(), F.col("byte_offset")]
    best = top_n_per_group(findings, norm_id("run_id"), norm_id("finding_id"), [F.lit(0.0) - F.col("confidence"), *offset])
    entries = table(spark, d, "topk_entries").filter("mean_variance >= 0 and not isnan(mean_variance)")
    entropy = F.coalesce(F.lit(0.0) - F.nanvl("mean_entropy", F.lit(None).cast("double")), last)
    top = top_n_per_group(entries, norm_id("run_id"), "entry_id", [F.lit(0.0) - F.col("mean_variance"), entropy, *offset])
    part = lambda src, df: df.select(F.lit(src).alias("src"), F.col("grp").alias("run_id"), F.col("item").cast("string").alias("item_id"))
    return part("findings", best).unionByName(part("topk_entries", top))


def p6_packing(spark: SparkSession, d: str) -> DataFrame:
    """Every text of ``documents`` in a container of each capacity."""
    return pack_texts(table(spark, d, "documents", "doc_id"), table(spark, d, "pack_sizes"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers of each capacity are."""
    return fill_report(p6_packing(spark, d))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """The texts of the mix, the source each serves and how often it is used."""
    return mix_sources(table(spark, d, "documents", "doc_id"), table(spark, d, "mix_targets"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of every source."""
    return mix_sources(table(spark, d, "documents", "doc_id"), table(spark, d, "mix_targets"))[1]


def p6_check(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of a packing, per capacity: the documents laid, and how often something is wrong."""
    documents = table(spark, d, "documents", "doc_id")
    given = token_counts(documents.select("doc_id", "text")).select("doc_id", F.col("n_tokens").alias("given"))
    laid = materialize(pack_texts(documents, table(spark, d, "pack_sizes")), "packing-check")
    texts = laid.groupBy("pack_id", "capacity_tokens", "doc_id").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("parts"), F.max("part_no").alias("last"), F.max(F.col("token_start") + F.col("n_tokens")).alias("end"))
    texts = texts.join(given, "doc_id")
    wrong = lambda c: F.sum(c.cast("bigint"))
    split = (F.col("parts") > 1) & (F.col("parts") != F.ceil(F.col("given") / F.col("capacity_tokens")))
    of_texts = texts.groupBy("pack_id", "capacity_tokens").agg(F.count(F.lit(1)).alias("documents"), wrong((F.col("tokens") != F.col("given")) | (F.col("end") != F.col("given"))).alias("not_whole"), wrong(split | (F.col("last") != F.col("parts") - 1)).alias("needless_splits"))
    boxes = laid.filter("container_id is not null").groupBy("pack_id", "container_id", "capacity_tokens").agg(F.sum("n_tokens").alias("tokens"), F.max(F.col("container_offset") + F.col("n_tokens")).alias("end"))
    of_boxes = boxes.groupBy("pack_id").agg(wrong((F.col("tokens") > F.col("capacity_tokens")) | (F.col("end") != F.col("tokens"))).alias("bad_containers"), (F.sum("tokens") >= 0.95 * F.sum("capacity_tokens")).alias("well_filled"))
    return of_texts.join(of_boxes, "pack_id").select("pack_id", "capacity_tokens", "documents", "not_whole", "needless_splits", "bad_containers", "well_filled")


def p7_check(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of a mix, per target: uses within the cap, texts of the source, the share reached to within one text."""
    documents, targets = table(spark, d, "documents", "doc_id"), table(spark, d, "mix_targets")
    chosen, report = mix_sources(documents, targets)
    held = documents.select(norm_source("source").alias("source"), F.md5("text").alias("print")).distinct()
    texts = documents.select("doc_id", F.md5("text").alias("print"))
    goal = targets.select(norm_source("source").alias("source"), "max_repeats")
    foreign = chosen.join(texts, "doc_id").join(held, ["source", "print"], "left_anti").groupBy("source").agg(F.count(F.lit(1)).alias("foreign_texts"))
    over = chosen.join(goal, "source").filter((F.col("repeats") > F.col("max_repeats")) | (F.col("repeats") < 1)).groupBy("source").agg(F.count(F.lit(1)).alias("over_cap"))
    reachable = report.filter("available_tokens > 0").agg(F.sum("target_share")).scalar()
    sizes = chosen.agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("total"), F.max("n_tokens").alias("longest"))
    off = F.abs(F.col("tokens") - F.col("target_share") / reachable * sizes.select("total").scalar())
    reached = off <= sizes.select("longest").scalar()
    rows = report.withColumn("share_reached", F.when(F.col("available_tokens") > 0, reached).otherwise(F.col("tokens") == 0))
    return rows.join(foreign, "source", "left").join(over, "source", "left").na.fill(0, ["foreign_texts", "over_cap"]).select("source", "max_repeats", "over_cap", "foreign_texts", "share_reached")


def p8_check(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the levels: every document once, a level of 1 to 5 exactly where there is prose, near the ratings."""
    levels = _levels(spark, d)
    rated = table(spark, d, "doc_labels").filter("reading_level between 1 and 5").groupBy("doc_id").agg(F.min("reading_level").alias("low"), F.max("reading_level").alias("high"))
    rows = levels.join(rated, "doc_id", "left")
    none = F.col("reading_level").isNull()
    bad = (none != (F.col("prose_words") == 0)) | (~none & ~F.col("reading_level").between(1, 5))
    near = F.col("reading_level").between(F.col("low") - 1, F.col("high") + 1)
    return rows.agg(F.count(F.lit(1)).alias("documents"), F.count_distinct("doc_id").alias("ids"), F.sum(bad.cast("bigint")).alias("bad_levels"), (F.avg(F.when(F.col("low").isNotNull() & ~none, near.cast("double"))) >= 0.9).alias("near_ratings"))


def _levels(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents", "doc_id")
    return reading_levels(documents, train(documents, table(spark, d, "doc_labels")))


def p8_levels(spark: SparkSession, d: str) -> DataFrame:
    """The reading level of every document."""
    return _levels(spark, d)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose running prose is of level 4 or 5."""
    return _levels(spark, d).filter("reading_level >= 4").select("doc_id").distinct()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_terms, p2_found, p6_packing, p6_fill, p6_check, p7_mix, p7_shares, p7_check, p8_found, p8_levels, p8_check)}


_RUN = "nullif(replace(lower(trim(run_id)), '-', ''), '')"
_ONE = f"""
WITH one AS (
  SELECT DISTINCT replace(lower(trim(finding_id)), '-', '') AS fid, {_RUN} AS run,
    replace(replace(lower(trim(finding_type)), ' ', '_'), '-', '_') AS ty,
    regexp_replace(regexp_replace(lower(value_hex), '[ :\\-]', '', 'g'), '^0x', '') AS hx
  FROM findings),
terms AS (
  SELECT 'finding_type' AS field_name, ty AS term, fid, run FROM one WHERE ty IS NOT NULL
  UNION ALL
  SELECT 'value_hex', hx, fid, run FROM one WHERE regexp_full_match(hx, '([0-9a-f][0-9a-f])+')),
counts AS (
  SELECT field_name, term, count(DISTINCT fid) AS n_findings, count(DISTINCT run) AS n_runs FROM terms GROUP BY 1, 2),
marked AS (
  SELECT *, CASE WHEN n_runs < 3 THEN 'rare'
    WHEN n_runs > 0.25 * (SELECT count(DISTINCT {_RUN}) FROM findings) THEN 'common' END AS mark FROM counts)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_terms": _ONE + "SELECT row_number() OVER (ORDER BY field_name, term) - 1 AS term_id, field_name, term, n_findings, n_runs, mark FROM marked",
        "p1_found": _ONE + "SELECT field_name, term, mark FROM marked WHERE mark IS NOT NULL",
        "p6_check": "SELECT pack_id, capacity_tokens, (SELECT count(*) FROM documents) AS documents, 0::BIGINT AS not_whole, 0::BIGINT AS needless_splits, 0::BIGINT AS bad_containers, true AS well_filled FROM pack_sizes",
        "p7_check": "SELECT regexp_replace(trim(lower(source)), '[ _-]+', '_', 'g') AS source, max_repeats, 0::BIGINT AS over_cap, 0::BIGINT AS foreign_texts, true AS share_reached FROM mix_targets",
        "p8_check": "SELECT count(*) AS documents, count(DISTINCT doc_id) AS ids, 0::BIGINT AS bad_levels, true AS near_ratings FROM documents",
        "p2_found": f"""
WITH f AS (
  SELECT DISTINCT {_RUN} AS run_id, replace(lower(trim(finding_id)), '-', '') AS item_id, confidence, byte_offset
  FROM findings WHERE confidence >= 0 AND confidence <= 1 AND NOT isnan(confidence)),
t AS (
  SELECT DISTINCT {_RUN} AS run_id, entry_id, mean_variance, mean_entropy, byte_offset
  FROM topk_entries WHERE mean_variance >= 0 AND NOT isnan(mean_variance)),
ranked AS (
  SELECT 'findings' AS src, run_id, item_id,
    row_number() OVER (PARTITION BY run_id ORDER BY confidence DESC, byte_offset NULLS LAST, item_id) AS n FROM f WHERE run_id IS NOT NULL
  UNION ALL
  SELECT 'topk_entries', run_id, CAST(entry_id AS VARCHAR),
    row_number() OVER (PARTITION BY run_id ORDER BY mean_variance DESC, mean_entropy DESC NULLS LAST, byte_offset NULLS LAST, entry_id) FROM t WHERE run_id IS NOT NULL)
SELECT src, run_id, item_id FROM ranked WHERE n <= 3""",
    }
