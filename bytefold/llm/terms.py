"""Frequency of every distinct term: occurrences, records holding it, and a usefulness mark.

Plan, after the rows of one item were made one and written to the shared folder:

1. the global dictionary: each block's distinct terms with their counts go to ranges of (field,
   term); the sorted ranges are numbered on, so a term's integer is its rank among all terms, the
   same on each execution;
2. terms are encoded: the few terms that hold much of the rows (``HOT_SHARE``) by a broadcast map,
   all others by a join with the dictionary, so no term's rows are gathered in one task;
3. the rows, now pairs of integer and record, are counted by pair; each block of pairs becomes
   count arrays (occurrences, records) over the integers it holds;
4. the arrays meet by identifier range, where the dictionary's own rows of the range wait for them,
   and are summed one range at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytefold.session import materialize

#: Rows of one block; bounds the memory of a local dictionary.
BLOCK_ROWS = 262_144
#: Identifiers of one range; bounds the memory of its count arrays.
RANGE = 1 << 16
#: A term with more than this share of all rows is encoded by broadcast: at most 1 / share terms are.
HOT_SHARE = 0.001

_LOCAL = "field_name string, term string, n bigint"
_NUMBERED = "part int, place bigint, field_name string, term string, n bigint"
_ARRAYS = "term_id bigint, n_items bigint, n_records bigint"
_COUNTS = "term_id bigint, field_name string, term string, n_items bigint, n_records bigint"


def _blocks(batches: Iterator[pa.RecordBatch], work) -> Iterator[pa.RecordBatch]:
    """``work`` on blocks of at least ``BLOCK_ROWS`` rows."""
    block: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if batch.num_rows:
            block.append(batch)
            rows += batch.num_rows
        if rows >= BLOCK_ROWS:
            yield work(pa.Table.from_batches(block))
            block, rows = [], 0
    if block:
        yield work(pa.Table.from_batches(block))


def _local_dictionary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct terms of each block with their rows: a hot term leaves a block as one row."""

    def distinct(rows: pa.Table) -> pa.RecordBatch:
        counted = rows.group_by(["field_name", "term"]).aggregate([([], "count_all")])
        arrays = [counted[c].combine_chunks() for c in ("field_name", "term", "count_all")]
        return pa.RecordBatch.from_arrays(arrays, names=["field_name", "term", "n"])

    return _blocks(batches, distinct)


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the distinct terms of a sorted range: equal neighbours are one term."""
    from pyspark import TaskContext

    part, place = TaskContext.get().partitionId(), 0
    held: tuple | None = None
    out: list[tuple] = []

    def put() -> pa.RecordBatch:
        types = [pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        columns = list(zip(*out)) if out else [[] for _ in types]
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[f.split()[0] for f in _NUMBERED.split(", ")])
        out.clear()
        return batch

    for batch in batches:
        for field, term, n in zip(*(batch.column(c).to_pylist() for c in ("field_name", "term", "n"))):
            if held is not None and held[:2] == (field, term):
                held = (field, term, held[2] + n)
                continue
            if held is not None:
                out.append((part, place, *held))
                place += 1
            held = (field, term, n)
        if len(out) >= RANGE:
            yield put()
    if held is not None:
        out.append((part, place, *held))
    yield put()


def dictionary_of(pairs: DataFrame) -> DataFrame:
    """The global dictionary of ``(field_name, term)`` rows: ``term_id, field_name, term, n``.

    A term's id is its rank by field and term (by bytes); ``n`` is its number of rows.
    """
    spark = pairs.sparkSession
    local = materialize(pairs.select("field_name", "term").mapInArrow(_local_dictionary, _LOCAL), "terms-local")
    numbered = materialize(local.repartitionByRange("field_name", "term").sortWithinPartitions("field_name", "term").mapInArrow(_number, _NUMBERED), "terms-numbered")
    # One row per partition comes to the driver and goes back as the ranges' first numbers.
    sizes = {r["part"]: r["n"] for r in numbered.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, first = [], 0
    for part in sorted(sizes):
        starts.append((part, first))
        first += sizes[part]
    start = spark.createDataFrame(starts, "part int, first bigint")
    return numbered.join(F.broadcast(start), "part").select((F.col("first") + F.col("place")).alias("term_id"), "field_name", "term", "n")


def encode(pairs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``pairs(field_name, term, …)`` with ``term_id`` in place of the two.

    A term over ``HOT_SHARE`` of all rows is looked up in a broadcast map; there are at most
    1 / ``HOT_SHARE`` of them, whatever the data.
    """
    rest = [c for c in pairs.columns if c not in ("field_name", "term")]
    total = dictionary.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") > HOT_SHARE * total
    hot = dictionary.filter(is_hot).select("field_name", "term", F.col("term_id").alias("hot_id"))
    marked = pairs.join(F.broadcast(hot), ["field_name", "term"], "left")
    cold = marked.filter("hot_id is null").join(dictionary.filter(~is_hot).select("field_name", "term", "term_id"), ["field_name", "term"])
    return marked.filter("hot_id is not null").select(F.col("hot_id").alias("term_id"), *rest).unionByName(cold.select("term_id", *rest))


def _count_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's count arrays over the integers it holds."""

    def count(rows: pa.Table) -> pa.RecordBatch:
        ids, codes = np.unique(rows["term_id"].to_numpy(), return_inverse=True)
        arrays = []
        for c in ("n_items", "n_records"):
            total = np.zeros(len(ids), dtype=np.int64)
            np.add.at(total, codes, rows[c].to_numpy())
            arrays.append(pa.array(total))
        return pa.RecordBatch.from_arrays([pa.array(ids), *arrays], names=["term_id", "n_items", "n_records"])

    return _blocks(batches, count)


def _sum_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum the arrays of one identifier range after the other and put them beside its terms."""
    at, items, records, terms = None, None, None, []

    def put() -> pa.RecordBatch:
        ids = np.array([t[0] for t in terms], dtype=np.int64)
        local = ids - at * RANGE
        arrays = [pa.array(ids), pa.array([t[1] for t in terms], pa.string()), pa.array([t[2] for t in terms], pa.string()), pa.array(items[local]), pa.array(records[local])]
        return pa.RecordBatch.from_arrays(arrays, names=["term_id", "field_name", "term", "n_items", "n_records"])

    for batch in batches:
        ids = batch.column("term_id").to_numpy()
        n_items, n_records = (batch.column(c).fill_null(0).to_numpy() for c in ("n_items", "n_records"))
        names = list(zip(batch.column("field_name").to_pylist(), batch.column("term").to_pylist()))
        edges = np.flatnonzero(np.diff(ids // RANGE)) + 1
        for low, high in zip([0, *edges.tolist()], [*edges.tolist(), len(ids)]):
            if low == high:
                continue
            here = int(ids[low]) // RANGE
            if here != at:
                if at is not None:
                    yield put()
                at, items, records, terms = here, np.zeros(RANGE, dtype=np.int64), np.zeros(RANGE, dtype=np.int64), []
            local = ids[low:high] - at * RANGE
            np.add.at(items, local, n_items[low:high])
            np.add.at(records, local, n_records[low:high])
            terms += [(i, *name) for i, name in zip(ids[low:high].tolist(), names[low:high]) if name[0] is not None]
    if at is not None:
        yield put()


def _compact(id_: Column) -> Column:
    """An id as bytes: 32 hex digits as 16 bytes, anything else as its text behind a zero byte."""
    return F.when(id_.rlike("^[0-9a-f]{32}$"), F.unhex(id_)).otherwise(F.encode(F.concat(F.lit("\x00"), id_), "UTF-8"))


def term_counts(items: DataFrame, terms: dict[str, Column | str], record: Column | str, item: Column | str | None = None) -> DataFrame:
    """Count every distinct term of each field over all items.

    ``terms`` maps a field name to the expression of its term; ``record`` is the record an item
    belongs to; ``item`` is the item's id.  Returns ``term_id, field_name, term, n_items,
    n_records``, one row per distinct term; ``term_id`` is the term's rank by field and term.

    Defined cases: a null term is no term; an item with a null record counts as an item but for
    no record; rows with one item id count once, by the smallest (record, terms) among them; rows
    with a null id each count as an item; an empty input gives no row.  Further columns of
    ``items`` are never read, whatever their names.
    """
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    body = [_compact(as_col(record).cast("string")).alias("rec"), *(as_col(c).alias(f"t{i}") for i, c in enumerate(terms.values()))]
    if item is None:
        rows = items.select(*body)
    else:
        own = F.coalesce(_compact(as_col(item).cast("string")), F.encode(F.concat(F.lit("\x00\x00"), F.monotonically_increasing_id().cast("string")), "UTF-8"))
        rows = items.select(own.alias("item"), F.struct(*body).alias("row")).groupBy("item").agg(F.min("row").alias("row")).select("row.*")
    rows = materialize(rows, "terms-rows")
    fields = F.array(*(F.struct(F.lit(name).alias("field_name"), F.col(f"t{i}").alias("term")) for i, name in enumerate(terms)))
    pairs = rows.select("rec", F.explode(fields).alias("p")).select("p.field_name", "p.term", "rec").filter(F.col("term").isNotNull())
    dictionary = dictionary_of(pairs)
    counted = encode(pairs, dictionary).groupBy("term_id", "rec").agg(F.count(F.lit(1)).alias("n_items"))
    arrays = counted.select("term_id", "n_items", F.col("rec").isNotNull().cast("bigint").alias("n_records")).mapInArrow(_count_arrays, _ARRAYS)
    blank = lambda kind: F.lit(None).cast(kind)
    both = arrays.select("term_id", blank("string").alias("field_name"), blank("string").alias("term"), "n_items", "n_records").unionByName(dictionary.select("term_id", "field_name", "term", blank("bigint").alias("n_items"), blank("bigint").alias("n_records")))
    by_range = both.repartition(F.floor(F.col("term_id") / RANGE)).sortWithinPartitions("term_id")
    return by_range.mapInArrow(_sum_ranges, _COUNTS)


def mark_terms(counts: DataFrame, total_records: Column, rare_below: int = 3, common_above: float = 0.25) -> DataFrame:
    """Add ``mark``: ``rare`` under ``rare_below`` records, ``common`` over the share ``common_above``.

    A term that is both (few records in all) is ``rare``; other terms get null.
    """
    mark = F.when(F.col("n_records") < rare_below, "rare").when(F.col("n_records") > F.lit(common_above) * total_records, "common")
    return counts.withColumn("mark", mark)
