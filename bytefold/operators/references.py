"""References to records that don't exist, kept up incrementally.

The tracker holds four tables in the shared folder: the log of all references, the parent index, the
removals, and the pending orphans.  All are cut into ``parts`` folders by a hash of the key that is
referred to, and written in versions: an increment adds a version with only the parts it falls into,
and reads only these parts of the older ones.  New references probe the parent index; references to
parents that arrive, are removed or are restored are probed again (arrivals resolve orphans, removals
reopen them); all other pending orphans of a part are carried over.  Versions of one level are merged
into one of the next when there are ``fan`` of them, so a row is written again a few times only.
Counts per table and month can be snapshot at each increment.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bytefold.functions.normalize import month_of
from bytefold.session import path_exists, scratch_path

REFS = "child_table string, child_key string, parent_table string, ref string, micros bigint"
PARENTS = "parent_table string, ref string, parent_micros bigint"
REMOVALS = "parent_table string, ref string, removed_at string, restored boolean"
PENDING = REFS + ", ref_state string"
_SCHEMAS = {"refs": REFS, "parents": PARENTS, "removals": REMOVALS, "pending": PENDING}
_KEY = ["parent_table", "ref"]
#: Files into which the references to one part are spread, as a key may hold a third of all rows.
_SALT = 8


class OrphanTracker:
    """Pending orphan references, brought forward by ``advance``.

    Defined cases: a null reference is none; a row without an own id can't be named and is left
    out; several rows of one child count once, with their earliest known time; a parent's time is
    the earliest of its rows; a null time on either side is never late; a key that is removed and
    not restored is ``deleted`` whether or not its row is there; empty increments change nothing.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, parts: int = 256, fan: int = 4) -> None:
        self.spark, self.root, self.parts, self.fan = spark, root or scratch_path(spark, "orphans"), parts, fan
        #: Per table the versions to read: number, level, and the parts in which it is the valid one.
        self.version, self.tables, self.counted = 0, {name: [] for name in _SCHEMAS}, []
        if path_exists(spark, f"{self.root}/commits"):
            last = spark.read.parquet(f"{self.root}/commits").orderBy(F.desc("version")).first()
            if last is not None:
                state = json.loads(last["state"])
                self.version, self.tables, self.counted, self.parts = last["version"], state["tables"], state["counted"], state["parts"]

    # ---- versions

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(*_KEY), F.lit(self.parts)).cast("int").alias("part")

    def _read(self, name: str, parts: list[int] | None = None) -> DataFrame:
        """A table as of the last commit, or some parts of it; no other folder is opened."""
        frames = []
        for v in self.tables[name]:
            wanted = v["parts"] if parts is None else sorted(set(v["parts"]) & set(parts))
            if wanted:
                df = self.spark.read.schema(_SCHEMAS[name] + ", part int").parquet(f"{self.root}/{name}/v{v['version']}")
                frames.append(df.filter(F.col("part").isin(wanted)))
        empty = lambda: self.spark.createDataFrame([], _SCHEMAS[name] + ", part int")
        return reduce(DataFrame.unionByName, frames) if frames else empty()

    def _write(self, df: DataFrame, name: str, version: int, salt: str | None = None) -> list[int]:
        """Write rows by their part; the parts that have any."""
        path = f"{self.root}/{name}/v{version}"
        spread = [F.col("part"), *([F.pmod(F.xxhash64(salt), F.lit(_SALT))] if salt else [])]
        df.repartition(*spread).write.mode("overwrite").partitionBy("part").parquet(path)
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        found = place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(place)
        return sorted(int(f.getPath().getName().split("=")[1]) for f in found if f.getPath().getName().startswith("part="))

    def _written(self, name: str, version: int, parts: list[int]) -> DataFrame:
        schema = _SCHEMAS[name] + ", part int"
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}/v{version}") if parts else self.spark.createDataFrame([], schema)

    def _merge(self, tables: dict, name: str, version: int) -> list[dict]:
        """Merge the versions of one level when there are many; those of the pending table replace each other."""
        kept, level = tables[name], 0
        while len(same := [v for v in kept if v["level"] == level]) >= self.fan:
            label = f"{version}-{level + 1}"
            frames = [self.spark.read.schema(_SCHEMAS[name] + ", part int").parquet(f"{self.root}/{name}/v{v['version']}").filter(F.col("part").isin(v["parts"])) for v in same]
            parts = self._write(reduce(DataFrame.unionByName, frames), name, label, "child_key" if name in ("refs", "pending") else None)
            kept = [v for v in kept if v["level"] != level] + [{"version": label, "level": level + 1, "parts": parts}]
            level += 1
        return kept

    # ---- increments

    @staticmethod
    def _probe(refs: DataFrame, parents: DataFrame, removals: DataFrame) -> DataFrame:
        """The references that fail, with their state."""
        since = parents.groupBy(*_KEY).agg(F.min("parent_micros").alias("parent_micros"))
        gone = removals.groupBy(*_KEY, "removed_at").agg(F.max("restored").alias("restored")).filter("not restored")
        index = since.withColumn("there", F.lit(True)).join(gone.select(*_KEY).distinct().withColumn("gone", F.lit(True)), _KEY, "full")
        late = F.col("parent_micros") > F.col("micros")
        state = F.when(F.col("gone"), "deleted").when(F.col("there").isNull(), "absent").when(late, "late")
        return refs.join(index, _KEY, "left").withColumn("ref_state", state).filter("ref_state is not null").select("child_table", "child_key", *_KEY, "micros", "ref_state", "part")

    def advance(self, refs: DataFrame | None = None, parents: DataFrame | None = None, removals: DataFrame | None = None, snapshot: bool = True) -> DataFrame:
        """Take in one increment, commit it, and return the pending orphans after it.

        ``refs``: ``child_table, child_key, parent_table, ref, micros``; ``parents``:
        ``parent_table, ref, parent_micros``; ``removals``: ``parent_table, ref, removed_at,
        restored`` (a restoration repeats the removal with ``restored`` true).
        """
        version = self.version + 1
        tables = {name: [dict(v) for v in versions] for name, versions in self.tables.items()}
        given = {
            "refs": refs and refs.filter("child_key is not null and ref is not null").select("child_table", "child_key", *_KEY, "micros"),
            "parents": parents and parents.filter("ref is not null").groupBy(*_KEY).agg(F.min("parent_micros").alias("parent_micros")),
            "removals": removals and removals.filter("ref is not null").select(*_KEY, "removed_at", "restored").distinct(),
        }
        new: dict[str, list[int]] = {}
        for name, df in given.items():
            new[name] = self._write(df.withColumn("part", self._part()), name, version, "child_key" if name == "refs" else None) if df is not None else []
            if new[name]:
                tables[name].append({"version": version, "level": 0, "parts": new[name]})
        touched = sorted(set().union(*new.values()))
        if touched:
            changed = [self._written(name, version, new[name]).select(*_KEY) for name in ("parents", "removals") if new[name]]
            old_refs, old_pending = self._read("refs", touched), self._read("pending", touched)
            probed, carried = self._written("refs", version, new["refs"]), old_pending
            if changed:
                keys = reduce(DataFrame.unionByName, changed).distinct()
                probed = probed.unionByName(old_refs.join(keys, _KEY, "left_semi").select(probed.columns))
                carried = old_pending.join(keys, _KEY, "left_anti").select(old_pending.columns)
            index = self._read("parents", touched).unionByName(self._written("parents", version, new["parents"]))
            out = self._read("removals", touched).unionByName(self._written("removals", version, new["removals"]))
            self._write(self._probe(probed, index, out).unionByName(carried), "pending", version, "child_key")
            for v in tables["pending"]:
                v["parts"] = [p for p in v["parts"] if p not in touched]
            tables["pending"].append({"version": version, "level": 0, "parts": touched})
        for name in tables:
            tables[name] = self._merge(tables, name, version) if touched else tables[name]
            tables[name] = [v for v in tables[name] if v["parts"]]
        before, self.tables = self.tables, tables
        try:
            if snapshot:
                counts = self.report(self.pending()).groupBy("child_table", "month_utc", "ref_state").agg(F.count(F.lit(1)).alias("orphans"))
                counts.withColumn("version", F.lit(version)).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/counts/v{version}")
            counted = [*self.counted, version] if snapshot else self.counted
            # The commit names the versions of every table; until it is there the step never happened.
            state = json.dumps({"tables": tables, "counted": counted, "parts": self.parts})
            self.spark.range(1).select(F.lit(version).alias("version"), F.lit(state).alias("state")).coalesce(1).write.mode("append").parquet(f"{self.root}/commits")
        except BaseException:
            self.tables = before
            raise
        self.version, self.counted = version, counted
        return self.pending()

    def pending(self) -> DataFrame:
        """The pending orphans as of the last commit."""
        return self._read("pending").drop("part")

    def counts(self) -> DataFrame:
        """All count snapshots: ``child_table, month_utc, ref_state, orphans, version``."""
        schema = "child_table string, month_utc string, ref_state string, orphans bigint, version int"
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/counts/v{v}" for v in self.counted)) if self.counted else self.spark.createDataFrame([], schema)

    @staticmethod
    def report(pending: DataFrame) -> DataFrame:
        """One row per child: ``child_table, child_key, month_utc, ref_state``.

        Copies of one child that fail differently count once: deleted before absent before late.
        """
        rank = F.when(F.col("ref_state") == "deleted", 0).when(F.col("ref_state") == "absent", 1).otherwise(2)
        one = pending.groupBy("child_table", "child_key").agg(F.min("micros").alias("micros"), F.min(rank).alias("rank"))
        state = F.element_at(F.array(F.lit("deleted"), F.lit("absent"), F.lit("late")), F.col("rank") + 1)
        return one.select("child_table", "child_key", month_of(F.col("micros")).alias("month_utc"), state.alias("ref_state"))
