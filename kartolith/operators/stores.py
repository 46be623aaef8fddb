"""Tables that are updated once per sequence however often it is replayed.

A table is a folder of numbered Parquet snapshots and a pointer, swapped after the new snapshot is
complete; merges are joins and aggregations, so any number of rows may change at once.  A table that
must move with another follows it: one pointer names the snapshots of both, so a crash leaves both old or both new.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class SnapshotTable:
    """Parquet snapshots under ``path``; readers see the one the pointer names."""

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.leader: SnapshotTable | None = None

    def follow(self, leader: SnapshotTable) -> None:
        """From now on the leader's pointer names this table's snapshot, too."""
        self.leader = leader

    def _pointer(self) -> tuple[int, int]:
        try:
            newest = self.spark.read.schema("version long, follower long").parquet(f"{self.path}/_pointer_*").agg(F.max(F.struct("version", F.coalesce("follower", F.lit(0)).alias("follower"))).alias("p"))
            found = newest.first()[0]
            return (found.version, found.follower) if found else (0, 0)
        except AnalysisException:
            return 0, 0

    def version(self) -> int:
        return self.leader._pointer()[1] if self.leader else self._pointer()[0]

    def read(self) -> DataFrame:
        v = self.version()
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{v}") if v else self.spark.createDataFrame([], self.schema)

    def replace(self, df: DataFrame, follower: SnapshotTable | None = None, rows: DataFrame | None = None) -> int:
        """Swaps in df; with a follower, its rows in the same step."""
        v, f = self._pointer()
        v += 1
        df.write.mode("overwrite").parquet(f"{self.path}/v{v}")
        if follower is not None:
            f += 1
            rows.write.mode("overwrite").parquet(f"{follower.path}/v{f}")
        self._swap(v, f)
        return v

    def _swap(self, version: int, follower: int) -> None:
        pointer = self.spark.range(1).select(F.lit(version).cast("long").alias("version"), F.lit(follower).cast("long").alias("follower"))
        pointer.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/_pointer_{version}")


def fresh_rows(new: DataFrame, applied: DataFrame, *keys: str) -> DataFrame:
    """Rows whose (keys, sequence) has not been applied."""
    return new.join(applied.select(*keys, "sequence"), [*keys, "sequence"], "left_anti")


def upsert_counts(stored: DataFrame, new: DataFrame, applied: DataFrame, key: str = "changeset") -> tuple[DataFrame, DataFrame]:
    """(table, applied): long (key, name, value) rows of new sequences added to the stored ones."""
    return upsert_fresh(stored, fresh_rows(new, applied, key), applied, key)


def upsert_fresh(stored: DataFrame, fresh: DataFrame, applied: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """``upsert_counts`` of rows whose (key, sequence) is known not to have been applied."""
    table = stored.select(key, "name", "value").unionByName(fresh.select(key, "name", "value")).groupBy(key, "name").agg(F.sum("value").alias("value"))
    return table, applied.select(key, "sequence").union(fresh.select(key, "sequence").distinct())


def upsert_latest(stored: DataFrame, new: DataFrame, key: str, *order: str) -> DataFrame:
    """The last write by order wins; of equal rank the new one."""
    both = stored.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    last = Window.partitionBy(key).orderBy(*[F.desc(c) for c in (*order, "__new")])
    return both.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n", "__new")


def insert_absent(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return stored.unionByName(new.dropDuplicates([key]).join(stored.select(key), key, "left_anti").select(*stored.columns))


def rename_users(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """id, name: new users added, known ones renamed."""
    s, n = stored.alias("s"), seen.groupBy("id").agg(F.max("name").alias("name")).alias("n")
    return s.join(n, "id", "full_outer").select("id", F.coalesce("n.name", "s.name").alias("name"))


def assign_ids(stored: DataFrame, names: DataFrame, name: str = "hashtag") -> DataFrame:
    """id, name: absent names get the next identifiers.

    Numbers come from counts per range partition and a rank within it, so no task sorts all names.
    """
    fresh = names.select(name).where(F.col(name).isNotNull()).distinct().join(stored.select(name), name, "left_anti")
    start = stored.agg(F.max("id")).first()[0] or 0
    parts = fresh.withColumn("bucket", F.substring(F.md5(name), 1, 2))
    sizes = parts.groupBy("bucket").agg(F.count("*").alias("n"))  # 256 rows at most
    before = sizes.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy(name))
    numbered = parts.withColumn("place", place).join(F.broadcast(before), "bucket")
    return stored.select("id", name).union(numbered.select((F.lit(start) + F.col("before") + F.col("place")).cast("long").alias("id"), name))


def save_checkpoint(stored: DataFrame, process: str, sequence: int) -> DataFrame:
    new = stored.sparkSession.createDataFrame([(process, sequence)], "proc_name string, sequence long")
    return stored.where(F.col("proc_name") != process).unionByName(new)


def checkpoint_lag(checkpoints: DataFrame, now_sequence: int, threshold: int = 10) -> DataFrame:
    """proc_name, sequence, behind, alert."""
    behind = F.lit(now_sequence).cast("long") - F.col("sequence")
    return checkpoints.select("proc_name", "sequence", behind.alias("behind"), (behind >= threshold).alias("alert"))


def split_errors(rows: DataFrame, valid) -> tuple[DataFrame, DataFrame]:
    """Rows that satisfy the predicate, and the others for the error table."""
    ok = F.coalesce(valid, F.lit(False))
    return rows.where(ok), rows.where(~ok)


_REFRESHING: set[str] = set()


def refresh(view: DataFrame, table: SnapshotTable, name: str, stamps: DataFrame) -> DataFrame:
    """Recomputes a view into its table and stamps it; a view that this driver is refreshing already is left alone."""
    if table.path in _REFRESHING:
        return stamps
    _REFRESHING.add(table.path)
    try:
        table.replace(view)
    finally:
        _REFRESHING.discard(table.path)
    return stamps.where(F.col("mat_view") != name).unionByName(stamps.sparkSession.range(1).select(F.lit(name).alias("mat_view"), F.current_timestamp().alias("updated_at")))


def upsert_countries(stored: DataFrame | None, new: DataFrame, applied: DataFrame | None, countries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(table, applied): changeset, country_id, edit_count after adding rows (changeset, sequence, code, edit_count); unknown codes go."""
    fresh = new if applied is None else fresh_rows(new, applied, "changeset")
    named = fresh.join(countries.select(F.col("id").alias("country_id"), "code"), "code").select("changeset", "country_id", "edit_count")
    both = named if stored is None else stored.unionByName(named)
    known = fresh.select("changeset", "sequence")
    return both.groupBy("changeset", "country_id").agg(F.sum("edit_count").alias("edit_count")), (known if applied is None else applied.select("changeset", "sequence").union(known)).distinct()


def bridge_rows(pairs: DataFrame, named: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """changeset, hashtag_id once a pair, pairs stored before included."""
    rows = pairs.join(named.select(F.col("id").alias("hashtag_id"), "hashtag"), "hashtag").select("changeset", "hashtag_id")
    return (rows if stored is None else stored.select("changeset", "hashtag_id").union(rows)).distinct()


def saved_sequence(checkpoints: DataFrame, process: str) -> int | None:
    row = checkpoints.where(F.col("proc_name") == process).agg(F.max("sequence")).first()
    return row[0]


def log_errors(rows: DataFrame, path: str, reason: str) -> None:
    """Appends failed rows with the reason and the time."""
    rows.withColumns({"reason": F.lit(reason), "at": F.current_timestamp()}).write.mode("append").parquet(path)


def write_partitions(df: DataFrame, path: str, writers: int = 64) -> None:
    """df written by at most ``writers`` tasks at a time."""
    df.repartition(writers).write.mode("append").parquet(path)
