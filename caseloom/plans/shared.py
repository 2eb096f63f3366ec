"""Tables written between the steps of a job, in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

#: Keys with more rows than HOT_ROWS are spread, the HOT_KEYS heaviest of them, each over SALTS partitions.
HOT_ROWS, HOT_KEYS, SALTS = 10_000, 512, 64


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, or the checkpoint folder that the session's owner set.

    Without one, a session whose driver and tasks are one process on one machine, as in tests, gets a folder of its
    own; on a cluster this raises, since a folder made up here wouldn't be one for all executors."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if not context.getCheckpointDir():
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="caseloom-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


class Scratch:
    """Tables of one job. ``keep`` writes a table and reads it back, which cuts the lineage and survives the loss of
    executors; ``drop`` deletes one that no later step reads. The folder of the whole job goes with ``close``.

    Result frames are lazy, so the tables under a result stay until the session's owner calls ``close`` or clears the
    shared folder."""

    def __init__(self, spark: SparkSession, name: str, root: str | None = None):
        """``root`` names a lasting folder of the caller's; otherwise a new one is made in the shared folder."""
        self.spark = spark
        self.root = root.rstrip("/") if root else f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, table: str) -> DataFrame:
        path = f"{self.root}/{table}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep_counted(self, df: DataFrame, table: str, **wanted: Column) -> tuple[DataFrame, dict]:
        """:meth:`keep`, with aggregates over the rows that are taken as they are written: no further job reads them."""
        seen = Observation()
        kept = self.keep(df.observe(seen, *[c.alias(name) for name, c in wanted.items()]), table)
        return kept, seen.get

    def has(self, path: str) -> bool:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}")
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target)

    def names(self, path: str) -> list[str]:
        """What lies in a folder."""
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}")
        return [s.getPath().getName() for s in target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(target)]

    def drop(self, *tables: str) -> None:
        for table in tables:
            self._delete(f"{self.root}/{table}")

    def close(self) -> None:
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def hot_keys(df: DataFrame, key: str, rows: int | None = None, least: int = HOT_ROWS, most: int = HOT_KEYS) -> list[Row]:
    """The heaviest keys with more than ``least`` rows, at most ``most`` of them; null is no key.

    A key that isn't among them holds at most 1 / most of all rows, so every skew worth spreading is in the list, and
    the list is bounded whatever the table is. Counts are combined before the shuffle; where the number of ``rows`` is
    known and too small for any hot key, nothing is counted."""
    if rows is not None and rows <= least:
        return []
    counts = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(key)).agg(F.count(F.lit(1)).alias("n"))
    return heaviest(counts, key, least, most)


def heaviest(counts: DataFrame, key: str, least: int = HOT_ROWS, most: int = HOT_KEYS, *, highest: int | None = None) -> list[Row]:
    """:func:`hot_keys`, with ``n``, of a table that has each key once with its number of rows ``n``. Where the
    ``highest`` number is known and isn't hot, nothing is read."""
    if highest is not None and highest <= least:
        return []
    return counts.where(F.col("n") > least).orderBy(F.desc("n")).limit(most).select(key, "n").collect()


def hot_rows() -> int:
    """The number of rows above which :func:`heaviest` calls a key hot."""
    return heaviest.__defaults__[0]


def salted_lookup(facts: DataFrame, table: DataFrame, key: str, hot: list[Row], spread: Column, how: str = "inner") -> DataFrame:
    """``facts`` joined with ``table`` on ``key``, rows of hot keys spread over SALTS partitions by ``spread``.

    Only the table's rows of hot keys are repeated. Without hot keys this is a plain join. ``how`` is inner or left."""
    if not hot:
        return facts.join(table, key, how)
    kind = table.schema[key]
    marks = facts.sparkSession.createDataFrame([(r[0], True) for r in hot], StructType([StructField(key, kind.dataType), StructField("_hot", BooleanType())]))
    marks = F.broadcast(marks)  # at most HOT_KEYS rows
    salt = F.when(F.col("_hot"), F.pmod(spread, F.lit(SALTS))).otherwise(0).cast("int")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = facts.join(marks, key, "left").withColumn("_salt", salt).drop("_hot")
    right = table.join(marks, key, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return left.join(right, [key, "_salt"], how).drop("_salt")
